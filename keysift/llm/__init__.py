"""Operators for training-data pipelines: tokens, quality, near duplicates, archives, packing.

Nothing outside this subpackage imports it; its queries are in ``keysift.llm.queries``.
"""
