"""Words of whole texts in parts of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of text that are split into words at a time.
PART = 1 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def parts(text: bytes, between: re.Pattern[bytes], size: int = PART) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut before a byte that ``between`` matches, hence never
    inside a word; one longer word is one part."""
    at = 0
    while len(text) - at > size:
        found = between.search(text, at + size)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]
