"""Prompts for the text model and the key their answers are cached under."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysift.operators.rules import RuleSet

# Content limit and the default model's options.
CONTENT_CHARS = 3000
DEFAULT_MODEL = "llama3.2"
DEFAULT_OPTIONS = {"temperature": 0.1, "top_p": 0.9, "num_predict": 10000}

BEFORE_RULES = """\
Find hardcoded secrets in the content below. These kinds matter most:
"""
BEFORE_CONTENT = """

Content:
```
"""
AFTER_CONTENT = """
```

Answer with a JSON array and nothing else: no prose and no code fence. Each secret is
one object with exactly these keys:
[{{"line": <line of the content, from 1>, "snippet": "<the code>", "type": "<kind>", \
"confidence": "high|medium|low", "rationale": "<why>"}}]
Without a secret, answer [].
"""


@dataclass(frozen=True)
class ModelOptions:
    """Which model answers and how; part of the cache key."""

    model: str = DEFAULT_MODEL
    options: dict = field(default_factory=lambda: dict(DEFAULT_OPTIONS))

    def options_text(self) -> str:
        return json.dumps(self.options, sort_keys=True)


def double_braces(content: Column) -> Column:
    return F.replace(F.replace(content, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def clamp_content(content: Column, limit: int = CONTENT_CHARS) -> Column:
    """The content's head with doubled braces, cut to the limit again: doubling may
    push text out, and the cut may halve a pair. It drops text, so nothing in a scan uses it:
    there, chunks are cut so that they fit."""
    return F.substring(double_braces(F.substring(content, 1, limit)), 1, limit)


def prompt(content: Column, rules: RuleSet) -> Column:
    """The whole content in a prompt; ``clamp_content`` or chunks keep it within a model's limit."""
    return F.concat(F.lit(BEFORE_RULES + rules.describe() + BEFORE_CONTENT),
                    double_braces(content), F.lit(AFTER_CONTENT))


def cache_key(content: Column, rules: RuleSet, model: ModelOptions) -> Column:
    """Everything an answer depends on, hashed."""
    return F.sha2(F.concat_ws("\u0000", F.lit(model.model), F.lit(model.options_text()),
                              F.lit(rules.digest()), content), 256)
