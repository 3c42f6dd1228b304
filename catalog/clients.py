"""A text-model client that needs no network."""

from __future__ import annotations

import json
from collections.abc import Callable

from keysift.operators.prompts import AFTER_CONTENT, BEFORE_CONTENT


def line_flagger(needle: str, kind: str) -> Callable[..., Callable[[str], str]]:
    """A client factory; the client names every content line that holds ``needle``.

    Plain nested functions travel to the executors by value, without this package.
    """
    def client(_options) -> Callable[[str], str]:
        def answer(prompt: str) -> str:
            content = prompt.split(BEFORE_CONTENT, 1)[1].rsplit(AFTER_CONTENT, 1)[0]
            return json.dumps([
                {"line": i, "snippet": line, "type": kind, "confidence": "medium", "rationale": f"Has {needle}"}
                for i, line in enumerate(content.split("\n"), 1) if needle in line])
        return answer
    return client


def refuser(needle: str) -> Callable[..., Callable[[str], str]]:
    """A client factory; calls with ``needle`` in the content fail, others find nothing."""
    def client(_options) -> Callable[[str], str]:
        def answer(prompt: str) -> str:
            if needle in prompt.split(BEFORE_CONTENT, 1)[1].rsplit(AFTER_CONTENT, 1)[0]:
                raise RuntimeError("refused")
            return "[]"
        return answer
    return client


def absent_in(inner: Callable[..., Callable[[str], str]], tasks: str) -> Callable[..., object]:
    """A factory of clients of ``inner`` that are not available in some tasks: those of an odd number, or all."""
    def client(options) -> object:
        from pyspark import TaskContext

        class Provider:
            def is_available(self) -> bool:
                return tasks == "odd" and TaskContext.get().partitionId() % 2 == 0

            def initialize(self) -> bool:
                self.answer = inner(options)
                return True

            def __call__(self, prompt: str) -> str:
                return self.answer(prompt)

        return Provider()
    return client
