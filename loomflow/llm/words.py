"""Words: longest runs of Unicode letters and digits, in lower case."""

from __future__ import annotations

import re

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []

