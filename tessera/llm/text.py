"""Tokenising shared by the operators of this package."""

from __future__ import annotations

import re

#: Letters, digits and underscore; Python's ``\w`` on str is exactly [\p{L}\p{N}_].
TERM = re.compile(r"\w+")


def terms(text: str | None) -> list[str]:
    """Terms of the lower-cased text; null and empty give an empty list."""
    return TERM.findall(text.lower()) if text else []
