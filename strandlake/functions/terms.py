"""The search terms of one text, as ``text.search_tokens`` gives them as a column."""

from __future__ import annotations

import re
from operator import add

_LATIN, _HAN = re.compile(r"[a-z0-9][a-z0-9.+#:_/-]*"), re.compile(r"[㐀-鿿]+")


def terms_of(text: str | None) -> list[str]:
    """Latin terms, then the single characters of each Han run followed by its pairs."""
    low = (text or "").lower()
    terms = _LATIN.findall(low)
    for run in _HAN.findall(low):
        terms += run
        terms += map(add, run, run[1:])
    return terms
