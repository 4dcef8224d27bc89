"""Splitting one text into pieces of bounded length: a small helper that the chunk operators call for each row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

#: The tokens of the chunk budget.
BUDGET_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+#:_/-]*|[㐀-鿿]|[^\sA-Za-z0-9㐀-鿿]")
#: Separators by rank. Those of PATTERNS are patterns, so that its ". " is any character and a blank;
#: those of parts of a budget and of children are literal.
PATTERNS = ("\\n#{1,6} ", "\\n\\n", "\\n", "。", ". ", " ", "")
BUDGET_LITERALS = ("\n\n", "\n", "。", ". ", " ", "")
CHILD_LITERALS = ("\n\n", "\n", ". ", " ", "")


def token_length(text: str) -> int:
    return len(BUDGET_TOKEN.findall(text))


def _merge(pieces: Sequence[tuple[str, int]], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring (piece, length) joined up to ``size``, each chunk starting with the end of the one before."""
    begin = total = 0
    for at, (_, length) in enumerate(pieces):
        if at > begin and total + length > size:
            yield "".join([p for p, _ in pieces[begin:at]]).strip()
            while begin < at and (total > overlap or (total > 0 and total + length > size)):
                total -= pieces[begin][1]
                begin += 1
        total += length
    yield "".join([p for p, _ in pieces[begin:]]).strip()


def _pieces(text: str, pattern: str) -> list[str]:
    """The text cut before each match of the separator, or into its characters if that is empty."""
    if not pattern:
        return list(text)
    marks = [0, *(m.start() for m in re.finditer(pattern, text)), len(text)]
    return [text[a:b] for a, b in zip(marks, marks[1:], strict=False) if b > a]


def _split(text: str, patterns: Sequence[str], size: int, overlap: int, measure: Callable[[str], int]) -> Iterator[str]:
    rank = next((k for k, p in enumerate(patterns) if not p or re.search(p, text)), len(patterns) - 1)
    rest, held = patterns[rank + 1 :] if patterns[rank] else (), []
    for piece in _pieces(text, patterns[rank]):
        length = measure(piece)
        if length < size:
            held.append((piece, length))
            continue
        yield from _merge(held, size, overlap)
        held = []
        if rest:
            yield from _split(piece, rest, size, overlap, measure)
        else:
            yield piece
    yield from _merge(held, size, overlap)


def split_recursive(text: str, size: int, overlap: int = 0, *, measure: Callable[[str], int] = token_length, literals: Sequence[str] | None = None) -> list[str]:
    """Split at the first separator that occurs, join up to ``size``, and split what is longer at the next ones.

    Separators stay at the begin of what follows them; they are PATTERNS, or the given ``literals``.
    """
    patterns = PATTERNS if literals is None else tuple(map(re.escape, literals))
    return [p for p in _split(text, patterns, size, overlap, measure) if p.strip()]


def split_paragraphs(text: str, size: int, overlap: int = 0) -> list[str]:
    """Paragraphs joined up to ``size``; what is longer is split further."""
    groups: list[list[str]] = []
    held = 0  # tokens of the last group; those of its paragraphs add up
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        length = token_length(paragraph)
        if groups and held + length <= size:
            groups[-1].append(paragraph)
            held += length
        else:
            groups.append([paragraph])
            held = length
    return [piece for group in groups for piece in split_recursive("\n\n".join(group), size, overlap)]


def split_markdown(text: str, size: int, overlap: int = 0) -> list[str]:
    """Sections by heading, each split further."""
    sections = (s.strip() for s in re.split(r"(?m)(?=^#{1,6}\s+)", text))
    return [piece for section in sections if section for piece in split_recursive(section, size, overlap)]


SPLITTERS: dict[str, Callable[[str, int, int], list[str]]] = {"recursive": split_recursive, "paragraph": split_paragraphs, "markdown": split_markdown}
