"""A character-level bidirectional LSTM with CRF transitions, in numpy: forward pass and decoding.

Gates are hard sigmoids and cell values pass a hard tanh (clipped lines, which cost a fraction of the curves);
emissions of both directions are summed and a
linear-chain CRF over B/I tags of each kind decides. A transition into O or B costs what leaving the one tag and
entering the other cost, so that a step of decoding takes one maximum for all of them. Characters enter as classes: ASCII by itself with all digits
as one, accented Latin letters as their base letter, full-width forms as ordinary ones, other alphabets as upper
or lower case, Han characters by a hash.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

KINDS = ("name", "email", "phone", "id_number", "address")
TAGS = ("O", *(f"B-{k}" for k in KINDS), *(f"I-{k}" for k in KINDS))
#: Tags that may follow any tag (O and B) come first, then the I tags, which follow their own kind only.
FREE = 1 + len(KINDS)
HAN_CLASSES, HIDDEN = 384, 20
#: Classes: 0 other, 1 white space, 2 line feed, 3 digit, 4 invisible, 5/6 Cyrillic or Greek lower/upper, 7 hiragana,
#: 8 katakana, 9 other letter, then ASCII from "!" to "~", then Han.
FIRST_ASCII = 10
FIRST_HAN = FIRST_ASCII + 94
CLASSES = FIRST_HAN + HAN_CLASSES

_table: np.ndarray | None = None


def _class_of(code: int) -> int:
    letter = chr(code)
    if 0xFF01 <= code <= 0xFF5E:
        return _class_of(code - 0xFEE0)
    if letter.isdecimal():
        return 3
    if 0x21 <= code <= 0x7E:
        return FIRST_ASCII + code - 0x21
    if letter == "\n":
        return 2
    if letter.isspace():
        return 1
    category = unicodedata.category(letter)
    if category in ("Cf", "Cc"):
        return 4
    if 0x3040 <= code < 0x30A0:
        return 7
    if 0x30A0 <= code < 0x3100:
        return 8
    if category[0] == "L":
        base = unicodedata.normalize("NFD", letter)[0]
        if base != letter and base.isascii():
            return _class_of(ord(base))
        if 0x370 <= code < 0x530:
            return 6 if letter.isupper() else 5
        return 9
    return 0


def char_classes(text: str) -> np.ndarray:
    """The class of every code point of ``text``."""
    global _table
    if _table is None:
        table = np.zeros(0x110000, np.int16)
        low = [_class_of(c) for c in range(0x3400)]
        table[:0x3400] = low
        han = np.arange(0x3400, 0xA000, dtype=np.uint64)
        table[0x3400:0xA000] = FIRST_HAN + ((han * np.uint64(2654435761) >> np.uint64(12)) % np.uint64(HAN_CLASSES)).astype(np.int16)
        table[0xF900:0xFB00] = 9
        table[0xFF00:0xFFF0] = [_class_of(c) for c in range(0xFF00, 0xFFF0)]
        table[0xFEFF] = 4
        _table = table
    return _table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


class Tagger:
    """Parameters by name: for each direction ``x`` [CLASSES, 4H], ``u`` [H, 4H], ``out`` [H, tags]; ``bias`` [tags];
    transitions ``leave`` [tags], ``enter`` [FREE] and ``stay`` [from B and from I, kinds]."""

    def __init__(self, parameters: dict[str, np.ndarray]) -> None:
        self.p = {k: v.astype(np.float32) for k, v in parameters.items()}
        self.inputs, self.recurrent = {}, {}
        gates = lambda m: np.ascontiguousarray(m.reshape(len(m), 4, HIDDEN).transpose(1, 0, 2))
        for d in "fb":  # a table for each gate, with its line folded in: a character's numbers of a gate lie together
            scale = np.repeat(np.array([0.25, 0.25, 0.25, 1], np.float32), HIDDEN)
            shift = np.repeat(np.array([0.5, 0.5, 0.5, 0], np.float32), HIDDEN)
            self.inputs[d] = gates(self.p[f"{d}_x"] * scale + shift)
            self.recurrent[d] = gates(self.p[f"{d}_u"] * scale)

    @staticmethod
    def load(path: str | None = None) -> Tagger:
        with np.load(path or os.path.join(os.path.dirname(__file__), "pii_weights.npz")) as file:
            return Tagger({k: file[k] for k in file.files})

    def direction(self, classes: np.ndarray, name: str) -> np.ndarray:
        """Hidden states [time, batch, H] over classes [time, batch]."""
        x, u = self.inputs[name], self.recurrent[name]
        (steps, batch), size = classes.shape, HIDDEN
        c, h = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
        states = np.empty((steps, batch, size), np.float32)
        z, drive, new = np.empty((4, batch, size), np.float32), np.empty((4, batch, size), np.float32), np.empty((batch, size), np.float32)
        gates, (allow, keep, show, value) = z[:3], z
        for t in range(steps) if name == "f" else range(steps - 1, -1, -1):
            np.matmul(h, u, out=z)
            np.take(x, classes[t], axis=1, out=drive, mode="clip")
            np.add(z, drive, out=z)
            gates.clip(0, 1, out=gates)
            value.clip(-1, 1, out=new)
            c *= keep
            new *= allow
            c += new
            h = states[t]
            c.clip(-1, 1, out=h)
            h *= show
        return states

    def emissions(self, classes: np.ndarray) -> np.ndarray:
        """[time, tags, batch]"""
        e = np.matmul(self.p["f_out"].T, self.direction(classes, "f").transpose(0, 2, 1))
        e += np.matmul(self.p["b_out"].T, self.direction(classes, "b").transpose(0, 2, 1))
        e += self.p["bias"][:, None]
        return e

    def decode(self, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tag path of every column, [time, batch]; 0 beyond a column's length."""
        e = self.emissions(classes)
        steps, _, batch = e.shape
        leave, enter, stay = self.p["leave"][:, None], self.p["enter"][:, None], self.p["stay"][:, :, None]
        scores, tops = e, np.empty((steps, batch), np.float32)  # emissions become path scores in place
        scores[0, FREE:] -= 1e4
        out, held = np.empty((len(TAGS), batch), np.float32), np.empty((2, len(KINDS), batch), np.float32)
        for t in range(1, steps):
            last, here = scores[t - 1], scores[t]
            np.add(last, leave, out=out)
            np.max(out, axis=0, out=tops[t])
            np.add(last[1:].reshape(2, len(KINDS), batch), stay, out=held)
            here[:FREE] += enter
            here[:FREE] += tops[t]
            here[FREE:] += np.maximum(held[0], held[1])
        path, tag = np.zeros((steps, batch), np.int8), np.zeros(batch, np.int64)
        for t in range(steps - 1, -1, -1):
            ended = np.flatnonzero(lengths == t + 1)
            tag[ended] = scores[t][:, ended].argmax(axis=0)
            path[t] = np.where(lengths > t, tag, 0)
            if t:
                # most columns are at O and come from O; only the others look for their source
                source = np.zeros(batch, np.int64)
                other = np.flatnonzero((tag >= FREE) | (scores[t - 1, 0] + leave[0] < tops[t]))
                if len(other):
                    now, last = tag[other], scores[t - 1][:, other]
                    free = (last + leave).argmax(axis=0)
                    kind, each = np.maximum(now - FREE, 0), np.arange(len(other))
                    from_b, from_i = last[1 + kind, each] + stay[0, kind, 0], last[FREE + kind, each] + stay[1, kind, 0]
                    source[other] = np.where(now < FREE, free, np.where(from_b >= from_i, 1 + kind, FREE + kind))
                tag = source
        return path


def moves_of(p: dict[str, np.ndarray]) -> np.ndarray:
    """The whole transition matrix of the parameters."""
    moves = np.full((len(TAGS), len(TAGS)), -1e4)
    moves[:, :FREE] = p["leave"][:, None] + p["enter"]
    kinds = np.arange(len(KINDS))
    moves[1 + kinds, FREE + kinds], moves[FREE + kinds, FREE + kinds] = p["stay"]
    return moves


def spans_of(tags: np.ndarray, offset: int = 0) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of each B tag and the I tags of its kind after it."""
    out = []
    for at in np.flatnonzero((tags > 0) & (tags < FREE)):
        end = at + 1
        while end < len(tags) and tags[end] == tags[at] + len(KINDS):
            end += 1
        out.append((offset + int(at), offset + end, KINDS[int(tags[at]) - 1]))
    return out
