"""Texts as pieces with rolling names, inside tasks.

A piece is a word (letters, digits, underscores) or one other sign. Any number of neighbouring pieces,
with the blanks between them, has a name of two 64-bit numbers that costs the same however long it is.
Equal stretches have equal names; different ones are taken to differ. Letters that are twins in lower
case count as equal.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .text import TWINS

BLANK, WORD, SIGN = 0, 1, 2
BLANKS = " \t\n\x0b\x0c\r"

_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_memory: dict[str, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of ``x`` spread over all bits (a bijection on 64-bit numbers)."""
    for factor in (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)):
        y = x >> np.uint64(33)
        y ^= x
        y *= factor
        x = y
    y = x >> np.uint64(33)
    y ^= x
    return y


def _kinds() -> np.ndarray:
    """The kind of every code point."""
    if "kinds" not in _memory:
        kinds = np.full(sys.maxunicode + 1, SIGN, np.uint8)
        kinds[[k for k in range(len(kinds)) if unicodedata.category(chr(k))[0] in "LN" or k == 95]] = WORD
        kinds[[ord(c) for c in BLANKS]] = BLANK
        _memory["kinds"] = kinds
    return _memory["kinds"]


def _values() -> np.ndarray:
    """The number of every code point; twins have the same."""
    if "values" not in _memory:
        values = _mixed(np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * _GOLDEN)
        values[[ord(twin) for twin in TWINS]] = values[[ord(main) for main in TWINS.values()]]
        _memory["values"] = values
    return _memory["values"]


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ...: at least ``n`` of them."""
    held = _memory.get(name)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = _memory[name] = np.cumprod(held, dtype=np.uint64)
    return held


def _back(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


@dataclass
class Pieces:
    """The pieces of some texts in order."""

    text: np.ndarray  # which text each is of
    free_before: np.ndarray  # no word touches it from the left
    free_after: np.ndarray  # no word touches its end
    bare: np.ndarray  # the name of the piece
    full: np.ndarray  # the name of the piece and the blanks after it

    def names(self, n: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, a, b) of every stretch of ``n`` pieces that no word touches.

        ``among``: only those whose ``a`` falls on a marked slot; the number of slots is a power of two.
        """
        many = len(self.text) - n + 1
        if many <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        found = (self.text[:many] == self.text[n - 1 :]) & self.free_before[:many] & self.free_after[n - 1 :]
        a = self._name(0, np.s_[:many], np.s_[n - 1 : n - 1 + many], n)
        if among is not None:
            found &= among[(a & np.uint64(len(among) - 1)).view(np.int64)]
        at = np.flatnonzero(found)
        return self.text[at], a[at], self._name(1, at, at + n - 1, n)

    def _name(self, k: int, first: np.ndarray | slice, last: np.ndarray | slice, n: int) -> np.ndarray:
        """Half ``k`` of the names of the stretches of ``n`` pieces from ``first`` to ``last``."""
        if n == 1:
            return _mixed(self.bare[last] + _GOLDEN * np.uint64(k))
        base, sums = _BASES[k], self._sums(k)
        weight = _powers(f"power {k}", base, len(self.full) + 1)[n - 1]
        inner = (sums[last] - sums[first]) * _powers(f"back {k}", _back(base), len(self.full) + 1)[first]
        return _mixed(inner + self.bare[last] * weight + np.uint64(n))

    def _sums(self, k: int) -> np.ndarray:
        name = f"_sums{k}"
        if name not in self.__dict__:
            terms = _mixed(self.full + _GOLDEN * np.uint64(k)) * _powers(f"power {k}", _BASES[k], len(self.full) + 1)[: len(self.full)]
            self.__dict__[name] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        return self.__dict__[name]


def _strips(text: str, most: int) -> Iterator[str]:
    """``text`` in strips of about ``most`` characters, each cut where a piece begins after blanks."""
    start = 0
    while len(text) - start > most:
        cut = max(text.rfind(" ", start, start + most), text.rfind("\n", start, start + most)) + 1
        if cut <= start:
            found = [p for p in (text.find(" ", start + most), text.find("\n", start + most)) if p >= 0]
            cut = min(found, default=len(text) - 1) + 1
        while cut < len(text) and text[cut] in BLANKS:
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def pieces_of(texts: list[str], most: int = 1 << 20) -> Pieces:
    """The pieces of ``texts``; characters are looked at in strips, so memory follows the pieces."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    ends_of = np.cumsum(lengths)
    parts: list[tuple] = []
    before = 0
    base = _BASES[0]
    for strip in _strips("\n".join([*texts, ""]), most):
        codes = np.frombuffer(strip.encode("utf-32-le"), "<u4")
        n = len(codes)
        kind = _kinds()[codes]
        word, sign = kind == WORD, kind == SIGN
        prior, later = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
        starts, ends = np.flatnonzero(sign | (word & ~prior)), np.flatnonzero(sign | (word & ~later)) + 1
        values = _values()[codes] * _powers("power 0", base, n + 1)[:n]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        back = _powers("back 0", _back(base), n + 1)[starts]
        # A text's last piece has no blanks after it that count: the line feed between texts is not its own.
        text = np.searchsorted(ends_of, starts + before, side="right")
        until = np.minimum(np.append(starts[1:], n), ends_of[text] - 1 - before)
        name = lambda stop: _mixed((sums[stop] - sums[starts]) * back + (stop - starts).astype(np.uint64))  # noqa: B023, E731
        parts.append((text, ~prior[starts], ~np.append(word, False)[ends], name(ends), name(until)))
        before += n
    return Pieces(*(np.concatenate(column) for column in zip(*parts)))


def distinct_names(pieces: Pieces, n: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``pieces.names(n, among)``, each once per text."""
    text, a, b = pieces.names(n, among)
    if len(text) < 2:
        return text, a, b
    mark = a ^ _mixed((text.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
    order = np.argsort(mark)
    mark, sorted_b, sorted_text = mark[order], b[order], text[order]
    new = np.concatenate([[True], (mark[1:] != mark[:-1]) | (sorted_b[1:] != sorted_b[:-1]) | (sorted_text[1:] != sorted_text[:-1])])
    kept = order[new]
    return text[kept], a[kept], b[kept]
