"""Cached tokenisation by units that the pre-tokeniser never joins.

A text is cut before every single U+0020. No match of the byte-level pattern spans such a cut unless the space stands
inside a longer run of white space; texts with such runs take the whole-text path, which gives the same ids."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

#: A space with white space before it and white space or the end after it: cutting there could split one match.
_RUN = re.compile(r"\s \s|\s \Z")
#: Entries that one task's cache holds at most, and the longest unit that it keeps. The cache goes with its task: an
#: idle worker would keep the memory.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 100


def splitter(findall: Callable[[str], list[str]]) -> Callable[[str], list[str]]:
    """findall of the byte-level pattern, without the pattern for a space and ASCII letters, with or without one comma
    or full stop behind them: by far most units of prose."""

    def split(text: str) -> list[str]:
        if text[:1] == " " and text.isascii():
            if text[1:].isalpha():
                return [text]
            if text[-1] in ",." and text[1:-1].isalpha():
                return [text[:-1], text[-1]]
        return findall(text)

    return split


class UnitCache:
    """encode(list of units) -> list of little-endian uint32 id bytes, called only for units not seen before."""

    def __init__(self, encode: Callable[[Sequence[str]], list[bytes]], entries: int = CACHE_ENTRIES):
        self.encode, self.known, self.entries = encode, {}, entries

    def texts(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32 bytes."""
        if len(self.known) > self.entries:
            self.known.clear()
        cut: list[list[str]] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            if _RUN.search(text) or "\0" in text:
                whole.append(i)
                cut.append([])
                continue
            units = text.split(" ")
            units[0] = "\0" + units[0]  # marks a unit that starts its text: no space stands before it
            cut.append(units)
        need = set().union(*cut)
        new = list(need - self.known.keys())
        if new:
            spelt = [u[1:] if u[:1] == "\0" else " " + u for u in new]
            self.known.update(zip(new, self.encode(spelt), strict=True))
        out = [b"".join(map(self.known.__getitem__, units)) for units in cut]
        if whole:
            for i, ids in zip(whole, self.encode([texts[i] for i in whole]), strict=True):
                out[i] = ids
        for u in new:
            if len(u) > CACHE_CHARS:
                del self.known[u]
        return out
