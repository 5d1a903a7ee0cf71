"""Texts cut at spaces into chunks that tokenise independently, each different chunk once per task.

The pre-tokenisation pattern never joins a non-white-space character with white space after it,
and looks ahead only from white space.  So a text may be cut before any space that follows a
non-white-space character.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Chunks remembered per task; beyond it the memory starts afresh.
REMEMBERED = 350_000

#: White space followed by a space: texts with such places are cut with care.
_RUNS = tuple(chr(c) + " " for c in range(0x3001) if chr(c).isspace())


def plain(text: str) -> bool:
    """Whether no white space comes before a space."""
    return not any(run in text for run in _RUNS)


def chunks(text: str, simple: bool) -> tuple[str, list[str]]:
    """The first chunk, and the following ones without their leading space; ``simple`` texts are ``plain``."""
    head, *rest = text.split(" ")
    if simple:
        return head, rest
    out, now = [], head
    for word in rest:
        if now and not now[-1].isspace():
            out.append(now)
            now = " " + word
        else:
            now += " " + word
    out.append(now)
    # Chunks after the first start with a space: they were cut before one.
    return out[0], [chunk[1:] for chunk in out[1:]]


class ChunkTokens:
    """Token ids of texts as packed bytes; ``encode`` maps different chunks to packed ids."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]]):
        self.encode, self.known = encode, {}

    def of(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        wanted: set[str] = set()
        heads: set[str] = set()
        simple = list(map(plain, texts))
        for text, flag in zip(texts, simple):
            head, rest = chunks(text, flag)
            heads.add(head)
            wanted.update(rest)
        new = list(wanted.difference(self.known))
        del wanted
        self.known.update(zip(new, self.encode([" " + chunk for chunk in new])))
        names = list(heads)
        first = dict(zip(names, self.encode(names)))
        out = []
        for text, flag in zip(texts, simple):
            head, rest = chunks(text, flag)
            out.append(first[head] + b"".join(map(self.known.__getitem__, rest)))
        return out
