"""Cutting texts into pieces that a byte-level tokenizer handles independently, so that results can be remembered."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: No pre-token reaches over a single space between two non-spaces: it can only begin with that space.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_UNEVEN = re.compile(r"\s\s")


def _uneven(text: str) -> bool:
    return text[:1].isspace() or text[-1:].isspace() or _UNEVEN.search(text) is not None


class Pieces:
    """Values of pieces of text: `compute` gets those that are not remembered, each once.

    Keys leave out the leading space, which all pieces but the first of a text have; `firsts` are kept apart. When
    BOUND pieces are remembered they become the older generation, of which only what is met again is taken over.
    """

    LONGEST, BOUND = 48, 3 << 17

    def __init__(self, compute: Callable[[list[str]], list], specials: Iterable[str] = ()):
        self.compute = compute
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.inner: dict[str, object] = {}
        self.older: dict[str, object] = {}
        self.firsts: dict[str, object] = {}

    def values(self, texts: list[str]) -> list[list]:
        """For each text the values of its pieces, in order. Texts hold no special strings (see `parts`)."""
        cut = [_BETWEEN.split(text) if _uneven(text) else text.split(" ") for text in texts]
        if len(self.inner) > self.BOUND:
            self.inner, self.older = {}, self.inner
        if len(self.firsts) > self.BOUND:
            self.firsts.clear()
        first = {pieces[0] for pieces in cut}.difference(self.firsts)
        inner = set().union(*cut).difference(self.inner) if cut else set()  # first pieces too: cheaper than leaving them out
        again = {piece: self.older[piece] for piece in inner if piece in self.older} if self.older else {}
        self.inner.update(again)
        inner.difference_update(again)
        passing_first = self._learn(first, "", self.firsts)
        passing = self._learn(inner, " ", self.inner)
        found = []
        for pieces in cut:
            value = self.firsts.get(pieces[0])
            row = [passing_first[pieces[0]] if value is None else value]
            try:
                row.extend(map(self.inner.__getitem__, pieces[1:]))
            except KeyError:
                del row[1:]
                row.extend(passing[piece] if piece in passing else self.inner[piece] for piece in pieces[1:])
            found.append(row)
        return found

    def _learn(self, pieces: set[str], space: str, known: dict) -> dict:
        """Compute what is new; long pieces are not kept beyond this batch."""
        new = list(pieces)
        passing = {}
        for piece, value in zip(new, self.compute([space + piece for piece in new])):
            (known if len(piece) <= self.LONGEST else passing)[piece] = value
        return passing

    def parts(self, text: str) -> tuple[list[str], list[str]]:
        """A text between its special strings, and those strings."""
        if self.specials is None or not self.specials.search(text):
            return [text], []
        return self.specials.split(text), self.specials.findall(text)
