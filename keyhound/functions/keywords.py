"""Keywords of rules in texts: one Aho-Corasick automaton over all of them, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shorter keywords are so frequent that looking for the first one is quicker than meeting them all.
SHORT = 3


def folded(text: str) -> str:
    """Lower case; the long s is a letter of ASCII too, as the Kelvin sign is by lower case already."""
    low = text.lower()
    return low.replace("ſ", "s") if "ſ" in low else low


class Finder:
    """The numbers of the lists of keywords of which a text holds one; empty lists are always held."""

    def __init__(self, keywords: Sequence[Sequence[str]]):
        import ahocorasick

        self.always = [i for i, own in enumerate(keywords) if not own]
        owners: dict[str, list[int]] = {}
        for i, own in enumerate(keywords):
            for k in own:
                owners.setdefault(k, []).append(i)
        self.short = [(k, own) for k, own in owners.items() if len(k) < SHORT]
        self.search = ahocorasick.Automaton()
        for k, own in owners.items():
            if len(k) >= SHORT:
                self.search.add_word(k, tuple(own))
        self.long = len(self.search) > 0
        if self.long:
            self.search.make_automaton()

    def find(self, text: str) -> list[int]:
        found = {*self.always}
        if text:
            low = folded(text)
            for k, own in self.short:
                if k in low:
                    found.update(own)
            if self.long:
                for own in {own for _, own in self.search.iter(low)}:
                    found.update(own)
        return sorted(found)


def candidates(keywords: Sequence[Sequence[str]]) -> Callable[[Column], Column]:
    """A function of a text column: which of the lists have a keyword in it (array of their numbers, from 0)."""
    keywords = [list(own) for own in keywords]
    if not any(keywords):
        return lambda c: F.array(*map(F.lit, range(len(keywords)))).cast("array<int>")
    made: list[Finder] = []

    @F.arrow_udf("array<int>")
    def find(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Finder(keywords))
        return pa.array([made[0].find(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return find
