"""Many terms found in one pass over a text, by an Aho-Corasick automaton inside an Arrow UDF.

The automaton is built once a worker from the terms, which come with the function; its cost a character does not depend
on their number. Word bounds are checked where a term ends, so results equal those of a pattern a term.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: How a term is found: TERM as text.term_hit, ALIAS as text.has_alias, PART as text.matched_terms.
TERM, ALIAS, PART = "term", "alias", "part"
_LATIN_TERM = re.compile(r"[a-z0-9 ._\-/]+")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


class _Plan:
    """Automata of terms: those found in the text as it is, and Latin ones whose inner space stands for any white space."""

    def __init__(self, terms: tuple[tuple[str, str], ...]):
        needles: tuple[dict, dict] = ({}, {})
        self.odd = []
        for i, (kind, term) in enumerate(terms):
            bare = term.strip().casefold() if kind == TERM else term.strip().lower()
            latin = bool(_LATIN_TERM.fullmatch(bare)) if kind == TERM else kind == ALIAS and re.search("[a-z]", bare) is not None
            if not bare or (kind == ALIAS and len(bare) < 2):
                continue
            if kind == TERM and latin and "  " in bare:
                self.odd.append((i, re.compile(r"(?<![a-z0-9])" + r"\s+".join(map(re.escape, bare.split(" "))) + r"(?![a-z0-9])")))
            else:
                needles[kind == TERM and latin and " " in bare].setdefault(bare, []).append((i, latin))
        self.automata = []
        for held in needles:
            made = ahocorasick.Automaton()
            for needle, entries in held.items():
                made.add_word(needle, (len(needle), entries))
            if held:
                made.make_automaton()
            self.automata.append(made if held else None)

    def found(self, low: str) -> list[int]:
        seen = {i for i, pattern in self.odd if pattern.search(low)}
        for automaton, said in zip(self.automata, (low, re.sub(r"\s+", " ", low) if self.automata[1] else "")):
            if automaton is None:
                continue
            last = len(said)
            for end, (n, entries) in automaton.iter(said):
                for i, bounded in entries:
                    if i not in seen and not (bounded and ((end >= n and said[end - n] in _ALNUM) or (end + 1 < last and said[end + 1] in _ALNUM))):
                        seen.add(i)
        return sorted(seen)


@lru_cache(maxsize=64)
def _plan(terms: tuple[tuple[str, str], ...]) -> _Plan:
    return _Plan(terms)


def found_terms(text: Column, terms: Iterable[tuple[str, str]]) -> Column:
    """The places in `terms`, (kind, term) pairs, of those that occur in the text, ascending. Null texts have none."""
    terms = tuple((kind, str(term)) for kind, term in terms)
    none = F.array().cast("array<int>")
    if not terms:
        return none

    @arrow_udf("array<int>")
    def scan(texts: pa.Array) -> pa.Array:
        plan = _plan(terms)
        return pa.array([plan.found(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.int32()))

    return F.coalesce(scan(F.lower(text)), none)


def picked(found: Column, values: list[str], first: int = 0) -> Column:
    """What the found places from `first` on stand for, one value a term, in order."""
    if not values:
        return F.array().cast("array<string>")
    names = F.array(*map(F.lit, values))
    return F.transform(F.filter(found, lambda i: (i >= first) & (i < first + len(values))), lambda i: F.get(names, i - first))
