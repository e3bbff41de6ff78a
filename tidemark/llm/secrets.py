"""Secret scanning with one combined automaton.

Each rule has a loose expression, whose leftmost non-overlapping longest matches are its candidates, and a test
of length. The rules' strict forms are compiled together, by subset construction and
minimisation, into one automaton; one pass over a text's bytes tells whether any rule fires, and which. Only a text with a hit is read again, for exact spans of the rules that fired: a reversed automaton
marks where matches start, a forward one takes each to its longest end.

Null and empty texts have no secrets. Very long texts are scanned whole, one at a time. Spans count code points, end
exclusive. Copies and ties need no care: each text is judged alone; spans that start together go in the order of the
rules. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, Parser, compile_trees, mirrored
from .common import as_text, utf8


@dataclass(frozen=True)
class Rule:
    """loose: all candidate matches; strict: what a text must hold for a match to qualify, and not much more.

    Two long counted repeats in strict forms would multiply the automaton's states, so only one rule has one.

    least: bytes that the match must have, behind the longest part that head (if given) matches at its start.
    """

    name: str
    loose: str
    strict: str
    least: int
    head: str = ""
    any_case: bool = False


_VALUE = "[A-Za-z0-9+/_.=-]"
_KEYWORD = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"

#: The base rules.
BASE_RULES = (
    Rule("assign", f"{_KEYWORD}{_VALUE}+", f"{_KEYWORD}{_VALUE}", 8, _KEYWORD, True),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", 16),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{32}", 32),
)
#: Further public formats of credentials.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]", 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", "AIza[A-Za-z0-9_-]", 39),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]+", "[rs]k_live_[A-Za-z0-9]", 24),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", "eyJ[A-Za-z0-9_-]+\\.eyJ", 0),
)
RULES = BASE_RULES + MORE_RULES


@dataclass(frozen=True)
class Compiled:
    rules: tuple[Rule, ...]
    scan: Automaton
    forward: tuple[Automaton, ...]
    backward: tuple[Automaton, ...]
    heads: tuple[Automaton | None, ...]


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Compiled:
    """All automata of the rules, as plain arrays that travel with the tasks."""
    loose = [Parser(r.loose, r.any_case).parse() for r in rules]
    return Compiled(
        tuple(rules),
        compile_trees([Parser(r.strict, r.any_case).parse() for r in rules], anywhere=True),
        tuple(compile_trees([t], anywhere=False) for t in loose),
        tuple(compile_trees([mirrored(t)], anywhere=True) for t in loose),
        tuple(compile_trees([Parser(r.head, r.any_case).parse()], anywhere=False) if r.head else None for r in rules),
    )


class Scanner:
    """Compiled rules in the form that walks bytes fastest: each state is the list of its successors."""

    def __init__(self, compiled: Compiled):
        self.rules = compiled.rules
        table, classes = compiled.scan.table, compiled.scan.classes
        states: list[list] = [[] for _ in range(len(table) + 1)]
        hit = states[-1]
        hit.extend([hit] * 256)
        for i, row in enumerate(table[:, classes].tolist()):
            states[i].extend(hit if compiled.scan.accepts[j] else states[j] for j in row)
        self.start, self.hit = states[0], hit
        self.next, self.accepts = compiled.scan.rows(), compiled.scan.accepts.tolist()
        self.forward = [(a.rows(), a.accepts.tolist(), a.dead) for a in compiled.forward]
        self.heads = [(a.rows(), a.accepts.tolist(), a.dead) if a else None for a in compiled.heads]
        self.backward = [(a.rows(), a.accepts.tolist()) for a in compiled.backward]

    def any(self, text: bytes) -> bool:
        """Whether a strict form occurs: the one pass that every text gets."""
        state = self.start
        for byte in text:
            state = state[byte]
        return state is self.hit

    def fired(self, text: bytes) -> list[int]:
        """The rules whose strict forms occur."""
        state, seen, rows, accepts = 0, 0, self.next, self.accepts
        for byte in text:
            state = rows[state][byte]
            seen |= accepts[state]
        return [i for i in range(len(self.rules)) if seen >> i & 1]

    def matches(self, i: int, text: bytes) -> list[tuple[int, int]]:
        """Qualifying byte spans of one rule: leftmost, longest, non-overlapping, then tested."""
        rows, accepts = self.backward[i]
        state, starts = 0, []
        for at in range(len(text) - 1, -1, -1):
            state = rows[state][text[at]]
            if accepts[state]:
                starts.append(at)
        out, free = [], 0
        for start in reversed(starts):
            if start >= free:
                free = self._end(self.forward[i], text, start)
                begin = self._end(self.heads[i], text, start) if self.heads[i] else start
                if free - begin >= self.rules[i].least:
                    out.append((start, free))
        return out

    @staticmethod
    def _end(automaton: tuple, text: bytes, start: int) -> int:
        """Where the longest match from start ends."""
        rows, accepts, dead = automaton
        state, end = 0, start
        for at in range(start, len(text)):
            state = rows[state][text[at]]
            if state == dead:
                break
            if accepts[state]:
                end = at + 1
        return end

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, by start and then by rule."""
        if not self.any(text):
            return []
        found = [(s, i, e) for i in self.fired(text) for s, e in self.matches(i, text)]
        if found and not text.isascii():
            lead = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
            at = lambda p: int(lead[p - 1]) if p else 0
            found = [(at(s), i, at(e)) for s, i, e in found]
        return sorted(found)


def _told(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...], most: int) -> str:
    return ",".join(f"{rules[i].name}:{s}:{e}" for s, i, e in spans if i < most)


def span_rows(compiled: Compiled, n_base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(compiled)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            raw, edges = data.data, offsets.tolist()
            cols: dict[str, list] = {"counts": [], "base": [], "spans": []}
            for lo, hi in zip(edges[:-1], edges[1:]):
                text = bytes(raw[lo:hi])
                found = scanner.spans(text)
                cols["counts"].append([sum(i == k for _, i, _ in found) for k in range(n_base)])
                cols["base"].append(hashlib.sha256(_told(found, scanner.rules, n_base).encode()).hexdigest())
                cols["spans"].append(_told(found, scanner.rules, len(scanner.rules)))
            out = [batch.column(0), *(pa.array([c[k] for c in cols["counts"]], pa.int64()) for k in range(n_base)), pa.array(cols["base"], pa.string()), pa.array(cols["spans"], pa.string())]
            names = ["id", *(f"n_{scanner.rules[k].name}" for k in range(n_base)), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def redacted(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first rule."""
    out, at = [], 0
    for start, rule, end in spans:
        if start >= at:
            out += [text[at:start], f"<{rules[rule].name}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, n_base: int = len(BASE_RULES), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: the id, a count for each base rule, base_sha256 and spans.

    spans lists kind:start:end of all rules by start and then in the rules' order, joined by commas; base_sha256
    is the hex digest of the same list of the first n_base rules. Only the two named columns are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), as_text(text_col).alias("text"))
    counts = ", ".join(f"n_{r.name} bigint" for r in rules[:n_base])
    return base.mapInArrow(span_rows(compile_rules(rules), n_base), f"id {kind}, {counts}, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The input rows and columns, each secret in the text replaced by <kind>. Null texts stay null. Columns may have any names."""
    compiled = compile_rules(rules)
    column = next(i for i, c in enumerate(docs.columns) if c.lower() == text_col.lower())
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots do not pass through the map

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(compiled)
        for batch in batches:
            out = []
            for value in batch.column(column):
                text = value.as_py()
                found = scanner.spans(text.encode("utf-8", "surrogatepass")) if text else []
                out.append(redacted(text, found, scanner.rules) if found else text)
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field(i).type) if i == column else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
