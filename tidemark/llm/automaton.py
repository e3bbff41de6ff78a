"""Regular expressions to one minimal deterministic automaton over bytes.

A small dialect: literals, classes, groups, alternation, ? * + {m} {m,} {m,n}, escapes \\xHH and \\d, and a
flag for letters in either case. Expressions become a Thompson graph; subset construction over byte classes and
partition refinement give transition arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Graph:
    """Nodes with byte-set edges and empty edges."""

    moves: list[tuple[frozenset[int], int] | None] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def node(self) -> int:
        self.moves.append(None)
        self.empty.append([])
        return len(self.moves) - 1


class Parser:
    """Recursive descent over one expression, to a syntax tree of tuples."""

    def __init__(self, source: str, any_case: bool):
        self.s, self.i, self.any_case = source, 0, any_case

    def parse(self):
        tree = self.alternatives()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} of {self.s!r}")
        return tree

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("then", parts)

    def repeated(self):
        tree = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                inside = ""
                while self.peek() != "}":
                    inside += self.take()
                self.take()
                lo, comma, hi = inside.partition(",")
                tree = ("times", tree, int(lo), None if comma and not hi else int(hi or lo))
            else:
                tree = ("times", tree, int(c == "+"), 1 if c == "?" else None)
        return tree

    def atom(self):
        c = self.take()
        if c == "(":
            if self.s.startswith("?:", self.i):
                self.i += 2
            tree = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.s!r}")
            return tree
        if c == "[":
            return ("bytes", self.cased(self.members()))
        return ("bytes", self.cased(self.escaped() if c == "\\" else {ord(c)}))

    def escaped(self) -> set[int]:
        c = self.take()
        if c == "x":
            self.i += 2
            return {int(self.s[self.i - 2 : self.i], 16)}
        if c == "d":
            return set(range(0x30, 0x3A))
        return {ord(c)}

    def members(self) -> set[int]:
        negated, out, first = self.peek() == "^", set(), True
        if negated:
            self.take()
        while first or self.peek() != "]":
            first = False
            c = self.take()
            lo = self.escaped() if c == "\\" else {ord(c)}
            if self.peek() == "-" and self.s[self.i + 1] != "]" and len(lo) == 1:
                self.take()
                d = self.take()
                hi = self.escaped() if d == "\\" else {ord(d)}
                lo = set(range(min(lo), max(hi) + 1))
            out |= lo
        self.take()
        return set(range(256)) - out if negated else out

    def cased(self, values: set[int]) -> frozenset[int]:
        if self.any_case:
            values = values | {v ^ 0x20 for v in values if chr(v & 0xDF).isalpha() and v < 128}
        return frozenset(values)


def build(graph: Graph, tree, start: int) -> int:
    """Add the tree behind a node; the node where it ends."""
    kind = tree[0]
    if kind == "bytes":
        mid, end = graph.node(), graph.node()
        graph.empty[start].append(mid)
        graph.moves[mid] = (tree[1], end)
        return end
    if kind == "then":
        for part in tree[1]:
            start = build(graph, part, start)
        return start
    if kind == "or":
        end = graph.node()
        for option in tree[1]:
            head = graph.node()
            graph.empty[start].append(head)
            graph.empty[build(graph, option, head)].append(end)
        return end
    _, inner, lo, hi = tree
    for _ in range(lo):
        start = build(graph, inner, start)
    if hi is None:
        loop = graph.node()
        graph.empty[start].append(loop)
        graph.empty[build(graph, inner, loop)].append(loop)
        end = graph.node()
        graph.empty[loop].append(end)
        return end
    end = graph.node()
    graph.empty[start].append(end)
    for _ in range(hi - lo):
        start = build(graph, inner, start)
        graph.empty[start].append(end)
    return end


def mirrored(tree):
    """The tree of the reversed language."""
    if tree[0] == "then":
        return ("then", [mirrored(x) for x in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [mirrored(x) for x in tree[1]])
    if tree[0] == "times":
        return ("times", mirrored(tree[1]), *tree[2:])
    return tree


@dataclass(frozen=True)
class Automaton:
    """table[state, byte class] is the next state; accepts[state] is a bit set of the expressions that end there.

    State 0 is the start. dead is the state nothing leads out of, or -1.
    """

    classes: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    dead: int

    def rows(self) -> list[list[int]]:
        """For each state the next state by byte."""
        return self.table[:, self.classes].tolist()


def compile_trees(trees: list, anywhere: bool) -> Automaton:
    """One automaton for all the trees. anywhere: matches may start at every byte."""
    graph = Graph()
    root = graph.node()
    ends = {}
    for i, tree in enumerate(trees):
        head = graph.node()
        graph.empty[root].append(head)
        ends[build(graph, tree, head)] = 1 << i

    # Bytes that no edge tells apart form one class.
    sets = sorted({m[0] for m in graph.moves if m}, key=sorted)
    signs = [tuple(b in s for s in sets) for b in range(256)]
    numbers = {sign: i for i, sign in enumerate(dict.fromkeys(signs))}
    classes = np.array([numbers[s] for s in signs], np.uint8)
    sample = [int(np.flatnonzero(classes == i)[0]) for i in range(len(numbers))]

    reach: list[frozenset[int] | None] = [None] * len(graph.moves)

    def closure(node: int) -> frozenset[int]:
        if reach[node] is None:
            seen, todo = {node}, [node]
            while todo:
                for x in graph.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            reach[node] = frozenset(x for x in seen if graph.moves[x] or x in ends)
        return reach[node]

    first = closure(root)
    states, table, todo = {first: 0}, [], [first]
    while todo:
        at = todo.pop(0)
        row = []
        for byte in sample:
            to = set(first) if anywhere else set()
            for x in at:
                move = graph.moves[x]
                if move and byte in move[0]:
                    to |= closure(move[1])
            key = frozenset(to)
            if key not in states:
                states[key] = len(states)
                todo.append(key)
            row.append(states[key])
        table.append(row)
    accepts = np.array([sum(bits for e, bits in ends.items() if e in s) for s in states], np.int64)
    return _minimal(classes, np.array(table, np.int32), accepts)


def _minimal(classes: np.ndarray, table: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Merge states that accept alike and move alike, by refinement until nothing splits."""
    _, group = np.unique(accepts, return_inverse=True)
    while True:
        signs = np.column_stack((group, group[table]))
        _, new = np.unique(signs, axis=0, return_inverse=True)
        new = new.ravel()
        if new.max() == group.max():
            break
        group = new
    _, rep = np.unique(group, return_index=True)
    order = np.argsort(group[rep] != group[0], kind="stable")
    name = np.empty(len(rep), np.int32)
    name[order] = np.arange(len(rep))
    kept = rep[order]
    small, ends = name[group[table[kept]]], accepts[kept]
    stuck = np.flatnonzero((small == np.arange(len(small))[:, None]).all(axis=1) & (ends == 0))
    return Automaton(classes, small, ends, int(stuck[0]) if len(stuck) else -1)
