"""Substring deduplication: seed and extend.

Winnowing picks, in every run of `length` words, one anchor (a shorter run with the smallest hash), so equal
runs always share an anchor at the same place. Documents meet on anchors that occur twice or more; each such
seed is extended both ways over every window of `length` words around it, compared by a 96-bit identity of its
word sequence, and the union of the windows found elsewhere too is the union of the maximal repeats over the
length.

Texts become blocks of some megabytes, compressed. A block asks about its distinct anchors, and then about the
distinct windows around its seeds, whether they occur once or more often in the table; hashes are dealt to buckets,
and a bucket answers with a bit each. So a passage in a third of all documents costs a number a block, and no row is
paired with another.

Null and empty texts have no words and lose none. Texts shorter than the length lose none; a very long one is a
block of its own. Rows that repeat a document in full are each other's repeats and lose everything, if long enough;
so do rows that repeat an id and a text. A null id stays null. An empty table gives an empty result. Of the table's
columns only the two named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import as_text, chunks, cut, lists, utf8
from .hashing import hash_words, windows

#: Bytes of text in a block.
_BLOCK = 8 << 20
_ASKED = "bucket int, block bigint, step int, ones binary, twos binary, twice binary"
_TOLD = "block bigint, step int, bucket int, often binary"


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (id, text) rows."""
    part, i = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for lo, hi in chunks(offsets, _BLOCK):
            body = data[offsets[lo] : offsets[hi]].tobytes()
            cols = [
                pa.array([(part << 32) + i], pa.int64()), pa.array([pa.compress(body, "zstd", asbytes=True)], pa.binary()), pa.array([(offsets[lo : hi + 1] - offsets[lo]).astype("<i8").tobytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo)),
            ]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(body)], pa.int64())], names=["block", "data", "offsets", "ids", "size"])
            i += 1


def _anchors(words: np.ndarray, first: np.ndarray, length: int, k: int) -> np.ndarray:
    """Positions of the winnowed anchors: the last smallest k-gram of every length-word run within a document."""
    gram = windows(words, k)
    span = length - k + 1
    if len(gram) < span:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(gram[::-1], span)[::-1]
    picked = []
    for lo in range(0, len(view), 1 << 16):
        part = view[lo : lo + (1 << 16)]
        picked.append(np.arange(lo, lo + len(part)) + span - 1 - part.argmin(axis=1))
    at = np.concatenate(picked)
    inside = np.searchsorted(first, np.arange(len(view)), side="right") - 1
    return np.unique(at[np.arange(len(view)) + length <= first[inside + 1]])


class Asked:
    """Distinct hashes of a block, in the order in which buckets are asked about them."""

    def __init__(self, one: np.ndarray, two: np.ndarray, buckets: int):
        order = np.lexsort((two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        one, two, times = one[order][new], two[order][new], np.bincount(rank, minlength=int(new.sum()))
        bucket = (one % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        self.one, self.two, self.twice, self.bucket = one[order], two[order], times[order] > 1, bucket[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.slot = place[rank]  # of each of the hashes given
        self.edges = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1)).tolist() if len(order) else [0]

    def rows(self, block: int, step: int) -> pa.Table:
        spans = list(zip(self.edges[:-1], self.edges[1:]))
        raw = lambda x, kind: pa.array([x[a:z].astype(kind).tobytes() for a, z in spans], pa.binary())
        n = len(spans)
        return pa.table(
            {
                "bucket": pa.array([int(self.bucket[a]) for a, _ in spans], pa.int32()), "block": pa.array([block] * n, pa.int64()), "step": pa.array([step] * n, pa.int32()),
                "ones": raw(self.one, "<u8"), "twos": raw(self.two, "<u4"), "twice": pa.array([np.packbits(self.twice[a:z]).tobytes() for a, z in spans], pa.binary()),
            }
        )

    def answered(self, rows: list[dict]) -> np.ndarray:
        """Whether each of the hashes given occurs twice or more."""
        bits = [np.unpackbits(np.frombuffer(r["often"], np.uint8), count=z - a).astype(bool) for r, a, z in zip(rows, self.edges[:-1], self.edges[1:])]
        return np.concatenate([np.zeros(0, bool), *bits])[self.slot]


class Block:
    """The words of a block, its anchors, and its windows around seeds."""

    def __init__(self, table: pa.Table, length: int, k: int, buckets: int):
        row = table.select(["block", "data", "offsets", "size"]).to_pylist()[0]
        self.number, self.length, self.k, self.buckets = row["block"], length, k, buckets
        self.data = pa.decompress(row["data"], row["size"], "zstd", asbytes=True)
        self.words, self.starts, self.ends, self.first = hash_words(np.frombuffer(self.data, np.uint8), np.frombuffer(row["offsets"], "<i8"))

    def anchors(self) -> Asked:
        self.at = _anchors(self.words, self.first, self.length, self.k)
        gram = windows(self.words, self.k)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        return Asked(gram, np.zeros(len(gram), np.uint32), self.buckets)

    def around(self, often: np.ndarray) -> Asked:
        """Every window of `length` words that holds a seed: an anchor that occurs twice or more."""
        seeds = self.at[often]
        doc = np.searchsorted(self.first, seeds, side="right") - 1
        keep = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(keep, np.maximum(seeds - (self.length - self.k), self.first[doc]), 1)
        np.add.at(keep, np.minimum(seeds, self.first[doc + 1] - self.length) + 1, -1)
        self.held = np.flatnonzero(np.cumsum(keep)[:-1] > 0)
        if not len(self.held):
            return Asked(np.zeros(0, np.uint64), np.zeros(0, np.uint32), self.buckets)
        one, two = windows(self.words, self.length)[self.held], windows(self.words, self.length, 1)[self.held]
        return Asked(one, (two >> np.uint64(32)).astype(np.uint32), self.buckets)

    def removed(self, often: np.ndarray) -> np.ndarray:
        """Whether each word lies in a window found twice or more."""
        gone = np.zeros(len(self.words) + 1, np.int32)
        at = self.held[often]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + self.length, -1)
        return np.cumsum(gone)[:-1] > 0


def _replayed(table: pa.Table, answers: pa.Table | None, make: Callable[[pa.Table], Block]) -> tuple[Block, Asked, np.ndarray | None]:
    """A block, its next questions, and (once both steps are answered) the words that go."""
    block = make(table)
    asked = block.anchors()
    rows = sorted(answers.to_pylist(), key=lambda r: (r["step"], r["bucket"])) if answers is not None else []
    if answers is None:
        return block, asked, None
    asked = block.around(asked.answered([r for r in rows if r["step"] == 1]))
    return block, asked, block.removed(asked.answered([r for r in rows if r["step"] == 2])) if _answered(rows, asked) else None


def _answered(rows: list[dict], asked: Asked) -> bool:
    return sum(r["step"] == 2 for r in rows) == len(asked.edges) - 1


def _ask_anchors(make: Callable[[pa.Table], Block]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block, asked, _ = _replayed(pa.Table.from_batches([batch.slice(i, 1)]), None, make)
                yield from asked.rows(block.number, 1).to_batches()

    return run


def _ask_windows(make: Callable[[pa.Table], Block]):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return Asked(np.zeros(0, np.uint64), np.zeros(0, np.uint32), 1).rows(0, 2)
        block, asked, _ = _replayed(table, answers, make)
        return asked.rows(block.number, 2)

    return run


def _often(table: pa.Table) -> pa.Table:
    """A bucket's answers: a bit for each hash of each block."""
    rows = table.to_pylist()
    ones = [np.frombuffer(r["ones"], "<u8") for r in rows]
    one, two = np.concatenate(ones), np.concatenate([np.frombuffer(r["twos"], "<u4") for r in rows])
    times = np.concatenate([np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(x)) for r, x in zip(rows, ones)]).astype(np.int64) + 1
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    run = np.cumsum(new) - 1
    often = np.empty(len(order), bool)
    often[order] = (np.bincount(run, times[order]) > 1)[run]
    parts = np.split(often, np.cumsum([len(x) for x in ones])[:-1])
    return pa.table({"block": table["block"], "step": table["step"], "bucket": table["bucket"], "often": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})


def _kept(make: Callable[[pa.Table], Block], empty: pa.Schema):
    """The documents of a block without the words that go."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return empty.empty_table()
        block, _, dead = _replayed(table, answers, make)
        removed, digest, spans = [], [], []
        for a, z in zip(block.first[:-1].tolist(), block.first[1:].tolist()):
            gone = dead[a:z]
            s, e = block.starts[a:z][~gone].tolist(), block.ends[a:z][~gone].tolist()
            digest.append(hashlib.sha256(b" ".join([block.data[x:y] for x, y in zip(s, e)])).hexdigest())
            removed.append(int(gone.sum()))
            spans.append(np.flatnonzero(np.diff(gone.view(np.int8), prepend=0, append=0)))
        cols = [
            table["ids"].combine_chunks().flatten(), pa.array(np.diff(block.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()),
            lists(np.concatenate(spans), np.array([len(x) for x in spans], np.int64), pa.int64()),
        ]
        return pa.table(cols, names=empty.names)

    return run


def remove_repeats(docs: DataFrame, length: int = 35, anchor: int = 20, bucket_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed_spans (word positions: start, end, start, end...) of each row.

    A word goes if a window of `length` words over it has the same word sequence as a window that starts anywhere
    else in the table. Windows are judged on the input.
    """
    if not 0 < anchor <= length:
        raise ValueError("anchor must be within 1..length")
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), as_text(text_col).alias("text"))
    blocks = cut(base.mapInArrow(block_rows, f"block bigint, data binary, offsets binary, ids array<{kind}>, size bigint"))
    size = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = 1 + size // (6 * bucket_words)  # a word has about six bytes

    def make(table: pa.Table) -> Block:
        return Block(table, length, anchor, buckets)

    def with_answers(told: DataFrame, run, schema: str) -> DataFrame:
        # The aliases give the answers columns of their own: both sides may come from the same table.
        own = told.select(*(F.col(c).alias(c) for c in ("block", "step", "bucket", "often")))
        return blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(run, schema)

    seeds = cut(blocks.mapInArrow(_ask_anchors(make), _ASKED).groupBy("bucket").applyInArrow(_often, _TOLD))
    repeats = cut(with_answers(seeds, _ask_windows(make), _ASKED).groupBy("bucket").applyInArrow(_often, _TOLD))
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, removed_spans array<bigint>"

    out = with_answers(seeds.union(repeats), _kept(make, to_arrow_schema(StructType.fromDDL(schema))), schema)
    return out.withColumnRenamed("doc_id", id_col)
