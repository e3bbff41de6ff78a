"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit a dimension (whether it lies above zero), held in 64-bit words and cut into segments of
about log2 of the number of distinct codes, so that a segment's value has few codes at any size. Every distinct code
is listed once a segment, with its k + 1 smallest ids and its number of rows: copies cost nothing. A segment's values
lie in blocks by their bits above the lowest `_LOW`. In round r each open query goes to the blocks that can hold a value at
distance r from its own; there, inside a task, it looks up all such values, its candidates are verified on whole
codes, and the block's k + 1 nearest leave it, none farther than the k + 1 nearest of earlier rounds. After round r every code within (r + 1) * segments - 1 has been met, so
a query is done when its kth distance is no more than that. At r = segment bits everything has been met. Blocks
with very many codes or queries are dealt over parts of both, and each part of the one meets each of the other.

Neighbours are ordered by distance, then id; the query itself is not its neighbour. Fewer than k others: all of them.
A dimension that is null or that a shorter vector lacks counts as not above zero, so a null or empty vector has no bit
set; NaN lies above zero. Rows that repeat an id and a code count once; an id with several codes is several rows, and several queries, each
with ranks of its own. Rows without an id are left out. An empty table gives no rows. Of the columns only two are read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop

#: A block with more codes, or with more queries in a round, than this is dealt over parts of about this size.
_HOT = 16384
#: Bits of a segment's value that a block spans: so many that a query goes to few blocks, so few that a block is small.
_LOW = 13
#: Lookups, and candidates at most, that a task holds at once.
_CHUNK = 1 << 20


def _even(n: int, most: int) -> list[int]:
    """n as the fewest numbers of at most `most`, as equal as can be."""
    parts = -(-n // most)
    return [n // parts + (i < n % parts) for i in range(parts)]


def code(vector: Column, bits: int) -> Column:
    """The signs of the first `bits` dimensions as a struct of 64-bit words w0, w1, ..."""
    words, lo = [], 0
    for i, n in enumerate(_even(bits, 64)):
        sign = lambda at: F.when(F.try_element_at(vector, at) > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        words.append(F.aggregate(F.sequence(F.lit(lo + 1), F.lit(lo + n)), F.lit(0).cast("bigint"), lambda a, at: F.shiftleft(a, 1).bitwiseOR(sign(at))).alias(f"w{i}"))
        lo += n
    return F.struct(*words)


def _layout(bits: int, width: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of each segment."""
    out = []
    for word, n in enumerate(_even(bits, 64)):
        shift = 0
        for w in _even(n, width):
            out.append((word, shift, w))
            shift += w
    return out


def _flips(width: int, distance: int) -> np.ndarray:
    """All masks of so many bits of the width."""
    places = itertools.combinations(range(width), distance)
    return np.array([sum(1 << i for i in at) for at in places], np.int64)


def _first(owner: np.ndarray, distance: np.ndarray, turn: np.ndarray, n: int) -> np.ndarray:
    """Places of each owner's first n rows by distance, then turn."""
    order = np.lexsort((turn, distance, owner))
    sizes = np.bincount(owner[order])
    return order[np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < n]


def _looked_up(k: int, words: int, round_: int):
    """The k + 1 nearest codes of a block for each query, of those whose value lies at distance `round_` from the query's."""

    def run(key, asks: pa.Table, block: pa.Table) -> pa.Table:
        found = []
        if len(asks) and len(block):
            block = block.take(pa.array(np.argsort(block["low"].to_numpy(), kind="stable")))
            low, turn = block["low"].to_numpy(), np.unique(block["first"].to_numpy(), return_inverse=True)[1]
            codes = np.stack([block[f"c{i}"].to_numpy() for i in range(words)]).view(np.uint64)  # of signed numbers numpy counts the bits of the absolute value
            queries = np.stack([asks[f"q{i}"].to_numpy() for i in range(words)]).view(np.uint64)
            values, far, bound = (asks[c].to_numpy() for c in ("low", "far", "bound"))
            width = asks["width"][0].as_py()
            starts = np.searchsorted(low, np.arange((1 << width) + 1))
            for d in np.unique(far):
                masks, mine = _flips(width, round_ - int(d)), np.flatnonzero(far == d)
                step = max(1, _CHUNK // max(len(masks), len(low)))
                for lo in range(0, len(mine), step):
                    own = mine[lo : lo + step]
                    probes = (values[own][:, None] ^ masks[None, :]).ravel()
                    n = starts[probes + 1] - starts[probes]
                    hit = np.flatnonzero(n)
                    probes, n = probes[hit], n[hit]
                    at = np.repeat(starts[probes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    owner = np.repeat(hit // len(masks), n)
                    distance = sum(np.bitwise_count(queries[i, own][owner] ^ codes[i, at]).astype(np.int32) for i in range(words))
                    near = np.flatnonzero(distance <= bound[own][owner])
                    owner, at, distance = owner[near], at[near], distance[near]
                    best = _first(owner, distance, turn[at], k + 1)
                    found.append((own[owner[best]], at[best], distance[best]))
        q, c, distance = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        columns = {f"q{i}": asks[f"q{i}"].take(pa.array(q)) for i in range(words)} | {f"c{i}": block[f"c{i}"].take(pa.array(c)) for i in range(words)}
        return pa.table(columns | {"distance": pa.array(distance.astype(np.int32)), "first": block["first"].take(pa.array(c)), "n": block["n"].take(pa.array(c))})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int | None = None, width: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbour_id, distance) of the k nearest rows of every query.

    bits: dimensions that count, all if None. width: most bits of a segment, log2 of the number of codes if None.
    """
    if bits is None:
        sizes = [df.agg(F.max(F.size(vector_col))).first()[0] or 0 for df in (vectors, queries)]
        bits = max(1, *sizes)
    coded = lambda df: df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), code(F.col(vector_col), bits).alias("code")).distinct()
    # k + 1 ids a code, smallest first; parts are ranked before they meet, so that a code of very many rows is no one task's.
    part = coded(vectors).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["code", "part"], ["code"]):
        part = part.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter(F.col("_n") <= k + 1).drop("_n")
    codes = cut(part.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    if width is None:
        width = min(32, max(8, round(math.log2(codes.count() + 1))))
    layout = _layout(bits, width)
    segments, widest = len(layout), max(w for _, _, w in layout)

    low = [min(w, _LOW) for _, _, w in layout]
    words = layout[-1][0] + 1
    flat = lambda struct, name: [F.col(f"{struct}.w{i}").alias(f"{name}{i}") for i in range(words)]
    again = lambda name: F.struct(*(F.col(f"{name}{i}").alias(f"w{i}") for i in range(words)))

    def pieces(df: DataFrame) -> DataFrame:
        """Each row once a segment, with the block and the place in it of its code's value."""
        own = []
        for i, (word, shift, w) in enumerate(layout):
            value = F.shiftrightunsigned(F.col(f"code.w{word}"), shift).bitwiseAND(F.lit((1 << w) - 1).cast("bigint"))
            own.append(F.struct(F.lit(i).alias("seg"), F.lit(low[i]).alias("width"), F.lit(w - low[i]).alias("above"), F.shiftrightunsigned(value, low[i]).alias("block"), value.bitwiseAND(F.lit((1 << low[i]) - 1).cast("bigint")).alias("low")))
        return df.select("*", F.explode(F.array(*own)).alias("_s")).select(*df.columns, "_s.*")

    def many(df: DataFrame, name: str) -> DataFrame:
        """The blocks that the rows need several parts for."""
        return cut(df.groupBy("seg", "block").agg(F.ceil(F.count("*") / _HOT).cast("int").alias(name)).filter(F.col(name) > 1))

    def dealt(df: DataFrame, by: Column, own: str, parts: DataFrame, other: str, others: DataFrame) -> DataFrame:
        """The rows with a part of their own kind, once for each part of the other kind."""
        n = lambda c: F.coalesce(c, F.lit(1))
        placed = df.join(parts, ["seg", "block"], "left").withColumn(own, F.pmod(F.xxhash64(by), n(own)).cast("int"))
        return placed.join(others, ["seg", "block"], "left").withColumn(other, F.explode(F.sequence(F.lit(0), n(F.col(other)) - 1)))

    keys = ["seg", "block", "c_part", "q_part"]
    index = cut(pieces(codes.select("code", F.element_at("ids", 1).alias("first"), F.least(F.size("ids"), F.lit(k + 1)).alias("n"))).drop("width", "above"))
    full = many(index, "c_part")
    kind = dict(codes.select(F.element_at("ids", 1).alias("first")).dtypes)["first"]
    told = ", ".join([*(f"{x}{i} bigint" for x in "qc" for i in range(words)), "distance int", f"first {kind}", "n int"])
    above = sorted({w - n for (_, _, w), n in zip(layout, low)})
    asked = cut(coded(queries))
    open_, best = asked.select(F.col("code").alias("q"), F.lit(bits).alias("bound")).distinct(), None
    for r in range(widest + 1):
        # Every way to change the bits above: those of a block at distance `far` leave r - far for the bits within it.
        masks = None
        for n in above:
            some = vectors.sparkSession.range(1 << n).select(F.lit(n).alias("above"), F.col("id").alias("mask"), F.bit_count("id").alias("far")).filter(F.col("far") <= r)
            masks = some if masks is None else masks.unionByName(some)
        sent = pieces(open_.withColumn("code", F.col("q"))).join(F.broadcast(masks), "above").filter(r - F.col("far") <= F.col("width"))
        sent = cut(sent.select("q", "bound", "seg", "width", F.col("block").bitwiseXOR(F.col("mask")).alias("block"), "low", "far"))
        crowded = many(sent, "q_part")
        asks = dealt(sent, F.col("q"), "q_part", crowded, "c_part", full).select(*keys, *flat("q", "q"), "bound", "width", "low", "far")
        held = dealt(index, F.col("code"), "c_part", full, "q_part", crowded).select(*keys, *flat("code", "c"), "low", "first", "n")
        met = asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_looked_up(k, words, r), told)
        met = met.select(again("q").alias("q"), again("c").alias("code"), "distance", "first", "n")
        both = (met if best is None else met.unionByName(best)).dropDuplicates(["q", "code"])
        # Of the codes in order of distance and first id, no more than k + 1 hold the k + 1 nearest rows (one may be the query itself).
        place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "first"))
        spent, best = best, cut(both.withColumn("_n", place).filter(F.col("_n") <= k + 1).drop("_n"))
        within = F.sum(F.when(F.col("distance") <= (r + 1) * segments - 1, F.col("n")).otherwise(0))
        so_far = best.groupBy("q").agg(within.alias("within"), F.when(F.count("*") > k, F.max("distance")).otherwise(bits).alias("bound"))
        drop(spent, sent, crowded)
        open_ = cut(open_.select("q").join(so_far, "q", "left").filter(F.coalesce("within", F.lit(0)) <= k).select("q", F.coalesce("bound", F.lit(bits)).alias("bound")))
        if open_.isEmpty():
            break
    pairs = best.select("q", "code", "distance").join(codes, "code").select("q", "distance", F.explode("ids").alias("neighbour_id"))
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "neighbour_id"))
    found = pairs.withColumn("_n", place).filter(F.col("_n") <= k + 1).drop("_n")
    told = asked.withColumnRenamed("id", "query_id").join(found, F.col("code") == F.col("q")).filter((F.col("query_id") != F.col("neighbour_id")) | (F.col("distance") > 0))
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("distance", "neighbour_id"))
    return told.select("query_id", rank.alias("rank"), "neighbour_id", F.col("distance").cast("int").alias("distance")).filter(F.col("rank") <= k)


#: DuckDB SQL of the query: brute force.
ORACLE = """
    WITH size AS (SELECT coalesce(max(len(embedding)), 0) AS n FROM embeddings),
    codes AS (SELECT DISTINCT vec_id AS id, [coalesce(embedding[i] > 0, false) FOR i IN range(1, n + 1)] AS bits FROM embeddings, size WHERE vec_id IS NOT NULL),
    pairs AS (
        SELECT a.id AS query_id, a.bits AS q, b.id AS neighbour_id, CAST(len(list_filter(list_zip(a.bits, b.bits), lambda p: p[1] <> p[2])) AS INTEGER) AS distance
        FROM codes a JOIN codes b ON a.id <> b.id OR a.bits <> b.bits WHERE a.id % 20 = 0
    ), ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, q ORDER BY distance, neighbour_id) AS INTEGER) AS rank, neighbour_id, distance FROM pairs)
    SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= 10"""
