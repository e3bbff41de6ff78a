"""N-gram Jaccard self-join with MinHash banding, verified on full n-gram sets.

1. One pass computes each text's MinHash bands and a 128-bit identity of its word sequence; texts with the same
   words form one node, so exact copies are never compared.
2. Nodes meet on band hashes. A bucket of up to `pairwise` nodes yields all its pairs; in a larger one every node
   is compared with the bucket's smallest node only, so a bucket costs one row a member however large it is.
3. Candidates are verified on their full n-gram sets; verified links give connected components.
4. A large bucket whose members all lie in one component needs nothing more: no further link could change a
   class. In any other, the members outside the first one's component are compared with all members of other
   components, block by block inside tasks, and the components are formed again. So no bucket is capped.
5. Links are counted apart from that: the members that a component has in large buckets are all compared, block by
   block, and each pair that meets in a band is counted once. So counts do not depend on `pairwise` either; only
   counts leave a block, never a row a link.

A text of fewer than n words has one n-gram, its whole word sequence. Null and empty texts have no n-gram and
link to nothing: each row is a class of its own. Rows that repeat a doc_id are joined by their texts; a null
doc_id stays null in the result. Very long texts are read one at a time. An empty table gives an empty result. Of the
table's columns only the two named are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, chunks, cut, fresh, lists, utf8
from .components import components
from .hashing import hash_words, mix, runs, windows


def choose_bands(threshold: float, recall: float, rows: int = 6) -> tuple[int, int]:
    """Bands and rows a band such that a pair at the threshold meets in a band with the recall wanted."""
    meet = threshold**rows
    return math.ceil(math.log(1 - recall) / math.log(1 - meet)), rows


def _ngrams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram hashes in document order and each document's first one (and the total)."""
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    gram = windows(words, n)
    whole = np.arange(len(gram)) + n <= first[doc[: len(gram)] + 1] if len(gram) else np.zeros(0, bool)
    values, owner = gram[whole], doc[: len(gram)][whole]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        values = np.concatenate((values, runs(words, first)[short]))
        owner = np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    return values, np.searchsorted(owner, np.arange(len(sizes) + 1))


def signature_rows(n: int, bands: int, rows: int, seed: int):
    factors = np.random.default_rng(seed).integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in chunks(offsets):
                words, _, _, first = hash_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                values, at = _ngrams(words, first, n)
                full = np.flatnonzero(np.diff(at))
                keys = np.zeros((len(full), bands), np.uint64)
                if len(full):
                    for b in range(bands):
                        key = np.full(len(full), b + 1, np.uint64)
                        for f in factors[b * rows : (b + 1) * rows]:
                            key = mix(key ^ np.minimum.reduceat(values * f, at[full]))
                        keys[:, b] = key
                sizes = np.zeros(hi - lo, np.int64)
                sizes[full] = bands
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(runs(words, first).view(np.int64)), pa.array(runs(words, first, 1).view(np.int64)), pa.array(np.diff(first).astype(np.int64)), lists(keys.ravel().view(np.int64), sizes, pa.int64())],
                    names=["id", "node", "check", "n_words", "bands"],
                )

    return run


def ngram_rows(n: int):
    """The node and the sorted distinct n-grams of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in chunks(offsets):
                words, _, _, first = hash_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                values, at = _ngrams(words, first, n)
                sets = [np.unique(values[at[d] : at[d + 1]]) for d in range(hi - lo)]
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs(words, first).view(np.int64)), lists(flat.view(np.int64), np.array([len(s) for s in sets]), pa.int64())], names=["node", "grams"]
                )

    return run


def _verified(pairs: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose n-gram sets have a Jaccard similarity of the threshold or more."""
    one = pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    two = one.join(grams.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return two.select("a", "b", shared.alias("shared"), (F.size("ga") + F.size("gb")).alias("both")).filter(F.col("shared") >= F.lit(threshold) * (F.col("both") - F.col("shared"))).select("a", "b")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of indicator matrices over the values that both sides have."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(common), 8192):
        part = common[lo : lo + 8192]
        sides = []
        for side in (left, right):
            has = np.zeros((len(side), len(part)), np.float32)
            for i, values in enumerate(side):
                inside = values[np.searchsorted(values, part[0]) : np.searchsorted(values, part[-1], side="right")]
                at = np.searchsorted(part, inside)
                has[i, at[part[at] == inside]] = 1
            sides.append(has)
        out += sides[0] @ sides[1].T
    return out


def _block_links(threshold: float):
    def run(key, strays: pa.Table, members: pa.Table) -> pa.Table:
        a, b = [], []
        if len(strays) and len(members):
            left = [np.sort(np.asarray(x, np.int64)) for x in strays["grams"].to_pylist()]  # were sorted as unsigned
            right = [np.sort(np.asarray(x, np.int64)) for x in members["grams"].to_pylist()]
            shared = _overlaps(left, right)
            both = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
            ls, lm = strays["label"].to_numpy(), members["label"].to_numpy()
            linked = (shared >= threshold * (both - shared)) & (ls[:, None] != lm[None, :])
            ns, nm = strays["node"].to_numpy(), members["node"].to_numpy()
            for i in np.flatnonzero(linked.any(axis=1)):
                hit = np.flatnonzero(linked[i])
                hit = hit[np.unique(lm[hit], return_index=True)[1]]  # one link to each other component joins it
                a.append(np.full(len(hit), ns[i]))
                b.append(nm[hit])
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
        return pa.table({"a": pa.array(flat[0], pa.int64()), "b": pa.array(flat[1], pa.int64())})

    return run


def _rest(buckets: DataFrame, labels: DataFrame, grams: DataFrame, threshold: float, block: int) -> DataFrame | None:
    """Links that large buckets may still hide between components, by exact comparison in blocks."""
    named = buckets.join(labels, buckets["node"] == labels["member"], "left").select("bucket", "node", "lead", F.coalesce("component", "node").alias("label"))
    split = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.max(F.expr("CASE WHEN node = lead THEN label END")).alias("home")).filter("lo <> hi")
    left = cut(named.join(split.select("bucket", "n", "home"), "bucket"))
    if left.isEmpty():
        return None
    strays = left.filter("label <> home")
    cells = left.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("across"), F.ceil(F.count_if(F.expr("label <> home")) / block).cast("int").alias("down"))
    spot = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    tall = strays.join(cells, "bucket").select("bucket", "node", "label", spot("down").alias("i"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"))
    wide = left.join(cells, "bucket").select("bucket", "node", "label", spot("across").alias("j"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"))
    keys = ["bucket", "i", "j"]
    # Both sides come from the same tables: aliases give each columns of its own, or a cogroup finds them ambiguous.
    sides = [x.join(grams, "node").select(*(F.col(c).alias(c) for c in (*keys, "node", "label", "grams"))).groupBy(*keys) for x in (tall, wide)]
    return sides[0].cogroup(sides[1]).applyInArrow(_block_links(threshold), "a bigint, b bigint")


def _block_degrees(threshold: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        part, node = table["part"].to_numpy(), table["node"].to_numpy()
        bands = np.array(table["bands"].to_pylist(), np.int64)
        grams = [np.sort(np.asarray(x, np.int64)) for x in table["grams"].to_pylist()]
        held = table["size"].to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        rows, columns = np.flatnonzero(part == i), np.flatnonzero(part == j)
        degree = np.zeros(len(node), np.int64)
        if len(rows) and len(columns):
            met = np.zeros((len(rows), len(columns)), bool)
            for b in range(bands.shape[1]):
                met |= bands[rows, b][:, None] == bands[columns, b][None, :]
            if i == j:
                np.fill_diagonal(met, False)
            if met.any():
                shared = _overlaps([grams[x] for x in rows], [grams[x] for x in columns])
                size = np.array([len(x) for x in grams])
                linked = met & (shared >= threshold * (size[rows][:, None] + size[columns][None, :] - shared))
                degree[rows] += linked @ held[columns]
                if i != j:
                    degree[columns] += held[rows] @ linked
        has = np.flatnonzero(degree)
        return pa.table({"node": pa.array(node[has], pa.int64()), "degree": pa.array(degree[has], pa.int64())})

    return run


def _degrees(links: DataFrame, large: DataFrame, nodes: DataFrame, found: DataFrame, grams: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, degree): rows that each node's links reach. Of `links` only those outside the large buckets count; the others come from blocks."""
    wide = cut(large.select("node").distinct().join(found, "node"))
    inside = lambda c: wide.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_wide"))
    apart = links.join(inside("a"), "a", "left").join(inside("b"), "b", "left").filter("a_wide is null or b_wide is null")
    parts = wide.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = wide.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = dealt.select("component", "node", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select("component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "part")
    full = cells.join(nodes.select("node", "bands", "size").dropDuplicates(["node"]), "node").join(grams, "node").select("component", "i", "j", "node", "part", "bands", "size", "grams")
    counted = full.groupBy("component", "i", "j").applyInArrow(_block_degrees(threshold), "node bigint, degree bigint")
    both = apart.select(F.col("a").alias("node"), F.col("b").alias("far")).union(apart.select(F.col("b").alias("node"), F.col("a").alias("far")))
    reached = both.join(nodes.groupBy(F.col("node").alias("far")).agg(F.sum("size").alias("degree")), "far").select("node", "degree")
    return reached.union(counted).groupBy("node").agg(F.sum("degree").alias("degree"))


def near_duplicates(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, rows: int = 6, pairwise: int = 48, block: int = 192, seed: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each input row: id, class_id, n_links, n_copies.

    class_id is the smallest id of all rows reached over links. n_copies counts the other rows of the same word
    sequence; n_links counts those and all rows of other texts that the row's text has a verified link to.
    """
    bands, rows = choose_bands(threshold, recall, rows)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), as_text(text_col).alias("text"))
    sig = cut(base.mapInArrow(signature_rows(n, bands, rows, seed), f"id {kind}, node bigint, check bigint, n_words bigint, bands array<bigint>"))
    nodes = sig.filter("n_words > 0").groupBy("node", "check").agg(F.count("*").alias("size"), F.min("id").alias("rep"), F.first("bands").alias("bands"))
    members = nodes.select("node", "rep", F.explode("bands").alias("bucket"))
    met = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("lead")).filter("n > 1")
    joined = cut(members.join(met, "bucket"))
    small, large = joined.filter(F.col("n") <= pairwise), joined.filter(F.col("n") > pairwise)
    close = small.select("bucket", F.col("node").alias("a")).join(small.select("bucket", F.col("node").alias("b")), "bucket").filter("a < b").select("a", "b")
    star = large.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    pairs = close.union(star).distinct()

    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    wanted = joined.select(word("rep").alias("key")).distinct()
    texts = base.select(word("id").alias("key"), "text").join(wanted, "key", "left_semi").select("text")
    grams = cut(texts.mapInArrow(ngram_rows(n), "node bigint, grams array<bigint>").filter("size(grams) > 0").dropDuplicates(["node"]))

    links = cut(_verified(pairs, grams, threshold))
    found = components(links)
    more = _rest(large, found.withColumnRenamed("node", "member"), grams, threshold, block)
    if more is not None:
        links = cut(links.union(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())
        found = components(links)

    degree = _degrees(links, large, nodes, found, grams, threshold, block)
    whole = nodes.drop("bands").join(found, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = whole.groupBy("component").agg(F.min("rep").alias("class_id"))
    told = whole.join(least, "component").select("node", "check", "class_id", F.coalesce("degree", F.lit(0)).alias("degree"), "size")
    return sig.join(told, ["node", "check"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.coalesce(F.col("degree") + F.col("size") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce(F.col("size") - 1, F.lit(0)).cast("bigint").alias("n_copies"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The input rows with those of each class kept whose id is the class's; all columns stay.

    Of rows that repeat an id and a text the first by all columns that can be compared stays. Rows of one id with different
    texts stay all, so that none is lost where an id names unrelated texts. Rows with a null id are kept.
    """
    result = near_duplicates(docs, id_col=id_col, text_col=text_col, **parameters)
    chosen = result.filter(F.col(id_col) == F.col("class_id")).select(F.col(id_col).alias(fresh("_kept_id", docs.columns))).distinct()
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in (id_col, text_col) and "map<" not in kind and "variant" not in kind]
    place = fresh("_place", docs.columns)
    order = F.row_number().over(Window.partitionBy(id_col, text_col).orderBy(*(plain or [F.col(id_col)])))
    once = docs.join(chosen, docs[id_col] == chosen[chosen.columns[0]], "left_semi").withColumn(place, order).filter(F.col(place) == 1).drop(place)
    return once.unionByName(docs.filter(F.col(id_col).isNull()))
