"""Audit of how far the sources of a language differ in their terms, by sorting and scanning runs.

1. Each task turns its documents into partial runs (lang, term, source, documents, count)
   before anything is shuffled; a document lies in one task, so its runs need no key of their own.
2. Partial runs are dealt by (lang, term) and sorted by (lang, term, source). One scan adds up neighbours: the run of
   a term gives its documents and its counts by source, and only terms in enough documents go on. Memory: one term.
3. The totals of each group follow from the kept runs. They are dealt to the same tasks as the runs, ahead of the terms
   of their language, so nothing is broadcast.
4. A second scan gives each term's shares in all groups of its language. It adds the differences of each pair of
   sources, and keeps the leading terms of each group; partial pairs and terms go out once a language and task.

Memory of the second scan: a square of the sources of one language, as large as that language's result, and `most_terms`
terms a source. A share is 1 + floor(scale * (count + prior) / (N + prior * V)), all in exact integers.

Null text, lang and source are read as ''. A row counts as one document, also one that repeats another or its id. A text
without terms has no runs, but its group counts. A language without kept terms has pairs of value 0 and no
terms. Ties rank by the item's UTF-8. Very long texts are read one at a time. An empty table gives an empty result. Only the columns
named are read, so others may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, cut

#: Letters, and everything beyond ASCII, in texts whose A-Z are small.
_TERM = re.compile(rb"[^\x00-\x60\x7B-\x7F]+")
_RUNS = "lang string, term string, source string, docs bigint, count bigint"
_KEPT = "lang string, term string, sources array<string>, counts array<bigint>"
_PARTS = "part string, lang string, source string, item string, value bigint, p bigint"


def document_runs(most: int):
    """Partial runs of (lang, source, text) rows. At most about `most` runs are held before they go out."""

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, counts) in held.items():
            terms = list(counts)
            for at in range(0, len(terms), 65536):
                part = terms[at : at + 65536]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, n), pa.array(part, pa.binary()).cast(pa.string()), pa.repeat(source, n), pa.array([docs[t] for t in part], pa.int64()), pa.array([counts[t] for t in part], pa.int64())],
                    names=["lang", "term", "source", "docs", "count"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                docs, counts = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(counts)
                found = _TERM.findall(text.as_buffer().to_pybytes().lower())
                counts.update(found)
                docs.update(set(found))
                size += len(counts) - before
                if size > most:
                    yield from emit(held)
                    held, size = {}, 0
        yield from emit(held)

    return run


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where rows differ from the row before, the first row included."""
    n = len(columns[0])
    differ = np.zeros(n, bool)
    differ[:1] = True
    for c in columns:
        differ[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(differ)


def kept_terms(least_docs: int):
    """Of runs sorted by language, term and source: each term of enough documents, with its counts by source.

    A batch is summed as whole columns. Of its last term the sums by source wait for the next batch.
    """
    kinds = [pa.string()] * 3 + [pa.int64()] * 2
    names = ["lang", "term", "source", "docs", "count"]

    def settled(rows: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The kept terms of summed rows; first: where each term starts."""
        size = np.diff(np.append(first, rows.num_rows))
        stays = np.add.reduceat(rows.column(3).to_numpy(), first) >= least_docs
        if stays.any():
            inner = rows.filter(pa.array(np.repeat(stays, size)))
            heads = rows.take(pa.array(first[stays]))
            ends = pa.array(np.append(0, np.cumsum(size[stays])), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, inner.column(i)) for i in (2, 4)]
            yield pa.RecordBatch.from_arrays([heads.column(0), heads.column(1), *lists], names=["lang", "term", "sources", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.cast(k) for c, k in zip(batch.columns, kinds)]
            if held is not None:
                columns = [pa.concat_arrays(pair) for pair in zip(held.columns, columns)]
            first = _starts(*columns[:3])
            sums = [pa.array(np.add.reduceat(c.to_numpy(), first)) for c in columns[3:]]
            rows = pa.RecordBatch.from_arrays([c.take(pa.array(first)) for c in columns[:3]] + sums, names=names)
            terms = _starts(rows.column(0), rows.column(1))
            if len(terms) > 1:
                yield from settled(rows.slice(0, terms[-1]), terms[:-1])
            held = rows.slice(terms[-1])
        if held is not None:
            yield from settled(held, np.zeros(1, np.int64))

    return run


def shares(counts: np.ndarray, totals: np.ndarray, n_terms: int, prior: int, scale: int) -> np.ndarray:
    """1 + floor(scale * (count + prior) / (total + prior * n_terms)), exactly; wider than 64 bits where needed."""
    top = int(counts.max(initial=0)) + prior
    kind = np.int64 if top * scale < 1 << 63 and int(totals.max(initial=0)) + prior * n_terms < 1 << 63 else object
    return (1 + scale * (counts.astype(kind) + prior) // (totals.astype(kind) + prior * n_terms)).astype(np.int64)


class _Language:
    """What the second scan holds of the language it is in."""

    def __init__(self, lang: str, first: bool, prior: int, scale: int, most_terms: int):
        self.lang, self.first, self.prior, self.scale, self.most = lang, first, prior, scale, most_terms
        self.sources, self.totals, self.n_terms, self.sums, self.top, self.block = [], [], 0, None, [], []

    def add_group(self, source: str, total: int, n_terms: int) -> None:
        self.sources.append(source)
        self.totals.append(total)
        self.n_terms = n_terms

    def add_term(self, term: str, sources: list[str], counts: list[int]) -> None:
        if self.sums is None:
            self.at = {s: i for i, s in enumerate(self.sources)}
            self.wide = np.array([*self.totals, sum(self.totals)], object)
            self.wide = self.wide.astype(np.int64) if self.wide.max() < 1 << 62 else self.wide
            self.sums, self.top = np.zeros((len(self.sources),) * 2, np.int64), [[] for _ in self.sources]
        row = np.zeros(len(self.sources) + 1, np.int64)
        row[[self.at[s] for s in sources]] = counts
        row[-1] = sum(counts)
        self.block.append((term, row))
        if len(self.block) * len(row) >= 1 << 18:
            self.settle()

    def settle(self) -> None:
        """The waiting terms into the sums and the leading terms."""
        if not self.block:
            return
        rows = np.stack([r for _, r in self.block])
        p = shares(rows, self.wide[None, :], self.n_terms, self.prior, self.scale)
        for i in range(len(self.sources)):
            self.sums[i] += np.abs(p[:, i, None] - p[:, :-1]).sum(axis=0)
            over = p[:, i] - p[:, -1]
            hits = np.flatnonzero((rows[:, i] > 0) & (over > 0))
            if len(hits):
                found = self.top[i] + [(-int(over[k]), self.block[k][0], int(p[k, -1])) for k in hits]
                self.top[i] = sorted(found)[: self.most]  # strings compare as their UTF-8 does
        self.block = []

    def parts(self) -> Iterator[tuple]:
        """Its share of the result; where no term was seen, zeros from the first task alone, so that no pair is missing."""
        self.settle()
        if self.sums is None and not self.first:
            return
        for i, source in enumerate(self.sources):
            for j, other in enumerate(self.sources):
                if i != j:
                    yield ("pair", self.lang, source, other, int(self.sums[i, j]) if self.sums is not None else 0, None)
            for value, term, q in self.top[i] if self.top else []:
                yield ("term", self.lang, source, term, -value, q)


def partial_audit(prior: int, scale: int, most_terms: int):
    """Of groups and terms sorted by task, language and kind: partial pairs and leading terms."""
    kinds = (pa.string(),) * 4 + (pa.int64(),) * 2

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["part", "lang", "source", "item", "value", "p"])

    def chunked(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in rows:
            held.append(row)
            if len(held) == 65536:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for batch in batches:
            for task, lang, term, sources, counts, n_terms in zip(*(c.to_pylist() for c in batch.columns)):
                if (task, lang) != key:
                    if now:
                        yield from chunked(now.parts())
                    key, now = (task, lang), _Language(lang, task == 0, prior, scale, most_terms)
                if term is None:
                    now.add_group(sources[0], counts[0], n_terms)
                else:
                    now.add_term(term, sources, counts)
        if now:
            yield from chunked(now.parts())

    return run


def audit(
    docs: DataFrame, least_docs: int = 30, most_terms: int = 50, prior: int = 5, scale: int = 1_000_000_000, most_held: int = 1_000_000, terms_a_task: int = 8192, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """Rows (lang, source, part, item, value, p, rank) of each (lang, source) group.

    Part `pair`: each other source of the language, by the sum of the differences of shares over all kept terms. Part
    `term`: the `most_terms` terms whose share in the group is furthest above the language's, p being the latter. The second scan
    has a task for about `terms_a_task` kept terms, and no more tasks than there are shuffle partitions.
    """
    base = docs.select(as_text(lang_col).alias("lang"), as_text(source_col).alias("source"), as_text(text_col).alias("text"))
    runs = base.mapInArrow(document_runs(most_held), _RUNS)
    sorted_runs = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    kept = cut(sorted_runs.mapInArrow(kept_terms(least_docs), _KEPT))

    counted = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("total"))
    numbers = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    groups = base.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").join(numbers, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))

    # Each task makes its own pairs and leading terms, so their number follows the kept terms.
    tasks = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, -(-kept.count() // terms_a_task)))
    ahead = groups.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "lang", F.lit(None).cast("string").alias("term"), F.array("source").alias("sources"), F.array("total").alias("counts"), "n_terms")
    terms = kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(tasks)).cast("int").alias("task"), "lang", "term", "sources", "counts", F.lit(0).cast("bigint").alias("n_terms"))
    dealt = ahead.unionByName(terms).repartition("task").sortWithinPartitions("task", "lang", F.asc_nulls_first("term"))
    parts = cut(dealt.mapInArrow(partial_audit(prior, scale, most_terms), _PARTS))

    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"), F.lit(None).cast("bigint").alias("p"))
    best = parts.filter("part = 'term'").select("lang", "source", "part", "item", "value", "p")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df: df.withColumn("rank", place)
    return ranked(pairs).unionByName(ranked(best).filter(F.col("rank") <= most_terms))


_TERMS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(n.total, 0) + 5 * v.v) AS p
    FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM p GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
out AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM out) WHERE part = 'pair' OR rank <= 50"""
