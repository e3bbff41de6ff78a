"""Benchmark decontamination by a prefix-filtered set join, in built-in column expressions only.

A window is `window` consecutive words of an item; an item of fewer words is one window. A document is contaminated
where it holds a window word by word.

1. Each distinct window is the set of its shingles (`shingle` consecutive words, hashed). One pass over the documents
   keeps the places of shingles that any window has.
2. Those places give the order of rarity. A window that is contained has all its shingles in the document, so the
   rarest one, its necessary prefix at this threshold, is all that has to be joined. A window with a shingle that
   occurs nowhere is gone at once.
3. A place of the prefix fixes where the window would start. Positional and length bounds drop those that would begin
   before the document or end after it.
4. What is left is compared word by word within the document's own row, so neither a hash nor a row key can decide.

Words lie between other characters than digits, letters and all beyond ASCII; only A-Z are lower-cased. A null or
empty text has no words: such a document has no hit, such an item no window. An item whose id is null marks words but is not listed.
Items or documents that repeat (an id, a text, or both) count each; a list of items has an id once. Very long texts are
read whole. An empty table of documents gives an empty result, an empty benchmark one without hits. Only the columns
named are read, so others may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, cut
from .quality import let

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: ASCII characters other than digits and small letters.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in small letters."""
    return F.filter(F.split(F.translate(text, _UPPER, _UPPER.lower()), GAP), lambda w: w != "")


def shingles(words: Column, size: int) -> Column:
    """Hashes of the runs of `size` words, by where they start; of a run that would go beyond the end, of what there is."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, size))))) if size > 1 else hashed


def _bounded(small: DataFrame, most_rows: int) -> DataFrame:
    """The table, marked for broadcast if it is known to have so many rows at most; else Spark chooses the join."""
    return F.broadcast(small) if small.count() <= most_rows else small


def _places(docs: DataFrame, known: DataFrame, sizes: list[int], shingle: int, most_broadcast: int) -> DataFrame:
    """(key, doc, n, p, h): a row for each place of a known shingle, and one with null p and h for each document."""
    words = words_of(F.col("text"))
    wanted = _bounded(known, most_broadcast)

    def of(size: int) -> DataFrame:
        told = docs.select("doc", "key", words.alias("w")).select("doc", "key", F.size("w").alias("n"), shingles(F.col("w"), size).alias("all"))
        # The document's own row comes first, at place -1; of one size alone, so that each has one.
        places = told.select("doc", "key", "n", F.posexplode(F.concat(F.array(F.lit(None).cast("bigint")), "all")).alias("at", "h"))
        found = places.join(wanted.withColumnRenamed("known", "k"), F.col("h") == F.col("k"), "left")
        own = F.col("at") == 0 if size == sizes[-1] else F.lit(False)
        return found.filter(own | F.col("k").isNotNull()).select("key", F.when(F.col("at") == 0, F.col("doc")).alias("doc"), "n", F.when(F.col("at") > 0, F.col("at") - 1).alias("p"), F.col("k").alias("h"))

    return reduce(DataFrame.unionByName, (of(s) for s in sizes))


def windows_of(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (wid, words) of (item, text), and which items have them (wid, item)."""
    words = words_of(F.col("text"))
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0)))
    runs = items.select("item", words.alias("w")).filter(F.size("w") > 0).select("item", F.explode(let(F.col("w"), lambda w: F.transform(starts(w), lambda s: F.slice(w, s + 1, window)))).alias("words"))
    # Words hold no space, so the joined text tells windows apart.
    made = cut(runs.select(F.sha2(F.array_join("words", " "), 256).alias("wid"), "item", "words"))
    return made.groupBy("wid").agg(F.first("words").alias("words")), made.select("wid", "item").filter("item is not null").distinct()


def covered(spans: Column) -> Column:
    """How many places lie in any of the spans, structs of start and length in order of start."""
    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["start"] + s["length"]).alias("end"))
    return F.aggregate(spans, first, step, lambda a: a["n"]).cast("bigint")


def hits(
    docs: DataFrame, bench: DataFrame, window: int = 10, shingle: int = 3, most_broadcast: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """A row for each document: its id, n_words, n_hit, spans (start and length of the windows found, in words) and items (ids as text, sorted).

    most_broadcast: as many distinct shingles of the benchmark, 8 bytes each, are sent to all tasks at most; beyond that
    the places are shuffled by shingle. The result is the same.
    """
    base = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), as_text(text_col)).alias("key"), as_text(text_col).alias("text"))
    items = bench.select(F.col(item_col).cast("string").alias("item"), as_text(item_text_col).alias("text"))
    windows, owners = windows_of(items, window)
    windows = cut(windows)
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(shingle))).distinct().collect()) or [shingle]  # 1..shingle: a few values

    def grams(size: int) -> DataFrame:
        held = windows.filter(F.least(F.size("words"), F.lit(shingle)) == size)
        return held.select("wid", F.posexplode(F.slice(shingles(F.col("words"), size), F.lit(1), F.size("words") - size + 1)).alias("offset", "h"))

    of_windows = cut(reduce(DataFrame.unionByName, map(grams, sizes)))
    places = cut(_places(base, of_windows.select(F.col("h").alias("known")).distinct(), sizes, shingle, most_broadcast))
    met = places.filter("h is not null").select("key", "n", "p", "h")

    count = met.groupBy("h").agg(F.count("*").alias("count"))
    rarest = of_windows.join(count, "h", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset", "h")).alias("least")).filter("least.count > 0")
    prefix = rarest.join(windows, "wid").select("wid", "words", F.size("words").alias("length"), F.col("least.offset").alias("offset"), F.col("least.h").alias("h"))
    bounds = (F.col("p") >= F.col("offset")) & (F.col("p") - F.col("offset") + F.col("length") <= F.col("n"))
    maybe = met.join(prefix, "h").filter(bounds).select("key", F.struct((F.col("p") - F.col("offset")).alias("start"), "length", "wid", "words").alias("c"))
    asked = maybe.groupBy("key").agg(F.sort_array(F.collect_set("c")).alias("asked"))

    texts = base.join(asked, "key").select("key", words_of(F.col("text")).alias("w"), "asked")
    found = texts.select("key", let(F.col("w"), lambda w: F.filter("asked", lambda c: F.slice(w, c["start"] + 1, c["length"]) == c["words"])).alias("found"))
    span = lambda c: F.struct(c["start"].alias("start"), c["length"].alias("length"))
    # Rows that repeat an id and a text have one key and the same windows.
    told = cut(found.filter(F.size("found") > 0).dropDuplicates(["key"]).select("key", F.array_distinct(F.transform("found", span)).alias("spans"), F.array_distinct(F.transform("found", lambda c: c["wid"])).alias("wids")))
    listed = told.select("key", F.explode("wids").alias("wid")).join(owners, "wid").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = F.array()
    out = places.filter("h is null").select("key", "doc", "n").join(told.select("key", "spans"), "key", "left").join(listed, "key", "left")
    spans = F.coalesce("spans", none.cast("array<struct<start:int,length:int>>"))
    return out.select(F.col("doc").alias(id_col), F.col("n").cast("bigint").alias("n_words"), covered(spans).alias("n_hit"), spans.alias("spans"), F.coalesce("items", none.cast("array<string>")).alias("items"))


def report(docs: DataFrame, bench: DataFrame, **parameters) -> DataFrame:
    """The hits as numbers and a digest of the items."""
    told = hits(docs, bench, **parameters)
    return told.select(told.columns[0], "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, unnest(list_transform(range(0, greatest(len(w) - 10, 0) + 1), lambda s: w[s + 1 : s + 10])) AS win FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM v),
runs AS (SELECT r, n, p, w[p + 1 : p + n] AS win FROM (SELECT r, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS p FROM d, sizes)),
m AS (SELECT r, p, n, item_id FROM runs JOIN v USING (win)),
h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS place FROM (SELECT DISTINCT r, p, n FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""
