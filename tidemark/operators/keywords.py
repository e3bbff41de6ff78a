"""Search plans: queries from templates over term groups, ranked and picked within a budget."""

from __future__ import annotations

import string
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed

CANDIDATE = "query string, template string, score bigint, facets array<string>"


def clean(c: Column) -> Column:
    return F.trim(collapsed(c))


def folded(c: Column) -> Column:
    """What tells queries apart: white space collapsed, small letters."""
    return F.lower(clean(c))


def hash_rank(seed: Column, value: Column) -> Column:
    """A fixed random order of values for a seed, such as a date."""
    return F.sha2(F.concat(seed, F.lit("|"), value), 256)


def distinct_queries(df: DataFrame, seq: str, pinned: str | None = None) -> DataFrame:
    """One candidate a query: a pinned one before others, then the highest score, then the first; at the place of the first, as `place`."""
    named = df.withColumn("_key", folded(F.col("query"))).filter("_key <> ''")
    pin = F.col(pinned) if pinned else F.lit(False)
    window = Window.partitionBy("_key")
    ranked = named.withColumns({"_n": F.row_number().over(window.orderBy(F.desc(pin), F.desc("score"), seq)), "place": F.min(seq).over(window)})
    return ranked.filter("_n = 1").drop("_n", "_key")


def expand(spark: SparkSession, spec: Mapping, groups: Mapping[str, Iterable[tuple[str, int]]], date: str) -> DataFrame:
    """Candidates of one template: each choice of a term a slot put into the pattern, by score and a daily order, up to its cap.

    groups: name -> (term, weight) pairs. A template without a pattern or with an empty group has none. Terms are
    parameters, a few hundred a group; the product of the groups is made and ranked in the cluster.
    """
    name, pattern, refs = str(spec.get("name") or "unnamed"), str(spec.get("pattern") or "").strip(), spec.get("groups") or {}
    terms = {slot: list({t.strip().casefold(): (t.strip(), w) for t, w in reversed(list(groups.get(ref, []))) if t.strip()}.values())[::-1] for slot, ref in refs.items()}
    holes = [h for _, h, _, _ in string.Formatter().parse(pattern) if h is not None]
    if not pattern or not terms or not all(terms.values()) or not set(holes) <= set(terms):
        return spark.createDataFrame([], CANDIDATE)
    out = spark.range(1).select(F.lit(0).cast("bigint").alias("seq"), F.lit(int(spec.get("priority") or 0)).cast("bigint").alias("score"))
    for slot, pairs in terms.items():
        side = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(pairs)], "i bigint, t string, w bigint")
        out = out.crossJoin(F.broadcast(side)).select(*[c for c in out.columns if c not in ("seq", "score")], (F.col("seq") * len(pairs) + F.col("i")).alias("seq"), (F.col("score") + F.col("w")).alias("score"), F.col("t").alias(f"t_{slot}"))
    pieces = [p for text, hole, _, _ in string.Formatter().parse(pattern) for p in (F.lit(text), F.col(f"t_{hole}") if hole is not None else F.lit(""))]
    facets = [F.col(f"t_{s}") for s in (spec.get("diversity_slots") or ([spec["diversity_slot"]] if spec.get("diversity_slot") else [])) if s in terms]
    made = out.select(clean(F.concat(*pieces)).alias("query"), F.lit(name).alias("template"), "score", F.array(*facets).cast("array<string>").alias("facets"), "seq")
    kept = distinct_queries(made, "seq").orderBy(F.desc("score"), hash_rank(F.lit(f"{date}|pool|{name}"), F.col("query")))
    cap = int(spec.get("max_candidates") or 0)
    return (kept.limit(cap) if cap > 0 else kept).select("query", "template", "score", "facets")


def top_of_templates(candidates: DataFrame, date: str, most: int) -> DataFrame:
    """The best candidates of each template, equal scores in a daily order, with their rank."""
    seed = F.concat(F.lit(f"{date}|pick|"), F.col("template"))
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("template").orderBy(F.desc("score"), hash_rank(seed, F.col("query")))))
    return ranked.filter(F.col("rank") <= most)


class _Picked:
    """Queries chosen so far, in order."""

    def __init__(self, budget: int):
        self.budget, self.rows, self.keys = budget, [], set()

    def full(self) -> bool:
        return bool(self.budget) and len(self.rows) >= self.budget

    def take(self, query: str, template: str, score: int, pinned: bool = False) -> bool:
        key = " ".join(query.split()).casefold()
        if not key or key in self.keys:
            return False
        self.keys.add(key)
        self.rows.append((len(self.rows), query, template, int(score), pinned))
        return True


def _diverse(picked: _Picked, rows: list, quota: int) -> None:
    """Up to a quota of a template's rows: first those none of whose facets was used, then any."""
    chosen, used, done = 0, {}, set()
    for fresh in (True, False):
        for at, row in enumerate(rows):
            if chosen >= quota or picked.full():
                return
            facets = [(i, f.casefold()) for i, f in enumerate(x for x in row.facets if x)]
            if at in done or (fresh and (not facets or any(f in used for f in facets))):
                continue
            if picked.take(row.query, row.template, row.score):
                chosen += 1
                done.add(at)
                used.update(dict.fromkeys(facets))


def build_plan(spark: SparkSession, templates: list[Mapping], groups: Mapping[str, Iterable[tuple[str, int]]], date: str, budget: int = 0, pinned: Iterable[str] = ()) -> DataFrame:
    """(position, query, template, score, pinned): pinned queries, each template's quota with diverse facets, then the best of the rest.

    What is picked depends on all that was picked before, over templates, so the pick is one sequential pass. It reads
    each template's best candidates only: its quota of each facet value and as many as the budget can need.
    """
    picked = _Picked(budget)
    for query in pinned:
        picked.take(" ".join(str(query).split()), "pinned", 10_000, True)
    pools = [expand(spark, spec, groups, date).persist() for spec in templates]
    for spec, pool in zip(templates, pools):
        ranked = top_of_templates(pool, date, 1 << 30).orderBy("rank").toPandas()  # a template's candidates are capped by max_candidates
        _diverse(picked, list(ranked.itertuples(index=False)), max(0, int(spec.get("quota") or 0)))
    if budget and len(picked.rows) < budget and pools:
        everything = pools[0].withColumn("turn", F.lit(0))
        for i, pool in enumerate(pools[1:], 1):
            everything = everything.unionByName(pool.withColumn("turn", F.lit(i)))
        rest = distinct_queries(everything.withColumn("seq", F.struct("turn", "query")), "seq")
        for row in rest.orderBy(F.desc("score"), hash_rank(F.lit(f"{date}|fill"), F.col("query"))).limit(budget + len(picked.keys)).toPandas().itertuples(index=False):
            if picked.full():
                break
            picked.take(row.query, row.template, row.score)
    for pool in pools:
        pool.unpersist()
    rows = picked.rows[: budget or len(picked.rows)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["position", "query", "template", "score", "pinned"]) if rows else [], "position int, query string, template string, score bigint, pinned boolean")
