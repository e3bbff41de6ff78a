"""Titles and reasons in two languages: from a cache, from a translator, else from what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..session import materialized


def cached(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Jobs (text, target, ...) with the `value` that the cache (cache_key, value) has for them, or null."""
    known = cache.groupBy("cache_key").agg(F.max("value").alias("value"))
    return jobs.withColumn("cache_key", text.cache_key(F.col("text"), F.col("target"))).join(known, "cache_key", "left")


def translations(events: DataFrame, order: list[Column], titles: int = 300, reasons: int = 80) -> DataFrame:
    """The jobs (id, field, text, target) of the first events: the other language of a title, and English reasons.

    The order must be total. The first `titles` events are numbered in one task, since the two limits bound them.
    """
    first = events.orderBy(*order).limit(titles)
    rows = first.withColumn("_place", F.row_number().over(Window.orderBy(*order)))
    title, reason = (F.trim(F.coalesce(c, F.lit(""))) for c in ("title", "reason"))
    job = lambda name, said, target: F.struct(F.lit(name).alias("field"), said.alias("text"), F.lit(target).alias("target"))
    own = F.when(chinese(), job("title_en", title, "en")).otherwise(job("title_zh", title, "zh-CN"))
    jobs = F.array(own, F.when(F.col("_place") <= min(titles, reasons), job("reason_en", reason, "en")))
    return rows.select("id", F.explode(jobs).alias("j")).select("id", "j.field", "j.text", "j.target").filter("text <> ''")


def chinese() -> Column:
    """Whether an event's title is Chinese: by its language, or by its signs where that is unknown."""
    lang = F.lower(F.coalesce("language", F.lit("")))
    return lang.startswith("zh") | ((lang == "") & text.has_cjk(F.col("title")))


def enrich(events: DataFrame, cache: DataFrame, order: list[Column], translate: Callable[[DataFrame], DataFrame] | None = None, titles: int = 300, reasons: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, cache, counts). The first `titles` events get title_zh, title_en, reason_zh and reason_en; the others nulls there.

    translate: takes (cache_key, text, target), returns (cache_key, value), such as a mapInPandas; rows it leaves out
    count as failed. Without one nothing is pending. What stays open falls back to the title itself and, for English
    reasons, to a sentence from the event's relation, area and entities. Ids must be unique.
    """
    jobs = materialized(cached(translations(events, order, titles, reasons), cache))
    done = jobs.filter("value IS NOT NULL").select("cache_key", "value")
    new = None
    if translate is not None:
        open_ = jobs.filter("value IS NULL").select("cache_key", F.substring("text", 1, 1800).alias("text"), "target").dropDuplicates(["cache_key"])
        new = materialized(translate(open_).filter("value <> ''").select("cache_key", "value"))
    more = done.distinct() if new is None else done.distinct().unionByName(new)
    made = jobs.drop("value").join(more, "cache_key").groupBy("id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias("_" + f) for f in ("title_zh", "title_en", "reason_en")))
    near = events.orderBy(*order).limit(titles).select("id", F.lit(True).alias("_first"))
    rows = events.join(near, "id", "left").join(made, "id", "left")
    title, reason = (F.trim(F.coalesce(c, F.lit(""))) for c in ("title", "reason"))
    first, held = F.col("_first"), lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))
    told = {
        "title_zh": held(F.when(chinese(), title), F.col("_title_zh"), title), "title_en": held(F.when(~chinese(), title), F.col("_title_en"), title), "reason_zh": reason,
        "reason_en": held(F.col("_reason_en"), rules.english_reason(F.col("relation"), F.col("countries"), F.col("entities"))),
    }
    out = rows.withColumns({n: F.when(first, c) for n, c in told.items()}).drop("_first", "_title_zh", "_title_en", "_reason_en")
    hits = F.count("value").alias("cache_hits")
    counts = jobs.agg(F.count("*").alias("jobs"), hits) if new is None else jobs.join(new.select("cache_key", F.lit(1).alias("_new")), "cache_key", "left").agg(F.count("*").alias("jobs"), hits, F.count("_new").alias("translated"))
    if new is None:
        counts = counts.withColumn("translated", F.lit(0).cast("bigint"))
    counts = counts.withColumn("failed", F.col("jobs") - F.col("cache_hits") - F.col("translated") if new is not None else F.lit(0).cast("bigint"))
    return out, (cache if new is None else cache.select("cache_key", "value").unionByName(new)), counts
