"""What readers of the published tables ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def says(query: str, *fields: Column) -> Column:
    """Whether a text is part of the fields put together, in any case of letters; an empty one always is. Lists are joined by spaces."""
    query = query.strip().lower()
    whole = F.concat_ws(" ", *(F.coalesce(f, F.lit("")) for f in fields))
    return F.contains(F.lower(whole), F.lit(query)) if query else F.lit(True)


def filter_events(events: DataFrame, category: str = "", status: str = "", lifecycle: str = "", query: str = "", fields: tuple[str, ...] = ("title", "reason")) -> DataFrame:
    """Events of a category, status and lifecycle (empty: any) that say the query in one of the fields; array columns count as their elements."""
    kinds = {f.name: f.dataType.typeName() for f in events.schema.fields}
    told = [F.array_join(F.col(c), " ") if kinds[c] == "array" else F.col(c).cast("string") for c in fields]
    keep = says(query, *told)
    for column, wanted in (("category", category), ("status", status), ("lifecycle", lifecycle)):
        if wanted:
            keep = keep & (F.col(column) == wanted)
    return events.filter(keep)


def social_only(events: DataFrame) -> DataFrame:
    """Events that no news report holds."""
    return events.filter((F.col("social_count") > 0) & (F.col("news_count") == 0))


def first_of_all(events: DataFrame, order: list[Column], most: int = 300) -> DataFrame:
    """The first events in order."""
    return events.orderBy(*order).limit(most)


def raw_feed(signals: DataFrame, articles: DataFrame, most: int = 2000) -> DataFrame:
    """Posts and news together, newest first: kind, id, at, source, content. Ties go by kind and id."""
    post = signals.select(F.lit("signal").alias("kind"), "id", F.coalesce("published_at", "collected_at").alias("at"), F.concat_ws(" · ", F.coalesce("platform", F.lit("")), F.coalesce("author", F.lit(""))).alias("source"), F.col("text").alias("content"))
    news = articles.select(F.lit("article").alias("kind"), "id", F.coalesce("published_at", "collected_at").alias("at"), "source", F.col("title").alias("content"))
    return post.unionByName(news).orderBy(F.desc_nulls_last("at"), "kind", "id").limit(most)


def filter_review(review: DataFrame, decision: str = "", query: str = "", fields: tuple[str, ...] = ("text", "query", "reason")) -> DataFrame:
    """Audit rows accepted or rejected (empty: both) that say the query."""
    keep = says(query, *(F.col(c).cast("string") for c in fields))
    if decision:
        accepted = F.coalesce(F.col("accepted"), F.lit(False))
        keep = keep & (accepted if decision == "accepted" else ~accepted)
    return review.filter(keep)


def status_rows(platforms: DataFrame, translated: int | None = None, cache_hits: int = 0, failed: int = 0, provider: str = "") -> DataFrame:
    """Status of each platform, and of the translation if there was one, with a class for its severity."""
    rows = platforms.select("platform", "status", F.col("items").cast("bigint").alias("items"), "detail")
    if translated is not None:
        said = f"provider={provider}; translated={translated}; cache={cache_hits}; failed={failed}"
        more = platforms.sparkSession.range(1).select(F.lit("bilingual").alias("platform"), F.lit("partial" if failed > 0 else "ok").alias("status"), F.lit(translated).cast("bigint").alias("items"), F.lit(said).alias("detail"))
        rows = rows.unionByName(more)
    return rows.withColumn("class", F.when(F.col("status").isin("blocked", "error", "failed"), "bad").when(F.col("status").isin("empty", "partial", "not_configured"), "warn").otherwise(""))


def platform_status(platforms: DataFrame, counts: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """ok for a platform with rows, else what its diagnostics say, else empty. Joined on platform."""
    joined = platforms.join(counts.select("platform", F.col("items").cast("bigint").alias("items")), "platform", "left").join(diagnostics.select("platform", F.col("status").alias("said"), "reason_code"), "platform", "left")
    items = F.coalesce("items", F.lit(0))
    return joined.select("platform", F.when(items > 0, "ok").otherwise(F.coalesce(F.nullif("said", F.lit("")), F.lit("empty"))).alias("status"), items.alias("items"), F.coalesce("reason_code", F.lit("")).alias("reason_code"))


def source_catalog(sources: DataFrame, group: str = "", query: str = "") -> DataFrame:
    """Sources of a group (empty: all) that say the query, by group, tier and name."""
    keep = says(query, *(F.col(c).cast("string") for c in ("name", "country", "language", "group")))
    return sources.filter(keep & (F.col("group") == group) if group else keep).orderBy("group", "tier", "name")


def kpis(events: DataFrame, latest: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: events in focus, of posts alone, urgent and escalating ones in focus, and sources."""
    a = latest.agg(F.count("*").alias("focus"), F.count_if(F.col("priority_score") >= 75).alias("urgent"), F.count_if(F.col("lifecycle") == "escalating").alias("escalating"))
    b = events.agg(F.count_if((F.col("social_count") > 0) & (F.col("news_count") == 0)).alias("social_only"))
    return a.crossJoin(b).crossJoin(sources.agg(F.count("*").alias("sources")))  # a row each


def facets(events: DataFrame, *columns: str) -> DataFrame:
    """(facet, value): the distinct values of each column that are not empty."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return events.select(pairs.alias("p")).select("p.facet", "p.value").filter("value <> ''").distinct()
