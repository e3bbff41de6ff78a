"""Events from news and social posts: rows that tell one story, scored, matched with the last run's and put in order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, lexicon, rules, scores, text
from ..session import materialized
from . import similarity

#: Columns that rows may have, with their types; missing ones count as null.
FIELDS = {
    "id": "string", "title": "string", "text": "string", "snippet": "string", "source": "string", "source_kind": "string", "platform": "string", "author": "string", "url": "string", "country": "string", "language": "string",
    "published_at": "timestamp", "collected_at": "timestamp", "relation": "string", "reason": "string", "entities": "array<string>", "confidence": "int", "media_count": "int", "engagement": "map<string,bigint>",
}
#: What the next run reads of an event.
STATE = {
    "id": "string", "title": "string", "first_seen": "timestamp", "last_seen": "timestamp", "lifecycle": "string", "severity": "string", "status": "string", "source_count": "int", "evidence_count": "int", "official_evidence": "boolean",
    "entities": "array<string>", "countries": "array<string>",
    "history": "array<struct<observed_at:timestamp,last_seen:timestamp,lifecycle:string,priority_score:int,confidence_score:int,novelty_score:int,momentum_score:int,source_count:int,evidence_count:int>>",
}


@dataclass(frozen=True)
class Config:
    """tiers: (tier, pattern); families: name -> patterns; taxonomy: key -> label_zh, label_en, exposure_weight, terms."""

    tiers: list[tuple[int, str]] = field(default_factory=list)
    default_tier: int = 3
    families: dict[str, list[str]] = field(default_factory=dict)
    taxonomy: dict[str, dict] = field(default_factory=dict)
    escalation: list[str] = field(default_factory=list)
    resolution: list[str] = field(default_factory=list)
    concepts: dict[str, str] = field(default_factory=lambda: fixed.CONCEPTS)
    stop: list[str] = field(default_factory=lambda: fixed.STOP_WORDS)


def _shaped(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    there = set(df.columns)
    return df.select(*((F.col(c) if c in there else F.lit(None)).cast(t).alias(c) for c, t in fields.items()))


def union_rows(articles: DataFrame, signals: DataFrame) -> DataFrame:
    """News and posts together, posts with their derived defaults; origin_type says which.

    seq: articles first, each table in the order of its column input_order, else as Spark happens to number its rows.
    """
    placed = lambda df: F.col("input_order").cast("bigint") if "input_order" in df.columns else F.monotonically_increasing_id()
    articles, signals = (df.withColumn("_row", placed(df)) for df in (articles, signals))
    news = _shaped(articles, FIELDS | {"_row": "bigint"}).withColumn("origin_type", F.lit("news"))
    post = _shaped(signals, FIELDS | {"_row": "bigint"}).withColumn("origin_type", F.lit("social"))
    given = {c: c in signals.columns for c in ("source_kind", "source", "title")}
    if not given["source_kind"]:
        post = post.withColumn("source_kind", F.lit("social"))
    if not given["source"]:
        post = post.withColumn("source", F.concat(F.coalesce("platform", F.lit("social")), F.lit(" · "), F.coalesce("author", F.lit("unknown"))))
    if not given["title"]:
        post = post.withColumn("title", F.substring(F.coalesce("text", F.lit("")), 1, 260))
    both = news.withColumn("turn", F.lit(0)).unionByName(post.withColumn("turn", F.lit(1)))
    return both.withColumn("seq", F.struct("turn", F.col("_row").alias("row"))).drop("turn", "_row")


def _described(rows: DataFrame, cfg: Config, now: Column) -> DataFrame:
    """Rows of the last seven days, with what the aggregates need of each."""
    said = text.event_text(F.col("title"), F.col("text"), F.col("snippet"))
    at = F.coalesce("published_at", "collected_at")
    made = rows.withColumns({"at": F.coalesce(at, now), "dated": at, "said": said}).filter((F.unix_micros(now) - F.unix_micros("at") <= 7 * 86_400_000_000) & (F.col("said") != ""))
    kind = F.lower(F.coalesce("source_kind", F.lit("")))
    # The name that a family is told by may come from the author; the tier's may not.
    told = {
        "official": F.coalesce(F.col("source_kind") == "official", F.lit(False)), "news": F.col("origin_type") == "news", "tier": rules.source_tier(F.col("source"), kind, cfg.tiers, cfg.default_tier),
        "family": text.publisher_family(F.coalesce(F.nullif("source", F.lit("")), "author"), F.col("platform"), F.col("url"), cfg.families), "severity": text.severity_label(F.col("said")), "fresh": scores.freshness(F.col("dated"), now),
    }
    made = made.withColumns(told).withColumn("weight", scores.severity_value(F.col("severity")))
    social = (F.col("origin_type") == "social") | (F.col("source_kind") == "social")
    return made.withColumns(
        {
            "related": scores.relation_name_score(F.coalesce("relation", F.lit(""))), "strength": scores.evidence_score(F.coalesce(social, F.lit(False)), F.col("confidence"), F.col("media_count"), F.col("engagement"), F.col("tier")),
            "stands": scores.representative(F.col("official"), F.col("news"), F.col("tier"), F.col("weight"), F.col("fresh")), "proof": F.when(F.col("official"), "official").otherwise(F.col("origin_type")),
        }
    )


def _distinct(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """The distinct values of each cluster in the order of its rows."""
    each = rows.select("cluster", "place", value.alias("v"))
    first = each.groupBy("cluster", F.col("v.x").alias("x")).agg(F.min(F.struct("place", F.col("v.i").alias("i"))).alias("p"))
    return first.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("held")).select("cluster", F.col("held.x").alias(name))


def _facts(rows: DataFrame, cfg: Config) -> DataFrame:
    """A row a cluster. Texts and evidence come from its first rows, so an aggregate never holds a whole cluster."""
    ranked = rows.withColumns({"place": F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("at"), "seq")), "best": F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("related")))})
    head = lambda n, c: F.collect_list(F.when(F.col("place") <= n, F.struct("place", c)))
    proof = F.struct(
        "id", "origin_type", "source", "source_kind", "platform", "author", F.substring("said", 1, 500).alias("title"), "url", "published_at", "collected_at", "relation", "confidence", F.col("family").alias("publisher_family")
    ).alias("e")
    reason = F.trim(F.coalesce("reason", F.lit("")))
    facts = ranked.groupBy("cluster").agg(
        F.count("*").cast("int").alias("evidence_count"), F.count_if("news").cast("int").alias("news_count"), F.count_if(~F.col("news")).cast("int").alias("social_count"), F.countDistinct("family").cast("int").alias("source_count"),
        F.sort_array(F.collect_set(F.when(~F.col("news"), F.nullif("platform", F.lit(""))))).alias("platforms"), head(12, "said").alias("story"), head(30, proof).alias("proofs"), F.max("related").alias("top"), F.avg(F.when(F.col("best") <= 3, F.col("related"))).alias("mean"),
        F.max_by("severity", "weight").alias("severity"), F.max("weight").alias("weight"), F.max("fresh").alias("freshness_score"), F.min(F.when(F.col("news"), F.col("tier"))).alias("tier"), F.countDistinct("proof").alias("kinds"),
        F.max_by(F.struct("said", "language"), F.struct("stands", (-F.col("place")).alias("p"))).alias("rep"), F.min("at").alias("cluster_first_seen"), F.max("at").alias("last_seen"), F.max("strength").alias("strength"),
        F.coalesce(F.bool_or(F.col("official") & F.col("news")), F.lit(False)).alias("official_evidence"), F.min_by(F.when(reason != "", reason), F.when(reason != "", F.col("place"))).alias("reason"),
    )
    things = _distinct(ranked.select("cluster", "place", F.posexplode(F.coalesce("entities", F.array().cast("array<string>"))).alias("i", "x")).filter("x <> ''"), F.struct("x", "i"), "entities")
    country = F.trim(F.coalesce("country", F.lit("")))
    places = _distinct(ranked.filter(country != ""), F.struct(country.alias("x"), F.lit(0).alias("i")), "countries")
    none = F.array().cast("array<string>")
    joined = facts.join(things, "cluster", "left").join(places, "cluster", "left").withColumns({"entities": F.coalesce("entities", none), "countries": F.coalesce("countries", none)})
    story = F.array_join(F.col("held").getField("said"), " ")
    joined = joined.withColumn("held", F.array_sort("story")).withColumn("combined", story).withColumn("risks", rules.risk_taxonomy(F.col("combined"), cfg.taxonomy) if cfg.taxonomy else F.lit(None).cast("array<struct<weight:int,key:string,label_zh:string,label_en:string,terms:array<string>>>"))
    return joined.withColumns({"escalates": F.size(lexicon.found_terms(F.col("combined"), [(lexicon.TERM, t) for t in cfg.escalation])) > 0, "resolves": F.size(lexicon.found_terms(F.col("combined"), [(lexicon.TERM, t) for t in cfg.resolution])) > 0, "title": F.substring("rep.said", 1, 360), "language": F.coalesce("rep.language", F.lit(""))}).drop("story", "held")


def _matched(facts: DataFrame, previous: DataFrame, cfg: Config) -> DataFrame:
    """Facts beside the last run's event that each matches, as a struct p, and the score of the match."""
    known = materialized(_shaped(previous, STATE).withColumn("seq", F.monotonically_increasing_id()))
    sides = [
        materialized(similarity.prepared(df, key, "title", "last_seen", cfg.stop, cfg.concepts, keep=("entities", "countries")))
        for df, key in ((facts, "cluster"), (known, "seq"))
    ]
    found = similarity.best_matches(*sides).select(F.col("id").alias("cluster"), F.col("known_id").alias("seq"), F.col("score").alias("match_score"))
    old = known.select("seq", F.struct(*STATE).alias("p"))
    return facts.join(found.join(old, "seq").drop("seq"), "cluster", "left")


def build_events(articles: DataFrame, signals: DataFrame, now: Column, previous: DataFrame | None = None, cfg: Config = Config()) -> DataFrame:
    """A row an event, unordered; see ordered().

    Rows of the last seven days form clusters (similarity.clusters; its fold is the one sequential step). What an
    event matched in the last run gives its id, first_seen, novelty, momentum and history. Empty input gives none.
    """
    rows = _described(union_rows(articles, signals), cfg, now)
    rows = materialized(rows.withColumn("row", F.col("seq.turn") * F.lit(1 << 60) + F.col("seq.row")))
    found = similarity.clusters(materialized(similarity.prepared(rows, "row", "said", "at", cfg.stop, cfg.concepts)))
    facts = materialized(_facts(rows.join(found.withColumnRenamed("id", "row"), "row"), cfg))
    if previous is None:
        all_ = facts.withColumns({"p": F.lit(None).cast("struct<" + ",".join(f"{c}:{t}" for c, t in STATE.items()) + ">"), "match_score": F.lit(None).cast("double")})
    else:
        all_ = _matched(facts, previous, cfg)

    is_new = F.col("p").isNull()
    hours = lambda a, b: F.greatest(F.lit(0.0), (F.unix_micros(a) - F.unix_micros(b)) / 3.6e9)
    risk = F.try_element_at("risks", F.lit(1))
    told = all_.withColumns({"first_seen": F.coalesce("p.first_seen", "cluster_first_seen"), "risk": risk})
    told = told.withColumns(
        {
            "new_sources": F.when(is_new, F.col("source_count")).otherwise(F.greatest(F.lit(0), F.col("source_count") - F.coalesce("p.source_count", F.lit(0)))),
            "new_evidence": F.when(is_new, F.col("evidence_count")).otherwise(F.greatest(F.lit(0), F.col("evidence_count") - F.coalesce("p.evidence_count", F.lit(0)))),
            "severity_change": F.when(is_new, 0).otherwise(F.col("weight") - scores.severity_value(F.coalesce("p.severity", F.lit("")))),
            "official_added": F.col("official_evidence") & (is_new | ~(F.coalesce("p.official_evidence", F.lit(False)) | (F.coalesce("p.status", F.lit("")) == "官方信号"))),
            "novelty_score": scores.novelty(F.when(~is_new, hours(now, F.col("first_seen")))), "china_relevance_score": F.bround(0.78 * F.col("top") + 0.22 * F.col("mean"), 0).cast("int"),
            "corroboration_score": scores.corroboration(F.col("source_count")), "evidence_diversity_score": scores.diversity(F.col("kinds")), "source_score": scores.tier_score(F.coalesce("tier", F.lit(4)), 25),
            "category": F.coalesce(F.col("risk.label_zh"), text.category(F.col("combined"))), "risk_category": F.coalesce("risk.key", F.lit("other")), "risk_category_en": F.coalesce("risk.label_en", F.lit("")),
        }
    )
    stale = hours(now, F.col("last_seen"))
    told = told.withColumn("momentum_score", scores.momentum(is_new, F.col("source_count"), F.col("new_sources"), F.col("new_evidence"), F.col("official_added"), F.col("severity_change") > 0, F.col("escalates"), stale <= 12))
    told = told.withColumns(
        {
            "lifecycle": rules.lifecycle(F.col("resolves"), is_new, hours(now, F.col("first_seen")), F.col("momentum_score"), F.col("escalates"), F.col("severity_change") > 0, F.col("new_sources"), F.coalesce("p.lifecycle", F.lit("")), stale),
            "exposure_score": scores.exposure(F.col("risk.weight"), F.size("entities"), F.col("china_relevance_score")),
            "importance_score": scores.importance(F.col("weight"), F.col("source_score"), F.col("corroboration_score"), F.col("freshness_score")),
            "confidence_score": scores.confidence(F.col("strength"), F.col("corroboration_score"), F.col("evidence_diversity_score")), "status": rules.evidence_status(F.col("news_count"), F.col("social_count"), F.col("source_count"), F.col("official_evidence")),
        }
    )
    told = told.withColumn("priority_score", scores.priority(F.col("china_relevance_score"), F.col("weight"), F.col("novelty_score"), F.col("momentum_score"), F.col("exposure_score"), F.col("freshness_score"), F.col("lifecycle") == "resolved"))
    why = [rules.why_now(lang, F.col("lifecycle"), risk, F.col("new_sources"), F.col("source_count"), F.col("official_added"), F.col("novelty_score"), F.col("momentum_score")).alias(f"why_now_{lang}") for lang, risk in (("zh", F.col("category")), ("en", F.col("risk_category_en")))]
    snapshot = F.struct(now.alias("observed_at"), "last_seen", "lifecycle", "priority_score", "confidence_score", "novelty_score", "momentum_score", "source_count", "evidence_count")
    past = F.coalesce("p.history", F.array().cast(STATE["history"]))
    tail = F.when(F.coalesce(F.try_element_at(past, F.lit(-1)) == snapshot.cast(STATE["history"][6:-1]), F.lit(False)), past).otherwise(F.concat(past, F.array(snapshot).cast(STATE["history"])))
    last = F.slice(tail, F.greatest(F.lit(1), F.size(tail) - 11), 12)
    return told.select(
        F.coalesce(F.nullif("p.id", F.lit("")), text.event_id(F.col("title"), F.col("cluster_first_seen"))).alias("id"), "title", "language", "status", F.col("status").alias("evidence_status"), "lifecycle", "category", "risk_category", "risk_category_en",
        F.coalesce(F.slice(F.col("risks.key"), 1, 4), F.array().cast("array<string>")).alias("risk_categories"), F.coalesce(F.slice(F.array_distinct(F.flatten(F.slice(F.col("risks.terms"), 1, 4))), 1, 20), F.array().cast("array<string>")).alias("matched_risk_terms"),
        "severity", "priority_score", "confidence_score", "importance_score", "china_relevance_score", "novelty_score", "momentum_score", "exposure_score", "freshness_score", "corroboration_score", "evidence_diversity_score",
        "first_seen", "last_seen", "source_count", "evidence_count", "news_count", "social_count", "official_evidence", "platforms", F.slice("countries", 1, 8).alias("countries"), F.slice("entities", 1, 16).alias("entities"), F.coalesce("reason", F.lit("")).alias("reason"),
        *why, (~is_new).alias("previous_event_matched"), F.coalesce(F.bround("match_score", 3), F.lit(0.0)).alias("previous_match_score"), F.struct("new_sources", "new_evidence", "severity_change", "official_added").alias("change"), last.alias("history"),
        F.col("proofs").alias("_proofs"),
    ).withColumn("evidence", F.transform(F.array_sort("_proofs"), lambda x: x["e"])).drop("_proofs")


def ordered(events: DataFrame) -> DataFrame:
    """Most urgent first; of equals those that move most, then the latest, then by id."""
    return events.orderBy(F.desc("priority_score"), F.desc("momentum_score"), F.desc("last_seen"), "id")


def latest_gate(events: DataFrame, now: Column, hours: int = 24, least: int = 58) -> DataFrame:
    """Events of the last hours with the least priority."""
    return events.filter((F.col("last_seen") >= now - F.expr(f"INTERVAL {hours} HOURS")) & (F.coalesce("priority_score", F.lit(0)) >= least))
