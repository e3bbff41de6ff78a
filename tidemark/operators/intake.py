"""From items and posts to stored tables: decisions, records, review rows, upserts, and one run of the whole engine."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, rules, scores, text
from ..session import materialized
from . import events, tables

_NONE = "array<string>"
#: What a model says of an item.
ANSWER = "id string, relation string, reason string, entities array<string>, confidence int"


@dataclass(frozen=True)
class Rules:
    """Word lists and limits of a run. Profiles: name -> aliases and entities."""

    profiles: dict[str, dict] = field(default_factory=dict)
    direct: str = fixed.DIRECT
    major: str = fixed.MAJOR
    leisure: str = fixed.LEISURE
    anchors: list[str] = field(default_factory=list)
    happenings: list[str] = field(default_factory=list)
    strategic: list[str] = field(default_factory=list)
    noise: list[str] = field(default_factory=list)
    article_days: int = 45
    signal_days: int = 14
    most_articles: int = 30000
    most_signals: int = 15000
    events: events.Config = field(default_factory=events.Config)


def batched_answers(ask: Callable[[list[dict]], str | list[dict]], size: int = 25) -> Callable[[DataFrame], DataFrame]:
    """A hook for classify(): asks about `size` items at a time and reads a JSON array of answers.

    A batch that fails, and an item without an answer, give no row, so the rules decide.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), size):
                batch = part.iloc[at : at + size]
                try:
                    said = ask([{**r, "profiles": list(r["profiles"]), "entities": list(r["entities"])} for r in batch.to_dict("records")])
                    if isinstance(said, str):
                        said = json.loads(said[said.find("[") : said.rfind("]") + 1])
                    known = set(batch["id"])
                    rows = [_answer(x) for x in said if isinstance(x, dict) and str(x.get("id")) in known]
                except Exception:
                    continue
                if rows:
                    yield pd.DataFrame(rows).drop_duplicates("id", keep="last")

    return lambda items: items.mapInPandas(run, ANSWER)


def _answer(x: dict) -> dict:
    try:
        sure = int(x.get("confidence", 70))
    except (TypeError, ValueError):
        sure = 70
    named = x.get("entities")
    return {"id": str(x["id"]), "relation": str(x.get("relation", "unrelated")), "reason": str(x.get("reason") or ""), "entities": [str(e) for e in named] if isinstance(named, list) else [], "confidence": max(0, min(100, sure))}


def answered(answers: DataFrame) -> DataFrame:
    """A model's answers within their limits: unknown relations are unrelated, 12 entities of 120 characters, a reason of 800."""
    kind = F.when(F.col("relation").isin("direct", "indirect", "potential"), F.col("relation")).otherwise("unrelated")
    names = F.transform(F.slice(F.coalesce("entities", F.array().cast(_NONE)), 1, 12), lambda x: text.compact_text(x, 120))
    return answers.select("id", kind.alias("relation"), F.coalesce(text.compact_text(F.col("reason"), 800), F.lit("")).alias("reason"), names.alias("entities"), F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("confidence", F.lit(70)))).alias("confidence"))


def classify(items: DataFrame, known: Rules, ask: Callable[[DataFrame], DataFrame] | None = None, classifier: str = "model") -> DataFrame:
    """Related items with their `decision`: relation, confidence, entities, reason, classifier.

    Direct terms decide at once. Of the rest, candidates alone are judged: by `ask` where there is one and it has
    an answer, else by rules. ask gets id, title, snippet, country, profiles and entities of candidates and returns
    ANSWER rows. Items need an id, one row each.
    """
    said = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    found = rules.match_profiles(said, F.col("country"), known.profiles)
    # Generated rows let no filter through, so each row is judged once.
    facts = rules.let(found, lambda m: F.struct(m.alias("found"), rules.judged(said, F.col("country"), m, False, known.direct, known.major, known.leisure).alias("rule")))
    wanted = lambda f: f["rule"]["candidate"] if ask else f["rule"]["candidate"] & (f["rule"]["relation"] != "unrelated")
    rows = items.withColumn("_facts", F.explode(F.filter(F.array(facts), wanted)))
    by_rule = F.struct(*(F.col(f"_facts.rule.{n}").alias(n) for n in ("relation", "confidence", "entities", "reason")), F.lit("rules").alias("classifier"))
    if ask is None:
        return rows.withColumn("decision", by_rule).drop("_facts")
    rows = materialized(rows)
    asked = rows.filter("NOT _facts.rule.direct").select("id", F.substring("title", 1, 500).alias("title"), F.substring("snippet", 1, 700).alias("snippet"), "country", "_facts.found.profiles", "_facts.found.entities")
    answers = answered(ask(asked)).select("id", F.struct("relation", "confidence", "entities", "reason", F.lit(classifier).alias("classifier")).alias("_model"))
    told = rows.join(answers, "id", "left").withColumn("decision", F.coalesce("_model", by_rule))
    return told.filter("decision.relation <> 'unrelated'").drop("_facts", "_model")


def article_records(items: DataFrame, now: Column) -> DataFrame:
    """Stored articles from items with a decision."""
    canonical = text.canonical_url(F.col("url"))
    d, blank = F.col("decision"), lambda c: F.coalesce(c, F.lit("")).alias(c)
    return items.select(
        text.record_id(canonical).alias("id"), "title", blank("snippet"), "source", "source_kind", blank("country"), blank("language"), "published_at", now.alias("collected_at"), "url", canonical.alias("canonical_url"),
        *(d[n].alias(n) for n in ("relation", "reason", "entities", "confidence", "classifier")), text.severity_label(F.concat_ws(" ", "title", F.coalesce("snippet", F.lit("")))).alias("severity"),
    )


def post_items(raw: DataFrame) -> DataFrame:
    """Posts as items, with all their columns; those without text go."""
    body = text.compact_text(F.col("text"), 1800)
    held = lambda c, other: F.coalesce(F.col(c), F.lit(other))
    told = raw.withColumns({
        "snippet": body, "title": F.substring(body, 1, 500), "source": F.concat(held("platform", "social"), F.lit(" · "), held("author", "unknown")), "source_kind": F.lit("social"),
        "url": F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit("https://example.invalid/"), F.coalesce("id", F.lit("signal")))),
    })
    return told.filter("snippet <> ''")


def judged_posts(items: DataFrame, known: Rules) -> DataFrame:
    """Posts with the struct `audit` of the rules for posts, and `severity`."""
    said = F.col("snippet")
    found = rules.match_profiles(said, F.col("country"), known.profiles)
    lists = (known.anchors, known.happenings, known.strategic, known.noise)
    # Generated columns are computed once, however often they are used.
    rows = items.withColumn("severity", text.severity_label(said)).withColumn("_found", F.explode(F.array(found)))
    told = rules.relevance_decision(said, *lists, text.severity(said), F.col("_found.entities"), F.col("_found.profiles"), F.col("_found.context"))
    return rows.withColumn("audit", F.explode(F.array(told))).drop("_found")


def signal_records(judged: DataFrame, now: Column) -> DataFrame:
    """Stored signals of the accepted posts."""
    a, body = F.col("audit"), F.col("snippet")
    held = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    own = text.record_id(F.concat(F.coalesce("platform", F.lit("")), F.lit(":"), F.coalesce("url", F.lit("")), F.lit(":"), body))
    weight = F.when(a["relation"] == "direct", 100).when(a["relation"] == "indirect", 82).when(a["relation"] == "potential", 60).otherwise(0)
    hours = (F.unix_micros(now) - F.unix_micros("published_at")) / F.lit(3.6e9)
    return judged.filter("audit.accepted").select(
        F.coalesce(F.nullif("id", F.lit("")), own).alias("id"), held("platform", "social").alias("platform"), held("author", "unknown").alias("author"), body.alias("text"), F.substring(body, 1, 360).alias("title"), "url", "published_at",
        now.alias("collected_at"), held("query", "").alias("query"), "engagement", F.coalesce("media_count", F.lit(0)).alias("media_count"), held("collector", "unknown").alias("collector"),
        F.concat(held("platform", "social"), F.lit(" · "), held("author", "unknown")).alias("source"), F.lit("social").alias("source_kind"), held("country", "").alias("country"), a["relation"].alias("relation"), a["reason"].alias("reason"), a["entities"].alias("entities"),
        scores.signal_confidence(F.col("confidence"), F.col("verified"), F.col("media_count")).alias("confidence"), scores.signal_priority(weight, text.severity(body), hours).alias("priority_score"), "severity", F.lit("rules").alias("classifier"),
        a["score"].alias("relevance_score"), a["anchors"].alias("matched_anchors"), a["events"].alias("matched_events"),
    )


def review_rows(judged: DataFrame) -> DataFrame:
    """What the rules said of every post, accepted or not."""
    a = F.col("audit")
    lists = {"matched_anchors": "anchors", "matched_events": "events", "matched_strategic": "strategic", "noise_terms": "noise", "profiles": "profiles", "entities": "entities"}
    return judged.select("id", "platform", "author", "published_at", "query", "text", "url", a["accepted"].alias("accepted"), a["relation"].alias("relation"), a["score"].alias("relevance_score"), "severity", a["reason"].alias("reason"), *(a[c].alias(n) for n, c in lists.items()))


def upsert(old: DataFrame, new: DataFrame, now: Column, days: int, most: int, turn: str | None = None) -> DataFrame:
    """Stored rows with new ones put in by id, canonical address or address; see tables.merge_by_id. Dates are of publication, else of collection."""
    keys = lambda df: [F.col(c) for c in ("id", "canonical_url", "url") if c in df.columns]
    shaped = lambda df: df.withColumns({"_store": tables.store_key(*keys(df)), "_dated": F.coalesce("published_at", "collected_at")}).filter("_store IS NOT NULL")
    return tables.merge_by_id(shaped(old), shaped(new), "_store", "_dated", now, days, most, turn).drop("_store", "_dated")


def counters(**frames: DataFrame) -> DataFrame:
    """(counter, n): the rows of each frame."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@dataclass(frozen=True)
class Result:
    """The tables after a run. review is None without external posts."""

    articles: DataFrame
    signals: DataFrame
    review: DataFrame | None
    events: DataFrame
    latest: DataFrame
    counters: DataFrame


def run(
    mode: str, now: Column, articles: DataFrame, signals: DataFrame, previous: DataFrame | None, known: Rules, items: DataFrame | None = None, posts: DataFrame | None = None, external: DataFrame | None = None,
    ask: Callable[[DataFrame], DataFrame] | None = None,
) -> Result:
    """One run: all, news, social or rebuild. Stored tables, landed items and posts in; the next stored tables, events and counts out.

    News: unseen addresses are judged and stored. Social: posts of the connectors and external ones not stored yet are
    judged and stored. In any mode external posts, if there are any, are judged anew in place of those stored, and events are built.
    Each stored table and the events are written once to spark.checkpoint.dir.
    """
    if mode not in ("all", "news", "social", "rebuild"):
        raise ValueError("mode must be all, news, social or rebuild")
    seen: dict[str, DataFrame] = {}
    if mode in ("all", "news") and items is not None:
        keyed = items.withColumn("canonical_url", text.canonical_url(F.col("url"))).filter("canonical_url <> ''")
        fresh = tables.unseen(keyed, articles, "canonical_url", F.asc("url"), F.asc("title"))
        told = materialized(classify(fresh.withColumn("id", text.record_id(F.col("canonical_url"))), known, ask))
        seen |= {"items_seen": items, "items_new": fresh, "items_relevant": told}
        articles = materialized(upsert(articles, article_records(told, now), now, known.article_days, known.most_articles))
    if mode in ("all", "social") and (posts is not None or external is not None):
        raw = posts if external is None else external if posts is None else posts.unionByName(external, allowMissingColumns=True)
        judged = judged_posts(post_items(tables.unseen_or_nameless(raw, signals, "id")), known)
        new = materialized(signal_records(judged, now))
        seen |= {"signals_seen": raw, "signals_relevant": new}
        signals = materialized(upsert(signals, new, now, known.signal_days, known.most_signals))
    review = None
    if external is not None and not external.isEmpty():
        judged = materialized(judged_posts(post_items(external), known))
        review = review_rows(judged)
        others = signals.filter(~F.col("collector").eqNullSafe(F.lit("MediaCrawler-external")))
        signals = materialized(upsert(others, signal_records(judged, now), now, known.signal_days, known.most_signals))
        seen |= {"social_review_total": review, "social_review_accepted": review.filter("accepted")}
    built = materialized(events.build_events(articles, signals, now, previous, known.events))
    order = [F.desc("priority_score"), F.desc("momentum_score"), F.desc("last_seen"), F.asc("id")]
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    gate = events.latest_gate(built, now).withColumn("_kind", F.coalesce(named("risk_category"), named("category"), F.lit("other")))
    latest = tables.diverse_top(gate, "_kind", order, caps={"military_security": 5}).drop("_kind")
    seen |= {"stored_articles": articles, "stored_signals": signals, "events": built, "latest_events": latest}
    return Result(articles, signals, review, built, latest, counters(**seen))
