"""Queries of landed items, posts, records and translations on the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import bilingual, intake, tables
from ..sources import feeds
from .more import _DIRECT, _LEISURE, _MAJOR, _MATCHED, _NOW, _PROFILES, _now, _read

_RULES = intake.Rules(profiles=_PROFILES, direct=_DIRECT, major=_MAJOR, leisure=_LEISURE)


def _items(spark, sf_dir):
    """Documents as news items; China is home, so every grave event counts."""
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.lit("").alias("title"), F.col("text").alias("snippet"), F.col("source"), F.lit("news").alias("source_kind"), F.col("source").alias("country"), F.col("lang").alias("language"), F.lit(None).cast("timestamp").alias("published_at"), F.concat(F.lit("HTTPS://Example.org//d/"), "doc_id", F.lit("/#x")).alias("url"))


def a7_page_items(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source"), F.lit("news").alias("source_kind"), F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("language"), "url", "html")
    return feeds.page_items(pages, least=2, alone=3)  # the links of these pages are single words


def a9_search_items(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    answers = docs.select("doc_id", F.substring("text", 1, 40).alias("title"), F.concat(F.lit("http://x.org/"), F.floor(F.col("doc_id") / 3)).alias("url"), F.lit("").alias("domain"), F.lit("X").alias("sourcecountry"), F.col("lang").alias("language"), F.lit("20240120T103000Z").alias("seendate"))
    return feeds.search_items(answers, F.asc("doc_id")).select("url", "source", "language", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("at"))


def a11_posts_with_users(spark, sf_dir):
    posts = _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("author_id"), F.col("props").alias("text"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("query"), F.lit(None).cast("map<string,bigint>").alias("engagement"), F.lit(None).cast("int").alias("media_count"))
    users = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.lit("").alias("name"), (F.col("c_acctbal") > 0).alias("verified"))
    return feeds.posts_with_users(posts, users, _now()).select("id", "author", "author_name", "verified", "url", "media_count")


def a14_channel_messages(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.concat(F.lit(" @"), "user_id").alias("channel"), F.col("event_id").alias("msg_id"), F.col("props").alias("text"), F.col("ts").cast("timestamp").alias("date"), F.col("value").alias("views"), F.lit(None).cast("int").alias("forwards"), (F.col("event_id") % 2 == 0).alias("media"))
    return feeds.channel_messages(rows, _now(), 24 * 7, 3).select("id", "author", "url", "media_count", F.element_at("engagement", "views").alias("views"))


def a16_collect_posts(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("platform"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("url"), F.col("props").alias("text"))
    return feeds.collect_posts(rows.filter("platform <> 'purchase'"), rows.filter("platform = 'purchase'")).select("id", "platform", "url")


def a18_post_items(spark, sf_dir):
    raw = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("platform"), F.col("source").alias("author"), F.substring("text", 1, 200).alias("text"), F.lit("").alias("url"))
    return intake.post_items(raw).select("id", F.sha2("title", 256).alias("title"), "source", "url")


def c13_article_records(spark, sf_dir):
    decision = F.struct(F.lit("direct").alias("relation"), F.lit(94).alias("confidence"), F.array(F.lit("a")).alias("entities"), F.lit("").alias("reason"), F.lit("rules").alias("classifier"))
    return intake.article_records(_items(spark, sf_dir).withColumn("decision", decision), _now()).select("id", "source", "canonical_url", "relation", "confidence")


def e7_classify(spark, sf_dir):
    return intake.classify(_items(spark, sf_dir), _RULES).select("doc_id", "decision.relation", "decision.confidence")


def e8_answers_first(spark, sf_dir):
    """Answers for every even document, rules for the rest."""

    def ask(items):
        return items.filter(F.col("id").cast("bigint") % 2 == 0).select("id", F.when(F.col("id").cast("bigint") % 4 == 0, "potential").otherwise("odd").alias("relation"), F.lit("r").alias("reason"), F.lit(None).cast("array<string>").alias("entities"), F.lit(130).alias("confidence"))

    return intake.classify(_items(spark, sf_dir), _RULES, ask).select("doc_id", "decision.relation", "decision.confidence", "decision.classifier")


def f8_cached(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    cache = docs.filter("lang = 'fr'").select(text.cache_key(F.col("source"), F.lit("en")).alias("cache_key"), F.concat(F.lit("en:"), "source").alias("value"))
    jobs = docs.select("doc_id", F.col("source").alias("text"), F.when(F.col("doc_id") % 2 == 0, "en").otherwise("zh-CN").alias("target"))
    return bilingual.cached(jobs, cache).select("doc_id", "value")


def g19_counters(spark, sf_dir):
    return intake.counters(documents=_read(spark, sf_dir, "documents"), reports=_read(spark, sf_dir, "pages"), none=_read(spark, sf_dir, "events").filter("user_id < 0"))


def j4_upsert(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("u"), "user_id").alias("url"), F.col("ts").cast("timestamp").alias("published_at"), F.lit(None).cast("timestamp").alias("collected_at"), F.lit("old").alias("state"))
    new = rows.filter("url LIKE 'u1%'").withColumns({"id": F.lit(""), "state": F.lit("new")})
    last = tables.first_wins(new, "url", F.desc("published_at"))
    return intake.upsert(rows, last, _now(), 14, 12000).select("id", "url", "state")


def k9_review(spark, sf_dir):
    raw = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.lit("p").alias("platform"), F.lit("a").alias("author"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("q").alias("query"), F.col("text"), F.lit("").alias("url"), F.col("source").alias("country"))
    known = intake.Rules(profiles={"src1": {"aliases": [], "entities": ["with"]}}, anchors=["that"], happenings=["pour", "nicht"], strategic=["para"], noise=["%%%"])
    return intake.review_rows(intake.judged_posts(intake.post_items(raw), known)).select("id", "accepted", "relation", F.array_join("matched_events", ",").alias("events"), F.array_join("matched_anchors", ",").alias("anchors"))


def k8_bilingual(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.col("source").alias("title"), F.lit("r").alias("reason"), F.when(F.col("lang") == "de", "zh").otherwise(F.col("lang")).alias("language"), F.lit("direct").alias("relation"), F.array().cast("array<string>").alias("countries"), F.array(F.lit("x")).alias("entities"))
    cache = docs.select(text.cache_key(F.col("source"), F.lit("en")).alias("cache_key"), F.concat(F.lit("en:"), "source").alias("value")).distinct()
    out, _, _ = bilingual.enrich(rows, cache, [F.asc("doc_id")], titles=100, reasons=10)
    return out.select("doc_id", "title_zh", "title_en", "reason_zh")


QUERIES = (a7_page_items, a9_search_items, a11_posts_with_users, a14_channel_messages, a16_collect_posts, a18_post_items, c13_article_records, e7_classify, e8_answers_first, f8_cached, g19_counters, j4_upsert, k9_review, k8_bilingual)

_JUDGED = f"""(SELECT *, regexp_matches(t, 'secret|%%%') AS d, regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])(und|pour|with)([^\\p{{L}}\\p{{N}}_]|$)') AND NOT regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])(para)([^\\p{{L}}\\p{{N}}_]|$)') AS m FROM {_MATCHED})"""
_RELATION = "CASE WHEN d THEN 'direct' WHEN len(ents) > 0 THEN 'indirect' WHEN m AND len(list_filter(profiles, lambda p: p <> 'Europe')) > 0 THEN 'potential' ELSE 'unrelated' END"
_SURE = "CASE WHEN d THEN 94 WHEN len(ents) > 0 THEN 84 ELSE 62 END"
SQL = {
    "a9_search_items": "SELECT 'http://x.org/' || doc_id // 3 AS url, 'search' AS source, lang AS language, '2024-01-20 10:30' AS at FROM documents WHERE regexp_matches(substr(text, 1, 40), '[^ \\t\\n\\x0B\\f\\r]') QUALIFY row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) = 1",
    "a11_posts_with_users": "SELECT substr(sha256('x:' || event_id), 1, 20) AS id, coalesce(c_name, user_id::VARCHAR) AS author, coalesce(c_name, user_id::VARCHAR) AS author_name, coalesce(c_acctbal > 0, false) AS verified, 'https://x.com/' || coalesce(c_name, user_id::VARCHAR) || '/status/' || event_id AS url, 0 AS media_count FROM events LEFT JOIN customer ON c_custkey = user_id",
    "a14_channel_messages": f"SELECT substr(sha256('telegram:' || user_id || ':' || event_id), 1, 20) AS id, user_id::VARCHAR AS author, 'https://t.me/' || user_id || '/' || event_id AS url, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS media_count, CAST(trunc(value) AS BIGINT) AS views FROM events WHERE ts >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAYS AND trim(props) <> '' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3",
    "a16_collect_posts": "SELECT user_id::VARCHAR AS id, event_type AS platform, lpad(event_id::VARCHAR, 12, '0') AS url FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, event_id DESC) = 1",
    "a18_post_items": "SELECT id, sha256(b) AS title, 'social · ' || source AS source, 'https://example.invalid/' || id AS url FROM (SELECT doc_id::VARCHAR AS id, source, trim(regexp_replace(substr(text, 1, 200), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS b FROM documents) WHERE b <> ''",
    "c13_article_records": "SELECT substr(sha256('https://example.org/d/' || doc_id), 1, 20) AS id, source, 'https://example.org/d/' || doc_id AS canonical_url, 'direct' AS relation, 94 AS confidence FROM documents",
    "e7_classify": f"SELECT doc_id, {_RELATION} AS relation, {_SURE} AS confidence FROM {_JUDGED} WHERE {_RELATION} <> 'unrelated'",
    "e8_answers_first": f"""SELECT * FROM (SELECT doc_id, CASE WHEN d OR doc_id % 2 = 1 THEN {_RELATION} WHEN doc_id % 4 = 0 THEN 'potential' ELSE 'unrelated' END AS relation, CASE WHEN d OR doc_id % 2 = 1 THEN {_SURE} ELSE 100 END AS confidence,
        CASE WHEN d OR doc_id % 2 = 1 THEN 'rules' ELSE 'model' END AS classifier FROM {_JUDGED} WHERE d OR len(ents) > 0 OR (m AND len(profiles) > 0)) WHERE relation <> 'unrelated'""",
    "f8_cached": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND source IN (SELECT source FROM documents WHERE lang = 'fr') THEN 'en:' || source END AS value FROM documents",
    "g19_counters": "SELECT 'documents' AS counter, count(*) AS n FROM documents UNION ALL SELECT 'reports', count(*) FROM pages UNION ALL SELECT 'none', 0",
    "j4_upsert": f"""SELECT id, url, state FROM (SELECT event_id::VARCHAR AS id, 'u' || user_id AS url, ts, 'old' AS state, event_id::VARCHAR AS k FROM events UNION ALL
        SELECT '', 'u' || user_id, max(ts), 'new', 'u' || user_id FROM events WHERE starts_with(user_id::VARCHAR, '1') GROUP BY user_id) WHERE ts >= TIMESTAMP '{_NOW}' - INTERVAL 14 DAYS ORDER BY ts DESC, k LIMIT 12000""",
    "k8_bilingual": "SELECT doc_id, CASE WHEN r <= 100 THEN source END AS title_zh, CASE WHEN r <= 100 THEN CASE WHEN lang = 'de' THEN 'en:' || source ELSE source END END AS title_en, CASE WHEN r <= 100 THEN 'r' END AS reason_zh FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM documents)",
    "k9_review": """SELECT id, relation <> 'unrelated' AS accepted, relation, array_to_string(list_filter(['pour', 'nicht'], lambda x: contains(b, x)), ',') AS events, CASE WHEN a THEN 'that' ELSE '' END AS anchors FROM (
        SELECT *, CASE WHEN e AND v THEN CASE WHEN score >= 55 THEN 'indirect' ELSE 'unrelated' END WHEN a AND v THEN CASE WHEN score >= 55 THEN 'direct' ELSE 'unrelated' END WHEN v AND s AND p AND score >= 60 THEN 'potential' ELSE 'unrelated' END AS relation FROM (
        SELECT *, greatest(0, least(100, 38 * a::INT + 28 * e::INT + 34 * v::INT + 14 * s::INT + CASE WHEN sev >= 75 THEN 10 WHEN sev >= 50 THEN 5 ELSE 0 END + CASE WHEN n AND NOT v THEN -48 WHEN n THEN -15 ELSE 0 END
            + CASE WHEN a AND NOT e AND NOT v THEN -25 ELSE 0 END + CASE WHEN NOT a AND NOT e THEN -20 ELSE 0 END)) AS score FROM (
        SELECT *, contains(b, 'that') AS a, regexp_matches(b, '(^|[^a-z0-9])with([^a-z0-9]|$)') AS e, contains(b, 'pour') OR contains(b, 'nicht') AS v, contains(b, 'para') AS s, contains(b, '%%%') AS n,
            source = 'src1' OR regexp_matches(b, '(^|[^a-z0-9])(src1|with)([^a-z0-9]|$)') AS p, 25 AS sev FROM (
        SELECT doc_id::VARCHAR AS id, source, lower(substr(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 1800)) AS b FROM documents) WHERE b <> '')))""",
}
