"""Landed feeds, home pages, search answers and posts as items: what the network readers would bring, read from tables.

An item has source, source_kind, country, language, title, url, published_at and snippet. Landed tables carry the first
four beside their own columns. Nothing here opens a connection.
"""

from __future__ import annotations

from collections.abc import Iterable
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links, text
from ..operators import tables

_ABOUT = ("source", "source_kind", "country", "language")


def _field(entry: Column, names: str) -> Column:
    """What an element of an entry holds: a CDATA section as it is, other text with its references decoded."""
    raw = F.regexp_extract(entry, rf"(?is)<(?:{names})(?:\s[^>]*)?>(.*?)</(?:{names})\s*>", 1)
    inner = F.regexp_extract(raw, r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", 1)
    return F.when(inner != "", inner).otherwise(text.decoded(raw))


def _entries(feeds: DataFrame, body: str, most: int) -> DataFrame:
    """The first entries of each feed: pos, title, url, at, about."""
    found = F.slice(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?is)<(item|entry)(?:\s[^>]*)?>.*?</\1\s*>"), F.lit(0)), 1, most)
    rows = feeds.select("*", F.posexplode(found).alias("_pos", "_entry"))
    e = F.col("_entry")
    href = F.regexp_extract(e, r"""(?is)<link\b(?![^>]*\brel\s*=\s*["']?+(?!alternate))[^>]*\bhref\s*=\s*["']([^"']*)""", 1)
    link = F.coalesce(F.nullif(F.trim(_field(e, "link")), F.lit("")), text.decoded(href))
    at = F.coalesce(*(F.nullif(F.trim(_field(e, n)), F.lit("")) for n in ("pubDate|published|dc:date", "updated")))
    about = F.coalesce(F.nullif(_field(e, "summary"), F.lit("")), _field(e, "description"))
    return rows.select(*feeds.columns, F.col("_pos").alias("pos"), _field(e, "title").alias("_title"), link.alias("_url"), at.alias("_at"), about.alias("_about"))


def feed_items(feeds: DataFrame, body: str = "body", most: int = 5) -> DataFrame:
    """Items of the first `most` entries of each landed RSS or Atom feed, those without title or link left out.

    A null or malformed body gives none.
    """
    rows = _entries(feeds, body, most)
    title = text.compact_text(text.decoded(F.col("_title")), 500)
    told = rows.select(*_ABOUT, title.alias("title"), F.col("_url").alias("url"), text.parse_time(F.col("_at")).alias("published_at"), F.substring(text.page_text(F.col("_about")), 1, 1000).alias("snippet"))
    return told.filter("title <> '' AND url <> ''")


def page_items(pages: DataFrame, url: str = "url", html: str = "html", most: int = 5, article: str = links.ARTICLE, skip: str = links.SKIP, least: int = 18, alone: int = 42) -> DataFrame:
    """Items from the links of each landed page: the first `most` that look like articles of its own host.

    A link's text must have `least` characters, or `alone` where the path does not speak for an article. Links of one
    canonical address count once. A null page gives none.
    """
    anchor = r"""(?is)<a\s(?:[^>]*\s)?href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)[^>]*>.*?</a\s*>"""
    page = F.xxhash64(F.col("source"), F.col(url))
    rows = pages.select(*_ABOUT, F.col(url).alias("_base"), page.alias("_page"), F.posexplode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(anchor), F.lit(0))).alias("pos", "_a"))
    href = F.regexp_extract("_a", r"""(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*["']?([^"'>\s]*)""", 1)
    rows = rows.withColumns({"title": F.substring(text.page_text(F.col("_a")), 1, 500), "url": text.absolute_url(F.col("_base"), text.decoded(href))})
    place = lambda c, i: F.regexp_extract(c, r"^(https?)://([^/?#]*)([^?#]*)", i)
    path, there = place(F.col("url"), 3), place(F.col("url"), 2)
    fit = (F.length("title") >= least) & (there != "") & (there == place(F.col("_base"), 2)) & ~path.rlike(skip) & (path.rlike(article) | (F.length("title") >= alone))
    rows = rows.filter(fit).withColumn("_canonical", text.canonical_url(F.col("url")))
    once = tables.first_wins(rows.repartition("_page"), ("_page", "_canonical"), F.asc("pos"))
    kept = tables.top_of_each(once, "_page", most, F.asc("pos"))
    return kept.select(*_ABOUT, "title", "url", F.lit(None).cast("timestamp").alias("published_at"), F.lit("").alias("snippet"))


def search_items(answers: DataFrame, *order: Column) -> DataFrame:
    """Items of landed news searches (title, url, domain, sourcecountry, language, seendate): of one canonical address the first in the order."""
    at = F.coalesce(text.parse_time(F.col("seendate")), F.try_to_timestamp(F.col("seendate").cast("string"), F.lit("yyyyMMdd'T'HHmmss'Z'")))
    named = answers.withColumns({"title": text.compact_text(F.col("title"), 500), "_canonical": text.canonical_url(F.col("url"))}).filter("title <> '' AND url <> ''")
    return tables.first_wins(named, "_canonical", *order).select(
        F.coalesce(F.nullif("domain", F.lit("")), F.lit("search")).alias("source"), F.lit("news").alias("source_kind"), F.col("sourcecountry").alias("country"), "language", "title", "url", at.alias("published_at"), F.lit("").alias("snippet")
    )


def collect_news(sources: DataFrame, feeds: DataFrame, pages: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of sources (source, mode, feed, robots).

    A source that is not disabled gives what its landed feed holds if it names a feed or its mode is auto or feed, else
    its landed page; one with neither is an error. robots = false: nothing is read, and that is no error.
    """
    mode = F.coalesce("mode", F.lit("auto"))
    live = sources.filter(mode != "disabled").select("source", ((F.coalesce("feed", F.lit("")) != "") | mode.isin("auto", "feed")).alias("_feed"), F.coalesce("robots", F.lit(True)).alias("_open"))
    fed = feeds.join(live.filter("_feed").select("source").distinct(), "source", "left_semi").select(*feeds.columns)
    rest = live.join(fed.select("source").distinct(), "source", "left_anti")
    seen = pages.join(rest.select("source").distinct(), "source", "left_semi").select(*pages.columns)
    items = feed_items(fed, most=most).unionByName(page_items(seen, most=most)).join(live.filter("_open").select("source").distinct(), "source", "left_semi")
    missed = rest.filter("_open").join(seen.select("source").distinct(), "source", "left_anti")
    return items, missed.select("source", F.lit("nothing landed").alias("error"))


def robots_allowed(addresses: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """Addresses with `allowed`: what the landed robots.txt of their root (root, status, body) says to an agent.

    True where none landed, its status is 400 or more, or it cannot be read.
    """

    @F.pandas_udf("boolean")
    def may(body: pd.Series, where: pd.Series) -> pd.Series:
        known: dict[str, RobotFileParser] = {}

        def ask(said: str | None, at: str | None) -> bool:
            if said is None or at is None:
                return True
            if said not in known:
                known[said] = RobotFileParser()
                known[said].parse(said.splitlines())
            return known[said].can_fetch(agent, at)

        return pd.Series([ask(b, u) for b, u in zip(body, where)])

    root = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))
    known = tables.first_wins(robots.filter("status < 400").select(F.lower("root").alias("_root"), F.col("body").alias("_body")), "_root", F.asc("_body"))
    joined = addresses.withColumn("_root", root).join(known, "_root", "left")
    return joined.withColumn("allowed", may("_body", url)).drop("_root", "_body")


def search_queries(queries: Iterable[str], manual: str = "", most: int = 12) -> list[str]:
    """The queries of one run: the manual one first, each once, `most` at most."""
    told = [q.strip() for q in (manual, *queries) if q and q.strip()]
    return list(dict.fromkeys(told))[:most]


def post_query(query: str, size: int) -> tuple[str, int]:
    """A post search without reposts, and the page size that its endpoint takes."""
    return query if "-is:retweet" in query else f"({query}) -is:retweet", max(10, min(100, size))


def _sid(platform: Column, key: Column) -> Column:
    return text.record_id(F.concat(platform, F.lit(":"), key))


def posts_with_users(posts: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Signals of landed posts (id, author_id, text, created_at, query, engagement, media_count) and their users (id, username, name, verified).

    Posts without an id go; of several rows of a user the largest username counts; unknown users keep their id as name.
    """
    known = tables.first_wins(users, "id", F.desc("username")).select(F.col("id").alias("author_id"), F.col("username").alias("_user"), F.col("name").alias("_name"), F.col("verified").alias("_sure"))
    held = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    rows = posts.filter(held("id").isNotNull()).join(known, "author_id", "left")
    author, key = F.coalesce(held("_user"), held("author_id"), F.lit("unknown")), F.col("id").cast("string")
    return rows.select(
        _sid(F.lit("x"), key).alias("id"), F.lit("x").alias("platform"), author.alias("author"), F.coalesce(held("_name"), author).alias("author_name"), F.coalesce("_sure", F.lit(False)).alias("verified"),
        F.coalesce(text.compact_text(text.decoded(F.col("text")), 1600), F.lit("")).alias("text"), F.concat(F.lit("https://x.com/"), author, F.lit("/status/"), key).alias("url"), F.col("created_at").alias("published_at"), now.alias("collected_at"), "query", "engagement",
        F.coalesce("media_count", F.lit(0)).alias("media_count"), F.lit("x_api_v2").alias("collector"),
    )


def channel_messages(messages: DataFrame, now: Column, hours: int = 36, most: int = 80) -> DataFrame:
    """Signals of landed channel messages (channel, msg_id, text, date, views, forwards, media): of each channel the newest `most` of the last hours.

    Messages without a date stay and count as the oldest; those without text go after the cut.
    """
    channel = F.regexp_replace(F.trim("channel"), "^@+", "")
    rows = messages.withColumn("channel", channel).filter((channel != "") & (F.col("date").isNull() | (F.col("date") >= now - F.expr(f"INTERVAL {hours} HOURS"))))
    rows = tables.top_of_each(rows, "channel", most, F.desc_nulls_last("date"), F.desc("msg_id"))
    body = F.coalesce(text.compact_text(text.decoded(F.col("text")), 1600), F.lit(""))
    count = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0))
    return rows.select(
        _sid(F.lit("telegram"), F.concat("channel", F.lit(":"), F.col("msg_id").cast("string"))).alias("id"), F.lit("telegram").alias("platform"), F.col("channel").alias("author"), body.alias("text"),
        F.concat(F.lit("https://t.me/"), "channel", F.lit("/"), F.col("msg_id").cast("string")).alias("url"), F.col("date").alias("published_at"), now.alias("collected_at"), F.concat(F.lit("channel:"), "channel").alias("query"),
        F.create_map(F.lit("views"), count("views"), F.lit("forwards"), count("forwards")).alias("engagement"), F.when(F.col("media"), 1).otherwise(0).alias("media_count"), F.lit("telethon").alias("collector"),
    ).filter("text <> ''")


def bridge_posts(feeds: DataFrame, now: Column, body: str = "body", most: int = 30) -> tuple[DataFrame, DataFrame]:
    """(signals, status) of landed bridge feeds (platform, name, body): entries with any text; a status row a feed, error where nothing landed."""
    platform = F.coalesce(F.nullif(F.lower(F.trim("platform")), F.lit("")), F.lit("social-rss"))
    named = feeds.withColumn("platform", platform).withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.col("platform")))
    rows = _entries(named, body, most)
    clean = lambda c: F.coalesce(text.compact_text(text.decoded(F.col(c)), 1600), F.lit(""))
    said = F.trim(F.concat_ws(" ", clean("_title"), clean("_about")))
    key = F.coalesce(F.nullif("_url", F.lit("")), F.concat("name", F.lit(":"), clean("_title")))
    signals = rows.select(
        _sid(F.col("platform"), key).alias("id"), "platform", F.col("name").alias("author"), F.substring(said, 1, 1600).alias("text"), F.coalesce("_url", F.lit("")).alias("url"), text.parse_time(F.col("_at")).alias("published_at"), now.alias("collected_at"),
        F.concat(F.lit("rss:"), "name").alias("query"), F.lit(0).alias("media_count"), F.lit("rss_bridge").alias("collector"),
    ).filter("text <> ''")
    counts = signals.groupBy("platform", F.col("author").alias("name")).agg(F.count("*").alias("items"))
    feeds_ = named.groupBy("platform", "name").agg(F.bool_or(F.col(body).isNotNull()).alias("_landed")).join(counts, ["platform", "name"], "left")
    return signals, feeds_.select("platform", F.col("name").alias("source"), F.when(F.col("_landed"), "ok").otherwise("error").alias("status"), F.coalesce("items", F.lit(0)).cast("bigint").alias("items"))


def collect_posts(*parts: DataFrame, order: str = "url") -> DataFrame:
    """Signals of several connectors, one an id: the last connector wins, in it the last by `order`. Rows without an id are named by platform and address or text."""
    whole = None
    for turn, part in enumerate(parts):
        part = part.withColumn("_turn", F.lit(turn))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    key = F.coalesce(F.nullif("id", F.lit("")), _sid(F.coalesce("platform", F.lit("social")), F.coalesce(F.nullif("url", F.lit("")), "text", F.lit(""))))
    last = tables.first_wins(whole.withColumn("_key", key), "_key", F.desc("_turn"), F.desc(order))
    return last.drop("_turn", "_key")
