"""Landed files: loose rows in, normalized signals and truncated site tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: The aliases of each field, in the order of preference.
ALIASES = {
    "title": "title note_title video_title".split(),
    "description": "desc content text note_desc aweme_desc description".split(),
    "author": "nickname user_nickname author_name screen_name user_name author".split(),
    "raw_id": "note_id aweme_id id mblogid content_id video_id".split(),
    "url": "note_url aweme_url video_url url content_url".split(),
    "published_at": "time create_time created_at publish_time note_time last_modify_ts".split(),
    "likes": "liked_count like_count attitudes_count digg_count".split(),
    "comments": "comment_count comments_count".split(),
    "shares": "share_count reposts_count".split(),
    "media": "image_list images video_cover video_url".split(),
    "query": "source_keyword keyword search_keyword query".split(),
}

#: Addresses of a platform's posts, by their id.
ADDRESSES = {"xiaohongshu": "https://www.xiaohongshu.com/explore/", "douyin": "https://www.douyin.com/video/", "weibo": "https://weibo.com/detail/"}


def read_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of whole-file JSON arrays. A file that is no array of objects counts as an empty one."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return raw.select(F.explode(F.from_json("value", f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})).alias("r")).select("r.*").dropna("all")


def content_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of landed content files: json, jsonl, csv or xlsx, none of comments, creators or word clouds.

    A name tells content by content, aweme, note or search in it, or lies in a folder called json, jsonl or csv.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    name, parent = F.lower(F.regexp_extract("path", "([^/]+)$", 1)), F.lower(F.regexp_extract("path", "([^/]+)/[^/]+$", 1))
    kept = name.rlike(r"\.(json|jsonl|csv|xlsx)$") & ~name.rlike("comment|creator|wordcloud") & (name.rlike("content|aweme|note|search") | parent.isin("json", "jsonl", "csv"))
    return files.filter(kept)


def row_counts(df: DataFrame) -> DataFrame:
    """Rows of each file that a frame was read from."""
    return df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))


def feed_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(url, feed): the first feed that a landed page names in a link element, in absolute form where it starts with a slash."""
    links = F.regexp_extract_all(html_col, F.lit("(?is)<link\\b[^>]*>"), F.lit(0))
    value = lambda x, n: F.regexp_extract(x, f"(?is)\\b{n}\\s*=\\s*[\"']?([^\"'>]*)", 1)
    feeds = F.filter(links, lambda x: F.lower(value(x, "rel")).contains("alternate") & F.lower(value(x, "type")).rlike("rss|atom|xml") & (value(x, "href") != ""))
    href = value(F.try_element_at(feeds, F.lit(1)), "href")
    root = F.regexp_extract(url_col, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return pages.select(F.col(url_col).alias("url"), F.when(href.startswith("/"), F.concat(root, href)).otherwise(href).alias("feed")).filter("feed <> ''")


def external_rows(rows: DataFrame) -> DataFrame:
    """Landed signals that have a text and a platform."""
    return rows.filter((F.coalesce("text", F.lit("")) != "") & (F.coalesce("platform", F.lit("")) != ""))


def read_rows(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """Rows of json (arrays), jsonl or csv files; malformed rows are dropped. With a schema the files are read once."""
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return reader.option("multiLine", kind == "json").option("mode", "DROPMALFORMED").json(path)


def normalize(rows: DataFrame, platform: str) -> DataFrame:
    """Signals from loose rows: for each field the first alias that is there and not empty."""

    def pick(name: str) -> Column:
        there = [F.col(c) for c in ALIASES[name] if c in rows.columns]
        return text.first_of(*there) if there else F.lit(None).cast("string")

    title, about = F.coalesce(pick("title"), F.lit("")), F.coalesce(pick("description"), F.lit(""))
    body = text.compact_text(F.concat(title, F.lit(" "), about), 1 << 30)
    raw = F.coalesce(pick("raw_id"), text.record_id(body))
    address = F.concat(F.lit(ADDRESSES[platform]), raw) if platform in ADDRESSES else F.lit("")
    kinds = {f.name: f.dataType.typeName() for f in rows.schema.fields}
    media = F.lit(0)
    for name in reversed([c for c in ALIASES["media"] if c in rows.columns]):
        there = text.first_of(F.col(name)).isNotNull()
        media = F.when(there, F.size(name) if kinds[name] == "array" else F.lit(1)).otherwise(media)
    counts = {f"{n}_count": text.to_int(pick(k)) for n, k in (("like", "likes"), ("comment", "comments"), ("share", "shares"))}
    told = rows.select(
        text.record_id(F.concat(F.lit(platform + ":"), raw)).alias("id"), F.lit(platform).alias("platform"), F.coalesce(pick("author"), F.lit("unknown")).alias("author"), F.substring(body, 1, 1800).alias("text"), F.coalesce(pick("url"), address).alias("url"),
        text.iso_time(pick("published_at")).alias("published_at"), F.coalesce(pick("query"), F.lit("mediacrawler-search")).alias("query"),
        F.create_map(*(x for k, c in counts.items() for x in (F.lit(k), c))).alias("engagement"), media.alias("media_count"), F.lit("MediaCrawler-external").alias("collector"),
    )
    return told.filter("text <> ''")


def write_newest(df: DataFrame, path: str, at: str, most: int) -> None:
    """The newest rows as JSON; lists stay lists."""
    df.orderBy(F.desc(at)).limit(most).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with lists joined by a comma."""
    flat = [F.array_join(F.col(f.name), ", ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
