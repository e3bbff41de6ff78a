"""Landed feeds, pages and posts, decisions, records, translations and whole runs on small fixtures."""

from datetime import datetime, timedelta
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import bilingual, events, intake
from tidemark.sources import config, feeds

NOW = datetime(2026, 8, 19, 8)
RSS = """<?xml version="1.0"?><rss><channel><title>All</title><item><title>One &amp;amp; two</title><link> https://a.org/1 </link><description>&lt;p&gt;Hello &lt;b&gt;you&lt;/b&gt;&lt;/p&gt;</description><pubDate>Tue, 18 Aug 2026 10:00:00 +0200</pubDate></item>
<item><title><![CDATA[Three <4]]></title><link>https://a.org/2</link><description><![CDATA[<p>x</p>]]></description></item><item><title></title><link>https://a.org/3</link></item><item><title>No link</title></item><item><title>Five</title><link>https://a.org/5</link></item><item><title>Six</title><link>https://a.org/6</link></item></channel></rss>"""
ATOM = """<feed><entry><title type="html">Atom</title><link rel="self" href="https://b.org/self"/><link rel="alternate" href="https://b.org/a?x=1&amp;y=2"/><summary>S</summary><updated>2026-08-18T01:00:00Z</updated></entry></feed>"""
PAGE = """<a href="/news/one">A headline of more than eighteen</a> <a href="/news/one?utm_source=x#top">The same article once again here</a> <a class="c" href='../story/2'>Second &amp; also long enough</a>
<a href="/about/">About this site and all the people who make it every day</a> <a href="https://other.org/news/1">A headline on another host</a> <a href="/x">Short</a> <a href="//h.org/y">A title long enough that no hint in the path is needed at all</a>
<a href="/z">A title without any hint</a> <a href="mailto:x@h.org">Write to the editors of this page today</a> <a href="/news/3"><b>Third</b> headline is <i>nested</i></a> <a href="/news/4">Fourth headline of this page</a> <a href="/news/5">Fifth headline of this page</a> <a href="/news/6">Sixth headline of this page</a>"""
ABOUT = "source string, source_kind string, country string, language string"


def test_feed_items(spark):
    rows = spark.createDataFrame([("a", "news", "X", "en", RSS), ("b", "official", None, None, ATOM), ("c", "news", None, None, None), ("d", "news", None, None, "<rss><item>broken")], ABOUT + ", body string")
    got = {r.url: r for r in feeds.feed_items(rows).collect()}
    assert set(got) == {"https://a.org/1", "https://a.org/2", "https://a.org/5", "https://b.org/a?x=1&y=2"}  # six is beyond the first five entries
    assert got["https://a.org/1"].title == "One & two" and got["https://a.org/1"].snippet == "Hello you" and got["https://a.org/1"].published_at == datetime(2026, 8, 18, 8)
    assert got["https://a.org/2"].title == "Three <4" and got["https://a.org/2"].snippet == "x" and got["https://b.org/a?x=1&y=2"].source_kind == "official"


def test_page_items(spark):
    rows = spark.createDataFrame([("h", "news", None, "en", "https://h.org/front/index.html", PAGE), ("n", "news", None, None, "https://n.org/", None)], ABOUT + ", url string, html string")
    got = [(r.url, r.title) for r in feeds.page_items(rows).collect()]
    assert sorted(got) == sorted([
        ("https://h.org/news/one", "A headline of more than eighteen"), ("https://h.org/story/2", "Second & also long enough"), ("https://h.org/y", "A title long enough that no hint in the path is needed at all"),
        ("https://h.org/news/3", "Third headline is nested"), ("https://h.org/news/4", "Fourth headline of this page"),
    ])


@pytest.mark.parametrize("href", ["/a/b", "a", "./a", "../a", "../../../a", "a/./b/../c", "?q=1", "#f", "", "//h.net/p", "http://o.org/x", "mailto:a@b.c", "..", "a/..", "x.y/z?u=../v"])
@pytest.mark.parametrize("base", ["https://h.org/one/two/three.html?k=v", "https://h.org/d/"])
def test_absolute_url(spark, base, href):
    got = spark.createDataFrame([(base, href)], "b string, h string").select(text.absolute_url(F.col("b"), F.col("h"))).head()[0]
    assert got == urljoin(base, href)


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.open = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href"):
            self.open = [dict(attrs)["href"], ""]

    def handle_data(self, data):
        if self.open:
            self.open[1] += " " + data

    def handle_endtag(self, tag):
        if tag == "a" and self.open:
            self.found.append((self.open[0], " ".join(self.open[1].split())))
            self.open = None


def test_page_links_of_the_table_against_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    told = pages.select(F.col("page_id").cast("string").alias("source"), *(F.lit(None).cast("string").alias(c) for c in ("source_kind", "country", "language")), F.col("url"), F.regexp_replace("html", "(?s)<a (href=\"[^\"]*\")>([^<]*)</a>", '<a $1>$2 and all the rest of a headline that is long enough</a>').alias("html"))
    want = set()
    for row in told.collect():
        parser = _Anchors()
        parser.feed(row.html)
        urls = [(row.source, urljoin(row.url, h), t) for h, t in parser.found]
        seen, kept = set(), []
        for u in urls:
            key = u[1].rstrip("/")
            if key not in seen:
                seen.add(key)
                kept.append(u)
        want |= set(kept[:5])
    assert want and {(r.source, r.url, r.title) for r in feeds.page_items(told).collect()} == want


def test_fallback_chain_and_errors(spark):
    sources = spark.createDataFrame([("a", None, "f", None), ("h", "listing", None, None), ("off", "disabled", "f", None), ("gone", None, None, None), ("shut", None, "f", False)], "source string, mode string, feed string, robots boolean")
    landed = spark.createDataFrame([(s, "news", None, None, ATOM) for s in ("a", "h", "off", "shut")], ABOUT + ", body string")
    pages = spark.createDataFrame([(s, "news", None, None, "https://h.org/", PAGE) for s in ("a", "h", "off")], ABOUT + ", url string, html string")
    items, errors = feeds.collect_news(sources, landed, pages)
    assert {(r.source, r.n) for r in items.groupBy("source").agg(F.count("*").alias("n")).collect()} == {("a", 1), ("h", 5)}
    assert [r.source for r in errors.collect()] == ["gone"]


def test_robots(spark):
    said = spark.createDataFrame([("https://a.org", 200, "User-agent: *\nDisallow: /x"), ("https://b.org", 404, "User-agent: *\nDisallow: /")], "root string, status int, body string")
    urls = spark.createDataFrame([("https://a.org/x/1",), ("https://a.org/y",), ("https://b.org/z",), ("https://c.org/",), (None,)], "url string")
    assert {r.url: r.allowed for r in feeds.robots_allowed(urls, said, "bot").collect()} == {"https://a.org/x/1": False, "https://a.org/y": True, "https://b.org/z": True, "https://c.org/": True, None: True}


def test_bridge_posts_and_queries(spark):
    rows = spark.createDataFrame([("Weibo ", "n", RSS), (None, None, ATOM), ("x", "late", None)], "platform string, name string, body string")
    posts, status = feeds.bridge_posts(rows, F.lit(NOW))
    assert {(r.platform, r.source, r.status, r.items) for r in status.collect()} == {("weibo", "n", "ok", 5), ("social-rss", "social-rss", "ok", 1), ("x", "late", "error", 0)}
    assert posts.filter("text LIKE 'One%'").head().text.startswith("One & two")
    assert feeds.search_queries([" a ", "b", "a", ""], "m", 2) == ["m", "a"] and feeds.post_query("q", 500) == ("(q) -is:retweet", 100)


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"generator": {"taxonomy": {"s": {"g": ["A", {"term": " b "}, "a", null], "h": 3}}}}')
    told = config.load_config(spark, str(tmp_path / "c.json"))
    assert config.taxonomy_terms(told, "s") == ["A", "b"] and config.taxonomy_terms({}, "s") == [] and config.load_config(spark, str(tmp_path / "none.json")) == {}
    assert config.with_geo_aliases({"P": {"aliases": ["a"]}, "Q": {}}, {"P": ["a", "b"], "R": ["c"]}) == {"P": {"aliases": ["a", "b"]}, "Q": {"aliases": []}}
    assert config.profile_aliases("P", {"aliases": [1]}) == ["P", "1"]


ITEMS = [
    ("EU announces new restrictions on Chinese chip firms", "European Union", "direct"), ("Hungary's new government vows to restore relations with Brussels after election", "Hungary", "potential"),
    ("Hungary wins dramatic football match in extra time", "Hungary", None), ("Budapest reviews subsidies for CATL Debrecen battery plant", "Hungary", "direct"),
]
RULES = intake.Rules(
    profiles={"Hungary": {"aliases": ["Hungary", "Hungarian", "Budapest"], "entities": ["BYD Szeged", "CATL Debrecen"]}}, anchors=["chinese workers"], happenings=["attacked"], noise=["recipe"],
    events=events.Config(tiers=[(1, "official")]),
)


def _items(spark, rows=ITEMS):
    told = [(str(i), t, None, "S", "news", c, "en", NOW - timedelta(hours=2), f"https://x.org/{i}") for i, (t, c, _) in enumerate(rows)]
    return spark.createDataFrame(told, "id string, title string, snippet string, source string, source_kind string, country string, language string, published_at timestamp, url string")


def test_classify_on_the_survey_goldens(spark):
    got = {r.title: r.decision.relation for r in intake.classify(_items(spark), RULES).collect()}
    assert got == {t: want for t, _, want in ITEMS if want}


def test_answers_come_first_and_failures_fall_back(spark):
    asked = []

    def ask(batch):
        if batch[0]["title"].startswith("Hungary's"):
            return '```json\n[{"id": "1", "relation": "indirect", "confidence": "x", "entities": ["a  b"]}, {"id": "99"}]\n```'
        raise OSError

    assert not asked
    got = {r.id: r.decision for r in intake.classify(_items(spark), RULES, intake.batched_answers(ask, 1)).collect()}
    assert set(got) == {"0", "1", "3"} and got["1"].relation == "indirect" and got["1"].confidence == 70 and got["1"].entities == ["a b"] and got["0"].classifier == "rules"
    failing = {r.id: r.decision.relation for r in intake.classify(_items(spark), RULES, intake.batched_answers(lambda b: 1 / 0)).collect()}
    assert failing == {"0": "direct", "1": "potential", "3": "direct"}


POSTS = "id string, platform string, author string, text string, url string, published_at timestamp, query string, engagement map<string,bigint>, media_count int, collector string, country string, confidence int, verified boolean"


def _posts(spark, *rows):
    return spark.createDataFrame([(i, "weibo", None, t, None, at, "q", None, 0, c, None, None, None) for i, t, at, c in rows], POSTS)


def test_runs_of_the_whole_engine(spark):
    at = NOW - timedelta(hours=1)
    none = F.lit(False)
    articles = intake.article_records(intake.classify(_items(spark), RULES), F.lit(NOW)).filter(none)
    posts = _posts(spark, ("1", "Chinese workers attacked in the port", at, "c"), (None, "  ", at, "c"), ("2", "A recipe", at, "c"))
    signals = intake.signal_records(intake.judged_posts(intake.post_items(posts), RULES), F.lit(NOW)).filter(none)
    outside = _posts(spark, ("3", "chinese workers were attacked at night", at, "MediaCrawler-external"))
    first = intake.run("all", F.lit(NOW), articles, signals, None, RULES, _items(spark), posts, outside)
    n = {r.counter: r.n for r in first.counters.collect()}
    assert n["items_new"] == 4 and n["items_relevant"] == n["stored_articles"] == 3 and n["signals_seen"] == 4 and n["signals_relevant"] == n["stored_signals"] == 2
    assert n["social_review_total"] == n["social_review_accepted"] == 1 and n["events"] >= 3
    again = intake.run("news", F.lit(NOW), first.articles, first.signals, first.events, RULES, _items(spark))
    m = {r.counter: r.n for r in again.counters.collect()}
    # The unrelated article was not stored, so it is new again.
    assert m["items_new"] == 1 and m["stored_articles"] == 3 and m["stored_signals"] == 2 and again.review is None
    assert {r.id for r in again.events.collect()} == {r.id for r in first.events.collect()}
    later = intake.run("rebuild", F.lit(NOW + timedelta(days=15)), first.articles, first.signals, None, RULES)
    assert later.events.count() == 0
    with pytest.raises(ValueError):
        intake.run("other", F.lit(NOW), articles, signals, None, RULES)


def test_bilingual(spark):
    rows = spark.createDataFrame(
        [("a", "港口关闭", "原因", None, 3), ("b", "Port closed", "r", "en", 2), ("c", " ", None, "en", 1), ("d", "Beyond", "r", "en", 0)], "id string, title string, reason string, language string, p int"
    ).withColumns({"relation": F.lit("direct"), "countries": F.array(F.lit("Chile")), "entities": F.array().cast("array<string>")})
    cache = spark.createDataFrame([("x", "y")], "cache_key string, value string").unionByName(spark.range(1).select(text.cache_key(F.lit("港口关闭"), F.lit("en")).alias("cache_key"), F.lit("The port is closed").alias("value")))
    order = [F.desc("p"), F.asc("id")]
    translate = lambda jobs: jobs.filter("target = 'zh-CN'").select("cache_key", F.concat(F.lit("译"), "text").alias("value"))
    out, new, counts = bilingual.enrich(rows, cache, order, translate, titles=3, reasons=1)
    got = {r.id: r for r in out.collect()}
    assert got["a"].title_en == "The port is closed" and got["a"].title_zh == "港口关闭" and got["a"].reason_en.startswith("Direct")  # the reason's translation failed
    assert got["b"].title_zh == "译Port closed" and got["b"].title_en == "Port closed" and got["c"].title_zh == "" and got["d"].title_zh is None
    assert counts.head().asDict() == {"jobs": 3, "cache_hits": 1, "translated": 1, "failed": 1} and new.count() == 3
    plain, same, told = bilingual.enrich(rows, cache, order, None, titles=3, reasons=1)
    assert {r.id: r.title_zh for r in plain.collect()}["b"] == "Port closed" and same is cache and told.head().failed == 0
