import difflib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules, scores, text
from tidemark.operators import similarity
from tidemark.plans import catalog
from tidemark.sources import files
from tidemark.streaming import feeds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, want", [("1700000000", "2023-11-14 22:13:20"), ("1700000000000", "2023-11-14 22:13:20"), ("2024-01-02T03:04:05", "2024-01-02 03:04:05"), ("soon", None), (None, None)])
def test_times(spark, given, want):
    assert one(spark, text.iso_time(F.lit(given)).cast("string")) == want


def test_text(spark):
    assert one(spark, text.split_keywords(F.lit(" A ,B,A,, C "))) == ["A", "B", "C"]
    assert one(spark, text.normalize_text(F.lit("See https://x.y/z  A+B 中国!"))) == "see a b 中国"
    assert one(spark, text.cjk_tokens(F.lit("中 中国 中国工人被围"))) == ["中国", "国工", "工人", "人被", "被围", "中国工", "国工人", "工人被", "人被围"]
    assert one(spark, text.to_int(F.lit("1,234 likes"))) == 1234 and one(spark, text.to_int(F.lit("none"))) == 0
    assert one(spark, text.first_of(F.lit(None), F.lit(""), F.lit("b"))) == "b"


def test_scores(spark):
    assert one(spark, scores.relation_score(F.lit("potential"), F.lit(50))) == 54
    assert one(spark, scores.relation_name_score(F.lit("potential"))) == 58
    no = F.lit(False)
    assert one(spark, scores.momentum(no, F.lit(3), F.lit(0), F.lit(0), no, no, no, F.lit(True))) == 12
    assert one(spark, scores.momentum(F.lit(True), F.lit(2), F.lit(0), F.lit(0), no, no, F.lit(True), no)) == 73
    assert one(spark, scores.engagement(F.create_map(F.lit("like_count"), F.lit(99), F.lit("view_count"), F.lit(10**9)))) == 6
    assert one(spark, rules.lifecycle(no, no, F.lit(90), F.lit(30), no, no, F.lit(0), F.lit("escalating"), F.lit(2))) == "escalating"
    assert one(spark, rules.lifecycle(F.lit(True), no, F.lit(90), F.lit(30), no, no, F.lit(0), F.lit("x"), F.lit(2))) == "resolved"


def test_clusters_against_a_plain_loop(spark):
    rows = duckdb.sql("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()
    rows = [(i, t) for i, t in rows] + [(1000 + i, t + " more") for i, t in rows[::3]]
    spark.createDataFrame(rows, "page_id bigint, title string").createOrReplaceTempView("titles")
    df = spark.sql("SELECT page_id, title, timestamp'2024-01-20 00:00:00' AS at FROM titles")
    made = similarity.prepared(df, "page_id", "title", "at")
    got = {r["id"]: r["cluster"] for r in similarity.clusters(made).collect()}
    said = {r["id"]: r for r in made.collect()}
    leaders, want = [], {}
    for i in sorted(i for i in said if said[i]["text"]):
        best, score = None, 0.0
        for c in reversed(range(len(leaders))):
            a, b = said[i], said[leaders[c]]
            ta, tb = set(a["tokens"]), set(b["tokens"])
            ratio = difflib.SequenceMatcher(None, a["text"], b["text"]).ratio()
            if not ta or not tb:
                if ratio >= 0.6 and ratio > score:
                    best, score = c, ratio
                continue
            s = 0.45 * len(ta & tb) / len(ta | tb) + 0.35 * len(ta & tb) / min(len(ta), len(tb)) + 0.2 * ratio
            if a["numbers"] and b["numbers"] and not set(a["numbers"]) & set(b["numbers"]):
                s -= 0.1
            if s >= 0.6 and s > score:
                best, score = c, s
        if best is None:
            best = len(leaders)
            leaders.append(i)
        elif said[i]["length"] > 1.25 * said[leaders[best]]["length"]:
            leaders[best] = i
        want[i] = best
    assert got == want and len(set(got.values())) < len(got)


def test_loose_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, [{"note_id": "7", "desc": "hello  there", "liked_count": "1,200", "time": 1700000000000}, {"title": "", "content": "x"}])) + "\nnot json\n")
    got = files.normalize(files.read_rows(spark, str(tmp_path / "a.jsonl"), "jsonl"), "xhs").orderBy("text").collect()
    assert [r["text"] for r in got] == ["hello there", "x"] and got[0]["engagement"]["like_count"] == 1200 and got[0]["author"] == "unknown" and got[1]["url"] == "" and str(got[0]["published_at"]).startswith("2023-11-14")


def test_stream_counts_equal_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{path}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/events.parquet").schema).parquet(str(tmp_path / "in"))
    counts = feeds.tumbling_counts(stream, "ts", "event_type")
    run = counts.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    want = feeds.tumbling_counts(spark.read.parquet(f"{path}/events.parquet"), "ts", "event_type")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))


def test_all_queries_have_sql_or_a_test():
    assert {q.__name__ for q in catalog.QUERIES} - set(catalog.SQL) == {"k5_clusters", "f6_similar_pairs", "a7_page_items"}
