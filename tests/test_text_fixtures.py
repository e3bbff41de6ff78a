"""Text functions on inputs whose results are written out."""

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import keywords


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(function(F.col("s")).alias("v")).first().v


def test_white_space_of_any_script(spark):
    assert one(spark, "　a \xa0\n b ", text.compact_text) == "a b"
    assert one(spark, "  a　\x1cb ", keywords.clean) == "a b"
    assert one(spark, "see https://t.co/x　中国工人遇袭", text.normalize_text) == "see 中国工人遇袭"
    assert one(spark, "HTTP://a.b/c DEF　ghi", text.normalize_text) == "def ghi"


def test_keywords(spark):
    assert one(spark, "A,\tB\n, a ,B", text.split_keywords) == ["A", "B"]
    assert one(spark, "x  y,,　X Y , z,\xa0", text.split_keywords) == ["x  y", "z"]
    assert one(spark, ["\tChina", "china ", "", None, "　PLA"], lambda c: text.merge_terms(c, F.array(F.lit("pla"), F.lit("ÉA"), F.lit("éa"))), "array<string>") == ["China", "PLA", "ÉA"]
    long = ",".join(f"w{i % 5000}" for i in range(20000))
    assert len(one(spark, long, text.split_keywords)) == 5000


def test_matched_terms(spark):
    assert one(spark, "urban PLA", lambda c: text.matched_terms(c, ["", " ", "PLA", "ban", "ban", " Urban "])) == ["PLA", "ban", " Urban "]
    assert one(spark, None, lambda c: text.matched_terms(c, ["a", ""])) == []


def test_addresses(spark):
    for said, want in {"//Host.org/a//b/": "https://host.org/a/b", "　HTTP://A.b/?utm_source=x&q=1#z": "http://a.b/?q=1", "no address": "no address"}.items():
        assert one(spark, said, text.canonical_url) == want


def test_helpers(spark):
    log = "Traceback\r\nValueError: first\n  RuntimeError: told \nlast words\n\n"
    assert one(spark, log, text.exception_line) == "RuntimeError: told" and one(spark, "a\n b \n", text.exception_line) == "b" and one(spark, None, text.exception_line) == ""
    assert [tuple(r) for r in one(spark, "x ```json\n[{\"id\": \"1\", \"n\": 2}]\n``` y", lambda c: text.json_array(c, "array<struct<id:string,n:int>>"))] == [("1", 2)]
    assert one(spark, "no array", lambda c: text.json_array(c, "array<struct<id:string>>")) is None
