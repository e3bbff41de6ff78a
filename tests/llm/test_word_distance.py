from pyspark.sql import functions as F

from tidemark.llm import quality


def test_labelled_documents(spark):
    """The words of a text decide: bad documents go that the base rules and the character classes keep."""
    path = "/root/testdata/sf0.01"
    told = quality.report(spark.read.parquet(f"{path}/documents.parquet")).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").filter("not base_failed").toPandas()
    good, bad = told[told["quality"] == 1], told[told["quality"] == 0]
    assert good["kept"].mean() > 0.99
    by_word = bad[~(bad["class_distance"] > 0.3) & (bad["word_distance"] > 0)]
    assert len(by_word) > 5 and (~by_word["kept"]).mean() > 0.5


def test_text_without_common_words(spark):
    plain = " ".join(f"the word{i} of and page{i} is in that" for i in range(40))
    bare = " ".join(f"word{chr(97 + i % 26)} page{chr(97 + i // 26)} line tree stone cloud river field" for i in range(40))
    rows = [(0, plain, "en"), (1, bare, "en"), (2, bare, None), (3, bare, "it")] + [(9 + i, plain, "en") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("text", F.translate("text", "0123456789", "abcdefghij"))
    told = {r["doc_id"]: r for r in quality.report(df).collect()}
    facts = [(told[i]["base_failed"], told[i]["kept"], told[i]["word_distance"] is None) for i in range(4)]
    assert [k for _, k, _ in facts] == [True, False, False, True] and not any(f for f, _, _ in facts) and facts[3][2]
    assert {r["doc_id"] for r in quality.passing(df).collect()} == set(told) - {1, 2}
