"""The stages one after another, each against a brute-force version over its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import mixing, packing, quality, secrets
from tidemark.llm.secrets import Scanner, compile_rules, redacted

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The documents of sf0.001 and odd ones: null and empty texts, copies, a very long text, nulls in every column."""
    path = str(tmp_path_factory.mktemp("pipe"))
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.col("lang"), "source", "n_chars")
    long = " ".join(f"the w{i % 977}x{i // 89} of and" for i in range(9000))
    secret = " ".join(f"the word{i} of and" for i in range(30)) + " password=abcdefgh12"
    odd = [(9000, None, "en", "src0", 0), (9001, "", None, None, None), (9002, long, "en", "src1", 1), (9003, long, "en", "src1", 1), (9004, secret, "en", "src0", 1), (9004, secret, "en", "src0", 1), (None, secret, None, None, None)]
    base.union(spark.createDataFrame(odd, SCHEMA)).withColumn("m_copies", F.lit("own")).withColumn("_kept_id", F.lit(1)).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        before, after = docs.collect(), out.collect()
        key = lambda r: tuple(str(x) for x in r)
        if name != "packing":
            assert out.columns == docs.columns
        if name == "quality":
            kept = {(r["doc_id"], r["n_words"]) for r in quality.report(docs).collect() if r["kept"]}
            want = [r for r in before if (r["doc_id"], len(WORD.findall(r["text"] or ""))) in kept]
            assert sorted(map(key, after)) == sorted(map(key, want)) and len(after) > 50
        elif name == "near_duplicates":
            grams = []
            for r in before:
                w = WORD.findall(r["text"])
                grams.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
            root = list(range(len(before)))

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for i in range(len(before)):
                for j in range(i):
                    if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                        root[find(i)] = find(j)
            least = {}
            for i, r in enumerate(before):
                if r["doc_id"] is not None:
                    least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
            assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted(least.values())
            assert sum(r["doc_id"] is None for r in after) == sum(r["doc_id"] is None for r in before)
        elif name == "secrets":
            scanner = Scanner(compile_rules())
            want = [(*r[:1], redacted(r["text"], scanner.spans(r["text"].encode()), scanner.rules), *r[2:]) for r in before]
            assert sorted(map(key, after)) == sorted(map(key, want)) and not any("abcdefgh12" in r["text"] for r in after)
        elif name == "mixing":
            told = mixing.calibrate(docs.drop("m_copies")).collect()
            want = [str(r["doc_id"]) for r in told for _ in range(r["m_copies"])]
            assert sorted(str(r["doc_id"]) for r in after) == sorted(want)
        else:
            encoder = packing.Encoder(None)
            import pyarrow as pa

            sizes = [len(x) + 1 for x in encoder.encode(pa.array([r["text"] for r in before]))]
            assert sum(r["length"] for r in after) == sum(sizes) and {r["doc_tokens"] for r in after} == set(sizes)
        docs = out
    assert sorted(map(str, corpus_pipeline.run(spark, folder).select("doc_id", "doc_tokens").distinct().collect())) == sorted(map(str, docs.select("doc_id", "doc_tokens").distinct().collect()))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
