from pyspark.sql import functions as F

from tidemark.llm import mixing


def test_sample_meets_the_real_targets(spark):
    """Targets above what the cells hold included: src0 has 0.23 to meet from 0.05 of the tokens."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    told = mixing.calibrate(docs).select("m_source", "m_lang", "m_topic", "m_tokens", "m_weight", "m_copies").toPandas()
    copied = told["m_tokens"] * told["m_copies"]
    for d, targets in mixing.TARGETS.items():
        there = {v: targets[v] for v in set(told[f"m_{d}"])}
        for value, share in there.items():
            got = copied[told[f"m_{d}"] == value].sum() / copied.sum()
            assert abs(got - share / sum(there.values())) < 0.012, (d, value, got)
    assert abs(copied.sum() / told["m_tokens"].sum() - 0.6) < 0.02
    n = mixing.sample(docs).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    assert n["n"] == told["m_copies"].sum() and n["d"] == (told["m_copies"] > 0).sum()
