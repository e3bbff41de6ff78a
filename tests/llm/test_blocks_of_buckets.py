from tidemark.llm import ngram_join


def test_large_buckets_that_span_components(spark):
    """One row a band and no small buckets: members of different components are compared in blocks."""
    common = [f"w{i}" for i in range(60)]
    texts = {10 * f + v: " ".join(common + [f"f{f}x{i}" for i in range(60)] + [f"v{v}"]) for f in range(4) for v in range(4)}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    near = lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
    want = {i: min(j for j in texts if near(i, j)) for i in texts}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in ngram_join.near_duplicates(df, rows=1, pairwise=1, block=3).collect()}
    assert got == want and len(set(got.values())) == 4
