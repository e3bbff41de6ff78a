import pytest

from tidemark.llm import ngram_join


@pytest.mark.parametrize("block", [40, 192])
def test_links_in_a_group_above_pairwise(spark, block):
    """125 distinct near-copies of one text, with one, two or four words changed: links against brute force."""
    changed = [1] * 90 + [2] * 20 + [4] * 15
    texts = {}
    for i, k in enumerate(changed):
        words = [f"w{p}" for p in range(200)]
        for c in range(k):
            words[(7 * i + 47 * c) % 190 + 5] = f"x{i}y{c}"
        texts[i] = " ".join(words)
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    near = lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
    want = {i: sum(i != j and near(i, j) for j in texts) for i in texts}
    assert max(want.values()) > 100 and len(set(want.values())) > 5
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.near_duplicates(df, block=block).collect()}
    assert got == want
