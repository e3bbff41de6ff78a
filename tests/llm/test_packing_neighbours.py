from tidemark.llm import packing


def test_neighbours_share_a_shard(spark):
    """Forty subjects of a vocabulary each, over about ten shards: sequences hold neighbours, not a random mixture."""
    letters = "".join(chr(0x4E00 + 37 * k) for k in range(400))  # each subject has ten of its own
    words = lambda s, i: " ".join(letters[10 * s + (i + k * (1 + i % 3)) % 10] for k in range(60))
    rows = [(40 * i + s, words(s, i)) for i in range(20) for s in range(40)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), shard_tokens=20_000, least_df=10).collect()
    assert len({r["sequence_id"] >> 32 for r in pieces}) > 4
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r["sequence_id"], []).append((r["doc_id"] % 40, r["length"]))
    same = sum(max(sum(n for t, n in ps if t == s) for s in {t for t, _ in ps}) for ps in by_sequence.values())
    assert same > 0.6 * sum(r["length"] for r in pieces)
    assert sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())
