"""Top-k search where blocks, parts and chunks are small, and the rows that a round keeps."""

import random

from test_topk_edges import plain, table

from tidemark.llm import hamming


def test_small_blocks_and_few_rows_a_query(spark, monkeypatch):
    for name, n in (("_LOW", 3), ("_HOT", 5), ("_CHUNK", 16)):
        monkeypatch.setattr(hamming, name, n, raising=False)
    kept, cut = [], hamming.cut
    monkeypatch.setattr(hamming, "cut", lambda df: [out := cut(df), kept.append((out.columns, out.count()))][0])
    draw = random.Random(1)
    sets = [draw.sample(range(20), 2) for _ in range(60)]  # most pairs of codes are equally far
    rows = [(i, [1.0 if d in s else -1.0 for d in range(20)]) for i, s in enumerate(sets)]
    asked = rows[::5]
    got = hamming.search(table(spark, rows), table(spark, asked), k=3, width=5)
    assert sorted(map(tuple, got.collect())) == plain(rows, asked, 3)
    assert max(n for columns, n in kept if "distance" in columns) <= 4 * len(asked)
