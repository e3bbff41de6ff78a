"""Top-k search on odd rows and long vectors against brute force."""

import random

import pytest

from tidemark.llm import hamming

SCHEMA = "vec_id bigint, embedding array<float>, q string, code int, seg int, value int, ids string, width int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "q", 1, 1, 1, "i", 1, 1) for i, v in rows], SCHEMA)


def plain(rows, asked, k):
    size = max((len(v) for _, v in rows if v), default=0)
    coded = lambda rows: {(i, tuple(d < len(v or []) and v[d] is not None and not v[d] <= 0 for d in range(size))) for i, v in rows if i is not None}
    out = []
    for i, c in coded(asked):
        near = sorted((sum(x != y for x, y in zip(c, e)), j) for j, e in coded(rows) if (i, c) != (j, e))[:k]
        out += [(i, n + 1, j, d) for n, (d, j) in enumerate(near)]
    return sorted(out)


def drawn(seed, dims, n):
    r = random.Random(seed)
    base = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    near = lambda v: [x if r.random() < 0.9 else -x for x in v]
    rows = [(i, near(r.choice(base))) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0, None, -1.0]), (None, base[0]), (3, rows[3][1]), (20, base[1]), (n + 3, base[0][: dims // 2]), (n + 4, [0.0] * dims), (n + 5, [float("nan")] * dims)]
    return rows + [(n + 10 + i, base[2]) for i in range(15)]


@pytest.mark.parametrize(("dims", "width", "hot"), [(64, None, 8192), (130, None, 8192), (7, 4, 2)])
def test_against_brute_force(spark, monkeypatch, dims, width, hot):
    monkeypatch.setattr(hamming, "_HOT", hot)
    rows = drawn(dims, dims, 120)
    asked = [x for x in rows if x[0] is None or x[0] % 10 == 0 or x[0] >= 120]
    got = hamming.search(table(spark, rows), table(spark, asked), k=4, width=width)
    assert sorted(map(tuple, got.collect())) == plain(rows, asked, 4)


def test_few_rows_and_none(spark):
    rows = [(1, [1.0, -1.0]), (2, None), (3, [1.0])]
    assert sorted(map(tuple, hamming.search(table(spark, rows), table(spark, rows)).collect())) == plain(rows, rows, 10)
    none = table(spark, [])
    assert hamming.search(none, none).collect() == hamming.search(none, table(spark, rows)).collect() == []
