"""Benchmark windows in documents, against a plain search."""

import re

import pytest

from tidemark.llm import decontamination

DOCS = "doc_id bigint, text string, item_id string, key string, words string, h bigint"
ITEMS = "item_id bigint, text string, doc_id string, n bigint"
A = " ".join(f"alpha{i}" for i in range(14))
TEXTS = [None, "", "...", A, f"x {A} y {A.upper()}!", "one two", "One, TWO three", "z z z z z z z z z z z z", "É one é two", "na na " * 3000 + A, "alpha0 alpha1 alpha2", " ".join(A.split()[3:13])]
BENCH = [(1, A), (10, A), (2, "z z z z z z z z z z z"), (3, "ONE two"), (4, None), (5, "!!"), (None, "three"), (6, "É"), (7, "absent words here"), (7, "na na na na na na na na na na na")]


def plain(texts, bench, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in texts:
        w, hit, items = words(t), set(), set()
        for item, said in bench:
            i = words(said)
            n = min(size, len(i))
            for s in range(len(i) - n + 1 if i else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == i[s : s + n]:
                        hit |= set(range(p, p + n))
                        items.add(item)
        out.append((len(w), len(hit), sorted(str(i) for i in items if i is not None)))
    return out


@pytest.mark.parametrize("most_broadcast", [1 << 20, 0])
def test_odd_rows_against_plain_search(spark, most_broadcast):
    rows = [(i, t, "i", "k", "w", 1) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], None, None, None, None), (None, A, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    bench = spark.createDataFrame([(*b, "d", 1) for b in BENCH], ITEMS)
    got = decontamination.hits(docs, bench, most_broadcast=most_broadcast).collect()
    want = plain([r[1] for r in rows], BENCH)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)
    assert max(w[1] for w in want) > 14


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, A, "", "", "", 1)], DOCS), spark.createDataFrame([(1, A, "", 1)], ITEMS)
    assert decontamination.hits(docs.limit(0), bench).collect() == []
    assert [(r.n_words, r.n_hit, r["items"]) for r in decontamination.hits(docs, bench.limit(0)).collect()] == [(14, 0, [])]
