"""Removed words against brute force: lengths about the window, repeats inside a document, overlaps, copies."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tidemark.llm import substring


def _brute(rows, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[a : a + length]) for w in words for a in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {p for a in range(len(w) - length + 1) if seen[tuple(w[a : a + length])] > 1 for p in range(a, a + length)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("anchor", [5, 20, 35])
def test_against_brute_force(spark, anchor):
    rng = random.Random(anchor)
    fresh = lambda n: [f"f{rng.random()}" for _ in range(n)]
    shared = [f"s{i}é" for i in range(200)]
    rows = []
    for n in (34, 35, 36, 50, 70):  # a passage of so many words in three documents, at several places
        for k in range(3):
            rows.append((len(rows), " ".join(fresh(k * 7) + shared[n : 2 * n] + fresh(20 - k * 5))))
    loop = ["a", "b", "c"] * 30  # repeats that overlap themselves
    near = fresh(300)
    changed = [*near[:100], "x", *near[101:180], "y", *near[181:]]
    rows += [(100, " ".join(fresh(5) + loop)), (101, " ".join(shared[:40] + fresh(3) + shared[:40])), (102, " ".join(["w"] * 36)), (103, " ".join(["v"] * 35))]
    rows += [(104, " ".join(near)), (105, "\n".join(changed)), (105, "\n".join(changed)), (None, " ".join(shared[:60])), (None, None), (106, ""), (107, "\t".join(shared[:34]))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, row bigint, mark string").repartition(4)
    got = substring.remove_repeats(df, anchor=anchor).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == _brute(rows, 35)
