"""Base score and the tree's score against plain loops over Python words."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import suffix_tree


def _tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def _brute(rows, least, depth, alpha=0.1):
    """(n_tokens, n_known, base, score) of each row, and the number of retained contexts by length."""
    docs = [(_tokens(t), zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0) for i, t in rows]
    learnt = [w for w, held in docs if not held]
    unigram = Counter(x for w in learnt for x in w)
    total, floor = sum(unigram.values()), sum(unigram.values()) + alpha * (len(unigram) + 1)
    cost = 0.5 * math.log(max(total, 2))
    grams = [None] + [defaultdict(Counter) for _ in range(depth)]
    ctx = lambda w, i, d: tuple((["^"] + w)[i + 1 - d : i + 1]) if i >= d - 1 else None
    for w in learnt:
        for i in range(len(w)):
            for d in range(1, depth + 1):
                if ctx(w, i, d):
                    grams[d][ctx(w, i, d)][w[i]] += 1
    kept, looked = [{()}], [{()}]

    def p(c, w, upto):
        value = (unigram[w] + alpha) / floor
        for d in range(1, upto + 1):
            own = c[-d:] if len(c) >= d else None
            if own is None or own not in kept[d]:
                break
            n, k = grams[d][own], len(grams[d][own])
            value = (n[w] + k * value) / (sum(n.values()) + k)
        return value

    for d in range(1, depth + 1):
        seen, keep = set(), set()
        for c, n in grams[d].items():
            t = sum(n.values())
            if c[1:] in kept[d - 1] and t >= least and c[:-1] in looked[d - 1]:
                seen.add(c)
                if sum(m * (math.log(m / t) - math.log(p(c, w, d - 1))) for w, m in n.items()) > cost * len(n):
                    keep.add(c)
        looked.append(seen)
        kept.append(keep)
    out = []
    for w, held in docs:
        base = sum(math.log10((unigram[x] + alpha) / floor) for x in w)
        score = sum(math.log10(p(ctx(w, i, min(depth, i + 1)), x, depth)) for i, x in enumerate(w))
        out.append((held, len(w), sum(unigram[x] > 0 for x in w), total, base, score))
    return out, [len(k) for k in kept[1:]]


@pytest.mark.parametrize("least,depth,share", [(2, 4, 200_000), (3, 2, 200_000), (2, 3, 20)])
def test_against_plain_loops(spark, least, depth, share):
    """With a share of 20 tokens, the commonest contexts are dealt over several buckets."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()][:70]
    phrase = " ".join(f"p{i}" for i in range(12))
    rows += [(1000 + i, f"{phrase} x{i % 3} {phrase} The end") for i in range(30)] + [(None, None), (5000, ""), (5000, ""), (5001, "É é \xa0 A a")]
    want, kept = _brute(rows, least, depth)
    assert all(kept[:2])
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, block bigint, id string").repartition(3)
    got = suffix_tree.score(df, least=least, depth=depth, share=share, bucket_tokens=2000).collect()
    key = lambda i, r: (str(i), *r[:4], round(r[4], 6), round(r[5], 6))
    assert sorted(key(r["doc_id"], tuple(r)[1:]) for r in got) == sorted(key(i, w) for (i, _), w in zip(rows, want))


def test_without_training_tokens(spark):
    """A null id counts as the empty string, which is held out: nothing is learnt, and each token has probability one."""
    got = suffix_tree.score(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id bigint, text string")).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"], r["held_out"]) for r in got) == [(1, 0, 0, 0.0, 0.0, True), (3, 0, 0, 0.0, 0.0, True)]
