"""The audit against a plain reading of its formulas."""

import re
from collections import Counter

import numpy as np

from tidemark.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, task string, count bigint"


def plain(rows, least=3, top=4, prior=5, scale=10**9):
    groups, docs, counts = set(), Counter(), {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        docs.update((lang, t) for t in set(found))
        counts.setdefault((lang, source), Counter()).update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept, names = sorted(t for (x, t), n in docs.items() if x == lang and n >= least), sorted(s for x, s in groups if x == lang)
        share = lambda c: {t: 1 + scale * (c[t] + prior) // (sum(c[k] for k in kept) + prior * len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in names}
        q = share(sum((counts[lang, s] for s in names), Counter()))
        for s in names:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in names if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((q[t] - p[s][t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, -v, r) for part, found in (("pair", pairs), ("term", terms)) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


def test_odd_rows_against_plain_formulas(spark):
    rng = np.random.default_rng(5)
    word = [*"abcdefgh", "É", "日本", "ab c", "Zz", "1x2"]
    rows = [(" ".join(rng.choice(word, rng.integers(0, 12), p=None)), rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s3", "é"])) for _ in range(60)]
    rows = [(t, str(a), str(s)) for t, a, s in rows] + [(None, None, None), ("", "en", "none"), ("a " * 4000, "en", "s1"), ("a b", "fr", "s1"), ("c", "fr", "s2"), rows and (rows[0][0], "en", "s1")]
    docs = spark.createDataFrame([(1, *r, "t", "k", 1) for r in rows], SCHEMA).repartition(5)
    for most_held in (1_000_000, 7):
        got = divergence.audit(docs, least_docs=3, most_terms=4, most_held=most_held).collect()
        assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == plain(rows)


def test_shares_beyond_64_bits():
    counts, totals = np.array([10**12, 0]), np.array([10**13, 10**13])
    want = [1 + 10**9 * (int(c) + 5) // (int(t) + 50) for c, t in zip(counts, totals)]
    assert divergence.shares(counts, totals, 10, 5, 10**9).tolist() == want


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
