"""Every id, crc and place against the plain tokenizer, and the order of neighbours against the formula of BM25."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, queries

ODD = [
    None, "", "hello <|endoftext|> world", "<|endoftext|>", " lead", "trail ", "a  b\n\n c\t\td \n", "é　x  ü\xa0y", "don't  we'll\r\n 's it's.", "日本 語\n \n語", "\x1c a b​c", "9a9 a9. b_c", "x" * 70_000,
    "  \n", "A.B,C;d 1,000.50% (x)", "ünï. cödé, 'tis 'S", "word " * 30_000,
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def _ids(plain, text):
    return np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], np.uint32)


def _checked(rows, ids):
    """Each piece holds the ids that the plain tokenizer gives there; pieces tile documents and sequences."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and zlib.crc32(part.astype("<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        ends = sorted((r["start"], r["start"] + r["length"]) for r in pieces)
        assert [a for a, _ in ends] == [0, *(z for _, z in ends[:-1])] and ends[-1][1] == len(ids[i])
    for pieces in by_sequence.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1].tolist()]
        size = sum(n for _, n in pieces)
        assert size <= 2048 and size & (size - 1) == 0


def test_special_tokens_are_plain(plain):
    assert packing.Encoder(None).encode(pa.array(["hello <|endoftext|> world"]))[0].tolist() == plain.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [31373, 220, 50256, 995]


def test_query_against_the_plain_tokenizer(spark, plain):
    sf = "/root/testdata/sf0.001"
    ids = {r["doc_id"]: _ids(plain, r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    _checked(queries.op7_packing(spark, sf).collect(), ids)


def test_odd_texts_against_the_plain_tokenizer(spark, plain):
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in enumerate(ODD)], "doc_id bigint, text string, row string, shard int")
    _checked(packing.pack(df, shard_tokens=5000).collect(), {i: _ids(plain, t) for i, t in enumerate(ODD)})


def test_memo_may_be_forgotten(plain, monkeypatch):
    monkeypatch.setattr(packing, "_MEMO", 3)
    encoder = packing.Encoder(None)
    for text in ("a b c d e f", "a b x y z", "f e d, c. b a"):
        assert encoder.encode(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_scores_against_the_formula():
    rng = np.random.default_rng(3)
    docs = [rng.zipf(1.5, rng.integers(5, 60)).astype(np.uint32) % 50 for _ in range(40)]
    df = Counter(t for d in docs for t in set(d.tolist()))
    mean = sum(map(len, docs)) / len(docs)
    idf = lambda t: math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
    for q in docs[:5]:
        want = [sum(idf(t) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t, tf in Counter(d.tolist()).items() if t in set(q.tolist())) for d in docs]
        assert np.allclose(packing.Index(docs).scores(q), want, rtol=1e-4)


def test_window_is_filled_with_the_best_neighbours():
    """The seed's best neighbours, in order, fill its window; the last one is cut to fit."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 30, 40).astype(np.uint32) for _ in range(12)]
    first = sorted((p for p in packing.pack_shard(docs, 100) if p[3] == 0), key=lambda p: p[4])
    scores = packing.Index(docs).scores(docs[0])
    scores[0] = -1
    best = np.argsort(-scores, kind="stable")[:2].tolist()
    assert [(p[0], p[2]) for p in first] == [(0, 40), (best[0], 40), (best[1], 20)]
