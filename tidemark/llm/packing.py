"""Lexical retrieval packing.

A document's tokens beyond its last whole window fill windows of their own at once. What is left of each document
(less than a window) goes to a shard; shards are of about equal, bounded size however many there are. Rests are dealt
in the order of their rarest token among those that `least_df` rests hold, so lexical neighbours tend to share a
shard, and a token of very many rests spreads over several. A shard builds an inverted index with BM25 impacts over
token ids, with the document frequencies and the mean length of all rests. The first unused document seeds a window; its best-scoring unused
neighbours fill it in order, the last one being cut to fit, with its rest staying unused. The last tokens of a
shard go to sequences whose sizes are powers of two, which need no padding; so no sequence is padded.

Null and empty texts give the end token alone. Very long texts fill windows of their own; their tokens are held in
memory one text at a time. Repeated rows are packed as often as they occur. Equal scores go by place in the shard.
An empty table gives an empty result. Of the table's columns only the two named are read, so others may have any
name. Every token lies in exactly one piece.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, chunks, cut, utf8

END = 1
#: Texts are tokenized in slices of about so many bytes at a time, and pieces remembered up to a number, to bound memory.
_SLICE, _MEMO = 8 << 20, 1 << 20
#: White space beyond ASCII, and separators that some definitions count as such. Texts with any go whole through the tokenizer.
_ODD_SPACE = "[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200d}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]"


class Encoder:
    """Token ids of texts, equal to the tokenizer's own with add_special_tokens=False.

    A byte-level tokenizer without a normaliser splits a text, before it joins bytes, into runs of letters, of
    digits, of other characters (each with a space before it or not) and of white space. So texts may be cut before
    white space and behind runs of ASCII letters or digits; each distinct piece is encoded once and remembered.
    Texts that hold an added token or white space beyond ASCII, and all texts of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        before = told.get("pre_tokenizer") or {}
        self.cuts = told.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        added = [t["content"] for t in told.get("added_tokens", [])]
        self.whole = "|".join([_ODD_SPACE, *map(re.escape, added)])
        alone = [t for t in told.get("added_tokens", []) if not (t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.mark = (alone[0]["content"], alone[0]["id"]) if alone else None
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[bytes], between: str, mark: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids, from texts of n pieces with a token between them that none of them has."""
        texts = [between.encode().join(pieces[lo : lo + n]).decode("utf-8", "surrogatepass") for lo in range(0, len(pieces), n)]
        ids = np.concatenate([np.append(x, np.uint32(mark)) for x in self._whole(texts)])
        ends = np.flatnonzero(ids == mark)
        return np.diff(ends, prepend=-1) - 1, ids[ids != mark]

    def _listed(self, pieces: list[bytes], simple: list[bool]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The pieces in some order, the number of ids of each, and all ids. simple: without white space but a space in front."""
        if self.mark is None:
            ids = self._whole([p.decode("utf-8", "surrogatepass") for p in pieces])
            return pieces, np.array([len(x) for x in ids], np.int64), np.concatenate(ids)
        # A line feed before a space and a word, or before a word, is a token of its own: the fastest mark for simple pieces.
        near = [p for p, ok in zip(pieces, simple) if ok] if self.line is not None else []
        apart = [p for p, ok in zip(pieces, simple) if not ok] if self.line is not None else pieces
        parts = [self._joined(x, *how) for x, how in ((apart, (*self.mark, 4096)), (near, ("\n", self.line, 256))) if x]
        return apart + near, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _pieces(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of texts that may be cut."""
        data, offsets = utf8(column)
        kind = _KIND[data]
        first = np.ones(len(data), bool)
        first[1:] = (kind[1:] != kind[:-1]) & _CUT[kind[:-1], kind[1:]]
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(first)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        told = pieces.dictionary_encode()
        distinct = told.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(distinct) > _MEMO:
            self._forget()
        fresh = [i for i, p in enumerate(distinct) if p not in self.known]
        if fresh:
            body, at = utf8(told.dictionary.cast(pa.large_string()))
            lead = body[at[:-1]]
            simple = (_KIND[body[np.minimum(at[:-1] + 1, at[1:] - 1)]] != 1) & ((lead == 0x20) | (_KIND[lead] != 1))
            new, sizes, flat = self._listed([distinct[i] for i in fresh], simple[fresh].tolist())
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, flat))
        row = np.array([self.known[p] for p in distinct], np.int64)[told.indices.to_numpy()] if distinct else np.zeros(0, np.int64)
        sizes = self.sizes[row]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        begin = np.cumsum(self.sizes) - self.sizes
        out = self.flat[np.repeat(begin[row] - (ends - sizes), sizes) + np.arange(total)]
        edges = np.concatenate(([0], ends))[np.searchsorted(starts, offsets)]
        return [out[a:z] for a, z in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        odd = pc.match_substring_regex(column, self.whole).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(column), bool)
        if not odd.any():
            return self._pieces(column)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(column)
        for at, run in ((np.flatnonzero(odd), lambda c: self._whole(c.to_pylist())), (np.flatnonzero(~odd), self._pieces)):
            if len(at):
                for i, ids in zip(at.tolist(), run(column.take(pa.array(at)))):
                    out[i] = ids
        return out


#: Kinds of bytes: other characters of ASCII (0), white space (1), letters (2), digits (3), bytes beyond ASCII (4).
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 2
_KIND[48:58] = 3
_KIND[128:] = 4
#: Whether a text may be cut between two kinds: before white space, and behind an ASCII letter or digit where ASCII of another kind follows.
_CUT = np.array([[0, 1, 0, 0, 0], [0, 0, 0, 0, 0], [1, 1, 0, 1, 0], [1, 1, 1, 0, 0], [0, 1, 0, 0, 0]], bool)


@functools.cache
def _encoder(path: str | None) -> Encoder:
    """One for all tasks of a worker, with the pieces that it remembers."""
    return Encoder(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str | None):
    encoder = _encoder(path)
    for batch in batches:
        _, offsets = utf8(batch.column(1))
        for lo, hi in chunks(offsets, _SLICE):
            part = batch.slice(lo, hi - lo)
            yield part, [np.append(ids, np.uint32(END)) for ids in encoder.encode(part.column(1))]


def token_rows(window: int, path: str | None):
    """Whole windows (with no ids behind) and the rest of each document (with its ids).

    A last row of each partition, of length 0, holds token ids and the number of rests with each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, id_kind = np.zeros(0, np.int64), pa.null()
        for part, encoded in _encoded(batches, path):
            seen = np.concatenate([np.unique(ids[len(ids) - len(ids) % window :]) for ids in encoded] or [np.zeros(0, np.uint32)])
            more = np.bincount(seen, minlength=len(df))
            more[: len(df)] += df
            df, id_kind = more, part.column(0).type
            take, start, length, crc, total, rest = [], [], [], [], [], []
            for i, ids in enumerate(encoded):
                kind = "<u2" if ids.max() < 1 << 16 else "<u4"
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    whole = len(piece) == window
                    take.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.astype("<u4").tobytes()) if whole else None)
                    total.append(len(ids))
                    rest.append(None if whole else piece.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(take, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(rest, pa.binary())],
                names=["id", "start", "length", "crc", "total", "rest"],
            )
        if len(df):
            held = np.flatnonzero(df)
            packed = np.concatenate((held, df[held])).astype("<i8").tobytes()
            numbers = [pa.array([x], pa.int64()) for x in (None, 0, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array([None], id_kind), *numbers, pa.array([packed], pa.binary())], names=["id", "start", "length", "crc", "total", "rest"])

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (term, df) of packed frequencies."""
    for batch in batches:
        for packed in batch["rest"].to_pylist():
            term, df = np.frombuffer(packed, "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df)], names=["term", "df"])


def _unpacked(rests: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    return [np.frombuffer(r, "<u2" if len(r) == 2 * n else "<u4") for r, n in zip(rests, lengths)]


class Corpus:
    """What is known of all rests: their number, mean length and document frequencies (a row a token of the vocabulary)."""

    def __init__(self, n: int, mean: float, terms: np.ndarray, df: np.ndarray):
        order = np.argsort(terms)
        self.n, self.mean, self.terms, self.df = n, mean, terms[order], df[order]

    def frequency(self, terms: np.ndarray) -> np.ndarray:
        return self.df[np.searchsorted(self.terms, terms)]


def _keyed(corpus: Corpus, least_df: int):
    df = np.zeros(int(corpus.terms[-1]) + 1 if len(corpus.terms) else 1, np.int64)
    df[corpus.terms] = corpus.df
    rare = np.where(df >= least_df, (df << 32) + np.arange(len(df)), np.iinfo(np.int64).max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(0, np.int64)
            if len(batch):
                length = batch["length"].to_numpy()
                flat = np.concatenate(_unpacked(batch["rest"].to_pylist(), length.tolist()))
                least = np.minimum.reduceat(rare[flat], np.cumsum(length) - length)  # a rest has a token at least
                keys = np.where(least < np.iinfo(np.int64).max, least & 0xFFFFFFFF, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=[*batch.schema.names, "lexical"])

    return run


class Index:
    """Inverted index of a shard: for each token id the documents that hold it, with BM25 impacts."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None, k1: float = 1.2, b: float = 0.75):
        sizes = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs)), sizes)
        pairs, tf = np.unique(np.concatenate(docs).astype(np.int64) * len(docs) + owner, return_counts=True)
        term, self.doc = pairs // len(docs), pairs % len(docs)
        self.terms, first = np.unique(term, return_index=True)
        self.first = np.append(first, len(term))
        df = np.diff(self.first)
        n, mean, held = (corpus.n, corpus.mean, corpus.frequency(self.terms)) if corpus else (len(docs), sizes.mean(), df)
        idf = np.log1p((n - held + 0.5) / (held + 0.5))
        norm = k1 * (1 - b + b * sizes / mean)
        self.impact = (np.repeat(idf, df) * tf * (k1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        self.n = len(docs)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        terms = np.searchsorted(self.terms, np.unique(ids))
        begin, sizes = self.first[terms], self.first[terms + 1] - self.first[terms]
        at = np.arange(sizes.sum()) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        return np.bincount(self.doc[at], self.impact[at], self.n)


def pack_shard(docs: list[np.ndarray], window: int, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start in it, length, sequence, offset) of all pieces."""
    index, used = Index(docs, corpus), [0] * len(docs)
    open_ = np.ones(len(docs), bool)
    out, sequence, next_seed = [], 0, 0
    left = sum(map(len, docs))
    while left >= window:
        while not open_[next_seed]:
            next_seed += 1
        room, queue = window, iter(())
        current, asked = next_seed, False
        while room:
            n = min(room, len(docs[current]) - used[current])
            out.append((current, used[current], n, sequence, window - room))
            used[current] += n
            room -= n
            left -= n
            open_[current] = used[current] < len(docs[current])
            if room:
                if not asked:  # ties go by place in the shard
                    found = np.where(open_, index.scores(docs[current]), -1.0)
                    queue, asked = iter(np.argsort(-found, kind="stable").tolist()), True
                current = next(d for d in queue if open_[d])
        sequence += 1
    spare = [(d, used[d], len(docs[d]) - used[d]) for d in np.flatnonzero(open_).tolist()]
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            room = 1 << bit
            while room:
                d, at, n = spare[0]
                take = min(n, room)
                out.append((d, at, take, sequence, (1 << bit) - room))
                room -= take
                spare[0:1] = [(d, at + take, n - take)] if n > take else []
            sequence += 1
    return out


def _shard_pieces(window: int, corpus: Corpus):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        length = table["length"].to_numpy()
        docs = _unpacked(table["rest"].to_pylist(), length.tolist())
        pieces = np.array(pack_shard(docs, window, corpus), np.int64).reshape(-1, 5)
        who = pa.array(pieces[:, 0])
        crc = [zlib.crc32(docs[d][a : a + n].astype("<u4").tobytes()) for d, a, n in pieces[:, :3].tolist()]
        shard = int(table["shard"][0].as_py())
        return pa.table(
            {
                "id": table["id"].take(who),
                "start": pa.array(table["start"].to_numpy()[pieces[:, 0]] + pieces[:, 1]),
                "length": pa.array(pieces[:, 2]),
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": table["total"].take(who),
                "sequence_id": pa.array((shard << 32) + pieces[:, 3]),
                "offset": pa.array(pieces[:, 4]),
            }
        )

    return run


def corpus_of(rows: DataFrame) -> Corpus:
    n, mean = rows.filter("rest is not null and length > 0").agg(F.count("*"), F.avg("length")).first()
    found = rows.filter("length = 0").select("rest").mapInArrow(_held, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # at most a row a token of the vocabulary
    return Corpus(n, mean or 0.0, found["term"].to_numpy(), found["df"].to_numpy())


def keyed(rest: DataFrame, corpus: Corpus, least_df: int) -> DataFrame:
    """The rests with the rarest token of each that least_df rests hold; -1 if there is none."""
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(_keyed(corpus, least_df), f"{names}, lexical bigint")


def pack(docs: DataFrame, window: int = 2048, shard_tokens: int = 400_000, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", least_df: int = 100) -> DataFrame:
    """A row a piece: the id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Whole windows have negative sequence ids; the others hold the shard in their upper half.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), as_text(text_col).alias("text"))
    rows = base.mapInArrow(token_rows(window, tokenizer), f"id {kind}, start bigint, length bigint, crc bigint, total bigint, rest binary")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    whole = rows.filter("rest is null").select("id", "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = rows.filter("rest is not null and length > 0")
    corpus = corpus_of(rows)
    shards = 1 + round(corpus.n * corpus.mean) // shard_tokens
    dealt = keyed(rest, corpus, least_df).repartitionByRange(shards, "lexical", "row").withColumn("shard", F.spark_partition_id()).select("shard", "id", "start", "length", "total", "rest")
    packed = dealt.groupBy("shard").applyInArrow(_shard_pieces(window, corpus), f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return whole.union(packed).withColumnRenamed("id", id_col)
