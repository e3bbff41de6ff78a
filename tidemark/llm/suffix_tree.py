"""A probabilistic suffix tree over words, grown level by level.

States are contexts of 0, 1, 2, ... words. A context of d words is looked at if the one without its first word is
retained, the one without its last word was looked at, and training texts hold it at least `least` times (contexts
are left out by that, never tokens). It is retained if its next-word distribution differs from that of its suffix by
more than its parameters cost: sum of c * ln(P(w|context) / P(w|suffix)) above half of ln N for each distinct next
word. A retained state's distribution is smoothed with its suffix's (Witten-Bell), down to the additive unigram. A
word is scored in the state of its longest retained suffix. Levels are added until no context of the next length
is retained, or up to `depth` words.

Texts become blocks: some megabytes of documents as a list of their words' hashes and, for each token, its place in
that list. A block asks for the counts of its distinct grams, dealt out by context to buckets; a bucket adds
up what all blocks sent, judges its contexts, and answers each block in the order of its questions. So what is moved
is a number a distinct gram of a block, and texts are read once. The grams of a context of more than `share` tokens
are dealt over several buckets, and the driver joins the parts of at most `most_split` such contexts a level.

Null and empty texts are the end token alone. Very long texts make a block of their own. Rows that repeat an id and
a text get the same scores. A null id counts as the empty string and stays null. Without training tokens every
token has probability 1 (0.1 / 0.1) and both scores are 0. An empty table gives an empty result. Of the table's
columns only the two named are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, chunks, cut, drop, utf8
from .hashing import hash_words, mix

#: Hashes that stand for the end token and for the place before the first word.
_END, _BEFORE = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text in a block.
_BLOCK = 12 << 20

_ASKED = "bucket int, block bigint, split boolean, contexts binary, sizes binary, logs binary, grams binary, counts binary"
_TOLD = "block bigint, split boolean, bucket int, n binary, total binary, kinds binary, context bigint, tokens bigint, types bigint, ncs double, logs double, kept bigint"


def after(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0xD6E8FEB86659FD93) + word)


def _packed(values: np.ndarray) -> bytes:
    """Non-negative integers, all lowest bytes first, then all second ones..., compressed. Whoever reads them knows how many."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : data[0]] = np.frombuffer(pa.decompress(data[1:], n * data[0], "zstd", asbytes=True), np.uint8).reshape(data[0], n).T
    return out.view("<i8").ravel()


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (id, held_out, text) rows."""
    part, i = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for lo, hi in chunks(offsets, _BLOCK):
            hashes, _, _, first = hash_words(_LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo])
            token = np.insert(hashes, first[1:], _END)
            first = first + np.arange(len(first))
            place, words = pd.factorize(token)
            order = np.argsort(-np.bincount(place), kind="stable")  # common words have small places, which pack well
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            held = batch.column(1).slice(lo, hi - lo)
            flags = held.to_numpy(zero_copy_only=False).astype(bool)
            learnt = np.diff(first)[~flags]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + i], pa.int64()), pa.array([words[order].tobytes()], pa.binary()), pa.array([len(token)], pa.int64()), pa.array([_packed(rank[place])], pa.binary()),
                    pa.array([first.astype("<i8").tobytes()], pa.binary()), pa.array([flags.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo)),
                    pa.array([len(learnt)], pa.int64()),
                ],
                names=["block", "words", "tokens", "places", "first", "held_out", "ids", "learnt_docs"],
            )
            i += 1


@dataclass(frozen=True)
class Settings:
    """What all tasks share: parameters, totals, and for each level the parts-joined contexts (sorted keys, tokens, types)."""

    alpha: float
    least: int
    share: int
    buckets: int
    total: int = 0
    types: int = 0
    learnt_docs: int = 0
    split: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...] = ()


class State:
    """Counts and probabilities at each token of a block, after the levels answered so far."""

    def __init__(self, row: dict, settings: Settings):
        self.s = settings
        self.words = np.frombuffer(row["words"], np.uint64)
        self.place = _unpacked(row["places"], row["tokens"]).astype(np.int32)
        self.first = np.frombuffer(row["first"], "<i8")
        self.held = np.frombuffer(row["held_out"], bool)
        sizes = np.diff(self.first)
        self.at = (np.arange(row["tokens"], dtype=np.int32) - np.repeat(self.first[:-1].astype(np.int32), sizes)).astype(np.int32)
        self.learnt = np.repeat(~self.held, sizes)
        self.bucket0 = (self.words % np.uint64(settings.buckets)).astype(np.int32)
        self.order0 = np.argsort(self.bucket0, kind="stable")
        self.level = -1

    def ask_words(self) -> list[tuple]:
        """(bucket, split, contexts, sizes, logs, grams, counts) of level 0."""
        counts = np.bincount(self.place[self.learnt], minlength=len(self.words))
        bucket = self.bucket0[self.order0]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        none = np.zeros(0)
        return [(int(bucket[a]), False, none.astype(np.uint64), none, none, self.words[self.order0[a:z]], counts[self.order0[a:z]]) for a, z in zip(edges[:-1], edges[1:])]

    def take_words(self, n: np.ndarray) -> None:
        self.known = np.empty(len(self.words), np.int64)
        self.known[self.order0] = n
        self.base = (self.known + self.s.alpha) / (self.s.total + self.s.alpha * (self.s.types + 1))
        self.count, self.p = self.known[self.place], self.base[self.place]
        self.context = np.zeros(len(self.place), np.uint64)
        self.open = np.ones(len(self.place), bool)
        self.level = 0

    def before(self) -> np.ndarray:
        """The word before each token."""
        prev = np.empty(len(self.place), np.uint64)
        prev[1:] = self.words[self.place[:-1]]
        prev[self.first[:-1]] = _BEFORE
        return prev

    def grow(self) -> None:
        """Contexts one word longer, and the distinct grams behind those to be looked at, in the order they are asked."""
        d = self.level + 1
        held = np.zeros(len(self.place), np.int64)
        held[1:] = self.count[:-1]
        if d == 1:
            held[self.first[:-1]] = self.s.learnt_docs
        else:
            self.context[1:] = self.context[:-1].copy()
        self.context = after(self.context, self.before())
        self.idx = np.flatnonzero((self.at >= d - 1) & self.open & (held >= self.s.least)).astype(np.int32)
        context, held = self.context[self.idx], held[self.idx]
        code, grams = pd.factorize(after(context, self.words[self.place[self.idx]]))
        of = np.empty(len(grams), np.uint64)
        of[code] = context
        salts = np.empty(len(grams), np.int64)
        salts[code] = np.where(held > self.s.share, -(-held // self.s.share), 1)
        del context, held
        spot = of + np.where(salts > 1, (grams >> np.uint64(7)) % salts.astype(np.uint64), np.uint64(0))
        bucket = (spot % np.uint64(self.s.buckets)).astype(np.int32)
        split = salts > 1
        order = np.lexsort((of, bucket, split))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.slot = rank[code]
        del code, rank
        self.grams, self.of, self.bucket, self.split = grams[order], of[order], bucket[order], split[order]
        new = np.ones(len(order), bool)
        new[1:] = (self.of[1:] != self.of[:-1]) | (self.bucket[1:] != self.bucket[:-1]) | (self.split[1:] != self.split[:-1])
        self.run_of, self.run_at = np.cumsum(new) - 1, np.flatnonzero(new)
        self.level = d

    def ask(self) -> list[tuple]:
        """(bucket, split, contexts, sizes, logs, grams, counts) of the present level."""
        learnt = self.learnt[self.idx]
        slot = self.slot[learnt]
        counts = np.bincount(slot, minlength=len(self.grams))
        logs = np.bincount(self.run_of[slot], np.log(self.p[self.idx[learnt]]), len(self.run_at)).astype(np.float64)
        sizes = np.diff(np.append(self.run_at, len(self.grams)))
        bucket, split = self.bucket[self.run_at], self.split[self.run_at]
        edges = np.flatnonzero(np.diff(bucket.astype(np.int64) * 2 + split, prepend=-1, append=-1))
        out = []
        for a, z in zip(edges[:-1], edges[1:]):
            lo, hi = self.run_at[a], self.run_at[z] if z < len(self.run_at) else len(self.grams)
            out.append((int(bucket[a]), bool(split[a]), self.of[self.run_at[a:z]], sizes[a:z], logs[a:z], self.grams[lo:hi], counts[lo:hi]))
        return out

    def take(self, n: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> None:
        """Answers to ask(): a count a gram, and tokens (0: not retained) and types a context."""
        keys, tokens, types = self.s.split[self.level - 1]
        runs = self.split[self.run_at]
        if runs.any():
            of = self.of[self.run_at[runs]]
            at = np.minimum(np.searchsorted(keys, of), max(len(keys) - 1, 0))
            hit = keys[at] == of if len(keys) else np.zeros(len(of), bool)
            total[runs] = np.where(hit, tokens[at], 0) if len(keys) else 0
            kinds[runs] = np.where(hit, types[at], 0) if len(keys) else 0
        self.count = np.zeros(len(self.p), np.int64)
        self.count[self.idx] = n[self.slot]
        self.open = np.zeros(len(self.p), bool)
        self.open[self.idx] = total[self.run_of[self.slot]] > 0
        slot = self.slot[self.open[self.idx]]
        run = self.run_of[slot]
        self.p[self.open] = (n[slot] + kinds[run] * self.p[self.open]) / (total[run] + kinds[run])


def _replayed(block: pa.Table, answers: pa.Table | None, settings: Settings, levels: int) -> State:
    """The block's state after so many levels of answers."""
    state = State(block.to_pylist()[0], settings)
    if answers is not None:
        rows = sorted(answers.to_pylist(), key=lambda r: (r["level"], r["split"], r["bucket"]))
        for d in range(levels):
            own = [r for r in rows if r["level"] == d]
            if d:
                state.grow()
                edges = np.flatnonzero(np.diff(state.bucket.astype(np.int64) * 2 + state.split, prepend=-1, append=-1))
                runs = [np.searchsorted(state.run_at, e) for e in edges]
                whole = [np.concatenate([_unpacked(r[c], int(z - a)) for r, a, z in zip(own, e[:-1], e[1:])]) if own else np.zeros(0, np.int64) for c, e in (("n", edges), ("total", runs), ("kinds", runs))]
                state.take(*whole)
            else:
                edges = np.flatnonzero(np.diff(state.bucket0[state.order0], prepend=-1, append=-1))
                state.take_words(np.concatenate([_unpacked(r["n"], int(z - a)) for r, a, z in zip(own, edges[:-1], edges[1:])]))
    return state


def _asked(asked: list[tuple], block: int) -> pa.Table:
    raw = lambda x, kind: x.astype(kind).tobytes()
    cols = list(zip(*((b, block, s, raw(c, "<u8"), _packed(z), raw(x, "<f8"), raw(g, "<u8"), _packed(n)) for b, s, c, z, x, g, n in asked))) or [[]] * 8
    kinds = [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 5]
    return pa.table({n: pa.array(c, k) for n, c, k in zip("bucket block split contexts sizes logs grams counts".split(), cols, kinds)})


def _ask_words(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                yield from _asked(_replayed(row, None, settings, 0).ask_words(), row["block"][0].as_py()).to_batches()

    return run


def _ask(settings: Settings, levels: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(block):
            return _asked([], 0)
        state = _replayed(block, answers, settings, levels)
        state.grow()
        return _asked(state.ask(), block["block"][0].as_py())

    return run


def _told(rows: list[dict]) -> pa.Table:
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    return pa.table({n: pa.array([r.get(n) for r in rows], kinds[k]) for n, k in (f.split() for f in _TOLD.split(", "))})


def _count_words(table: pa.Table) -> pa.Table:
    """Answers of a bucket of words."""
    rows = table.to_pylist()
    words = [np.frombuffer(r["grams"], "<u8") for r in rows]
    kinds, at = np.unique(np.concatenate(words), return_inverse=True)
    n = np.bincount(at, np.concatenate([_unpacked(r["counts"], len(w)) for r, w in zip(rows, words)]), len(kinds)).astype(np.int64)
    out, lo = [], 0
    for r, w in zip(rows, words):
        out.append({"block": r["block"], "split": False, "bucket": r["bucket"], "n": _packed(n[at[lo : lo + len(w)]])})
        lo += len(w)
    out.append({"tokens": int(n.sum()), "types": int((n > 0).sum()), "kept": 0})
    return _told(out)


def _count(least: int, cost: float):
    """Answers of a bucket of contexts, and the parts of those that are dealt over several buckets."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        grams = [np.frombuffer(r["grams"], "<u8") for r in rows]
        contexts = [np.frombuffer(r["contexts"], "<u8") for r in rows]
        sizes = [_unpacked(r["sizes"], len(c)) for r, c in zip(rows, contexts)]
        kinds, at = np.unique(np.concatenate(grams), return_inverse=True)
        n = np.bincount(at, np.concatenate([_unpacked(r["counts"], len(g)) for r, g in zip(rows, grams)]), len(kinds)).astype(np.int64)
        named, run_of = np.unique(np.concatenate(contexts), return_inverse=True)
        logs = np.bincount(run_of, np.concatenate([np.frombuffer(r["logs"], "<f8") for r in rows]), len(named))
        of = np.empty(len(kinds), np.int64)
        of[at] = np.repeat(run_of, np.concatenate(sizes))
        t = np.bincount(of, n, len(named)).astype(np.int64)
        k = np.bincount(of, n > 0, len(named)).astype(np.int64)
        ncs = np.bincount(of, n * np.log(np.maximum(n, 1)), len(named))
        split = np.zeros(len(named), bool)
        split[run_of] = np.repeat([r["split"] for r in rows], [len(c) for c in contexts])
        keep = ~split & (ncs - t * np.log(np.maximum(t, 1)) - logs > cost * k)
        # Counts that no later level or score asks for go back as 0, which packs best.
        n = np.where((keep | split)[of] | (n >= least), n, 0)
        out, lo, run = [], 0, 0
        for r, g, c in zip(rows, grams, contexts):
            mine = run_of[run : run + len(c)]
            out.append({"block": r["block"], "split": r["split"], "bucket": r["bucket"], "n": _packed(n[at[lo : lo + len(g)]]), "total": _packed(np.where(keep, t, 0)[mine]), "kinds": _packed(np.where(keep, k, 0)[mine])})
            lo, run = lo + len(g), run + len(c)
        for i in np.flatnonzero(split):
            out.append({"context": int(named[i].view(np.int64)), "tokens": int(t[i]), "types": int(k[i]), "ncs": float(ncs[i]), "logs": float(logs[i])})
        out.append({"kept": int(keep.sum())})
        return _told(out)

    return run


def _scores(settings: Settings, levels: int, kind: str):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(block):
            block = block.slice(0, 0)
            state, sizes, ids = None, np.zeros(0, np.int64), pa.array([], block["ids"].type.value_type)
        else:
            state = _replayed(block, answers, settings, levels)
            sizes, ids = np.diff(state.first), block["ids"].combine_chunks().flatten()
        doc = np.repeat(np.arange(len(sizes)), sizes)
        summed = lambda x: np.bincount(doc, x, len(sizes))
        held = state.held if state else np.zeros(0, bool)
        known, base, score = (summed(x) for x in ((state.known > 0)[state.place], np.log10(state.base)[state.place], np.log10(state.p))) if state else [np.zeros(0)] * 3
        return pa.table(
            {
                "id": ids, "held_out": pa.array(held), "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array(np.full(len(sizes), settings.total), pa.int64()),
                "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()),
            }
        )

    return run


def _joined_parts(told: DataFrame, cost: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The retained ones of the contexts that were dealt over several buckets: at most tokens / share of them."""
    parts = told.filter("context is not null").groupBy("context").agg(*(F.sum(c).alias(c) for c in ("tokens", "types", "ncs", "logs"))).toArrow()
    key = parts["context"].to_numpy().view(np.uint64)
    t, k, ncs, logs = (parts[c].to_numpy() for c in ("tokens", "types", "ncs", "logs"))
    keep = ncs - t * np.log(np.maximum(t, 1)) - logs > cost * k
    order = np.argsort(key[keep])
    return key[keep][order], t[keep][order], k[keep][order]


def score(
    docs: DataFrame, alpha: float = 0.1, least: int = 2, depth: int = 3, share: int = 200_000, most_split: int = 1 << 20, bucket_tokens: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    least: occurrences below which a context is not looked at; depth: words of the longest context.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), (F.crc32(id_text.cast("binary")) % 10 == 0).alias("held_out"), as_text(text_col).alias("text"))
    blocks = cut(base.mapInArrow(block_rows, f"block bigint, words binary, tokens bigint, places binary, first binary, held_out binary, ids array<{kind}>, learnt_docs bigint"))
    tokens, learnt_docs = blocks.agg(F.sum("tokens"), F.sum("learnt_docs")).first()
    settings = Settings(alpha, least, max(share, (tokens or 0) // most_split), 1 + (tokens or 0) // bucket_tokens, learnt_docs=learnt_docs or 0)

    told = [cut(blocks.mapInArrow(_ask_words(settings), _ASKED).groupBy("bucket").applyInArrow(_count_words, _TOLD))]
    total, types = told[0].filter("block is null").agg(F.sum("tokens"), F.sum("types")).first()
    settings = replace(settings, total=total or 0, types=types or 0)
    cost = 0.5 * float(np.log(max(settings.total, 2)))

    def with_answers(run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        answers = None
        for d, t in enumerate(told):
            part = t.filter("block is not null").select(F.col("block").alias("block"), F.lit(d).alias("level"), "split", "bucket", "n", "total", "kinds")
            answers = part if answers is None else answers.union(part)
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)

    while settings.total and len(told) <= depth:
        found = cut(with_answers(_ask(settings, len(told)), _ASKED).groupBy("bucket").applyInArrow(_count(least, cost), _TOLD))
        kept = found.filter("block is null").agg(F.sum("kept")).first()[0] or 0
        split = _joined_parts(found, cost)
        if not kept + len(split[0]):
            drop(found)
            break
        told.append(found)
        settings = replace(settings, split=(*settings.split, split))
    out = with_answers(_scores(settings, len(told), kind), f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
