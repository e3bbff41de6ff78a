import itertools
import random
import time

import pyarrow as pa

from tidemark.llm.divergence import kept_terms

NAMES = ["lang", "term", "source", "docs", "count"]


def batches(rows, size):
    for at in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows[at : at + size]], pa.schema([*((c, pa.string()) for c in NAMES[:3]), *((c, pa.int64()) for c in NAMES[3:])]))


def told(rows, size, least):
    return [tuple(r.values()) for out in kept_terms(least)(batches(rows, size)) for r in out.to_pylist()]


def test_terms_across_batches_against_plain_sums():
    r = random.Random(3)
    rows = sorted((r.choice(["", "de", "en"]), r.choice(["a", "b", "ü", "c" * 9]), r.choice(["", "s1", "s2", "s3"]), r.randint(1, 4), r.randint(4, 9)) for _ in range(400))
    want = []
    for (lang, term), runs in itertools.groupby(rows, lambda x: x[:2]):
        runs = list(runs)
        by = {s: sum(x[4] for x in g) for s, g in itertools.groupby(runs, lambda x: x[2])}
        if sum(x[3] for x in runs) >= 80:
            want.append((lang, term, list(by), list(by.values())))
    assert 0 < len(want) < 12
    for size in (1, 2, 7, 100, 400):
        assert told(rows, size, 80) == want
    assert told([], 5, 1) == []


def test_runs_are_summed_as_columns():
    """Seen as Python objects a row, half a million runs of rare terms took over a second."""
    n, size = 500_000, 10_000
    names = [f"t{i:07d}" for i in range(n)]
    ones = pa.array([1] * size, pa.int64())
    made = [pa.RecordBatch.from_arrays([pa.repeat("en", size), pa.array(names[at : at + size]), pa.repeat("s", size), ones, ones], names=NAMES) for at in range(0, n, size)]
    start = time.process_time()
    assert list(kept_terms(2)(iter(made))) == []
    took = time.process_time() - start
    objects = time.process_time()
    for batch in made:
        [c.to_pylist() for c in batch.columns]
    assert took < time.process_time() - objects
