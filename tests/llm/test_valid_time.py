"""Enriched sales against a plain reading of the rules, a row at a time."""

import datetime as dt
import math
import random
import zlib

import pytest

from tidemark.llm import valid_time

SALES = "sale_id bigint, client_id bigint, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, turn string, owner string"
CHANGES = "change_id bigint, client_id bigint, seq bigint, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, kind string"
START = dt.datetime(2024, 1, 1)
LOW = (0,)


def batch(day):
    return min(9, max(0, (day - 19723) * 10 // 152))


def days(t):
    return (t - dt.datetime(1970, 1, 1)).days


def plain(sales, changes):
    """(rec, id, batch, n_held, change_id, cents, op) of every output row."""
    dealt = [([], []) for _ in range(10)]
    for s in sales:
        dealt[batch(days(s[5])) if s[5] else 9][0].append(s)
    for c in set(changes):
        if c[4] is not None:
            dealt[batch(days(c[4]) + (zlib.crc32(str(c[0]).encode()) % 4 if c[0] is not None else 0))][1].append(c)
    order = lambda c: (c[4], (0, 0) if c[2] is None else (1, c[2]), (0, 0) if c[0] is None else (1, c[0]))
    out, held, waiting, tops = [], {}, [], [None, None]
    for b in range(11):
        marks = [t and t - dt.timedelta(hours=36) for t in tops]
        h = None if None in marks else min(marks)
        new = dealt[b] if b < 10 else ([], [])
        for c in new[1]:
            if marks[1] is not None and c[4] < marks[1]:
                out.append(("late", c[0], b, None, None, None, None))
            elif c[1] is not None:
                held.setdefault(c[1], []).append(c)
        kept = []
        for s in waiting + new[0]:
            if b == 10 or s[4] is None or (h is not None and s[4] < h):
                own = held.get(s[1], []) if s[1] is not None else []
                before = [c for c in own if s[4] is not None and c[4] <= s[4]]
                v = max(before, key=order) if before else None
                cents = None if v is None or v[8] is None else math.floor(100 * v[8] + 0.5)
                out.append(("sale", s[0], b, len(own), v and v[0], cents, v and v[3]))
            else:
                kept.append(s)
        waiting = kept
        for k, own in held.items():
            old = sorted((c for c in own if h is not None and c[4] <= h), key=order)
            held[k] = old[-1:] + [c for c in own if h is None or c[4] > h]
        for i, at in ((0, 4), (1, 4)):
            tops[i] = max([t for t in (tops[i], *(r[at] for r in new[i])) if t is not None], default=None)
    return sorted(out, key=repr)


def drawn(seed, n_sales, n_changes, clients):
    r = random.Random(seed)
    who = lambda: r.choice([1, 1, 1, None, *range(clients)])
    time = lambda most: START + dt.timedelta(hours=r.randrange(most), microseconds=r.choice([0, 0, 7]))
    sales, changes = [], []
    for i in range(n_sales):
        at = time(24 * 120)
        sales.append((i if r.random() < 0.95 else r.randrange(n_sales), who(), "done", 1.0, None if r.random() < 0.03 else at, None if r.random() < 0.01 else at + dt.timedelta(hours=r.choice([0, 1, 30, 400])), 1, "t", "o"))
    for i in range(n_changes):
        at = START if r.random() < 0.05 else time(24 * 120)
        changes.append((i if r.random() < 0.97 else None, who(), r.choice([None, 0, 1, 2]), r.choice(["I", "U", "D", None]), None if r.random() < 0.02 else at, "s", None, None, r.choice([None, 1.005, -2.5, 1e6]), "k"))
    return sales, changes + changes[: n_changes // 20]


def told(df):
    return sorted(((x.rec, x.id, x.batch, x.n_held, x.change_id, x.balance_cents, x.op) for x in df.collect()), key=repr)


@pytest.mark.parametrize("slot_rows", [16, 100000])
def test_against_plain_rules(spark, slot_rows):
    sales, changes = drawn(slot_rows, 400, 300, 12)
    got = told(valid_time.enrich(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES), slot_rows=slot_rows))
    assert got == plain(sales, changes)
    assert {r[0] for r in got} == {"sale", "late"} and len({r[2] for r in got}) > 5


@pytest.mark.parametrize("empty", ["sales", "changes", "both"])
def test_empty_tables(spark, empty):
    sales, changes = drawn(3, 40, 30, 3)
    sales, changes = [] if empty in ("sales", "both") else sales, [] if empty in ("changes", "both") else changes
    assert told(valid_time.enrich(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES), slot_rows=16)) == plain(sales, changes)


def test_query_on_its_tables(spark):
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.001"
    tables = [list(map(tuple, spark.read.parquet(f"{sf}/{t}.parquet").collect())) for t in ("sales", "client_changes")]
    assert told(queries.queries()["op13_valid_time"](spark, sf)) == plain(*tables)
