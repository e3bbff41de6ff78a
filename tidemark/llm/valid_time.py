"""Sales enriched with the client's record valid at the time, by a stateful streaming query over numbered batches.

Sales and changes are cut into batches, which a query with transformWithState takes one at a time, started anew for
each on one checkpoint. A table's watermark in a batch is its largest time in earlier batches less a delay; H is the
smaller of the two. In each batch
  - changes below their watermark are late, the others become versions of their client,
  - new and waiting sales with a time below H, or none, are emitted with their client's last version at or before it,
  - of a client's versions at or before H all but the last are pruned.
What waits after the last batch is emitted in one more.

State. A key of the query is a slot of about `slot_rows` rows: many small clients, or a slice of time of a large one. It
holds two lists, versions in order and waiting sales, as Arrow blocks, since a row at a time through the state's
interface would cost more than all the rest. Each batch brings each slot one clock row with both watermarks, so that
waiting sales go out when they are due without new rows. Rows without a client have no versions and lie in any slot.

A large client's slices need three facts of their other slices, which their clock rows bring: the last version that
pruning keeps (H and the order of versions alone decide that), how many versions the others hold, and the last of the
earlier slices. They come from sums and maxima per slice; no task sees all rows of a client. Rows of one client with the same
time stay in one slice.

Null valid_at: the change is ignored. Null sold_at: emitted at once, without a version. Null client: no version.
Null seq and change_id sort first, a null change_id is dealt as if its hash were 0. Null arrived_at: the last batch;
times before the first day: the first. Changes that repeat in all columns count once, repeated sales each. An empty table of sales
or changes, and an empty batch, give what the rest gives. Of columns beyond those named only the comparison of whole changes takes notice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .common import drop_table, shared_folder

#: Stands for null, and for minus infinity.
LOW = -(1 << 63)
HIGH = (1 << 63) - 1
_CLOCK, _CHANGE, _SALE = 0, 1, 2
_FED = (
    "owner string, part bigint, kind int, client bigint, at bigint, seq bigint, id bigint, cents bigint, op string, "
    "turn bigint, sales_mark bigint, changes_mark bigint, others bigint, floor_at bigint, floor_seq bigint, floor_id bigint, carried boolean"
)
_OUT = "rec string, id bigint, client bigint, batch bigint, n_held bigint, change_id bigint, cents bigint, op string"
#: A store opened anew in each batch would else set aside megabytes of disk before its first row, and keep them and its
#: memory for a minute after its last: it is closed with its task. All stores of an executor share one bound of memory.
_SETTINGS = {
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_VERSION = ("client", "at", "seq", "id", "cents", "op")
_WAITING = ("client", "at", "id")


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    seconds = (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint")
    return F.unix_date(F.to_date(c)).cast("bigint") * 86_400_000_000 + seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def _some(c: Column) -> Column:
    return F.coalesce(c.cast("bigint"), F.lit(LOW))


def numbered(sales: DataFrame, changes: DataFrame, batches: int, first_day: int, days: int, late_days: int) -> DataFrame:
    """Both tables as rows (kind, client, at, seq, id, cents, op, turn); turn is the batch."""
    turn = lambda day: F.when(day.isNull(), batches - 1).otherwise(F.least(F.lit(batches - 1), F.greatest(F.lit(0), F.floor((day - first_day) * batches / days)))).cast("bigint")
    day = lambda c: F.unix_date(F.to_date(c))
    sold = sales.select(F.lit(_SALE).alias("kind"), F.col("client_id").cast("bigint").alias("client"), _some(micros(F.col("sold_at"))).alias("at"), F.lit(LOW).alias("seq"), _some(F.col("sale_id")).alias("id"), F.lit(LOW).alias("cents"), F.lit(None).cast("string").alias("op"), turn(day(F.col("arrived_at"))).alias("turn"))
    plain = [c for c, kind in changes.dtypes if not kind.startswith(("map", "variant"))]
    late = F.coalesce(F.pmod(F.crc32(F.col("change_id").cast("string")), F.lit(late_days)), F.lit(0))
    once = changes.filter("valid_at is not null").dropDuplicates(plain)
    changed = once.select(F.lit(_CHANGE).alias("kind"), F.col("client_id").cast("bigint").alias("client"), micros(F.col("valid_at")).alias("at"), _some(F.col("seq")).alias("seq"), _some(F.col("change_id")).alias("id"), _some(F.floor(100 * F.col("balance") + F.lit(0.5))).alias("cents"), "op", turn(day(F.col("valid_at")) + late).alias("turn"))
    return sold.unionByName(changed)


def watermarks(rows: DataFrame, batches: int, delay: int) -> tuple[list[int], list[int]]:
    """The watermarks of sales and changes in each batch, and at the end."""
    peaks = {(r["kind"], r["turn"]): r["at"] for r in rows.groupBy("kind", "turn").agg(F.max("at").alias("at")).collect()}  # two rows a batch

    def of(kind: int) -> list[int]:
        out, top = [], LOW
        for b in range(batches):
            out.append(top if top == LOW else top - delay)
            top = max(top, peaks.get((kind, b), LOW))
        return [*out, HIGH]

    return of(_SALE), of(_CHANGE)


def _at(values: list[int], turn: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (turn + 1).cast("int"))


def slotted(rows: DataFrame, large: DataFrame, slots: int, slot_rows: int) -> DataFrame:
    """The rows with their slot: (owner, part) is a number of '', or a slice of a large client."""
    slices = F.ceil(F.col("n") / slot_rows)
    width = F.floor((F.col("hi") - F.col("lo")) / slices).cast("bigint") + 1
    part = F.when(F.col("at") == LOW, 0).otherwise(F.floor((F.col("at") - F.col("lo")) / width)).cast("bigint")
    own = F.xxhash64(F.when(F.col("client").isNull(), F.col("id")).otherwise(F.col("client")))
    return rows.join(large, "client", "left").select(
        F.when(F.col("n").isNotNull(), F.col("client").cast("string")).otherwise("").alias("owner"), F.when(F.col("n").isNotNull(), part).otherwise(F.pmod(own, F.lit(slots))).alias("part"), *rows.columns
    )


def slice_clocks(fed: DataFrame, batches: int, h: list[int], mark: list[int]) -> DataFrame:
    """The clock rows of the slices of large clients: (owner, part, turn, others, floor_..., carried, and the carried version)."""
    kept = fed.filter((F.col("kind") == _CHANGE) & (F.col("owner") != "") & (F.col("at") >= _at(mark, F.col("turn")))).select("owner", "part", F.col("turn").alias("b"), F.struct("at", "seq", "id").alias("o"), F.struct("at", "seq", "id", "cents", "op").alias("v"))
    last = [F.max(F.when((F.col("b") <= b) & (F.col("o.at") <= h[b]), F.col("o"))) for b in range(batches)]
    floors = kept.groupBy("owner").agg(F.array(*last).alias("floors"))
    lives = lambda e: (F.col("b") == e) | ((F.col("b") < e) & F.coalesce(F.col("o") >= F.get("floors", F.lit(e - 1)), F.lit(True)))
    turns = range(batches + 1)
    pieces = kept.join(floors, "owner").groupBy("owner", "part").agg(F.array(*(F.count_if(lives(e)) for e in turns)).alias("n"), F.array(*(F.max(F.when(lives(e), F.col("v"))) for e in turns)).alias("v"))
    slices = fed.filter(F.col("owner") != "").select("owner", "part").distinct().join(pieces, ["owner", "part"], "left").join(floors, "owner", "left")
    each = Window.partitionBy("owner")
    before = each.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = lambda e: F.coalesce(F.get("n", F.lit(e)), F.lit(0))
    told = [
        F.struct(F.lit(e).cast("bigint").alias("turn"), (F.sum(held(e)).over(each) - held(e)).alias("others"), F.max(F.get("v", F.lit(e))).over(before).alias("c"), (F.get("floors", F.lit(e)) if e < batches else F.lit(None).cast("struct<at:bigint,seq:bigint,id:bigint>")).alias("f"))
        for e in turns
    ]
    out = slices.select("owner", "part", F.array(*told).alias("all")).select("owner", "part", F.explode("all").alias("t")).select("owner", "part", "t.*")
    return out.select(
        "owner", "part", F.lit(_CLOCK).alias("kind"), F.lit(None).cast("bigint").alias("client"), _some(F.col("c.at")).alias("at"), _some(F.col("c.seq")).alias("seq"), _some(F.col("c.id")).alias("id"), _some(F.col("c.cents")).alias("cents"), F.col("c.op").alias("op"), "turn", "others",
        _some(F.col("f.at")).alias("floor_at"), _some(F.col("f.seq")).alias("floor_seq"), _some(F.col("f.id")).alias("floor_id"), F.col("c").isNotNull().alias("carried"),
    )


def _stack(blocks: Iterator[tuple], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    tables = [pa.ipc.open_stream(b).read_all() for (b,) in blocks]
    if not tables:
        return {c: np.zeros(0, object if c == "op" else np.int64) for c in names}
    table = pa.concat_tables(tables)
    return {c: table[c].to_numpy(zero_copy_only=False) for c in names}


def _packed(rows: dict[str, np.ndarray], most: int = 8192) -> list[tuple[bytes]]:
    table = pa.table({c: pa.array(v, pa.string() if c == "op" else pa.int64()) for c, v in rows.items()})
    out = []
    for batch in table.to_batches(max_chunksize=most):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _join(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {c: np.concatenate((a[c], b[c])) for c in a}


def _take(rows: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {c: v[which] for c, v in rows.items()}


def bisected(versions: dict[str, np.ndarray], sales: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each sale the place of its client's last version at or before its time, or -1, and how many versions the client has.

    versions: sorted by client, at, seq, id.
    """
    clients, first = np.unique(versions["client"], return_index=True)
    n = np.diff(np.append(first, len(versions["client"])))
    if not len(clients):
        return np.full(len(sales["id"]), -1), np.zeros(len(sales["id"]), np.int64)
    code = np.minimum(np.searchsorted(clients, sales["client"]), len(clients) - 1)
    known = clients[code] == sales["client"]
    times = np.unique(versions["at"])
    rank = np.searchsorted(times, versions["at"]) + 1
    keys = np.repeat(np.arange(len(clients)), n) * (len(times) + 1) + rank
    place = np.searchsorted(keys, code * (len(times) + 1) + np.searchsorted(times, sales["at"], side="right"), side="right") - 1
    return np.where(known & (sales["at"] != LOW) & (place >= first[code]), place, -1), np.where(known, n[code], 0)


class Enricher(StatefulProcessor):
    """Takes one batch of one slot; see the module's text."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.versions = handle.getListState("versions", "block binary")
        self.waiting = handle.getListState("waiting", "block binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows), ignore_index=True)
        kind = came["kind"].to_numpy()
        clock = came.iloc[int(np.flatnonzero(kind == _CLOCK)[0])]
        large = key[0] != ""
        h = min(clock["sales_mark"], clock["changes_mark"])
        columns = {c: came[c].to_numpy() for c in _VERSION}
        has_client = columns["client"] != LOW

        below = (kind == _CHANGE) & (columns["at"] < clock["changes_mark"])
        late = _take(columns, below)
        new = _take(columns, (kind == _CHANGE) & ~below & has_client)
        versions = _join(_stack(self.versions.get(), _VERSION), new)
        versions = _take(versions, np.lexsort([versions[c] for c in ("id", "seq", "at", "client")]))

        waiting = _join(_stack(self.waiting.get(), _WAITING), {c: columns[c][kind == _SALE] for c in _WAITING})
        due = (waiting["at"] == LOW) | (waiting["at"] < h)
        sales, waiting = _take(waiting, due), _take(waiting, ~due)
        place, held = bisected(versions, sales)
        known = sales["client"] != LOW
        place = np.where(known, place, -1)
        held = np.where(known, held + int(clock["others"]), 0)
        out = {c: versions[c][place] if len(versions[c]) else np.full(len(place), None if c == "op" else LOW) for c in ("id", "cents", "op")}
        carried = known & (place < 0) & (sales["at"] != LOW) & bool(clock["carried"])
        for c in out:
            out[c] = np.where(carried, clock[c], np.where(place >= 0, out[c], None if c == "op" else LOW))

        if large:
            floor = [clock[f"floor_{c}"] for c in ("at", "seq", "id")]
            at, seq, own = (versions[c] for c in ("at", "seq", "id"))
            stays = ~((at < floor[0]) | ((at == floor[0]) & ((seq < floor[1]) | ((seq == floor[1]) & (own < floor[2])))))
        else:
            settled = versions["at"] <= h
            again = np.append(settled[1:] & (versions["client"][1:] == versions["client"][:-1]), False) if len(settled) else settled
            stays = ~(settled & again)
        versions = _take(versions, stays)
        for state, held_rows in ((self.versions, versions), (self.waiting, waiting)):
            if len(held_rows["id"]):
                state.put(_packed(held_rows))
            else:
                state.clear()

        turn, none = int(clock["turn"]), np.full(len(late["id"]), LOW)
        yield pd.DataFrame(
            {
                "rec": np.array(["sale"] * len(place) + ["late"] * len(none), object),
                "id": np.concatenate((sales["id"], late["id"])),
                "client": np.concatenate((sales["client"], late["client"])),
                "batch": turn,
                "n_held": np.concatenate((held, none)),
                "change_id": np.concatenate((out["id"].astype(np.int64), none)),
                "cents": np.concatenate((out["cents"].astype(np.int64), none)),
                "op": np.concatenate((out["op"], np.full(len(none), None))),
            }
        ).astype({"rec": object, "op": object})  # the worker takes no strings kept in Arrow


def _renamed(spark, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"cannot move {source} to {target}")


def enrich(sales: DataFrame, changes: DataFrame, batches: int = 10, first_day: int = 19723, days: int = 152, late_days: int = 4, delay_hours: int = 36, slot_rows: int = 8192) -> DataFrame:
    """Rows (rec, id, client_id, batch, n_held, change_id, balance_cents, op) of emitted sales and late changes.

    Batch of a sale: the day it arrived, of a change: the day it is valid plus 0 to late_days - 1; days since first_day
    scaled to `batches` over `days`. The tables, the checkpoint and the result lie in a new folder of the shared one at every call.
    """
    spark = sales.sparkSession
    folder = shared_folder(spark)
    numbered(sales, changes, batches, first_day, days, late_days).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    sales_mark, changes_mark = watermarks(rows, batches, delay_hours * 3_600_000_000)
    h = [min(x) for x in zip(sales_mark, changes_mark)]
    time = F.when(F.col("at") != LOW, F.col("at"))
    rows.filter("client is not null").groupBy("client").agg(F.count("*").alias("n"), F.min(time).alias("lo"), F.max(time).alias("hi")).filter(F.col("n") > slot_rows).write.parquet(f"{folder}/large")
    large = spark.read.parquet(f"{folder}/large")
    slots = max(1, -(-rows.count() // slot_rows))

    # The list of large clients is a file of known size, which Spark broadcasts below its threshold and else joins with split skew.
    slotted(rows, large, slots, slot_rows).write.parquet(f"{folder}/slotted")
    fed = spark.read.parquet(f"{folder}/slotted")
    zero = {c: F.lit(0 if c == "others" else LOW).cast("bigint") for c in ("others", "floor_at", "floor_seq", "floor_id")} | {"carried": F.lit(False)}
    turns = F.explode(F.sequence(F.lit(0), F.lit(batches))).alias("turn")
    small = spark.range(slots).select(F.lit("").alias("owner"), F.col("id").alias("part"), turns)
    small = small.select("owner", "part", F.lit(_CLOCK).alias("kind"), F.lit(None).cast("bigint").alias("client"), *(F.lit(LOW).alias(c) for c in ("at", "seq", "id", "cents")), F.lit(None).cast("string").alias("op"), F.col("turn").cast("bigint"), *(v.alias(c) for c, v in zero.items()))
    whole = fed.withColumns(zero).unionByName(small)
    if not large.isEmpty():
        whole = whole.unionByName(slice_clocks(fed, batches, h, changes_mark))
    whole = whole.withColumns({"client": _some(F.col("client")), "sales_mark": _at(sales_mark, F.col("turn")), "changes_mark": _at(changes_mark, F.col("turn")), "batch": F.col("turn")})
    names = [c.strip().split(" ")[0] for c in _FED.split(",")]
    whole.select(*names, "batch").hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{folder}/staged")

    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        for b in range(batches + 1):
            if b == 0:
                spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/feed").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/feed"))
            _renamed(spark, f"{folder}/staged/batch={b}", f"{folder}/feed/{b}")
            stream = spark.readStream.schema(_FED).parquet(f"{folder}/feed/*")
            told = stream.groupBy("owner", "part").transformWithStateInPandas(Enricher(), _OUT, "append", "None")
            query = told.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for spent in ("rows", "large", "slotted", "staged", "feed", "checkpoint"):
        drop_table(spark, f"{folder}/{spent}")
    known = lambda c: F.when(F.col(c) != LOW, F.col(c))
    return spark.read.schema(_OUT).parquet(f"{folder}/out").select("rec", known("id").alias("id"), known("client").alias("client_id"), "batch", known("n_held").alias("n_held"), known("change_id").alias("change_id"), known("cents").alias("balance_cents"), "op")
