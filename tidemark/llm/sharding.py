"""Sharding by a permutation-filled lookup table, in built-in column expressions only.

Each shard has its own preference order of the slots of a prime-sized table, from an offset and a skip taken
from its name; shards claim their next free slot in turns until the table is full. A key hashes to a slot, and a
broadcast join of the table (one row a slot: the size is the parameter) gives its shard. Slot counts of any two
shards differ by one at most, and when a shard leaves, few keys of other shards move.

Null ids hash as the empty string, so that every row gets a shard. Repeated ids share theirs. Texts are not read. An
empty table gives an empty result. Input columns called slot or shard are replaced; any others may have any name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh


def fill(shards: list[str], size: int) -> list[int]:
    """The shard number of each slot."""
    if not shards or size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime, not below the number of shards")
    orders = []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        orders.append([int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:16], "big") % (size - 1) + 1])
    table, left = [-1] * size, size
    while left:
        for shard, order in enumerate(orders):
            slot, skip = order
            while table[slot] >= 0:
                slot = (slot + skip) % size
            table[slot], order[0] = shard, (slot + skip) % size
            left -= 1
            if not left:
                break
    return table


def place(docs: DataFrame, shards: list[str] | None = None, size: int = 8191, id_col: str = "doc_id") -> DataFrame:
    """The input rows and columns, with slot and shard behind them. Input columns of these two names are replaced."""
    shards = shards or [f"shard-{i:03d}" for i in range(64)]
    table = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, fill(shards, size)))), ",")).alias("slot", "shard"))
    key, found = fresh("_slot", docs.columns), fresh("_shard", docs.columns)
    table = table.select(F.col("slot").alias(key), F.col("shard").cast("int").alias(found))
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    slot = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("int")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("slot", "shard")]
    return docs.withColumn(key, slot).join(F.broadcast(table), key).select(*own, F.col(key).alias("slot"), F.col(found).alias("shard"))


def oracle(shards: list[str] | None = None, size: int = 8191) -> str:
    shards = shards or [f"shard-{i:03d}" for i in range(64)]
    return f"""
        WITH spot AS (
            SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {size} AS INTEGER) AS slot FROM documents
        ), filled AS (SELECT {fill(shards, size)} AS shards)
        SELECT doc_id, slot, CAST(shards[slot + 1] AS INTEGER) AS shard FROM spot, filled"""
