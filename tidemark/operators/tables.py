"""Operators over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: str | tuple[str, ...], *order: Column) -> DataFrame:
    """One row a key, of one column or several: the first in the order, which must be total for a fixed result."""
    place = F.row_number().over(Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def merge_by_id(old: DataFrame, new: DataFrame, key: str, at: str, now: Column, days: int, most: int, turn: str | None = None) -> DataFrame:
    """Upsert: new rows win, undated rows and those within the retention stay, the newest `most` are kept.

    Of rows of one table that share a key the last in the order of `turn` wins, a column of the input's order; without
    one the latest date, then the last by all columns that can be compared. So the result does not depend on partitions.
    """
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    plain = [c for c, kind in both.dtypes if c != "_turn" and "map<" not in kind and "variant" not in kind]
    order = [F.desc(turn)] if turn else [F.desc(at), *map(F.desc, plain)]
    last = first_wins(both, key, F.desc("_turn"), *order).drop("_turn")
    kept = last.filter(F.col(at).isNull() | (F.col(at) >= now - F.expr(f"INTERVAL {days} DAYS")))
    return kept.orderBy(F.desc(at), F.asc(key)).limit(most)


def active(df: DataFrame, at: str, now: Column, days: int = 7) -> DataFrame:
    """Rows of the last days; later ones stay, and undated ones, which count as now."""
    return df.filter(F.col(at).isNull() | (F.col(at) >= now - F.expr(f"INTERVAL {days} DAYS")))


def diverse_top(df: DataFrame, category: str, order: list[Column], cap: int = 4, most: int = 18, caps: dict[str, int] | None = None) -> DataFrame:
    """The best rows with at most `cap` (or its own cap) of each category."""
    limit = F.lit(cap)
    for name, n in (caps or {}).items():
        limit = F.when(F.col(category) == name, n).otherwise(limit)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(category).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= limit).drop("_rank").orderBy(*order).limit(most)


def summary(df: DataFrame, *columns: str) -> DataFrame:
    """Counts by each column, as (dimension, value, n), in one pass: each row gives a pair a column, which partial sums shrink before the shuffle."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def top_of_each(df: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    """The first `most` rows of each key in the order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def unseen(new: DataFrame, stored: DataFrame, key: str, *order: Column) -> DataFrame:
    """Rows whose key is not stored yet, the first of each key in the order."""
    return first_wins(new.join(stored.select(key).distinct(), key, "left_anti"), key, *order)


def unseen_or_nameless(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows without a key, and those whose key is not stored."""
    named = new.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return new.filter(F.col(key).isNull() | (F.col(key).cast("string") == "")).unionByName(named.join(stored.select(key).distinct(), key, "left_anti").select(*new.columns))


def replace_collector(old: DataFrame, new: DataFrame, column: str, name: str) -> DataFrame:
    """All rows but those of a collector, and its new ones."""
    return old.filter(~F.col(column).eqNullSafe(F.lit(name))).unionByName(new, allowMissingColumns=True)


def store_key(*columns: Column) -> Column:
    """The first of an id, a canonical URL and a URL that is there."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns))


def newest(df: DataFrame, at: Column, most: int, *ties: Column) -> DataFrame:
    """The newest rows, as by their ISO times read as text; undated ones last."""
    return df.orderBy(F.desc(F.coalesce(at.cast("string"), F.lit(""))), *ties).limit(most)


def numbered_batches(df: DataFrame, size: int, *order: Column) -> DataFrame:
    """Rows with the number of their batch of `size`, from 0. The order is global: for lists of queries, not for large tables."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / max(1, size)).cast("int"))
