"""Additive counters by key, reductions, scans and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import running_sum


def add_counts(events: DataFrame, key: str = "key", amount: Column | None = None) -> DataFrame:
    """``key, value``: the sum of the amounts (default 1) of each key."""
    return events.groupBy(F.col(key).alias("key")).agg(F.sum(amount if amount is not None else F.lit(1)).cast("long").alias("value"))


def merge_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("key").agg(F.sum("value").cast("long").alias("value"))


def find(counts: DataFrame, key: int) -> DataFrame:
    return counts.where(F.col("key") == key)


def top_keys(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest values, of equal ones the larger key first."""
    return counts.orderBy(F.desc("value"), F.desc("key")).limit(k)


def updated_keys(counts: DataFrame) -> DataFrame:
    return counts.where("value <> 0").select("key")


def reduce_values(values: DataFrame, column: str = "value") -> DataFrame:
    return values.agg(F.sum(column).alias("sum"), F.min(column).alias("least"), F.max(column).alias("most"), F.count(column).alias("n"))


def scan(values: DataFrame, inclusive: bool = False, backward: bool = False, width: int = 1 << 16) -> DataFrame:
    """``id, value, before``: running sums in the order of ids."""
    return running_sum(values, width, inclusive, backward)


def pack(values: DataFrame, predicate: Column) -> DataFrame:
    """The ids of the rows that pass, numbered from 0 in order: ``id, position``."""
    kept = values.where(predicate).select("id", F.lit(1).cast("long").alias("value"))
    return running_sum(kept, 1 << 16).select("id", F.col("before").alias("position"))


def summary(values: DataFrame, column: str = "value") -> DataFrame:
    return values.agg(F.avg(column).alias("mean"), F.percentile(column, 0.5).alias("median"), F.min(column).alias("least"))
