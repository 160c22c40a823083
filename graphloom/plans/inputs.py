"""Graphs derived from relational tables, as DataFrames and as SQL.

``order``: customer to part, weight = least whole quantity.  ``chain``: each customer's orders in order of date,
weight = days between + 1.  ``trust``: user of an event to the user of the next one.  ``rate``: customer to part,
weight = least tenth of the quantity.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph, bucket_number

_kept: dict[tuple, Graph] = {}


def kept(make: Callable[..., Graph]) -> Callable[..., Graph]:
    """A graph is derived and written once in a Spark application; later calls get the written one."""

    @wraps(make)
    def found(spark: SparkSession, sf_dir: str, mirror: bool = False) -> Graph:
        key = (spark.sparkContext.applicationId, make.__name__, sf_dir, mirror)
        if key not in _kept:
            _kept[key] = make(spark, sf_dir, mirror).cache()
        return _kept[key]

    return found


def forget() -> None:
    """Drop the kept graphs, whose tables ``clean_up`` deletes."""
    _kept.clear()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bought(spark: SparkSession, sf_dir: str, *columns: Column) -> tuple[DataFrame, int]:
    """``columns`` of the order lines with their orders, and how many lines there are (which Parquet knows unread)."""
    lines = _table(spark, sf_dir, "lineitem")
    rows = lines.count()
    n = bucket_number(spark, rows)
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(n, "o_orderkey")
    return orders.join(lines.select("l_orderkey", "l_partkey", "l_quantity").repartition(n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(*columns), rows


@kept
def order_graph(spark: SparkSession, sf_dir: str, mirror: bool = False) -> Graph:
    bought, rows = _bought(spark, sf_dir, F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), F.floor("l_quantity").alias("weight"))
    return Graph.from_tables(bought, weight="weight", mirror=mirror, rows=rows)


@kept
def rate_graph(spark: SparkSession, sf_dir: str, mirror: bool = False) -> Graph:
    bought, rows = _bought(spark, sf_dir, F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), F.floor(F.col("l_quantity") / 10).alias("weight"))
    return Graph.from_tables(bought, weight="weight", mirror=mirror, rows=rows)


@kept
def chain_graph(spark: SparkSession, sf_dir: str, mirror: bool = False) -> Graph:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.lead("o_orderkey").over(w).alias("dst"), F.datediff(F.lead("o_orderdate").over(w), "o_orderdate").alias("days"))
    nodes = orders.agg(F.max("o_orderkey")).head()[0]
    return Graph.from_tables(orders.select(F.col("o_orderkey").alias("src"), "dst", (F.col("days") + 1).alias("weight")), weight="weight", mirror=mirror, nodes=(nodes or 0) + 1)


@kept
def trust_graph(spark: SparkSession, sf_dir: str, mirror: bool = False) -> Graph:
    """Successive events meet within hours; the last event of an hour takes its successor from the next hour that has any."""
    events = _table(spark, sf_dir, "events")
    many = events.count()
    e = events.select("user_id", "ts", "event_id", F.date_trunc("hour", "ts").alias("hour"))
    inside = Window.partitionBy("hour").orderBy("ts", "event_id")
    first = e.groupBy("hour").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    later = first.select("hour", F.lead("first").over(Window.orderBy("hour")).alias("after"))
    rows = e.repartition(bucket_number(spark, many), "hour").withColumn("next", F.lead("user_id").over(inside)).join(later, "hour").select(F.col("user_id").alias("src"), F.coalesce("next", "after").alias("dst"))
    return Graph.from_tables(rows, mirror=mirror, rows=many)


ORDER = """orders_ AS (SELECT o_custkey AS src, l_partkey AS dst, CAST(floor(l_quantity) AS BIGINT) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
g AS (SELECT src, dst, min(weight) AS weight FROM orders_ WHERE src <> dst GROUP BY src, dst),
u AS (SELECT src, dst, min(weight) AS weight FROM (SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g) GROUP BY src, dst),
n AS (SELECT greatest(max(src), max(dst)) + 1 AS n FROM orders_),
v AS (SELECT unnest(range(n)) AS id FROM n)"""

RATE = """rate AS (SELECT o_custkey AS src, l_partkey AS dst, min(CAST(floor(l_quantity / 10) AS BIGINT)) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey <> l_partkey GROUP BY o_custkey, l_partkey),
rn AS (SELECT greatest(max(o_custkey), max(l_partkey)) + 1 AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""

CHAIN = """chain_ AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER w AS dst, date_diff('day', CAST(o_orderdate AS DATE), CAST(lead(o_orderdate) OVER w AS DATE)) + 1 AS weight
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
g AS (SELECT src, dst, weight FROM chain_ WHERE dst IS NOT NULL AND src <> dst),
n AS (SELECT max(o_orderkey) + 1 AS n FROM orders),
v AS (SELECT unnest(range(n)) AS id FROM n)"""

TRUST = """trust_ AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events),
g AS (SELECT DISTINCT src, dst, CAST(1 AS BIGINT) AS weight FROM trust_ WHERE dst IS NOT NULL AND src <> dst),
u AS (SELECT src, dst, weight FROM g UNION SELECT dst, src, weight FROM g),
n AS (SELECT greatest(max(src), max(dst)) + 1 AS n FROM trust_ WHERE dst IS NOT NULL),
v AS (SELECT unnest(range(n)) AS id FROM n)"""
