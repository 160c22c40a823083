"""Cutting lineage with tables in the folder that the whole cluster shares.

Iterative plans grow without bound unless each superstep ends in storage.  A step
is written as Parquet under ``spark.checkpoint.dir`` rather than kept in executor
memory, so a lost executor costs nothing but the running task, and the next step
starts from a plain file scan that AQE can size.

All tables of one Spark application lie in one folder, ``graphloom-<application>``.
Operators delete what no later plan reads; what a returned DataFrame still reads
stays until ``clean_up(spark)`` or the end of the application, which delete the folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_fallback: list[str] = []
_marked: set[str] = set()
_tables: dict[str, set[str]] = {}


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under the one named in ``spark.checkpoint.dir``.

    Where that is unset, a temporary one, on a local master only: executors of a cluster do not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _fallback:
            _fallback.append(tempfile.mkdtemp(prefix="graphloom-"))
            atexit.register(shutil.rmtree, _fallback[0], ignore_errors=True)
        named = f"file://{_fallback[0]}"
    path = f"{named.rstrip('/')}/graphloom-{spark.sparkContext.applicationId}"
    if path not in _marked:
        fs, target = _hadoop(spark, path)
        fs.mkdirs(target)
        fs.deleteOnExit(target)
        _marked.add(path)
    return path


def clean_up(spark: SparkSession) -> None:
    """Delete all tables of this application.  DataFrames that operators have returned cannot be read any more."""
    for table in _tables.pop(spark.sparkContext.applicationId, set()):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    path = shared_dir(spark)
    fs, target = _hadoop(spark, path)
    fs.delete(target, True)
    _marked.discard(path)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def materialize_watched(df: DataFrame, name: str = "step", **watched: Column) -> tuple[DataFrame, dict]:
    """``materialize``, and aggregates over the rows that are taken while they are written, without a job of their own.

    Where a stage runs twice its rows may count twice, so sums and counts are for choosing plans; least and most are exact.
    """
    seen = Observation()
    table = materialize(df.observe(seen, *[c.alias(k) for k, c in watched.items()]), name)
    found = seen.get
    return table, found if set(found) == set(watched) else table.agg(*[c.alias(k) for k, c in watched.items()]).head().asDict()


def discard(*tables: DataFrame | None) -> None:
    """Delete the tables behind ``materialize`` and ``materialize_bucketed`` results that no later plan reads."""
    for df in tables:
        discard(*getattr(df, "_graphloom_parts", ()))
        path = getattr(df, "_graphloom_path", None)
        if not path:
            continue
        spark = df.sparkSession
        table = getattr(df, "_graphloom_table", None)
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            _tables.get(spark.sparkContext.applicationId, set()).discard(table)
        fs, target = _hadoop(spark, path)
        fs.delete(target, True)


def passed_on(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, a view of the materialized ``tables``, as something that ``discard`` knows."""
    df._graphloom_parts = tables
    return df


def materialize_bucketed(df: DataFrame, column: str, name: str = "table", buckets: int | None = None, exchange: bool = True) -> DataFrame:
    """``df`` as a bucketed and sorted table in the shared folder: joins on ``column`` then leave it where it is.

    Without ``exchange`` every task writes a file for each bucket that it has rows of, which suits few, large rows.
    """
    spark = df.sparkSession
    table = f"graphloom_{name}_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{table}"
    (df.repartition(n, column) if exchange else df).write.format("parquet").option("path", path).bucketBy(n, column).sortBy(column).saveAsTable(table)
    _tables.setdefault(spark.sparkContext.applicationId, set()).add(table)
    out = spark.table(table)
    out._graphloom_path, out._graphloom_table = path, table
    return out


discard_table = discard
