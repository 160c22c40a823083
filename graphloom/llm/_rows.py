"""Columns that pass through an operator beside the ones it reads, and the size of the batches that workers get."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on Arrow batches of the session have about ``most`` bytes at most, unless it has a bound already.

    Spark's own bound is 10,000 rows, which is tens of megabytes of text, several times over, for each running task.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(most))


def carried(columns: tuple[str, ...]) -> list[Column]:
    """One struct column ``row`` that holds the given columns, whatever they are named; nothing for none."""
    return [F.struct(*[F.col(c) for c in columns]).alias("row")] if columns else []


def carried_type(base: DataFrame) -> str:
    """What ``row`` adds to a schema string."""
    return f", row {base.schema['row'].dataType.simpleString()}" if "row" in base.columns else ""


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column, which is in the carried ``row`` if the batch has none of its own."""
    return batch[column] if column in batch.schema.names else pc.struct_field(batch["row"], column)


def row_of(batch: pa.RecordBatch) -> tuple[list[pa.Array], list[str]]:
    """The carried column of a batch and its name, in lists; empty lists where nothing is carried."""
    return ([batch["row"]], ["row"]) if "row" in batch.schema.names else ([], [])
