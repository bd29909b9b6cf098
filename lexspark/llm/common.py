"""What the operators of this subpackage share: reading, durable cuts, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.batches import SLICE_BYTES, arrow_batch, slices  # noqa: F401  for the operators
from lexspark.plans.storage import cut, drop, shared_dir, staged, workspace  # noqa: F401  for the operators

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> "F.Column":
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_arrow(frame: DataFrame, step: Callable, schema: str) -> DataFrame:
    return frame.mapInArrow(step, schema)
