"""Keyed work that can stop anywhere and go on: each batch's results are appended, and keys that have a result
aren't worked on again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lexspark.operators.corpus import pending


def _done(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def run_pending(work: DataFrame, key: str, do: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """do() over the keys without a result; all results, one row a key, as a table at `path`."""
    done = _done(work.sparkSession, path)
    left = work.dropDuplicates([key]) if done is None else pending(work.dropDuplicates([key]), done, key)
    if done is None or not left.isEmpty():
        do(left).write.mode("append").parquet(path)
    return work.sparkSession.read.parquet(path)


def stream_pending(spark: SparkSession, source: str, schema, key: str, do: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """The same over files that arrive in a folder: all that is there now, each file once."""
    stream = spark.readStream.schema(schema).parquet(source)

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            run_pending(rows, key, do, path)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
