"""The folder that driver and executors share, and durable cuts of a lineage there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a temporary folder of this machine stands in if
    everything runs on this machine; on a cluster that is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexspark-"))
    return context._jsc.sc().getCheckpointDir().get()


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in files that survive lost executors."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def staged(frame: DataFrame, name: str) -> DataFrame:
    """As cut(), for wide rows: a Parquet table in the shared folder, compressed and columnar."""
    spark = frame.sparkSession
    path = workspace(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder or file through the file system that holds it, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """The text as one file that is there whole or not at all: written under another name beside its place,
    then renamed over what stood there."""
    jvm = spark._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(part, True)
    out.write(bytearray(text.encode("utf-8", "surrogatepass")))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    whole = files.makeQualified(target)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(part), whole, over)
