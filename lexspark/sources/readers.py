"""Readers: typed CSV without guesses, many-valued lists, key-value logs, digests, commits from git."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """Strings stay strings: `NA` and the like are text, an empty or missing field is the empty string, quotes are doubled, fields may
    hold line feeds."""
    rows = spark.read.schema(schema).csv(path, header=header, multiLine=True, quote='"', escape='"', emptyValue="", nullValue="\u0000", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rows.fillna("", [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"])


#: What a default CSV scan takes for missing.
NA_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv_na(spark: SparkSession, path: str, schema: StructType | str, key: str) -> DataFrame:
    """As read_csv, with the usual texts for missing values as nulls; the key stays a string as it is
    written, so that one like `123e4567` is no number."""
    wanted = spark.createDataFrame([], schema).schema
    raw = read_csv(spark, path, StructType([StructField(f.name, StringType()) for f in wanted.fields]))
    known = lambda f: F.when(~F.trim(f.name).isin(*NA_TEXTS), F.col(f.name)).try_cast(f.dataType)
    return raw.select(*[F.col(f.name).cast("string").alias(f.name) if f.name == key else known(f).alias(f.name) for f in wanted.fields])


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """The prepared corpus as a stage left it, read again by each later stage; only the columns that a query
    names are scanned."""
    return spark.read.parquet(path)


def explode_list(rows: DataFrame, key: str, many: str, separator: str = ";") -> DataFrame:
    """(key, position, value): values of a separated list, trimmed, without empty ones and repeats."""
    values = F.array_distinct(F.filter(F.transform(F.split(many, separator), lambda x: F.trim(x)), lambda x: x != ""))
    return rows.where(F.col(many).isNotNull()).select(key, F.posexplode(values).alias("position", "value")).withColumn("position", F.col("position").cast("bigint"))


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True).option("allowNonNumericNumbers", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(k, v of the last write of each key; one row with the number of unreadable lines) of JSON lines
    {"k": ..., "v": ...}. Later lines count, by file name and place in the file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at")).where("trim(value) <> ''")
    parsed = lines.withColumn("j", F.try_parse_json("value"))
    good = parsed.select(F.try_variant_get("j", "$.k", "string").alias("k"), F.to_json(F.try_variant_get("j", "$.v", "variant")).alias("v"), "file", "at")
    latest = good.where("k is not null").groupBy("k").agg(F.max_by("v", F.struct("file", "at")).alias("v"))
    return latest, good.agg(F.sum(F.col("k").isNull().cast("int")).cast("bigint").alias("n_bad"))


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest): the first 16 hex digits of each file's SHA-256."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring(F.sha2("content", 256), 1, 16).alias("digest"))


def value_digest(*columns: str) -> "F.Column":
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16)


class _Repository(InputPartition):
    def __init__(self, owner: str, commits: list[str]):
        self.owner, self.commits = owner, commits


class GitReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        """One for each repository of `commits`: owner/name=sha,sha;..."""
        out = []
        for part in filter(None, self.options["commits"].split(";")):
            owner, _, commits = part.partition("=")
            out.append(_Repository(owner.strip(), [c.strip() for c in commits.split(",") if c.strip()]))
        return out

    def _git(self, where: str, *args: str, timeout: int = 600) -> str:
        done = subprocess.run(["git", "-C", where, *args], capture_output=True, timeout=timeout)
        if done.returncode:
            raise OSError(done.stderr.decode(errors="replace")[:300])
        return done.stdout.decode(errors="replace")

    def read(self, partition):
        where = os.path.join(self.options["cache"], partition.owner.replace("/", "_"))
        os.makedirs(where, exist_ok=True)
        if not os.path.isdir(os.path.join(where, ".git")):
            self._git(where, "init", "-q")
        for sha in partition.commits:
            try:
                url = self.options.get("base", "https://github.com/") + partition.owner
                try:
                    self._git(where, "cat-file", "-e", f"{sha}^")
                except OSError:
                    self._git(where, "fetch", "-q", "--depth", "2", "--filter=blob:none", url, sha)
                about = self._git(where, "show", "-s", "--format=%an%x00%aI%x00%s", sha, timeout=120).rstrip("\n").split("\0")
                for line in self._git(where, "diff", "--name-status", "-M", f"{sha}^", sha, timeout=120).splitlines():
                    status, *paths = line.split("\t")
                    yield (partition.owner, sha, *about, status[0], paths[-1], self._blob(where, f"{sha}^", paths[0]), self._blob(where, sha, paths[-1]), None)
            except (OSError, subprocess.TimeoutExpired) as problem:
                yield (partition.owner, sha, *[None] * 7, str(problem)[:300])

    def _blob(self, where: str, revision: str, path: str) -> str | None:
        try:
            return self._git(where, "show", f"{revision}:{path}", timeout=120)
        except OSError:
            return None


class GitCommits(DataSource):
    """Changed files of commits against their first parents, one partition a repository. A commit that
    can't be had gives one row with `error`. Option `cache` names a folder of the executor's own machine, for
    clones that only the task which made them reads; a lost one is fetched again. Register with
    spark.dataSource.register(GitCommits)."""

    @classmethod
    def name(cls):
        return "git_commits"

    def schema(self):
        return "repository string, sha string, author string, date string, subject string, status string, path string, before string, after string, error string"

    def reader(self, schema):
        return GitReader(self.options)
