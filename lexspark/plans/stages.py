"""A runner for stages whose results are tables: a stage whose inputs and parameters haven't changed is
skipped, required stages stop the run when they fail, optional ones warn.

Inputs are what a stage needs from others, told apart by the run that wrote them, and source files, told
apart by their paths, sizes and times of change. So new source data, or a stage that was made to run again,
reaches all that stands behind it. Each marker carries the time it was written, its duration and checks."""

from __future__ import annotations

import hashlib
import json
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


@dataclass
class Stage:
    name: str
    run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)
    required: bool = True
    checks: Callable[[DataFrame], dict[str, bool]] | None = None


class Failed(Exception):
    pass


def order(stages: list[Stage]) -> list[Stage]:
    """Stages behind what they need, else in the given order."""
    known, out, left = {s.name for s in stages}, [], list(stages)
    while left:
        ready = next((s for s in left if all(n not in known or any(o.name == n for o in out) for n in s.needs)), None)
        if ready is None:
            raise ValueError("stages need each other")
        out.append(ready)
        left.remove(ready)
    return out


def select(stages: list[Stage], only: list[str] | None = None, start: str | None = None) -> list[Stage]:
    ordered = order(stages)
    if only:
        return [s for s in ordered if s.name in only]
    names = [s.name for s in ordered]
    return ordered[names.index(start) :] if start else ordered


def signature(stage: Stage, inputs: dict[str, str], sources: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps([stage.name, stage.parameters, inputs, sources], sort_keys=True, default=str).encode()).hexdigest()[:16]


def source_digest(spark: SparkSession, path: str) -> str:
    """Of a file, or of all files below a folder: names, sizes and times of change."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*").load(path).select("path", "length", F.col("modificationTime").cast("double").alias("t"))
    found = files.agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.bit_xor(F.xxhash64("path", "length", "t")).alias("x")).first()
    return f"{found.n}:{found['size']}:{found.x}"


MARKS = "stage string, signature string, run string, at double, seconds double, failed_checks string"


class Runner:
    """Tables stand at root/name, their markers in a table at root/_done; the latest marker of a stage counts."""

    def __init__(self, spark: SparkSession, root: str, smoke: bool = False):
        self.spark, self.root, self.smoke = spark, root.rstrip("/") + ("_smoke" if smoke else ""), smoke

    def log(self) -> DataFrame:
        """All markers: stage, signature, run, at, seconds, failed_checks."""
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(MARKS).json(f"{self.root}/_done")
        except AnalysisException:
            return self.spark.createDataFrame([], MARKS)

    def marks(self) -> dict[str, tuple[str, str]]:
        """Signature and run of each stage's latest marker."""
        latest = self.log().groupBy("stage").agg(F.max_by(F.struct("signature", "run"), F.struct("at", "run")).alias("m"))
        return {r.stage: (r.m.signature, r.m.run) for r in latest.collect()}

    def run(self, stages: list[Stage], *, only: list[str] | None = None, start: str | None = None, force: bool = False) -> dict[str, str]:
        """What became of each stage: done, skipped, or failed: why. In a smoke run checks that fail are
        noted, and stop nothing."""
        out: dict[str, str] = {}
        for stage in select(stages, only, start):
            marks = self.marks()
            own = signature(stage, {n: marks.get(n, ("", ""))[1] for n in stage.needs}, {p: source_digest(self.spark, p) for p in stage.sources})
            if not force and marks.get(stage.name, ("",))[0] == own:
                out[stage.name] = "skipped"
                continue
            began, bad = time.time(), []
            try:
                inputs = {n: self.spark.read.parquet(f"{self.root}/{n}") for n in stage.needs}
                stage.run(self.spark, inputs).write.mode("overwrite").parquet(f"{self.root}/{stage.name}")
                if stage.checks:
                    bad = [k for k, v in stage.checks(self.spark.read.parquet(f"{self.root}/{stage.name}")).items() if isinstance(v, bool) and not v]
                    if bad and not self.smoke:
                        raise Failed(", ".join(bad))
            except Exception as problem:
                log.warning("stage %s failed: %s", stage.name, problem)
                out[stage.name] = f"failed: {problem}"
                if stage.required:
                    return out
                continue
            seconds = time.time() - began
            log.info("stage %s took %.1f s", stage.name, seconds)
            mark = (stage.name, own, uuid.uuid4().hex, time.time(), seconds, ", ".join(bad))
            self.spark.createDataFrame([mark], MARKS).coalesce(1).write.mode("append").json(f"{self.root}/_done")
            out[stage.name] = "done"
        return out
