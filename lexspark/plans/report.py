"""Small tables as Markdown, and sentences that follow from the numbers."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.plans.storage import write_text

DASH = "—"


def number(x, digits: int = 4) -> str:
    """Null, NaN and infinities as a dash, integers as they are, others with fixed decimals."""
    if x is None or (isinstance(x, float) and not math.isfinite(x)):
        return DASH
    if isinstance(x, bool):
        return "yes" if x else "no"
    return f"{x:.{digits}f}" if isinstance(x, float) else str(x)


def markdown(rows: DataFrame, title: str = "", most: int = 500, digits: int = 4) -> str:
    """A report table of up to `most` rows."""
    head = [f"## {title}", ""] if title else []
    lines = [f"| {' | '.join(rows.columns)} |", f"|{'-|' * len(rows.columns)}"]
    lines += [f"| {' | '.join(number(v, digits) for v in r)} |" for r in rows.limit(most).collect()]
    return "\n".join([*head, *lines, ""])


def widest(intervals: list[tuple[str, float, float]]) -> str | None:
    """The name of the widest interval; a missing end counts as widest."""
    return max(intervals, key=lambda x: math.inf if x[1] is None or x[2] is None else x[2] - x[1])[0] if intervals else None


def compare(name: str, value: float | None, reference: float | None) -> str:
    if value is None or reference is None:
        return f"{name}: no comparison."
    word = "above" if value > reference else "below" if value < reference else "level with"
    return f"{name}: {number(value)} is {word} {number(reference)}."


def verdict(decision: str) -> str:
    return {"proceed": "All claims hold: proceed.", "stop": "A claim failed: stop and write up.", "inconclusive": "No claim failed, but not all could be decided."}[decision]


def write_json(rows: DataFrame, path: str, most: int = 100_000) -> None:
    """A report's rows as one file, one JSON object a line, keys in the columns' order; NaN becomes null. The
    file is there whole or not at all. For tables of up to `most` rows; larger ones are an error."""
    clean = rows.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in rows.schema.fields])
    lines = clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("j")).limit(most + 1).collect()
    if len(lines) > most:
        raise ValueError(f"more than {most} rows")
    write_text(rows.sparkSession, "".join(f"{r.j}\n" for r in lines), path)


CLAIM_WORDS = {True: "holds", False: "fails", None: "can't be decided"}


def main_report(title: str, decision: str, claims: dict[str, bool | None], sections: list[tuple[str, DataFrame | None, list[str]]]) -> str:
    """The verdict, a table of the claims, and a section for each (heading, table, sentences); sections whose
    table is missing are named as left out."""
    lines = [f"# {title}", "", f"**{verdict(decision)}**", "", "| claim | outcome |", "|-|-|", *(f"| {name} | {CLAIM_WORDS[held]} |" for name, held in claims.items()), ""]
    left_out = []
    for heading, table, sentences in sections:
        if table is None:
            left_out.append(heading)
            continue
        lines += [markdown(table, heading), *sentences, ""]
    failed = [name for name, held in claims.items() if held is False]
    if failed:
        lines += [f"Failed: {', '.join(failed)}.", ""]
    if left_out:
        lines += [f"Left out, for lack of a table: {', '.join(left_out)}.", ""]
    return "\n".join(lines)


def stage_report(name: str, rows: DataFrame, failed_checks: str | None, seconds: float | None) -> str:
    outcome = "all checks passed" if not failed_checks else f"failed checks: {failed_checks}"
    return "\n".join([markdown(rows, name), f"{outcome}; {number(seconds, 1)} s.", ""])


def write_reports(spark: SparkSession, root: str, path: str, names: list[str], log: DataFrame) -> DataFrame:
    """A Markdown file for each stage whose table is there, below `path`, and index.md with their sizes.
    Returns (stage, file, n_bytes), file null for stages without a table. log: the runner's markers."""
    marks = {r.stage: r for r in log.groupBy("stage").agg(F.max_by("failed_checks", "at").alias("failed_checks"), F.max_by("seconds", "at").alias("seconds")).collect()}
    found = []
    for k, name in enumerate(names, 1):
        try:
            rows = spark.read.parquet(f"{root}/{name}")
        except AnalysisException:
            found.append((name, None, None))
            continue
        mark = marks.get(name)
        text = stage_report(name, rows, mark.failed_checks if mark else None, mark.seconds if mark else None)
        file = f"{k:02d}_{name}.md"
        write_text(spark, text, f"{path}/{file}")
        found.append((name, file, len(text.encode())))
    index = spark.createDataFrame(found, "stage string, file string, n_bytes long")
    write_text(spark, markdown(index, "Reports"), f"{path}/index.md")
    return index


def audit_blocks(rows: DataFrame, key: str, text: str, properties: list[str], carry: list[str] | None = None) -> DataFrame:
    """(key, block, template and the columns of `carry`): a Markdown block a row, and an empty answer sheet."""
    block = F.concat_ws("\n", F.concat(F.lit("### "), F.col(key).cast("string")), F.lit("```"), F.col(text), F.lit("```"))
    sheet = F.to_json(F.struct(*[F.lit(None).cast("int").alias(p) for p in properties]), {"ignoreNullFields": "false"})
    return rows.select(key, *(carry or []), block.alias("block"), sheet.alias("template"))


def histogram(rows: DataFrame, value: str, bins: int = 25) -> DataFrame:
    """Plot data: (bin, low, high, n) over equal bins between the extremes."""
    ends = rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(0))).cast("bigint")
    return rows.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"), "lo", "hi").agg(F.count("*").cast("bigint").alias("n")).select("bin", F.round(F.col("lo") + F.col("bin") * width, 6).alias("low"), F.round(F.col("lo") + (F.col("bin") + 1) * width, 6).alias("high"), "n")


def curve(cells: DataFrame, x: str, value: str, *keys: str) -> DataFrame:
    """Plot data of a curve: (keys, x, mean, std, n_folds), from a row a fold."""
    from lexspark.operators.metrics import fold_summary

    return fold_summary(cells, value, *keys, x)


def bars(cells: DataFrame, value: str, name: str) -> DataFrame:
    """Plot data of bars: (name, mean, std, n_folds, place), the tallest first."""
    from pyspark.sql import Window

    from lexspark.operators.metrics import fold_summary

    return fold_summary(cells, value, name).withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), name)).cast("bigint"))


def transfer_bars(own: DataFrame, other: DataFrame, value: str, fold: str, name: str) -> DataFrame:
    """Plot data: (name, own, other, drop), means over the folds that both have."""
    from lexspark.operators.metrics import rounded

    both = own.select(name, fold, F.col(value).alias("a")).join(other.select(name, fold, F.col(value).alias("b")), [name, fold]).where("a is not null and b is not null")
    return both.groupBy(name).agg(rounded(F.avg("a")).alias("own"), rounded(F.avg("b")).alias("other"), rounded(F.avg(F.col("a") - F.col("b"))).alias("drop"))
