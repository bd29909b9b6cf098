"""Corpus preparation: conflicting labels, duplicates, counts, prevalence and medians."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T


def conflicting_keys(rows: DataFrame, key: str | Column, label: str) -> DataFrame:
    """(key, n_labels, n_rows) of keys that carry more than one label."""
    key = F.col(key) if isinstance(key, str) else key
    found = rows.groupBy(key.alias("key")).agg(F.countDistinct(label).cast("bigint").alias("n_labels"), F.count("*").cast("bigint").alias("n_rows"))
    return found.where("n_labels > 1")


def raise_on_conflicts(rows: DataFrame, key: str, label: str) -> DataFrame:
    """The rows as they are; an error if any key of raw text carries two labels."""
    if not conflicting_keys(rows, key, label).isEmpty():
        raise ValueError(f"texts with conflicting {label}")
    return rows


def drop_conflicts(rows: DataFrame, key: str, label: str) -> DataFrame:
    """All copies of a conflicting key go; before any removal of duplicates."""
    bad = conflicting_keys(rows, key, label).select(F.col("key").alias(key))
    return rows.join(bad, key, "left_anti")


def only_conflicts(rows: DataFrame, key: str, label: str) -> DataFrame:
    bad = conflicting_keys(rows, key, label).select(F.col("key").alias(key))
    return rows.join(bad, key, "left_semi")


def prepare(rows: DataFrame, key: str, text: str, label: str, tokens: Callable[[str], Column] | None = None) -> DataFrame:
    """The prepared corpus: texts in normal form, none empty, none with two labels, each once (the row of least
    key); with uid, n_chars, n_lines and n_tokens. tokens: a text column to its number of tokens, by default
    the number of words."""
    count = tokens or (lambda c: F.size(T.words(c)))
    normal = T.non_empty(rows.withColumn("code", T.normalize(text)), "code").withColumns({"__h1": F.xxhash64("code"), "__h2": F.xxhash64(F.lit(1), F.col("code"))})
    bad = normal.groupBy("__h1", "__h2").agg(F.min(label).alias("__a"), F.max(label).alias("__b")).where("__a <> __b").select("__h1", "__h2")
    once = keep_first(normal.join(bad, ["__h1", "__h2"], "left_anti"), ["__h1", "__h2"], [key]).drop("__h1", "__h2")
    return once.withColumns({"uid": T.content_key("code"), "n_chars": F.length("code").cast("bigint"), "n_lines": T.line_count("code"), "n_tokens": count("code").cast("bigint")})


def keep_first(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order, by partial aggregation rather than a window: a hot
    key never gathers in one task."""
    whole = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], F.struct(*rows.columns).alias("__row"))
    return rows.groupBy(*[F.xxhash64(*keys).alias("__h")], *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(whole).alias("__m")).select("__m.__row.*")


def duplicate_count(rows: DataFrame, key: str) -> DataFrame:
    """One row: keys that repeat, and rows beyond each key's first."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("bigint").alias("n_repeated_keys"), F.sum(F.col("n") - 1).cast("bigint").alias("n_extra_rows"))


def frequency(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").cast("bigint").alias("n"))


def rates(rows: DataFrame, flags: list[str], *keys: str) -> DataFrame:
    """Mean of each flag, overall or by key."""
    return rows.groupBy(*keys).agg(F.count("*").cast("bigint").alias("n"), *[F.round(F.avg(f), 6).alias(f"{f}_rate") for f in flags])


def exact_quantiles(rows: DataFrame, value: str, points: dict[str, float], *keys: str) -> DataFrame:
    """Exact quantiles with linear interpolation. Spark's percentile aggregates counts by value, so copies
    of a value take one entry."""
    return rows.groupBy(*keys).agg(*[F.round(F.percentile(value, p), 6).alias(name) for name, p in points.items()])


def relative_gap(a: Column, b: Column) -> Column:
    most = F.greatest(a, b)
    return F.when(most == 0, F.lit(0.0)).otherwise(F.abs(a - b) / most)


def crosstab(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    return rows.groupBy(F.col(outer).cast("bigint").alias(outer), F.col(inner).cast("bigint").alias(inner)).agg(F.count("*").cast("bigint").alias("n"))


def mask_none(flags: list[str]) -> Column:
    """True where no flag is set."""
    any_set = F.lit(False)
    for f in flags:
        any_set = any_set | (F.col(f) > 0)
    return ~any_set


def latest_by_key(log: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Of an append-only log the last write of each key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(key, *[F.col(f"v.{v}").alias(v) for v in values])


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key the log doesn't hold."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def first_n(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("__n") <= n).drop("__n")


def hold_out(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Rows of none of the groups, in either spelling (a slash may stand as an underscore)."""
    names = groups.select(F.col(key)).union(groups.select(F.regexp_replace(key, "/", "_"))).distinct()
    left = rows.join(names, key, "left_anti")
    return left


def audit_join(audit: DataFrame, facts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(audited rows with their facts, keys of those that have none)."""
    return audit.join(facts, key), audit.join(facts, key, "left_anti").select(key)


def both_sides(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join that tells which side is missing."""
    a = before.withColumn("__a", F.lit(1))
    b = after.withColumn("__b", F.lit(1))
    joined = a.join(b, key, "full_outer")
    side = F.when(F.col("__b").isNull(), "before_only").when(F.col("__a").isNull(), "after_only").otherwise("both")
    return joined.withColumn("side", side).drop("__a", "__b")
