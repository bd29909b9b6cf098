"""A pre-registered decision over metric tables, in SQL's three-valued logic: null is inconclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA, LEAST_PAIRS, FLOOR = 0.05, 40, 0.8


def first_claim(p: Column, mean_diff: Column, alpha: float = ALPHA) -> Column:
    return (p < alpha) & (mean_diff > 0)


def framings(tests: dict[str, dict[str, Column]], primary: str, alpha: float = ALPHA) -> dict[str, Column]:
    """Whether each framing of the first claim holds, and as `first` whether the primary one does. tests: for
    each framing what metrics.paired_test gives."""
    out = {name: F.coalesce(first_claim(t["p"], t["mean_diff"], alpha), F.lit(False)) for name, t in tests.items()}
    return {**out, "first": out[primary]}


def second_claim(own_mean: Column, other_mean: Column) -> Column:
    return own_mean > other_mean


def third_claim(n: Column, accuracy: Column, p: Column, alpha: float = ALPHA, least: int = LEAST_PAIRS) -> Column:
    return F.when((n >= least) & accuracy.isNotNull(), (accuracy > 0.5) & (p < alpha))


def overall(*claims: Column) -> Column:
    all_true, some_false = F.lit(True), F.lit(False)
    for c in claims:
        all_true, some_false = all_true & F.coalesce(c, F.lit(False)), some_false | F.coalesce(~c, F.lit(False))
    return F.when(all_true, "proceed").when(some_false, "stop").otherwise("inconclusive")


def keep_precise(properties: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Properties whose precision is known and reaches the floor."""
    return properties.where(F.col("precision").isNotNull() & ~F.isnan("precision") & (F.col("precision") >= floor))


def split_verdict(ap: Column, selectivity: Column, prior: Column) -> Column:
    return F.when((ap > prior) & (selectivity > 0), "structural").when(ap > prior, "above_prior_only").otherwise("absent")


def failing(checks: dict[str, Column], rows: DataFrame) -> DataFrame:
    """One row: whether all boolean checks hold, and the names of those that don't."""
    names = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()])
    kept = F.filter(names, lambda x: x.isNotNull())
    return rows.select((F.size(kept) == 0).cast("bigint").alias("passed"), F.array_join(F.sort_array(kept), ",").alias("failing"))
