"""Ranking metrics, confusion counts, fold summaries and exact small-sample tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T

#: Fixed value: the 0.975 quantile of the normal distribution.
Z975 = 1.959963984540054


def rounded(x: Column) -> Column:
    """To six places; first to ten, so that halves which arithmetic leaves a bit short go up too."""
    return F.round(F.round(x, 10), 6)


def _levels(scored: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Counts by distinct score, before any window: windows then run over score levels, not rows."""
    return scored.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("__s")).agg(F.sum(label).cast("double").alias("__p"), F.count("*").cast("double").alias("__c"))


#: Ranges into which a key's score levels are cut for running sums.
RANGES = 256


def _running(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Levels with `__pp`, `__cc`: positives and rows of lower scores, `__np`, `__n`: of the key. A key's
    levels lie in ranges between approximate quantiles; sums over ranges and within each range give the
    whole, so no task has to sort all levels of a key."""
    points = [k / RANGES for k in range(1, RANGES)]
    cuts = levels.agg(F.percentile_approx("__s", F.array(*[F.lit(x) for x in points]), F.lit(20 * RANGES)).alias("__cuts"))
    placed = levels.crossJoin(F.broadcast(cuts)).withColumn("__cell", F.size(F.filter("__cuts", lambda c: c < F.col("__s")))).drop("__cuts")
    cells = placed.groupBy(*keys, "__cell").agg(F.sum("__p").alias("__cp"), F.sum("__c").alias("__cn"))
    below = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    zero = F.lit(0.0)
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    before = cells.select(*named, F.col("__cell").alias("__at"), F.coalesce(F.sum("__cp").over(below), zero).alias("__bp"), F.coalesce(F.sum("__cn").over(below), zero).alias("__bc"), F.sum("__cp").over(whole).alias("__np"), F.sum("__cn").over(whole).alias("__n"))
    same = F.col("__cell") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys, "__cell").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c: F.coalesce(F.sum(c).over(inside), zero)
    return placed.withColumns({"__ip": run("__p"), "__ic": run("__c")}).join(before, same).select(*keys, "__s", "__p", "__c", (F.col("__bp") + F.col("__ip")).alias("__pp"), (F.col("__bc") + F.col("__ic")).alias("__cc"), "__np", "__n")


def average_precision(scored: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """(keys, ap, n, n_pos): sum over distinct scores of recall gained times precision; ties are one step."""
    keys = list(keys)
    steps = _running(_levels(scored, keys, score, label), keys)
    precision = F.try_divide(F.col("__np") - F.col("__pp"), F.col("__n") - F.col("__cc"))  # of this level and those above
    return steps.groupBy(*keys).agg(F.round(F.sum(F.try_divide(F.col("__p"), F.col("__np")) * precision), 6).alias("ap"), F.sum("__c").cast("bigint").alias("n"), F.sum("__p").cast("bigint").alias("n_pos"))


def auroc(scored: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """(keys, auroc): by mid-ranks; null with a single class."""
    keys = list(keys)
    steps = _running(_levels(scored, keys, score, label), keys).withColumn("__rank", F.col("__cc") + (F.col("__c") + 1) / 2)
    sums = steps.groupBy(*keys).agg(F.sum(F.col("__rank") * F.col("__p")).alias("r"), F.sum("__p").alias("p"), F.sum("__c").alias("c"))
    value = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("c") - F.col("p")))
    return sums.select(*keys, F.round(value, 6).alias("auroc"))


def confusion(rows: DataFrame, truths: dict[str, tuple[str, str]]) -> DataFrame:
    """(property, tp, fp, fn, tn) for named (truth, prediction) columns of 0 and 1."""
    entries = F.array(*[F.struct(F.lit(name).alias("property"), F.col(t).cast("int").alias("t"), F.col(p).cast("int").alias("p")) for name, (t, p) in truths.items()])
    long = rows.select(F.explode(entries).alias("x")).select("x.*")
    count = lambda t, p: F.sum(F.when((F.col("t") == t) & (F.col("p") == p), 1).otherwise(0)).cast("bigint")
    return long.groupBy("property").agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))


def wilson(k: Column, n: Column, z: float = Z975) -> tuple[Column, Column]:
    """The interval's ends, within 0 and 1; null if there are no trials."""
    n = n.cast("double")
    p = F.try_divide(k.cast("double"), n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - half)), F.when(some, F.least(F.lit(1.0), centre + half))


def precision_recall(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    low, high = wilson(F.when(tp + fp > 0, tp).otherwise(0), F.when(tp + fp > 0, tp + fp))
    f1 = F.try_divide(2 * precision * recall, precision + recall)
    return counts.select("property", "tp", "fp", "fn", "tn", *[F.round(x, 6).alias(n) for n, x in (("precision", precision), ("recall", recall), ("f1", f1), ("precision_low", low), ("precision_high", high))])


def errors(rows: DataFrame, key: str, truth: str, prediction: str) -> DataFrame:
    """(kind, key) of false positives and false negatives, one row each."""
    kind = F.when((F.col(truth) == 0) & (F.col(prediction) == 1), "false_positive").when((F.col(truth) == 1) & (F.col(prediction) == 0), "false_negative")
    return rows.select(kind.alias("kind"), F.col(key).cast("string").alias("key")).where("kind is not null")


def error_lists(rows: DataFrame, key: str, truth: str, prediction: str, most: int = 1000) -> DataFrame:
    """One row each for false positives and false negatives: their number and, for a report, the `most`
    first keys in order. errors() has them all."""
    found = errors(rows, key, truth, prediction)
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("key"))).where(F.col("r") <= most)
    lists = first.groupBy("kind").agg(F.array_join(F.sort_array(F.collect_list("key")), ",").alias("keys"))
    return found.groupBy("kind").agg(F.count("*").cast("bigint").alias("n")).join(lists, "kind").select("kind", "n", "keys")


def fold_summary(folds: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, mean, std, n_folds) over folds with a value; the deviation of one fold is 0."""
    usable = folds.where(F.col(value).isNotNull() & ~F.isnan(value))
    return usable.groupBy(*keys).agg(rounded(F.avg(value)).alias("mean"), rounded(F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("std"), F.count("*").cast("bigint").alias("n_folds"))


def fold_vector(folds: DataFrame, value: str, fold: str, *keys: str) -> DataFrame:
    """(keys, folds): the values by fold, in order of the folds, those without a value left out."""
    usable = folds.where(F.col(value).isNotNull() & ~F.isnan(value))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(fold).alias("f"), F.col(value).alias("v"))))
    return usable.groupBy(*keys).agg(F.transform(ordered, lambda x: x["v"]).alias("folds"))


def gap_between(folds: DataFrame, value: str, side: str, high: str, low: str, *keys: str) -> DataFrame:
    """Difference of the sides' means (unpaired)."""
    mean = lambda s: F.avg(F.when(F.col(side) == s, F.col(value)))
    return folds.groupBy(*keys).agg(rounded(mean(high)).alias(f"{high}_mean"), rounded(mean(low)).alias(f"{low}_mean"), rounded(mean(high) - mean(low)).alias("gap"))


def paired_delta(a: DataFrame, b: DataFrame, value: str, on: list[str], *keys: str) -> DataFrame:
    """Mean and deviation over folds of a's value less b's."""
    joined = a.select(*on, F.col(value).alias("__a")).join(b.select(*on, F.col(value).alias("__b")), on).withColumn("delta", F.col("__a") - F.col("__b"))
    return fold_summary(joined, "delta", *keys)


def within_one_std(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Whether two summaries differ by no more than the larger deviation."""
    joined = a.toDF(*keys, "mean_a", "std_a", "n_a").join(b.toDF(*keys, "mean_b", "std_b", "n_b"), list(keys))
    return joined.withColumn("agrees", (F.abs(F.col("mean_a") - F.col("mean_b")) <= F.greatest("std_a", "std_b")).cast("bigint"))


def argmax(rows: DataFrame, choice: str, value: str, order: Column | str, *keys: str) -> DataFrame:
    """The choice of greatest value, the first in order among equals; nulls and NaN take no part."""
    usable = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    order = F.col(order) if isinstance(order, str) else order
    best = F.max_by(F.struct(choice, value), F.struct(F.col(value), -order))
    return usable.groupBy(*keys).agg(best.alias("b"), F.count("*").cast("bigint").alias("n_searched")).select(*keys, f"b.{choice}", F.round(f"b.{value}", 6).alias(value), "n_searched")


def pair_metrics(pairs: DataFrame, margin: str, *keys: str) -> DataFrame:
    """Wins (greater only; a tie is no win), ties, accuracy with its interval and exact p, margins."""
    out = pairs.groupBy(*keys).agg(F.count("*").cast("bigint").alias("n"), F.sum((F.col(margin) > 0).cast("bigint")).alias("wins"), F.sum((F.col(margin) == 0).cast("bigint")).alias("ties"), rounded(F.avg(margin)).alias("mean_margin"), F.round(F.percentile(margin, 0.5), 6).alias("median_margin"), rounded(F.coalesce(F.stddev_samp(margin), F.lit(0.0))).alias("std_margin"))
    low, high = wilson(F.col("wins"), F.col("n"))
    return out.withColumns({"accuracy": F.round(F.col("wins") / F.col("n"), 6), "low": F.round(low, 6), "high": F.round(high, 6), "p": rounded(binomial_half(F.col("wins"), F.col("n")))})


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, shifted by ten where it converges at once; to about 1e-13."""
    z = n.cast("double") + 11
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5)))
    for k in range(1, 11):
        series = series - F.log(n.cast("double") + k)
    return series


def binomial_half(k: Column, n: Column) -> Column:
    """Exact two-sided binomial test of one half."""
    low = F.least(k, n - k).cast("int")
    tail = F.aggregate(F.sequence(F.lit(0), low), F.lit(0.0), lambda s, i: s + F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) - n * F.log(F.lit(2.0))))
    return F.least(F.lit(1.0), 2 * tail)


def binomial_two_sided(k: Column, n: Column, p: Column) -> Column:
    """Exact two-sided binomial test of any p: the chance of all outcomes no likelier than k (up to a
    relative 1e-7, so that equal ones count)."""
    p = p.cast("double")
    certain = lambda count, chance: F.when(count == 0, F.lit(0.0)).otherwise(count * F.log(chance))
    log_chance = lambda i: log_factorial(n) - log_factorial(i) - log_factorial(n - i) + certain(i, p) + certain(n - i, 1 - p)
    possible = lambda i: F.when(p == 0, i == 0).when(p == 1, i == n).otherwise(F.lit(True))
    chance = lambda i: F.when(possible(i), F.exp(log_chance(i))).otherwise(0.0)
    most = chance(k) * (1 + 1e-7)
    tail = T.bind(most, lambda m: F.aggregate(F.transform(F.sequence(F.lit(0), n.cast("int")), chance), F.lit(0.0), lambda s, x: s + F.when(x <= m, x).otherwise(0.0)))
    return F.when(n > 0, F.least(F.lit(1.0), tail)).otherwise(1.0)


def wilcoxon_one_sided(diffs: Column) -> Column:
    """Exact p that paired differences are no greater than zero: how many choices of signs give the rank sum
    that is seen, or more. Doubled mid-ranks are whole numbers, so one pass over the ranks counts, for each
    sum, the choices that reach it, as shares; zero differences take no part."""

    def of(kept: Column) -> Column:
        smaller = lambda d: F.size(F.filter(kept, lambda x: F.abs(x) < F.abs(d)))
        equal = lambda d: F.size(F.filter(kept, lambda x: F.abs(x) == F.abs(d)))
        ranks = F.transform(kept, lambda d: 2 * smaller(d) + equal(d) + 1)
        observed = F.aggregate(F.transform(kept, lambda d: F.when(d > 0, 2 * smaller(d) + equal(d) + 1).otherwise(0)), F.lit(0), lambda s, r: s + r)
        n = F.size(kept)
        start = F.transform(F.sequence(F.lit(0), n * (n + 1)), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
        shares = F.aggregate(ranks, start, lambda held, r: F.transform(held, lambda x, i: x / 2 + F.when(i >= r, F.coalesce(F.get(held, i - r), F.lit(0.0)) / 2).otherwise(0.0)))
        return F.aggregate(F.slice(shares, observed + 1, F.size(shares)), F.lit(0.0), lambda s, x: s + x)

    kept = F.filter(diffs, lambda d: d != 0)
    return F.when(F.size(kept) == 0, F.lit(1.0)).otherwise(T.bind(kept, of))


def paired_test(diffs: Column) -> dict[str, Column]:
    """p and effect sizes of an array of paired differences."""
    n = F.size(diffs)
    mean = F.aggregate(diffs, F.lit(0.0), lambda s, d: s + d) / n
    ordered = F.sort_array(diffs)
    middle = (F.get(ordered, ((n - 1) / 2).cast("int")) + F.get(ordered, (n / 2).cast("int"))) / 2
    deviation = F.sqrt(F.aggregate(diffs, F.lit(0.0), lambda s, d: s + (d - mean) * (d - mean)) / F.nullif(n - 1, F.lit(0)))
    return {
        "p": F.round(wilcoxon_one_sided(diffs), 6),
        "mean_diff": F.round(mean, 6),
        "median_diff": F.round(middle, 6),
        "n_positive": F.size(F.filter(diffs, lambda d: d > 0)).cast("bigint"),
        "sign_mean": F.round(F.aggregate(diffs, F.lit(0.0), lambda s, d: s + F.signum(d)) / n, 6),
        "cohen_dz": F.round(F.try_divide(mean, deviation), 6),
        "least_p": F.round(F.pow(F.lit(0.5), n), 6),
    }
