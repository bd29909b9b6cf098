"""Reproducible samples, folds and one-to-one matching. Order comes from md5 of seed and key, never from a
generator's state, so any engine can check it."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators.graph import components
from lexspark.operators.matching import OTHER_GROUP, SLACK, UNMATCHED, transport
from lexspark.plans.storage import cut


def shuffled(seed: int | str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


#: Hexadecimal digits of the hash by which rows are dealt to be ranked.
CELL_DIGITS = 3


def hash_ranked(rows: DataFrame, key: str, seed: int | str, *by: str, name: str = "__rank") -> DataFrame:
    """Adds each row's rank, from 1, in md5 order within `by`. Rows are dealt by the first digits of their
    hash and ranked there; the counts of lower cells are added, so no task sees more than a cell of a group,
    whatever the group's size."""
    dealt = rows.withColumn("__h", shuffled(seed, key)).withColumn("__cell", F.substring("__h", 1, CELL_DIGITS))
    cells = dealt.groupBy(*by, "__cell").agg(F.count("*").alias("__n"))
    below = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col("__cell").alias("__at"), F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__before"))
    same = F.col("__cell") == F.col("__at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__b{i}"))
    inside = Window.partitionBy(*by, "__cell").orderBy("__h", key)
    return dealt.withColumn("__in", F.row_number().over(inside)).join(before, same).withColumn(name, (F.col("__in") + F.col("__before")).cast("bigint")).select(*rows.columns, name)


def within_folds(rows: DataFrame, key: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Adds `fold`: rows dealt in turn within each label."""
    return hash_ranked(rows, key, seed, label).withColumn("fold", ((F.col("__rank") - 1) % k).cast("bigint")).drop("__rank")


def inner_folds(rows: DataFrame, key: str, label: str, fold: str, k: int = 3, seed: int = 0) -> DataFrame:
    """For each outer fold its training rows, dealt anew: the rows with `outer` and `inner`."""
    outer = rows.select(F.col(fold).alias("outer")).distinct()
    nested = rows.join(F.broadcast(outer), F.col(fold) != F.col("outer"))  # folds are few
    return hash_ranked(nested, key, seed, "outer", label).withColumn("inner", ((F.col("__rank") - 1) % k).cast("bigint")).drop("__rank")


def assign_groups(groups: list[tuple[str, int, int]], k: int, seed: int = 0) -> dict[str, int]:
    """Fold of each (group, positives, rows): groups go one by one, the least balanced first, to the fold
    that leaves the classes' shares most even. Groups are few; this runs on the driver."""
    import hashlib

    totals = np.array([sum(p for _, p, _ in groups), sum(n - p for _, p, n in groups)], float)
    folds = np.zeros((k, 2))
    out: dict[str, int] = {}
    for name, p, n in sorted(groups, key=lambda g: (-abs(g[2] - 2 * g[1]) if g[1] else -g[2], hashlib.md5(f"{seed}:{g[0]}".encode()).hexdigest())):
        own = np.array([p, n - p], float)
        spread = []
        for f in range(k):
            folds[f] += own
            spread.append((np.divide(folds, totals, out=np.zeros_like(folds), where=totals > 0).std(axis=0).mean(), folds[f].sum(), f))
            folds[f] -= own
        out[name] = min(spread)[2]
        folds[out[name]] += own
    return out


MOST_GROUPS = 200_000


def cross_folds(rows: DataFrame, group: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Adds `fold`; no group stands in two folds. The choice for a group depends on those before it, so it is
    made on the driver, from one row a group: of MOST_GROUPS at most, more are an error."""
    counts = rows.groupBy(F.col(group).cast("string").alias("g")).agg(F.sum(label).alias("p"), F.count("*").alias("n")).limit(MOST_GROUPS + 1).collect()
    if len(counts) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    chosen = assign_groups([(r.g, int(r.p or 0), r.n) for r in counts], k, seed)
    if not chosen:
        return rows.withColumn("fold", F.lit(None).cast("bigint"))
    table = rows.sparkSession.createDataFrame(list(chosen.items()), "__g string, fold long")
    return rows.join(table, F.col(group).cast("string").eqNullSafe(F.col("__g"))).drop("__g")


def inner_k(k: int, n_pos: int, n_groups: int | None = None) -> int:
    return max(2, min(k, n_pos, *([n_groups] if n_groups is not None else [])))


def degenerate_folds(rows: DataFrame, fold: str, label: str, *keys: str) -> DataFrame:
    """Folds (by key) without positives, or whose training rows have fewer than two."""
    counts = rows.groupBy(*keys, fold).agg(F.sum(label).cast("bigint").alias("test_pos"))
    whole = Window.partitionBy(*keys)  # over a row a fold
    with_train = counts.withColumn("train_pos", F.sum("test_pos").over(whole) - F.col("test_pos"))
    return with_train.where("test_pos = 0 or train_pos < 2").select(*keys, fold, "test_pos", "train_pos")


def control_labels(rows: DataFrame, key: str, label: str, seed: int = 991) -> DataFrame:
    """Adds `control`: as many random positives as there are real ones."""
    total = rows.agg(F.coalesce(F.sum(label), F.lit(0)).alias("__pos"))
    ranked = hash_ranked(rows, key, seed).crossJoin(F.broadcast(total))
    return ranked.withColumn("control", (F.col("__rank") <= F.col("__pos")).cast("bigint")).drop("__rank", "__pos")


def usable_fold(rows: DataFrame, train: str, label: str) -> bool:
    """Whether there are positives to test on and two or more to train on."""
    counts = rows.agg(F.sum(F.when(F.col(train), F.col(label))).alias("a"), F.sum(F.when(~F.col(train), F.col(label))).alias("b")).first()
    return (counts.a or 0) >= 2 and (counts.b or 0) > 0


def length_batches(rows: DataFrame, key: str, length: str, size: int, seed: int = 0) -> DataFrame:
    """Adds `batch`: batches of `size` rows of like length, the longest first. Ranks come from counts by
    length and ranks within a length; a key restores the order."""
    lengths = rows.groupBy(length).agg(F.count("*").alias("__n"))
    longer = Window.orderBy(F.desc(length)).rowsBetween(Window.unboundedPreceding, -1)
    before = lengths.select(F.col(length).alias("__l"), F.coalesce(F.sum("__n").over(longer), F.lit(0)).alias("__before"))  # a row a length
    ranked = hash_ranked(rows, key, seed, length).join(before, F.col(length).eqNullSafe(F.col("__l")))
    return ranked.withColumn("batch", F.floor((F.col("__rank") - 1 + F.col("__before")) / size).cast("bigint")).select(*rows.columns, "batch")


def stratified(rows: DataFrame, key: str, strata: list[tuple[str, Column]], n: int, seed: int = 0) -> DataFrame:
    """n rows: n // strata of each stratum in md5 order, a row counting for the first stratum that draws it,
    filled up in md5 order over all."""
    each = n // len(strata)
    flagged = F.array(*[F.when(c, F.struct(F.lit(i).alias("at"), F.lit(name).alias("stratum"))) for i, (name, c) in enumerate(strata)])
    long = rows.select(key, F.explode(F.filter(flagged, lambda x: x.isNotNull())).alias("s")).select(key, "s.at", "s.stratum", shuffled(seed, key).alias("h"))
    drawn = long.withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy("h", key))).where(F.col("r") <= each)
    first = drawn.groupBy(key).agg(F.min_by("stratum", "at").alias("stratum"))
    taken = first.agg(F.count("*").alias("taken"))
    rest = rows.select(key).join(first.select(key), key, "left_anti").select(key, shuffled(seed, key).alias("h")).orderBy("h", key).limit(n)
    filled = rest.withColumn("r", F.row_number().over(Window.orderBy("h", key))).crossJoin(F.broadcast(taken)).where(F.col("r") <= n - F.col("taken"))
    return first.unionByName(filled.select(key, F.lit("fill").alias("stratum")))


def smoke_subset(rows: DataFrame, key: str, group: str, label: str, category: str, *, groups: int = 12, positives: int = 12, negatives: int = 45, rescue: int = 3, seed: int = 0) -> DataFrame:
    """A small subset: the groups with most positives, of each some positives in key order and some other rows
    in md5 order, then a few rows of every category that is missing."""
    top = rows.groupBy(group).agg(F.sum(label).alias("p")).orderBy(F.desc("p"), group).limit(groups).select(group)
    own = rows.join(F.broadcast(top), group, "left_semi").select(key, group, label, category)
    order = F.when(F.col(label) == 1, F.lpad(F.col(key).cast("string"), 20, "0")).otherwise(shuffled(seed, key))
    drawn = own.withColumn("r", F.row_number().over(Window.partitionBy(group, label).orderBy(order, key))).where(F.col("r") <= F.when(F.col(label) == 1, positives).otherwise(negatives)).select(key, category)
    missing = rows.select(key, category).join(drawn.select(category).distinct(), category, "left_anti")
    rescued = missing.withColumn("r", F.row_number().over(Window.partitionBy(category).orderBy(key))).where(F.col("r") <= rescue).select(key, category)
    return drawn.unionByName(rescued)


EXACT_BELOW = 20


def match_candidates(rows: DataFrame, key: str, label: str, length: str, group: str) -> DataFrame:
    """(pos, neg, gap, same_group): pairs within the caliper max(1, 0.05 x positive's length). The range join is an
    equi-join on tags: exact lengths below EXACT_BELOW, else classes of constant ratio, five of which
    surely hold all partners; the caliper is then checked exactly."""
    ratio = math.log1p(SLACK)
    cell = lambda n: F.floor(F.log(n.cast("double")) / ratio).cast("bigint")
    n = F.col(length).cast("bigint")
    tag = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("v"))
    pool = rows.where((F.col(label) == 0) & (n > 0)).select(F.col(key).alias("neg"), n.alias("m"), F.col(group).alias("g0"), F.explode(F.array(tag("e", n), tag("b", cell(n)))).alias("t"))
    wanted = F.when(n < EXACT_BELOW, F.transform(F.sequence(n - 1, n + 1), lambda v: tag("e", v))).otherwise(F.transform(F.sequence(cell(n) - 2, cell(n) + 2), lambda v: tag("b", v)))
    cases = rows.where((F.col(label) == 1) & (n > 0)).select(F.col(key).alias("pos"), n.alias("n"), F.col(group).alias("g1"), F.explode(wanted).alias("t"))
    gap = F.abs(F.col("n") - F.col("m"))
    return cases.join(pool, "t").where(gap <= F.greatest(F.lit(1.0), SLACK * F.col("n"))).select("pos", "neg", gap.alias("gap"), F.coalesce(F.col("g0") == F.col("g1"), F.lit(False)).cast("bigint").alias("same_group"))


def assignment(edges: list[list[tuple[int, float]]], columns: int) -> list[int | None]:
    """The column of each row, or None, in a choice of least total cost in which a row without a column costs
    UNMATCHED. edges: for each row its (column, cost). Rows enter one by one along a cheapest path of
    exchanges (Dijkstra's search over reduced costs), so memory is that of the edges."""
    n = len(edges)
    owner: list[int | None] = [None] * (columns + n)  # row i may stay unmatched in column `columns + i`
    chosen: list[int | None] = [None] * n
    price = [0.0] * (columns + n)
    level = [0.0] * n
    all_edges = [[*own, (columns + i, UNMATCHED)] for i, own in enumerate(edges)]
    for i in range(n):
        level[i] = min(c - price[j] for j, c in all_edges[i])
        dist: dict[int, float] = {}
        came: dict[int, int] = {}
        settled: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        row, base = i, 0.0
        while True:
            for j, c in all_edges[row]:
                d = base + c - price[j] - level[row]
                if j not in settled and d < dist.get(j, math.inf) - 1e-9:
                    dist[j], came[j] = d, row
                    heapq.heappush(heap, (d, j))
            while True:
                base, j = heapq.heappop(heap)
                if j not in settled and base <= dist[j]:
                    break
            if owner[j] is None:
                break
            settled[j] = base
            row = owner[j]
        end = base
        level[i] += end
        for k, d in settled.items():
            price[k] -= end - d
            level[owner[k]] += end - d
        while True:  # hand columns on along the path
            row = came[j]
            owner[j], j, chosen[row] = row, chosen[row], j
            if row == i:
                break
    return [j if j is not None and j < columns else None for j in chosen]


def match(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """(pos, neg, gap, same_group): pairs of least cost: as many as possible, then within a group, then of
    small gaps. parts: (pos, part), the connected component of each case; components are independent and
    are solved each in one task, in memory that follows its pairs."""

    def solve(pairs: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.sort_values(["pos", "neg"], ignore_index=True)
        row, _ = pd.factorize(pairs.pos, sort=True)
        column, names = pd.factorize(pairs.neg, sort=True)
        cost = np.where(pairs.same_group == 1, 0.0, OTHER_GROUP) + pairs.gap.to_numpy(float)
        edges: list[list[tuple[int, float]]] = [[] for _ in range(row.max() + 1)]
        for i, j, c in zip(row.tolist(), column.tolist(), cost.tolist(), strict=True):
            edges[i].append((j, c))
        chosen = np.array([-1 if j is None else j for j in assignment(edges, len(names))])
        return pairs[chosen[row] == column][["pos", "neg", "gap", "same_group"]]

    return candidates.join(parts, "pos").groupBy("part").applyInPandas(solve, candidates.select("pos", "neg", "gap", "same_group").schema)


def _stars(batches):
    """The links of a task as one link from each node to the least one that it is connected with there."""
    over: dict = {}
    alone = set()

    def top(x):
        while (y := over.setdefault(x, x)) != x:
            over[x] = x = over[y]
        return x

    for batch in batches:
        for a, b in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True):
            if a == b:
                alone.add(a)
            a, b = top(a), top(b)
            over[max(a, b)] = min(a, b)
    out = [(x, least) for x in over if (least := top(x)) != x or x in alone]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (batch.schema.field(c).type for c in ("a", "b")), strict=True)], names=["a", "b"])


def match_parts(candidates: DataFrame) -> DataFrame:
    """(pos, part): components of the graph of candidates, named by their least case. A control links its cases
    through the least one of them, so links number the distinct pairs of cases, not the candidates; each task
    then contracts its links to stars, so that the search over all of them takes few rounds."""
    least = F.min("pos").over(Window.partitionBy("neg"))
    distinct = candidates.where(F.col("pos").isNotNull()).select(F.col("pos").alias("a"), least.alias("b")).distinct()
    links = cut(distinct.mapInArrow(_stars, distinct.schema))
    nodes = links.select(F.col("a").alias("node")).distinct()
    found = components(links, nodes.withColumn("value", F.col("node"))).select(F.col("node").alias("pos"), F.col("value").alias("part"))
    # a case alone with its controls has no link to another
    alone = nodes.select(F.col("node").alias("pos")).join(found, "pos", "left_anti")
    return found.union(alone.select("pos", F.col("pos").alias("part")))


def match_lengths(rows: DataFrame, key: str, label: str, length: str, group: str) -> DataFrame:
    """What match() finds over match_candidates(), without a table of candidates: rows of one label, length and
    group are alike, so one task solves a component of such kinds, and their rows are then dealt in hash order.
    Null keys take no part; a key in several rows of a label counts once, with the least length."""
    side = F.when(F.col(label) == 1, 1).when(F.col(label) == 0, 0)
    told = rows.select(F.col(key).alias("k"), side.alias("y"), F.struct(F.col(length).cast("bigint").alias("n"), F.col(group).cast("string").alias("g")).alias("x"))
    own = cut(told.where("k is not null and y is not null and x.n > 0").groupBy("k", "y").agg(F.min("x").alias("x")).select("k", "y", "x.n", "x.g"))
    kinds = own.groupBy("y", "n", "g").agg(F.count("*").alias("rows"))
    near = cut(match_candidates(kinds.select("y", "n").distinct(), "n", "y", "n", "n"))
    parts = cut(match_parts(near))
    of = near.join(parts, "pos").select(F.lit(0).alias("y"), F.col("neg").alias("n"), "part").distinct().union(parts.select(F.lit(1), "pos", "part"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "g"], ignore_index=True)
        case, pool = ([(None if pd.isna(g) else g, n, r) for g, n, r in zip(*(frame[frame.y == y][c].tolist() for c in "gnr"), strict=True)] for y in (1, 0))
        dealt_a, dealt_b = [0] * len(case), [0] * len(pool)
        out = []
        for i, j, f in transport(case, pool):
            out.append((case[i][1], case[i][0], dealt_a[i], pool[j][1], pool[j][0], dealt_b[j], f))
            dealt_a[i] += f
            dealt_b[j] += f
        return pd.DataFrame(out, columns=["n1", "g1", "a1", "n0", "g0", "a0", "f"])

    flows = kinds.withColumnRenamed("rows", "r").join(of, ["y", "n"]).groupBy("part").applyInPandas(solve, "n1 long, g1 string, a1 long, n0 long, g0 string, a0 long, f long")
    pairs = flows.withColumn("i", F.explode(F.sequence(F.lit(1), "f"))).select(*[c for s in "10" for c in (f"n{s}", f"g{s}", (F.col(f"a{s}") + F.col("i")).alias(f"at{s}"))])
    ranked = hash_ranked(own, "k", 0, "y", "n", "g")
    for s, name in ("1", "pos"), ("0", "neg"):
        rank = ranked.where(F.col("y") == int(s)).select(F.col("k").alias(name), F.col("n").alias("__n"), F.col("g").alias("__g"), "__rank")
        pairs = pairs.join(rank, (F.col(f"n{s}") == F.col("__n")) & F.col(f"g{s}").eqNullSafe(F.col("__g")) & (F.col(f"at{s}") == F.col("__rank"))).drop("__n", "__g", "__rank")
    return pairs.select("pos", "neg", F.abs(F.col("n1") - F.col("n0")).alias("gap"), F.coalesce(F.col("g1") == F.col("g0"), F.lit(False)).cast("bigint").alias("same_group"))


def matched(rows: DataFrame, key: str, label: str, length: str, group: str) -> DataFrame:
    """The rows with `matched`: whether a row is in the length-matched subset, of as many cases as can get a
    partner and these partners."""
    pairs = match_lengths(rows, key, label, length, group)
    chosen = pairs.select(F.explode(F.array("pos", "neg")).alias("__m")).distinct()
    return rows.join(chosen, F.col(key) == F.col("__m"), "left").withColumn("matched", F.col("__m").isNotNull()).drop("__m")
