"""Maximum inner product search with score-aware quantisation.

Vectors are cut into subspaces of two dimensions with sixteen centres each, so a vector is coded in four
bits per subspace, two subspaces to a byte. Codebooks and codes minimise an anisotropic loss: of the
residual r of a vector x, the part parallel to x weighs ETA times the part orthogonal to it, since only the
former moves large inner products. Codes come from coordinate descent over subspaces; centres from the
weighted least squares over all subspaces at once.

A query's products with the centres are a table; candidates are scored by table look-ups over the code
bytes, the RERANK best of each part, and what scores like the last of them, are scored again on the original vectors in double precision, and the
best of all parts are the answer. Ties go to the smaller identifier.

Codebooks are fitted on SAMPLE vectors at most (those of least hash, a documented bound); every vector is
coded and searched. Equal vectors are searched, and asked for, once: of their identifiers the k + 1 least go
along. Candidates fall into parts of BLOCK, queries into slices of QUERY_BLOCK, and each pair of these is a
task of its own, which holds the part while the slice streams by. Nothing that grows with the input is
broadcast or collected.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
dimension isn't the most common one (of equally common ones the smallest), and rows with a null identifier. Rows
that share an identifier, repeated ones too, are candidates each, but not for a query of their own identifier; as
queries the least of their vectors stands for them. With no vectors left the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm import common

SUB, CENTRES = 2, 16
SAMPLE, ROUNDS, THRESHOLD = 6000, 4, 0.2
RERANK = 256
#: Different vectors of a part of the candidates, and of a slice of the queries.
BLOCK, QUERY_BLOCK = 16_384, 1024


def eta_of(dimension: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel against the orthogonal residual, for products above the threshold."""
    return (dimension - 1) * threshold**2 / (1 - threshold**2)


class Quantiser:
    def __init__(self, centres: np.ndarray, eta: float):
        self.centres, self.eta = centres, eta  # [subspaces, CENTRES, SUB]

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = ROUNDS, seed: int = 0) -> "Quantiser":
        n, d = x.shape
        x = np.pad(x, ((0, 0), (0, -d % (2 * SUB)))).astype(np.float64)
        subspaces = x.shape[1] // SUB
        parts = x.reshape(n, subspaces, SUB)
        rng = np.random.default_rng(seed)
        centres = parts[rng.choice(n, CENTRES, replace=n < CENTRES)].transpose(1, 0, 2).copy()
        own = cls(centres, eta_of(d))
        for _ in range(rounds):  # plain k-means to begin with
            codes = own._nearest(parts)
            for s in range(subspaces):
                for k in range(CENTRES):
                    if (m := codes[:, s] == k).any():
                        centres[s, k] = parts[m, s].mean(axis=0)
        for _ in range(rounds):
            codes = own.codes(x)
            own.centres = own._centres(x, codes)
        return own

    def _nearest(self, parts: np.ndarray) -> np.ndarray:
        return np.stack([((parts[:, s, None, :] - self.centres[s]) ** 2).sum(axis=2).argmin(axis=1) for s in range(parts.shape[1])], axis=1)

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """[n, subspaces] centre numbers of least anisotropic loss, by coordinate descent."""
        n, d = x.shape
        x = np.pad(x, ((0, 0), (0, self.centres.shape[0] * SUB - d))).astype(np.float64)
        parts = x.reshape(n, -1, SUB)
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(parts.shape)
        codes = self._nearest(parts)
        gap = [((parts[:, s, None, :] - self.centres[s]) ** 2).sum(axis=2) for s in range(parts.shape[1])]
        along = [((parts[:, s, None, :] - self.centres[s]) * unit[:, s, None, :]).sum(axis=2) for s in range(parts.shape[1])]
        rows = np.arange(n)
        parallel = sum(a[rows, codes[:, s]] for s, a in enumerate(along))
        for _ in range(sweeps):
            for s in range(parts.shape[1]):
                rest = parallel - along[s][rows, codes[:, s]]
                # |r|^2 + (eta - 1) (r.x/|x|)^2, where only this subspace's share varies
                best = (gap[s] + (self.eta - 1) * (rest[:, None] + along[s]) ** 2).argmin(axis=1)
                codes[:, s] = best
                parallel = rest + along[s][rows, best]
        return codes.astype(np.uint8)

    def _centres(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        n, subspaces = codes.shape
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        size = subspaces * CENTRES * SUB
        slots = ((np.arange(subspaces) * CENTRES + codes)[:, :, None] * SUB + np.arange(SUB)).reshape(n, -1)
        chosen = np.zeros((n, size))
        np.put_along_axis(chosen, slots, unit, axis=1)
        left = (self.eta - 1) * (chosen.T @ chosen)
        used = np.bincount(slots.ravel(), minlength=size).astype(float)
        left[np.diag_indices(size)] += used + 1e-6
        right = np.bincount(slots.ravel(), weights=x.ravel(), minlength=size) + (self.eta - 1) * (chosen.T @ np.linalg.norm(x, axis=1))
        solved = np.linalg.solve(left, right + 1e-6 * self.centres.ravel())
        return solved.reshape(self.centres.shape)

    @staticmethod
    def packed(codes: np.ndarray) -> np.ndarray:
        """[n, subspaces / 2] bytes of two four-bit codes."""
        return (codes[:, 0::2] | (codes[:, 1::2] << 4)).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """[subspaces / 2, 256] products of a query with the pairs of centres that a byte names."""
        q = np.pad(q, (0, self.centres.shape[0] * SUB - len(q))).reshape(-1, SUB)
        products = np.einsum("skd,sd->sk", self.centres, q)
        return (products[0::2, None, :] + products[1::2, :, None]).reshape(len(q) // 2, 256).astype(np.float32)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, equal for equal rows wherever they stand."""
    return (x * q).sum(axis=1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows that take part; see the module's first lines."""
    v = F.col(vector_col).cast("array<double>")
    fine = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fine = fine.where(finite & F.exists("v", lambda c: c != 0))
    common_size = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fine.where(F.size("v") == (common_size.n if common_size else -1))


SCHEMA = "query_id long, rank int, vec_id long, score double"


def _codes_step(model):
    def step(batches):
        for batch in batches:
            if batch.num_rows:
                column = batch.column("v")
                packed = model.value.packed(model.value.codes(column.flatten().to_numpy().reshape(batch.num_rows, -1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in packed], pa.binary())], names=[*batch.schema.names, "codes"])

    return step


def search(vectors: DataFrame, k: int, *, every: int, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for each row whose identifier `every` divides."""
    spark = vectors.sparkSession
    fine = common.cut(usable(vectors, id_col, vector_col))
    key = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    rows = fine.select(*key, "vec_id", "v")
    counted = rows.groupBy("h1", "h2", "vec_id").agg(F.count("*").alias("n"))
    # of equal vectors the k + 1 least identifiers can be among k neighbours of any query
    first = counted.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = first.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))
    groups = common.cut(rows.groupBy("h1", "h2").agg(F.first("v").alias("v")).join(ids, ["h1", "h2"]))
    total = groups.count()
    sample = groups.orderBy("h1", "h2").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], SCHEMA)
    model = spark.sparkContext.broadcast(Quantiser.fit(np.array([r.v for r in sample])))
    queries = fine.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), *key)
    asked = common.cut(groups.join(queries.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "v"))
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], SCHEMA)
    parts, slices = -(-total // BLOCK), -(-n_asked // QUERY_BLOCK)
    coded = common.staged(common.map_arrow(groups, _codes_step(model), "h1 long, h2 long, v array<double>, ids array<struct<vec_id:bigint,n:bigint>>, codes binary"), "neighbours")
    # a grid of cells: each holds one part of the candidates and one slice of the queries
    others = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    candidates = coded.select("*", F.pmod("h1", F.lit(parts)).alias("part"), others.alias("slice")).select((F.col("part") * slices + F.col("slice")).cast("int").alias("cell"), F.lit(0).alias("kind"), "h1", "h2", "v", "ids", "codes")
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = asked.select("*", F.pmod("h2", F.lit(slices)).alias("slice"), every_part.alias("part"))
    dealt = dealt.select((F.col("part") * slices + F.col("slice")).cast("int").alias("cell"), F.lit(1).alias("kind"), "h1", "h2", "v", F.lit(None).cast("array<struct<vec_id:bigint,n:bigint>>").alias("ids"), F.lit(None).cast("binary").alias("codes"))
    mixed = candidates.union(dealt).repartitionById(parts * slices, F.col("cell")).sortWithinPartitions("cell", "kind")
    local = common.map_arrow(mixed, _cell_step(model, k, rerank), "h1 long, h2 long, vec_id long, score double")
    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = ranked.groupBy("h1", "h2").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))), lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score"))).alias("found"))
    own = queries.join(lists, ["h1", "h2"]).select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _cell_step(model, k: int, rerank: int):
    """A cell's candidates come first, a bounded number; its queries then pass as a stream."""

    def step(batches):
        cell, held, ready = None, [], None
        for batch in batches:
            where, kind = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (np.diff(where) != 0) | (np.diff(kind) != 0))) if len(where) else [])
            for a, b in zip(cuts, [*cuts[1:], len(where)], strict=True):
                if where[a] != cell:
                    cell, held, ready = where[a], [], None
                rows = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append(rows)
                elif held:
                    ready = ready or _Candidates(model.value, held)
                    yield from ready.answer(rows, k, rerank)

    return step


class _Candidates:
    def __init__(self, quantiser: Quantiser, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.quantiser = quantiser
        order = np.lexsort((table["h2"].to_numpy(), table["h1"].to_numpy()))  # whatever order they came in
        self.x = pc.list_flatten(table["v"]).to_numpy().reshape(len(order), -1)[order]
        self.codes = np.ascontiguousarray(np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(len(order), -1)[order].T)
        self.ids = [[(i["vec_id"], i["n"]) for i in own] for own in table["ids"].take(pa.array(order)).to_pylist()]

    def answer(self, rows: pa.RecordBatch, k: int, rerank: int):
        """The k + 1 best of these candidates for each query; of equal ones the least identifiers."""
        q = rows.column("v").flatten().to_numpy().reshape(rows.num_rows, -1)
        out: list[list] = [[], [], [], []]
        for h1, h2, v in zip(rows.column("h1").to_pylist(), rows.column("h2").to_pylist(), q, strict=True):
            tables = self.quantiser.tables(v)
            found = tables[0][self.codes[0]]
            for t, c in zip(tables[1:], self.codes[1:], strict=True):
                found += t[c]
            # all that score like the last one, too: very similar vectors have the same code
            near = np.flatnonzero(found >= np.partition(found, -rerank)[-rerank]) if len(found) > rerank else np.arange(len(found))
            scores = exact(self.x[near], v)
            best = np.sort(scores)[-(k + 1) :][0]  # groups hold one identifier at least
            hits = [(-s, i) for s, g in zip(scores.tolist(), near.tolist(), strict=True) if s >= best for i, n in self.ids[g] for _ in range(min(n, k + 1))]
            for s, i in sorted(hits)[: k + 1]:
                for column, value in zip(out, (h1, h2, i, -s), strict=True):
                    column.append(value)
        yield common.arrow_batch(h1=pa.array(out[0], pa.int64()), h2=pa.array(out[1], pa.int64()), vec_id=pa.array(out[2], pa.int64()), score=pa.array(out[3], pa.float64()))
