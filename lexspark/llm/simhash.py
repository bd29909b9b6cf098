"""SimHash fingerprints and their links by multi-index hashing.

Words are the runs between ASCII white space after A-Z are put in lower case; shingles are `size`
consecutive words, repeats included, joined by single spaces (fewer words: the whole sequence; none: the
fingerprint zero). A fingerprint's bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).

Links at RADIUS = 2 or fewer differing bits: the 64 bits are two segments of 32. Of two fingerprints within
two bits, either one bit at most differs in the upper segment or the lower segments are equal. So each
fingerprint is entered under its two segment values, and asks the tables for its lower segment and for all
values in a Hamming ball of one bit around its upper one (only balls that set a bit: of two values that
differ in one bit, one has it clear). What the tables return is kept if all 64 bits differ in two at most.

Only distinct fingerprints take part, so copies never multiply. A table entry that over HEAVY distinct
fingerprints share is not paired: its fingerprints, and those that ask for it, are entered under each of
the 2016 values with two bits masked out. At most four distinct fingerprints share such a value, and all
pairs of these are within two bits, so cost stays in proportion however large the group is.

Null texts count as empty ones. Rows whose identifier is null take part; a component's identifier is the
least that is not null, and null if there is none. Repeated rows each get their row. Empty tables give
empty results. Other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from lexspark.llm import common
from lexspark.llm.components import components

RADIUS = 2
HEAVY = 2048
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of the text's shingles, in order, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    n = len(words) - size + 1
    if n <= 1:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(lengths + 1) - lengths - 1
    ends = (begins + lengths)[size - 1 :].tolist()
    view = memoryview(joined)
    return np.fromiter([digest(view[a:b], SEED) for a, b in zip(begins.tolist(), ends, strict=False)], np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned integer."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.empty((8, 8), np.int64)  # by bit in a byte, byte
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    for k in range(8):  # bytes as counters of up to 255
        lanes = ((padded >> np.uint64(k)) & _LANES).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        counts[k] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    set_bits = counts.T.reshape(-1) * 2 > n  # little-endian: bit 8 * byte + k
    return int.from_bytes(np.packbits(set_bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): a row for each document, fp as a signed 64-bit integer."""

    def step(batches):
        for batch in common.slices(batches):
            out = np.array([fingerprint(shingle_hashes(t, size)) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield common.arrow_batch(doc_id=batch.column("doc_id"), fp=pa.array(out))

    return common.map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text")), step, "doc_id long, fp long")


def links(distinct: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(a, b): all pairs of different fingerprints within RADIUS bits, from a table of distinct `fp`."""
    upper, lower = F.shiftrightunsigned("fp", 32).cast("long"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    entries = distinct.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), upper.alias("val")), F.struct(F.lit(1).alias("seg"), lower.alias("val")))).alias("e")).select("e.seg", "e.val", "fp")
    ball = F.transform(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda k: F.expr("0L") == F.call_function("shiftright", upper, k).bitwiseAND(F.lit(1))), lambda k: upper.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    asked = distinct.select("fp", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("seg"), upper.alias("val")), F.struct(F.lit(1).alias("seg"), lower.alias("val"))), F.transform(ball, lambda v: F.struct(F.lit(0).alias("seg"), v.alias("val"))))).alias("e")).select("e.seg", "e.val", F.col("fp").alias("asker"))
    crowded = common.cut(entries.groupBy("seg", "val").count().where(F.col("count") > heavy).select("seg", "val"))
    near = (F.bit_count(F.col("asker").bitwiseXOR(F.col("fp"))) <= RADIUS) & (F.col("asker") != F.col("fp"))
    if crowded.isEmpty():
        return asked.join(entries, ["seg", "val"]).where(near).select(F.least("asker", "fp").alias("a"), F.greatest("asker", "fp").alias("b")).distinct()
    light = asked.join(entries.join(crowded, ["seg", "val"], "left_anti"), ["seg", "val"]).where(near).select(F.least("asker", "fp").alias("a"), F.greatest("asker", "fp").alias("b"))
    members = entries.join(crowded, ["seg", "val"], "left_semi").select("fp").union(asked.join(crowded, ["seg", "val"], "left_semi").select("asker")).distinct()
    masks = [(j, k) for j in range(64) for k in range(j)]
    values = [~((1 << j) | (1 << k)) & (2**64 - 1) for j, k in masks]
    masked = members.select("fp", F.posexplode(F.array(*[F.lit(v - 2**64 if v >= 2**63 else v) for v in values])).alias("which", "mask"))
    groups = masked.groupBy("which", F.col("fp").bitwiseAND(F.col("mask")).alias("rest")).agg(F.array_sort(F.collect_set("fp")).alias("fps"))  # four at most
    pairs = groups.where(F.size("fps") > 1).select("fps", F.explode("fps").alias("a")).select("a", F.explode("fps").alias("b")).where("a < b")  # six at most
    return light.union(pairs).distinct()


def group(docs: DataFrame, size: int = 3, *, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document: 16 hex digits, and the least identifier
    that links of RADIUS bits reach, its own included."""
    prints = common.cut(fingerprints(docs, size, id_col=id_col, text_col=text_col))
    classes = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = links(classes.select("fp"), heavy)
    # classes without any identifier come last, and are told apart by their fingerprint
    values = classes.select(F.col("fp").alias("node"), F.struct(F.col("least").isNull().alias("none"), F.coalesce("least", "fp").alias("id")).alias("value"))
    joined = components(found, values)
    named = classes.join(joined, classes.fp == joined.node, "left").select("fp", F.when(F.col("node").isNull(), F.col("least")).when(~F.col("value.none"), F.col("value.id")).alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


CELLS = 1 << 21


SKETCHES = "row long, other long, doc_id long, n long, fp long, content binary, part int, counts binary"


def _sketch_step(size: int):
    """Of each text: number and hash of its distinct shingles, and its fingerprint. Then, of the task: how many
    texts hold a shingle of a cell, in parts that can be added apart."""

    def step(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in common.slices(batches):
            sets, prints = [], []
            for t in batch.column("text").to_pylist():
                hashes = shingle_hashes(t, size)
                prints.append(fingerprint(hashes))
                sets.append(np.unique(hashes))
            cells += np.bincount(np.concatenate(sets) % np.uint64(CELLS), minlength=CELLS)
            none = pa.nulls(len(sets), pa.int32())
            yield common.arrow_batch(row=batch.column("row"), other=batch.column("other"), doc_id=batch.column("doc_id"), n=pa.array([len(s) for s in sets], pa.int64()), fp=pa.array(np.array(prints, np.uint64).view(np.int64)), content=pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), part=none, counts=pa.nulls(len(sets), pa.binary()))
        if cells.any():
            parts = np.minimum(cells, 2**31 - 1).astype("<u4").reshape(64, -1)
            none = pa.nulls(64, pa.int64())
            yield common.arrow_batch(row=none, other=none, doc_id=none, n=none, fp=none, content=pa.nulls(64, pa.binary()), part=pa.array(np.arange(64, dtype=np.int32)), counts=pa.array([zstandard.compress(p.tobytes(), 1) for p in parts], pa.binary()))

    return step


def _sets_step(size: int):
    def step(batches):
        for batch in common.slices(batches):
            sets = [np.unique(shingle_hashes(t, size)).view(np.int64) for t in batch.column("text").to_pylist()]
            yield common.arrow_batch(row=batch.column("row"), shingles=pa.array(sets, pa.list_(pa.int64())))

    return step


def _levels_step(batches):
    """Sums of parts, as the binary logarithm."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(zstandard.decompress(counts), "<u4").astype(np.int64)
    if sums:
        yield common.arrow_batch(part=pa.array(list(sums), pa.int32()), levels=pa.array([np.log2(s + 1).astype(np.uint8).tobytes() for s in sums.values()], pa.binary()))


def _prefix_step(levels, size: int, similarity: float):
    """(token, row, n, at): of each set the shingles at the front in the common order of all shingles, one of
    which any two sets of `similarity` share; at counts from 0. Tokens are the lower halves of the hashes:
    different ones that agree only make a pair more to be compared."""

    def step(batches):
        level = levels.value
        for batch in common.slices(batches):
            tokens, rows, numbers, places = [], [], [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = np.unique(shingle_hashes(text, size))
                if not len(s):
                    continue
                order = np.argsort(level[s % np.uint64(CELLS)], kind="stable")
                front = order[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]
                tokens.append(s[front].astype(np.uint32).view(np.int32))
                rows.append(np.full(len(front), row, np.int64))
                numbers.append(np.full(len(front), len(s), np.int32))
                places.append(np.arange(len(front), dtype=np.int32))
            if tokens:
                yield common.arrow_batch(**{k: pa.array(np.concatenate(v)) for k, v in {"token": tokens, "row": rows, "n": numbers, "at": places}.items()})

    return step


def _free(columns: list[str], name: str) -> str:
    while name in columns:
        name += "_"
    return name


def _hashable(f) -> "F.Column":
    return F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`")


def deduplicate(docs: DataFrame, size: int = 5, similarity: float = 0.8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents but for near copies: of each group the one of least identifier (null last; of equal ones
    that of least hash over all columns) stays, in all its columns. The documents are read several times, so
    give a table rather than a computation.

    Groups are joined by links; a link is a Jaccard similarity of `similarity` or more of the sets of
    `size`-word shingles. Texts of equal shingle sets are put together first, so copies don't multiply. Then the
    candidates of multi-index hashing (fingerprints that are equal or within RADIUS bits) are compared, each
    fingerprint's texts with its first one. What these candidates miss is found exactly: shingles have one
    order throughout, rare ones first (by counts of hash cells, then by hash; any order gives the same groups).
    Two sets that link share one of the n - ceil(similarity * n) + 1 first shingles of both, and at the first
    they share enough is left in each. Of the sets that share such a shingle, each is compared to the one where
    it stands furthest in front (the original of edited copies, which has no rare shingles of its own); then
    all pairs that are not in one group yet are compared, so a large group of near copies costs in proportion
    but no link between groups is left untested. Null and empty texts are copies of each other."""
    spark = docs.sparkSession
    r1, r2 = _free(docs.columns, "row1"), _free(docs.columns, "row2")
    whole = [_hashable(f) for f in docs.schema.fields]
    keyed = docs.withColumns({r1: F.xxhash64(*whole), r2: F.xxhash64(F.lit(1), *whole)})  # tells rows apart wherever they stand
    narrow = keyed.select(F.col(r1).alias("row"), F.col(r2).alias("other"), F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    made: list[str] = []

    def staged(frame: DataFrame) -> DataFrame:
        """A table that goes again as soon as it isn't needed."""
        made.append(common.workspace(spark, "dedup"))
        frame.write.parquet(made[-1])
        return spark.read.schema(frame.schema).parquet(made[-1])

    sketched = staged(common.map_arrow(narrow, _sketch_step(size), SKETCHES))
    sketches = sketched.where("part is null").drop("part", "counts")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "other")
    classes = sketches.groupBy("content").agg(F.min(rank).alias("rank"), F.first("n").alias("n"), F.min("fp").alias("fp"))
    classes = common.cut(classes.select(F.col("rank.row").alias("row"), F.col("rank.other").alias("other"), "rank", "content", "n", "fp"))
    parts = sketched.where("part is not null").select("part", "counts")
    level = np.zeros((64, CELLS // 64), np.uint8)
    for r in common.map_arrow(parts.repartitionById(64, F.col("part")), _levels_step, "part int, levels binary").collect():
        level[r.part] = np.frombuffer(r.levels, np.uint8)
    copies = common.cut(sketches.join(classes.select(F.col("row").alias("kept"), "content"), "content").where("row <> kept").select("row", "other").distinct())
    repeats = common.cut(sketches.groupBy("row", "other").count().where("count > 1").select("row", "other"))
    common.drop(spark, made.pop())

    def possible(na, nb, at_a, at_b):
        return F.least(na - at_a, nb - at_b) * (1 + similarity) >= similarity * (na + nb) - 1e-9

    def alike(pairs):
        """Those of the pairs that link."""
        pairs = common.cut(pairs.distinct())
        wanted = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
        own = staged(common.map_arrow(narrow.join(wanted, "row", "left_semi").dropDuplicates(["row"]).select("row", "text"), _sets_step(size), "row long, shingles array<long>"))
        shared = F.size(F.array_intersect("sa", "sb"))
        both = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")
        linked = common.cut(both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b"))
        common.drop(spark, made.pop())
        return linked

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    firsts = common.cut(classes.groupBy("fp").agg(F.min("row").alias("head")))
    within = classes.join(firsts, "fp").where("row <> head").select(*ordered(F.col("row"), F.col("head")))
    between = links(firsts.select("fp")).join(firsts.toDF("a", "ra"), "a").join(firsts.toDF("b", "rb"), "b").select(*ordered(F.col("ra"), F.col("rb")))
    hashed = within.union(between)

    fronts = common.map_arrow(narrow.select("row", "text"), _prefix_step(spark.sparkContext.broadcast(level.reshape(-1)), size, similarity), "token int, row long, n int, at int").join(copies.select("row"), "row", "left_anti")
    together = Window.partitionBy("token")
    shared_by = fronts.withColumn("c", F.count("*").over(together)).withColumn("head", F.min(F.struct("at", "row", "n")).over(together)).where("c > 1").drop("c")
    shared_by = staged(shared_by)
    to_heads = shared_by.where((F.col("row") != F.col("head.row")) & possible(F.col("n"), F.col("head.n"), F.col("at"), F.col("head.at")))
    values = classes.select(F.col("row").alias("node"), F.col("rank").alias("value"))
    first = alike(hashed.union(to_heads.select(*ordered(F.col("row"), F.col("head.row")))))
    groups = components(first, values).select(F.col("node").alias("row"), F.col("value.row").alias("group"))
    grouped = shared_by.select("token", "row", "n", "at").join(groups, "row", "left").withColumn("group", F.coalesce("group", "row"))
    several = grouped.groupBy("token").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least <> most").select("token")
    grouped = staged(grouped.join(several, "token", "left_semi"))
    common.drop(spark, made.pop(0))
    x, y = grouped.alias("x"), grouped.alias("y")
    apart = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.group") < F.col("y.group")) & possible(F.col("x.n"), F.col("y.n"), F.col("x.at"), F.col("y.at")))
    second = alike(apart.select(*ordered(F.col("x.row"), F.col("y.row"))))
    found = components(first.union(second), values)
    lost = common.cut(found.where("value.row <> node").select(F.col("node").alias("row")).join(classes.select("row", "other"), "row").union(copies))
    for path in made:
        common.drop(spark, path)
    kept = keyed.join(lost.toDF(r1, r2), [r1, r2], "left_anti")
    if not repeats.isEmpty():  # rows that are equal in every column: one of them stays
        again = repeats.toDF(r1, r2)
        kept = kept.join(again, [r1, r2], "left_anti").unionByName(kept.join(again, [r1, r2], "left_semi").dropDuplicates([r1, r2]))
    return kept.select(*[f"`{c}`" for c in docs.columns])
