"""TF-IDF over character n-grams of large tables, with grams as numbers.

Texts pass in blocks. A block tells its different grams apart once and sends each with the number of its
documents that hold it, one row for a block and bucket (grams are dealt to buckets by a hash); buckets add up
and answer with the totals. Then a block weighs its grams. So what is shuffled is a block's different grams
and its texts, never a row for a document and gram. Grams are compared by their code points, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.functions.batches import arrow_batch
from lexspark.plans.storage import staged

#: Bytes of text in a block, and those whose grams go to one bucket.
BLOCK_BYTES, BUCKET_BYTES = 3 << 20, 24 << 20


def packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def counted(texts: list[str], owner: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size (grams, document, gram, tf): the different grams' code points, each plus one, in rows
    filled up with zeros, in order of first occurrence; and the number of times that a document has one.
    owner: each text's document. No gram crosses from one text to the next."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return
    letters = np.flatnonzero(np.bincount(points))
    number = np.zeros(letters[-1] + 1, np.int64)
    number[letters] = np.arange(len(letters))
    single = number[points]
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
    left, owner = np.minimum(left, max(sizes)).astype(np.int8), np.repeat(owner.astype(np.int32), lengths)
    codes, most = single, len(letters)
    for n in range(1, max(sizes) + 1):
        if n > 1:
            if most * len(letters) >= 1 << 62:
                seen, codes = np.unique(codes, return_inverse=True)
                most = len(seen)
            codes, most = codes[:-1] * len(letters) + single[n - 1 :], most * len(letters)
        if n not in sizes or not len(codes):
            continue
        at = np.flatnonzero(left[: len(codes)] >= n)
        if not len(at):
            continue
        known = pa.array(codes[at]).dictionary_encode()
        gram, width = known.indices.to_numpy(), len(known.dictionary)
        place = np.empty(width, np.int64)
        place[gram] = at
        names = np.zeros((width, max(sizes)), "<u4")
        names[:, :n] = points[place[:, None] + np.arange(n)] + 1
        pairs = owner[at].astype(np.int64) * width + gram
        del at, gram, known
        pairs.sort()
        starts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        tf = np.diff(np.append(starts, len(pairs)))
        yield names, pairs[starts] // width, pairs[starts] % width, tf


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    mixed = np.zeros(len(names), np.uint64)
    for k in range(names.shape[1]):
        mixed = (mixed ^ names[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(buckets)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], np.ndarray]]:
    """(keys, texts, each text's place among the keys) of about BLOCK_BYTES; a longer row stands alone."""
    for batch in batches:
        lists, keys = batch.column("texts").to_pylist(), batch.column("key")
        start = held = 0
        for i, own in enumerate(lists):
            size = sum(map(len, own))
            if held and held + size > BLOCK_BYTES:
                yield keys.slice(start, i - start), [t for x in lists[start:i] for t in x], np.repeat(np.arange(i - start), [len(x) for x in lists[start:i]])
                start, held = i, 0
            held += size
        if start < len(lists):
            yield keys.slice(start), [t for x in lists[start:] for t in x], np.repeat(np.arange(len(lists) - start), [len(x) for x in lists[start:]])
        del lists
        pa.default_memory_pool().release_unused()


def _block_step(buckets: int, sizes: tuple[int, ...]):
    def step(batches):
        number = TaskContext.get().partitionId() << 32
        for keys, texts, owner in _blocks(batches):
            found = [(names, np.bincount(gram, minlength=len(names))) for names, _, gram, _ in counted(texts, owner, sizes)]
            if found:
                names, df = (np.concatenate(x) for x in zip(*found, strict=True))
                bucket = bucket_of(names, buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                parts = [order[cuts[b] : cuts[b + 1]] for b in full]
                yield _row(keys.type, bucket=full.astype(np.int32), block=np.full(len(full), number), grams=[packed(names[p]) for p in parts], df=[packed(df[p].astype("<u4")) for p in parts])
                yield _row(keys.type, bucket=np.full(1, -1, np.int32), block=np.full(1, number), keys=[keys], texts=[texts], owner=[owner.astype(np.int32)])
            number += 1

    return step


def _row(key: pa.DataType, *, keys=None, **columns) -> pa.RecordBatch:
    n = len(columns["bucket"])
    kinds = {"bucket": pa.int32(), "block": pa.int64(), "grams": pa.binary(), "df": pa.binary(), "texts": pa.list_(pa.string()), "owner": pa.list_(pa.int32())}
    out = {name: pa.array(columns.get(name, [None] * n), kind) for name, kind in kinds.items()}
    own = pa.ListArray.from_arrays(pa.array([0, len(keys[0])], pa.int32()), keys[0]) if keys else pa.nulls(n, pa.list_(key))
    return arrow_batch(**out, keys=own)


def _bucket_step(at_least: int, width: int):
    """The numbers of documents of all blocks together, to each block; 0 below at_least. Buckets are sorted."""

    def answers(bucket: int, blocks: list[int], grams: list[bytes], df: list[np.ndarray]):
        names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * width), sum(map(len, df)), [None, pa.py_buffer(b"".join(grams))])
        gram = names.dictionary_encode().indices.to_numpy()
        total = np.bincount(gram, weights=np.concatenate(df)).astype("<u4")
        total[total < at_least] = 0
        parts = np.split(total[gram], np.cumsum([len(x) for x in df])[:-1])
        return arrow_batch(bucket=pa.array([bucket] * len(blocks), pa.int32()), block=pa.array(blocks, pa.int64()), df=pa.array([packed(x) for x in parts], pa.binary()))

    def step(batches):
        now, blocks, grams, df = None, [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != now and blocks:
                    yield answers(now, blocks, grams, df)
                    blocks, grams, df = [], [], []
                now = r["bucket"]
                blocks.append(r["block"])
                grams.append(unpacked(r["grams"], "u1").tobytes())
                df.append(unpacked(r["df"], "<u4"))
        if blocks:
            yield answers(now, blocks, grams, df)

    return step


def _weigh_step(n_docs: int, buckets: int, sizes: tuple[int, ...]):
    """From a block's answers, in order of buckets, and then the block itself."""

    def step(batches):
        df = []
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("bucket")[i].as_py() >= 0:
                    df.append(unpacked(batch.column("df")[i].as_py(), "<u4"))
                    continue
                keys, owner = batch.column("keys")[i].values, batch.column("owner")[i].values.to_numpy()
                yield weighed(keys, batch.column("texts")[i].as_py(), owner, np.concatenate(df))
                df = []

    def weighed(keys, texts, owner, answered):
        found = list(counted(texts, owner, sizes))
        bucket = np.concatenate([bucket_of(names, buckets) for names, *_ in found])
        df = np.empty(len(bucket), np.int64)
        df[np.argsort(bucket, kind="stable")] = answered
        n, total, square, most, first = np.zeros(len(keys), np.int64), np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys)), 0
        while found:
            names, doc, gram, tf = found.pop(0)
            own = df[first : first + len(names)]
            first += len(names)
            idf = np.where(own > 0, np.log((1 + n_docs) / (1 + own)) + 1, 0.0)
            w = (1 + np.log(tf)) * idf[gram]
            n += np.bincount(doc, weights=own[gram] > 0, minlength=len(keys)).astype(np.int64)
            total += np.bincount(doc, weights=w, minlength=len(keys))
            square += np.bincount(doc, weights=w * w, minlength=len(keys))
            starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            most[doc[starts]] = np.maximum(most[doc[starts]], np.maximum.reduceat(w, starts))
        some = np.flatnonzero(n)
        norm = np.sqrt(square[some])
        return arrow_batch(key=keys.take(pa.array(some)), n_grams=n[some], total=total[some] / norm, most=most[some] / norm)

    return step


def weight_totals(docs: DataFrame, key: str, text: str, sizes: tuple[int, ...] = (3, 4, 5), at_least: int = 3) -> DataFrame:
    """(key, n_grams, total, most): of each key's TF-IDF weights over character n-grams, as features.tfidf()
    has them, their number, sum and greatest. Runs of white space are squeezed first. Rows of one key are one
    document of several texts, those of null key too; keys without weights have no row, but count."""
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.coalesce(T.squeeze_spaces(text), F.lit("")).alias("text"))
    facts = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    buckets = 1 + int((facts.bytes or 0) // BUCKET_BYTES)
    if rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        whole = rows.select("key", F.array("text").alias("texts"))
    else:
        whole = rows.groupBy("key").agg(F.collect_list("text").alias("texts"))
    schema = f"bucket int, block long, grams binary, df binary, texts array<string>, owner array<int>, keys array<{kind.simpleString()}>"
    blocks = staged(whole.mapInArrow(_block_step(buckets, sizes), schema), "ngram-blocks")
    asked = blocks.where("bucket >= 0").select("bucket", "block", "grams", "df").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "block")
    answers = asked.mapInArrow(_bucket_step(at_least, max(sizes)), "bucket int, block long, df binary")
    own = blocks.where("bucket < 0").select("bucket", "block", "df", "texts", "owner", "keys")
    none = F.lit(None)
    both = answers.select("bucket", "block", "df", none.cast("array<string>").alias("texts"), none.cast("array<int>").alias("owner"), none.cast(own.schema["keys"].dataType).alias("keys")).union(own)
    dealt = both.repartition(max(1, own.count()), "block").sortWithinPartitions("block", F.col("bucket") < 0, "bucket")
    weights = dealt.mapInArrow(_weigh_step(facts.n, buckets, sizes), f"key {kind.simpleString()}, n_grams long, total double, most double")
    return weights.withColumnRenamed("key", key)
