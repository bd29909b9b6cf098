"""Order-preserving packing of token ids into windows, by dynamic programming.

Documents stand in ascending identifier order; a cut between windows may lie behind a document, behind
a sentence, or, only inside a sentence longer than a STRIDES-th of a window, at steps of that length. The windows of a
block of ids are those of least cost: padding in ids, plus SENTENCE_COST or FORCED_COST for a cut that
splits a document. With places p of possible cuts, best[j] = min over p[j] - p[i] <= size of
best[i] + size - (p[j] - p[i]) + cost[j]; the window's least best[i] + p[i] is kept in a monotone queue,
so a block takes time in proportion to its cuts.

Each task packs a range of identifiers, in blocks of about BLOCK_WINDOWS windows so that memory stays
bounded; what lies behind the last full window of a block goes on to the next block. The rest at a
task's end is cut into windows of powers of two, which need no padding.

Every id lies in exactly one piece. A null text is an empty one (its only id is the end id), rows that
share an identifier are packed one after another (those of equal text too by one task), an empty table gives no pieces, other columns are
left out. A document longer than a window spans several.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import common
from lexspark.llm.encoding import encoder

BLOCK_WINDOWS = 128
STRIDES = 32
SENTENCE_COST, FORCED_COST = 2, 16


def best_cuts(places: np.ndarray, costs: np.ndarray, size: int, tail_free: bool) -> list[int]:
    """Indices of the chosen cuts, ascending. places ascend by at most `size` a step, from 0 on.

    Without tail_free the last window reaches the last place at any padding; with it the rest may stay
    uncut: the last chosen cut is the cheapest that lies within one window of the end."""
    p, c = places.tolist(), costs.tolist()
    n = len(p)
    best, back = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])
    value = [0.0] * n  # best[i] + p[i]
    for j in range(1, n):
        while p[j] - p[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        best[j] = value[i] + size - p[j] + c[j]
        back[j] = i
        value[j] = best[j] + p[j]
        while queue and value[queue[-1]] >= value[j]:
            queue.pop()
        queue.append(j)
    j = n - 1
    if tail_free:
        j = min((i for i in range(n - 1, -1, -1) if p[-1] - p[i] < size), key=lambda i: (value[i], -i))
    cuts = []
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def cut_places(ids: np.ndarray, ends: np.ndarray, sentence_ids: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, costs) of possible cuts in a block of ids; ends: where each document ends."""
    after = np.flatnonzero(np.isin(ids, sentence_ids)) + 1
    places = np.concatenate(([0], after, ends, [len(ids)]))
    costs = np.concatenate(([0.0], np.full(len(after), float(SENTENCE_COST)), np.zeros(len(ends)), [0.0]))
    order = np.lexsort((costs, places))
    places, costs = places[order], costs[order]
    keep = np.concatenate(([True], np.diff(places) > 0))
    places, costs = places[keep], costs[keep]
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > stride)
    if len(wide):
        more = np.concatenate([np.arange(places[k] + stride, places[k + 1], stride) for k in wide])
        places, costs = np.concatenate((places, more)), np.concatenate((costs, np.full(len(more), float(FORCED_COST))))
        order = np.argsort(places, kind="stable")
        places, costs = places[order], costs[order]
    return places, costs


def powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Takes documents in order; pieces() gives (row of document, start, length, crc, doc_tokens, window, offset)."""

    def __init__(self, size: int, sentence_ids: np.ndarray):
        self.size, self.sentence_ids = size, sentence_ids
        self.ids, self.docs = [], []  # arrays; (name, start in the document, ids in this buffer, doc_tokens)
        self.held = self.window = 0

    def add(self, name, ids: np.ndarray):
        whole, at, most = len(ids), 0, self.size * BLOCK_WINDOWS
        while at < whole:  # a document longer than a block is taken in parts
            part = ids[at : at + most]
            self.ids.append(part)
            self.docs.append((name, at, len(part), whole))
            self.held += len(part)
            at += len(part)
            if self.held >= most:
                yield from self._pack(False)

    def finish(self):
        if self.held:
            yield from self._pack(True)

    def _pack(self, last: bool):
        ids = np.concatenate(self.ids)
        lengths = np.array([d[2] for d in self.docs])
        begins = np.cumsum(lengths) - lengths
        done = np.array([d[1] + d[2] == d[3] for d in self.docs])
        places, costs = cut_places(ids, (begins + lengths)[done], self.sentence_ids, max(1, self.size // STRIDES))
        cuts = places[best_cuts(places, costs, self.size, True)].tolist()
        if last:
            rest = len(ids) - (cuts[-1] if cuts else 0)
            for n in powers(rest):
                cuts.append((cuts[-1] if cuts else 0) + n)
        begin, k = 0, 0
        for end in cuts:
            at = begin
            while at < end:
                name, start, n, whole = self.docs[k]
                stop = min(end, int(begins[k]) + n)
                yield name, start + at - int(begins[k]), stop - at, zlib.crc32(ids[at:stop].astype("<u4").tobytes()), whole, self.window, at - begin
                at = stop
                if stop == int(begins[k]) + n:
                    k += 1
            self.window += 1
            begin = end
        if begin == len(ids):
            self.ids, self.docs, self.held = [], [], 0
            return
        name, start, n, whole = self.docs[k]
        gone = begin - int(begins[k])
        self.docs = [(name, start + gone, n - gone, whole), *self.docs[k + 1 :]]
        self.ids, self.held = [ids[begin:].copy()], len(ids) - begin


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sentence_end_ids(tokenizer) -> np.ndarray:
    """Ids whose text closes a sentence."""
    marks = set(".!?。！？")
    return np.array(sorted(i for token, i in tokenizer.get_vocab().items() if (bare := token.removesuffix("</w>")) and set(bare) <= marks), np.uint32)


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sequence_id is the task's number times 2^33 plus the window's number there: a range of identifiers
    lies in one task, so sequence_id ascends with doc_id."""

    def step(batches):
        coder = encoder(tokenizer)
        packer = Packer(size, sentence_end_ids(coder.tokenizer))
        base = TaskContext.get().partitionId() << 33

        def out(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*columns[:5], [base + w for w in columns[5]], columns[6])], names=[x.split()[0] for x in SCHEMA.split(", ")])

        end = np.array([end_id], np.uint32)
        for batch in common.slices(batches):
            values, at = coder.encode(batch.column("text"))
            rows: list = []
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                rows += packer.add(doc_id, np.concatenate((values[at[k] : at[k + 1]], end)))
            if rows:
                yield out(rows)
        if rows := list(packer.finish()):
            yield out(rows)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    ranged = narrow.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return common.map_arrow(ranged, step, SCHEMA)
