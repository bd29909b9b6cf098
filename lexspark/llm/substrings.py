"""Exact repeated substrings, by merged Burrows-Wheeler transforms.

A byte is removed if a string of `size` bytes that covers it also starts anywhere else, in this document or
another. Texts are UTF-8 bytes, null ones empty; matches never cross documents.

1. Every string of `size` bytes has an anchor: of the K-byte strings in it that of least hash, the leftmost
   of equals. Equal strings have equal anchors at equal offsets. A document falls into pieces, runs of
   strings that share an anchor's place. Pieces that are equal as a whole are repeated throughout and need no
   further look, nor do pieces alone with their anchor. Equal pieces of a slice of texts become one before
   anything is shuffled; pieces are dealt by anchor, but where a slice holds over CROWD different ones around
   an anchor, by anchor and content, with a note to the anchor's home that there are others.
2. Left are different pieces around one anchor. By how far in the anchor lies, their strings fall into
   CLASSES classes; equal strings of a class agree in its core, the bytes that all its strings have in
   common. Pieces without a partner in any core are dropped, the others cut to the classes that have
   one. One piece of each content is fetched and dealt by anchor. There the pieces form shards, and each shard's transform is
   made by doubling of ranks (over rotations of each piece with an end mark, as far as `size` bytes).
3. Shard transforms are merged by refining their interleaving: each round puts each suffix, stably, behind the
   symbols that precede it, some at a time, so after t symbols suffixes stand in the order of their first t
   although none is compared. Beside the interleaving goes where these begin to differ from the neighbour's;
   a suffix that differs from both is settled and leaves. What is left after `size` symbols has a common prefix of
   `size` bytes with a neighbour: the repeated strings.

Work and memory follow the input. A group that is merged holds HEAVY pieces at most: the pieces around an
anchor, or where these are more, those of one core (a piece then takes part in the groups of all its cores,
each time with the strings of that class). Small groups share chunks of CHUNK bytes. Pieces that share a core
with more than HEAVY go another exact way, by counts of their strings' 128-bit
hashes, as DataFrame aggregation, so that no task holds a group. Pieces that share any core with one of those
go both ways, so every two pieces of a core meet on one of them. Repeated rows are copies of each other. Rows with null
identifiers are treated like others. Only the two named columns are read; empty tables give empty results. Very
long texts are cut to overlapping stretches. `size` is from K + CLASSES to MOST; others are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import common

K, CLASSES = 24, 4
CHUNK, SHARDS, HEAVY, CROWD = 1 << 20, 4, 3000, 16
#: Symbols that a round of merging takes at most, a power of two.
WIDEST = 32
#: The greatest size, whose places fit their fields, and bytes of text that are searched at once.
MOST, STRETCH = 2000, 1 << 26
_SYMBOLS = (np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(2**28 - 1)
END = 255  # never a byte of UTF-8


def core_step(size: int) -> int:
    return -(-(size - K) // CLASSES)


def hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte strings."""
    h, width = _SYMBOLS[data], 1
    out = None
    at = 0
    while k:  # powers of two that add up to k
        if k & 1:
            part = h[at:] if at else h
            out = part if out is None else out[: len(part)] * _MIX + part[: len(out)]
            at += width
        k >>= 1
        if k:
            h = h[:-width] * _MIX + h[width:]
            h ^= h >> np.uint64(29)
            width *= 2
    return out ^ (out >> np.uint64(31))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def pieces_of(data: np.ndarray, ends: np.ndarray, size: int):
    """(text number, first byte, byte behind the last, anchor's first byte, anchor's hash) of all pieces of
    the texts that stand one after another in data; bytes are numbered from their text's first one."""
    none = np.zeros(0, np.int64)
    if len(data) < size:
        return none, none, none, none, none.view(np.uint64)
    h = hashes(data, K)
    keyed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    place = (sliding_min(keyed, size - K + 1) & _PLACE).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    text = np.repeat(np.arange(len(ends), dtype=np.int32), ends - starts)
    i = np.flatnonzero(text[: len(place)] == text[size - 1 : size - 1 + len(place)])
    if not len(i):
        return none, none, none, none, none.view(np.uint64)
    p = place[i]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 0) | (np.diff(i) != 1))))
    last = np.concatenate((first[1:], [len(i)])) - 1
    a, b, m = i[first], i[last] + size, p[first]
    t = text[a].astype(np.int64)
    return t, a - starts[t], b - starts[t], m - starts[t], h[m]


PIECES = "kind int, anchor long, content long, k1 long, k2 long, place long, cores0 long, cores1 long"
#: Kinds of rows: a piece, one that is repeated in its slice, a note that an anchor has pieces elsewhere, a piece
#: around a crowded anchor.
PIECE, WHOLE, NOTE, CROWDED = range(4)


def stretches(data: bytes, size: int):
    """(offset, bytes): overlapping parts that hold every string once."""
    for at in range(0, max(1, len(data) - size + 1), STRETCH):
        yield at, data[at : at + STRETCH + size - 1]


def _pieces_step(size: int):
    def step(batches):
        width = core_step(size)
        digest = xxhash.xxh3_64_intdigest
        for batch in common.slices(batches):
            seen: dict[tuple, int] = {}
            texts, keys = [], []
            for t, *key in zip(batch.column("text").to_pylist(), batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True):
                seen[tuple(key)] = n = seen.get(tuple(key), 0) + 1
                if n <= 2:  # further copies in this batch tell nothing new
                    for at, part in stretches(t.encode("utf-8", "surrogatepass"), size):
                        texts.append(part)
                        keys.append((*key, at))
            joined = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts])
            t, a, b, m, h = pieces_of(np.frombuffer(joined, np.uint8), ends, size)
            if not len(t):
                continue
            base = (ends - [len(x) for x in texts])[t]
            view = memoryview(joined)
            content = np.fromiter([digest(view[x:y]) for x, y in zip((a + base).tolist(), (b + base).tolist(), strict=True)], np.uint64, len(t))
            _, first, which, count = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
            named = np.array(keys, np.int64).reshape(-1, 3)[t]
            place = ((a + named[:, 2]) << 24) | ((m - a) << 12) | (b - a)
            whole = np.flatnonzero(count[which] > 1)
            # one of each content goes on, with what its strings have in common by class
            a, b, m, base = a[first], b[first], m[first], base[first]
            cores = []
            for j in range(CLASSES):  # all strings whose anchor lies j to j + 1 steps in
                begin = m - j * width
                fits = (begin >= a) & (begin + size - width <= b)
                at = (begin + base)[fits]
                core = np.zeros(len(m), np.uint64)
                core[fits] = np.fromiter([digest(view[x : x + size - width]) | 1 for x in at.tolist()], np.uint64, len(at)) & np.uint64(2**32 - 1)
                cores.append(core)
            anchors, anchor, around = np.unique(h[first], return_inverse=True, return_counts=True)
            noted = anchors[around > CROWD].view(np.int64)
            none, more = np.zeros(len(whole), np.int64), np.zeros(len(noted), np.int64)
            columns = {
                "kind": (np.where(around[anchor] > CROWD, CROWDED, PIECE), none + WHOLE, more + NOTE),
                "anchor": (h[first].view(np.int64), none, noted),
                "content": (content[first].view(np.int64), none, more + np.iinfo(np.int64).min),
                "k1": (named[first, 0], named[whole, 0], more),
                "k2": (named[first, 1], named[whole, 1], more),
                "place": (place[first], place[whole], more),
                "cores0": (((cores[0] << np.uint64(32)) | cores[1]).view(np.int64), none, more),
                "cores1": (((cores[2] << np.uint64(32)) | cores[3]).view(np.int64), none, more),
            }
            yield common.arrow_batch(**{c: pa.array(np.concatenate(x), pa.int32() if c == "kind" else pa.int64()) for c, x in columns.items()})

    return step


FOUND = "mixed boolean, anchor long, content long, k1 long, k2 long, place long, cores0 long, cores1 long"


def _classes_step(batches):
    """From pieces in order of (anchor, content): those whose content stands twice (mixed false), and one
    piece of each content of anchors with several contents or notes (mixed true). One piece is held over."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    held = None  # (row, its class has two pieces or more so far, its class went out before)

    def out(mixed, rows):
        rows = rows[:, rows[0] != NOTE]
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows.shape[1], mixed)), *(pa.array(r) for r in rows[1:])], names=["mixed", *names[1:]])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])
        whole = rows[0] == WHOLE
        if whole.any():
            yield out(False, rows[:, whole])
            rows = rows[:, ~whole]
            if not rows.shape[1]:
                continue
        two, later = False, False
        if held is not None:
            rows, two, later = np.concatenate((held[0], rows), axis=1), held[1], held[2]
        new_anchor = np.concatenate(([True], rows[1, 1:] != rows[1, :-1]))
        new = new_anchor | np.concatenate(([True], rows[2, 1:] != rows[2, :-1]))
        first = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        count = np.bincount(number)
        count[0] += two
        repeated = (count >= 2)[number]
        emit = repeated.copy()
        if held is not None and two:
            emit[0] = False  # it went out before
        not_first = ~new_anchor[first] | np.logical_or.reduceat(rows[0] == CROWDED, first)
        followed = np.concatenate((~new_anchor[first][1:], [False]))
        rep = not_first | followed
        last = bool(not_first[-1])
        if held is not None and later:
            rep[0] = False  # went out before
            last = last or len(first) == 1
        if emit.any():
            yield out(False, rows[:, emit])
        if rep.any():
            yield out(True, rows[:, first[rep]])
        held = (rows[:, first[-1] : first[-1] + 1], bool(count[-1] >= 2), last)


def shard_transform(data: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, transform, steps) of the rotations of pieces that end at `ends` (each with its END symbol),
    sorted by their first `depth` symbols, two at least. transform: the symbol before each rotation's
    first; steps: where the rotation that begins there stands in the order."""
    starts = np.concatenate(([0], ends[:-1]))
    length = ends - starts
    begin = np.repeat(starts, length)
    span = np.repeat(length, length)
    offset = np.arange(len(data)) - begin

    def ahead(k):
        return begin + (offset + k) % span

    rank, width = data.astype(np.uint64), 1
    while width < min(8, depth):
        rank, width = (rank << np.uint64(8 * width)) | rank[ahead(width)], 2 * width
    order = np.argsort(rank)
    rank = rank[order]
    first = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
    group = np.repeat(first, np.diff(np.append(first, len(data))))  # by place in the order: where its equals begin
    rank = np.empty(len(data), np.int64)
    rank[order] = group
    while width < depth:
        alike = np.append(group[1:] == group[:-1], False)
        open_ = np.flatnonzero(alike | np.concatenate(([False], alike[:-1])))
        if not len(open_):
            break
        shift = min(width, depth - width)
        own = order[open_]
        pair = group[open_] * len(data) + rank[begin[own] + (offset[own] + shift) % span[own]]
        by = np.argsort(pair)
        own, pair = own[by], pair[by]
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        order[open_] = own
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        rank[own] = group[open_]
        width += shift
    place = np.empty(len(data), np.int32)
    place[order] = np.arange(len(data), dtype=np.int32)
    before = ahead(-1)[order]
    return order, data[before], place[before]


def merge_transforms(transforms: list[tuple[np.ndarray, np.ndarray]], depth: int) -> np.ndarray:
    """Suffixes, as numbers that run on from shard to shard, whose first `depth` symbols another suffix
    shares. transforms: (symbols, steps) of each shard.

    The interleaving begins as one shard after another. A round puts the suffixes that begin WIDEST symbols
    earlier (fewer, to begin with, if depth is no multiple), found by the steps, in the order of these symbols,
    else of the interleaving so far; a block is what shares its symbols up to now. A block of one suffix is
    settled, and so are all that extend it, so only what lies in larger blocks goes on to the next round. A suffix
    that would need its piece's END symbol leaves. Symbols go by names: numbers of the different strings of
    their length, in order."""
    offsets = np.cumsum([0, *(len(t) for t, _ in transforms)])
    step = np.concatenate([x + o for (_, x), o in zip(transforms, offsets, strict=False)]).astype(np.int32)
    name = np.concatenate([t for t, _ in transforms]).astype(np.uint32)
    inside, width, kinds = name != END, 1, {}
    while True:
        if depth // width % 2 or width == WIDEST:
            kinds[width] = (name.astype(np.uint16), (name >> np.uint32(16)).astype(np.uint16) if name.max(initial=0) >> 16 else None, inside, step)
        if width == WIDEST or 2 * width > depth:
            break
        inside = inside & inside[step]
        if width == 1:
            name = (name[step] << np.uint32(8)) | name
        else:
            _, name = np.unique((name[step].astype(np.uint64) << np.uint64(32)) | name, return_inverse=True)
            name = name.astype(np.uint32)
        step, width = step[step], 2 * width
    suffixes = np.arange(len(step), dtype=np.int32)
    block = np.zeros(len(step), np.int32)
    for width in [w for w in kinds if w < WIDEST and depth % WIDEST & w] + [WIDEST] * (depth // WIDEST):
        low, high, inside, steps = kinds[width]
        kept = np.flatnonzero(inside[suffixes])
        suffixes, block = suffixes[kept], block[kept]
        now = low[suffixes]
        order = np.argsort(now, kind="stable")  # of 16 bits: by counting
        if high is not None:
            upper = high[suffixes[order]]
            again = np.argsort(upper, kind="stable")
            order, upper = order[again], upper[again]
        now, suffixes, block = now[order], suffixes[order], block[order]
        differs = np.empty(len(suffixes) + 1, bool)
        differs[0] = differs[-1] = True
        np.logical_or(now[1:] != now[:-1], block[1:] != block[:-1], out=differs[1:-1])
        if high is not None:
            differs[1:-1] |= upper[1:] != upper[:-1]
        shared = np.flatnonzero(~(differs[1:] & differs[:-1]))
        block = np.cumsum(differs[:-1], dtype=np.int32)[shared]
        suffixes = steps[suffixes[shared]]
        if not len(suffixes):
            break
    return suffixes


def repeated_strings(pieces: list[bytes], size: int, shards: int = SHARDS) -> list[np.ndarray]:
    """For each piece the places at which a string of `size` bytes starts that also starts elsewhere."""
    number: dict[bytes, int] = {}
    which_piece = [number.setdefault(p, len(number)) for p in pieces]
    distinct = list(number)
    dealt = [list(range(s, len(distinct), shards)) for s in range(min(shards, len(distinct)))]
    transforms, pieces_at, starts_at = [], [], []
    for own in dealt:
        data = np.frombuffer(b"".join(distinct[k] + bytes([END]) for k in own), np.uint8)
        lengths = np.array([len(distinct[k]) + 1 for k in own])
        ends = np.cumsum(lengths)
        order, transform, steps = shard_transform(data, ends, size)
        transforms.append((transform, steps))
        pieces_at.append(np.repeat(np.array(own), lengths)[order])
        starts_at.append((np.arange(len(data)) - np.repeat(ends - lengths, lengths))[order])
    found = merge_transforms(transforms, size)
    piece, start = np.concatenate(pieces_at)[found], np.concatenate(starts_at)[found]
    order = np.lexsort((start, piece))
    piece, start = piece[order], start[order]
    cuts = np.searchsorted(piece, np.arange(len(distinct) + 1))
    copies = np.bincount(which_piece, minlength=len(distinct))
    # copies of a piece repeat all its strings
    out = [np.arange(len(distinct[k]) - size + 1) if copies[k] > 1 else start[cuts[k] : cuts[k + 1]] for k in range(len(distinct))]
    return [out[k] for k in which_piece]


def runs_of(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Bytes that strings of `size` at ascending starts cover, as (first, behind the last)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > size)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.concatenate((cut, [len(starts) - 1]))] + size).tolist(), strict=True))


MARKS = "k1 long, k2 long, start long, stop long"


def _merge_step(size: int):
    def step(batches):
        held, weight, group = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("group", "k1", "k2", "first", "bytes")), strict=True):
                if row[0] != group and weight > CHUNK:
                    yield from marked(held)
                    held, weight = [], 0
                group = row[0]
                held.append(row)
                weight += len(row[4])
        if held:
            yield from marked(held)

    def marked(rows):
        out: list[tuple] = []
        for row, starts in zip(rows, repeated_strings([r[4] for r in rows], size), strict=True):
            out += [(row[1], row[2], row[3] + a, row[3] + b) for a, b in runs_of(starts, size)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in MARKS.split(", ")])

    return step


def _fetch_step(batches):
    """The bytes of asked pieces."""
    for batch in common.slices(batches):
        out = []
        for text, asked in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            out += [(r["group"], r["k1"], r["k2"], r["first"], data[r["first"] : r["first"] + r["length"]], r["heavy"], r["light"]) for r in asked]
        if out:
            c = list(zip(*out, strict=True))
            yield common.arrow_batch(group=pa.array(c[0], pa.int64()), k1=pa.array(c[1], pa.int64()), k2=pa.array(c[2], pa.int64()), first=pa.array(c[3], pa.int64()), bytes=pa.array(c[4], pa.binary()), heavy=pa.array(c[5], pa.bool_()), light=pa.array(c[6], pa.bool_()))


def _strings_step(size: int):
    """128-bit hashes of every string of pieces around crowded anchors."""

    def step(batches):
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, first, data in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "first", "bytes")), strict=True):
                for i in range(len(data) - size + 1):
                    h = xxhash.xxh3_128_intdigest(data[i : i + size])
                    out.append(((h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63, k1, k2, first + i))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["h1", "h2", "k1", "k2", "start"])

    return step


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut_step(batches):
    for batch in common.slices(batches):
        rows = []
        for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            data, kept, at, spans = text.encode("utf-8", "surrogatepass"), [], 0, []
            for m in sorted((m["start"], m["stop"]) for m in marks or ()):
                if spans and m[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], m[1])
                else:
                    spans.append([*m])
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            left = b"".join(kept)
            rows.append((len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
        c = list(zip(*rows, strict=True))
        yield common.arrow_batch(doc_id=batch.column("doc_id"), n_bytes=pa.array(c[0], pa.int64()), n_removed=pa.array(c[1], pa.int64()), n_spans=pa.array(c[2], pa.int64()), kept_sha256=pa.array(c[3]))


def repeated_spans(docs: DataFrame, size: int = 200, heavy: int = HEAVY) -> DataFrame:
    """(k1, k2, marks): for each distinct text with repeated strings, by its two hashes, the byte runs."""
    if not K + CLASSES <= size <= MOST:
        raise ValueError(f"size must be from {K + CLASSES} to {MOST}")
    pieces = common.map_arrow(docs.select("k1", "k2", "text").where(F.octet_length("text") >= size), _pieces_step(size), PIECES)
    home = F.when(F.col("kind") == CROWDED, F.xxhash64("anchor", "content")).when(F.col("kind") == WHOLE, F.xxhash64("k1", "place")).otherwise(F.xxhash64("anchor"))
    ordered = pieces.repartition(home).sortWithinPartitions("anchor", "content")
    found = common.staged(common.map_arrow(ordered, _classes_step, FOUND), "substring-pieces")
    whole = found.where(~F.col("mixed")).select("k1", "k2", F.shiftright("place", 24).alias("start"), (F.shiftright("place", 24) + F.col("place").bitwiseAND(F.lit(4095))).alias("stop"))
    mixed = found.where("mixed").drop("mixed")
    cores = [half(c) for c in ("cores0", "cores1") for half in (lambda c: F.shiftrightunsigned(c, 32), lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))]
    sided = mixed.select("*", F.explode(F.array(*[F.struct(F.lit(j).alias("side"), c.alias("part")) for j, c in enumerate(cores)])).alias("s")).select("anchor", "content", "k1", "k2", "place", "s.side", "s.part").where("part <> 0")
    partnered = sided.groupBy("anchor", "side", "part").agg(F.count("*").alias("n")).where("n > 1")
    partnered = common.cut(partnered)
    cored = sided.join(partnered, ["anchor", "side", "part"]).withColumn("touched", F.lit(False))
    heavies = partnered.where(F.col("n") > heavy)
    if not heavies.isEmpty():
        hot = sided.join(heavies, ["anchor", "side", "part"], "left_semi").select("anchor", "content").distinct()
        touched = sided.join(hot, ["anchor", "content"], "left_semi").select("anchor", "side", "part").distinct()
        cored = cored.drop("touched").join(touched.withColumn("touched", F.lit(True)), ["anchor", "side", "part"], "left").withColumn("touched", F.coalesce("touched", F.lit(False)))
    whose = F.min(F.struct("k1", "k2", "place")).alias("p")
    asked = cored.groupBy("anchor", "content").agg(whose, F.max("n").alias("n"), F.max("touched").alias("touched"), F.min("side").alias("first_side"), F.max("side").alias("last_side"))
    # of a piece, what the strings of classes with partners span
    step = core_step(size)
    start, anchor_at, length = F.shiftright("p.place", 24), F.shiftright("p.place", 12).bitwiseAND(F.lit(4095)), F.col("p.place").bitwiseAND(F.lit(4095))
    skip = F.greatest(F.lit(0), anchor_at - (F.col("last_side") + 1) * step)
    stop = F.least(length, anchor_at - F.col("first_side") * step + size)
    span = ["p.k1", "p.k2", (start + skip).alias("first"), (stop - skip).alias("length")]
    asked = common.cut(asked.select("anchor", F.col("anchor").alias("group"), *span, F.col("touched").alias("heavy"), (F.col("n") <= heavy).alias("light")).where(F.col("length") >= size))
    big = common.cut(asked.where("light").groupBy("anchor").count().where(F.col("count") > heavy).select("anchor"))
    if not big.isEmpty():  # of these, each core is a group of its own
        by_core = cored.where(F.col("n") <= heavy).join(big, "anchor", "left_semi").groupBy("anchor", "content", "side", "part").agg(whose)
        by_core = by_core.withColumns({"first_side": F.col("side"), "last_side": F.col("side")}).select("anchor", F.xxhash64("anchor", "side", "part").alias("group"), *span, F.lit(False).alias("heavy"), F.lit(True).alias("light")).where(F.col("length") >= size)
        known = big.withColumn("big", F.lit(True))
        rest = asked.join(known, "anchor", "left").withColumn("light", F.col("light") & F.col("big").isNull()).drop("big").where("light or heavy")
        asked = common.cut(rest.select(*asked.columns).union(by_core))
    by_text = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("group", "k1", "k2", "first", "length", "heavy", "light")).alias("asked"))  # no more than a text has pieces, CLASSES times
    once = docs.select("k1", "k2", "text").where(F.octet_length("text") >= size).join(by_text, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    fetched = common.map_arrow(once.select("text", "asked"), _fetch_step, "group long, k1 long, k2 long, first long, bytes binary, heavy boolean, light boolean")
    fetched = common.staged(fetched, "substring-bytes")
    # merging takes long for its bytes, so its tasks get few: a number of partitions of its own
    weight = fetched.where("light").agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    light = fetched.where("light").repartition(1 + weight // (2 * CHUNK), "group").sortWithinPartitions("group")
    merged = common.map_arrow(light.select("group", "k1", "k2", "first", "bytes"), _merge_step(size), MARKS)
    marks = whole.union(merged)
    crowded = fetched.where("heavy")
    if not crowded.isEmpty():
        strings = common.staged(common.map_arrow(crowded.select("k1", "k2", "first", "bytes"), _strings_step(size), "h1 long, h2 long, k1 long, k2 long, start long"), "substring-strings")
        twice = strings.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
        marks = marks.union(strings.join(twice, ["h1", "h2"]).select("k1", "k2", "start", (F.col("start") + size).alias("stop")))
    longest = marks.groupBy("k1", "k2", "start").agg(F.max("stop").alias("stop"))
    return longest.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("marks"))


def remove(docs: DataFrame, size: int = 200, *, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    text = common.text_of(text_col)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    marks = repeated_spans(keyed, size, heavy)
    return common.map_arrow(keyed.join(marks, ["k1", "k2"], "left").select("doc_id", "text", "marks"), _cut_step, SCHEMA)
