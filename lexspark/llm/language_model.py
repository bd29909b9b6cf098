"""A hierarchical Pitman-Yor language model, sampled by Gibbs, and the scores it gives.

Each token has a context of three levels, as in a trie of suffixes: the word before it together with its
class, the class alone, and nothing. A class is the last of the CLASSES commonest words that stands before
the token in its text, or none; the word before is told apart by a hash into HASHES (the text's beginning is
a word of its own). Each context has a restaurant whose dishes are words; its parent is the restaurant one
level up, and above the last is the uniform distribution over the words known from training and one more
for all unknown ones. The end of a text is a word like others.

Seating is sampled by Gibbs in blocks: a sweep draws each dish's number of tables in each restaurant from
its full conditional, given the parent's present probability (the arrangement at tables is summed out, by
generalised Stirling numbers; past EXACT customers by their limit). Tables are
the parent's customers, which are seated likewise. Words are dealt to buckets; given the restaurants' totals
(tables) buckets are independent. ROUNDS rounds of SWEEPS sweeps each start from the totals of the round
before; each of the last SAMPLES rounds gives a sample, of seats and the totals of these very seats, so its
probabilities sum to one. A token's predictive probability is averaged over the samples. Discounts are
n1 / (n1 + 2 n2), of the dishes that a level's restaurants serve once and twice.

Counts cover all training texts. Texts pass in blocks; a block keeps its texts as numbers of its own
distinct words. Pairs of word and context are counted in the block first and dealt by the word's hash, one
row for a block and bucket, so a frequent pair is one entry a block; buckets answer with counts and
probabilities, which go back to the blocks. The commonest words and the end have their pairs dealt by class
too, as one bucket couldn't hold theirs; what their slices share is part of the totals. Only totals are
broadcast: (CLASSES + 1) x (HASHES + 1) numbers and a few for each of the commonest words.

Null texts are empty: their only token is the end. Whether a text is for training is decided by its
identifier; rows of null identifier are held out. Repeated rows count as often as they stand. Without
training texts all words are unknown. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import common

CLASSES, HASHES = 24, 1 << 14
CONTEXTS = (CLASSES + 1) * HASHES
#: Words whose pairs are dealt by class: the commonest ones, and the end as the last.
END_OF_TEXT, HOT = "", CLASSES + 2
ROUNDS, SWEEPS, SAMPLES = 4, 2, 2
STRENGTH = 1.0
EXACT, GRID = 1024, 256
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 8 << 20
PRIOR = 0.1
#: Steps of a power of ten in which probabilities are sent.
FINE = 1 << 19


def held_out(doc_id: int | None, fold: int = 10) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % fold == 0


@functools.lru_cache(16)
def stirling_logs(discount: float) -> np.ndarray:
    """[n, t] logarithms of the generalised Stirling numbers: the weight of all ways to seat n customers of a
    dish at t tables."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(EXACT + 1)
    for n in range(1, EXACT):
        stay = np.log(np.maximum(n - discount * t, 1e-300)) + out[n]
        out[n + 1, 1:] = np.logaddexp(out[n, :-1], stay[1:])
    return out


def seat(counts: np.ndarray, strength: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of so many customers of a dish, drawn from their conditional distribution; strength:
    the weight of a new table, the parent's probability of the dish included."""
    counts = np.asarray(counts).astype(np.int64)
    tables = (counts > 0).astype(np.float64)
    some = np.flatnonzero((counts > 1) & (counts <= EXACT))
    some = some[np.argsort(counts[some], kind="stable")]
    logs = stirling_logs(float(discount)) if len(some) else None
    for n, own in zip(*_runs(counts[some], some), strict=True):
        weights = logs[n, 1 : n + 1] + np.log(np.maximum(strength[own], 1e-300))[:, None] * np.arange(1, n + 1)
        weights = np.cumsum(np.exp(weights - weights.max(axis=1, keepdims=True)), axis=1)
        tables[own] = 1 + (weights < (rng.random(len(own)) * weights[:, -1])[:, None]).sum(axis=1)
    many = np.flatnonzero(counts > EXACT)
    if len(many):
        tables[many] = _seat_many(counts[many], np.maximum(strength[many], 1e-300), discount, rng)
    return tables


def _seat_many(counts: np.ndarray, strength: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """As seat(), past EXACT customers. t tables weigh as a Poisson variable of mean strength / discount, times
    the chance that so many independent table sizes add up to the customers; sizes have a heavy tail, so that
    chance for n is about that for EXACT at t x (EXACT / n) ** discount. Drawn over GRID values of t."""
    t = np.arange(1, EXACT + 1)
    chance = stirling_logs(float(discount))[EXACT, 1:] + log_gamma(t + 1.0) + t * np.log(discount)
    mean = strength / discount
    step = np.maximum(1, np.ceil(np.minimum(counts, mean + 8 * np.sqrt(mean) + 20) / GRID))
    tables = 1 + step[:, None] * np.arange(GRID)
    like = tables * ((EXACT / counts) ** discount)[:, None]
    weight = tables * np.log(mean)[:, None] - log_gamma(tables + 1) + np.interp(like, t, chance) + np.log(np.minimum(like, 1.0))
    weight[tables > counts[:, None]] = -np.inf
    return np.take_along_axis(tables, (weight + rng.gumbel(size=tables.shape)).argmax(axis=1)[:, None], axis=1)[:, 0]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, shifted by ten."""
    z = x + 10
    out = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3)
    for k in range(10):
        out -= np.log(x + k)
    return out


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Values by their sorted keys."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.concatenate(([0], cuts))].tolist() if len(keys) else [], np.split(values, cuts) if len(keys) else []


def packed(a: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def packed_steps(a: np.ndarray) -> bytes:
    """As packed(), of ascending numbers."""
    return packed(np.diff(a, prepend=0).astype("<u4"))


def unpacked_steps(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u4"), dtype=np.int64)


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts one after another, the text's number for each)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    full = pc.not_equal(words, "")  # white space at either end gives empty words
    return words.filter(full), np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[full.to_numpy(zero_copy_only=False)]


def _common_step(batches):
    """Every word of each batch's training texts, with its count."""
    for batch in common.slices(batches, limit=BLOCK_BYTES):
        trained = pa.array([not held_out(i) for i in batch.column("doc_id").to_pylist()])
        found = pc.value_counts(tokens_of(batch.column("text").filter(trained))[0])
        yield common.arrow_batch(word=found.field("values"), n=found.field("counts"))


def preceding(special: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each token the last number other than 0 that stands before it in its text, or 0."""
    place = np.where(special > 0, np.arange(len(special)), -1)
    last = np.concatenate(([-1], np.maximum.accumulate(place)[:-1])) if len(place) else place
    same = (last >= 0) & (owner[np.maximum(last, 0)] == owner)
    return np.where(same, special[np.maximum(last, 0)], 0)



def keys_of(tokens: np.ndarray, sizes: np.ndarray, special: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each token, its class, its key of word and context). tokens: numbers of words, the end of
    each text included; sizes: tokens a text; special, hashes: of each word."""
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    classes = preceding(special[tokens], owner)
    before = np.full(len(tokens), zlib.crc32(END_OF_TEXT.encode()) % HASHES, np.int64)
    inner = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    before[inner] = hashes[tokens[inner - 1]]
    return owner, classes, tokens.astype(np.int64) * CONTEXTS + classes * HASHES + before


STAGED = "bucket int, block long, words array<string>, pair_words binary, contexts binary, counts binary, names array<long>, held array<boolean>, sizes array<int>, tokens binary, special binary, hashes binary"


def _block_step(buckets: int, contexts: dict[str, int]):
    """Texts in blocks: a row of the block itself (bucket -1), and one for each bucket with its distinct
    words (those of a common word once for each class) and its pairs of word and context."""

    def step(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        for batch in common.slices(batches, limit=BLOCK_BYTES):
            names = batch.column("doc_id").to_pylist()
            held = np.array([held_out(i) for i in names])
            words, owner = tokens_of(batch.column("text"))
            coded = words.dictionary_encode()
            distinct = pa.concat_arrays([coded.dictionary, pa.array([END_OF_TEXT])])
            sizes = np.bincount(owner, minlength=len(names)) + 1
            tokens = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes - 1), len(coded.dictionary))
            listed = distinct.to_pylist()
            crc = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in listed), np.int64, len(listed))
            special = np.fromiter((contexts.get(w, 0) for w in listed), np.int64, len(listed))
            _, classes, _ = keys_of(tokens, sizes, special, crc % HASHES)
            common_word = special > 0
            common_word[-1] = True
            units, unit = np.unique(tokens * (CLASSES + 1) + np.where(common_word[tokens], classes, 0), return_inverse=True)
            word, part = units // (CLASSES + 1), units % (CLASSES + 1)
            bucket = (crc[word] + part * 7919) % buckets
            rank = np.empty(len(listed), np.int64)
            rank[pc.sort_indices(distinct).to_numpy()] = np.arange(len(listed))
            order = np.lexsort((part, rank[word], bucket))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            tokens, special, hashes = place[unit], special[word[order]], (crc % HASHES)[word[order]]
            owner, _, keys = keys_of(tokens, sizes, special, hashes)
            pairs, at = np.unique(keys, return_inverse=True)  # in order of buckets, as words are
            counts = np.bincount(at[~held[owner]], minlength=len(pairs))
            pair_word, context = pairs // CONTEXTS, pairs % CONTEXTS
            block = base + number
            number += 1
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            ends = np.searchsorted(pair_word, cuts)
            some = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
            none = [None] * len(some)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1, *some], pa.int32()),
                    pa.array([block] * (1 + len(some)), pa.int64()),
                    pa.array([None, *(distinct.take(pa.array(word[order[cuts[b] : cuts[b + 1]]])).to_pylist() for b in some)], pa.list_(pa.string())),
                    pa.array([None, *(packed_steps(pair_word[ends[b] : ends[b + 1]] - cuts[b]) for b in some)], pa.binary()),
                    pa.array([None, *(packed(context[ends[b] : ends[b + 1]].astype("<u4")) for b in some)], pa.binary()),
                    pa.array([None, *(packed(counts[ends[b] : ends[b + 1]].astype("<u4")) for b in some)], pa.binary()),
                    pa.array([names, *none], pa.list_(pa.int64())),
                    pa.array([held.tolist(), *none], pa.list_(pa.bool_())),
                    pa.array([sizes, *none], pa.list_(pa.int32())),
                    pa.array([packed(tokens.astype("<u4")), *none], pa.binary()),
                    pa.array([packed(special.astype("u1")), *none], pa.binary()),
                    pa.array([packed(hashes.astype("<u2")), *none], pa.binary()),
                ],
                names=[x.split()[0] for x in STAGED.split(", ")],
            )

    return step


BUCKETS = "bucket int, hot binary, pair_words binary, contexts binary, counts binary, asked array<struct<block:bigint,at:binary>>"


def _bucket_step(hot: dict[str, int]):
    """A row for each bucket: its pairs, as numbers of its words, their counts, and where each block's pairs
    are there. Words have the same order in blocks and buckets, so these places ascend."""

    def step(batches):
        bucket, parts = None, []

        def closed():
            words = pa.concat_arrays([p[1] for p in parts]).dictionary_encode()
            rank = np.empty(len(words.dictionary), np.int64)
            order = pc.sort_indices(words.dictionary)
            rank[order.to_numpy()] = np.arange(len(rank))
            number = rank[words.indices.to_numpy(zero_copy_only=False)]
            begins = np.cumsum([0, *(len(p[1]) for p in parts)])
            keys = np.concatenate([number[a + p[2]] * CONTEXTS + p[3] for a, p in zip(begins[:-1], parts, strict=True)])
            pairs, at = np.unique(keys, return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([p[4] for p in parts]), minlength=len(pairs))
            cuts = np.cumsum([len(p[2]) for p in parts])
            asked = [{"block": p[0], "at": packed_steps(x)} for p, x in zip(parts, np.split(at, cuts[:-1]), strict=True)]
            named = np.array([hot.get(w, 0) for w in words.dictionary.take(order).to_pylist()], "u1")
            row = (bucket, packed(named), packed_steps(pairs // CONTEXTS), packed((pairs % CONTEXTS).astype("<u4")), packed(counts.astype("<i8")), asked)
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.struct([("block", pa.int64()), ("at", pa.binary())])))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BUCKETS.split(", ")])

        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.column("bucket")[i].as_py()
                if b != bucket:
                    if parts:
                        yield closed()
                    bucket, parts = b, []
                get = lambda c, i=i, batch=batch: batch.column(c)[i].as_py()
                parts.append((get("block"), batch.column("words")[i].values, unpacked_steps(get("pair_words")), unpacked(get("contexts"), "<u4"), unpacked(get("counts"), "<u4")))
        if parts:
            yield closed()

    return step


class Bucket:
    """One bucket's pairs and the sampling of their seats. Levels: 0 nothing, 1 the class, 2 the class and the
    word before. A model holds the totals: `tables` and `customers` of each level's restaurants, `discounts`,
    `known` words, `tokens`, and of the hot words their counts, customers and tables at level 0."""

    def __init__(self, row: dict):
        self.number = row["bucket"]
        self.hot = unpacked(row["hot"], "u1").astype(np.int64)
        self.n = len(self.hot)
        self.word = unpacked_steps(row["pair_words"])
        self.context = unpacked(row["contexts"], "<u4").astype(np.int64)
        self.counts = unpacked(row["counts"], "<i8")
        self.asked = row.get("asked")
        classes = self.context // HASHES
        first = np.ones(len(self.word), bool)
        first[1:] = (self.word[1:] != self.word[:-1]) | (classes[1:] != classes[:-1])
        self.middle = np.cumsum(first) - 1  # of each pair its pair of word and class
        self.middle_word, self.middle_class = self.word[first], classes[first]

    def sums(self, at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(at, weights=values, minlength=size)

    @property
    def own_counts(self) -> np.ndarray:
        """Counts of words; of hot ones what this bucket has."""
        return self.sums(self.word, self.counts, self.n)

    def word_counts(self, model: dict) -> np.ndarray:
        return np.where(self.hot > 0, model["hot_counts"][self.hot], self.own_counts)

    def roots(self, model: dict, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probabilities of the words at level 0."""
        d = model["discounts"][0]
        customers = np.where(self.hot > 0, model["hot_customers"][self.hot], customers)
        tables = np.where(self.hot > 0, model["hot_tables"][self.hot], tables)
        return (customers - d * tables + new_root(model)) / (STRENGTH + model["customers"][0])

    def middles(self, model: dict, customers: np.ndarray, tables: np.ndarray, root: np.ndarray) -> np.ndarray:
        d, k = model["discounts"][1], self.middle_class
        return (customers - d * tables + (STRENGTH + d * model["tables"][1][k]) * root[self.middle_word]) / (STRENGTH + model["customers"][1][k])

    def seats(self, model: dict, seed: int) -> tuple:
        """(tables of pairs, customers and tables at level 1, customers and tables at level 0) after SWEEPS."""
        rng = np.random.default_rng((seed, self.number))
        _, d1, d2 = model["discounts"]
        weight2 = STRENGTH + d2 * model["tables"][2][self.context]
        weight1 = STRENGTH + d1 * model["tables"][1][self.middle_class]
        root = (self.word_counts(model) + 1.0) / (model["tokens"] + model["known"] + 1)
        middle = root[self.middle_word]
        for _ in range(SWEEPS):
            tables = seat(self.counts, weight2 * middle[self.middle], d2, rng)
            customers1 = self.sums(self.middle, tables, len(self.middle_word))
            tables1 = seat(customers1, weight1 * root[self.middle_word], d1, rng)
            customers0 = self.sums(self.middle_word, tables1, self.n)
            tables0 = np.where(self.hot > 0, 0, seat(np.where(self.hot > 0, 0, customers0), np.full(self.n, new_root(model)), model["discounts"][0], rng))
            root = self.roots(model, customers0, tables0)
            middle = self.middles(model, customers1, tables1, root)
        return tables, customers1, tables1, customers0, tables0

    def predictive(self, model: dict, seats: tuple) -> np.ndarray:
        """Probability of each pair's word in its context, for the totals of these seats."""
        tables, customers1, tables1, customers0, tables0 = seats
        d = model["discounts"][2]
        middle = self.middles(model, customers1, tables1, self.roots(model, customers0, tables0))
        own = self.counts - d * tables + (STRENGTH + d * model["tables"][2][self.context]) * middle[self.middle]
        return own / (STRENGTH + model["customers"][2][self.context])


def new_root(model: dict) -> float:
    """Weight of a new table for any word at level 0."""
    return (STRENGTH + model["discounts"][0] * model["tables"][0]) / (model["known"] + 1)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield Bucket({c: batch.column(c)[i].as_py() for c in batch.schema.names})


#: What buckets add up: tables (or customers) by context, tables by class, tables at level 0, of hot words
#: customers at level 0 (or counts), and six facts about counts.
TOTALS = CONTEXTS + CLASSES + 1 + 1 + HOT + 6
PARTS = 16


def _totals_step(of_bucket):
    """Sums of of_bucket() over a task's buckets, in parts that can be added apart."""

    def step(batches):
        total = None
        for b in _rows(batches):
            own = of_bucket(b)
            total = own if total is None else total + own
        if total is not None:
            cuts = np.array_split(total.astype("<i8"), PARTS)
            yield common.arrow_batch(part=pa.array(range(PARTS), pa.int32()), n=pa.array([packed(x) for x in cuts], pa.binary()))

    return step


def _add_step(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, n in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), strict=True):
            sums[part] = sums.get(part, 0) + unpacked(n, "<i8")
    if sums:
        yield common.arrow_batch(part=pa.array(list(sums), pa.int32()), n=pa.array([packed(x) for x in sums.values()], pa.binary()))


def _summed(buckets: DataFrame, of_bucket, size: int = TOTALS) -> np.ndarray:
    parts = common.map_arrow(buckets, _totals_step(of_bucket), "part int, n binary")
    rows = common.map_arrow(parts.repartition(PARTS, "part"), _add_step, "part int, n binary").collect()  # PARTS rows
    if not rows:
        return np.zeros(size, np.int64)
    return np.concatenate([unpacked(bytes(r.n), "<i8") for r in sorted(rows, key=lambda r: r.part)])


def _counted(b: Bucket) -> np.ndarray:
    """Customers by context; what is known without sampling, each dish at one table of each restaurant."""
    words, cold = b.own_counts, b.hot == 0
    middle = b.sums(b.middle, b.counts > 0, len(b.middle_word))
    root = b.sums(b.middle_word, middle > 0, b.n)
    hot = lambda x: np.bincount(b.hot, weights=np.where(cold, 0, x), minlength=HOT)
    once_twice = [(x == k).sum() for x in (root[cold], middle, b.counts) for k in (1, 2)]
    return np.concatenate((np.bincount(b.context, weights=b.counts, minlength=CONTEXTS), np.bincount(b.middle_class, weights=middle > 0, minlength=CLASSES + 1), [(words[cold] > 0).sum()], hot(words), once_twice))


def _tables_of(b: Bucket) -> np.ndarray:
    """Tables by context if each pair has one."""
    out = np.zeros(TOTALS)
    out[:CONTEXTS] = np.bincount(b.context, weights=b.counts > 0, minlength=CONTEXTS)
    middle = b.sums(b.middle, b.counts > 0, len(b.middle_word))
    root = b.sums(b.middle_word, middle > 0, b.n)
    out[-HOT - 6 : -6] = np.bincount(b.hot, weights=np.where(b.hot > 0, root, 0), minlength=HOT)
    return out


def _seated(held, seed: int):
    def of_bucket(b: Bucket) -> np.ndarray:
        tables, _, tables1, customers0, tables0 = b.seats(held.value, seed)
        hot = np.bincount(b.hot, weights=np.where(b.hot > 0, customers0, 0), minlength=HOT)
        return np.concatenate((np.bincount(b.context, weights=tables, minlength=CONTEXTS), np.bincount(b.middle_class, weights=tables1, minlength=CLASSES + 1), [tables0.sum()], hot, np.zeros(6)))

    return of_bucket


def _model(base: dict, totals: np.ndarray, seed: int) -> dict:
    """The base with the totals of seats; the hot words' tables at level 0 are drawn here."""
    tables2, tables1 = totals[:CONTEXTS].astype(float), totals[CONTEXTS : CONTEXTS + CLASSES + 1].astype(float)
    hot = totals[-HOT - 6 : -6].astype(float)
    cold = float(totals[CONTEXTS + CLASSES + 1])
    model = base | {"tables": (cold + float((hot > 0).sum()), tables1, tables2), "customers": (float(tables1.sum()), tables2.reshape(-1, HASHES).sum(axis=1), base["customers2"])}
    drawn = seat(hot, np.full(HOT, new_root(model)), base["discounts"][0], np.random.default_rng((seed, 1 << 31)))
    return model | {"hot_customers": hot, "hot_tables": drawn, "tables": (cold + float(drawn.sum()), tables1, tables2)}


def fit(buckets: DataFrame) -> tuple[dict, list[tuple[int, dict, dict]]]:
    """(facts about counts; of each sample its seed, the model that its seats are drawn under, and the model
    of their totals)."""
    context = buckets.sparkSession.sparkContext
    both = _summed(buckets, lambda b: np.concatenate((_counted(b), _tables_of(b))), 2 * TOTALS)
    facts, ones = both[:TOTALS], both[TOTALS:]
    hot_counts = facts[-HOT - 6 : -6].astype(float)
    known = int(facts[CONTEXTS + CLASSES + 1]) + int((hot_counts > 0).sum())
    tokens = int(facts[:CONTEXTS].sum())
    discounts = tuple(float(np.clip(a / max(1, a + 2 * b), 0.1, 0.95)) for a, b in facts[-6:].reshape(3, 2).tolist())
    base = {"known": known, "tokens": tokens, "discounts": discounts, "hot_counts": hot_counts, "customers2": facts[:CONTEXTS].astype(float)}
    first = facts.copy()
    first[:CONTEXTS], first[-HOT - 6 : -6] = ones[:CONTEXTS], ones[-HOT - 6 : -6]
    model, samples = _model(base, first, 0), []
    for k in range(1, ROUNDS + 1):
        after = _model(base, _summed(buckets, _seated(context.broadcast(model), k)), k)
        samples.append((k, model, after))
        model = after
    return base, samples[-SAMPLES:]


ANSWERS = "block long, bucket int, counts binary, p binary"


def _answer_step(held):
    """Words' counts and averaged predictive probabilities, to every block that asked. Probabilities go as
    whole numbers, of steps of 1 / FINE of their negative decimal logarithm."""

    def step(batches):
        samples = held.value
        for b in _rows(batches):
            p = sum(b.predictive(after, b.seats(before, seed)) for seed, before, after in samples) / len(samples)
            steps = np.clip(np.rint(-np.log10(np.maximum(p, 1e-30)) * FINE), 0, 2**24 - 1).astype("<u4")
            words = b.word_counts(samples[0][1])
            unit = b.word * (CLASSES + 1) + np.where(b.hot[b.word] > 0, b.context // HASHES, 0)
            for a in b.asked:
                at = unpacked_steps(a["at"])
                own = unit[at]
                first = at[np.concatenate(([True], own[1:] != own[:-1]))]
                yield common.arrow_batch(block=pa.array([a["block"]], pa.int64()), bucket=pa.array([b.number], pa.int32()), counts=pa.array([packed(words[b.word[first]].astype("<i8"))], pa.binary()), p=pa.array([packed(steps[at])], pa.binary()))

    return step


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_step(tokens: int, known: int):
    """From a block's answers, in order of buckets, and then the block itself: its texts' scores."""
    whole = tokens + PRIOR * (known + 1)

    def step(batches):
        counts, steps = [], []
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, i=i, batch=batch: batch.column(c)[i].as_py()
                if not get("last"):
                    counts.append(unpacked(get("counts"), "<i8"))
                    steps.append(unpacked(get("p"), "<u4"))
                    continue
                c = np.concatenate(counts)
                own = np.concatenate(steps) / -FINE
                base = np.log10((c + PRIOR) / whole)
                sizes = np.array(get("sizes"), np.int64)
                words = unpacked(get("tokens"), "<u4").astype(np.int64)
                doc, _, keys = keys_of(words, sizes, unpacked(get("special"), "u1").astype(np.int64), unpacked(get("hashes"), "<u2").astype(np.int64))
                at = np.unique(keys, return_inverse=True)[1]
                sums = [np.bincount(doc, weights=x, minlength=len(sizes)) for x in (base[words], own[at], c[words] > 0)]
                yield common.arrow_batch(
                    doc_id=pa.array(get("names"), pa.int64()),
                    held_out=pa.array(get("held"), pa.bool_()),
                    n_tokens=pa.array(sizes),
                    n_known=pa.array(sums[2].astype(np.int64)),
                    train_tokens=pa.array(np.full(len(sizes), tokens)),
                    base_score=pa.array(sums[0]),
                    score=pa.array(sums[1]),
                )
                counts, steps = [], []

    return step


def gather(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(blocks of texts, buckets of pairs), as staged tables."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    buckets = 1 + int((narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    top = common.map_arrow(narrow, _common_step, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(CLASSES).collect()
    contexts = {r.word: k + 1 for k, r in enumerate(top)}
    staged = common.staged(common.map_arrow(narrow, _block_step(buckets, contexts), STAGED), "lm-blocks")
    requests = staged.where("bucket >= 0").select("bucket", "block", "words", "pair_words", "contexts", "counts").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "block")
    table = common.staged(common.map_arrow(requests, _bucket_step(contexts | {END_OF_TEXT: CLASSES + 1}), BUCKETS), "lm-buckets")
    return staged.where("bucket < 0").select("block", "names", "held", "sizes", "tokens", "special", "hashes"), table


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (of counts with a
    small prior), score (log10 probability under the model)."""
    blocks, table = gather(docs, id_col=id_col, text_col=text_col)
    base, samples = fit(table.drop("asked"))
    answers = common.map_arrow(table, _answer_step(docs.sparkSession.sparkContext.broadcast(samples)), ANSWERS)
    none = F.lit(None)
    asked = answers.select("block", "bucket", "counts", "p", none.cast("array<long>").alias("names"), none.cast("array<boolean>").alias("held"), none.cast("array<int>").alias("sizes"), *(none.cast("binary").alias(c) for c in ("tokens", "special", "hashes")), F.lit(False).alias("last"))
    own = blocks.select("block", F.lit(-1).alias("bucket"), none.cast("binary").alias("counts"), none.cast("binary").alias("p"), "names", "held", "sizes", "tokens", "special", "hashes", F.lit(True).alias("last"))
    # as many partitions as blocks, else a task's share grows with the input
    both = asked.union(own).repartition(max(1, blocks.count()), "block").sortWithinPartitions("block", "last", "bucket")
    return common.map_arrow(both, _score_step(base["tokens"], base["known"]), SCHEMA)
