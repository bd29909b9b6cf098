"""Quality classifier from weak labels.

Two questions are asked of each document: is it of low quality, and is it toxic? For each, overlapping
heuristic labellers vote yes, no, or abstain. Expectation-maximisation over the counts of vote patterns,
which cover all documents, estimates how often each labeller is right for either answer and how common yes
is. The posterior of its pattern is a document's label; a hashed linear scorer is trained on these labels
and then scores every document. A document is kept if neither probability reaches CUT.

Some labellers look words up in lists that are learnt from labelled rows: those of the LABELLED rows of
least hash, a documented bound. Their labels also vote themselves, on those rows. The scorer is trained on
TRAINED documents of either answer at most. Counts of vote patterns and scores cover all rows.

A null or empty text gets no vote but abstentions and the scorer's bias, and is kept unless that is high.
Labels of null identifier or null value are left out; of several labels of one document the highest
counts. Without labels the learnt lists are empty. Repeated documents are scored each on its own; an empty
table gives an empty result. A column `verdict` of the input gives way to the new one.

Texts pass in slices. A slice is split once into numbers of its distinct tokens, all that is asked of a token
is asked once for each distinct one, by column operations, and sums by document are counts over those
numbers; nothing is remembered from slice to slice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm import common

LABELLED, TRAINED = 8000, 1500
BITS = 18
#: L1 penalty of the scorers, in documents: a feature needs the errors of more than so many to get a weight.
PENALTY = 4.0
#: What the mean of shapes counts, beside each statistic.
SHAPES = 8.0
CUT = 0.5
ABSTAIN, NO, YES = 0, 1, 2
#: Insults of everyday English that need no labels.
INSULTS = pa.array("idiot idiots moron morons stupid dumb scum loser losers pathetic worthless disgusting trash clown filth imbecile".split())
_EDGE = ".,!?;:\"'()[]{}"
_SYMBOLS = r"[$%&*#~^=<>@!]"
_RUN = r"[^\p{L}\p{N}_\s]{2}"
_BARS = pa.array(["|", "-", "*"])
#: Shares of a text that speak of a defect, and below which there is no trace of it; see Tokens.statistics.
MUCH, FEW = np.array((0.08, 0.3, 0.1, 0.3, 0.2)), np.array((0.03, 0.15, 0.02, 0.08, 0.05))
STEPS = (0.01, 0.03, 0.06, 0.1, 0.2, 0.4)
#: Lengths of the stems of a word.
STEMS = (4, 5)


def shapes_of(tokens: pa.Array) -> pa.Array:
    """Tokens' kinds of character, runs put together: `Ab,` gives `Aa,`."""
    for pattern, kind in ((r"\p{Nd}+", "0"), (r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", "a")):
        tokens = pc.replace_substring_regex(tokens, pattern, kind)
    return pc.utf8_slice_codeunits(tokens, 0, 8)


def words_of(tokens: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(tokens), _EDGE)


def stems_of(words: pa.Array, n: int) -> pa.Array:
    """The first n letters of words that have so many, else null."""
    return pc.if_else(pc.greater_equal(pc.utf8_length(words), n), pc.utf8_slice_codeunits(words, 0, n), None)


def flags(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def coded(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct values, the number of each row's)."""
    c = column.dictionary_encode()
    return c.dictionary, c.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Tokens:
    """Texts as numbers of distinct tokens."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        lists = pc.utf8_split_whitespace(texts)
        words = lists.flatten()
        full = pc.not_equal(words, "")  # white space at either end gives empty ones
        self.docs = len(texts)
        self.doc = np.repeat(np.arange(self.docs), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[flags(full)]
        self.tokens, self.code = coded(words.filter(full))
        self.chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        self.pair_doc, self.pair_token = self.pairs(self.doc, self.code, len(self.tokens))
        self.n = self.count(self.doc)
        self.distinct = self.count(self.pair_doc)

    @staticmethod
    def pairs(doc: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        both = np.unique(doc * max(1, size) + code)
        return both // max(1, size), both % max(1, size)

    def count(self, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weights, minlength=self.docs)

    def holding(self, marked: np.ndarray) -> np.ndarray:
        """By document the number of distinct tokens that are marked."""
        return self.count(self.pair_doc[marked[self.pair_token]])

    def statistics(self) -> np.ndarray:
        """By document the shares of symbols among characters, of upper-case tokens, of bars and bullets, of
        tokens with runs of marks, of tokens that repeat the one before."""
        upper = flags(pc.and_(pc.utf8_is_upper(self.tokens), pc.greater(pc.utf8_length(self.tokens), 2)))
        odd = flags(pc.match_substring_regex(self.tokens, _RUN))
        bars = flags(pc.is_in(self.tokens, value_set=_BARS))
        symbols = flags(pc.count_substring_regex(self.tokens, _SYMBOLS))
        again = (self.code[1:] == self.code[:-1]) & (self.doc[1:] == self.doc[:-1])
        n, distinct = np.maximum(1, self.n), np.maximum(1, self.distinct)
        sums = (self.count(self.doc, symbols[self.code]) / np.maximum(1, self.chars - self.n + 1), self.holding(upper) / distinct, self.count(self.doc[bars[self.code]]) / n, self.holding(odd) / distinct, self.count(self.doc[1:][again]) / n)
        return np.stack(sums, axis=1)


class Labellers:
    """Votes on texts; lists: the four learnt ones."""

    def __init__(self, lists: dict[str, list], gold: dict[int, tuple[int, int]]):
        self.lists, self.gold = lists, gold

    def votes(self, doc_ids: list, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(patterns on low quality, patterns on toxic), each in base three."""
        t = Tokens(texts)
        stats, some = t.statistics(), t.n > 0
        known = {k: pa.array(v, pa.string()) for k, v in self.lists.items()}
        words = words_of(t.tokens)
        share = t.holding(flags(pc.is_in(shapes_of(t.tokens), value_set=known["shapes"]))) / np.maximum(1, t.distinct)
        low = [np.where(stats[:, i] >= MUCH[i], YES, ABSTAIN) for i in range(len(MUCH))]
        # a text without a trace of these defects is evidence the other way; one defect's absence isn't
        low.append(np.where(some & (stats < FEW).all(axis=1), NO, ABSTAIN))
        low.append(np.where(share > 0.2, YES, np.where(some & (share < 0.02) & (stats.max(axis=1, initial=0) < 0.1), NO, ABSTAIN)))
        stem = np.zeros(len(words), bool)
        for n in STEMS:
            stem |= flags(pc.is_in(pc.binary_join_element_wise(f"{n}", stems_of(words, n), ":"), value_set=known["stems"]))
        toxic = [np.where(some, np.where(t.holding(x) > 0, YES, NO), ABSTAIN) for x in (flags(pc.is_in(words, value_set=INSULTS)), flags(pc.is_in(words, value_set=known["words"])), stem)]
        gold = [self.gold.get(i) for i in doc_ids]
        for k, votes in enumerate((low, toxic)):
            votes.append(np.array([ABSTAIN if g is None else YES if g[k] else NO for g in gold], np.int64))
        return tuple(sum((v.astype(np.int64) * 3**i for i, v in enumerate(votes)), np.zeros(t.docs, np.int64)) for votes in (low, toxic))


LOW_VOTES, TOXIC_VOTES = 8, 4


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of yes for each pattern, [labellers, answer, vote] probabilities). An abstention tells
    nothing: only votes are modelled, no and yes, given the answer."""
    votes = np.stack([patterns // 3**i % 3 for i in range(labellers)], axis=1)
    chance = np.tile(np.array([[1.0, 0.9, 0.1], [1.0, 0.1, 0.9]]), (labellers, 1, 1))
    prior = 0.15
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        logs = np.stack([np.log(chance[np.arange(labellers), y, votes]).sum(axis=1) for y in (0, 1)])
        logs += np.log([[1 - prior], [prior]])
        was, post = post, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        for y, w in ((0, counts * (1 - post)), (1, counts * post)):
            for v in (NO, YES):
                chance[:, y, v] = ((votes == v) * w[:, None]).sum(axis=0) + (9 if (v == YES) == bool(y) else 1)
        chance[:, :, 1:] /= chance[:, :, 1:].sum(axis=2, keepdims=True)
        prior = float(np.clip((counts * post).sum() / counts.sum(), 1e-4, 0.5))
        if np.abs(post - was).max() < 1e-6:
            break
    return post, chance


def hashed(column: pa.Array, kind: str) -> np.ndarray:
    """Places of features in the scorers' weights."""
    values = column.to_numpy(zero_copy_only=False).astype(object)
    return (pd.util.hash_array(values, hash_key=kind.ljust(16, "."), categorize=False) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def step_places() -> np.ndarray:
    """[statistic, step] places of the statistics' steps."""
    names = [f"{i}:{k}" for i in range(len(MUCH)) for k in range(len(STEPS) + 1)]
    return hashed(pa.array(names), "steps").reshape(len(MUCH), -1)


def steps_of(stats: np.ndarray) -> np.ndarray:
    return np.searchsorted(STEPS, stats, side="right")


def word_places(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of words, places): each word's own feature and those of its stems."""
    number, places = [np.arange(len(words))], [hashed(words, "word")]
    for n in STEMS:
        stems = stems_of(words, n)
        long = np.flatnonzero(flags(stems.is_valid()))
        number.append(long)
        places.append(hashed(stems.drop_null(), f"stem {n}"))
    return np.concatenate(number), np.concatenate(places)


def features(texts: pa.Array) -> tuple[list, list]:
    """For each text (places of the statistics' steps, then of the shapes of the distinct tokens; places of
    the distinct words and their stems)."""
    t = Tokens(texts)
    steps = step_places()[np.arange(len(MUCH)), steps_of(t.statistics())]
    shape = hashed(shapes_of(t.tokens), "shape")
    cuts = np.cumsum(t.distinct)[:-1]
    low = [np.concatenate(x) for x in zip(steps, np.split(shape[t.pair_token], cuts), strict=True)]
    words, word = coded(words_of(t.tokens))
    doc, word = t.pairs(t.pair_doc, word[t.pair_token], len(words))
    number, places = word_places(words)
    order = np.argsort(number, kind="stable")
    begins = np.searchsorted(number[order], np.arange(len(words) + 1))
    of_word = np.split(places[order], begins[1:-1]) if len(words) else []
    ends = np.searchsorted(doc, np.arange(t.docs + 1))
    none = np.zeros(0, np.int64)
    return low, [np.concatenate([none, *(of_word[w] for w in word[a:b])]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def train(rows: pa.Table | None, mean: bool, rounds: int = 80) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic scorer over feature sums, or means, by proximal gradient steps
    scaled by feature (Adagrad) with an L1 penalty; features of fewer than eight documents stay out."""
    size = 1 << BITS
    weights, bias = np.zeros(size, np.float64), 0.0
    if rows is None or not rows.num_rows:
        return weights.astype(np.float32), -4.0
    lengths = pc.list_value_length(rows["at"]).to_numpy().astype(np.int64)
    at = pc.list_flatten(rows["at"]).to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    y = rows["post"].to_numpy()
    seen = np.bincount(np.unique(doc * size + at) % size, minlength=size)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = seen[at] >= 8
    at, doc, place = at[keep], doc[keep], place[keep]
    # of a document's shapes the mean counts; its statistics, which come first, and words count each
    value = np.where(place < len(MUCH), 1.0, SHAPES / np.maximum(1, lengths[doc] - len(MUCH))) if mean else np.ones(len(at))
    used, at = np.unique(at, return_inverse=True)
    small = np.zeros(len(used))
    squares, bias_squares = np.full(len(used), 1e-6), 1e-6
    for _ in range(rounds):
        margin = np.bincount(doc, small[at] * value, minlength=len(y)) + bias
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        slope = np.bincount(at, error[doc] * value, minlength=len(used))
        squares += slope**2
        step = 0.5 / np.sqrt(squares)
        small -= step * slope
        small = np.sign(small) * np.maximum(np.abs(small) - step * PENALTY, 0)
        total = error.sum()
        bias_squares += total**2
        bias -= 0.5 * total / np.sqrt(bias_squares)
    weights[used] = small
    return weights.astype(np.float32), float(bias)


class Scorer:
    def __init__(self, low: tuple[np.ndarray, float], toxic: tuple[np.ndarray, float]):
        self.low, self.toxic = low, toxic

    def score(self, texts: pa.Array) -> np.ndarray:
        """[text, (low quality, toxic)] probabilities."""
        t = Tokens(texts)
        shapes, shape = coded(shapes_of(t.tokens))
        shape_weight = self.low[0][hashed(shapes, "shape")][shape]
        low = t.count(t.pair_doc, shape_weight[t.pair_token]) * SHAPES / np.maximum(1, t.distinct)
        low += self.low[0][step_places()[np.arange(len(MUCH)), steps_of(t.statistics())]].sum(axis=1) + self.low[1]
        words, word = coded(words_of(t.tokens))
        number, places = word_places(words)
        word_weight = np.bincount(number, self.toxic[0][places], minlength=len(words))
        heavy = np.flatnonzero(word_weight)  # most words weigh nothing
        rank = np.full(len(words), -1)
        rank[heavy] = np.arange(len(heavy))
        of_pair = rank[word][t.pair_token]
        doc, at = t.pairs(t.pair_doc[of_pair >= 0], of_pair[of_pair >= 0], len(heavy))
        toxic = t.count(doc, word_weight[heavy[at]]) + self.toxic[1]
        return 1 / (1 + np.exp(-np.clip(np.stack((low, toxic), axis=1), -30, 30)))


def _learn_lists(labelled: DataFrame) -> dict[str, list]:
    """Words, stems and shapes that almost only documents of the one kind hold."""

    def step(batches):
        for batch in common.slices(batches):
            t = Tokens(batch.column("text"))
            words = words_of(t.tokens)
            stems = [pc.binary_join_element_wise(f"{n}", stems_of(words, n), ":") for n in STEMS]
            for kind, items, answer in (("shapes", shapes_of(t.tokens), "low"), ("words", words, "toxic"), *(("stems", s, "toxic") for s in stems)):
                yes = batch.column(answer).to_numpy(zero_copy_only=False) > 0
                valid = flags(items.is_valid())
                found, number = coded(items.drop_null())
                at = np.full(len(items), -1)
                at[valid] = number
                at = at[t.pair_token]
                doc, item = t.pairs(t.pair_doc[at >= 0], at[at >= 0], len(found))
                counts = [np.bincount(item[yes[doc] == side], minlength=len(found)) for side in (False, True)]
                yield common.arrow_batch(kind=pa.array([kind] * len(found), pa.string()), item=found, no=pa.array(counts[0], pa.int64()), yes=pa.array(counts[1], pa.int64()))

    found = common.map_arrow(labelled, step, "kind string, item string, no long, yes long").groupBy("kind", "item").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    rows = found.where((F.col("yes") >= F.when(F.col("kind") == "stems", 8).otherwise(6)) & (F.col("yes") >= 30 * F.col("no")) & (F.length("item") > 0)).collect()  # bounded by LABELLED
    return {kind: sorted(r["item"] for r in rows if r.kind == kind) for kind in ("shapes", "words", "stems")}


SCHEMA = "low_quality double, toxic double, keep boolean"


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[Scorer, dict]:
    """(scorer, what was estimated: priors and labellers' accuracies)."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).cast("int").alias("low"), F.col("toxic").cast("int").alias("toxic")).dropna()
    sample = given.groupBy("doc_id").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).collect()
    spark = docs.sparkSession
    gold = {r.doc_id: (r.low, r.toxic) for r in sample}
    lists: dict[str, list] = {k: [] for k in ("shapes", "words", "stems")}
    if sample:
        chosen = spark.createDataFrame([(i, *v) for i, v in gold.items()], "doc_id long, low int, toxic int")
        lists = _learn_lists(narrow.join(F.broadcast(chosen), "doc_id"))  # LABELLED rows at most
    labellers = spark.sparkContext.broadcast(Labellers(lists, gold))

    def vote(batches):
        own = labellers.value
        for batch in common.slices(batches):
            low, toxic = own.votes(batch.column("doc_id").to_pylist(), batch.column("text"))
            yield common.arrow_batch(doc_id=batch.column("doc_id"), low=pa.array(low), toxic=pa.array(toxic))

    votes = common.cut(common.map_arrow(narrow, vote, "doc_id long, low long, toxic long"))
    told, chosen = {}, []
    for which, (name, n) in enumerate((("low", LOW_VOTES), ("toxic", TOXIC_VOTES))):
        counted = votes.groupBy(name).count().collect()  # 3^n patterns at most
        if not counted:
            continue
        patterns, counts = np.array([r[name] for r in counted]), np.array([r["count"] for r in counted], float)
        post, chance = expectation_maximisation(patterns, counts, n)
        told[name] = {"prior": float((post * counts).sum() / counts.sum()), "votes": chance.tolist()}
        posterior = spark.createDataFrame(list(zip(patterns.tolist(), post.tolist(), strict=True)), f"{name} long, post double")
        known = votes.join(F.broadcast(posterior), name).where(F.col("doc_id").isNotNull()).select("doc_id", "post")
        picked = None
        for side in (F.col("post") >= 0.5, F.col("post") < 0.5):
            part = known.where(side).orderBy(F.xxhash64("doc_id", F.lit(which)), "doc_id").limit(TRAINED)
            picked = part if picked is None else picked.union(part)
        chosen += [(r.doc_id, which, r.post) for r in picked.groupBy("doc_id").agg(F.max("post").alias("post")).collect()]
    if not chosen:
        return Scorer(train(None, True), train(None, False)), told

    def featured(batches):
        for batch in common.slices(batches):
            both = features(batch.column("text"))
            which = batch.column("which").to_pylist()
            yield common.arrow_batch(which=batch.column("which"), at=pa.array([both[w][k] for k, w in enumerate(which)], pa.list_(pa.int32())), post=batch.column("post"))

    train_on = narrow.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, which int, post double")), "doc_id")
    # a limit, as identifiers may repeat; the rows of least content hash, so that the choice doesn't depend on the layout
    least = Window.partitionBy("which").orderBy(F.xxhash64("text"), "doc_id")
    train_on = train_on.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= 2 * TRAINED).select("text", "which", "post")
    rows = common.map_arrow(train_on, featured, "which int, at array<int>, post double").toArrow()
    return Scorer(*(train(rows.filter(pc.equal(rows["which"], w)), w == 0) for w in (0, 1))), told


def score(docs: DataFrame, scorer: Scorer, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The documents' columns (or those of `carry`) and `verdict`: struct of low_quality, toxic, keep."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)
    carry = [c for c in (docs.columns if carry is None else carry) if c != "verdict"]

    def step(batches):
        own = held.value
        for batch in common.slices(batches, text_col):
            found = own.score(batch.column(text_col).cast(pa.string()))
            verdict = pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array((found < CUT).all(axis=1))], ["low_quality", "toxic", "keep"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), verdict], names=[*carry, "verdict"])

    narrow = docs.select(*dict.fromkeys([*carry, text_col]))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.select(*carry).schema.fields) + "verdict struct<low_quality:double,toxic:double,keep:boolean>"
    return common.map_arrow(narrow, step, schema)


def classify(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    scorer, _ = fit(docs, labels)
    return score(docs, scorer, **kw)
