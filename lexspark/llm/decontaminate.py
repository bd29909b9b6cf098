"""Benchmark decontamination with an Aho-Corasick automaton.

Test items and documents are normalised alike: A-Z in lower case, words of digits, letters and every
character beyond ASCII, a single space between words. A window is `size` consecutive words of an item; an
item of fewer words, but at least one, is one window. One automaton over all windows scans each text
once. Its symbols are words, by their number among the items' words; places of hits are mapped back to offsets
of the original text.

A document word is hit if it lies inside an occurrence of a window. Null texts, and texts and items
without words, hit nothing. Repeated documents and items each count on their own; empty tables of either
kind give no hits. Only the named columns of the inputs are read.

The automaton grows with the test items, not with the documents. Its size is bounded all the same: items
of more than PASS_BYTES are split over several passes, each with an automaton of its own.
"""

from __future__ import annotations

import bisect
import re
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import common

PASS_BYTES = 2 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normalised(text: str | None) -> bytes:
    """Words in lower case, everything else as spaces; on UTF-8 bytes, of which all beyond ASCII belong to words."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)


def words_of(text: str | None) -> list[bytes]:
    return normalised(text).split()


def windows_of(items: Iterable[tuple], size: int) -> dict[tuple, list]:
    """Each window, as a tuple of words, with the items that hold it."""
    found: dict[tuple, dict] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            found.setdefault(tuple(words[i : i + size]), {})[item] = None
    return {w: list(own) for w, own in found.items()}


class Windows:
    """The automaton, and the numbers of its words; every other word is 0."""

    def __init__(self, windows: dict[tuple, list]):
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, own in windows.items():
            self.automaton.add_word(tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window), (len(window), own))
        if windows:
            self.automaton.make_automaton()

        self.listed = pa.array([w.decode() for w in self.numbers], pa.string())
        self.shortest = min(map(len, windows), default=1)

    def known(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int, list[int]]]]:
        """(words of each normalised text; text, place and numbers of all runs of words that the automaton
        knows which could hold a window): whatever lies in a window does."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        words = lists.flatten()
        full = pc.not_equal(words, "")  # spaces at either end give empty ones
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[full.to_numpy(zero_copy_only=False)]
        sizes = np.bincount(owner, minlength=len(texts))
        number = pc.fill_null(pc.index_in(words.filter(full), value_set=self.listed), -1).to_numpy(zero_copy_only=False) + 1
        some = np.flatnonzero(number)
        if not len(some):
            return sizes, []
        cut = np.flatnonzero((np.diff(some) > 1) | (np.diff(owner[some]) != 0)) + 1
        first, last = some[np.concatenate(([0], cut))], some[np.concatenate((cut, [len(some)])) - 1] + 1
        begins = np.cumsum(sizes) - sizes
        long = last - first >= self.shortest
        return sizes, [(int(owner[a]), int(a - begins[owner[a]]), number[a:b].tolist()) for a, b in zip(first[long], last[long], strict=True)]

    def hits(self, numbers: list[int], at: int) -> Iterator[tuple[int, int, list]]:
        """(first word, behind the last, items) of the windows in a run that begins at word `at`."""
        for last, (n, own) in self.automaton.iter(tuple(numbers)):
            yield at + last + 1 - n, at + last + 1, own


HITS = "struct<n_words:bigint,n_hit:bigint,items:array<bigint>,spans:array<struct<start:bigint,stop:bigint>>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def scan(docs: DataFrame, items: DataFrame, size: int = 10, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: list[str] | None = None, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents' columns (or those of `carry`) and `hits`: struct of n_words, n_hit, items (ascending
    identifiers, null ones left out, of items with a hit) and spans (original code-point offsets of the
    hit runs). A column `hits` of the input gives way to the new one."""
    spark = docs.sparkSession
    items = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where(F.length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-total // pass_bytes) or 1
    carry = [c for c in (docs.columns if carry is None else carry) if c != "hits"]
    out = docs.select(*dict.fromkeys([*carry, text_col])).withColumn("hits", F.lit(None).cast(HITS))
    for k in range(passes):
        last = k + 1 == passes
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        windows = windows_of(((r.item, r.text) for r in part.toLocalIterator()), size)
        kept = [*carry, "hits"] if last else out.columns
        out = common.map_arrow(out, _step(spark.sparkContext.broadcast(windows), text_col, kept), out.select(*kept).schema)
        if not last:
            out = common.staged(out, "decontaminate")
    return out


_automata: dict[str, Windows] = {}


def _step(held, text_col: str, kept: list[str]):
    key = uuid.uuid4().hex

    def step(batches):
        if key not in _automata:  # a worker holds one
            _automata.clear()
            _automata[key] = Windows(held.value)
        windows = _automata[key]
        for batch in common.slices(batches, text_col):
            texts, before = batch.column(text_col).to_pylist(), batch.column("hits").to_pylist()
            sizes, known = windows.known([normalised(t) for t in texts])
            found: dict[int, list] = {}
            for k, at, numbers in known:
                found.setdefault(k, []).extend(windows.hits(numbers, at))
            rows = []
            for k, (text, had) in enumerate(zip(texts, before, strict=True)):
                own = found.get(k, [])
                if not own and not (had and had["n_hit"]):
                    rows.append((0, [], []))
                    continue
                places = [m.span() for m in WORD.finditer(text)]
                runs, items = [(a, b) for a, b, _ in own], {i for _, _, named in own for i in named}
                if had:  # join with what an earlier pass found
                    starts = [a for a, _ in places]
                    runs += [(bisect.bisect_left(starts, x["start"]), bisect.bisect_left(starts, x["stop"])) for x in had["spans"]]
                    items |= set(had["items"])
                runs = merged(runs)
                rows.append((sum(b - a for a, b in runs), sorted(i for i in items if i is not None), [{"start": places[a][0], "stop": places[b - 1][1]} for a, b in runs]))
            columns = list(zip(*rows, strict=True))
            hits = pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], _SPANS)], ["n_words", "n_hit", "items", "spans"])
            yield pa.RecordBatch.from_arrays([hits if c == "hits" else batch.column(c) for c in kept], names=kept)

    return step


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
