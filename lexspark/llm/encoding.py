"""Fast encoding of whole columns with a public tokenizer file; ids are those that the library gives for
each whole text with add_special_tokens=False.

Two kinds of file are known, and probed when one is opened: byte-level ones whose words keep the one space
before them, and ones that drop white space and lower-case. Either splits a text wherever a single space or
line feed stands between other characters, and behind every run of letters. So a slice of texts is cut there,
and of its distinct pieces the letters at the front and the rest are looked up each: a worker remembers the
ids of parts, and asks the library for new ones. Runs of letters pass as one text, a line each, through the
same model without the splitting that they don't need. Texts with white space in longer runs, or with a
string that the file lists as a token of its own (such as an end mark), are given to the library whole, as
are all texts if the file is of neither kind.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts a worker remembers before the older half is forgotten, of CACHE_BYTES each at most.
CACHE_PIECES, CACHE_BYTES = 400_000, 64
#: Parts given to the library at once.
CALL_PIECES = 4_000

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A line feed, letters, and a rest that begins with an ASCII character other than a letter.
_PARTS = rf"^(?P<n>\n?)(?P<h>[{_LETTERS}]*)(?P<t>(?:[\x00-\x40\x5B-\x60\x7B-\x7F](?s:.*))?)$"
_SOLID = r"\x21-\x7E\x{A1}-\x{167F}\x{1690}-\x{1FFF}\x{2070}-\x{2FFF}\x{3001}-\x{10FFFF}"
_RUNS = rf"  |[^{_SOLID}]\n|\n[^{_SOLID}]|[ \n]\z"
_PROBES = ("a b", "It's he'll, don't! 12 3.5a", "Été là\nNew Line.\n\x1dx", "tab\there \tor", "x y z　w", "naïve'S ΑΣ ß12a", "a_b-c 'tis\nÉCOLE")


def gather(values: np.ndarray, lengths: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of values that entries name, one after another; where each begins and the last ends)."""
    begins = np.cumsum(lengths) - lengths
    size = lengths[entries]
    ends = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat((begins[entry_index(entries)] - ends[:-1]).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return values[at], ends


def entry_index(entries: np.ndarray) -> np.ndarray:
    return entries.astype(np.int64, copy=False)


def _lookup(texts: pa.Array) -> tuple[list, np.ndarray]:
    coded = texts.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class ColumnEncoder:
    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = self._ask([" a"]) != self._ask(["a"])
        self.lines = Tokenizer.from_file(path)
        self.lines.normalizer = None
        self.lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache_pieces = cache_pieces
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        mark = self.lines.encode("\n", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else -1
        self.feed = self._ask(["\n"])[0] if self.spaced else b""
        self.known = self.mark >= 0 and self._probe()

    def _probe(self) -> bool:
        self.known = True
        values, ends = self.encode(pa.array(_PROBES))
        return [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)] == self._ask(list(_PROBES))

    def _ask(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), CALL_PIECES):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + CALL_PIECES], add_special_tokens=False):
                out.append(np.array(e.ids, "<u4").tobytes())
        return out

    def _ask_lines(self, words: list[str]) -> list[bytes]:
        """As _ask, of runs of letters with or without a space before them."""
        out: list[bytes] = []
        for i in range(0, len(words), CALL_PIECES):
            own = words[i : i + CALL_PIECES]
            ids = np.array(self.lines.encode_batch_fast(["\n".join(own)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(ids == self.mark) * 4).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True)]
        return out

    def _ids(self, parts: list[str], words: np.ndarray) -> list[bytes]:
        """Ids of distinct parts; words: whether each is a run of letters."""
        found = list(map(self.young.get, parts))
        missing = []
        for k, ids in enumerate(found):
            if ids is None:
                if (ids := self.old.get(parts[k])) is None:
                    missing.append(k)
                else:
                    found[k] = self.young[parts[k]] = ids
        for some, ask in (([k for k in missing if words[k]], self._ask_lines), ([k for k in missing if not words[k]], self._ask)):
            asked = [parts[k] for k in some]
            for k, part, ids in zip(some, asked, ask(asked), strict=True):
                found[k] = ids
                if len(part) <= CACHE_BYTES:
                    self.young[part] = ids
        if len(self.young) > self.cache_pieces // 2:
            self.young, self.old = {}, self.young
        return found

    def _table(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct pieces one after another, numbers of them)."""
        parts = pc.extract_regex(pieces, _PARTS)
        clear = pc.is_valid(parts)
        head, rest = (pc.fill_null(pc.struct_field(parts, c), "") for c in "ht")
        fed = pc.and_(clear, pc.equal(pc.fill_null(pc.struct_field(parts, "n"), ""), "\n"))
        word = pc.and_(clear, pc.greater(pc.binary_length(head), 0))
        front = pc.if_else(word, head if self.spaced else pc.utf8_lower(head), pc.if_else(clear, rest, pieces))
        if self.spaced:
            front = pc.binary_join_element_wise(pc.if_else(pc.starts_with(pieces, "\n"), "", " "), front, "")
        fronts, at_front = _lookup(front)
        words = np.zeros(len(fronts), bool)
        words[at_front[word.to_numpy(zero_copy_only=False)]] = True
        rests, at_rest = _lookup(pc.if_else(word, rest, ""))
        table = [b"", self.feed, *self._ids(fronts, words), *self._ids(rests, np.zeros(len(rests), bool))]
        lengths = np.fromiter(map(len, table), np.int64, len(table)) // 4
        entries = np.stack([fed.to_numpy(zero_copy_only=False).astype(np.int64), at_front + 2, at_rest + 2 + len(fronts)], axis=1).ravel()
        values, ends = gather(np.frombuffer(b"".join(table), "<u4"), lengths, entries)
        return values, np.diff(ends[::3])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids begin and the last ones end)."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        whole = np.full(n, not self.known)
        if self.known:
            for content in self.added:
                whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
            if self.spaced:
                whole |= pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n" if self.spaced else " "), " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts -= starts[0]
        words = lists.flatten()
        coded = words.dictionary_encode()
        values, lengths = self._table(coded.dictionary)
        entry = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        more: list[bytes] = []
        if self.spaced:  # a text's first piece has no space before it
            first, at = _lookup(words.take(pa.array(starts[:-1])))
            more = self._ask(first)
            entry[starts[:-1]] = len(lengths) + at
        odd = np.flatnonzero(whole)
        entry[starts[odd]] = len(lengths) + len(more) + np.arange(len(odd))
        for i in range(0, len(odd), 64):
            more += self._ask(texts.take(pa.array(odd[i : i + 64])).to_pylist())
        values = np.concatenate((values, np.frombuffer(b"".join(more), "<u4")))
        lengths = np.concatenate((lengths, np.fromiter(map(len, more), np.int64, len(more)) // 4))
        ids, ends = gather(values, lengths, entry)
        return ids, ends[starts]


_encoders: dict[str, ColumnEncoder] = {}


def encoder(path: str) -> ColumnEncoder:
    """This worker's encoder for the file."""
    if path not in _encoders:
        _encoders[path] = ColumnEncoder(path)
    return _encoders[path]
