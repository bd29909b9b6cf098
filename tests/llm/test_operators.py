"""The operators against brute force, on a small table with every awkward row."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexspark.llm import chat, decontaminate, language_model, neighbours, packing, pii, quality, simhash, sstable, substrings

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    said = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = said(60)
    rows = [(i, said(rng.randint(1, 90))) for i in range(60)]
    rows += [(100 + i, f"{said(10)} {passage} {said(12)}") for i in range(6)]
    base = said(200).split()
    for i in range(12):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(200)] = "edited"
        rows.append((200 + i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "  \n\t "), (303, "One"), (303, "One"), (None, "no name here"), (304, said(3000)), (305, "Ab, cd! " * 50), (306, "Ab, cd! " * 50)]
    rows += [(307, "x@@y a@b.co Visa 4111 1111 1111 1111, 10.0.0.255 1.2.3.999 +1 (415) 555-0199"), (308, passage.upper())]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "clash", 1, None) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, k1 int, hits string").repartition(5)


def empty(spark, schema="doc_id long, text string"):
    return spark.createDataFrame([], schema)


def hashed(text, size=3):
    words = re.findall("[^\x20\x09-\x0d]+", text.translate(LOWER))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    return [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]


def test_simhash_against_all_pairs(spark, docs):
    rows = [(i, t or "") for i, t in corpus()]
    fps = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if (hs := hashed(t)) else 0 for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    expected = sorted((str(i), f"{fps[k]:016x}", least.get(root(k))) for k, (i, _) in enumerate(rows))
    for heavy in (simhash.HEAVY, 1):  # 1: all go by masked bits
        got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.group(docs, heavy=heavy).collect())
        assert got == expected
    assert simhash.group(empty(spark)).count() == 0


def test_links_are_complete(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for _ in range(6):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))))
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    expected = {tuple(sorted((signed[a], signed[b]))) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2}
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    for heavy in (simhash.HEAVY, 1):
        assert {(r.a, r.b) for r in simhash.links(table, heavy).collect()} == expected


def test_near_copies_keep_one(spark, docs):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert len([i for i in ids if i is not None and 200 <= i < 212]) == 1 and ids[200] == 1
    assert ids[303] == 1 and ids[305] == 1 and ids[306] == 0 and ids[300] == 1 and ids[301] == 0
    assert all(ids[100 + i] == 1 for i in range(6)) and all(ids[i] == 1 for i in range(60))
    assert simhash.deduplicate(empty(spark)).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e f g", "x", {"k": 1}), (1, "a b c d e f g", "x", {"k": 1}), (1, "a b c d e f g", "y", None), (2, "other words in this text", "x", None), (2, "other words in this text", "x", None)], "doc_id long, text string, row1 string, m map<string,int>")
    left = simhash.deduplicate(odd)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [1, 2]


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(8)
    said = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    centre = said(204)
    rows = [(5000, " ".join(centre))]
    for i in range(1000):  # a star: 0.82 like the centre, 0.68 like each other
        words = list(centre)
        for k in range(4):
            words[51 * k + rng.randrange(5, 46)] = f"n{i}-{k}"
        rows.append((i, " ".join(words)))
    passage = said(40)
    for i in range(150):  # short texts, and texts that share a passage, with up to three edits
        words = said(rng.randint(5, 30)) + passage[: rng.choice([0, 0, 20, 40])]
        for j in range(rng.randint(1, 6)):
            edited = list(words)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(10**6)}"
            rows.append((10000 + 10 * i + j, " ".join(edited)))
    sets = [frozenset(hashed(t, 5)) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_shards_round_trip(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/shards"
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards = sstable.write_shards(docs, folder, path, 2)
    got = sstable.read_shards(spark, folder, shards).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(path)
    coded = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in corpus()]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in coded)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    names = [r.doc_id for r in got]
    assert names[0] is None and names[1:] == sorted(names[1:])
    from pyarrow import fs

    readers = [sstable.ShardReader(fs.LocalFileSystem(), s.path) for s in shards]
    for wanted in (5, 303, None, 999):
        found = [x.tolist() for r in readers for x in r.lookup(wanted)]
        assert sorted(found) == sorted(x for i, x in coded if i == wanted)
    none = sstable.write_shards(empty(spark), folder, path, 2)
    assert none == [] and sstable.read_shards(spark, folder, none).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_ids_of_the_library(name):
    import pyarrow as pa

    from lexspark.llm.encoding import ColumnEncoder

    coder = ColumnEncoder(public_tokenizers.path(name), 2000)
    assert coder.known
    library = Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(1)
    special = [t.content for t in library.get_added_tokens_decoder().values()]
    parts = ["a", "b", " ", "  ", "\n", "\t", "\r", "é", "ß", "Σ", "'s", "'ll", "'", "12", ".", "!", *special, "<|endof", "A", "Z", "É", "\u00a0", "\u3000", "\u0301", "中", "İ", "K", "\x1c", "\x85", "_", "-", "ing", "The", "😀", "\u2009", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    texts += [t for x in special for t in (x, f"{x} a", f"a {x}", f"a{x}b", f"a {x} b", f"a\n{x}\nb", x.upper(), x[:-1])]
    texts += [None, "", "word " * 50_000, "x" * 100_000]
    values, at = coder.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert values[at[k] : at[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_packing_covers_every_token_once(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path, 1, 256).collect()
    tokenizer = Tokenizer.from_file(path)
    coded = collections.defaultdict(list)
    for i, t in corpus():
        coded[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, texts in coded.items():
        assert sum(p.length for p in pieces[i]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for p in sorted(pieces[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(texts[0])
                assert p.ids_crc32 == zlib.crc32(np.array(texts[0][at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(texts[0])
    windows = collections.defaultdict(list)
    for r in got:
        windows[r.sequence_id].append(r)
    padding = total = 0
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
        n = sum(r.length for r in own)
        assert n <= 256
        padding += 0 if n & (n - 1) == 0 else 256 - n
        total += n
    assert padding < 0.05 * total
    assert packing.pack(empty(spark), path, 1).count() == 0


def test_cuts_are_cheapest():
    rng = random.Random(3)
    for _ in range(200):
        places, size = [0], 12
        while len(places) < 12:
            places.append(places[-1] + rng.randint(1, 6))
        costs = [0.0] + [float(rng.randint(0, 5)) for _ in places[1:]]
        best = [0.0] + [math.inf] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                if places[j] - places[i] <= size:
                    best[j] = min(best[j], best[i] + size - places[j] + places[i] + costs[j])
        cuts = packing.best_cuts(np.array(places), np.array(costs), size, False)
        at = [0, *cuts]
        assert sum(size - places[b] + places[a] + costs[b] for a, b in zip(at, cuts, strict=False)) == best[-1]


def test_decontamination_against_search(spark, docs):
    rows = corpus()
    texts = dict((i, t) for i, t in rows if t)
    items = [(1, " ".join(texts[100].split()[10:40])), (2, "Ab CD"), (3, None), (4, "..."), (5, "never seen anywhere in these texts"), (5, texts[304][:200]), (None, texts[304][:200])]
    table = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    expected = []
    for i, t in rows:
        own, hit, found = words(t), set(), set()
        for item, x in items:
            w = words(x)
            for k in range(max(1, len(w) - 9) if w else 0):
                window = w[k : k + 10]
                for at in range(len(own) - len(window) + 1):
                    if own[at : at + len(window)] == window:
                        hit |= set(range(at, at + len(window)))
                        found.add(item)
        expected.append((str(i), len(own), len(hit), sorted(x for x in found if x is not None)))
    for limit in (decontaminate.PASS_BYTES, 100):  # 100: several passes
        got = decontaminate.scan(docs, table, carry=["doc_id", "text", "fp"], pass_bytes=limit).collect()
        assert sorted((str(r.doc_id), r.hits.n_words, r.hits.n_hit, list(r.hits["items"])) for r in got) == sorted(expected)
        for r in got:  # offsets are those of the original text
            assert sum(len(words(r.text[s.start : s.stop])) for s in r.hits.spans) == r.hits.n_hit
    assert decontaminate.scan(empty(spark), table).count() == 0
    assert decontaminate.scan(docs, empty(spark, "item_id long, text string")).where("hits.n_hit > 0").count() == 0


def test_substrings_against_counts(spark, docs):
    size = 60
    rows = [(i, (t or "").encode()) for i, t in corpus()]
    seen = collections.Counter(b[k : k + size] for _, b in rows for k in range(len(b) - size + 1))
    expected = []
    for i, b in rows:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        expected.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    for heavy in (substrings.HEAVY, 1):  # 1: all groups go by counts of hashes
        got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove(docs, size, heavy=heavy).collect()]
        assert sorted(got) == sorted(expected)
    assert substrings.remove(empty(spark)).count() == 0


def test_substrings_around_one_anchor(spark):
    """Very many different pieces around one anchor, in pairs of like ones; crowded slices and notes."""
    rng = random.Random(4)
    size = 60
    said = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line = said(substrings.K + 6)
    rows = []
    for _ in range(150):
        before, after = said(40), said(40)
        rows += [said(90) + before + line + after + said(90), said(90) + before + line + said(130), said(130) + line + after + said(90)]
    rows += [said(200) + line + said(10), line + said(300), rows[0], rows[0][:150]]
    rows = list(enumerate(rows))
    seen = collections.Counter(t[k : k + size] for _, t in rows for k in range(len(t) - size + 1))
    expected = []
    for i, t in rows:
        gone = {x for k in range(len(t) - size + 1) if seen[t[k : k + size]] > 1 for x in range(k, k + size)}
        expected.append((i, len(gone)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for heavy in (substrings.HEAVY, 8):  # 8: the anchor's pieces are too many for a group
        got = substrings.remove(table, size, heavy=heavy).collect()
        assert sorted((r.doc_id, r.n_removed) for r in got) == expected
    with pytest.raises(ValueError):
        substrings.remove(table, 3000)


def test_stretches_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(substrings, "STRETCH", 100)
    rng = random.Random(5)
    text = "".join(rng.choice("abc") for _ in range(1000))
    data = (text + text[200:700]).encode()
    assert b"".join(p[:100] for _, p in substrings.stretches(data, 50))[: len(data) - 49] == data[: len(data) - 49]
    assert all(data[at : at + len(p)] == p for at, p in substrings.stretches(data, 50))


def test_substrings_where_a_heavy_core_splits_an_anchor(spark):
    rng = random.Random(3)
    size = 60
    said = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = []
    for _ in range(12):  # many texts share a passage, a few share what stands before it and part of it
        passage, before = said(70), [said(80) for _ in range(4)]
        rows += [said(80) + passage + said(80) for _ in range(8)]
        rows += [b + passage[: rng.randint(20, 60)] + said(80) for b in before]
        rows += [b + passage + said(80) for b in before]
    rows = list(enumerate(rows))
    seen = collections.Counter(t[k : k + size] for _, t in rows for k in range(len(t) - size + 1))
    expected = []
    for i, t in rows:
        gone = {x for k in range(len(t) - size + 1) if seen[t[k : k + size]] > 1 for x in range(k, k + size)}
        expected.append((i, len(gone)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for heavy in (2, 6):
        got = substrings.remove(table, size, heavy=heavy).collect()
        assert sorted((r.doc_id, r.n_removed) for r in got) == expected


def test_merged_transforms_find_repeats():
    rng = random.Random(2)
    for _ in range(20):
        size = rng.choice([5, 8, 20, 50])
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(8)]
        pieces = [b"".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 25))]
        seen = collections.Counter(p[i : i + size] for p in pieces for i in range(len(p) - size + 1))
        expected = [[i for i in range(len(p) - size + 1) if seen[p[i : i + size]] > 1] for p in pieces]
        assert [x.tolist() for x in substrings.repeated_strings(pieces, size)] == expected


def test_merging_takes_many_symbols_a_round(monkeypatch):
    """The same strings whatever the symbols of a round, and far fewer sorts than symbols."""
    rng = random.Random(3)
    words = [bytes(rng.choice(b"ab\0\xf4") for _ in range(rng.randint(1, 90))) for _ in range(9)]
    pieces = [b"".join(rng.choice(words) for _ in range(rng.randint(6, 12))) for _ in range(20)] + [b"a" * 260, b"a" * 230]
    for size in (28, 47, 200):
        seen = collections.Counter(p[i : i + size] for p in pieces for i in range(len(p) - size + 1))
        expected = [[i for i in range(len(p) - size + 1) if seen[p[i : i + size]] > 1] for p in pieces]
        for widest in (1, 2, 8, 32, 64):
            monkeypatch.setattr(substrings, "WIDEST", widest, raising=False)
            assert [x.tolist() for x in substrings.repeated_strings(pieces, size)] == expected and any(expected)
    monkeypatch.undo()
    sorts, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **b: sorts.append(1) or plain(*a, **b))
    substrings.repeated_strings(pieces, 200)
    assert len(sorts) < 60


def test_language_model(spark, docs):
    got = language_model.score(docs).collect()
    tokens = [(i, re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER)) + [None]) for i, t in corpus()]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in tokens]
    counts = collections.Counter(w for (_, t), h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(i), h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for (i, t), h in zip(tokens, held, strict=True))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert language_model.score(empty(spark)).count() == 0


def test_seating_has_its_conditional_distribution():
    discount = 0.4

    def partitions(n):  # of n customers, each as sizes of tables
        if n == 0:
            yield ()
            return
        for p in partitions(n - 1):
            yield (*p, 1)
            for i in range(len(p)):
                yield (*p[:i], p[i] + 1, *p[i + 1 :])

    rng = np.random.default_rng(0)
    for n, strength in ((2, 0.3), (5, 1.5), (7, 0.05), (7, 4.0)):
        weight = collections.Counter()
        for sizes in partitions(n):
            weight[len(sizes)] += strength ** len(sizes) * math.prod(math.prod(k - discount for k in range(1, m)) for m in sizes)
        total = sum(weight.values())
        drawn = collections.Counter(language_model.seat(np.full(20000, n), np.full(20000, strength), discount, rng).tolist())
        assert all(abs(drawn[t] / 20000 - weight[t] / total) < 0.015 for t in range(1, n + 1))
    logs = np.full(4001, -np.inf)  # many customers: against the same recursion, carried on
    logs[1] = 0.0
    t = np.arange(4001)
    for n in range(1, 4000):
        logs[1:] = np.logaddexp(logs[:-1], logs[1:] + np.log(np.maximum(n - discount * t[1:], 1e-300)))
        if n + 1 in (200, 1500, 4000):
            for strength in (0.02, 0.2, 3.0, 30.0):
                w = np.exp((x := logs + t * math.log(strength)) - x.max())
                mean = (t * w).sum() / w.sum()
                drawn = language_model.seat(np.full(2000, n + 1), np.full(2000, strength), discount, rng).mean()
                assert abs(drawn - mean) < 0.03 * mean + 0.05


def test_probabilities_sum_to_one(spark, docs, monkeypatch):
    monkeypatch.setattr(language_model, "BUCKET_BYTES", 4000)  # several buckets, and slices of the common words
    _, table = language_model.gather(docs)
    base, samples = language_model.fit(table.drop("asked"))
    rows = [language_model.Bucket(r.asDict()) for r in table.drop("asked").collect()]
    assert len(rows) > 3 and base["tokens"] == sum(b.counts.sum() for b in rows)
    rng = np.random.default_rng(1)
    for seed, before, after in samples:
        seats = [b.seats(before, seed) for b in rows]
        root = {}  # by bucket and word; a hot word stands in several buckets, with one value
        for b, (_, _, _, customers, tables) in zip(rows, seats, strict=True):
            for w, p in enumerate(b.roots(after, customers, tables)):
                key = ("hot", b.hot[w]) if b.hot[w] else (b.number, w)
                assert abs(root.setdefault(key, p) - p) < 1e-12
        unknown = language_model.new_root(after) / (1 + after["customers"][0])
        assert abs(sum(p for k, p in root.items()) + unknown - 1) < 1e-9 or any(b.own_counts[b.hot == 0].min(initial=1) == 0 for b in rows)
        known = {k for b in rows for w, n in enumerate(b.own_counts) for k in [("hot", b.hot[w]) if b.hot[w] else (b.number, w)] if n > 0 or b.hot[w]}
        total_root = sum(root[k] for k in known) + unknown
        assert abs(total_root - 1) < 1e-9
        _, d1, d2 = after["discounts"]
        contexts = np.unique(np.concatenate([b.context[b.counts > 0] for b in rows]))
        for c in rng.choice(contexts, 40):
            k = c // language_model.HASHES
            middle = {key: (1 + d1 * after["tables"][1][k]) * p / (1 + after["customers"][1][k]) for key, p in root.items() if key in known}
            leaf = {}
            for b, s in zip(rows, seats, strict=True):
                name = lambda w, b=b: ("hot", b.hot[w]) if b.hot[w] else (b.number, w)
                values = b.middles(after, s[1], s[2], b.roots(after, s[3], s[4]))
                for w, q, p in zip(b.middle_word, b.middle_class, values, strict=True):
                    if q == k and name(w) in known:
                        middle[name(w)] = p
                for w, q, p in zip(b.word, b.context, b.predictive(after, s), strict=True):
                    if q == c and name(w) in known:
                        leaf[name(w)] = p
            back = (1 + d2 * after["tables"][2][c]) / (1 + after["customers"][2][c])
            nothing = back * (1 + d1 * after["tables"][1][k]) / (1 + after["customers"][1][k]) * unknown
            assert abs(sum(leaf.get(key, back * p) for key, p in middle.items()) + nothing - 1) < 1e-9


def test_language_model_without_training_and_with_one_word(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    got = language_model.score(spark.createDataFrame([(i, "a b c") for i in held], "doc_id long, text string")).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) and r.score <= 0 for r in got)
    trained = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10][:60]
    got = language_model.score(spark.createDataFrame([(i, "word " * 4000) for i in trained], "doc_id long, text string")).collect()
    assert all(r.n_tokens == 4001 and r.score / r.n_tokens > -0.01 for r in got)


def test_score_is_the_mean_of_the_samples(spark, docs):
    """One bucket and block, worked out again token by token from seats and totals."""
    rows = [(i, t or "") for i, t in corpus()]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    _, buckets = language_model.gather(table)
    _, samples = language_model.fit(buckets.drop("asked"))
    b = language_model.Bucket(buckets.drop("asked").first().asDict())
    lower = {t.translate(LOWER) for _, t in rows}
    listed = sorted({w for t in lower for w in re.findall("[^\x20\x09-\x0d]+", t)} | {""}, key=lambda w: w.encode())
    number = {w: k for k, w in enumerate(listed)}
    classes = {w: b.hot[k] for w, k in number.items()}
    p = sum(b.predictive(after, b.seats(before, seed)) for seed, before, after in samples) / len(samples)
    known = {(w, c): x for w, c, x in zip(b.word.tolist(), b.context.tolist(), p.tolist(), strict=True)}
    expected = collections.defaultdict(list)
    for i, t in rows:
        total, last, before = 0.0, 0, ""
        for w in [*re.findall("[^\x20\x09-\x0d]+", t.translate(LOWER)), ""]:
            total += math.log10(known[number[w], last * language_model.HASHES + zlib.crc32(before.encode()) % language_model.HASHES])
            if w and classes[w]:
                last = int(classes[w])
            before = w
        expected[i].append(total)
    got = collections.defaultdict(list)
    for r in language_model.score(table).collect():
        got[r.doc_id].append(r.score)
    assert all(np.allclose(sorted(got[i]), sorted(x), atol=2e-6 * 3001) for i, x in expected.items()) and set(got) == set(expected)


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, x[7].tolist()), (1001, x[7].tolist()), (20000, None), (20020, [0.0] * 32), (20040, [float("nan")] * 32), (20060, [1.0] * 5), (None, x[3].tolist())]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), 10, every=20).collect()
    kept = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and len(v) == 32 and np.isfinite(v).all() and any(v)]
    ids, mat = np.array([i for i, _ in kept]), np.stack([v for _, v in kept])
    by = collections.defaultdict(dict)
    for r in got:
        by[r.query_id][r.rank] = (r.vec_id, r.score)
    assert set(by) == {i for i in ids.tolist() if i % 20 == 0}
    hit = 0
    for q, found in by.items():
        at = int(np.flatnonzero(ids == q)[0])
        scores = (mat * mat[at]).sum(axis=1)
        others = [k for k in np.lexsort((ids, -scores)) if ids[k] != q][:10]
        hit += len({v for v, _ in found.values()} & set(ids[others].tolist()))
        listed = [found[k] for k in sorted(found)]
        assert sorted(found) == list(range(1, 11)) and listed == sorted(listed, key=lambda r: (-r[1], r[0]))
        assert all(abs(s - scores[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, s in listed)
    assert hit >= 0.9 * 10 * len(by)
    assert neighbours.search(empty(spark, "vec_id long, embedding array<float>"), 10, every=20).count() == 0


def test_personal_data():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    fine = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 10 <= len(digits(s)) <= 15}
    rng = random.Random(6)
    texts = ["".join(rng.choice("a@.b1-é 0+(") for _ in range(rng.randint(0, 30))) for _ in range(20000)]
    texts += [t for _, t in corpus() if t] + ["4111 1111 1111 1111", "+1 (415) 555-0199", "0255.1.001.9 and 256.1.1.1", "9" * 5000, "a" * 5000 + "@b.c"]
    for t in texts:
        expected = sorted((k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t) if fine[k](m[0]))
        assert sorted(s[:3] for s in pii.find(t) if s[0] in pii.BASE) == expected
    assert [s[0] for s in pii.find("IBAN DE89 3704 0044 0532 0130 00, her ssn 123-45-6789")] == ["iban", "ssn"]
    assert pii.find("the part with number 123-45-6789") == []
    assert not any(s[0] == "iban" for s in pii.find("IBAN DE88 3704 0044 0532 0130 00"))
    for text in ("IBAN DE89370400440532013000 BIC COBADEFFXXX", "account DE89370400440532013000 OR CALL", "konto: DE89 3704 0044 0532 0130 00 UND DANN"):
        (found,) = [x for x in pii.find(text) if x[0] == "iban"]
        assert text[found[1] : found[2]].replace(" ", "") == "DE89370400440532013000"
    assert [x[0] for x in pii.find("iban GB82WEST12345698765432, iban DE89370400440532013000")] == ["iban", "iban"]
    began = time.time()
    assert pii.find("7" * 2_000_000) == [] and pii.find("1" * 300_000 + ".2.3.4") == []
    assert time.time() - began < 5
    assert pii.redact("mail a@b.co now", pii.find("mail a@b.co now")) == "mail [EMAIL] now" and pii.find(None) == []


def test_personal_data_tables(spark, docs):
    got = {str(r.doc_id): r for r in pii.report(docs).collect()}
    assert (got["307"].n_email, got["307"].n_ip, got["307"].n_card, got["307"].n_phone) == (1, 1, 1, 1)
    assert got["300"].base_sha256 == hashlib.sha256(b"").hexdigest() and got["300"].spans == ""
    safe = pii.detect(docs, redacted=True)
    assert safe.drop("pii").columns == docs.columns and "[CARD]" in safe.where("doc_id = 307").first().text
    assert pii.report(empty(spark)).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(8)
    rows = []
    for c in (*range(12), None):
        n = 40 if c == 3 else rng.randint(1, 9)
        for t in range(n):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "tool: x", "Assistant", None])
            rows.append((c, t, role, rng.choice([None, "", "\\### Assistant: </turn> ok", "é" * 30, "\\t\\\\h ##", "</turn></turn>", "word " * rng.randint(1, 120)])))
    rows += [(50, 0, "user", "twice"), (50, 0, "user", "twice"), (51, None, "assistant", "no number")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    windows = chat.windows(turns, public_tokenizers.path("byte_bpe_50k.json"), 100, 3, 8)
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    for w in windows.collect():
        assert w.n_tokens <= 100 or w.n_turns == 1
    # gaps in the numbers change nothing but the numbers
    sparse = chat.windows(turns.withColumn("turn", F.col("turn") * 600), public_tokenizers.path("byte_bpe_50k.json"), 100, 3, 8)
    plain = lambda w: sorted((str(r.conv_id), r.stretch, r.window, r.n_turns, r.repeated, r.formatted) for r in w.collect())
    assert plain(sparse) == plain(windows) and any(r.repeated for r in windows.collect())
    assert chat.digests(chat.windows(empty(spark, "conv_id long, turn long, role string, text string"), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_expectation_maximisation_row_by_row():
    rng = random.Random(10)
    rows = []
    for _ in range(800):
        yes = rng.random() < 0.2
        rows.append([0 if rng.random() < 0.3 else 1 + (yes if rng.random() < right else not yes) for right in (0.95, 0.8, 0.7)])
    counted = collections.Counter(sum(v * 3**i for i, v in enumerate(r)) for r in rows)
    patterns, counts = np.array(list(counted)), np.array(list(counted.values()), float)
    post, chance = quality.expectation_maximisation(patterns, counts, 3)
    # the same, a row and a vote at a time
    right = [{(y, v): 0.9 if y == v - 1 else 0.1 for y in (0, 1) for v in (1, 2)} for _ in range(3)]
    prior = 0.15
    for _ in range(200):
        found = []
        for r in rows:
            p = [1 - prior, prior]
            for k, v in enumerate(r):
                if v:
                    p = [p[y] * right[k][y, v] for y in (0, 1)]
            found.append(p[1] / (p[0] + p[1]))
        for k in range(3):
            for y in (0, 1):
                sums = {v: (9 if y == v - 1 else 1) + sum((x if y else 1 - x) for x, r in zip(found, rows, strict=True) if r[k] == v) for v in (1, 2)}
                for v in (1, 2):
                    right[k][y, v] = sums[v] / (sums[1] + sums[2])
        prior = min(0.5, max(1e-4, sum(found) / len(rows)))
    by_pattern = dict(zip(patterns.tolist(), post, strict=True))
    assert all(abs(by_pattern[sum(v * 3**i for i, v in enumerate(r))] - x) < 1e-3 for r, x in zip(rows, found, strict=True))
    assert chance[:, 1, 2].min() > 0.5 and chance[:, 0, 1].min() > 0.5


def test_votes_and_features_agree_with_plain_ones():
    import pyarrow as pa

    texts = ["The cat sat.", "", "AB CD!! EF %%% x - | * *", "idiot idiots Idiot, word", "ééé ÀB 12a3 $$$$ a a a", "one\ttwo  three\n"]
    t = quality.Tokens(pa.array(texts))
    for k, text in enumerate(texts):
        tokens = text.split()
        n, distinct = max(1, len(tokens)), set(tokens)
        plain = (
            sum(text.count(c) for c in "$%&*#~^=<>@!") / max(1, len(text) - len(tokens) + 1),
            sum(x.isupper() and len(x) > 2 for x in distinct) / max(1, len(distinct)),
            sum(x in "|-*" for x in tokens) / n,
            sum(re.search(r"[^\w\s]{2}", x) is not None for x in distinct) / max(1, len(distinct)),
            sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / n,
        )
        assert np.allclose(t.statistics()[k], plain)
    low, toxic = quality.features(pa.array(texts))
    weights = np.random.default_rng(0).normal(size=(2, 1 << quality.BITS)).astype(np.float32)
    scored = quality.Scorer((weights[0], 0.1), (weights[1], -0.2)).score(pa.array(texts))
    for k, text in enumerate(texts):
        steps = len(quality.MUCH)
        z = weights[0][low[k][:steps]].sum() + weights[0][low[k][steps:]].sum() * quality.SHAPES / max(1, len(set(text.split()))) + 0.1
        assert abs(scored[k, 0] - 1 / (1 + math.exp(-z))) < 1e-5
        assert abs(scored[k, 1] - 1 / (1 + math.exp(0.2 - weights[1][toxic[k]].sum()))) < 1e-5


def test_training_finds_the_telling_features():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    y = (np.arange(400) % 4 == 0).astype(float)
    rows = [np.concatenate(([5] if v else [6], rng.integers(100, 400, 10), [9] if k < 5 else [])).astype(int) for k, v in enumerate(y)]
    weights, bias = quality.train(pa.table({"at": pa.array(rows, pa.list_(pa.int32())), "post": pa.array(y)}), False)
    margin = np.array([weights[r].sum() + bias for r in rows])
    assert ((margin > 0) == (y > 0)).mean() > 0.99 and weights[5] > 1 and weights[6] < 0 and weights[9] == 0
    assert quality.train(None, True)[1] < 0


def test_quality_on_labelled_rows(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(vocabulary) for _ in range(60)]
        low, toxic = i % 7 == 0, i % 9 == 1
        if low:
            words = [w + rng.choice(["%%%", "$$$"]) for w in words]
        if toxic:
            words[5] = rng.choice(["zorgul", "zorgulen", "idiot"])
        rows.append((i, " ".join(words), "x"))
        if i < 400:
            labels.append((i, int(not low), int(toxic)))
    rows += [(900, None, "x"), (901, "", "x"), (None, "abc def", "x")]
    labels += [(None, 0, 1), (1, None, None), (77777, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, verdict string").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, table).collect()
    assert len(got) == len(rows)
    wrong = sum(r.verdict.keep == (r.doc_id % 7 == 0 or r.doc_id % 9 == 1) for r in got if r.doc_id is not None and 400 <= r.doc_id < 600)
    assert wrong <= 6
    assert all(r.verdict.keep for r in got if r.text is None or r.text == "")
    assert quality.classify(docs, table.limit(0)).count() == len(rows)
    assert quality.classify(docs.limit(0), table).count() == 0


def test_common_words_are_counted_whole():
    """A word that no batch has among its commonest counts like others."""
    texts = [" ".join([f"w{k}_{b}" for k in range(1500) for _ in range(2)] + ["rare"]) for b in range(3)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t]}) for i, t in zip((1, 2, 3), texts, strict=True)]
    found = [dict(zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True)) for b in language_model._common_step(batches)]
    assert [len(x) for x in found] == [1501] * 3 and sum(x["rare"] for x in found) == 3
