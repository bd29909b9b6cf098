"""The queries with their contracts' parameters against brute force on the smallest tables, and every stage of the
pipeline on a small table with awkward rows."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from lexspark.llm import common, decontaminate, pii, queries

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows_of(name, folder=DATA):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def run(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


class Groups(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        self[self.root(a)] = self.root(b)


def test_op1(spark):
    docs = rows_of("documents")
    prints = {}
    for d in docs:
        words = re.findall("[^\x20\x09-\x0d]+", (d["text"] or "").translate(LOWER))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))] if words else []
        prints[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    groups = Groups()
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                groups.join(a, b)
    least = {}
    for i in sorted(prints, reverse=True):
        least[groups.root(i)] = i
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in run(spark, "op1_simhash")) == sorted((i, f"{f:016x}", least[groups.root(i)]) for i, f in prints.items())


def test_op2(spark):
    library, at, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for d in sorted(rows_of("documents"), key=lambda d: d["doc_id"]):
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        expected.append((d["doc_id"], at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op2_token_shards")) == expected


def test_op3(spark):
    by = collections.defaultdict(list)
    for t in rows_of("conversations"):
        by[t["conv_id"]].append((t["turn"], t["role"], t["text"] or ""))
    said = "\\### Assistant: </turn> ok"
    by[-7] = [(0, "user", said), (1, "assistant", said)]
    expected = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        expected.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)))
    got = run(spark, "op3_chat")
    assert sorted((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got) == sorted(expected) and all(r.formatted_chars > 0 for r in got)


def test_op4(spark):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = duck.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL['op4_decontaminate']})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in run(spark, "op4_decontaminate")) == sorted(expected)


def test_op5(spark):
    docs = {d["doc_id"]: (d["text"] or "").encode() for d in rows_of("documents")}
    seen = collections.Counter(b[k : k + 200] for b in docs.values() for k in range(len(b) - 199))
    expected = []
    for i, b in docs.items():
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = 1
        expected.append((i, len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), sha(bytes(x for x, g in zip(b, gone, strict=False) if not g))))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op5_substrings")) == sorted(expected)


def test_op6(spark):
    got = {r.doc_id: r for r in run(spark, "op6_quality")}
    assert sorted(got) == sorted(d["doc_id"] for d in rows_of("documents"))
    assert all(0 <= r.low_quality <= 1 and 0 <= r.toxic <= 1 and r.keep == (r.low_quality < 0.5 and r.toxic < 0.5) for r in got.values())


def test_op7(spark):
    docs = [(d["doc_id"], re.findall("[^\x20\x09-\x0d]+", (d["text"] or "").translate(LOWER)) + [None]) for d in rows_of("documents")]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    counts = collections.Counter(w for i, t in docs if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in run(spark, "op7_language_model")}
    for i, t in docs:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(counts[w] > 0 for w in t), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) < 1e-6 * len(t)
    own = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_op8(spark):
    vectors = [(r["vec_id"], np.array(r["embedding"], float)) for r in rows_of("embeddings") if r["embedding"] is not None]
    ids, x = np.array([i for i, _ in vectors]), np.stack([v for _, v in vectors])
    expected = set()
    for q in ids[ids % 20 == 0].tolist():
        scores = (x * x[ids == q][0]).sum(axis=1)
        expected |= {(q, k + 1, int(ids[j])) for k, j in enumerate([j for j in np.lexsort((ids, -scores)) if ids[j] != q][:20])}
    got = {(r.query_id, r["rank"], r.vec_id) for r in run(spark, "op8_neighbours")}
    assert len(got) == len(expected) and len(got & expected) >= 0.95 * len(expected)


def test_op9(spark):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    fine = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 10 <= len(digits(s)) <= 15}
    got = {r.doc_id: r for r in run(spark, "op9_pii")}
    for d in rows_of("documents"):
        base = sorted((m.start(), list(patterns).index(k), k, m.end()) for k, p in patterns.items() for m in re.finditer(p, d["text"] or "") if fine[k](m[0]))
        r = got[d["doc_id"]]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in base) for k in patterns]
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in base)) and all(f"{k}:{a}:{b}" in r.spans for a, _, k, b in base)


def packed_right(pieces, docs, size=2048):
    """Every id of every document in one piece, sequences without gaps, little padding."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    texts = collections.defaultdict(list)
    for i, t in docs:
        texts[i].append(library.encode(t or "", add_special_tokens=False).ids + [1])
    assert set(by) == set(texts)
    for i, (ids, *more) in texts.items():
        assert sum(p.length for p in by[i]) == len(ids) + sum(map(len, more))
        if not more:
            at = 0
            for p in sorted(by[i], key=lambda p: p.start):
                assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), crc(ids[at : at + p.length]))
                at += p.length
            assert at == len(ids)
    padding = total = 0
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        n = sum(p.length for p in own)
        assert [p.offset for p in own] == [sum(p.length for p in own[:k]) for k in range(len(own))] and n <= size
        padding += 0 if n & (n - 1) == 0 else size - n
        total += n
    assert padding <= 0.05 * total


def test_op10(spark):
    packed_right(run(spark, "op10_packing"), [(d["doc_id"], d["text"]) for d in rows_of("documents")])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents, low-quality and toxic ones, copies, benchmark passages, personal data, awkward rows."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    said = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, said(14)) for k in range(4)] + [(9, None), (10, "")]
    docs, labels = [], []
    for i in range(300):
        text = said(60)
        low, toxic = i % 10 == 0, i % 11 == 1
        if low:
            text = " ".join(w + "%%%" for w in text.split())
        if toxic:
            text = f"{text} idiot scum"
        if i % 13 == 2:
            text += " " + items[i % 4][1]
        if i % 17 == 3:
            text += f" mail a{i}@b.co or 10.0.0.{i % 200}"
        docs.append((i, text))
        if i % 2 == 0:
            labels.append((i, int(not low), int(toxic)))
    centre = said(200).split()
    for i in range(30):  # a star of near copies
        words = list(centre)
        for k in range(rng.randint(0, 3)):
            words[40 + 50 * k] = f"edited{i}{k}"
        docs.append((1000 + i, " ".join(words)))
    docs += [(2000, None), (2001, ""), (2002, " \n "), (2003, docs[5][1]), (2003, docs[5][1]), (None, said(50)), (2004, said(20_000))]
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    table = [(i, t, "en", "s", None if t is None else len(t), f"v{i}", 7, 8, [1], 0.5) for i, t in docs]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, verdict string, hits int, row1 int, pii array<int>, fp double").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def plain(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_pipeline(spark, folder):
    docs = common.table(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "decontaminate", "personal_data", "pack"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder)
        if name != "pack":
            assert found.columns == docs.columns
            found = common.staged(found, "test")
        kept.append((docs.collect(), found.collect()))
        docs = found
    before, after = kept[0]  # what it keeps is as it was; the planted rows go, awkward ones stay
    assert set(map(str, after)) <= set(map(str, before))
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    bad = {i for i in range(300) if i % 10 == 0 or i % 11 == 1}
    assert len(gone & bad) >= 0.95 * len(bad) and len(gone - bad) <= 2 and not gone & {2000, 2001, 2002, None}
    before, after = kept[1]
    sets = [frozenset(w[k : k + 5] for k in range(max(1, len(w) - 4))) if (w := tuple((r.text or "").translate(LOWER).split())) else frozenset() for r in before]
    groups = Groups()
    for a in range(len(before)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] == sets[b] or shared and shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                groups.join(a, b)
    least = {}
    for k, r in enumerate(before):
        least[groups.root(k)] = min(least.get(groups.root(k), (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == sorted(least.values())
    before, after = kept[2]
    items = [decontaminate.words_of(r["text"] or "") for r in rows_of("benchmark", folder.removeprefix("file://"))]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9)) if w}
    clean = [r for r in before if not any(tuple(w[k : k + 10]) in windows for w in [decontaminate.words_of(r.text or "")] for k in range(len(w) - 9))]
    assert sorted(map(str, after)) == sorted(map(str, clean)) and len(after) < len(before)
    before, after = kept[3]
    expected = [(r.doc_id, r.text and pii.redact(r.text, pii.find(r.text))) for r in before]
    assert sorted(map(str, ((r.doc_id, r.text) for r in after))) == sorted(map(str, expected))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after) and any("[EMAIL]" in (r.text or "") for r in after)
    before, after = kept[4]
    packed_right(after, [(r.doc_id, r.text) for r in before])
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, after))


def test_pipeline_over_nothing(spark, folder, tmp_path):
    path = f"file://{tmp_path}"
    for name in ("documents", "benchmark", "labels"):
        common.table(spark, folder, name).limit(0).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
