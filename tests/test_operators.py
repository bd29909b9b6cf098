import itertools
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import corpus, cue_lists, decide, features, graph, grid, learn, metrics, ngrams, pairs, sampling, vocabulary
from lexspark.plans import report, stages, storage
from lexspark.sources import readers
from lexspark.streaming import resume


def normal(spark, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.normalize("t")).collect()]


def test_normal_form(spark):
    given = ["a();\r\nb();\rc();", "void f() {\n\tx();\n}", "ab\tc", "a();   \nb();\t\n", "\n\n  a();\n\n\n", "", " \n\t\n", None, "    a();\n// c\n        b();\n    }", "x \u001c\ny"]
    found = normal(spark, given)
    assert found == ["a();\nb();\nc();", "void f() {\n    x();\n}", "ab  c", "a();\nb();", "a();", "", "", None, "a();\n// c\n    b();\n}", "x\ny"]
    assert normal(spark, found) == found
    rng = random.Random(1)
    long = "\n".join(f"{' ' * (4 + i % 9)}x{i}\t;  " if i % 7 else "" for i in range(5000))
    began = time.time()
    assert normal(spark, [long])[0].count("\n") == 4998 and time.time() - began < 5
    wild = ["".join(rng.choice(" \t\r\nab") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    once = normal(spark, wild)
    assert normal(spark, once) == once
    assert all(not t.startswith((" ", "\t")) and not t.endswith("\n") and "\r" not in t and "\t" not in t for t in once)


def test_token_distance(spark):
    rng = random.Random(2)

    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if not (old := row) else [i] + [0] * len(b)
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]

    rows = [(i, [rng.choice("abcdé") for _ in range(rng.randint(0, 12))], [rng.choice("abcdé") for _ in range(rng.randint(0, 12))]) for i in range(60)]
    rows.append((60, [str(i) for i in range(3500)], ["x"]))
    rows += [(61, ["a", "a", "b"] * 1200, ["a", "c"] * 1000), (62, ["q"] * 3001, [])]
    out = spark.createDataFrame(rows, "i int, a array<string>, b array<string>").select("i", *[c.alias(n) for c, n in zip(T.edit_distance(F.col("a"), F.col("b")), ("d", "approx"), strict=True)]).orderBy("i").collect()
    assert [r.d for r in out[:60]] == [levenshtein(a, b) for _, a, b in rows[:60]]
    assert [(r.approx, r.d) for r in out[60:]] == [(True, 3501), (True, 2400 - 1000 + 1200 + 1000), (True, 3001)]


def test_paths_and_annotations(spark):
    names = {"src/test/java/A.java": True, "FooTest.java": True, "src/main/Foo.java": False, "x/androidTest/B.java": True, "TestFoo.java": True, "latest/FooIT.java": True, "Test.txt": False}
    rows = spark.createDataFrame([(k,) for k in names], "p string").select("p", T.is_test_path("p").alias("t")).collect()
    assert {r.p: r.t for r in rows} == names
    assert spark.range(1).select(T.strip_annotation_lines(F.lit("@Test\nvoid f() {}\n  @X\n}"))).first()[0] == "void f() {}\n}"


def test_conflicts_and_first(spark):
    rows = spark.createDataFrame([(1, "a", 0, 5), (2, "a", 1, 4), (3, "b", 0, 3), (4, "b", 0, 2), (5, None, 1, 1)], "id int, k string, y int, o int")
    assert [r.id for r in corpus.keep_first(rows, ["k"], ["o"]).orderBy("id").collect()] == [2, 4, 5]
    assert [r.id for r in corpus.drop_conflicts(rows, "k", "y").orderBy("id").collect()] == [3, 4, 5]
    with pytest.raises(ValueError):
        corpus.raise_on_conflicts(rows, "k", "y")


def test_ranking_metrics(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 9), int(rng.random() < 0.3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "s int, y int")
    pos = sum(y for _, y in rows)
    levels = sorted({s for s, _ in rows}, reverse=True)
    ap = sum(sum(y for s, y in rows if s == v) / pos * sum(y for s, y in rows if s >= v) / sum(s >= v for s, _ in rows) for v in levels)
    auc = sum((a > b) + 0.5 * (a == b) for a, y in rows if y for b, z in rows if not z) / (pos * (200 - pos))
    assert abs(metrics.average_precision(df, "s", "y").first().ap - ap) < 1e-6
    assert abs(metrics.auroc(df, "s", "y").first().auroc - auc) < 1e-6
    again = df.withColumn("s", F.exp(F.col("s") * 2.0))
    assert metrics.average_precision(again, "s", "y").first().ap == metrics.average_precision(df, "s", "y").first().ap
    tied = df.withColumn("s", F.lit(1))
    assert abs(metrics.average_precision(tied, "s", "y").first().ap - pos / 200) < 1e-6
    assert metrics.auroc(df.where("y = 1"), "s", "y").first().auroc is None


def test_exact_tests(spark):
    low, high = metrics.wilson(F.lit(21), F.lit(50))
    r = spark.range(1).select(low.alias("low"), high.alias("high"), metrics.binomial_half(F.lit(21), F.lit(50)).alias("p")).first()
    assert (round(r.low, 3), round(r.high, 3), round(r.p, 4)) == (0.294, 0.558, 0.3222)
    cases = [[0.394, 0.447, 0.374, 0.661, 0.624], [0.5, -0.1, 0.2, 0.3, -0.4], [0.0, 0.0], [0.2, 0.2, -0.2, 0.1]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, d array<double>")
    out = df.select("i", *[c.alias(n) for n, c in metrics.paired_test(F.col("d")).items()]).orderBy("i").collect()
    assert out[0].p == 0.03125 and out[2].p == 1.0 and out[0].n_positive == 5

    def exact(d):
        d = [x for x in d if x]
        ranks = [(sum(abs(y) < abs(x) for y in d) + (sum(abs(y) == abs(x) for y in d) + 1) / 2) for x in d]
        w = sum(r for x, r in zip(d, ranks, strict=True) if x > 0)
        return np.mean([sum(r for s, r in zip(signs, ranks, strict=True) if s) >= w - 1e-9 for signs in itertools.product((0, 1), repeat=len(d))])

    assert out[1].p == exact(cases[1]) and out[3].p == exact(cases[3])


def test_assignment_is_cheapest():
    rng = np.random.default_rng(4)
    for _ in range(150):
        n, m = int(rng.integers(1, 6)), int(rng.integers(1, 7))
        cost = rng.integers(0, 20, (n, m)).astype(float)
        there = rng.random((n, m)) < 0.6
        edges = [[(j, cost[i, j]) for j in range(m) if there[i, j]] for i in range(n)]
        chosen = sampling.assignment(edges, m)
        taken = [j for j in chosen if j is not None]
        total = sum(sampling.UNMATCHED if j is None else cost[i, j] for i, j in enumerate(chosen))
        slots = [*range(m), *[None] * n]
        best = min(sum(sampling.UNMATCHED if (j := slots[k]) is None else cost[i, j] if there[i, j] else math.inf for i, k in enumerate(p)) for p in itertools.permutations(range(len(slots)), n)) if n + m < 9 else None
        assert len(set(taken)) == len(taken) and all(there[i, j] for i, j in enumerate(chosen) if j is not None)
        assert best is None or total == best


def test_matched_subset(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("gh"), int(rng.random() < 0.4), rng.randint(1, 40)) for i in range(60)]
    out = sampling.matched(spark.createDataFrame(rows, "id long, g string, y int, n int"), "id", "y", "n", "g").collect()
    chosen = [r for r in out if r.matched]
    assert len(out) == 60 and sum(r.y for r in chosen) * 2 == len(chosen)
    owner: dict = {}  # the number of pairs is the greatest there is

    def place(case, seen):
        for r in rows:
            if r[2] == 0 and abs(r[3] - case[3]) <= max(1.0, 0.05 * case[3]) and r[0] not in seen:
                seen.add(r[0])
                if r[0] not in owner or place(owner[r[0]], seen):
                    owner[r[0]] = case
                    return True
        return False

    assert sum(place(r, set()) for r in rows if r[2] == 1) * 2 == len(chosen)


def test_ranks_follow_the_hash(spark):
    import hashlib

    rows = spark.createDataFrame([(i, i % 3 if i % 5 else None) for i in range(500)], "id long, g int")
    got = {r.id: r["__rank"] for r in sampling.hash_ranked(rows, "id", 7, "g").collect()}
    digest = lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest()
    for g in (0, 1, 2, None):
        own = sorted((i for i in range(500) if (i % 3 if i % 5 else None) == g), key=lambda i: (digest(i), i))
        assert [got[i] for i in own] == list(range(1, len(own) + 1))
    batches = sampling.length_batches(rows.withColumn("n", F.col("id") % 7), "id", "n", 50).collect()
    assert sorted(r.batch for r in batches) == [i // 50 for i in range(500)]
    assert all(a.n >= b.n for a in batches for b in batches if a.batch < b.batch)


def test_folds_and_matching(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, f"g{rng.randint(0, 15)}", int(rng.random() < 0.3), rng.randint(1, 60)) for i in range(200)], "id long, g string, y int, n int")
    folded = sampling.cross_folds(rows, "g", "y")
    assert folded.count() == 200 and folded.groupBy("g").agg(F.countDistinct("fold").alias("k")).where("k > 1").isEmpty()
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) < 3 * min(sizes)
    found = sampling.match_candidates(rows, "id", "y", "n", "g").persist()
    matched = sampling.match(found, sampling.match_parts(found)).collect()
    assert len({r.pos for r in matched}) == len(matched) == len({r.neg for r in matched})
    assert found.groupBy("pos", "neg").count().where("count > 1").isEmpty()
    assert sampling.inner_k(5, 3) == 3 and sampling.inner_k(5, 1, 9) == 2


def test_general_binomial(spark):
    cases = [(k, n, p) for n in (0, 1, 7, 30) for k in {0, n // 3, n} for p in (0.0, 0.1, 0.5, 0.73, 1.0)]
    out = spark.createDataFrame(cases, "k long, n long, p double").select("k", "n", "p", metrics.binomial_two_sided(F.col("k"), F.col("n"), F.col("p")).alias("v")).collect()
    for r in out:
        chance = [math.comb(r.n, i) * r.p**i * (1 - r.p) ** (r.n - i) for i in range(r.n + 1)]
        assert abs(r.v - min(1.0, sum(c for c in chance if c <= chance[r.k] * (1 + 1e-7)))) < 1e-9
    many = [0.1 * (i - 18.3) for i in range(60)]  # beyond what sign by sign could be counted
    p = spark.createDataFrame([(many,)], "d array<double>").select(metrics.wilcoxon_one_sided(F.col("d"))).first()[0]
    assert 0 < p < 0.01


def test_metrics_over_ranges(spark):
    rng = random.Random(11)
    rows = [(rng.choice("ab"), rng.random(), int(rng.random() < 0.2)) for _ in range(4000)]
    found = {r.k: r for r in metrics.average_precision(spark.createDataFrame(rows, "k string, s double, y int"), "s", "y", "k").collect()}
    for k in "ab":
        own = sorted(((s, y) for key, s, y in rows if key == k), reverse=True)
        pos, tp, ap = sum(y for _, y in own), 0, 0.0
        for n, (_, y) in enumerate(own, 1):
            tp += y
            ap += y / pos * tp / n
        assert abs(found[k].ap - ap) < 1e-6 and found[k].n == len(own)


def labelled_texts(spark):
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "sleep", "await"]
    rows = []
    for i in range(90):
        y = int(i % 3 == 0)
        rows.append((i, " ".join(rng.choice(words[:4] + (["sleep", "await"] if y else [])) for _ in range(rng.randint(8, 20))), y, f"p{i % 9}"))
    return spark.createDataFrame(rows, "id long, text string, y int, g string")


def test_grid(spark):
    rows = labelled_texts(spark)
    cells = {(r.subset, r.regime): r for r in grid.jobs(rows, "y", "g", {"full": F.lit(True), "few": F.col("id") < 12}).collect()}
    assert cells["full", "cross"].skip is None and cells["few", "within"].skip == "too few positives" and len(cells) == 4
    mapping = {"sleep": "symA", "await": "symB"}
    renamed = rows.withColumn("renamed", vocabulary.rename_words("text", mapping))
    out = grid.run(renamed, "id", "text", "y", "g", "bow_plus_length", "cross", other="renamed", tuned=((0.1, 1.0), 2), k=2).collect()
    assert sum(r.n for r in out) == 90 and all(r.c in (0.1, 1.0) and r.ap > 0.8 and r.other_ap < r.ap for r in out)
    cues = spark.createDataFrame([("sleep",), ("await",)], "token string")
    ablated = grid.run(rows, "id", "text", "y", "g", "bow_ablated", "within", cues=cues, tuned=((1.0,), 2), k=2).collect()
    assert sum(r.n_pos for r in ablated) == 30
    assert grid.METHODS["bow_ablated"](rows.withColumn("t", F.lit(True)), "id", "text", "t", cues).where("token in ('sleep', 'await')").isEmpty()
    folds = spark.createDataFrame([("full", "cross", m, f, a) for m, a in (("bow", 0.4), ("char_ngram", 0.6), ("length", 0.9)) for f in range(2)] + [("matched", "cross", "bow", 0, 1.0)], "subset string, regime string, method string, fold int, ap double")
    best = grid.strong_baseline(folds).first()
    assert (best.method, best["mean"], best.folds) == ("char_ngram", 0.6, [0.6, 0.6])


def test_held_out_scorer(spark):
    pairs_ = spark.createDataFrame([(k, "p1", "alpha sleep await beta", "alpha beta gamma") for k in range(4)], "k int, g string, before string, after string")
    out = grid.score_pairs(labelled_texts(spark), pairs_, key="id", text="text", label="y", group="g", pair=["k"], before="before", after="after", tuned=((1.0,), 2)).collect()
    assert len(out) == 4 and all(r.margin < -0.2 and abs(r.margin - (r.score_after - r.score_before)) < 1e-12 for r in out)


def test_transferred_features_use_the_fitted_counts(spark):
    docs = spark.createDataFrame([(1, "a b b", "a z", True), (2, "a c", "c c", True), (3, "a b", "b", False)], "id int, text string, other string, fit boolean")
    found = features.refit(grid.METHODS["bow"], docs, "id", "text", "other", "fit")
    assert found.count() == 0  # no token stands in three training texts
    one = features.refit(lambda d, k, t, train, cues: features.tfidf(d, k, T.words(t), 1, train=train), docs, "id", "text", "other", "fit")
    assert {(r.id, r.token): round(r.weight, 6) for r in one.collect()} == {(1, "a"): 1.0, (2, "c"): 1.0, (3, "b"): 1.0}


def test_rename_map():
    corpus_words = {"pause", "Thread", "sleep", "x"}
    m = vocabulary.rename_map(["sleep", "Thread", "volatile", "MAX_X", "now"], corpus_words, {"sleep": "pause", "Thread": "Util", "now": "current"})
    assert next(vocabulary.neutral_names("_Max", 0)) == "symA" and next(vocabulary.neutral_names("A_B", 37)) == "CUE_BB"
    assert "volatile" not in m and m["Thread"] == "Util" and m["now"] == "current" and m["sleep"] != "pause" and m["MAX_X"].startswith("CUE_")
    assert len(set(m.values())) == len(m) and not set(m.values()) & corpus_words
    assert vocabulary.invert(m)["Util"] == "Thread"
    every = sorted({e for own in cue_lists.TAGS.values() for e in own if "*" not in e and "." not in e})
    named = vocabulary.rename_map(every, set(every), cue_lists.RENAMES)
    assert named["sleep"] == "pause" and "volatile" not in named and len(set(named.values())) == len(named) and not set(named.values()) & set(every)
    with pytest.raises(ValueError):
        vocabulary.invert({"a": "x", "b": "x"})


def test_logistic_regression(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=120) > 0.4).astype(float)
    df = spark.createDataFrame([(int(i % 4), float(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "fold int, y double, a double, b double, c double").withColumn("features", learn.vector("a", "b", "c"))
    model = learn.fit(df, "y", 0.7)
    w = learn.newton(x, y, 0.7)
    assert np.allclose([*model.coefficients, model.intercept], w, atol=1e-4)
    c, table = learn.tune(df, "y", "fold", (0.1, 1.0))
    assert c in (0.1, 1.0) and all(v > 0.5 for v in table.values())
    assert learn.in_sample_auroc(df.withColumn("k", F.lit(1)), ["k"], "y") == 0.5


def test_decisions(spark):
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    out = spark.range(1).select(*[decide.overall(*c).alias(str(i)) for i, c in enumerate([(t, t, t), (t, t, f), (t, n, t), (f, n, t)])]).first()
    assert list(out) == ["proceed", "stop", "inconclusive", "stop"]


def test_features(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "a b")], "id int, text string")
    w = {(r.id, r.token): r.weight for r in features.tfidf(docs, "id", T.words("text"), 1).collect()}
    idf = lambda df: math.log(4 / (1 + df)) + 1
    raw = {"a": idf(3), "b": (1 + math.log(2)) * idf(2)}
    assert abs(w[1, "b"] - raw["b"] / math.hypot(*raw.values())) < 1e-9
    assert spark.range(1).select(features.clip_half(F.array(F.lit(1e9), F.lit(-1e9), F.lit(2.0)))).first()[0] == [65504.0, -65504.0, 2.0]
    z = features.zscore(docs.withColumn("k", F.lit(3.0)), ["k"]).select("k_z").distinct().collect()
    assert z[0].k_z == 0.0


def test_layers_and_models(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1e9, 3.0, 4.0, 5.0]) for i in range(20)], "id long, v array<double>")
    features.write_layers(rows, "id", "v", 2, f"{tmp_path}/layers")
    one = features.read_layer(spark, f"{tmp_path}/layers", 0)
    assert sorted((r.id, r.vector) for r in one.collect()) == [(i, [float(i), 65504.0]) for i in range(20)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan
    assert [r.vector for r in features.read_layer(spark, f"{tmp_path}/layers", 2).distinct().collect() if r.id == 3] == [[5.0]]
    texts = spark.createDataFrame([(1, "abc"), (2, None), (3, "z")], "id int, t string")
    found = features.hidden_states(texts, "id", "t", lambda: lambda batch: [[len(x)] for x in batch])
    assert sorted((r.id, r.vector) for r in found.collect()) == [(1, [3.0]), (2, [0.0]), (3, [1.0])]


def test_pairs(spark):
    rows = spark.createDataFrame([(1, 0, "@A\nx y"), (1, 1, "@B\nx y"), (1, 2, "x z q")], "c int, t int, text string")
    out = pairs.measure(pairs.consecutive(rows, "c", "t", "text")).orderBy("t").collect()
    assert [r.annotation_only for r in out] == [1, 0] and out[0].distance == 1
    assert "+b" in spark.range(1).select(pairs.unified_diff(F.lit("a"), F.lit("b"))).first()[0]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,code\n1,"x ""q""\ny"\n2,\n3,NA\n')
    assert [tuple(r) for r in readers.read_csv(spark, f"{tmp_path}/a.csv", "id long, code string").collect()] == [(1, 'x "q"\ny'), (2, ""), (3, "NA")]
    (tmp_path / "log.jsonl").write_text('{"k": "a", "v": 1}\n{"k": "b", "v": {"x": [1]}}\nbroken\n{"k": "a", "v": 2}\n')
    latest, bad = readers.read_log(spark, f"{tmp_path}/log.jsonl")
    assert {r.k: r.v for r in latest.collect()} == {"a": "2", "b": '{"x":[1]}'} and bad.first().n_bad == 1
    import hashlib

    assert readers.file_digest(spark, f"{tmp_path}/a.csv").first().digest == hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest()[:16]
    (tmp_path / "b.json").write_text('[{"a": 1,\n "b": "x"}, {"a": NaN, "b": null}]')
    assert [r.b for r in readers.read_json(spark, f"{tmp_path}/b.json", "a double, b string").collect()] == ["x", None]
    for text in ("first", "seconds"):
        storage.write_text(spark, text, f"file://{tmp_path}/new/t.txt")
    assert (tmp_path / "new/t.txt").read_text() == "seconds" and [f.name for f in (tmp_path / "new").iterdir() if not f.name.endswith(".crc")] == ["t.txt"]
    storage.drop(spark, f"file://{tmp_path}/new")
    assert not (tmp_path / "new").exists()


def test_git_source(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@y", "-C", f"{tmp_path}/o/r", *a], check=True, capture_output=True, text=True).stdout
    (tmp_path / "o/r").mkdir(parents=True)
    run("init", "-q")
    for text in ("one", "two"):
        (tmp_path / "o/r/A.java").write_text(text)
        run("add", ".")
        run("commit", "-qm", text)
    sha = run("rev-parse", "HEAD").strip()
    spark.dataSource.register(readers.GitCommits)
    rows = spark.read.format("git_commits").option("commits", f"o/r={sha},nonsense").option("cache", f"{tmp_path}/cache").option("base", f"file://{tmp_path}/").load().collect()
    good = next(r for r in rows if r.error is None)
    assert (good.status, good.path, good.before, good.after, good.subject) == ("M", "A.java", "one", "two", "two") and len(rows) == 2


def test_resume_and_stages(spark, tmp_path):
    work = spark.createDataFrame([(i,) for i in range(6)], "k int")
    done = resume.run_pending(work.where("k < 3"), "k", lambda d: d.withColumn("v", F.col("k") * 2), f"{tmp_path}/r")
    assert done.count() == 3
    assert resume.run_pending(work, "k", lambda d: d.withColumn("v", F.lit(-1)), f"{tmp_path}/r").where("v = -1").count() == 3
    work.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        resume.stream_pending(spark, f"{tmp_path}/in", "k int", "k", lambda d: d.withColumn("v", F.lit(0)), f"{tmp_path}/s", f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 6
    plan = [stages.Stage("b", lambda s, t: t["a"].groupBy().count(), ("a",)), stages.Stage("a", lambda s, t: work), stages.Stage("z", lambda s, t: 1 / 0, required=False)]
    runner = stages.Runner(spark, f"{tmp_path}/p")
    assert list(runner.run(plan).items())[:2] == [("a", "done"), ("b", "done")]
    again = runner.run(plan)
    assert again["a"] == again["b"] == "skipped" and again["z"].startswith("failed")
    assert list(runner.run(plan, only=["b"], force=True)) == ["b"]
    runner.run(plan, only=["a"], force=True)  # what stands behind it runs again
    assert runner.run(plan, only=["a", "b"]) == {"a": "skipped", "b": "done"}
    (tmp_path / "src").mkdir()
    (tmp_path / "src/x.txt").write_text("1")
    read = [stages.Stage("r", lambda s, t: s.read.text(f"{tmp_path}/src"), sources=(f"{tmp_path}/src",), checks=lambda d: {"small": d.count() < 2})]
    assert [runner.run(read)["r"] for _ in range(2)] == ["done", "skipped"]
    (tmp_path / "src/y.txt").write_text("2")
    assert runner.run(read)["r"].startswith("failed: small")
    smoke = stages.Runner(spark, f"{tmp_path}/p", smoke=True)
    assert smoke.run(read) == {"r": "done"} and smoke.log().first().failed_checks == "small"
    index = report.write_reports(spark, smoke.root, f"file://{tmp_path}/reports", ["r", "gone"], smoke.log()).collect()
    assert [(r.stage, r.file) for r in index] == [("r", "01_r.md"), ("gone", None)] and "failed checks: small" in (tmp_path / "reports/01_r.md").read_text()


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, 1), ("b", float("nan"), None)], "n string, x double, k int")
    assert report.markdown(df) == "| n | x | k |\n|-|-|-|\n| a | 0.5000 | 1 |\n| b | — | — |\n"
    text = report.main_report("Study", "stop", {"first": True, "second": False, "third": None}, [("Rows", df, ["That's all."]), ("Nothing", None, [])])
    assert "stop and write up" in text and "| third | can't be decided |" in text and "Left out, for lack of a table: Nothing." in text and "Failed: second." in text
    report.write_json(df, f"file://{tmp_path}/x.json")
    assert (tmp_path / "x.json").read_text() == '{"n":"a","x":0.5,"k":1}\n{"n":"b","x":null,"k":null}\n'
    assert report.widest([("p", 0.78, 1.0), ("q", 0.44, 1.0)]) == "q"
    assert report.histogram(df.where("n = 'a'"), "x", 5).count() == 1


def test_ngram_weights_in_blocks(spark, monkeypatch):
    """Equal to the long form, over several blocks and buckets; only a block's different grams are shuffled."""
    monkeypatch.setattr(ngrams, "BLOCK_BYTES", 200)
    monkeypatch.setattr(ngrams, "BUCKET_BYTES", 500)
    rng = random.Random(14)
    texts = ["".join(rng.choice("ab \0\n\u00e9\U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(90)] + [None, "ab", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    long = features.tfidf(docs, "id", T.char_ngrams("text")).groupBy("id").agg(F.count("*").alias("n"), F.sum("weight").alias("total"), F.max("weight").alias("most"))
    plain = {r.id: (r.n, round(r.total, 6), round(r.most, 6)) for r in long.collect()}
    found = ngrams.weight_totals(docs, "id", "text")
    assert {r.id: (r.n_grams, round(r.total, 6), round(r.most, 6)) for r in found.collect()} == plain and len(plain) > 80
    assert "ArrayTransform" not in found._jdf.queryExecution().toString()
    again = spark.createDataFrame([(k, t) for k in (1, None, 3) for t in ("abcd", "abc")], "id long, text string")
    assert {(r.id, r.n_grams) for r in ngrams.weight_totals(again, "id", "text").collect()} == {(k, 3) for k in (1, None, 3)}


def test_grams_of_a_large_alphabet():
    text = "".join(chr(0x4E00 + 7 * i % 20000) for i in range(20000)) * 2
    for names, _, gram, tf in ngrams.counted([text], np.zeros(1, int), (3, 5)):
        n = int((names[0] > 0).sum())
        assert len(names) == len({text[i : i + n] for i in range(len(text) - n + 1)}) and tf.sum() == len(text) - n + 1
        assert text.startswith("".join(chr(c - 1) for c in names[0, :n])) and gram[0] == 0


def test_cases_are_linked_without_their_controls(spark, monkeypatch):
    """Components over pairs of cases: many controls that several cases share add no links."""
    seen, plain = [], sampling.components
    monkeypatch.setattr(sampling, "components", lambda links, values: seen.append(links.count()) or plain(links, values))
    edges = [(p, n) for p in range(5) for n in range(100, 160)] + [(p, 200 + p // 10) for p in (10, 11, 20, 21)] + [(5, 300), (4, 301), (21, 301)]
    found = spark.createDataFrame([(p, n, 0, 0) for p, n in edges], "pos long, neg long, gap long, same_group long")
    assert {tuple(r) for r in sampling.match_parts(found).collect()} == {(p, 0) for p in (0, 1, 2, 3, 4, 20, 21)} | {(10, 10), (11, 10), (5, 5)}
    assert max(seen) <= 13 < len(edges)
    assert sampling.match_parts(found.limit(0)).count() == 0


def test_matched_subset_links_cases_only(spark, monkeypatch):
    seen, plain = [], sampling.components
    monkeypatch.setattr(sampling, "components", lambda links, values: seen.append(links.count()) or plain(links, values))
    rows = spark.createDataFrame([(i, int(i < 4), 10, "g") for i in range(60)] + [(70, 1, 500, "g")], "id long, y int, n int, g string")
    out = {r.id: (r.y, r.matched) for r in sampling.matched(rows, "id", "y", "n", "g").collect()}
    assert len(out) == 61 and sum(m for _, m in out.values()) == 8 and not out[70][1] and all(out[i] == (1, True) for i in range(4))
    assert max(seen) <= 4


def test_chains_of_cases_take_few_rounds(spark, monkeypatch):
    """The search over links of cases doesn't follow a chain step by step, in whatever tasks its links are."""
    rounds, plain = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda frame: rounds.append(1) or plain(frame))
    chain = random.Random(3).sample(range(1500), 1500)
    edges = [(p, i + j) for i, p in enumerate(chain) for j in (0, 1)] + [(2000, 9000), (None, 9000)]
    found = spark.createDataFrame([(p, n, 0, 0) for p, n in edges], "pos long, neg long, gap long, same_group long")
    assert {tuple(r) for r in sampling.match_parts(found).collect()} == {(p, 0) for p in range(1500)} | {(2000, 2000)}
    assert len(rounds) <= 6
    links = [pa.RecordBatch.from_pydict({"a": ["c", "b"], "b": ["b", "b"]}), pa.RecordBatch.from_pydict({"a": ["f", "c"], "b": ["e", "a"]})]
    assert {(a, b) for x in sampling._stars(iter(links)) for a, b in zip(*x.to_pydict().values())} == {("c", "a"), ("b", "a"), ("f", "e")}
    assert not list(sampling._stars(iter([])))


def test_sparse_fit_is_the_same_model(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 4)) * (rng.random((150, 4)) < 0.5)
    y = (x[:, 0] - x[:, 2] + rng.normal(size=150) > 0.6).astype(float)
    dense = spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(x, y, strict=True)], "y double, a double, b double, c double, d double").select("y", learn.vector("a", "b", "c", "d").alias("features"))
    w = learn.newton(x, y, 0.7)
    model = learn.fit_sparse(dense, "y", 0.7)
    assert np.allclose([*model.coefficients, model.intercept], w, atol=1e-4)
    scores = [r.score for r in learn.score(model, dense).collect()]
    assert np.allclose(scores, 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))), atol=1e-4)


def test_sparse_fit_in_one_task(spark, monkeypatch):
    """Small blocks take no job a step, and the model is the one of steps over all blocks."""
    rng = np.random.default_rng(8)
    rows = [(float(v[0] + rng.normal() > 0.5), *map(float, v)) for v in rng.normal(size=(90, 3))]
    ready = spark.createDataFrame(rows, "y double, a double, b double, c double").select("y", learn.vector("a", "b", "c").alias("features")).repartition(5)
    seen, plain = [], learn.lbfgs
    monkeypatch.setattr(learn, "lbfgs", lambda *a: seen.append(1) or plain(*a))
    once = learn.fit_sparse(ready, "y", 1.0)
    assert not seen  # no step is made by the driver
    monkeypatch.setattr(learn, "FIT_BYTES", 0)
    steps = learn.fit_sparse(ready, "y", 1.0)
    assert seen
    assert np.allclose([*once.coefficients, once.intercept], [*steps.coefficients, steps.intercept], atol=1e-5)


def test_both_texts_share_a_featuriser(spark, monkeypatch):
    """One pass a fold weighs both texts; null keys have no weights, as before."""
    passes, plain = [], grid.METHODS["bow"]
    monkeypatch.setitem(grid.METHODS, "bow", lambda *a: passes.append(1) or plain(*a))
    rows = spark.createDataFrame([(i, f"{'x' if i % 3 else 'y'} w{i % 5} common", "gh"[i % 2], int(i % 3 == 0)) for i in range(60)], "id long, text string, g string, y int").withColumn("other", F.regexp_replace("text", "y", "x"))
    out = grid.run(rows, "id", "text", "y", "g", "bow", "within", other="other", tuned=((1.0,), 2), k=2).collect()
    assert [r.fold for r in out] == [0, 1] and all(r.ap == 1.0 > r.other_ap and (r.n, r.n_pos) == (30, 10) for r in out) and len(passes) == 2
    assert "other_ap" not in grid.run(rows, "id", "text", "y", "g", "bow", "within", tuned=((1.0,), 2), k=2).columns
    found = features.tfidf(spark.createDataFrame([(1, "a b"), (2, "a"), (None, "a b"), (3, "b")], "id long, text string"), "id", T.words("text"))
    assert {(r.id, r.token): round(r.weight, 6) for r in found.collect()} == {(1, "a"): 0.707107, (1, "b"): 0.707107, (2, "a"): 1.0, (3, "b"): 1.0}


def test_small_vocabularies_leave_features_in_place(spark, monkeypatch):
    long = spark.createDataFrame([(i % 5, f"t{i}", float(i)) for i in range(40)], "id long, token string, weight double")
    numbered, width = learn.number_tokens(long)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [learn.assemble(long.select("id").distinct(), long, "id", numbered, width)]
        monkeypatch.setattr(learn, "SMALL_VOCABULARY", 0, raising=False)
        found.append(learn.assemble(long.select("id").distinct(), long, "id", numbered, width))
        rows, plans = [sorted(f.collect()) for f in found], [f._jdf.queryExecution().toString() for f in found]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows[0] == rows[1] and len(rows[0]) == 5 and all(r.features.numNonzeros() for r in rows[0])
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]


def test_kinds_are_matched_as_rows_are(spark, monkeypatch):
    """The flow over kinds of rows costs what an assignment of rows costs, and no row is in two pairs."""
    rng = random.Random(5)
    rows = [(i, int(rng.random() < 0.5), rng.choice([3, 4, 5, 40, 41, 43, 60, 300, 310, 330]), rng.choice(["g", "g", "h", None])) for i in range(160)]
    frame = spark.createDataFrame([*rows, (None, 1, 4, "g"), (900, 1, 0, "g"), (901, None, 4, "g"), rows[0]], "id long, y int, n int, g string")
    found = sampling.match_lengths(frame, "id", "y", "n", "g")
    plain = sampling.match_candidates(frame.limit(160), "id", "y", "n", "g")
    assert found.schema.simpleString() == plain.schema.simpleString()
    out, best, every = found.collect(), sampling.match(plain, sampling.match_parts(plain)).collect(), {tuple(r) for r in plain.collect()}
    cost = lambda pairs: (len(pairs), sum(r.gap + 1e4 * (1 - r.same_group) for r in pairs))
    assert cost(out) == cost(best) and {tuple(r) for r in out} <= every
    assert len({r.pos for r in out}) == len({r.neg for r in out}) == len(out) > 40
    assert sampling.match_lengths(frame.limit(0), "id", "y", "n", "g").count() == 0


def test_flows_are_cheapest():
    from lexspark.operators import matching

    for seed in range(200):
        rng = random.Random(seed)
        groups, most = rng.choice([["a"], ["a", "b", None]]), rng.choice([6, 40, 300])
        cases, pool = ([(rng.choice(groups), rng.randint(1, most)) for _ in range(rng.randint(0, 25))] for _ in range(2))
        a, b = ([(*k, rows.count(k)) for k in sorted(set(rows), key=str)] for rows in (cases, pool))
        out = matching.transport(a, b)
        across = lambda g, h: 0 if g == h and g is not None else 1e4
        edges = [[(j, across(g, h) + abs(n - m)) for j, (h, m) in enumerate(pool) if abs(n - m) <= max(1.0, 0.05 * n)] for g, n in cases]
        chosen = sampling.assignment(edges, len(pool))
        assert sum(f for *_, f in out) == sum(j is not None for j in chosen)
        assert sum(f * (across(a[i][0], b[j][0]) + abs(a[i][1] - b[j][1])) for i, j, f in out) == sum(dict(own)[j] for own, j in zip(edges, chosen, strict=True) if j is not None)
        assert all(sum(f for x in out if x[s] == k for f in x[2:]) <= kind[2] for s, side in enumerate((a, b)) for k, kind in enumerate(side))


def test_matching_makes_no_table_of_candidates(spark, monkeypatch):
    """Candidates are pairs of lengths, however many rows have them."""
    seen, plain = [], sampling.match_candidates
    monkeypatch.setattr(sampling, "match_candidates", lambda *a: seen.append(plain(*a).count()) or plain(*a))
    rows = spark.createDataFrame([(i, int(i < 200), 50 + i % 2, "gh"[i // 2 % 2]) for i in range(500)], "id long, y int, n int, g string")
    out = sampling.matched(rows, "id", "y", "n", "g").where("matched").collect()
    assert len(out) == 400 and sum(r.y for r in out) == 200 and seen == [4]


@pytest.mark.parametrize("query", ["length_match_assignment", "matched_subset"])
def test_matching_queries_make_no_table_of_candidates(spark, monkeypatch, query):
    from lexspark import queries_study

    seen, plain = [], sampling.match_candidates
    monkeypatch.setattr(sampling, "match_candidates", lambda rows, *a: seen.append(rows.columns) or plain(rows, *a))
    assert queries_study.QUERIES[query](spark, "/root/testdata/sf0.001").count() > 0
    assert seen == [["y", "n"]]  # lengths, not documents


def test_bag_of_words_by_blocks(spark, monkeypatch):
    """No row a document and word is made, and the scores are those of the long features."""
    from lexspark.operators import word_blocks

    rng = random.Random(9)
    rows = spark.createDataFrame([(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 9))) or None, int(rng.random() < 0.4)) for i in range(80)], "id long, text string, y int").withColumn("g", F.lit("g")).withColumn("other", F.regexp_replace("text", "a", "b"))
    run = lambda: {tuple(r) for r in grid.run(rows, "id", "text", "y", "g", "bow", "within", other="other", tuned=((1.0,), 2), k=2).collect()}
    long, plain = [], learn.assemble
    monkeypatch.setattr(learn, "assemble", lambda *a: long.append(1) or plain(*a))
    blocks = run()
    assert not long and len(blocks) == 2
    monkeypatch.setattr(word_blocks, "MOST_WORDS", 1)
    assert run() == blocks and long


def test_words_of_blocks():
    from collections import Counter

    from lexspark.operators import word_blocks

    texts = [None, "", "12", "3ab4 \u00e9_$x9 9 ab4", "a\x00b \u65e5\u672cx \u017fK a"]
    names, codes, tf, sizes = word_blocks.counts_of(pa.array(texts, pa.string()))
    assert sizes.tolist() == [0, 0, 0, 2, 4]
    assert Counter(dict(zip([names[i].as_py() for i in codes[2:].tolist()], tf[2:].tolist(), strict=True))) == Counter(["a", "a", "b", "x", "K"])
    assert word_blocks.counts_of(pa.array([], pa.string()))[3].tolist() == []
