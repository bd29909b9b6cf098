import pytest

from lexspark.java import lexer, structure


def labels(body):
    r = structure.analyse("public void t() throws Exception {" + body + "}")
    return r["P_ASYNC"], r["P_UNORD"], r["P_CLOCK"]


A, U, C, N = (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("pool.submit(task); assertEquals(1, counter.get());", A),
        ("Future f = pool.submit(task); f.join(); assertTrue(ok);", N),
        ("Future<Integer> f = pool.submit(task); assertEquals(1, f.get());", N),
        ('pool.submit(task); assertEquals(1, map.get("k"));', A),
        ("pool.submit(task); Thread.sleep(100); assertTrue(ok);", N),
        ("pool.submit(task);", N),
        ("assertTrue(ok); pool.submit(task);", N),
        ("if (x) { pool.submit(task); } assertTrue(ok);", A),
        ("pool.submit(task); if (x) { latch.await(); } assertTrue(ok);", A),
        ("pool.submit(task); if (x) { latch.await(); } else { latch.await(); } assertTrue(ok);", N),
        ("pool.submit(() -> { counter.incrementAndGet(); }); assertEquals(1, counter.get());", A),
        ("Thread th = new Thread(r); th.start(); th.join(); assertTrue(ok);", N),
        ("Thread th = new Thread(r); th.start(); assertTrue(ok);", A),
        ("Thread th = new Thread(r); th.start(); th.join(100); assertTrue(ok);", N),
        ("Future f = pool.submit(r); f.get(1, TimeUnit.SECONDS); assertTrue(ok);", N),
        ('pool.submit(r); String s = String.join(",", parts); assertTrue(ok);', A),
        ("verify(mock).start(); assertTrue(ok);", N),
        ("server.start(); verify(mock).called();", A),
        ("try (Handle h = pool.submit(r)) { assertTrue(ok); }", A),
        ("assertEquals(x, map.keySet());", U),
        ("Map<String, Integer> m = new HashMap<>(); for (String k : m) { assertEquals(x, k); }", U),
        ("Map<String, Integer> m = new LinkedHashMap<>(); assertEquals(x, m.toString());", N),
        ("Set s = map.keySet(); assertTrue(ok);", N),
        ("Object k = map.keySet(); k = other; assertEquals(x, k);", N),
        ("List l = new ArrayList(map.keySet()); assertEquals(x, l);", U),
        ("assertEquals(x, json.toJson(HashMultimap.create()));", U),
        ("Map m = service.call(); assertEquals(x, m.toString());", U),
        ("Map m = service.call(); assertEquals(2, m.size());", N),
        ("Set<String> s = new HashSet<>(); assertEquals(expected, s);", N),
        ("assertEquals(x, Sets.newHashSet(a).toString());", U),
        ("List l = service.call(); assertEquals(x, l.toString());", N),
        ("Map m = service.call(); assertEquals(x, m.get(k).name());", N),
        ("assertEquals(x, thing.values());", N),
        ("Map m = new HashMap(); assertEquals(x, m.values());", U),
        ("Map m = new HashMap(); assertEquals(x, service.send(m));", N),
        ("Set s = new HashSet(); assertEquals(x, s.iterator().next());", U),
        ("assertEquals(x, m.keySet().iterator().next());", U),
        ("long t = System.currentTimeMillis(); assertEquals(5, t);", C),
        ("assertEquals(x, Instant.now());", C),
        ("assertEquals(new Date(), x);", C),
        ("try (Clock c = Instant.now()) { assertEquals(x, c); }", C),
        ("long t0 = System.nanoTime(); run(); log(System.nanoTime() - t0); assertTrue(ok);", N),
        ('String s = "pool.submit(x); keySet()"; assertEquals("HashMap", s);', N),
        ("for (int i = 0; i < 3; i++) { assertTrue(ok); pool.submit(r); }", A),
        ("try { pool.submit(r); f(); } catch (Exception e) { assertTrue(ok); }", N),
        ("try { f(); } finally { pool.submit(r); } assertTrue(ok);", A),
    ],
)
def test_labels(body, expected):
    assert labels(body) == expected


def test_sleep_variant_and_repairs():
    r = structure.analyse("void t() { pool.submit(task); Thread.sleep(9); assertTrue(ok); }")
    assert (r["P_ASYNC"], r["P_ASYNC_sleep_kills"]) == (0, 1)
    r = structure.analyse("void t() { pool.submit(task); assertEquals(1, counter.get(")
    assert r["parse_ok"] == 1 and r["parse_repair"] and r["P_ASYNC"] == 1
    r = structure.analyse("void t() { pool.submit(task); assertTrue(ok);")
    assert (r["parse_repair"], r["P_ASYNC"]) == ("close_brackets", 1)
    r = structure.analyse("t( {{{ ???")
    assert (r["parse_ok"], r["P_ASYNC"], r["P_UNORD"], r["P_CLOCK"]) == (0, 0, 0, 0)


def test_predicates():
    assert all(map(structure.is_assertion, ("assertTrue", "expectThat", "verify", "fail")))
    assert not any(map(structure.is_assertion, ("Assert", "check", "verified")))
    assert structure.is_barrier("await", 2) and structure.is_barrier("get", 0) and structure.is_barrier("get", 2)
    assert not structure.is_barrier("get", 1) and not structure.is_barrier("join", 2) and not structure.is_barrier("get", 0, False)


@pytest.mark.parametrize("source", ['int a = 1; // x\n/* y */ char c = \'"\';', '"open\nnext', "'''", '"""text\n"block"\n""" x', "1.5f 0x1F a1 é$ \\ \x00", '"a\\"b" \'\\\'\'', '"ends \\'])
def test_lexer_loses_nothing(source):
    tokens = lexer.tokenize(source)
    assert "".join(t.text for t in tokens) == source
    assert all(source[t.start : t.end] == t.text for t in tokens)


@pytest.mark.parametrize(
    ("source", "expected"),
    [("1e-5 1.2.3 3. .5 .x", ["1e-5", "1.2.3", "3.", ".5", ".", "x"]), ("0e-5 0x1F 2E+3f", ["0e", "-", "5", "0x1F", "2E+3f"]), ('"a\\\nb" x', ['"a\\\nb"', "x"]), ("'\n'", ["'", "'"]), ("a\u00a0b", ["a", "\u00a0", "b"])],
)
def test_lexer_rules(source, expected):
    assert [t.text for t in lexer.code_tokens(source)] == expected


def test_overloads_have_no_bare_name():
    found = dict(structure.extract_methods("class A { void m(){} void m(int x){} void n(){} class B { void n(){} } }"))
    assert sorted(found) == ["A.B.n", "A.m", "A.n", "B.n"] and found["A.m"] == "void m(int x){}"


def test_rename():
    code = 'sleep(1); sleepTimeout(); "sleep"; // sleep\n\'s\'; x.sleeper.sleep(); """\nsleep"""'
    out = lexer.rename(code, {"sleep": "pause"})
    assert out == 'pause(1); sleepTimeout(); "sleep"; // sleep\n\'s\'; x.sleeper.pause(); """\nsleep"""'
    assert lexer.rename(out, {"pause": "sleep"}) == code
    assert lexer.rename_report(code, {"sleep": "pause"}) == {"same_count": True, "same_kinds": True, "n_replaced": 2}


def test_methods():
    source = "class A { void m() { a(); } class B { int m(int x) { return x; } void only() {} } }"
    found = dict(structure.extract_methods(source))
    assert found["A.m"] == "void m() { a(); }" and found["B.m"] == found["A.B.m"] == "int m(int x) { return x; }"
    assert "m" not in found and found["only"] == "void only() {}"


def test_columns(spark):
    df = spark.createDataFrame([("void t() { pool.submit(x); assertTrue(ok); }",), (None,)], "code string")
    rows = df.select(structure.labels_column("code").alias("l"), lexer.tokens_column("code").alias("t"), structure.methods_column("code").alias("m")).collect()
    assert rows[0].l.P_ASYNC == 1 and rows[0].l.witness["P_ASYNC"].startswith("assertTrue") and len(rows[0].t) > 5 and rows[0].m[0].key == "t"
    assert rows[1].t is None


def test_counts_leave_without_tokens(spark):
    """Keys with several sources, null ones too, count their different identifiers once; nothing wide leaves the lexer."""
    code = ["a b a; if (c) x", "a d", None, "1 + 2", "e", "e f"]
    rows = spark.createDataFrame(list(zip([1, 1, 2, 3, None, None], code)), "id long, code string")
    assert {r.id: (r.n, r.n_distinct) for r in lexer.identifier_totals(rows, "id", "code").collect()} == {1: (7, 5), None: (3, 2)}
    once = lexer.identifier_totals(rows.where("id > 0").limit(1), "id", "code")
    assert once.columns == ["id", "n", "n_distinct"] and [tuple(r) for r in once.collect()] == [(1, 5, 4)]


def test_kinds_are_counted_without_tokens(spark):
    rows = spark.createDataFrame([(1, "if (é) a1 // é"), (1, '"s" b'), (2, None), (3, "")], "id long, code string")
    found = lexer.kind_counts(rows, "id", "code").groupBy("id", "kind").sum("n", "n_chars").collect()
    assert {tuple(r) for r in found} == {(1, "keyword", 1, 2), (1, "ws", 4, 4), (1, "op", 2, 2), (1, "other", 1, 1), (1, "ident", 2, 3), (1, "comment", 1, 4), (1, "string", 1, 3)}
    assert {(k, n) for k, n, _ in lexer.kinds_of("a b")} == {("ident", 2), ("ws", 1)}
