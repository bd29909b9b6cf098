"""Structural labels of a Java fragment: does an assertion run while asynchronous work may be in flight, does
it see a value that depends on the order of an unordered collection, or one read from a clock?

The first is liveness along control flow: a dispatch sets it, a barrier clears it, an assertion reports it.
The others are data flow: marks on values, carried by variables, reach an assertion's arguments. Branches
are joined by union; loops run until nothing changes, four times at most, and may be skipped; a catch starts
from the state before its try; assignments replace what a variable had. A call's receiver comes first, then
its arguments, then the report, then the clearing, then the setting.

A fragment that can't be read is repaired in steps (REPAIRS); if none helps, what could be read is labelled
and parse_ok is 0. Null sources give null labels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.java.parser import CLOSING, OPENING, Unit, parse

# Names that decide the labels.
DISPATCH = frozenset({"submit", "execute", "start", "thenApply", "runAsync", "supplyAsync", "schedule"})
BARRIERS = frozenset({"await", "sleep", "invokeAll", "awaitTermination"})
FUTURE_BARRIERS = {"get": (0, 2), "join": (0, 1)}
FUTURE_TYPES = frozenset({"Future", "CompletableFuture", "CompletionStage", "ScheduledFuture", "FutureTask", "ForkJoinTask", "ListenableFuture", "Thread", "Task"})
ORDER_SOURCES = frozenset({"keySet", "entrySet", "values", "listFiles", "toArray"})
GATED_SOURCES = frozenset({"values", "toArray"})
UNORDERED_TYPES = frozenset({"HashMap", "HashSet", "Hashtable", "HashTable", "ConcurrentHashMap", "IdentityHashMap", "WeakHashMap", "HashMultimap", "HashBiMap", "ConcurrentHashSet", "CopyOnWriteArraySet"})
ORDERED_TYPES = frozenset({"LinkedHashMap", "LinkedHashSet", "TreeMap", "TreeSet", "SortedMap", "SortedSet", "NavigableMap", "NavigableSet", "ImmutableSortedMap", "ImmutableSortedSet", "ArrayList", "LinkedList", "List", "ImmutableList", "ArrayDeque"})
OPEN_TYPES = frozenset({"Map", "Set"})
UNORDERED_FACTORIES = frozenset({"newHashSet", "newHashMap", "newConcurrentMap", "newIdentityHashMap", "newSetFromMap", "newKeySet", "newConcurrentHashSet"})
CLOCK_CALLS = frozenset({"currentTimeMillis", "nanoTime", "now"})
CLOCK_TYPES = frozenset({"Date", "GregorianCalendar"})
ITERATIONS = frozenset({"iterator", "stream", "forEach", "parallelStream", "spliterator"})
ORDER_BLIND = frozenset({"size", "isEmpty", "contains", "containsKey", "containsValue", "containsAll", "get", "getOrDefault", "equals", "hashCode", "length", "count", "put", "putAll", "add", "addAll", "remove", "clear"})
ORDER_SHOWING = frozenset({"toString", "toJSONString", "writeValueAsString", "toJson", "toPrettyString", "asText", "serialize", "format", "toStringHelper", "mkString", "toArray", "toList", "collect", "reduce", "flatMap", "map", "sorted"})
ASSERTION_STARTS = ("assert", "expect")
ASSERTIONS = frozenset({"verify", "fail", "checkThat", "shouldBe", "shouldEqual"})
MOCKS = frozenset({"verify", "when", "doReturn", "doThrow", "doAnswer", "doNothing", "given", "stub", "inOrder", "spy", "mock"})

PROPERTIES = ("P_ASYNC", "P_UNORD", "P_CLOCK")
ORDER, CLOCK, CONTAINER, FUTURE = "order", "clock", "container", "future"
NONE: frozenset[str] = frozenset()
LOOPS, STEPS, WITNESS, MOCK_DEPTH, TRIES = 4, 200_000, 200, 4, 16


def is_assertion(name: str) -> bool:
    return name.startswith(ASSERTION_STARTS) or name in ASSERTIONS


def is_barrier(name: str, n_args: int, future: bool = True, sleep_clears: bool = True) -> bool:
    if name in BARRIERS:
        return sleep_clears or name != "sleep"
    return future and n_args in FUTURE_BARRIERS.get(name, ())


@dataclass
class State:
    live: bool = False
    marks: dict[str, frozenset[str]] = field(default_factory=dict)

    def copy(self) -> "State":
        return State(self.live, dict(self.marks))

    def join(self, *others: "State") -> None:
        for o in others:
            self.live |= o.live
            for name, m in o.marks.items():
                self.marks[name] = self.marks.get(name, NONE) | m

    def become(self, other: "State") -> None:
        self.live, self.marks = other.live, other.marks


class _Stop(Exception):
    pass


class Analysis:
    def __init__(self, sleep_clears: bool = True):
        self.sleep_clears = sleep_clears
        self.found: dict[str, str] = {}
        self.steps = 0

    # -- statements
    def run(self, statements: list, s: State) -> None:
        for x in statements:
            self.statement(x, s)

    def statement(self, x, s: State) -> None:
        kind = x[0]
        if kind == "block":
            self.run(x[1], s)
        elif kind == "expr":
            self.value(x[1], s)
        elif kind == "seq":
            self.value(x[1], s)
            self.statement(x[2], s)
        elif kind == "local":
            for name, first in x[2]:
                marks = self.value(first, s) if first is not None else NONE
                s.marks[name] = marks | self.declared(x[1], first)
        elif kind == "if":
            self.value(x[1], s)
            other = s.copy()
            self.statement(x[2], s)
            if x[3] is not None:
                self.statement(x[3], other)
            s.join(other)
        elif kind == "loop":
            self.run(x[1], s)
            self.repeat(s, lambda t: (self.value(x[2], t) if x[2] else None, self.statement(x[4], t), self.run(x[3], t)))
        elif kind == "foreach":
            over = self.value(x[3], s)
            marks = (over - {CONTAINER, FUTURE}) | ({ORDER} if CONTAINER in over else NONE)

            def once(t):
                t.marks[x[2]] = marks
                self.statement(x[4], t)

            self.repeat(s, once)
        elif kind == "try":
            for r in x[1]:
                self.statement(r, s)
            before = s.copy()
            self.run(x[2], s)
            for c in x[3]:
                t = before.copy()
                self.run(c, t)
                s.join(t)
            if x[4] is not None:
                self.run(x[4], s)

    def repeat(self, s: State, once) -> None:
        for _ in range(LOOPS):
            t = s.copy()
            once(t)
            before = (s.live, dict(s.marks))
            s.join(t)
            if (s.live, s.marks) == before:
                return

    @staticmethod
    def declared(kind: str, first) -> frozenset[str]:
        out = set()
        if kind in FUTURE_TYPES:
            out.add(FUTURE)
        ordered = first is not None and first[0] == "new" and first[1] in ORDERED_TYPES
        if kind in UNORDERED_TYPES or (kind in OPEN_TYPES and not ordered):
            out.add(CONTAINER)
        return frozenset(out)

    # -- expressions
    def value(self, e, s: State) -> frozenset[str]:
        self.steps += 1
        if self.steps > STEPS:
            raise _Stop
        kind = e[0]
        if kind == "name":
            return s.marks.get(e[1], NONE)
        if kind == "group":
            return frozenset().union(*(self.value(p, s) for p in e[1])) if e[1] else NONE
        if kind == "assign":
            marks = self.value(e[2], s)
            if e[1][0] == "name":
                s.marks[e[1][1]] = marks
            else:
                self.value(e[1], s)
            return marks
        if kind == "lambda":
            for p in e[1]:
                s.marks.pop(p, None)
            self.statement(e[2], s)
            return NONE
        if kind == "field":
            return (self.value(e[1], s) - {CONTAINER, FUTURE}) | ({CLOCK} if e[2] == "now" else NONE)
        if kind == "new":
            marks = frozenset().union(NONE, *(self.value(a, s) for a in e[2])) - {CONTAINER, FUTURE}
            return marks | ({CLOCK} if e[1] in CLOCK_TYPES else NONE) | ({CONTAINER} if e[1] in UNORDERED_TYPES else NONE) | ({FUTURE} if e[1] in FUTURE_TYPES else NONE)
        if kind == "switch":
            self.value(e[1], s)
            start = s.copy()
            for g in e[2]:
                t = start.copy()
                self.run(g, t)
                s.join(t)
            return NONE
        if kind == "call":
            return self.call(e, s)
        return NONE

    def call(self, e, s: State) -> frozenset[str]:
        _, on, name, args = e
        receiver = self.value(on, s) if on is not None else NONE
        given = [self.value(a, s) for a in args]
        passed = frozenset().union(NONE, *given)
        if is_assertion(name):
            seen = passed if args else receiver
            if s.live:
                self.report("P_ASYNC", e)
            if ORDER in seen:
                self.report("P_UNORD", e)
            if CLOCK in seen:
                self.report("P_CLOCK", e)
        if is_barrier(name, len(args), FUTURE in receiver, self.sleep_clears):
            s.live = False
        if name in DISPATCH and not self.mocked(on):
            s.live = True
        out = set((passed | receiver) & {CLOCK})
        if (ORDER in receiver and name not in ORDER_BLIND) or ORDER in passed:
            out.add(ORDER)
        held = CONTAINER in receiver
        if name in ORDER_SOURCES and (name not in GATED_SOURCES or held or ORDER in receiver):
            out.add(ORDER)
        if name in ITERATIONS and held:
            out.add(ORDER)
        if name in ORDER_SHOWING and (held or CONTAINER in passed):
            out.add(ORDER)
        if name in CLOCK_CALLS:
            out.add(CLOCK)
        if name in UNORDERED_FACTORIES or (on is not None and on[0] == "name" and on[1] in UNORDERED_TYPES):
            out.add(CONTAINER)
        if name in DISPATCH or (FUTURE in receiver and name.startswith("then")):
            out.add(FUTURE)
        return frozenset(out)

    @staticmethod
    def mocked(on) -> bool:
        for _ in range(MOCK_DEPTH):
            if on is None or on[0] != "call":
                return False
            if on[2] in MOCKS:
                return True
            on = on[1]
        return False

    def report(self, what: str, e) -> None:
        self.found.setdefault(what, show(e)[:WITNESS])


def show(e) -> str:
    """A short form of an expression, as evidence."""
    kind = e[0]
    if kind == "name":
        return e[1]
    if kind == "group":
        return " ".join(show(p) for p in e[1]) or "_"
    if kind == "field":
        return f"{show(e[1])}.{e[2]}"
    if kind == "call":
        return (f"{show(e[1])}." if e[1] is not None else "") + f"{e[2]}({', '.join(show(a) for a in e[3])})"
    if kind == "new":
        return f"new {e[1]}({', '.join(show(a) for a in e[2])})"
    return kind


def closers(source: str) -> str:
    """The brackets that are open at the end."""
    from lexspark.java.lexer import code_tokens

    stack: list[str] = []
    for t in code_tokens(source):
        if t.text in OPENING:
            stack.append(t.text)
        elif t.text in CLOSING and stack and stack[-1] == CLOSING[t.text]:
            stack.pop()
    return "".join(OPENING[x] for x in reversed(stack))


REPAIRS = ("close_brackets", "close_brackets_semicolon", "semicolon", "empty_body", "truncate_to_last_statement", "rewind_and_close")


def repaired(source: str):
    """(name of the repair, repaired source) candidates, in order."""
    missing = closers(source)
    round_ones, curly = missing.replace("}", ""), "}" * missing.count("}")
    yield "close_brackets", source + missing
    yield "close_brackets_semicolon", source + round_ones + ";" + curly
    yield "semicolon", source + ";"
    yield "empty_body", source + " {}"
    cut = max(source.rfind(";"), source.rfind("}"))
    if cut >= 0:
        kept = source[: cut + 1]
        yield "truncate_to_last_statement", kept + closers(kept)
    for _ in range(TRIES):
        cut = max(source.rfind(";", 0, cut), source.rfind("}", 0, cut), source.rfind("{", 0, cut)) if cut > 0 else -1
        if cut < 0:
            return
        kept = source[: cut + 1]
        yield "rewind_and_close", kept + closers(kept)


def read(source: str) -> tuple[Unit, str | None]:
    unit = parse(source)
    if unit.ok and unit.methods:
        return unit, None
    for name, text in repaired(source):
        other = parse(text)
        if other.ok and other.methods:
            return other, name
    unit.ok = False
    return unit, None


def analyse(source: str) -> dict:
    unit, repair = read(source)
    out: dict = {"parse_ok": int(unit.ok), "parse_repair": repair, "n_methods": len(unit.methods)}
    for sleep_clears in (True, False):
        a = Analysis(sleep_clears)
        for m in unit.methods:
            s = State(marks={name: Analysis.declared(kind, None) for kind, name in m.params})
            try:
                a.run(m.body, s)
            except _Stop:
                pass
        if sleep_clears:
            out |= {p: int(p in a.found) for p in PROPERTIES}
            out["witness"] = a.found
        else:
            out["P_ASYNC_sleep_kills"] = int("P_ASYNC" in a.found)
    return out


LABELS = "struct<parse_ok:int,parse_repair:string,n_methods:int,P_ASYNC:int,P_UNORD:int,P_CLOCK:int,P_ASYNC_sleep_kills:int,witness:map<string,string>>"
_FIELDS = ("parse_ok", "parse_repair", "n_methods", *PROPERTIES, "P_ASYNC_sleep_kills", "witness")


def labels_column(source: Column | str) -> Column:
    """Labels of a column of fragments, in Arrow batches. P_ASYNC_sleep_kills is the variant in which
    a sleep is no barrier."""

    @F.pandas_udf(LABELS)
    def labelled(sources: pd.Series) -> pd.DataFrame:
        rows = [analyse(s) if s is not None else dict.fromkeys(_FIELDS) for s in sources]
        frame = pd.DataFrame({f: pd.Series([r[f] for r in rows], dtype=object) for f in _FIELDS})
        return frame

    return labelled(source)


def extract_methods(source: str, every_key: bool = True) -> list[tuple[str, str]]:
    """(key, text) of methods: `Class.name` of the innermost class; with every_key also the full path, and
    the bare name if one body in the file has it. Of overloads the last counts."""
    out: dict[str, str] = {}
    bodies: dict[str, list[str]] = {}
    for m in parse(source).methods:
        if not m.name:
            continue
        text = source[m.start : m.end]
        bodies.setdefault(m.name, []).append(text)
        if m.owners:
            out[f"{m.owners[-1]}.{m.name}"] = text
            if every_key:
                out[".".join((*m.owners, m.name))] = text
        elif not every_key:
            out[m.name] = text
    if every_key:
        out |= {name: found[0] for name, found in bodies.items() if len(found) == 1 and name not in out}
    return list(out.items())


def methods_column(source: Column | str, every_key: bool = True) -> Column:
    """An array of (key, body), to explode."""

    @F.pandas_udf("array<struct<key:string,body:string>>")
    def extracted(sources: pd.Series) -> pd.Series:
        return sources.map(lambda s: [{"key": k, "body": b} for k, b in extract_methods(s, every_key)] if s is not None else None)

    return extracted(source)
