r"""Chat formatting in budgeted windows.

A turn is written as `### Role: text </turn>` and a line feed, without the space before the end mark.
Within a role or a text a backslash is doubled and every `###`, `</turn>` (and, in a role, `: `) is
replaced by a backslash and a letter, so that control strings never stand inside a turn and the original
comes back exactly.

Windows: over each conversation's turns, in order of their number, runs the prefix sum of their tokens. A
window takes the longest span of turns whose sum, with the system turn and the repeated history, stays
within the budget; the span is found by bisecting the prefix sums. Each window begins with the system turn
(the conversation's first turn, if its role is system), then repeats up to HISTORY turns before the span as
far as a quarter of the budget allows, then holds the span. Loss falls on the texts of the span's
assistant turns; those repeated as history were targets in an earlier window and are masked. A turn longer
than the budget has a window of its own and is kept whole.

Long conversations are dealt in stretches of about STRETCH turns, so no task needs a whole conversation to
format it: a stretch is given the system turn and the last HISTORY turns of the stretch before, and windows
end where a stretch ends. A turn's place is the number of rows with lower turn numbers, whatever gaps these
leave; rows of one number stay together. Rows pass as a stream, and memory is bounded by one window.

A null text or role is empty; a null turn number sorts first. Rows that repeat a turn number are turns of
their own, ordered by role and text. Rows of a null conversation form one conversation. An empty table
gives no windows; columns other than the four are left out.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm import common
from lexspark.llm.encoding import encoder

BUDGET, HISTORY, STRETCH = 1024, 4, 512
MARK, END = "### ", "</turn>\n"
_IN = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t", ": ": "\\c"}
_OUT = {v[1]: k for k, v in _IN.items()} | {"=": ""}
_TEXT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|: ")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    return (_ROLE if role else _TEXT).sub(lambda m: _IN[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _OUT[m[1]], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(the turn as written, where its text begins, where it ends)."""
    name = role.capitalize() if role in PLAIN else escape(role, True)
    head = f"{MARK}{chr(92) + '=' if role in _PLAIN_BACK else ''}{name}: "
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


#: Roles written with a capital; others are written as they are, behind an empty escape if they look like these.
PLAIN = ("system", "user", "assistant")
_PLAIN_BACK = {r.capitalize(): r for r in PLAIN}


def read_turns(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, begin, end) of each turn of a formatted text; begin and end hold the written text."""
    at = 0
    while at < len(text):
        stop = text.index(END, at)
        head = text.index(": ", at + len(MARK))
        role = text[at + len(MARK) : head]
        yield _PLAIN_BACK.get(role, unescape(role)), unescape(text[head + 2 : stop]), head + 2, stop
        at = stop + len(END)


def spans(tokens: list[int], system: int, budget: int, history: int, before: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first turn, turn behind the last, repeated turns) of each window. before: tokens of the turns
    that precede the first one here."""
    sums = [0]
    for t in [*before, *tokens]:
        sums.append(sums[-1] + t)
    start, n, skip = len(before), len(before) + len(tokens), len(before)
    while start < n:
        room = budget - system
        back = start
        while back > 0 and start - back < history and sums[start] - sums[back - 1] <= budget // 4 and sums[start + 1] - sums[back - 1] <= room:
            back -= 1
        stop = max(start + 1, bisect.bisect_right(sums, sums[back] + room) - 1)
        yield start - skip, stop - skip, start - back
        start = stop


WINDOWS = "conv_id long, stretch long, window long, first_turn long, n_turns long, repeated long, has_system boolean, n_tokens long, formatted string, loss_spans array<struct<start:bigint,stop:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def windows(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY, stretch: int = STRETCH) -> DataFrame:
    """A row for each window, from columns conv_id, turn, role, text: its conversation, stretch and number
    there, the number of turns of its span, of repeated turns before them, whether a system turn that the
    span doesn't hold leads, tokens, the formatted text and the loss spans (code points)."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), common.text_of("role").alias("role"), common.text_of("text").alias("text"))
    at = F.coalesce("turn", F.lit(-(2**62)))
    numbers = t.groupBy(F.col("conv_id").alias("c"), at.alias("at")).agg(F.count("*").alias("n"))
    lower = Window.partitionBy("c").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    places = numbers.select("c", "at", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("place"))
    t = t.join(places, t.conv_id.eqNullSafe(places.c) & (at == places["at"])).drop("c", "at")
    t = t.withColumn("stretch", F.floor(F.col("place") / stretch).cast("long"))
    own = t.withColumn("kind", F.lit(2))
    tail = t.where(F.col("place") % stretch >= stretch - history).withColumn("stretch", F.col("stretch") + 1).withColumn("kind", F.lit(1))
    # the system turn, for stretches other than its own; few conversations are that long
    lead = t.groupBy("conv_id").agg(F.min(F.struct(at.alias("at"), "role", "text", "turn", "stretch")).alias("s"), F.max("stretch").alias("last")).where((F.col("last") > F.col("s.stretch")) & (F.col("s.role") == "system"))
    later = t.select(F.col("conv_id").alias("c"), F.col("stretch").alias("k")).distinct()
    systems = lead.join(later, lead.conv_id.eqNullSafe(later.c) & (later.k > F.col("s.stretch"))).select("conv_id", F.col("s.turn").alias("turn"), F.col("s.role").alias("role"), F.col("s.text").alias("text"), F.col("k").alias("stretch"), F.lit(0).alias("kind"))
    own, tail = own.drop("place"), tail.drop("place")
    dealt = own.unionByName(tail).unionByName(systems)
    dealt = dealt.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "kind", "turn", "role", "text")
    return common.map_arrow(dealt.select("conv_id", "stretch", "kind", "turn", "role", "text"), _windows_step(tokenizer, budget, history), WINDOWS)


def _windows_step(tokenizer: str, budget: int, history: int):
    def step(batches):
        coder = encoder(tokenizer)
        state = None
        for batch in common.slices(batches):
            written = [format_turn(r, x) for r, x in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            _, at = coder.encode(pa.array([w[0] for w in written], pa.string()))
            out: list = []
            for conv, stretch, kind, turn, role, w, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "stretch", "kind", "turn", "role")), written, (at[1:] - at[:-1]).tolist(), strict=True):
                if state is None or state.key != (conv, stretch):
                    if state is not None:
                        out += state.finish()
                    state = _Stretch(conv, stretch, budget, history)
                out += state.add(kind, turn, role, w, n)
            if out:
                yield _batch(out)
        if state is not None and (out := state.finish()):
            yield _batch(out)

    return step


def _batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.int64(), pa.string(), _SPANS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in WINDOWS.split(", ")])


class _Stretch:
    """Turns of one stretch as they come; full windows leave at once."""

    def __init__(self, conv, stretch, budget, history):
        self.key, self.budget, self.history = (conv, stretch), budget, history
        self.system = None  # (written, tokens) of a system turn from an earlier stretch or from this one
        self.before: list = []  # history: (role, written, tokens)
        self.turns: list = []
        self.sum = self.window = 0
        self.fresh = True

    def add(self, kind, turn, role, written, n):
        if kind == 0:
            self.system = (written, n)
        elif kind == 1:
            if not (self.before == [] and role == "system" and self.system is not None and self.system[0] == written):
                self.before = [*self.before, (role, written, n)][-self.history :] if self.history else []
        else:
            self.turns.append((turn, role, written, n))
            self.sum += n
            if self.sum > 4 * self.budget:
                yield from self._emit(False)

    def finish(self):
        return list(self._emit(True))

    def _emit(self, last):
        if not self.turns:
            return
        # the conversation's own first turn leads later windows; the first window holds it itself
        own_system = None
        if self.fresh and self.system is None and not self.before and self.turns[0][1] == "system":
            own_system = (self.turns[0][2], self.turns[0][3])
        tokens = [t[3] for t in self.turns]
        before = [b[2] for b in self.before]
        lead = self.system
        done = 0
        while done < len(self.turns):
            start, stop, back = next(spans(tokens[done:], lead[1] if lead else 0, self.budget, self.history, before))
            if not last and done + stop >= len(self.turns):
                break
            span = self.turns[done : done + stop]
            repeated = self.before[len(self.before) - back :] if back else []
            text, loss, count = [], [], 0
            at = 0
            if lead:
                text.append(lead[0][0])
                at += len(lead[0][0])
                count += lead[1]
            for _, w, n in repeated:
                text.append(w[0])
                at += len(w[0])
                count += n
            for _, role, w, n in span:
                if role == "assistant":
                    loss.append({"start": at + w[1], "stop": at + w[2]})
                text.append(w[0])
                at += len(w[0])
                count += n
            yield (*self.key, self.window, span[0][0], len(span), len(repeated), bool(lead), count, "".join(text), loss)
            self.window += 1
            self.fresh = False
            if own_system is not None:
                self.system = lead = own_system
                own_system, skip = None, 1
            else:
                skip = 0
            past = [(r, w, n) for _, r, w, n in span][skip:]
            self.before = [*self.before, *past][-self.history :] if self.history else []
            before = [b[2] for b in self.before]
            done += stop
        self.turns = self.turns[done:]
        self.sum = sum(t[3] for t in self.turns)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, read back from its windows' text alone: repeated turns are skipped,
    escapes undone. A digest chains over a conversation's turns; rows pass as a stream in their order."""
    ordered = formatted.select("conv_id", "stretch", "window", "n_turns", "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "window")

    def step(batches):
        state, out = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state is not None:
                        out.append(closed(state))
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                state[5] += len(text)
                for role, x, _, _ in list(read_turns(text))[-row["n_turns"] :]:
                    state[1] += 1
                    state[2].update(f"{role}\n{x}\n".encode("utf-8", "surrogatepass"))
                for s in row["loss_spans"]:
                    x = unescape(text[s["start"] : s["stop"]])
                    state[3] += len(x)
                    state[4].update(x.encode("utf-8", "surrogatepass"))
            if len(out) > 10_000:
                yield batched(out)
                out = []
        if state is not None:
            yield batched([*out, closed(state)])

    def closed(s):
        return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

    def batched(rows):
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return common.map_arrow(ordered, step, DIGEST)
