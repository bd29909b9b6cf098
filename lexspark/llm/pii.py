"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Kinds: email, ip, card and phone are the base ones; a proposal counts if it passes the kind's check (parts
of at most 255; Luhn and 14 to 19 digits; 10 to 15 digits), whatever its score. The further kinds iban
(mod-97), ssn and local phone (both confirmed by context) are added only where they overlap no base span
and their score reaches THRESHOLD. A score starts at the kind's prior; a context word of the kind within
CONTEXT characters before or after adds WITH, a word that speaks against it takes AGAINST away; checksums
have their say first.

Offsets are code points, end exclusive. Null texts are empty texts and have no spans; repeated rows are
handled each on its own; an empty table gives an empty result. Very long runs of digits or letters take
linear time, as proposals start at an '@' or at a digit only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lexspark.llm import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
THRESHOLD, CONTEXT, WITH, AGAINST = 0.6, 40, 0.35, 0.3

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only begin where a run of digits does: it takes runs whole.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")

#: kind: (prior score, words for, words against)
_CONTEXT = {
    "email": (0.9, "mail contact write reply address", "example"),
    "ip": (0.6, "ip host server address login", "version release section chapter"),
    "card": (0.8, "card visa credit debit payment", "order invoice tracking isbn"),
    "phone": (0.8, "phone call tel mobile fax telefon telefono", "order invoice"),
    "iban": (0.8, "iban account bank konto compte cuenta transfer", "order part serial"),
    "ssn": (0.4, "ssn social security", "part serial order model"),
    "local_phone": (0.4, "phone call tel mobile fax contact telefon", "order invoice serial isbn"),
}
_WORDS = {k: (re.compile(rf"\b(?:{'|'.join(a.split())})", re.I), re.compile(rf"\b(?:{'|'.join(b.split())})", re.I)) for k, (_, a, b) in _CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i & 1:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(text: str) -> bool:
    bare = text.replace(" ", "")
    if not 15 <= len(bare) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


#: Lengths of account numbers by country; other countries' may have any length from 15 to 34.
IBAN_LENGTHS = dict(AT=20, BE=16, CH=21, CZ=24, DE=22, DK=18, ES=24, FI=18, FR=27, GB=22, GR=27, HU=28, IE=22, IT=27, LU=20, NL=18, NO=15, PL=28, PT=25, SE=24)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of each proposal the longest beginning that ends with a word, has its country's length and passes: the
    words behind an account number may look like parts of it."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 2
        for end in range(m.end(), m.start() + 14, -1):
            if text[end - 1] != " " and not (end < len(text) and text[end].isascii() and text[end].isalnum()):
                own = m[0][: end - m.start()]
                if len(own.replace(" ", "")) == IBAN_LENGTHS.get(own[:2], len(own.replace(" ", ""))) and mod97(own):
                    yield m.start(), end
                    at = end
                    break


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()


def score(kind: str, text: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT]}"
    own, other = _WORDS[kind]
    return round(min(1.0, max(0.0, _CONTEXT[kind][0] + WITH * bool(own.search(near)) - AGAINST * bool(other.search(near)))), 2)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by start and then by kind as listed in KINDS."""
    if not text:
        return []
    found = [(k, a, b, score(k, text, a, b)) for k, a, b in _base(text)]
    if _DIGIT.search(text):
        further = [("iban", *x) for x in _ibans(text)] + [(kind, *m.span()) for kind, pattern in (("ssn", _SSN), ("local_phone", _LOCAL_PHONE)) for m in pattern.finditer(text)]
        for kind, a, b in further:
            if not any(a < y and x < b for _, x, y, _ in found) and (s := score(kind, text, a, b)) >= THRESHOLD:
                found.append((kind, a, b, s))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def digest(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def redact(text: str, spans: list[tuple]) -> str:
    """Each run of overlapping spans replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b, *_ in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect(docs: DataFrame, *, text_col: str = "text", carry: list[str] | None = None, redacted: bool = False) -> DataFrame:
    """The documents' columns (or those of `carry`) and `pii`, the spans; with `redacted`, the text column
    holds the redacted text. A column `pii` of the input gives way to the new one."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != "pii"]

    def step(batches):
        for batch in common.slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            found = [find(t) for t in texts]
            pii = pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in f] for f in found], _TYPE)
            if redacted:
                texts = pa.array([redact(t, f) if f else t for t, f in zip(texts, found, strict=True)], batch.schema.field(text_col).type)
            yield pa.RecordBatch.from_arrays([pii if c == "pii" else texts if redacted and c == text_col else batch.column(c) for c in kept], names=kept)

    kept = [*carry, "pii"]
    narrow = docs.select(*dict.fromkeys([*carry, text_col]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.select(*carry).schema.fields) + f", pii {SPANS}"
    return common.map_arrow(narrow, step, schema)


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts of the base kinds, sha256 of the base spans' list, all spans."""

    def step(batches):
        for batch in common.slices(batches, text_col):
            rows = []
            for text in batch.column(text_col).to_pylist():
                spans = find(text)
                base = [s for s in spans if s[0] in BASE]
                rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4]), pa.array(columns[5])], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    narrow = docs.select(id_col, text_col)
    return common.map_arrow(narrow, step, f"doc_id {narrow.schema[id_col].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
