"""Column functions on text: normal form, white-space flags, tokens, n-grams and keys. Only token_distance() leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as white space at a line's end, and the word pattern.
TRAILING_SPACE = r"(?U)[\s\x1c-\x1f]+\z"
WORD = r"[A-Za-z_$][A-Za-z0-9_$]*"
TAB_WIDTH = 4


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unify_newlines(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"\r\n?", "\n")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is named, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def expand_tabs(line: Column, width: int = TAB_WIDTH) -> Column:
    """Each tab filled up to the next column that `width` divides."""
    fill = lambda done, piece: F.concat(done, F.repeat(F.lit(" "), F.lit(width) - F.length(done) % width), piece)
    spread = bind(F.split(line, "\t"), lambda p: F.aggregate(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.get(p, F.lit(0)), fill))
    return F.when(line.contains("\t"), spread).otherwise(line)


def indent_of(line: Column) -> Column:
    """Number of leading spaces."""
    return F.length(line) - F.length(F.ltrim(line))


def outdent(lines: Column, by: Column) -> Column:
    """Up to so many leading spaces less on each line."""
    return F.transform(lines, lambda x: F.substring(x, F.least(by, indent_of(x)) + 1, F.length(x)))


def normalize(text: Column | str) -> Column:
    """One normal form of layout: LF only, tabs expanded, no space at line ends, no blank lines at either
    end, common indentation removed, and a first line that starts at column 0. Nulls stay null. What a line
    needs to know of the whole text is bound before the lines are gone through, so time follows the length."""

    def filled(lines: Column) -> Column:
        at = F.transform(lines, lambda x, i: F.when(F.length(x) > 0, i))
        indents = F.transform(lines, lambda x: F.when(F.length(x) > 0, indent_of(x)))
        return F.struct(lines.alias("lines"), F.array_min(at).alias("first"), F.array_max(at).alias("last"), F.coalesce(F.array_min(indents), F.lit(0)).alias("common"))

    def within(s: Column) -> Column:
        some = F.slice(s["lines"], s["first"] + 1, s["last"] - s["first"] + 1)
        return F.when(s["first"].isNotNull(), outdent(some, s["common"])).otherwise(F.array().cast("array<string>"))

    lines = F.transform(F.split(unify_newlines(text), "\n"), lambda x: F.regexp_replace(expand_tabs(x), TRAILING_SPACE, ""))
    inner = bind(bind(lines, filled), within)
    shifted = bind(bind(inner, lambda l: F.struct(l.alias("lines"), F.coalesce(indent_of(F.get(l, F.lit(0))), F.lit(0)).alias("by"))), lambda s: outdent(s["lines"], s["by"]))
    return F.when(col(text).isNotNull(), F.array_join(shifted, "\n"))


def non_empty(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose text is neither null nor white space alone."""
    return rows.where(F.col(text).isNotNull() & F.col(text).rlike(r"(?U)[^\s\x1c-\x1f]"))


def whitespace_flags(text: Column | str) -> dict[str, Column]:
    """Four 0/1 flags: starts with space or tab, ends with LF, holds a tab, holds a CR."""
    t = col(text)
    return {
        "leading_space": (t.startswith(" ") | t.startswith("\t")).cast("bigint"),
        "final_newline": t.endswith("\n").cast("bigint"),
        "has_tab": t.contains("\t").cast("bigint"),
        "has_cr": t.contains("\r").cast("bigint"),
    }


def line_count(text: Column | str) -> Column:
    return (F.regexp_count(col(text), F.lit("\n")) + 1).cast("bigint")


def content_key(text: Column | str) -> Column:
    return F.substring(F.sha1(col(text)), 1, 12)


def words(text: Column | str) -> Column:
    """Identifier-like words of the raw text, in order, repeats included."""
    return F.regexp_extract_all(col(text), F.lit(WORD), F.lit(0))


def squeeze_spaces(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"\s\s+", " ")


def char_ngrams(text: Column | str, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams of each size, runs of white space squeezed first. Characters are told apart once, so
    time follows the length."""

    def of(chars: Column, n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        grams = F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
        return F.when(F.size(chars) >= n, grams).otherwise(F.array().cast("array<string>"))

    chars = F.regexp_extract_all(squeeze_spaces(text), F.lit("(?s)."), F.lit(0))
    return bind(chars, lambda c: F.flatten(F.array(*[of(c, n) for n in sizes])))


def category_slug(label: Column | str, slugs: dict[str, str], default: str = "other") -> Column:
    pairs = [F.lit(x) for pair in slugs.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(label)), F.lit(default))


def strip_annotation_lines(source: Column | str) -> Column:
    """The source without lines that begin with @, trimmed."""
    kept = F.filter(F.split(col(source), "\n"), lambda line: ~F.trim(line).startswith("@"))
    return F.trim(F.array_join(kept, "\n"))


def is_test_path(path: Column | str) -> Column:
    """A Java file in a test folder or named like a test."""
    p = col(path)
    name = F.regexp_extract(p, r"([^/]*)\.java$", 1)
    folder = F.concat(F.lit("/"), p).rlike(r"(?i)/(test|tests|androidtest)/")
    return p.endswith(".java") & (folder | name.rlike(r"(Test|Tests|TestCase|IT|ITCase)$|^Test"))


def is_test_method(name: Column | str, source: Column | str, in_corpus: Column) -> Column:
    last = F.element_at(F.split(col(name), r"\."), -1)
    return in_corpus | F.lower(last).startswith("test") | col(source).contains("@Test")


#: First code points of the private-use areas, which stand for tokens in token_distance().
PRIVATE, PRIVATE_SIZE, FURTHER = 0xE000, 6400, 0xF0000


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance between two arrays of tokens: each distinct token of the pair becomes one
    private-use character, in Arrow batches, and the built-in distance of strings does the rest."""

    @F.pandas_udf("struct<a:string,b:string>")
    def coded(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        def pair(x, y):
            at: dict[str, int] = {}
            chars = [[at.setdefault(t, len(at)) for t in side] for side in (x, y)]
            return ["".join(chr(k + PRIVATE if k < PRIVATE_SIZE else k - PRIVATE_SIZE + FURTHER) for k in side) for side in chars]

        return pd.DataFrame([pair(x, y) if x is not None and y is not None else [None, None] for x, y in zip(left, right, strict=True)], columns=["a", "b"])

    both = coded(a, b)
    return F.levenshtein(both["a"], both["b"])


def bag_distance(a: Column, b: Column) -> Column:
    """Size of the symmetric difference of two arrays as multisets: a sum over the runs of equal tokens of
    both arrays put together and sorted."""
    side = lambda tokens, d: F.transform(tokens, lambda x: F.struct(x.alias("t"), F.lit(d).alias("d")))
    state = lambda last, run, total: F.struct(last.alias("last"), run.alias("run"), total.alias("total"))

    def step(s: Column, x: Column) -> Column:
        same = s["last"] == x["t"]
        return state(x["t"], F.when(same, s["run"] + x["d"]).otherwise(x["d"]), s["total"] + F.when(same, 0).otherwise(F.abs(s["run"])))

    start = state(F.lit(None).cast("string"), F.lit(0), F.lit(0))
    return F.aggregate(F.array_sort(F.concat(side(a, -1), side(b, 1))), start, step, lambda s: s["total"] + F.abs(s["run"]))


def edit_distance(a: Column, b: Column, most: int = 3000) -> tuple[Column, Column]:
    """(distance, whether it is the approximation by bags that long inputs get)."""
    long = (F.size(a) > most) | (F.size(b) > most)
    return F.when(long, bag_distance(a, b)).otherwise(token_distance(a, b)).cast("bigint"), long
