"""Vocabularies: frequencies, mutual information, cue lists, and renaming by an audited bijection."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as T

EPSILON = 1e-12


def corpus_frequency(docs: DataFrame, tokens: Column) -> DataFrame:
    return docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").cast("bigint").alias("n"))


def document_frequency(docs: DataFrame, tokens: Column, at_least: int = 1) -> DataFrame:
    """(token, df); a document's tokens are made distinct before anything is shuffled."""
    found = docs.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").cast("bigint").alias("df"))
    return found.where(F.col("df") >= at_least)


def _information(n: Column, n1: Column, df: Column, df1: Column) -> Column:
    """Mutual information of a token's presence and a 0/1 label, natural logarithm: n rows, n1 of label 1, df
    rows with the token, df1 of these of label 1."""
    n, n1, df, df1 = (c.cast("double") for c in (n, n1, df, df1))

    def cell(together, t, y):
        return together / n * F.log((together / n + EPSILON) / (t / n * (y / n) + EPSILON))

    return cell(df1, df, n1) + cell(df - df1, df, n - n1) + cell(n1 - df1, n - df, n1) + cell(n - n1 - df + df1, n - df, n - n1)


def mutual_information(docs: DataFrame, tokens: Column, label: str, at_least: int = 3) -> DataFrame:
    """(token, df, mi). Empty if there is one class only. The two totals ride along as a one-row cross join."""
    totals = docs.agg(F.count("*").alias("n"), F.sum(label).alias("n1"))
    seen = docs.select(F.col(label).alias("y"), F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"), F.sum("y").alias("df1")).where(F.col("df") >= at_least)
    joined = seen.crossJoin(F.broadcast(totals)).where("n1 > 0 and n1 < n")
    return joined.select("token", F.col("df").cast("bigint").alias("df"), _information(F.col("n"), F.col("n1"), F.col("df"), F.col("df1")).alias("mi"))


def mutual_information_by_fold(docs: DataFrame, tokens: Column, label: str, fold: str, at_least: int = 3) -> DataFrame:
    """(fold, token, df, mi): for each fold over its training rows, those of all other folds. Texts are read
    once: a fold's training counts are all counts less its own."""
    own = docs.select(F.col(fold).alias("fold"), F.col(label).alias("y"), F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token", "fold").agg(F.count("*").alias("df"), F.sum("y").alias("df1"))
    every = own.groupBy("token").agg(F.sum("df").alias("all"), F.sum("df1").alias("all1"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("df", "df1").alias("c")))).alias("by_fold"))
    sizes = docs.groupBy(F.col(fold).alias("fold")).agg(F.count("*").alias("m"), F.sum(label).alias("m1"))
    totals = sizes.agg(F.sum("m").alias("n"), F.sum("m1").alias("n1"))
    folds = sizes.crossJoin(totals).select("fold", (F.col("n") - F.col("m")).alias("n"), (F.col("n1") - F.col("m1")).alias("n1"))
    each = every.crossJoin(F.broadcast(folds)).withColumn("c", F.try_element_at("by_fold", "fold"))  # folds are few
    counted = each.select("fold", "token", "n", "n1", (F.col("all") - F.coalesce("c.df", F.lit(0))).alias("df"), (F.col("all1") - F.coalesce("c.df1", F.lit(0))).alias("df1"))
    usable = counted.where((F.col("df") >= at_least) & (F.col("n1") > 0) & (F.col("n1") < F.col("n")))
    return usable.select("fold", "token", F.col("df").cast("bigint").alias("df"), _information(F.col("n"), F.col("n1"), F.col("df"), F.col("df1")).alias("mi"))


def top_tokens(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("mi"), "token").limit(k)


def expand_entries(entries: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(tag, priority, token): `x*` stands for x and all identifiers that begin with it, `A.b` for A and b."""
    starred = entries.where(F.col("entry").endswith("*")).withColumn("stem", F.expr("substring(entry, 1, length(entry) - 1)"))
    plain = entries.where(~F.col("entry").endswith("*")).select("tag", "priority", F.explode(F.split("entry", r"\.")).alias("token"))
    # stems are few; equal first characters make this an equi-join instead of a nested loop
    probes = starred.withColumn("c", F.substring("stem", 1, 1)).join(identifiers.withColumn("c", F.substring("token", 1, 1)), "c").where(F.col("token").startswith(F.col("stem"))).select("tag", "priority", "token")
    return plain.union(starred.select("tag", "priority", F.col("stem").alias("token"))).union(probes).where("token <> ''").distinct()


def disjoint_tags(cues: DataFrame) -> DataFrame:
    """Each token under its tag of highest priority (least number)."""
    return cues.groupBy("token").agg(F.min_by("tag", F.struct("priority", "tag")).alias("tag"))


def present(cues: DataFrame, identifiers: DataFrame) -> DataFrame:
    return cues.join(identifiers.select("token").distinct(), "token", "left_semi")


#: The reserved words of Java, contextual ones included, and literals.
JAVA_KEYWORDS = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null record var yield sealed permits".split())


def base36(n: int) -> str:
    digits = "abcdefghijklmnopqrstuvwxyz0123456789"
    out = digits[n % 36]
    while n := n // 36:
        out = digits[n % 36] + out
    return out


#: Styles of case, the first that fits counts: constants, short constants, types, all else.
STYLES = (
    (re.compile(r"[A-Z](?=.*_)[A-Z0-9_$]*"), lambda code: f"CUE_{code.upper()}"),
    (re.compile(r"[A-Z][A-Z0-9_$]{0,2}"), lambda code: f"CUE{code.upper()}"),
    (re.compile(r"[A-Z].*", re.S), lambda code: f"Sym{code.capitalize()}"),
    (re.compile(r".*", re.S), lambda code: f"sym{code.capitalize()}"),
)


def neutral_names(token: str, start: int) -> Iterator[str]:
    """Meaningless names in the token's style of case, without end."""
    style = next(named for pattern, named in STYLES if pattern.fullmatch(token))
    return (style(base36(n)) for n in itertools.count(start))


def rename_map(cues: list[str], corpus: set[str], curated: dict[str, str] | None = None) -> dict[str, str]:
    """An injective map over sorted cues; each choice depends on those before, so this small vocabulary is
    folded on the driver. Keywords are left out. A cue gets its curated name, or one of its style counted
    from the map's size on: the first that isn't the cue, a keyword, or in the corpus or the map."""
    own = {c: (curated or {}).get(c) for c in sorted(set(cues)) if c not in JAVA_KEYWORDS and re.fullmatch(T.WORD, c)}
    barred = corpus | JAVA_KEYWORDS
    out: dict[str, str] = {}
    taken: set[str] = set()
    for cue, wish in own.items():
        names = itertools.chain([wish] if wish else [], neutral_names(cue, len(out)))
        out[cue] = next(n for n in names if n != cue and n not in barred and n not in taken)
        taken.add(out[cue])
    return out


def barred_names(identifiers: DataFrame, cues: list[str], curated: dict[str, str] | None = None) -> set[str]:
    """Of a corpus' identifiers (column token) those that a rename map over the cues could hit: curated names,
    and names in the styles that it makes up. Only these few come to the driver."""
    curated_names = [v for c in cues if (v := (curated or {}).get(c))]
    made_up = F.col("token").rlike(r"^(CUE_?[A-Z0-9]+|[sS]ym[A-Z0-9][a-z0-9]*)$")
    wanted = made_up | F.col("token").isin(curated_names) if curated_names else made_up
    return {r.token for r in identifiers.where(wanted).select("token").distinct().collect()}


def invert(mapping: dict[str, str]) -> dict[str, str]:
    if len(set(mapping.values())) != len(mapping):
        raise ValueError("the map isn't injective")
    return {v: k for k, v in mapping.items()}


def not_injective(mapping: DataFrame) -> DataFrame:
    """(new_token, n) of names that several tokens get."""
    return mapping.groupBy("new_token").agg(F.count("*").cast("bigint").alias("n")).where("n > 1")


def collisions(mapping: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(new_token) of names that stand in the corpus already: none, for a sound map."""
    return mapping.select("new_token").distinct().join(identifiers.select(F.col("token").alias("new_token")).distinct(), "new_token", "left_semi")


def top_replacements(counts: DataFrame, k: int = 25) -> DataFrame:
    """The k most frequent replacements (old_token, new_token, n), by number and then both names, descending."""
    return counts.orderBy(F.desc("n"), F.desc("old_token"), F.desc("new_token")).limit(k)


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]) if mapping else F.create_map().cast("map<string,string>")


def rename_words(text: Column | str, mapping: dict[str, str]) -> Column:
    """The text with whole words replaced; the parts between words are kept as they are."""
    t = T.col(text)
    parts = F.regexp_extract_all(t, F.lit(rf"{T.WORD}|[^A-Za-z_$]+"), F.lit(0))
    named = literal_map(mapping)
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(named, p), p)), "")


def rename_stats(text: Column | str, mapping: dict[str, str]) -> dict[str, Column]:
    before, after = T.words(text), T.words(rename_words(text, mapping))
    keys = F.array(*[F.lit(k) for k in mapping]) if mapping else F.array().cast("array<string>")
    return {"n_before": F.size(before).cast("bigint"), "n_after": F.size(after).cast("bigint"), "n_replaced": F.size(F.filter(before, lambda w: F.array_contains(keys, w))).cast("bigint")}


def multiset_delta(pairs: DataFrame, key: list[str], before: Column, after: Column) -> DataFrame:
    """(key, token, added, removed): how many more of each token stand on either side."""
    sides = pairs.select(*key, F.explode(F.transform(before, lambda t: F.struct(t.alias("token"), F.lit(-1).alias("d")))).alias("x")).unionAll(pairs.select(*key, F.explode(F.transform(after, lambda t: F.struct(t.alias("token"), F.lit(1).alias("d")))).alias("x")))
    net = sides.groupBy(*key, F.col("x.token").alias("token")).agg(F.sum("x.d").alias("d"))
    return net.where("d <> 0").select(*key, "token", F.greatest("d", F.lit(0)).cast("bigint").alias("added"), F.greatest(-F.col("d"), F.lit(0)).cast("bigint").alias("removed"))
