"""The engine's operators as queries over the driver's tables, each with its SQL where SQL can express it.

Stand-ins: text is code, source is the project, lang the category, `quality = 0` the target, `toxic` a second
property; an embedding's elements are eight layers of eight.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import corpus, decide, features, learn, metrics, pairs, sampling, vocabulary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: SQL of the labelled corpus, for the oracles.
LABELLED = "labelled AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(l.quality = 0 AS BIGINT) AS y, CAST(l.toxic AS BIGINT) AS toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
WORDS = "regexp_extract_all({}, '[A-Za-z_$][A-Za-z0-9_$]*')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents with labels; only the columns that a query needs are read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *columns)
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).cast("bigint").alias("y"), F.col("toxic").cast("bigint").alias("toxic"))
    return docs.join(labels, "doc_id")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# ---- corpus preparation


@query(f"""WITH {LABELLED}, top AS (
  SELECT t.token, t.df, t.df1, n.n, n.n1 FROM (
    SELECT token, count(*) AS df, sum(y) AS df1 FROM (SELECT doc_id, y, unnest(list_distinct({WORDS.format('text')})) AS token FROM labelled) GROUP BY token HAVING count(*) >= 3) t,
    (SELECT count(*) AS n, sum(y) AS n1 FROM labelled) n WHERE n.n1 > 0 AND n.n1 < n.n), mi AS (
  SELECT token, CAST(df AS BIGINT) AS df,
    df1/n*ln((df1/n+1e-12)/((df/n)*(n1/n)+1e-12)) + (df-df1)/n*ln(((df-df1)/n+1e-12)/((df/n)*((n-n1)/n)+1e-12))
    + (n1-df1)/n*ln(((n1-df1)/n+1e-12)/(((n-df)/n)*(n1/n)+1e-12)) + (n-n1-df+df1)/n*ln(((n-n1-df+df1)/n+1e-12)/(((n-df)/n)*((n-n1)/n)+1e-12)) AS mi
  FROM (SELECT token, CAST(df AS DOUBLE) AS df, CAST(df1 AS DOUBLE) AS df1, CAST(n AS DOUBLE) AS n, CAST(n1 AS DOUBLE) AS n1 FROM top))
SELECT token, df, round(mi, 6) AS mi FROM mi ORDER BY round(mi, 9) DESC, token LIMIT 200""")
def mutual_information_topk(spark, sf_dir):
    scored = vocabulary.mutual_information(labelled(spark, sf_dir, "text"), T.words("text"), "y")
    top = vocabulary.top_tokens(scored.withColumn("mi", F.round("mi", 9)), 200)
    return top.withColumn("mi", r6("mi"))


@query(f"WITH {LABELLED} SELECT concat(lang, ':', CAST(n_chars // 500 AS VARCHAR)) AS key, count(DISTINCT y) AS n_labels, count(*) AS n_rows FROM labelled GROUP BY 1 HAVING count(DISTINCT y) > 1")
def label_conflict_keys(spark, sf_dir):
    rows = labelled(spark, sf_dir, "lang", "n_chars").withColumn("k", F.concat("lang", F.lit(":"), F.floor(F.col("n_chars") / 500).cast("string")))
    return corpus.conflicting_keys(rows, "k", "y")


_LENGTH_KEY = "length(text) // 40"


@query(f"WITH {LABELLED}, k AS (SELECT *, {_LENGTH_KEY} AS k FROM labelled) SELECT doc_id FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(DISTINCT y) > 1)")
def conflict_semi(spark, sf_dir):
    rows = labelled(spark, sf_dir, "text").withColumn("k", F.floor(F.length("text") / 40))
    return corpus.only_conflicts(rows, "k", "y").select("doc_id")


@query(f"WITH {LABELLED}, k AS (SELECT *, {_LENGTH_KEY} AS k FROM labelled) SELECT doc_id FROM k WHERE k NOT IN (SELECT k FROM k GROUP BY k HAVING count(DISTINCT y) > 1)")
def conflict_anti(spark, sf_dir):
    rows = labelled(spark, sf_dir, "text").withColumn("k", F.floor(F.length("text") / 40))
    return corpus.drop_conflicts(rows, "k", "y").select("doc_id")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # a 128-bit key instead of the text itself keeps the shuffle narrow
    keyed = docs.select("doc_id", "lang", "source", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2"))
    return corpus.keep_first(keyed, ["h1", "h2"], ["doc_id"]).select("doc_id", "lang", "source")


@query("SELECT CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_repeated_keys, CAST(sum(n - 1) AS BIGINT) AS n_extra_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def duplicate_counts(spark, sf_dir):
    return corpus.duplicate_count(table(spark, sf_dir, "documents").select(F.md5("text").alias("k")), "k")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def frequency_table(spark, sf_dir):
    return corpus.frequency(table(spark, sf_dir, "documents"), "source", "lang")


_FLAGS = "CAST(html LIKE ' %' OR html LIKE chr(9) || '%' AS BIGINT) AS leading_space, CAST(html LIKE '%' || chr(10) AS BIGINT) AS final_newline, CAST(contains(html, chr(9)) AS BIGINT) AS has_tab, CAST(contains(html, chr(13)) AS BIGINT) AS has_cr"


@query(f"SELECT page_id, {_FLAGS} FROM pages")
def whitespace_flags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in T.whitespace_flags("html").items()])


@query(f"WITH {LABELLED}, f AS (SELECT y, {_FLAGS.replace('html', 'text')}, CAST(contains(text, chr(10)) AS BIGINT) AS has_lf FROM labelled) SELECT y, count(*) AS n, round(avg(leading_space), 6) AS leading_space_rate, round(avg(final_newline), 6) AS final_newline_rate, round(avg(has_lf), 6) AS has_lf_rate FROM f GROUP BY y")
def whitespace_rates_by_class(spark, sf_dir):
    flags = T.whitespace_flags("text") | {"has_lf": F.col("text").contains("\n").cast("bigint")}
    rows = labelled(spark, sf_dir, "text").select("y", *[c.alias(n) for n, c in flags.items()])
    return corpus.rates(rows, ["leading_space", "final_newline", "has_lf"], "y")


def normal_sql(rows: str, key: str, text: str) -> str:
    """A common table expression `nf` of (key, normal): the normal form of layout in SQL."""
    spread = "CASE WHEN contains(x, chr(9)) THEN list_reduce(string_split(x, chr(9)), lambda a, p: a || repeat(' ', 4 - length(a) % 4) || p) ELSE x END"
    return f"""nl AS (SELECT {key}, list_transform(list_transform(string_split(regexp_replace({text}, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: {spread}), lambda x: regexp_replace(x, '[ \\t\\f\\v]+$', '')) AS l FROM {rows}),
 nb AS (SELECT {key}, l, list_filter(range(1, len(l) + 1), lambda i: length(l[i]) > 0) AS f FROM nl),
 ns AS (SELECT {key}, CASE WHEN len(f) > 0 THEN l[f[1]:f[-1]] ELSE CAST([] AS VARCHAR[]) END AS l FROM nb),
 nd AS (SELECT {key}, l, coalesce(list_min(list_transform(list_filter(l, lambda x: length(x) > 0), lambda x: length(x) - length(ltrim(x, ' ')))), 0) AS c FROM ns),
 ne AS (SELECT {key}, list_transform(l, lambda x: CASE WHEN length(x) > 0 THEN substr(x, c + 1) ELSE x END) AS l FROM nd),
 ng AS (SELECT {key}, l, coalesce(length(l[1]) - length(ltrim(l[1], ' ')), 0) AS k FROM ne),
 nf AS (SELECT {key}, array_to_string(list_transform(l, lambda x: substr(x, least(k, length(x) - length(ltrim(x, ' '))) + 1)), chr(10)) AS normal FROM ng)"""


#: Pages with a layout to bring into order: tabs, carriage returns and indents, by the page's number.
LAID_OUT = "SELECT page_id, chr(9) || ' ' || replace(replace(html, '><', CASE page_id % 3 WHEN 0 THEN '>' || chr(13) || chr(10) || chr(9) || '<' WHEN 1 THEN '> ' || chr(9) || chr(10) || '    <' ELSE '>' || chr(10) || '  a' || chr(9) || '<' END), ' ', CASE WHEN page_id % 2 = 0 THEN ' ' ELSE chr(9) END) AS html FROM pages"


@query(f"WITH lp AS ({LAID_OUT}), {normal_sql('lp', 'page_id', 'html')} SELECT * FROM nf")
def normalize_text(spark, sf_dir):
    pages = spark.sql(LAID_OUT.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))
    return pages.select("page_id", T.normalize("html").alias("normal"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines, substr(sha1(text), 1, 12) AS uid FROM documents")
def derived_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("n_chars"), T.line_count("text").alias("n_lines"), T.content_key("text").alias("uid"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' ELSE 'other' END AS category, CAST(lang <> 'en' AS BIGINT) AS target FROM documents")
def category_slug(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.category_slug("lang", {"en": "english", "fr": "french", "de": "german"}).alias("category"), (F.col("lang") != "en").cast("bigint").alias("target"))


@query(f"WITH {LABELLED}, m AS (SELECT median(CASE WHEN y = 1 THEN n_chars END) AS a, median(CASE WHEN y = 0 THEN n_chars END) AS b FROM labelled) SELECT round(a, 6) AS median_pos, round(b, 6) AS median_neg, round(abs(a - b) / greatest(a, b), 6) AS relative_gap FROM m")
def class_medians(spark, sf_dir):
    rows = labelled(spark, sf_dir, "n_chars")
    m = rows.agg(F.percentile(F.when(F.col("y") == 1, F.col("n_chars")), 0.5).alias("a"), F.percentile(F.when(F.col("y") == 0, F.col("n_chars")), 0.5).alias("b"))
    return m.select(r6("a").alias("median_pos"), r6("b").alias("median_neg"), r6(corpus.relative_gap(F.col("a"), F.col("b"))).alias("relative_gap"))


@query("SELECT source, round(quantile_cont(n_chars, 0.05), 6) AS p05, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM documents GROUP BY source")
def length_percentiles(spark, sf_dir):
    return corpus.exact_quantiles(table(spark, sf_dir, "documents"), "n_chars", {"p05": 0.05, "p50": 0.5, "p95": 0.95}, "source")


@query(f"WITH {LABELLED} SELECT lang, count(*) AS n, round(avg(y), 6) AS y_rate, round(avg(toxic), 6) AS toxic_rate FROM labelled GROUP BY lang")
def prevalence_by_label(spark, sf_dir):
    return corpus.rates(labelled(spark, sf_dir, "lang"), ["y", "toxic"], "lang")


@query(f"WITH {LABELLED} SELECT y, toxic, count(*) AS n FROM labelled GROUP BY ALL")
def crosstab_property(spark, sf_dir):
    return corpus.crosstab(labelled(spark, sf_dir), "y", "toxic")


@query(f"WITH {LABELLED} SELECT count(*) AS n_rows, count(DISTINCT source) AS n_projects, CAST(sum(y) AS BIGINT) AS n_pos, round(avg(y), 6) AS prior, CAST(sum(CASE WHEN y = 0 AND toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_none FROM labelled")
def class_prior(spark, sf_dir):
    rows = labelled(spark, sf_dir, "source")
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_projects"), F.sum("y").alias("n_pos"), r6(F.avg("y")).alias("prior"), F.sum(corpus.mask_none(["y", "toxic"]).cast("bigint")).alias("n_none"))


# ---- vocabulary and renaming


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({WORDS.format('text')}) AS token FROM documents) GROUP BY token")
def corpus_token_freq(spark, sf_dir):
    return vocabulary.corpus_frequency(table(spark, sf_dir, "documents"), T.words("text"))


@query(f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({WORDS.format('text')})) AS token FROM documents) GROUP BY token HAVING count(*) >= 3")
def document_freq(spark, sf_dir):
    return vocabulary.document_frequency(table(spark, sf_dir, "documents"), T.words("text"), 3)


_ENTRIES = [("attributed", 0, "the"), ("api", 1, "the.is"), ("api", 1, "tha*"), ("curated", 2, "is"), ("curated", 2, "zzz")]
_ENTRIES_SQL = "(VALUES " + ", ".join(f"('{t}', {p}, '{e}')" for t, p, e in _ENTRIES) + ") AS e(tag, priority, entry)"
_IDENTS = f"idents AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS token FROM documents)"
_EXPANDED = f"""expanded AS (SELECT DISTINCT * FROM (
  SELECT tag, priority, unnest(string_split(entry, '.')) AS token FROM {_ENTRIES_SQL} WHERE entry NOT LIKE '%*'
  UNION ALL SELECT tag, priority, rtrim(entry, '*') FROM {_ENTRIES_SQL} WHERE entry LIKE '%*'
  UNION ALL SELECT tag, priority, token FROM {_ENTRIES_SQL}, idents WHERE entry LIKE '%*' AND starts_with(token, rtrim(entry, '*'))) WHERE token <> '')"""


def _cues(spark, sf_dir):
    entries = values(spark, _ENTRIES, "tag string, priority int, entry string")
    idents = table(spark, sf_dir, "documents").select(F.explode(T.words("text")).alias("token")).distinct()
    return vocabulary.expand_entries(entries, idents), idents


@query(f"WITH {_IDENTS}, {_EXPANDED} SELECT tag, CAST(priority AS BIGINT) AS priority, token FROM expanded")
def cue_prefix_expand(spark, sf_dir):
    return _cues(spark, sf_dir)[0].withColumn("priority", F.col("priority").cast("bigint"))


@query(f"WITH {_IDENTS}, {_EXPANDED} SELECT token, arg_min(tag, priority) AS tag FROM expanded GROUP BY token")
def cue_vocab_priority(spark, sf_dir):
    return vocabulary.disjoint_tags(_cues(spark, sf_dir)[0])


@query(f"WITH {_IDENTS}, {_EXPANDED} SELECT DISTINCT token FROM expanded WHERE token IN (SELECT token FROM idents)")
def cues_present(spark, sf_dir):
    cues, idents = _cues(spark, sf_dir)
    return vocabulary.present(cues.select("token").distinct(), idents)


_RENAMES = {"the": "symA", "The": "SymB", "to": "symC", "on": "symD"}
_RENAME_SQL = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _RENAMES.items()) + " ELSE x END"


@query(f"SELECT doc_id, sha1(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*|[^A-Za-z_$]+'), lambda x: {_RENAME_SQL}), '')) AS renamed_sha1 FROM documents")
def rename_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(vocabulary.rename_words("text", _RENAMES)).alias("renamed_sha1"))


@query(f"WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents) SELECT doc_id, CAST(len(w) AS BIGINT) AS n_before, CAST(len(w) AS BIGINT) AS n_after, CAST(len(list_filter(w, lambda x: x IN ({', '.join(repr(k) for k in _RENAMES)}))) AS BIGINT) AS n_replaced FROM w")
def rename_stats(spark, sf_dir):
    stats = vocabulary.rename_stats("text", _RENAMES)
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in stats.items()])


_BAD_MAP = [("a", "x"), ("b", "y"), ("c", "x"), ("d", "z"), ("e", "x")]


@query("SELECT new_token, count(*) AS n FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _BAD_MAP) + ") AS m(old_token, new_token) GROUP BY new_token HAVING count(*) > 1")
def rename_inverse_check(spark, sf_dir):
    return vocabulary.not_injective(values(spark, _BAD_MAP, "old_token string, new_token string"))


# ---- samples, folds and matching


def _md5(seed, key="doc_id"):
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


@query(f"WITH {LABELLED} SELECT doc_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {_md5(0)}, doc_id) - 1) % 5 AS BIGINT) AS fold FROM labelled")
def folds_within(spark, sf_dir):
    return sampling.within_folds(labelled(spark, sf_dir), "doc_id", "y").select("doc_id", "y", "fold")


@query()
def folds_cross_group(spark, sf_dir):
    return sampling.cross_folds(labelled(spark, sf_dir, "source"), "source", "y").select("doc_id", "source", "y", "fold")


@query(f"WITH {LABELLED}, r AS (SELECT doc_id, row_number() OVER (ORDER BY {_md5(991)}, doc_id) AS r FROM labelled) SELECT doc_id, CAST(r <= (SELECT sum(y) FROM labelled) AS BIGINT) AS control FROM r")
def control_labels(spark, sf_dir):
    return sampling.control_labels(labelled(spark, sf_dir), "doc_id", "y").select("doc_id", "control")


_STRATA = [("y_pos", "y = 1"), ("toxic_pos", "toxic = 1"), ("none", "y = 0 AND toxic = 0"), ("both", "y = 1 AND toxic = 1")]
_STRATA_SQL = " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, '{n}' AS stratum FROM labelled WHERE {c}" for i, (n, c) in enumerate(_STRATA))


@query(f"""WITH {LABELLED}, s AS ({_STRATA_SQL}), d AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY {_md5(0)}, doc_id) AS r FROM s),
 f AS (SELECT doc_id, arg_min(stratum, ord) AS stratum FROM d WHERE r <= 10 GROUP BY doc_id),
 g AS (SELECT doc_id, row_number() OVER (ORDER BY {_md5(0)}, doc_id) AS r FROM labelled WHERE doc_id NOT IN (SELECT doc_id FROM f))
SELECT doc_id, stratum FROM f UNION ALL SELECT doc_id, 'fill' FROM g WHERE r <= 40 - (SELECT count(*) FROM f)""")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(labelled(spark, sf_dir), "doc_id", [(n, F.expr(c)) for n, c in _STRATA], 40)


@query(f"""WITH {LABELLED}, t AS (SELECT source FROM labelled GROUP BY source ORDER BY sum(y) DESC, source LIMIT 3),
 o AS (SELECT doc_id, lang, y, row_number() OVER (PARTITION BY source, y ORDER BY CASE WHEN y = 1 THEN lpad(CAST(doc_id AS VARCHAR), 20, '0') ELSE {_md5(0)} END, doc_id) AS r FROM labelled WHERE source IN (SELECT source FROM t)),
 d AS (SELECT doc_id, lang FROM o WHERE r <= CASE WHEN y = 1 THEN 2 ELSE 5 END),
 m AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM labelled WHERE lang NOT IN (SELECT lang FROM d))
SELECT doc_id, lang FROM d UNION ALL SELECT doc_id, lang FROM m WHERE r <= 3""")
def smoke_subset(spark, sf_dir):
    return sampling.smoke_subset(labelled(spark, sf_dir, "source", "lang"), "doc_id", "source", "y", "lang", groups=3, positives=2, negatives=5)


_CANDIDATES = f"""WITH {LABELLED}, x AS (SELECT doc_id, source, y, CAST(len({WORDS.format('text')}) AS BIGINT) AS n FROM labelled)
SELECT a.doc_id AS pos, b.doc_id AS neg, abs(a.n - b.n) AS gap, CAST(a.source = b.source AS BIGINT) AS same_group FROM x a, x b WHERE a.y = 1 AND b.y = 0 AND a.n > 0 AND b.n > 0 AND abs(a.n - b.n) <= greatest(1.0, 0.05 * a.n)"""


def _sized(spark, sf_dir):
    return labelled(spark, sf_dir, "text", "source").select("doc_id", "source", "y", F.size(T.words("text")).cast("bigint").alias("n"))


@query(_CANDIDATES)
def length_match_candidates(spark, sf_dir):
    return sampling.match_candidates(_sized(spark, sf_dir), "doc_id", "y", "n", "source")


@query()
def length_match_assignment(spark, sf_dir):
    return sampling.match_lengths(_sized(spark, sf_dir), "doc_id", "y", "n", "source")


# ---- features

_TFIDF = f"""t AS (SELECT doc_id, unnest({WORDS.format('text')}) AS token FROM documents), tf AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY ALL),
 df AS (SELECT token, count(*) AS df FROM tf GROUP BY token HAVING count(*) >= 3), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
 w AS (SELECT doc_id, token, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (token), n),
 s AS (SELECT doc_id, sqrt(sum(w * w)) AS s FROM w GROUP BY doc_id)"""


@query(f"WITH {_TFIDF} SELECT doc_id, token, round(w / s, 6) AS weight FROM w JOIN s USING (doc_id)")
def tfidf_weights(spark, sf_dir):
    return features.tfidf(table(spark, sf_dir, "documents"), "doc_id", T.words("text")).withColumn("weight", r6("weight"))


@query(f"WITH {_TFIDF} SELECT doc_id, token, round(w / s, 6) AS weight FROM w JOIN s USING (doc_id) WHERE token NOT IN ('the', 'of', 'to', 'que', 'der')")
def tfidf_ablated(spark, sf_dir):
    cues = values(spark, [(w,) for w in ("the", "of", "to", "que", "der")], "token string")
    return features.tfidf(table(spark, sf_dir, "documents"), "doc_id", T.words("text"), without=cues).withColumn("weight", r6("weight"))


@query("""WITH b AS (SELECT doc_id, regexp_replace(text, '\\s\\s+', ' ', 'g') AS t FROM documents), g AS (SELECT doc_id, n, substr(t, CAST(i AS INTEGER), n) AS token FROM b, (VALUES (3), (4), (5)) AS s(n), LATERAL (SELECT unnest(range(1, length(t) - n + 2)) AS i))
SELECT token, count(DISTINCT doc_id) AS df FROM g GROUP BY token HAVING count(DISTINCT doc_id) >= 3""")
def char_ngram_df(spark, sf_dir):
    return vocabulary.document_frequency(table(spark, sf_dir, "documents"), T.char_ngrams("text"), 3)


@query("WITH f AS (SELECT source, avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents GROUP BY source) SELECT doc_id, round((n_chars - m) / s, 6) AS n_chars_z FROM documents JOIN f USING (source)")
def length_zscore(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("n_chars"))
    return features.zscore(rows, ["n_chars"], "source").select("doc_id", "n_chars_z")


_LONG = "v AS (SELECT vec_id, label, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


@query(f"WITH {_LONG}, f AS (SELECT i, avg(CAST(value AS DOUBLE)) AS m, stddev_pop(CAST(value AS DOUBLE)) AS s FROM v GROUP BY i) SELECT vec_id, CAST(i AS BIGINT) AS i, round((value - m) / s, 4) AS z FROM v JOIN f USING (i)")
def embedding_zscore(spark, sf_dir):
    return features.element_zscore(table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "vec_id", "embedding")


@query(f"WITH {_LONG} SELECT label, CAST(i AS BIGINT) AS i, round(avg(CAST(value AS DOUBLE)), 6) AS value FROM v GROUP BY label, i")
def mean_pool(spark, sf_dir):
    return features.mean_pool(table(spark, sf_dir, "embeddings"), "label", "embedding")


@query(f"WITH {_LONG} SELECT CAST(i // 8 AS BIGINT) AS layer, count(*) AS n, round(avg(CAST(value AS DOUBLE)), 6) AS mean_value FROM v GROUP BY 1")
def layer_slices(spark, sf_dir):
    return features.layers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8).groupBy("layer").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"))


@query(f"WITH {_LONG} SELECT count(*) AS n_values, CAST(sum(CASE WHEN abs(CAST(value AS DOUBLE)) > 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS n_clipped, round(avg(CASE WHEN abs(CAST(value AS DOUBLE)) > 0.3 THEN 1.0 ELSE 0.0 END), 6) AS clip_rate FROM v")
def fp16_clip_rate(spark, sf_dir):
    return features.clip_report(table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "embedding", 0.3)


@query("SELECT lang, round(avg(CASE WHEN n_chars > 3000 THEN 1.0 ELSE 0.0 END), 6) AS truncation_rate, round(median(n_chars), 6) AS median_length, round(quantile_cont(n_chars, 0.95), 6) AS p95_length FROM documents GROUP BY lang")
def truncation_rate(spark, sf_dir):
    return features.truncation(table(spark, sf_dir, "documents"), "n_chars", 3000, "lang")


# ---- metrics


def _ap_sql(rows: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    over = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""lv AS (SELECT {k}s, CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS c FROM {rows} GROUP BY {k}s), st AS (SELECT {k}p, c, sum(p) OVER ({over}ORDER BY s DESC) AS tp, sum(c) OVER ({over}ORDER BY s DESC) AS cc, sum(p) OVER ({over}) AS np FROM lv),
 ap AS (SELECT {k}round(sum(CASE WHEN np > 0 THEN p / np * tp / cc END), 6) AS ap, CAST(sum(c) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_pos FROM st {group})"""


@query(f"WITH {LABELLED}, q AS (SELECT lang, y, n_chars // 100 AS s FROM labelled), {_ap_sql('q', 'lang')} SELECT * FROM ap")
def average_precision(spark, sf_dir):
    rows = labelled(spark, sf_dir, "lang", "n_chars").withColumn("s", F.floor(F.col("n_chars") / 100))
    return metrics.average_precision(rows, "s", "y", "lang")


@query(f"""WITH {LABELLED}, q AS (SELECT lang, y, n_chars // 100 AS s FROM labelled), r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS r FROM q)
SELECT lang, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) END AS auroc FROM r GROUP BY lang""")
def auroc_midrank(spark, sf_dir):
    rows = labelled(spark, sf_dir, "lang", "n_chars").withColumn("s", F.floor(F.col("n_chars") / 100))
    return metrics.auroc(rows, "s", "y", "lang")


_FOLDED = f"{LABELLED}, fd AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY {_md5(0)}, doc_id) - 1) % 5 AS BIGINT) AS fold, n_chars // 100 AS s FROM labelled)"


def _fold_aps(spark, sf_dir):
    rows = sampling.within_folds(labelled(spark, sf_dir, "n_chars"), "doc_id", "y").withColumn("s", F.floor(F.col("n_chars") / 100))
    return metrics.average_precision(rows, "s", "y", "fold"), metrics.average_precision(rows, "s", "toxic", "fold")


_FOLD_APS = f"{_FOLDED}, {_ap_sql('fd', 'fold')}, tx AS (SELECT fold, toxic AS y, s FROM fd), " + _ap_sql("tx", "fold").replace("lv AS", "lv2 AS").replace("FROM lv)", "FROM lv2)").replace("st AS", "st2 AS").replace("FROM st ", "FROM st2 ").replace("ap AS (SELECT", "ap2 AS (SELECT")


@query(f"WITH {_FOLD_APS} SELECT round(round(avg(ap), 10), 6) AS mean, round(round(coalesce(stddev_samp(ap), 0), 10), 6) AS std, count(*) AS n_folds FROM ap WHERE ap IS NOT NULL")
def fold_summary(spark, sf_dir):
    return metrics.fold_summary(_fold_aps(spark, sf_dir)[0], "ap")


@query(f"WITH {_FOLD_APS} SELECT round(round(avg(a.ap - b.ap), 10), 6) AS mean, round(round(coalesce(stddev_samp(a.ap - b.ap), 0), 10), 6) AS std, count(*) AS n_folds FROM ap a JOIN ap2 b USING (fold) WHERE a.ap - b.ap IS NOT NULL")
def transfer_delta(spark, sf_dir):
    own, other = _fold_aps(spark, sf_dir)
    return metrics.paired_delta(own, other, "ap", ["fold"])


@query(f"WITH {_FOLD_APS}, u AS (SELECT 'within' AS regime, ap FROM ap UNION ALL SELECT 'cross', ap FROM ap2) SELECT round(round(avg(CASE WHEN regime = 'within' THEN ap END), 10), 6) AS within_mean, round(round(avg(CASE WHEN regime = 'cross' THEN ap END), 10), 6) AS cross_mean, round(round(avg(CASE WHEN regime = 'within' THEN ap END) - avg(CASE WHEN regime = 'cross' THEN ap END), 10), 6) AS gap FROM u")
def regime_gap(spark, sf_dir):
    own, other = _fold_aps(spark, sf_dir)
    both = own.select(F.lit("within").alias("regime"), "ap").union(other.select(F.lit("cross"), "ap"))
    return metrics.gap_between(both, "ap", "regime", "within", "cross")


_LAYERED = f"{_LONG}, nr AS (SELECT vec_id, CAST(i // 8 AS BIGINT) AS layer, any_value(CAST(label = 0 AS BIGINT)) AS y, round(sum(CAST(value AS DOUBLE) * CAST(value AS DOUBLE)), 9) AS s FROM v GROUP BY vec_id, i // 8)"


def _layer_scores(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    norms = features.layers(v, "vec_id", "embedding", 8).groupBy("vec_id", "layer").agg(F.round(F.sum(F.col("value") * F.col("value")), 9).alias("s"))
    return norms.join(v.select("vec_id", (F.col("label") == 0).cast("bigint").alias("y")), "vec_id")


@query(f"WITH {_LAYERED}, ct AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY {_md5(991, 'vec_id')}, vec_id) <= (SELECT sum(CAST(label = 0 AS BIGINT)) FROM embeddings) AS BIGINT) AS c FROM embeddings), {_ap_sql('nr', 'layer')}, nc AS (SELECT nr.layer, nr.s, ct.c AS y FROM nr JOIN ct USING (vec_id)), " + _ap_sql("nc", "layer").replace("lv AS", "lv2 AS").replace("FROM lv)", "FROM lv2)").replace("st AS", "st2 AS").replace("FROM st ", "FROM st2 ").replace("ap AS (SELECT", "ap2 AS (SELECT") + " SELECT layer, ap.ap AS ap, ap2.ap AS control_ap, round(ap.ap - ap2.ap, 6) AS selectivity FROM ap JOIN ap2 USING (layer)")
def selectivity_by_layer(spark, sf_dir):
    scores = _layer_scores(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") == 0).cast("bigint").alias("y"))
    control = sampling.control_labels(labels, "vec_id", "y").select("vec_id", "control")
    own = metrics.average_precision(scores, "s", "y", "layer")
    other = metrics.average_precision(scores.join(control, "vec_id"), "s", "control", "layer").select("layer", F.col("ap").alias("control_ap"))
    return own.join(other, "layer").select("layer", "ap", "control_ap", r6(F.col("ap") - F.col("control_ap")).alias("selectivity"))


@query(f"WITH {_LAYERED}, {_ap_sql('nr', 'layer')} SELECT arg_max(layer, ap * 1000 - layer / 1e6) AS layer, max(ap) AS ap, count(*) AS n_searched FROM ap")
def argmax_layer(spark, sf_dir):
    return metrics.argmax(metrics.average_precision(_layer_scores(spark, sf_dir), "s", "y", "layer"), "layer", "ap", "layer")


_PREDICTED = f"{LABELLED}, pr AS (SELECT doc_id, y, toxic, CAST(text LIKE '%!!%' OR text LIKE '%$%' AS BIGINT) AS py, CAST(text LIKE '%idiot%' OR text LIKE '%scum%' AS BIGINT) AS pt FROM labelled)"
_CONFUSED = "cf AS (" + " UNION ALL ".join(f"SELECT '{n}' AS property, CAST(sum(CASE WHEN {t} = 1 AND {p} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN {t} = 0 AND {p} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN {t} = 1 AND {p} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN {t} = 0 AND {p} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM pr" for n, t, p in (("quality", "y", "py"), ("toxic", "toxic", "pt"))) + ")"


def _predicted(spark, sf_dir):
    text = F.col("text")
    return labelled(spark, sf_dir, "text").select("doc_id", "y", "toxic", (text.contains("!!") | text.contains("$")).cast("bigint").alias("py"), (text.contains("idiot") | text.contains("scum")).cast("bigint").alias("pt"))


@query(f"WITH {_PREDICTED}, {_CONFUSED} SELECT * FROM cf")
def confusion_by_property(spark, sf_dir):
    return metrics.confusion(_predicted(spark, sf_dir), {"quality": ("y", "py"), "toxic": ("toxic", "pt")})


_Z2 = f"({metrics.Z975} * {metrics.Z975})"


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    centre, half = f"({k} / {n} + {_Z2} / (2 * {n})) / (1 + {_Z2} / {n})", f"{metrics.Z975} * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + {_Z2} / (4 * {n} * {n})) / (1 + {_Z2} / {n})"
    return f"round(greatest(0.0, {centre} - {half}), 6)", f"round(least(1.0, {centre} + {half}), 6)"


_W = _wilson_sql("CAST(tp AS DOUBLE)", "CAST(tp + fp AS DOUBLE)")


@query(f"WITH {_PREDICTED}, {_CONFUSED} SELECT property, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, CASE WHEN tp > 0 THEN round(2.0 * tp / (2 * tp + fp + fn), 6) END AS f1, CASE WHEN tp + fp > 0 THEN {_W[0]} END AS precision_low, CASE WHEN tp + fp > 0 THEN {_W[1]} END AS precision_high FROM cf")
def precision_recall_wilson(spark, sf_dir):
    return metrics.precision_recall(metrics.confusion(_predicted(spark, sf_dir), {"quality": ("y", "py"), "toxic": ("toxic", "pt")}))


_ERRORS = f"{_PREDICTED}, k AS (SELECT CASE WHEN y = 0 AND py = 1 THEN 'false_positive' WHEN y = 1 AND py = 0 THEN 'false_negative' END AS kind, CAST(doc_id AS VARCHAR) AS key FROM pr)"


@query(f"WITH {_ERRORS} SELECT kind, key FROM k WHERE kind IS NOT NULL")
def error_rows(spark, sf_dir):
    return metrics.errors(_predicted(spark, sf_dir), "doc_id", "y", "py")


@query(f"WITH {_ERRORS}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY key) AS r FROM k WHERE kind IS NOT NULL) SELECT kind, count(*) AS n, string_agg(CASE WHEN r <= 1000 THEN key END, ',' ORDER BY key) AS keys FROM r GROUP BY kind")
def error_lists(spark, sf_dir):
    return metrics.error_lists(_predicted(spark, sf_dir), "doc_id", "y", "py")


# ---- pairs

_PAIRS = "pp AS (SELECT * FROM (SELECT conv_id, turn, text AS before, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations) WHERE after IS NOT NULL)"


def _pairs(spark, sf_dir):
    return pairs.consecutive(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query()
def pair_edit_distance(spark, sf_dir):
    return pairs.measure(_pairs(spark, sf_dir)).select("conv_id", "turn", "n_before", "n_after", "distance", r6("diff_frac").alias("diff_frac"), "annotation_only")


_SIDES = f"{_PAIRS}, sd AS (SELECT conv_id, turn, unnest({WORDS.format('before')}) AS token, -1 AS d FROM pp UNION ALL SELECT conv_id, turn, unnest({WORDS.format('after')}), 1 FROM pp), nt AS (SELECT conv_id, turn, token, sum(d) AS d FROM sd GROUP BY ALL HAVING sum(d) <> 0)"


@query(f"WITH {_SIDES} SELECT conv_id, turn, token, CAST(greatest(d, 0) AS BIGINT) AS added, CAST(greatest(-d, 0) AS BIGINT) AS removed FROM nt")
def cue_multiset_delta(spark, sf_dir):
    return vocabulary.multiset_delta(_pairs(spark, sf_dir), ["conv_id", "turn"], T.words("before"), T.words("after"))


@query(f"WITH {_SIDES}, s AS (SELECT conv_id, turn, sum(greatest(d, 0)) AS a, sum(greatest(-d, 0)) AS r FROM nt GROUP BY ALL) SELECT CASE WHEN a > r THEN 'added' WHEN a < r THEN 'removed' ELSE 'neutral' END AS stratum, count(*) AS n FROM s GROUP BY 1")
def pair_strata(spark, sf_dir):
    delta = vocabulary.multiset_delta(_pairs(spark, sf_dir), ["conv_id", "turn"], T.words("before"), T.words("after"))
    sums = delta.groupBy("conv_id", "turn").agg(F.sum("added").alias("a"), F.sum("removed").alias("r"))
    return corpus.frequency(sums.select(pairs.stratum(F.col("a"), F.col("r")).alias("stratum")), "stratum")


def pair_metrics_sql(rows: str, keys: str) -> str:
    """Pair metrics of a table with `m`, the margin, by its keys."""
    p = "round(round(least(1.0, 2 * list_sum(list_transform(range(0, CAST(least(wins, n - wins) AS BIGINT) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))))), 10), 6)"
    low, high = _wilson_sql("CAST(wins AS DOUBLE)", "CAST(n AS DOUBLE)")
    return f"""pa AS (SELECT {keys}, count(*) AS n, CAST(sum(CASE WHEN m > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ties, round(round(avg(m), 10), 6) AS mean_margin, round(median(m), 6) AS median_margin, round(round(coalesce(stddev_samp(m), 0), 10), 6) AS std_margin FROM {rows} GROUP BY {keys}),
 pm AS (SELECT *, round(wins / n, 6) AS accuracy, {low} AS low, {high} AS high, {p} AS p FROM pa)"""


@query(f"WITH {_PAIRS}, q AS (SELECT CAST(turn % 2 AS BIGINT) AS side, length(after) - length(before) AS m FROM pp), {pair_metrics_sql('q', 'side')} SELECT * FROM pm")
def pair_accuracy(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select((F.col("turn") % 2).alias("side"), (F.length("after") - F.length("before")).alias("margin"))
    return metrics.pair_metrics(rows, "margin", "side")


@query(f"WITH {_PAIRS} SELECT CASE WHEN before = after THEN 'unchanged' WHEN abs(length(before) - length(after)) > 0.4 * greatest(length(before), length(after)) THEN 'diff_too_large' ELSE 'kept' END AS reason, count(*) AS n FROM pp GROUP BY 1")
def excluded_reasons(spark, sf_dir):
    a, b = F.length("before"), F.length("after")
    reason = F.when(F.col("before") == F.col("after"), "unchanged").when(F.abs(a - b) > 0.4 * F.greatest(a, b), "diff_too_large").otherwise("kept")
    return corpus.frequency(_pairs(spark, sf_dir).select(reason.alias("reason")), "reason")


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2', 'src/3', 'src_3')")
def holdout_anti_join(spark, sf_dir):
    groups = values(spark, [("src1",), ("src2",), ("src/3",)], "source string")
    return corpus.hold_out(table(spark, sf_dir, "documents").select("doc_id", "source"), groups, "source").select("doc_id")


@query("""WITH u AS (SELECT conv_id, turn // 2 AS round, count(*) AS n_user FROM conversations WHERE role = 'user' GROUP BY ALL), a AS (SELECT conv_id, turn // 2 AS round, count(*) AS n_assistant FROM conversations WHERE role = 'assistant' GROUP BY ALL)
SELECT conv_id, CAST(round AS BIGINT) AS round, n_user, n_assistant, CASE WHEN n_assistant IS NULL THEN 'before_only' WHEN n_user IS NULL THEN 'after_only' ELSE 'both' END AS side FROM u FULL OUTER JOIN a USING (conv_id, round)""")
def full_outer_methods(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.floor(F.col("turn") / 2).cast("bigint").alias("round"), "role")
    side = lambda role: turns.where(F.col("role") == role).groupBy("conv_id", "round").agg(F.count("*").alias(f"n_{role}"))
    return corpus.both_sides(side("user"), side("assistant"), ["conv_id", "round"])


_SHAS = [("a/b", "aa1; bb2;;aa1 ;cc3"), ("c/d", ""), ("e/f", "commit dd4;path/x.java")]


@query("""WITH s(repo, shas) AS (VALUES ('a/b', 'aa1; bb2;;aa1 ;cc3'), ('c/d', ''), ('e/f', 'commit dd4;path/x.java')),
 x AS (SELECT repo, unnest(string_split(shas, ';')) AS v, generate_subscripts(string_split(shas, ';'), 1) AS i FROM s), y AS (SELECT repo, trim(v) AS value, min(i) AS i FROM x WHERE trim(v) <> '' GROUP BY ALL)
SELECT repo, CAST(row_number() OVER (PARTITION BY repo ORDER BY i) - 1 AS BIGINT) AS position, value FROM y""")
def sha_list_explode(spark, sf_dir):
    from lexspark.sources.readers import explode_list

    return explode_list(values(spark, _SHAS, "repo string, shas string"), "repo", "shas")


# ---- tests and decisions

_TRIALS = [(21, 50), (0, 5), (5, 5), (14, 14), (3, 10)]
_TRIALS_SQL = "t(k, n) AS (VALUES " + ", ".join(f"({k}, {n})" for k, n in _TRIALS) + ")"
_WK = _wilson_sql("CAST(k AS DOUBLE)", "CAST(n AS DOUBLE)")


@query(f"WITH {_TRIALS_SQL} SELECT CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, {_WK[0]} AS low, {_WK[1]} AS high FROM t")
def wilson_interval(spark, sf_dir):
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return values(spark, _TRIALS, "k long, n long").select("k", "n", r6(low).alias("low"), r6(high).alias("high"))


@query(f"WITH {_TRIALS_SQL}, s AS (SELECT k, n, unnest(range(0, least(k, n - k) + 1)) AS i FROM t) SELECT CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0)))), 6) AS p FROM s GROUP BY k, n")
def binomial_two_sided(spark, sf_dir):
    return values(spark, _TRIALS, "k long, n long").select("k", "n", r6(metrics.binomial_half(F.col("k"), F.col("n"))).alias("p"))


_DIFFS = [("all_positive", [0.394, 0.447, 0.374, 0.661, 0.624]), ("mixed", [0.5, -0.1, 0.2, 0.3, -0.4]), ("ties", [0.2, 0.2, -0.2, 0.1, 0.3])]
_DIFFS_SQL = "d(name, ord, x) AS (VALUES " + ", ".join(f"('{n}', {i}, {x})" for n, v in _DIFFS for i, x in enumerate(v)) + ")"


@query(f"""WITH {_DIFFS_SQL}, r AS (SELECT name, ord, x, rank() OVER (PARTITION BY name ORDER BY abs(x)) + (count(*) OVER (PARTITION BY name, abs(x)) - 1) / 2.0 AS r FROM d), o AS (SELECT name, sum(CASE WHEN x > 0 THEN r ELSE 0 END) AS w FROM r GROUP BY name),
 m AS (SELECT name, mask, sum(CASE WHEN (mask >> ord) & 1 = 1 THEN r ELSE 0 END) AS w FROM r, (SELECT unnest(range(0, 32))::INTEGER AS mask) GROUP BY name, mask)
SELECT m.name, round(avg(CASE WHEN m.w >= o.w - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS p FROM m JOIN o USING (name) GROUP BY m.name""")
def wilcoxon_exact(spark, sf_dir):
    rows = values(spark, _DIFFS, "name string, d array<double>")
    return rows.select("name", r6(metrics.wilcoxon_one_sided(F.col("d"))).alias("p"))


_CASES = [("a", 0.03, 0.2, 0.5, 0.4, 50, 0.6, 0.01), ("b", 0.03, 0.2, 0.5, 0.4, 50, 0.42, 0.32), ("c", 0.03, 0.2, 0.5, 0.4, 12, 0.9, 0.01), ("d", 0.2, 0.1, 0.5, 0.4, 12, 0.9, 0.01)]


@query("""WITH c(name, p1, d1, own, other, n, acc, p3) AS (VALUES """ + ", ".join(str(c) for c in _CASES) + """), s AS (SELECT name, p1 < 0.05 AND d1 > 0 AS a, own > other AS b, CASE WHEN n >= 40 THEN acc > 0.5 AND p3 < 0.05 END AS c FROM c)
SELECT name, CAST(a AS BIGINT) AS first_claim, CAST(b AS BIGINT) AS second_claim, CAST(c AS BIGINT) AS third_claim, CASE WHEN a AND b AND coalesce(c, false) THEN 'proceed' WHEN NOT a OR NOT b OR NOT coalesce(c, true) THEN 'stop' ELSE 'inconclusive' END AS decision FROM s""")
def stopping_rule(spark, sf_dir):
    c = values(spark, _CASES, "name string, p1 double, d1 double, own double, other double, n long, acc double, p3 double")
    claims = [decide.first_claim(F.col("p1"), F.col("d1")), decide.second_claim(F.col("own"), F.col("other")), decide.third_claim(F.col("n"), F.col("acc"), F.col("p3"))]
    return c.select("name", *[x.cast("bigint").alias(f"{n}_claim") for n, x in zip(("first", "second", "third"), claims, strict=True)], decide.overall(*claims).alias("decision"))


# ---- state


@query("SELECT user_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def checkpoint_latest(spark, sf_dir):
    return corpus.latest_by_key(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"]).withColumn("value", r6("value"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return corpus.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


# ---- learning and Java: no SQL


def _small_vectors(rows: DataFrame) -> DataFrame:
    upper = F.regexp_count("text", F.lit("[A-Z]")) / F.greatest(F.length("text"), F.lit(1))
    marks = F.regexp_count("text", F.lit(r"[$%&*#!|]")) / F.greatest(F.length("text"), F.lit(1))
    return rows.withColumn("features", learn.vector(upper, marks, F.log1p(F.length("text"))))


@query()
def logistic_whitespace(spark, sf_dir):
    rows = labelled(spark, sf_dir, "text").select("y", *[c.alias(n) for n, c in T.whitespace_flags("text").items()]).persist()
    return values(spark, [(learn.in_sample_auroc(rows, ["leading_space", "final_newline", "has_tab", "has_cr"], "y"),)], "auroc double")


@query()
def logistic_cv(spark, sf_dir):
    rows = _small_vectors(sampling.cross_folds(labelled(spark, sf_dir, "text", "source"), "source", "y")).select("doc_id", "y", "fold", "features").persist()
    return metrics.average_precision(learn.cross_validate(rows, "y", "fold", 1.0), "score", "y", "fold")


@query()
def logistic_probe_layers(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") == 0).cast("bigint"))
    folded = sampling.control_labels(sampling.within_folds(v, "vec_id", "y"), "vec_id", "y").select("vec_id", "y", "fold", "control", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, 8))).alias("layer", "vector"))
    return learn.probe(folded, ["layer"], "fold", "y", "vector", "control")
