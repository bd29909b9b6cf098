"""Feature tables in long form: TF-IDF with optional ablation, scaling, vector slices and pools."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators import vocabulary

HALF_MOST = 65504.0  # the greatest finite half-precision number


def tfidf(docs: DataFrame, key: str, tokens: Column, at_least: int = 3, without: DataFrame | None = None, train: str | None = None) -> DataFrame:
    """(key, token, weight): (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), each document at length 1 over its
    vocabulary. Columns of `without` go after the scaling, so rows that lose some aren't scaled again.
    With `train`, a boolean column, counts come from its rows alone while all rows get weights."""
    fitted = docs.where(train) if train else docs
    df = vocabulary.document_frequency(fitted, tokens, at_least)
    n = fitted.agg(F.count("*").cast("double").alias("n"))
    # a document's tokens are counted where its text is, and its norm is taken where its weights meet
    tf = docs.where(F.col(key).isNotNull()).repartition(key).select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    raw = tf.join(df, "token").crossJoin(F.broadcast(n)).select(key, "token", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    out = raw.select(key, "token", (F.col("w") / norm).alias("weight"))
    return out.join(without.select("token").distinct(), "token", "left_anti").select(key, "token", "weight") if without is not None else out


def zscore(rows: DataFrame, columns: list[str], *keys: str, train: Column | None = None) -> DataFrame:
    """Columns scaled by mean and population deviation of the (training) rows; constant ones become 0."""
    source = rows.where(train) if train is not None else rows
    facts = source.groupBy(*keys).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    joined = rows.join(facts, list(keys)) if keys else rows.crossJoin(F.broadcast(facts))
    return joined.withColumns({f"{c}_z": F.round(F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.nullif(F.col(f"__s_{c}"), F.lit(0.0))), F.lit(0.0)), 6) for c in columns}).drop(*[f"__{x}_{c}" for c in columns for x in "ms"])


def layers(vectors: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(key, layer, pos, value): a vector's elements, `width` to a layer."""
    return vectors.select(key, F.posexplode(vector).alias("i", "value")).select(key, F.floor(F.col("i") / width).cast("bigint").alias("layer"), (F.col("i") % width).cast("bigint").alias("pos"), F.col("value").cast("double").alias("value"))


def element_zscore(vectors: DataFrame, key: str, vector: str, train: Column | None = None) -> DataFrame:
    """Each element scaled by mean and deviation over all rows, or over the training rows. Counts, sums and
    squares by position; no window over rows."""
    long = vectors.select(key, F.posexplode(vector).alias("i", "value"))
    fitted = long if train is None else vectors.where(train).select(F.posexplode(vector).alias("i", "value"))
    facts = fitted.groupBy("i").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return long.join(F.broadcast(facts), "i").select(key, F.col("i").cast("bigint").alias("i"), F.round((F.col("value") - F.col("m")) / F.nullif("s", F.lit(0.0)), 4).alias("z"))


def mean_pool(tokens: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean over a key's token vectors, element by element."""
    long = tokens.select(key, F.posexplode(vector).alias("i", "value"))
    means = long.groupBy(key, "i").agg(F.avg(F.col("value").cast("double")).alias("value"))
    return means.select(key, F.col("i").cast("bigint").alias("i"), F.round("value", 6).alias("value"))


def last_pool(vectors: Column) -> Column:
    """The last of an array of token vectors."""
    return F.try_element_at(vectors, F.lit(-1))


def refit(method, rows: DataFrame, key: str, text: str, other: str, train: str, cues: DataFrame | None = None) -> DataFrame:
    """Features of the rows' other text under what the method fits on the training rows' own text."""
    name = lambda side: F.concat(F.lit(f"{side}|"), F.col(key).cast("string")).alias("__key")
    own = rows.where(train).select(name("own"), F.col(text).alias("__text"), F.lit(True).alias("__fit"))
    moved = rows.select(name("other"), F.col(other), F.lit(False))
    long = method(own.union(moved), "__key", "__text", "__fit", cues).where(F.col("__key").startswith("other|"))
    return long.select(F.expr("substring(__key, 7)").cast(rows.schema[key].dataType).alias(key), "token", "weight")


def write_layers(vectors: DataFrame, key: str, vector: str, width: int, path: str) -> None:
    """A table of vectors partitioned by layer: (key, vector, layer), elements clipped to half precision.
    Written side by side, so that a layer is a folder which a scan can skip."""
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(vector) / width).cast("int") - 1, F.lit(0))), lambda k: F.struct(k.alias("layer"), F.slice(vector, k * width + 1, width).alias("v")))
    long = vectors.where(F.size(vector) > 0).select(key, F.explode(parts).alias("p")).select(key, clip_half(F.transform("p.v", lambda x: x.cast("double"))).cast("array<float>").alias("vector"), F.col("p.layer").alias("layer"))
    long.repartition("layer", F.pmod(F.xxhash64(key), F.lit(LAYER_FILES))).write.partitionBy("layer").mode("overwrite").parquet(path)


#: Files of a layer.
LAYER_FILES = 16


def read_layer(spark, path: str, layer: int) -> DataFrame:
    """(key, vector) of one layer; the scan reads that layer's files alone."""
    return spark.read.parquet(path).where(F.col("layer") == layer).drop("layer")


def hidden_states(rows: DataFrame, key: str, text: str, load, schema: str = "array<float>", batch: int = 32) -> DataFrame:
    """(key, vector) from a model. load() gives a function of a list of texts that returns a list of vectors;
    it is called once in a worker, at the first batch. Texts go to the model in small batches of like length,
    and come back under their keys."""

    def step(batches):
        model = None
        for rows_ in batches:
            if model is None:
                model = load()
            order = rows_["text"].str.len().sort_values(ascending=False, kind="stable").index
            for i in range(0, len(order), batch):
                own = rows_.loc[order[i : i + batch]]
                yield pd.DataFrame({"key": own["key"].to_numpy(), "vector": [list(map(float, v)) for v in model(own["text"].tolist())]})

    narrow = rows.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    out = narrow.mapInPandas(step, f"key {narrow.schema['key'].dataType.simpleString()}, vector {schema}")
    return out.withColumnRenamed("key", key)


def clip_half(vector: Column) -> Column:
    return F.transform(vector, lambda v: F.least(F.greatest(v, F.lit(-HALF_MOST)), F.lit(HALF_MOST)))


def clip_report(vectors: DataFrame, vector: str, most: float = HALF_MOST) -> DataFrame:
    beyond = F.size(F.filter(vector, lambda v: F.abs(v) > most))
    return vectors.agg(F.sum(F.size(vector)).cast("bigint").alias("n_values"), F.sum(beyond).cast("bigint").alias("n_clipped"), F.round(F.sum(beyond) / F.sum(F.size(vector)), 6).alias("clip_rate"))


def truncation(rows: DataFrame, length: str, most: int, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.round(F.avg((F.col(length) > most).cast("int")), 6).alias("truncation_rate"), F.round(F.percentile(length, 0.5), 6).alias("median_length"), F.round(F.percentile(length, 0.95), 6).alias("p95_length"))
