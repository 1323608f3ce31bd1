"""Feature blocks, scaling, one-hot, projection, grids, text weights and graph embeddings."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalar import col
from siltstone.operators.graph import cut

#: Most categories that one column may be expanded to (all port numbers); a column with more raises an error, none is left out.
MOST_CATEGORIES = 1 << 16


@dataclass(frozen=True)
class Block:
    """Columns that are one-hot encoded ("onehot"), scaled ("scale") or passed through ("plain")."""

    kind: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class FeatureSpec:
    """The blocks of a feature vector, in order."""

    blocks: tuple[Block, ...]


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column in one pass; null, NaN and infinite values are left out."""
    clean = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    got = df.agg(*[f(clean(col(c).cast("double"))) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    return {c: (got[2 * i] or 0.0, got[2 * i + 1] or 0.0) for i, c in enumerate(columns)}


def scaled(c: Column, mean: float, deviation: float) -> Column:
    """(c - mean) / deviation, 0 without variance or value."""
    c = c.cast("double")
    if not deviation:
        return F.lit(0.0)
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), (c - mean) / deviation).otherwise(0.0)


def categories(df: DataFrame, column: str, most: int = MOST_CATEGORIES) -> list:
    """All categories of a column, sorted; more than ``most`` are an error."""
    rows = df.where(col(column).isNotNull()).select(col(column).alias("c")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"column {column} has over {most} categories")
    return sorted(r["c"] for r in rows)


def one_hot(column: str, values: list) -> list[Column]:
    """A 0/1 column per category; unknown ones give zeros."""
    return [F.when(col(column) == v, 1.0).otherwise(0.0).alias(f"{column}_{v}") for v in values]


def one_hot_array(df: DataFrame, column: str, values: list) -> Column:
    """array<double>: the 0/1 columns of many categories in one expression, which looks the category's place up."""
    n, kind = len(values), df.select(col(column)).schema[0].dataType.simpleString()
    listed = F.from_json(F.lit(json.dumps([str(v) for v in values])), "array<string>").cast(f"array<{kind}>")
    at = F.coalesce(F.array_position(listed, col(column)), F.lit(0)).cast("int")
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    return F.when(at > 0, F.concat(zeros(at - 1), F.array(F.lit(1.0)), zeros(n - at))).otherwise(zeros(F.lit(n)))


def build(df: DataFrame, spec: FeatureSpec, row_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., v): the assembled vector of each row. One statistics pass, one for the categories, then a projection."""
    stats = moments(df, [c for b in spec.blocks if b.kind == "scale" for c in b.columns]) if any(b.kind == "scale" for b in spec.blocks) else {}
    parts: list[Column] = []
    for b in spec.blocks:
        if b.kind == "onehot":
            parts += [one_hot_array(df, c, categories(df, c)) for c in b.columns]
        elif b.columns:
            parts.append(F.array(*[scaled(col(c), *stats[c]) if b.kind == "scale" else F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in b.columns]))
    return df.select(col(row_id).cast("long").alias("id"), *map(col, keep), F.concat(*parts).alias("v"))


def literal(rows: np.ndarray) -> Column:
    """array<array<double>> of a small matrix, folded into one literal."""
    text = ";".join(",".join(map(repr, map(float, r))) for r in np.atleast_2d(rows))
    return F.transform(F.split(F.lit(text), ";"), lambda r: F.split(r, ",").cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def pca(points: DataFrame, k: int) -> DataFrame:
    """``points`` with v projected on k centred axes; each axis is turned so that its greatest loading is positive."""
    d = len(points.first()["v"])
    means = points.agg(*[F.avg(F.col("v")[i]) for i in range(d)]).first()
    centred = F.transform("v", lambda x, i: x - F.get(F.array(*[F.lit(float(m)) for m in means]), i))
    rows = points.withColumn("v", centred)
    axes = PCA(k=min(k, d), inputCol="f", outputCol="p").fit(rows.select(array_to_vector("v").alias("f"))).pc.toArray().T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return rows.withColumn("v", F.transform(literal(axes), lambda a: dot(a, F.col("v"))))


def digitize(v: Column, low: float, high: float, edges: int = 10) -> Column:
    """1-based bins between ``edges`` equal edges; only the greatest value is in the last one, those outside are 0 or the last."""
    step = (high - low) / (edges - 1)
    return F.transform(v, lambda x: F.when(x < low, 0).when(x >= high, edges).otherwise(F.least(F.lit(edges - 1), F.floor((x - low) / step).cast("int") + 1)).cast("int"))


def value_range(points: DataFrame) -> tuple[float, float]:
    got = points.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    return got[0], got[1]


def grid_items(points: DataFrame, edges: int = 10) -> DataFrame:
    """(id, items): the grid cell of each feature as an item Feature_i_bin."""
    low, high = value_range(points)
    return points.select("id", F.transform(digitize(F.col("v"), low, high, edges), lambda b, i: F.concat(F.lit("Feature_"), i.cast("string"), F.lit("_"), b.cast("string"))).alias("items"))


def word_tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def tfidf(docs: DataFrame, doc_id: str, tokens: Column) -> DataFrame:
    """(doc_id, term, weight): counts times ln((1 + n) / (1 + df)) + 1, each document at length 1. Documents without terms have no rows."""
    n = docs.count()
    terms = docs.select(doc_id, F.explode(tokens).alias("term")).where("term <> ''").groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = terms.join(df, "term").select(doc_id, "term", (F.col("tf") * (F.log(F.lit(1.0 + n) / (F.col("df") + 1)) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc_id)))  # a document's terms, bounded by its length
    return raw.select(doc_id, "term", (F.col("w") / norm).alias("weight"))


def projection_weights(width: int, size: int = 16, seed: int = 42) -> np.ndarray:
    """(size, width): uniform weights scaled by both sides, as an untrained dense layer has them."""
    return np.random.default_rng(seed).uniform(-1, 1, (size, width)) * np.sqrt(6 / (size + width))


def random_projection(v: Column, width: int, size: int = 16, seed: int = 42) -> Column:
    """An untrained dense layer: a seeded projection, negatives cut to 0."""
    return F.transform(literal(projection_weights(width, size, seed)), lambda a: F.greatest(F.lit(0.0), dot(a, v)))


def edges(df: DataFrame, source: str, target: str, order: str, attributes: list[str]) -> DataFrame:
    """(src, dst, attributes): one undirected edge per pair, the last row by ``order`` wins."""
    a, b = col(source), col(target)
    picked = df.where(a.isNotNull() & b.isNotNull()).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), col(order).alias("_o"), *map(col, attributes))
    last = picked.groupBy("src", "dst").agg(F.max_by(F.struct("_o", *attributes), F.struct("_o", *attributes)).alias("r"))
    return last.select("src", "dst", *[F.col(f"r.{c}") for c in attributes])


def random_walks(graph: DataFrame, length: int = 10, walks: int = 10, seed: int = 42) -> DataFrame:
    """(walk): uniform random walks from every node, one join and one draw a step.

    A node's neighbours are numbered, the walker draws a number below its degree and joins on (node, number), so hubs are
    neither collected nor multiplied.
    """
    both = graph.select("src", "dst").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    number = F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
    listed = cut(both.withColumn("i", number).join(degree, "src"))
    now = degree.select(F.col("src").alias("at"), F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("w")).select("at", "w", F.array(F.col("at").cast("string")).alias("walk"), F.col("at").alias("start"))
    for step in range(length - 1):
        drawn = now.join(degree, F.col("at") == F.col("src")).withColumn("i", F.pmod(F.xxhash64("start", "w", F.lit(step), F.lit(seed)), F.col("deg")).cast("int")).drop("src", "deg")
        hop = listed.select(F.col("src").alias("s"), F.col("i").alias("j"), "dst")
        now = cut(drawn.join(hop, (F.col("at") == F.col("s")) & (F.col("i") == F.col("j"))).select(F.col("dst").alias("at"), "w", F.concat("walk", F.array(F.col("dst").cast("string"))).alias("walk"), "start"))
    return now.select("walk")


def node_embeddings(graph: DataFrame, size: int = 16, length: int = 10, walks: int = 10, window: int = 5, seed: int = 42) -> DataFrame:
    """(node, v): skip-gram vectors of random walks."""
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=1, seed=seed, inputCol="walk", outputCol="o").fit(random_walks(graph, length, walks, seed))
    return model.getVectors().select(F.col("word").alias("node"), vector_to_array("vector").alias("v"))


def sequence_codes(rows: DataFrame, sequence: str, size: int = 10) -> DataFrame:
    """rows with ``code``: padded sequences on their leading axes. It stands in for a trained sequence encoder."""
    longest = rows.agg(F.max(F.size(sequence))).first()[0] or 1
    padded = F.concat(sequence, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(longest) - F.size(sequence))))
    return pca(rows.withColumn("v", padded), size).withColumnRenamed("v", "code")


def hstack(parts: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), parts)
