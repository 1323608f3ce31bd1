"""Quality of predictions and clusters, all from one contingency table.

The table has a row per (label, prediction) pair, so what follows it is small whatever the rows were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalar import ratio
from siltstone.operators import blocks


def flip(df: DataFrame, cluster: str = "cluster", out: str = "adjusted_cluster", fill: int | None = -1) -> DataFrame:
    """Clusters 0 and 1 change names; all others become the fill, or null."""
    swapped = F.when(F.col(cluster) == 0, 1).when(F.col(cluster) == 1, 0)
    return df.withColumn(out, F.coalesce(swapped, F.lit(fill)) if fill is not None else swapped)


def contingency(df: DataFrame, label: str, prediction: str, noise: int | None = -1) -> DataFrame:
    """(y, p, n) without null or noise predictions."""
    rows = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    if noise is not None:
        rows = rows.where(F.col(prediction) != noise)
    return rows.groupBy(F.col(label).cast("long").alias("y"), F.col(prediction).cast("long").alias("p")).agg(F.count(F.lit(1)).alias("n"))


def _per_label(table: DataFrame) -> DataFrame:
    """(c, tp, pred, sup) over the union of labels and predictions, and the total."""
    each = F.array(
        F.struct(F.col("y").alias("c"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("pred"), F.col("n").alias("sup")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("pred"), F.lit(0).cast("long").alias("sup")),
    )
    return table.select(F.inline(each)).groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("pred").alias("pred"), F.sum("sup").alias("sup"))


def scores(table: DataFrame) -> DataFrame:
    """(metric, average, value): accuracy, precision, recall, f1 and jaccard, macro, micro and weighted. An empty table gives zeros."""
    per = _per_label(table).withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("pred")),
            "recall": ratio(F.col("tp"), F.col("sup")),
            "f1": ratio(2 * F.col("tp"), F.col("pred") + F.col("sup")),
            "jaccard": ratio(F.col("tp"), F.col("pred") + F.col("sup") - F.col("tp")),
        }
    )
    names = ("precision", "recall", "f1", "jaccard")
    sums = per.agg(
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"macro_{m}") for m in names],
        *[F.coalesce(F.sum(F.col(m) * F.col("sup")) / F.nullif(F.sum("sup"), F.lit(0)), F.lit(0.0)).alias(f"weighted_{m}") for m in names],
        F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("sup"), F.lit(0)).alias("n"),
    )
    accuracy = ratio(F.col("tp"), F.col("n"))
    rows = [F.struct(F.lit("accuracy").alias("metric"), F.lit(a).alias("average"), accuracy.alias("value")) for a in ("macro", "micro", "weighted")]
    for m in names:
        micro = ratio(F.col("tp"), 2 * F.col("n") - F.col("tp")) if m == "jaccard" else accuracy
        for a, v in (("macro", F.col(f"macro_{m}")), ("micro", micro), ("weighted", F.col(f"weighted_{m}"))):
            rows.append(F.struct(F.lit(m).alias("metric"), F.lit(a).alias("average"), v.alias("value")))
    return sums.select(F.inline(F.array(*rows)))


def binary_scores(table: DataFrame, positive: int = 1) -> DataFrame:
    """(metric, value) of one positive class, with accuracy over all."""
    y, p, n = F.col("y") == positive, F.col("p") == positive, F.col("n")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    cells = table.agg(total(y & p).alias("tp"), total(p).alias("pred"), total(y).alias("sup"), total(F.col("y") == F.col("p")).alias("same"), total(F.lit(True)).alias("n"))
    found = {
        "accuracy": ratio(F.col("same"), F.col("n")),
        "precision": ratio(F.col("tp"), F.col("pred")),
        "recall": ratio(F.col("tp"), F.col("sup")),
        "f1": ratio(2 * F.col("tp"), F.col("pred") + F.col("sup")),
        "jaccard": ratio(F.col("tp"), F.col("pred") + F.col("sup") - F.col("tp")),
    }
    return cells.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in found.items()])))


def original_and_adjusted(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """(variant, metric, average, value) of the clusters and of the flipped clusters, noise left out of each."""
    both = flip(df, cluster)
    parts = [scores(contingency(both, label, c)).select(F.lit(v).alias("variant"), "metric", "average", "value") for v, c in (("Original", cluster), ("Adjusted", "adjusted_cluster"))]
    return parts[0].unionByName(parts[1])


def wide(long: DataFrame) -> DataFrame:
    """(metric, macro_original, macro_adjusted, ...) from ``original_and_adjusted``."""
    cell = F.concat(F.lower("average"), F.lit("_"), F.lower("variant"))
    columns = [f"{a}_{v}" for a in ("macro", "micro", "weighted") for v in ("original", "adjusted")]
    return long.withColumn("cell", cell).groupBy("metric").pivot("cell", columns).agg(F.first("value"))


def rand_index(table: DataFrame) -> DataFrame:
    """(adjusted_rand_index): 1 where both sides are a single class or agree."""
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    a = table.groupBy("y").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs("n")), F.lit(0.0)).alias("a"))
    b = table.groupBy("p").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs("n")), F.lit(0.0)).alias("b"))
    both = table.agg(F.coalesce(F.sum(pairs("n")), F.lit(0.0)).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    one = both.crossJoin(a).crossJoin(b)  # one row each
    expected = F.when(F.col("n") > 1, F.col("a") * F.col("b") / pairs("n")).otherwise(0.0)
    top, bottom = F.col("s") - expected, (F.col("a") + F.col("b")) / 2 - expected
    return one.select(F.when(bottom == 0, 1.0).otherwise(top / bottom).alias("adjusted_rand_index"))


def mutual_information(table: DataFrame) -> DataFrame:
    """(normalized_mutual_information), by the arithmetic mean of the entropies; 1 where both entropies are 0."""
    n = table.agg(F.sum("n").alias("t"))
    y, p = (table.groupBy(c).agg(F.sum("n").alias(f"n{c}")) for c in "yp")
    joint = table.join(y, "y").join(p, "p").crossJoin(n)  # n is one row
    mi = joint.agg(F.coalesce(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("ny") * F.col("np")))), F.lit(0.0)).alias("mi"))
    entropy = lambda d, c: d.crossJoin(n).agg(F.coalesce(-F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t"))), F.lit(0.0)).alias(f"h{c}"))
    one = mi.crossJoin(entropy(y, "ny")).crossJoin(entropy(p, "np"))
    mean = (F.col("hny") + F.col("hnp")) / 2
    return one.select(F.when(mean <= 1e-15, 1.0).otherwise(F.col("mi") / mean).alias("normalized_mutual_information"))


def silhouette(points: DataFrame, sample: int | None = None, seed: int = 42, block: int | None = None) -> DataFrame:
    """(id, cluster, s) of points (id, v, cluster): Euclidean, exact over all points, in blocks; a lone point has 0.

    sample: take the mean over so many random points, measured among themselves, as the sampled metric does.
    """
    rows = points.select("id", F.col("v").cast("array<double>").alias("v"), F.col("cluster").cast("long").alias("tag"))
    if sample is not None:
        rows = rows.orderBy(F.rand(seed)).limit(sample)
    sums = blocks.group_sums(rows, rows, block=block)
    own = rows.select("id", F.col("tag").alias("own"))
    each = sums.join(own, "id")
    mine = F.sum(F.when(F.col("tag") == F.col("own"), F.col("total") / F.nullif(F.col("n") - 1, F.lit(0))))
    rest = F.min(F.when(F.col("tag") != F.col("own"), F.col("total") / F.col("n")))
    got = each.groupBy("id", F.col("own").alias("cluster")).agg(mine.alias("a"), rest.alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(ratio(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return got.select("id", "cluster", value.alias("s"))


def silhouette_score(points: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    """(silhouette): the mean; null with fewer than two clusters."""
    got = silhouette(points, sample, seed)
    return got.agg(F.when(F.countDistinct("cluster") > 1, F.avg("s")).alias("silhouette"))
