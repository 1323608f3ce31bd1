"""Scoring of signature groups against labelled rows.

A row matches a group if all the group's columns are 1 in it. Rows are first counted by their distinct 0/1 patterns, then all
groups are scored over the patterns: a sum of matches among anomalous rows and one among the others per group, the four cells
follow from the totals. Groups come from column counts, so there are as many as columns or a few times that; they travel as
one literal.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalar import col, positive_items, ratio, weighted

#: Groups that one literal may hold.
MOST_GROUPS = 100_000
# Weights of the scores of a threshold and of a group.
WEIGHTS = {"accuracy": 0.15, "precision": 0.65, "recall": 0.15, "f1": 0.05}
ROW_WEIGHTS = {"accuracy": 0.45, "precision": 0.35, "recall": 0.15, "f1": 0.05}


def confusion(matrix: DataFrame, groups: list[tuple[int, list[str]]], label: str = "anomal", mode: str = "reference") -> DataFrame:
    """(group_id, TP, FP, TN, FN).

    mode reference: an anomalous row without a match is FP and a benign match FN, as the data's origin counts; standard: the other way.
    """
    spark = matrix.sparkSession
    if not groups:
        return spark.createDataFrame([], "group_id int, TP long, FP long, TN long, FN long")
    rows = patterns(matrix, sorted({c for _, items in groups for c in items}), label)
    # the empty group -1 matches every row: its sums are the totals
    text = json.dumps([{"g": -1, "items": []}, *({"g": g, "items": list(items)} for g, items in groups)])
    listed = F.from_json(F.lit(text), "array<struct<g: int, items: array<string>>>")
    met = F.filter(listed, lambda x: F.size(F.array_except(x["items"], F.col("items"))) == 0)
    anomal = F.col("anomal") == 1
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sums = rows.select(F.explode(F.transform(met, lambda x: x["g"])).alias("g"), "anomal", "n").groupBy("g").agg(total(anomal).alias("a"), total(~anomal).alias("b"))
    known = spark.range(1).select(F.explode(F.transform(listed, lambda x: x["g"])).alias("group_id")).join(sums, F.col("group_id") == F.col("g"), "left")
    everywhere = Window.partitionBy()  # a row per group
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = lambda c: zero(F.max(F.when(F.col("group_id") == -1, F.col(c))).over(everywhere))
    full = known.select("group_id", zero(F.col("a")).alias("a"), zero(F.col("b")).alias("b"), whole("a").alias("p"), whole("b").alias("q")).where("group_id >= 0")
    return full.select(
        "group_id",
        F.col("a").alias("TP"),
        (F.col("p") - F.col("a") if mode == "reference" else F.col("b")).alias("FP"),
        (F.col("q") - F.col("b")).alias("TN"),
        (F.col("b") if mode == "reference" else F.col("p") - F.col("a")).alias("FN"),
    )


def patterns(matrix: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(items, anomal, n): the distinct sets of columns that are 1, by label, with their numbers."""
    items = positive_items(columns) if columns else F.array().cast("array<string>")
    return matrix.select(items.alias("items"), F.coalesce(col(label), F.lit(0)).alias("anomal")).groupBy("items", "anomal").agg(F.count(F.lit(1)).alias("n"))


def metrics(cells: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1, tnr and fpr; a metric without a base is 0."""
    tp, fp, tn, fn = map(F.col, ("TP", "FP", "TN", "FN"))
    first = cells.withColumns(
        {"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "tnr": ratio(tn, tn + fp), "fpr": ratio(fp, tn + fp)}
    )
    p, r = F.col("precision"), F.col("recall")
    return first.withColumn("f1", ratio(2 * p * r, p + r))


def top(scored: DataFrame, k: int = 5, by: str = "precision") -> DataFrame:
    """The k best groups; ties by group id."""
    return scored.orderBy(F.desc(by), F.asc("group_id")).limit(k)


def top_with_mean(scored: DataFrame, k: int = 5) -> DataFrame:
    """(eva_row, precision): the k best and a row of their mean."""
    best = top(scored, k).select(F.col("group_id").cast("string").alias("eva_row"), "precision")
    return best.unionByName(best.agg(F.avg("precision").alias("precision")).select(F.lit("Precision Mean").alias("eva_row"), "precision"))


def selected(matrix: DataFrame, groups: list[tuple[int, list[str]]], label: str = "anomal") -> DataFrame:
    """Cells, precision and recall of chosen groups over the anomalous rows alone, summed."""
    cells = confusion(matrix.where(col(label) == 1), groups, label)
    total = cells.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("TP", "FP", "TN", "FN")])
    return metrics(total).select("TP", "FP", "TN", "FN", "precision", "recall")


def sweep(matrix: DataFrame, groups_at: dict[float, list[tuple[int, list[str]]]], label: str = "anomal", weights: dict[str, float] | None = None) -> DataFrame:
    """(confidence, accuracy, precision, recall, f1, total_score): all groups of a threshold summed, one row a threshold.

    Column counts are taken once for all thresholds by the caller, and all thresholds are scored in one pass.
    """
    numbered, owner = [], []
    for confidence, groups in groups_at.items():
        for _, items in groups:
            owner.append((len(numbered), confidence))
            numbered.append((len(numbered), items))
    cells = confusion(matrix, numbered, label)
    owners = matrix.sparkSession.createDataFrame(owner, "group_id int, confidence double")
    summed = cells.join(F.broadcast(owners), "group_id").groupBy("confidence").agg(*[F.sum(c).alias(c) for c in ("TP", "FP", "TN", "FN")])
    return metrics(summed).select("confidence", "accuracy", "precision", "recall", "f1", weighted(weights or WEIGHTS).alias("total_score"))


def best(swept: DataFrame) -> DataFrame:
    """The threshold of the greatest score, the least one on ties."""
    return swept.orderBy(F.desc("total_score"), "confidence").limit(1)


def thresholds(first: float = 0.1, stop: float = 1.0, step: float = 0.05) -> list[float]:
    n = round((stop - first) / step)
    return [round(first + i * step, 10) for i in range(n)]


def confidence_grid(scored: DataFrame, confidence: float = 0.7, widest: float = 10.0, narrowest: float = 1e-6, step: float = 0.01) -> DataFrame:
    """(group_id, confidence, total_score): each group's score at confidences around the given one, ever closer ranges by tens."""
    offsets, reach = [], widest
    while reach >= narrowest * 0.999:
        n = int((2 * reach + step) / step - 1e-9) + 1
        offsets += [-reach + i * step for i in range(n)]
        reach /= 10
    moves = F.explode(F.array(*[F.lit(confidence + o / 100) for o in offsets])) if len(offsets) < 500 else F.explode(F.transform(F.split(F.lit(",".join(map(repr, offsets))), ","), lambda o: F.lit(confidence) + o.cast("double") / 100))
    return scored.select("group_id", moves.alias("confidence"), weighted(ROW_WEIGHTS).alias("total_score"))


def difference_items(a: DataFrame, b: DataFrame) -> DataFrame:
    """(item): items of some group of a that some group of b lacks, which are those that not all groups of b hold."""
    groups = b.agg(F.count(F.lit(1)).alias("groups"))
    held = b.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    mine = a.select(F.explode("items").alias("item")).distinct().join(held, "item", "left")
    return mine.join(groups, F.coalesce("n", F.lit(0)) < F.col("groups")).select("item")  # groups is one row


def difference_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(items): the distinct non-empty differences of a group of a and one of b.

    b's distinct groups travel as one literal; groups come from columns, and more than MOST_GROUPS of them are an error.
    """
    rows = b.select("items").distinct().limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"over {MOST_GROUPS} groups to subtract")
    others = F.from_json(F.lit(json.dumps([r["items"] for r in rows])), "array<array<string>>")
    rest = a.select(F.explode(F.transform(others, lambda y: F.array_sort(F.array_except("items", y)))).alias("items"))
    return rest.where(F.size("items") > 0).distinct()
