"""Whole runs: mine and score signatures; embed, cluster and evaluate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import scalar
from siltstone.operators import evaluation, features, mining, signatures


@dataclass
class Mined:
    groups: list[mining.Group]
    cells: DataFrame
    metrics: DataFrame
    top: DataFrame


def mine_signatures(
    flows: DataFrame, row_id: str, stages: list[str], confidence: float = 0.7, with_labels: bool = False, anomalous: bool = True, mode: str = "reference", k: int = 5
) -> Mined:
    """Label, binarize, group, score and rank. with_labels: the stage columns are candidates too; anomalous False mines the other rows."""
    labelled = flows.withColumn("anomal", scalar.any_nonzero(stages))
    skip = [row_id, "anomal"] + ([] if with_labels else stages)
    columns = scalar.other_columns(labelled, skip)
    matrix = scalar.binarize(labelled, [row_id, "anomal"], columns)
    side = matrix.where(F.col("anomal") == (1 if anomalous else 0))
    groups = mining.related_groups(mining.collect_counts(mining.transactions(side, row_id, columns), columns), confidence)
    positive = scalar.binarize(labelled.withColumn("anomal", scalar.any_positive(stages)), [row_id, "anomal"], columns)
    cells = signatures.confusion(positive, [(g.group_id, list(g.items)) for g in groups], mode=mode)
    scored = signatures.metrics(cells)
    return Mined(groups, cells, scored, signatures.top_with_mean(scored, k))


def embed_cluster_evaluate(
    flows: DataFrame, row_id: str, spec: features.FeatureSpec, label: str, cluster: Callable[[DataFrame], DataFrame], axes: int | None = 10
) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, adjusted_cluster, label) and the metric values of the original and the flipped clusters."""
    points = features.build(flows, spec, row_id, keep=(label,))
    if axes:
        points = features.pca(points, axes)
    labelled = points.select("id", F.col(label).alias("label")).join(cluster(points), "id")
    compared = evaluation.flip(labelled)
    return compared.select("id", "cluster", "adjusted_cluster", "label"), evaluation.original_and_adjusted(labelled)
