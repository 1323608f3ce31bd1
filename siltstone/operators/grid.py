"""Grid clustering: cells as items, frequent itemsets, rules, and the last matching rule as the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import mining
from siltstone.operators.features import grid_items
from siltstone.operators.graph import cut


def grid_clusters(points: DataFrame, min_support: float = 0.98, min_confidence: float = 0.7, edges: int = 10, max_size: int | None = None) -> DataFrame:
    """(id, cluster). Rules are numbered by size, antecedent and consequent; a row takes the last rule whose antecedent it holds.

    With exactly two rule numbers in use they become 0 and 1, with one it becomes 0; otherwise all rows are noise (-1).
    All rules are matched, by a join of the items of distinct rows with the items of distinct antecedents.
    """
    tx = cut(grid_items(points, edges))
    found = mining.rules(mining.frequent_itemsets(tx, min_support, max_size), min_confidence)
    order = [F.size("antecedent") + F.size("consequent"), F.array_join("antecedent", ","), F.array_join("consequent", ",")]
    # numbers need only ascend with the order
    numbered = cut(found.orderBy(*order).select("antecedent", F.monotonically_increasing_id().alias("rule")))
    last = cut(numbered.groupBy("antecedent").agg(F.max("rule").alias("rule")))
    rows = cut(mining.patterns(tx).select("items", F.monotonically_increasing_id().alias("pattern")))
    wanted = last.select("rule", F.size("antecedent").alias("size"), F.explode("antecedent").alias("item"))
    held = rows.select("pattern", F.explode("items").alias("item")).join(wanted, "item").groupBy("pattern", "rule", "size").agg(F.count(F.lit(1)).alias("n"))
    taken = cut(held.where("n = size").groupBy("pattern").agg(F.max("rule").alias("rule")))
    used = sorted(r["rule"] for r in taken.select("rule").distinct().limit(3).collect())
    if len(used) not in (1, 2):
        return tx.select("id", F.lit(-1).alias("cluster"))
    cluster = F.when(F.col("rule") == used[0], 0)
    if len(used) == 2:
        cluster = cluster.when(F.col("rule") == used[1], 1)
    named = rows.join(taken, "pattern", "left").select("items", cluster.otherwise(-1).cast("int").alias("cluster"))
    return tx.join(named, "items").select("id", "cluster")


def pmafia(points: DataFrame, min_support: float = 0.98) -> DataFrame:
    return grid_clusters(points, min_support)


def fpmafia(points: DataFrame, min_support: float = 0.08, max_size: int | None = None) -> DataFrame:
    return grid_clusters(points, min_support, max_size=max_size)
