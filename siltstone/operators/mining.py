"""Itemsets, rules and related groups over 0/1 matrices.

Rows are first counted by their distinct patterns, with partial aggregation before the shuffle; items and pairs are exploded
from the patterns only. What reaches the driver is a count per column or pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalar import col, positive_items


def transactions(matrix: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(row_id, items): sorted names of the columns that are 1."""
    return matrix.select(row_id, positive_items(sorted(columns)).alias("items"))


def patterns(tx: DataFrame) -> DataFrame:
    """(items, n): distinct transactions with their numbers."""
    return tx.groupBy("items").agg(F.count(F.lit(1)).alias("n"))


def item_counts(tx: DataFrame) -> DataFrame:
    return patterns(tx).select(F.explode("items").alias("item"), "n").groupBy("item").agg(F.sum("n").alias("n"))


def _pairs(gap: int) -> Column:
    """Pairs (a, b) of the sorted items with b at least ``gap`` places after a."""
    tail = lambda i: F.slice("items", i + 1 + gap, F.greatest(F.size("items") - i - gap, F.lit(0)))
    return F.flatten(F.transform("items", lambda a, i: F.transform(tail(i), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def pair_counts(tx: DataFrame, gap: int = 1) -> DataFrame:
    """(a, b, n) with a < b: rows that hold both. Gap 0 adds the single items as pairs (a, a)."""
    return patterns(tx).select("n", F.inline(_pairs(gap))).groupBy("a", "b").agg(F.sum("n").alias("n"))


def frequent_itemsets(tx: DataFrame, min_support: float, max_size: int | None = None, min_size: int = 1) -> DataFrame:
    """(items, n, support): frequent itemsets by FP-growth, items sorted; every level of the level-wise search, or some of them."""
    rows = tx.count()
    if not rows:
        return tx.sparkSession.createDataFrame([], "items array<string>, n long, support double")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, 1e-12)).fit(tx.select("items"))
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))
    size = F.size("items")
    sets = sets.where(size >= min_size)
    if max_size is not None:
        sets = sets.where(size <= max_size)
    return sets.withColumn("support", F.col("n") / F.lit(rows))


def last_level(sets: DataFrame) -> DataFrame:
    """The largest frequent itemsets only."""
    top = sets.agg(F.max(F.size("items"))).first()[0]
    return sets.where(F.size("items") == F.lit(top or 0))


def candidates(frequent: DataFrame) -> DataFrame:
    """(items) of size k from frequent sets of size k - 1 that share all but their last item."""
    n = F.size("items")
    keyed = frequent.select("items", F.array_join(F.slice("items", 1, F.greatest(n - 1, F.lit(1))), "\x1f").alias("p"), n.alias("k"))
    keyed = keyed.withColumn("p", F.when(F.col("k") > 1, F.col("p")).otherwise(F.lit("")))
    left, right = keyed.alias("l"), keyed.alias("r")
    ahead = F.element_at("l.items", -1) < F.element_at("r.items", -1)
    return left.join(right, (F.col("l.p") == F.col("r.p")) & ahead).select(F.array_sort(F.array_union("l.items", "r.items")).alias("items")).distinct()


def antecedents(items: Column) -> Column:
    """Every proper non-empty subset of the column ``items``, from the bits of a counter."""
    masks = F.sequence(F.lit(1).cast("long"), F.expr("shiftleft(1L, size(items))") - 2)
    return F.transform(masks, lambda m: F.filter(items, lambda x, i: F.call_function("getbit", m, i) == 1))


def rules(sets: DataFrame, min_confidence: float, excluded: list[str] | None = None) -> DataFrame:
    """(antecedent, consequent, support, confidence), consequents of any size, from itemsets with all their subsets."""
    key = lambda c: F.array_join(c, "\x1f")
    big = sets.where(F.size("items") > 1).select("items", "n", "support", F.explode(antecedents(F.col("items"))).alias("antecedent"))
    known = sets.select(key("items").alias("k"), F.col("n").alias("base"))
    out = big.withColumn("k", key("antecedent")).join(known, "k").select(
        "antecedent", F.array_except("items", "antecedent").alias("consequent"), "support", (F.col("n") / F.col("base")).alias("confidence")
    )
    if excluded:
        banned = F.array(*map(F.lit, excluded))
        out = out.where(~F.arrays_overlap("antecedent", banned) & ~F.arrays_overlap("consequent", banned))
    return out.where(F.col("confidence") >= min_confidence)


@dataclass(frozen=True)
class Group:
    """A related group at one step of its growth."""

    group_id: int
    seed: str
    step: int
    items: tuple[str, ...]


@dataclass(frozen=True)
class Counts:
    """How often each column, and each pair, is 1."""

    single: dict[str, int]
    pair: dict[tuple[str, str], int]

    def both(self, a: str, b: str) -> int:
        return self.pair.get((min(a, b), max(a, b)), 0)

    def related(self, a: str, b: str, confidence: float) -> bool:
        n = self.both(a, b)
        return self.single[a] > 0 and self.single[b] > 0 and n / self.single[a] >= confidence and n / self.single[b] >= confidence


def collect_counts(tx: DataFrame, columns: list[str]) -> Counts:
    """At most a row per column and per pair of columns, in one pass."""
    rows = pair_counts(tx, gap=0).collect()
    single = dict.fromkeys(columns, 0) | {r["a"]: r["n"] for r in rows if r["a"] == r["b"]}
    return Counts(single, {(r["a"], r["b"]): r["n"] for r in rows if r["a"] != r["b"]})


def related_groups(counts: Counts, confidence: float, snapshots: bool = True) -> list[Group]:
    """Stars around seeds: in name order, each column that no star has taken yet seeds one and takes all columns related to it.

    With snapshots every growth is a group; else the finished stars. A column without any row is a star of its own.
    """
    names, taken, out = sorted(counts.single), set(), []
    for seed in names:
        if seed in taken:
            continue
        star = [seed]
        grown = [tuple(star)]
        for other in names:
            if other != seed and counts.related(seed, other, confidence):
                star.append(other)
                taken.add(other)
                grown.append(tuple(star))
        for step, items in enumerate(grown if snapshots else grown[-1:]):
            out.append(Group(len(out), seed, step, items))
    return out


def groups_frame(spark, groups: list[Group]) -> DataFrame:  # noqa: ANN001
    rows = [(g.group_id, g.seed, g.step, sorted(g.items)) for g in groups]
    return spark.createDataFrame(rows, "group_id int, seed string, step int, items array<string>")


def star_edges(tx: DataFrame, confidence: float) -> DataFrame:
    """(seed, member, n, seed_confidence, member_confidence) of all related pairs, in both directions."""
    single = item_counts(tx)
    pair = pair_counts(tx)
    both = pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return (
        both.join(single.select(F.col("item").alias("a"), F.col("n").alias("na")), "a")
        .join(single.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
        .select(F.col("a").alias("seed"), F.col("b").alias("member"), "n", (F.col("n") / F.col("na")).alias("seed_confidence"), (F.col("n") / F.col("nb")).alias("member_confidence"))
        .where((F.col("seed_confidence") >= confidence) & (F.col("member_confidence") >= confidence))
    )


def stars(tx: DataFrame, columns: list[str], confidence: float) -> DataFrame:
    """(seed, items): the full star of every column, taken or not."""
    seeds = tx.sparkSession.createDataFrame([(c,) for c in columns], "seed string")
    edges = star_edges(tx, confidence).groupBy("seed").agg(F.collect_list("member").alias("m"))
    return seeds.join(edges, "seed", "left").select("seed", F.array_sort(F.concat(F.array("seed"), F.coalesce("m", F.array().cast("array<string>")))).alias("items"))


def size_histogram(groups: DataFrame) -> DataFrame:
    return groups.groupBy(F.size("items").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy("size")


def on_off_transactions(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(row_id, items): names of the columns that are on, from on/off text columns."""
    return df.select(row_id, F.array_compact(F.array(*[F.when(col(c) == "on", F.lit(c)) for c in sorted(columns)])).alias("items"))
