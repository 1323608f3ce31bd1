"""The registered queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import scalar as S
from siltstone.operators import blocks, clustering, evaluation, features, grid, mining, signatures
from siltstone.plans import relational  # noqa: F401  registers its queries
from siltstone.operators.graph import cut
from siltstone.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from siltstone.sources import derived as D
from siltstone.sources import files, schemas

CONFIDENCE = 0.7

# --- shared SQL -------------------------------------------------------------------------------------------------------

ITEMS = sorted(D.FLOW)
FLOW = f"WITH RECURSIVE {D.ORDER_FLOW_SQL}"
BINARY = (
    FLOW
    + f""",
b AS (SELECT row_id, CASE WHEN urgent <> 0 OR pending <> 0 OR costly <> 0 THEN 1 ELSE 0 END AS anomal, {", ".join(f"CASE WHEN {c} > 0 THEN 1 ELSE 0 END AS {c}" for c in ITEMS)} FROM flow),
long AS ({" UNION ALL ".join(f"SELECT row_id, anomal, '{c}' AS item FROM b WHERE {c} = 1" for c in ITEMS)}),
names AS (SELECT unnest([{", ".join(f"'{c}'" for c in ITEMS)}]) AS item)"""
)


def _edges_sql(name: str, side: int) -> str:
    return f"""
c{name} AS (SELECT item, count(*) AS n FROM long WHERE anomal = {side} GROUP BY item),
p{name} AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM long x JOIN long y ON x.row_id = y.row_id AND x.item <> y.item WHERE x.anomal = {side} GROUP BY 1, 2),
e{name} AS (SELECT p.a AS seed, p.b AS member, p.n, p.n / ca.n AS seed_confidence, p.n / cb.n AS member_confidence
  FROM p{name} p JOIN c{name} ca ON p.a = ca.item JOIN c{name} cb ON p.b = cb.item)"""


def _stars_sql(name: str, side: int, confidence: float = CONFIDENCE) -> str:
    return f"""{_edges_sql(name, side)},
s{name} AS (SELECT item AS seed, item FROM names UNION ALL SELECT seed, member FROM e{name} WHERE seed_confidence >= {confidence} AND member_confidence >= {confidence}),
g{name} AS (SELECT CAST(row_number() OVER (ORDER BY seed) - 1 AS INT) AS group_id, seed, string_agg(item, ',' ORDER BY item) AS items, count(*) AS size FROM s{name} GROUP BY seed)"""


def _groups_sql(name: str, side: int, confidences: str) -> str:
    """The related groups with their snapshots at every threshold t of the list: g (t, group_id, seed, step, items, size) and s (t, group_id, item).

    In name order a column seeds a group unless an earlier seed has taken it, and takes all columns related to it, one a step.
    """
    return f"""{_edges_sql(name, side)},
t{name} AS (SELECT unnest({confidences}) AS t),
m{name} AS (SELECT t, n.item AS seed, row_number() OVER (PARTITION BY t ORDER BY n.item) AS place, coalesce(list(e.member ORDER BY e.member) FILTER (e.member IS NOT NULL), []) AS m
  FROM t{name} CROSS JOIN names n LEFT JOIN e{name} e ON e.seed = n.item AND e.seed_confidence >= t AND e.member_confidence >= t GROUP BY t, n.item),
w{name}(t, place, taken, fresh) AS (SELECT t, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false FROM t{name}
  UNION ALL SELECT m.t, m.place, CASE WHEN list_contains(w.taken, m.seed) THEN w.taken ELSE list_concat(w.taken, m.m) END, NOT list_contains(w.taken, m.seed) FROM w{name} w JOIN m{name} m ON m.t = w.t AND m.place = w.place + 1),
k{name} AS (SELECT w.t, w.place, m.seed, unnest(generate_series(0, len(m.m))) AS step, m.m FROM w{name} w JOIN m{name} m ON m.t = w.t AND m.place = w.place WHERE w.fresh),
g{name} AS (SELECT t, CAST(row_number() OVER (PARTITION BY t ORDER BY place, step) - 1 AS INT) AS group_id, seed, CAST(step AS INT) AS step, list_prepend(seed, m[1:step]) AS xs,
  array_to_string(list_sort(list_prepend(seed, m[1:step])), ',') AS items, CAST(step + 1 AS BIGINT) AS size FROM k{name}),
s{name} AS (SELECT t, group_id, unnest(xs) AS item FROM g{name})"""


ONE = f"[CAST({CONFIDENCE} AS DOUBLE)]"
GROUPS = f"{BINARY},{_groups_sql('1', 1, ONE)}"
CELLS = f"""{GROUPS},
hit AS (SELECT s.group_id, l.row_id, l.anomal FROM s1 s JOIN long l ON l.item = s.item JOIN g1 g ON g.group_id = s.group_id GROUP BY s.group_id, l.row_id, l.anomal, g.size HAVING count(*) = g.size),
total AS (SELECT CAST(sum(anomal) AS BIGINT) AS p, CAST(sum(1 - anomal) AS BIGINT) AS n FROM b),
cells AS (SELECT g.group_id, coalesce(CAST(sum(h.anomal) AS BIGINT), 0) AS TP, any_value(p) - coalesce(CAST(sum(h.anomal) AS BIGINT), 0) AS FP,
  any_value(n) - coalesce(CAST(sum(1 - h.anomal) AS BIGINT), 0) AS TN, coalesce(CAST(sum(1 - h.anomal) AS BIGINT), 0) AS FN
  FROM g1 g CROSS JOIN total LEFT JOIN hit h ON g.group_id = h.group_id GROUP BY g.group_id)"""


def _metrics_sql(source: str, keep: str) -> str:
    return f"""SELECT {keep}, accuracy, precision, recall, tnr, fpr, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
  SELECT *, CASE WHEN TP + FP + TN + FN > 0 THEN (TP + TN) / (TP + FP + TN + FN) ELSE 0 END AS accuracy, CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0 END AS precision,
    CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0 END AS recall, CASE WHEN TN + FP > 0 THEN TN / (TN + FP) ELSE 0 END AS tnr, CASE WHEN TN + FP > 0 THEN FP / (TN + FP) ELSE 0 END AS fpr FROM {source})"""


METRICS = f"{CELLS}, m AS ({_metrics_sql('cells', 'group_id, TP, FP, TN, FN')})"
ROUNDED = "round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- shared plans -----------------------------------------------------------------------------------------------------


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = D.order_flow(spark, sf_dir)
    return S.binarize(flow.withColumn("anomal", S.any_nonzero(D.STAGES)), ["row_id", "anomal"], ITEMS)


def baskets(spark: SparkSession, sf_dir: str, anomal: int | None = 1) -> DataFrame:
    rows = matrix(spark, sf_dir)
    return mining.transactions(rows if anomal is None else rows.where(F.col("anomal") == anomal), "row_id", ITEMS)


def groups(spark: SparkSession, sf_dir: str, confidence: float = CONFIDENCE, anomal: int = 1) -> list[mining.Group]:
    """Related groups of one side with the snapshots of their growth."""
    return mining.related_groups(mining.collect_counts(baskets(spark, sf_dir, anomal), ITEMS), confidence)


def _listed(found: list[mining.Group]) -> list[tuple[int, list[str]]]:
    return [(g.group_id, list(g.items)) for g in found]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.confusion(matrix(spark, sf_dir), _listed(groups(spark, sf_dir)))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.metrics(_cells(spark, sf_dir))


def _joined(items: str = "items") -> Column:
    return F.array_join(items, ",")


# --- labels and discretizing ------------------------------------------------------------------------------------------


@query(f"{FLOW} SELECT row_id, CASE WHEN urgent <> 0 OR pending <> 0 OR costly <> 0 THEN 1 ELSE 0 END AS anomal FROM flow")
def label_any_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.order_flow(spark, sf_dir).select("row_id", S.any_nonzero(D.STAGES).alias("anomal"))


@query(f"{FLOW} SELECT row_id, CASE WHEN urgent <> 0 OR pending <> 0 OR costly <> 0 THEN 0 ELSE 1 END AS nomal FROM flow")
def label_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.order_flow(spark, sf_dir).select("row_id", S.none_nonzero(D.STAGES).alias("nomal"))


@query(f"{FLOW} SELECT row_id, CASE WHEN urgent > 0 OR pending > 0 OR costly > 0 THEN 1 ELSE 0 END AS anomal FROM flow")
def label_any_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.order_flow(spark, sf_dir).select("row_id", S.any_positive(D.STAGES).alias("anomal"))


@query(f"{BINARY} SELECT * FROM b")
def binarize_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir)


@query(f"{FLOW} SELECT row_id, {', '.join(f'''CASE WHEN {c} > 0 THEN 'on' ELSE 'off' END AS {c}''' for c in ITEMS)} FROM flow")
def on_off_discretize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.order_flow(spark, sf_dir).select("row_id", *[S.on_off(F.col(c)).alias(c) for c in ITEMS])


@query(f"{FLOW} SELECT row_id, {', '.join(f'''CASE WHEN {c} = 0 THEN 'off' ELSE 'on' END AS {c}''' for c in ITEMS)} FROM flow")
def on_off_zero_discretize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.order_flow(spark, sf_dir).select("row_id", *[S.on_off_zero(F.col(c)).alias(c) for c in ITEMS])


@query(f"{BINARY} SELECT b.row_id, coalesce(i.items, '') AS items FROM b LEFT JOIN (SELECT row_id, string_agg(item, ',' ORDER BY item) AS items FROM long GROUP BY row_id) i ON b.row_id = i.row_id")
def positive_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baskets(spark, sf_dir, None).select("row_id", _joined().alias("items"))


@query(
    f"{BINARY} SELECT row_id FROM b WHERE ret_r = 1 AND line_o = 1 AND bulk = 1"
)
def rows_holding_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.array(*map(F.lit, ["ret_r", "line_o", "bulk"]))
    return baskets(spark, sf_dir, None).where(S.contains_all(F.col("items"), group)).select("row_id")


# --- mining -----------------------------------------------------------------------------------------------------------


@query(f"{BINARY} SELECT item, count(*) AS n FROM long WHERE anomal = 1 GROUP BY item")
def item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.item_counts(baskets(spark, sf_dir))


@query(f"{BINARY} SELECT x.item AS a, y.item AS b, count(*) AS n FROM long x JOIN long y ON x.row_id = y.row_id AND x.item < y.item WHERE x.anomal = 1 GROUP BY 1, 2")
def pair_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.pair_counts(baskets(spark, sf_dir))


SETS = f"""{BINARY}, t AS (SELECT row_id, item FROM long WHERE anomal = 1), r AS (SELECT CAST(sum(anomal) AS BIGINT) AS n FROM b),
sets AS (SELECT item AS items, 1 AS k, count(*) AS n FROM t GROUP BY item
  UNION ALL SELECT x.item || ',' || y.item, 2, count(*) FROM t x JOIN t y ON x.row_id = y.row_id AND x.item < y.item GROUP BY 1
  UNION ALL SELECT x.item || ',' || y.item || ',' || z.item, 3, count(*) FROM t x JOIN t y ON x.row_id = y.row_id AND x.item < y.item JOIN t z ON x.row_id = z.row_id AND y.item < z.item GROUP BY 1),
freq AS (SELECT items, k, sets.n, sets.n / r.n AS support FROM sets, r WHERE sets.n / r.n >= 0.5)"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.frequent_itemsets(baskets(spark, sf_dir), 0.5, max_size=3)


@query(f"{SETS} SELECT items, n, round(support, 6) AS support FROM freq WHERE k = 2")
def itemset_support_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).where(F.size("items") == 2).select(_joined().alias("items"), "n", F.round("support", 6).alias("support"))


@query(f"{SETS} SELECT items, n, round(support, 6) AS support FROM freq WHERE k = 3")
def itemset_support_l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).where(F.size("items") == 3).select(_joined().alias("items"), "n", F.round("support", 6).alias("support"))


@query(f"{SETS} SELECT items, n, round(support, 6) AS support FROM freq WHERE k = (SELECT max(k) FROM freq)")
def itemsets_last_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.last_level(_sets(spark, sf_dir)).select(_joined().alias("items"), "n", F.round("support", 6).alias("support"))


@query(
    f"""{SETS}, l AS (SELECT items, string_split(items, ',') AS xs, n, k, support FROM freq WHERE k > 1),
ante AS (SELECT items, xs, n, support, list_filter(xs, lambda x: list_contains(a, x)) AS a FROM (SELECT l.*, f.xs AS a FROM l, (SELECT string_split(items, ',') AS xs, k AS fk FROM freq) f WHERE f.fk < l.k AND list_has_all(l.xs, f.xs)))
SELECT array_to_string(a, ',') AS antecedent, array_to_string(list_filter(ante.xs, lambda x: NOT list_contains(a, x)), ',') AS consequent, round(ante.support, 6) AS support, round(ante.n / f.n, 6) AS confidence
FROM ante JOIN freq f ON f.items = array_to_string(a, ',') WHERE ante.n / f.n >= 0.7"""
)
def assoc_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.rules(_sets(spark, sf_dir), 0.7)
    return found.select(_joined("antecedent").alias("antecedent"), _joined("consequent").alias("consequent"), F.round("support", 6).alias("support"), F.round("confidence", 6).alias("confidence"))


@query(f"{BINARY},{_stars_sql('1', 1)} SELECT seed, member, n, round(seed_confidence, 6) AS seed_confidence, round(member_confidence, 6) AS member_confidence FROM e1 WHERE seed_confidence >= 0.7 AND member_confidence >= 0.7")
def related_star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mining.star_edges(baskets(spark, sf_dir), CONFIDENCE), "seed_confidence", "member_confidence")


@query(f"{BINARY},{_stars_sql('1', 1)} SELECT seed, items FROM g1")
def star_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.stars(baskets(spark, sf_dir), ITEMS, CONFIDENCE).select("seed", _joined().alias("items"))


@query(f"{GROUPS} SELECT group_id, seed, step, items FROM g1")
def related_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.groups_frame(spark, groups(spark, sf_dir)).select("group_id", "seed", "step", _joined().alias("items"))


def _threshold_query(confidence: float) -> None:
    name = f"related_groups_{round(confidence * 100)}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return mining.groups_frame(spark, groups(spark, sf_dir, confidence)).select("group_id", "seed", "step", _joined().alias("items"))

    run.__name__ = name
    query(f"{BINARY},{_groups_sql('1', 1, f'[CAST({confidence} AS DOUBLE)]')} SELECT group_id, seed, step, items FROM g1")(run)


for _confidence in (0.8, 0.9):
    _threshold_query(_confidence)


@query(f"{GROUPS} SELECT group_id, seed, items FROM (SELECT CAST(row_number() OVER (ORDER BY group_id) - 1 AS INT) AS group_id, seed, items FROM (SELECT *, max(step) OVER (PARTITION BY seed) AS last FROM g1) WHERE step = last)")
def related_groups_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.related_groups(mining.collect_counts(baskets(spark, sf_dir), ITEMS), CONFIDENCE, snapshots=False)
    return mining.groups_frame(spark, found).select("group_id", "seed", _joined().alias("items"))


@query(f"{GROUPS} SELECT CAST(size AS INT) AS size, count(*) AS n FROM g1 GROUP BY size")
def group_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.size_histogram(mining.groups_frame(spark, groups(spark, sf_dir)))


# --- signatures -------------------------------------------------------------------------------------------------------


@query(f"{CELLS} SELECT * FROM cells")
def signature_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query(f"{METRICS} SELECT group_id, TP, FP, TN, FN, {ROUNDED}, round(tnr, 6) AS tnr, round(fpr, 6) AS fpr FROM m")
def signature_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scored(spark, sf_dir), "accuracy", "precision", "recall", "f1", "tnr", "fpr")


@query(f"{METRICS} SELECT group_id, round(precision, 6) AS precision, round(recall, 6) AS recall FROM m ORDER BY m.precision DESC, group_id LIMIT 5")
def signature_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(signatures.top(_scored(spark, sf_dir), 5), "precision", "recall").select("group_id", "precision", "recall")


@query(
    f"""{METRICS}, best AS (SELECT * FROM m ORDER BY m.precision DESC, group_id LIMIT 5)
SELECT CAST(group_id AS VARCHAR) AS eva_row, round(precision, 6) AS precision FROM best UNION ALL SELECT 'Precision Mean', round(avg(precision), 6) FROM best"""
)
def signature_top5_with_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(signatures.top_with_mean(_scored(spark, sf_dir), 5), "precision")


@query(
    f"""{GROUPS}, pick AS (SELECT * FROM g1 WHERE group_id IN (0, 3, 5)),
hit AS (SELECT g.group_id, l.row_id FROM pick g JOIN s1 s ON g.group_id = s.group_id JOIN long l ON l.item = s.item AND l.anomal = 1 GROUP BY g.group_id, l.row_id, g.size HAVING count(*) = g.size),
q AS (SELECT CAST((SELECT count(*) FROM hit) AS BIGINT) AS TP, CAST((SELECT sum(anomal) FROM b) * (SELECT count(*) FROM pick) - (SELECT count(*) FROM hit) AS BIGINT) AS FP)
SELECT TP, FP, CAST(0 AS BIGINT) AS TN, CAST(0 AS BIGINT) AS FN, round(TP / (TP + FP), 6) AS precision, CAST(CASE WHEN TP > 0 THEN 1 ELSE 0 END AS DOUBLE) AS recall FROM q"""
)
def selected_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = [g for g in _listed(groups(spark, sf_dir)) if g[0] in (0, 3, 5)]
    return _rounded(signatures.selected(matrix(spark, sf_dir), chosen), "precision", "recall")


THRESHOLDS = "list_transform(generate_series(0, 17), lambda i: CAST(round(0.1 + i * 0.05, 10) AS DOUBLE))"
SWEEP = f"""{BINARY},{_groups_sql("1", 1, THRESHOLDS)},
hit AS (SELECT g.t, g.group_id, l.row_id, l.anomal FROM g1 g JOIN s1 s ON g.group_id = s.group_id AND g.t = s.t JOIN long l ON l.item = s.item GROUP BY g.t, g.group_id, l.row_id, l.anomal, g.size HAVING count(*) = g.size),
total AS (SELECT sum(anomal) AS p, sum(1 - anomal) AS n FROM b), many AS (SELECT t, count(*) AS k FROM g1 GROUP BY t),
ht AS (SELECT t, CAST(sum(anomal) AS BIGINT) AS a, CAST(sum(1 - anomal) AS BIGINT) AS c FROM hit GROUP BY t),
cells AS (SELECT many.t AS confidence, coalesce(a, 0) AS TP, CAST(k * p AS BIGINT) - coalesce(a, 0) AS FP, CAST(k * n AS BIGINT) - coalesce(c, 0) AS TN, coalesce(c, 0) AS FN FROM many CROSS JOIN total LEFT JOIN ht ON many.t = ht.t),
m AS ({_metrics_sql("cells", "confidence")}),
scored AS (SELECT *, 0.15 * accuracy + 0.65 * precision + 0.15 * recall + 0.05 * f1 AS total_score FROM m)"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = mining.collect_counts(baskets(spark, sf_dir), ITEMS)
    return signatures.sweep(matrix(spark, sf_dir), {t: _listed(mining.related_groups(counts, t)) for t in signatures.thresholds()})


@query(f"{SWEEP} SELECT confidence, {ROUNDED}, round(total_score, 6) AS total_score FROM scored")
def confidence_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_sweep(spark, sf_dir), "accuracy", "precision", "recall", "f1", "total_score")


@query(f"{SWEEP} SELECT confidence, round(total_score, 6) AS total_score FROM scored ORDER BY scored.total_score DESC, confidence LIMIT 1")
def confidence_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.best(_sweep(spark, sf_dir)).select("confidence", F.round("total_score", 6).alias("total_score"))


@query(
    f"""{METRICS}, sizes AS (SELECT unnest([10, 1, 0.1, 0.01, 0.001, 0.0001, 0.00001, 0.000001]) AS r),
o AS (SELECT -r + i * 0.01 AS o FROM sizes, generate_series(0, 2001) x(i) WHERE i < ceil((2 * r + 0.01) / 0.01 - 1e-9))
SELECT group_id, round(0.7 + o / 100, 6) AS confidence, round(0.45 * accuracy + 0.35 * precision + 0.15 * recall + 0.05 * f1, 6) AS total_score FROM m, o"""
)
def confidence_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(signatures.confidence_grid(_scored(spark, sf_dir)), "confidence", "total_score")


DIFFERENCE = f"""{BINARY},{_groups_sql("1", 1, ONE)},{_groups_sql("0", 0, ONE)},
d AS (SELECT x.group_id AS ga, y.group_id AS gb, list_sort(list_filter(x.xs, lambda i: NOT list_contains(y.xs, i))) AS items FROM g1 x, g0 y)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A count of columns and pairs a side; the groups follow from those."""
    return tuple(mining.groups_frame(spark, groups(spark, sf_dir, anomal=s)) for s in (1, 0))


@query(f"{DIFFERENCE} SELECT DISTINCT unnest(items) AS item FROM d")
def group_difference_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.difference_items(*_sides(spark, sf_dir))


@query(f"{DIFFERENCE} SELECT DISTINCT array_to_string(items, ',') AS items FROM d WHERE len(items) > 0")
def group_difference_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.difference_sets(*_sides(spark, sf_dir)).select(_joined().alias("items"))


# --- lookups, text and array features ---------------------------------------------------------------------------------


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS label FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) ON c_nationkey = n_nationkey")
def annotation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = D.table(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return files.attach_labels(D.table(spark, sf_dir, "customer"), notes, "c_nationkey").select("c_custkey", "label")


@query("SELECT c_custkey, " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0 ELSE 0.0 END::DOUBLE AS {s.lower()}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = D.table(spark, sf_dir, "customer")
    values = features.categories(customers, "c_mktsegment")
    return customers.select("c_custkey", *[c.alias(v.lower()) for c, v in zip(features.one_hot("c_mktsegment", values), values, strict=True)])


@query(
    """SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS price,
round((o_custkey - (SELECT avg(o_custkey) FROM orders)) / (SELECT stddev_pop(o_custkey) FROM orders), 6) AS customer, CAST(0 AS DOUBLE) AS constant FROM orders"""
)
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = D.table(spark, sf_dir, "orders").withColumn("one", F.lit(1))
    m = features.moments(orders, ["o_totalprice", "o_custkey", "one"])
    scaled = lambda c: F.round(features.scaled(F.col(c), *m[c]), 6)
    return orders.select("o_orderkey", scaled("o_totalprice").alias("price"), scaled("o_custkey").alias("customer"), scaled("one").alias("constant"))


def _wide_table(layout: str) -> tuple[list[str], str, list[str]]:
    """Columns of a layout, SQL of a table that has them over orders, and SQL of the layout's vector, number by number."""
    spec = schemas.flow_spec(layout)
    columns = [c for b in spec.blocks for c in b.columns]
    kinds = {c: b.kind for b in spec.blocks for c in b.columns}
    made = []
    for i, c in enumerate(columns):
        value = {"onehot": "o_orderkey % 5", "plain": f"(o_orderkey + {i}) % 2", "scale": f"o_custkey * {i % 7 + 1} % {31 + i} + o_totalprice / {1000 * (i + 1)}"}[kinds[c]]
        # one column without variance, and values that are absent here and there
        value = "3" if c == columns[3] else f"CASE WHEN o_orderkey % 97 = {i + 1} THEN NULL ELSE {value} END" if i % 11 == 5 else value
        made.append(f"CAST({value} AS DOUBLE) AS {{q}}{c}{{q}}")
    source = f"SELECT o_orderkey AS id, {', '.join(made)} FROM orders"
    parts = []
    for c in columns:
        if kinds[c] == "onehot":
            parts += [f"CASE WHEN {{q}}{c}{{q}} = {v} THEN 1.0 ELSE 0.0 END" for v in range(5)]
        elif kinds[c] == "scale":
            parts.append(f"CASE WHEN stddev_pop({{q}}{c}{{q}}) OVER () > 0 AND {{q}}{c}{{q}} IS NOT NULL THEN ({{q}}{c}{{q}} - avg({{q}}{c}{{q}}) OVER ()) / stddev_pop({{q}}{c}{{q}}) OVER () ELSE 0.0 END")
        else:
            parts.append(f"coalesce({{q}}{c}{{q}}, 0.0)")
    return columns, source, parts


def _layout_query(layout: str) -> None:
    _, source, parts = _wide_table(layout)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        D.table(spark, sf_dir, "orders").createOrReplaceTempView("siltstone_orders")
        rows = spark.sql(source.replace("{q}", "`").replace("FROM orders", "FROM siltstone_orders"))
        built = cut(features.build(rows, schemas.flow_spec(layout), "id"))
        return built.select("id", *[F.round(F.col("v")[i], 5).alias(f"f{i}") for i in range(len(parts))])

    run.__name__ = f"layout_{layout}"
    numbers = ", ".join(f"round(CAST({p} AS DOUBLE), 5) AS f{i}" for i, p in enumerate(parts))
    query(f"WITH t AS ({source}) SELECT id, {numbers} FROM t".replace("{q}", '"'))(run)


for _layout in ("a", "b", "c", "d", "port", "protocol", "window"):
    _layout_query(_layout)


USERS = "WITH u AS (SELECT user_id AS row_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}_n" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id)"
COUNTS = ["click_n", "error_n", "purchase_n", "signup_n", "view_n"]
BINS = f"""{USERS}, r AS (SELECT min(least({", ".join(COUNTS)})) AS lo, max(greatest({", ".join(COUNTS)})) AS hi FROM u)"""


def _bin(c: str) -> str:
    return f"CAST(CASE WHEN {c} >= hi THEN 10 ELSE least(9, floor(({c} - lo) / ((hi - lo) / 9)) + 1) END AS INT)"


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.user_flow(spark, sf_dir).select(F.col("row_id").alias("id"), F.array(*[F.col(c).cast("double") for c in COUNTS]).alias("v"))


@query(f"{BINS} SELECT row_id AS id, {', '.join(f'{_bin(c)} AS {c}' for c in COUNTS)} FROM u, r")
def digitize_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _users(spark, sf_dir)
    bins = features.digitize(F.col("v"), *features.value_range(users))
    return users.select("id", *[bins[i].alias(c) for i, c in enumerate(COUNTS)])


@query(f"{BINS} SELECT row_id AS id, {' || chr(44) || '.join(f'''{chr(39)}Feature_{i}_{chr(39)} || {_bin(c)}''' for i, c in enumerate(COUNTS))} AS items FROM u, r")
def grid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.grid_items(_users(spark, sf_dir)).select("id", _joined().alias("items"))


@query("SELECT page_id, CAST(length(url) AS INT) AS n_characters, CAST(len(list_distinct(string_split(url, ''))) AS INT) AS n_distinct, string_split(url, '.')[-1] AS last_token FROM pages")
def string_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return D.table(spark, sf_dir, "pages").select("page_id", S.text_length(url).alias("n_characters"), S.distinct_characters(url).alias("n_distinct"), S.last_token(url).alias("last_token"))


@query("SELECT page_id, array_to_string(string_split_regex(url, '[/?]'), ' ') AS tokens FROM pages")
def url_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "pages").select("page_id", F.array_join(S.uri_tokens(F.col("url")), " ").alias("tokens"))


@query("SELECT event_id, CAST(2 AS INT) AS n, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 1.5 AS mean FROM events")
def json_array_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit("["), k, F.lit(","), (k.cast("int") * 2).cast("string"), F.lit("]"))
    return D.table(spark, sf_dir, "events").select("event_id", S.array_length(text).alias("n"), S.array_mean(text).alias("mean"))


@query("SELECT event_type, CAST(row_number() OVER (ORDER BY first, event_type) - 1 AS INT) AS code FROM (SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type)")
def label_encode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_seen_codes(D.table(spark, sf_dir, "events"), "event_type", "event_id")


@query(
    """WITH t AS (SELECT page_id, unnest(regexp_extract_all(lower(url), '\\w\\w+')) AS term FROM pages), tf AS (SELECT page_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), w AS (SELECT page_id, tf.term, tf * (ln((1 + (SELECT count(*) FROM pages)) / (1.0 + df)) + 1) AS w FROM tf JOIN df ON tf.term = df.term)
SELECT page_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY page_id)), 6) AS weight FROM w"""
)
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.tfidf(D.table(spark, sf_dir, "pages"), "page_id", features.word_tokens(F.col("url"))), "weight")


@query(
    """WITH x AS (SELECT CASE event_id % 10 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE WHEN 3 THEN NULL ELSE value END AS x, value FROM events)
SELECT 'x' AS "column", count(*) - count(x) AS nulls, count(*) FILTER (isnan(x)) AS nans, count(*) FILTER (isinf(x)) AS infinities FROM x
UNION ALL SELECT 'value', count(*) - count(value), count(*) FILTER (isnan(value)), count(*) FILTER (isinf(value)) FROM x"""
)
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = {0: "NaN", 1: "Infinity", 2: "-Infinity"}
    x = F.when(F.col("event_id") % 10 == 3, F.lit(None)).otherwise(F.col("value"))
    for k, v in odd.items():
        x = F.when(F.col("event_id") % 10 == k, F.lit(v).cast("double")).otherwise(x)
    return S.missing_report(D.table(spark, sf_dir, "events").select(x.alias("x"), "value"), ["x", "value"])


@query("SELECT least(n_nationkey, n_regionkey) AS src, greatest(n_nationkey, n_regionkey) AS dst, max_by(n_name, n_nationkey) AS n_name FROM nation GROUP BY 1, 2")
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.edges(D.table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey", "n_nationkey", ["n_name"])


# --- neighbours and clusters ------------------------------------------------------------------------------------------

NEAR = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
d AS (SELECT a.id, b.id AS neighbour, b.label, round(list_distance(a.v, b.v), 9) AS distance FROM e a, e b WHERE a.id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d)"""


def _queries(points: DataFrame) -> DataFrame:
    return points.where("id % 100 = 0")


@query(f"{NEAR} SELECT id, neighbour, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5")
def knn5(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.points(spark, sf_dir)
    return blocks.nearest(_queries(points), points, 5).select("id", "neighbour", F.round("distance", 6).alias("distance"), "rank")


@query(f"{NEAR} SELECT id, min(neighbour) AS prediction FROM k WHERE rank <= 5 GROUP BY id")
def knn_min_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.points(spark, sf_dir)
    return clustering.least_neighbour(points, _queries(points), 5)


@query(
    f"""{NEAR}, v AS (SELECT id, label, count(*) AS n FROM k WHERE rank <= 3 GROUP BY id, label)
SELECT id, CAST(label AS BIGINT) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM v) WHERE r = 1"""
)
def knn3_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.points(spark, sf_dir)
    return clustering.knn_vote(points, _queries(points), 3)


CENTERS = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM x GROUP BY label, i) GROUP BY label)"""


@query(
    f"{CENTERS} SELECT id, CAST(label AS INT) AS cluster FROM (SELECT e.id, c.label, row_number() OVER (PARTITION BY e.id ORDER BY round(list_distance(e.v, c.c), 9), c.label) AS r FROM e, c) WHERE r = 1"
)
def nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.points(spark, sf_dir)
    rows = points.groupBy("tag").agg(*[F.avg(F.col("v")[i]) for i in range(64)]).orderBy("tag").collect()
    tags = [r["tag"] for r in rows]
    found = clustering.nearest_center(points, np.array([list(r)[1:] for r in rows], float))
    return found.select("id", F.element_at(F.array(*map(F.lit, tags)), F.col("cluster") + 1).cast("int").alias("cluster"))


EPS, LEAST = 1.15, 5
DENSE = f"""WITH RECURSIVE e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b FROM e a, e b WHERE list_distance(a.v, b.v) <= {EPS}),
n AS (SELECT a AS id, count(*) AS n FROM p GROUP BY a), core AS (SELECT id FROM n WHERE n >= {LEAST}),
cp AS (SELECT a, b FROM p WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT cp.b, reach.root FROM reach JOIN cp ON cp.a = reach.id),
root AS (SELECT id, min(root) AS root FROM reach GROUP BY id), named AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM root),
border AS (SELECT p.a AS id, min(named.cluster) AS cluster FROM p JOIN named ON p.b = named.id WHERE p.a NOT IN (SELECT id FROM core) GROUP BY p.a)"""


@query(f"{DENSE} SELECT id, n, n >= {LEAST} AS core FROM n")
def dbscan_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.within(D.points(spark, sf_dir), EPS).select("id", "n", (F.col("n") >= LEAST).alias("core"))


@query(f"{DENSE} SELECT e.id, CAST(coalesce(named.cluster, border.cluster, -1) AS INT) AS cluster, named.id IS NOT NULL AS core FROM e LEFT JOIN named ON e.id = named.id LEFT JOIN border ON e.id = border.id")
def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.dbscan(D.points(spark, sf_dir), EPS, LEAST)


@query(f"{DENSE} SELECT id FROM e WHERE id NOT IN (SELECT id FROM core) AND id NOT IN (SELECT id FROM border)")
def dbscan_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.dbscan(D.points(spark, sf_dir), EPS, LEAST).where("cluster = -1").select("id")


def _first_two(points: DataFrame, d: int | None = None) -> np.ndarray:
    rows = points.where("id in (0, 1)").orderBy("id").collect()
    return np.array([r["v"][:d] for r in rows], float)


FUZZY = """WITH e AS (SELECT vec_id AS id, (embedding::DOUBLE[]){cut} AS v FROM embeddings), c AS (SELECT id AS k, v AS c FROM e WHERE id IN (0, 1)),
d AS (SELECT e.id, c.k, greatest(list_distance(e.v, c.c), 2.220446049250313e-16) AS d FROM e, c),
u AS (SELECT id, k, pow(pow(d, -2) / sum(pow(d, -2)) OVER (PARTITION BY id), 2) AS u FROM d),
x AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM e),
m AS (SELECT k, i, sum(u * x) / sum(u) AS m FROM u JOIN x ON u.id = x.id GROUP BY k, i)"""


def _cells_of(spark: SparkSession, a: np.ndarray, names: list[str]) -> DataFrame:
    rows = [(*map(int, at), round(float(a[at]), 6)) for at in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", value double")


@query(FUZZY.replace("{cut}", "") + " SELECT CAST(k AS INT) AS cluster, CAST(i AS INT) AS i, round(m, 6) AS value FROM m")
def fcm_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.points(spark, sf_dir)
    return _cells_of(spark, clustering.fcm_step(points, _first_two(points)), ["cluster", "i"])


@query(
    FUZZY.replace("{cut}", "[1:2]")
    + """, s AS (SELECT u.k, a.i AS i, b.i AS j, sum(u.u * (a.x - ma.m) * (b.x - mb.m)) / sum(u.u) AS s FROM u JOIN x a ON u.id = a.id JOIN x b ON u.id = b.id JOIN m ma ON ma.k = u.k AND ma.i = a.i JOIN m mb ON mb.k = u.k AND mb.i = b.i GROUP BY 1, 2, 3),
t AS (SELECT k, sqrt(max(s) FILTER (i = 0 AND j = 0) * max(s) FILTER (i = 1 AND j = 1) - pow(max(s) FILTER (i = 0 AND j = 1), 2)) AS t FROM s GROUP BY k)
SELECT CAST(s.k AS INT) AS cluster, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(s / t, 6) AS value FROM s JOIN t ON s.k = t.k"""
)
def gk_covariance_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.points(spark, sf_dir).withColumn("v", F.slice("v", 1, 2))
    start = _first_two(points)
    return _cells_of(spark, clustering.gk_step(points, start, np.stack([np.eye(2)] * 2))[1], ["cluster", "i", "j"])


@query(
    """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT s.id AS k, e.id, e.v FROM e, e s WHERE s.id IN (0, 1) AND list_distance(e.v, s.v) <= 1.3),
x AS (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM n) SELECT CAST(k AS INT) AS seed, CAST(i AS INT) AS i, round(avg(x), 6) AS value FROM x GROUP BY k, i"""
)
def meanshift_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.points(spark, sf_dir)
    return _cells_of(spark, clustering.mean_shift_step(points, _first_two(points), 1.3)[0], ["seed", "i"])


PAIRS = "WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), s AS (SELECT a.id, a.label AS own, b.label AS tag, sum(list_distance(a.v, b.v)) AS total, count(*) AS n FROM e a, e b GROUP BY 1, 2, 3)"


@query(f"{PAIRS} SELECT CAST(own AS BIGINT) AS tag, id, round(total, 5) AS total FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY round(total, 9), id) AS r FROM s WHERE own = tag) WHERE r = 1")
def medoid_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.points(spark, sf_dir)
    own = blocks.group_sums(points, points).join(points.select("id", F.col("tag").alias("own")), "id").where("tag = own")
    best = own.groupBy("tag").agg(F.min(F.struct(F.round("total", 9).alias("total"), "id")).alias("r"))
    return best.select("tag", "r.id", F.round("r.total", 5).alias("total"))


@query(
    f"""{PAIRS}, g AS (SELECT id, own, max(CASE WHEN own = tag THEN total / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> tag THEN total / n END) AS b FROM s GROUP BY id, own)
SELECT id, CAST(own AS BIGINT) AS cluster, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS s FROM g"""
)
def silhouette_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.silhouette(D.points(spark, sf_dir).withColumnRenamed("tag", "cluster")), "s")


def _scaled_users(spark: SparkSession, sf_dir: str, axes: int | None = 3) -> DataFrame:
    """Scaled event counts of users, on ``axes`` axes, written once for the iterations that read them."""
    flow = D.user_flow(spark, sf_dir)
    spec = features.FeatureSpec((features.Block("scale", tuple(c for c in flow.columns if c != "row_id")),))
    points = features.build(flow, spec, "row_id")
    return cut(features.pca(cut(points), axes) if axes else points)


@query()
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.kmeans(_scaled_users(spark, sf_dir, 5), 2)


@query()
def gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.gmm(_scaled_users(spark, sf_dir), 2)


@query()
def gmm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.gmm_search(_scaled_users(spark, sf_dir))


@query()
def elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.elbow(_scaled_users(spark, sf_dir, None))


@query()
def fuzzy_cmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.fuzzy_cmeans(_scaled_users(spark, sf_dir), 2)[0].select("id", "cluster")


@query()
def gustafson_kessel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.gustafson_kessel(_scaled_users(spark, sf_dir), 2)[0]


@query()
def spherical_gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.spherical_gmm(_scaled_users(spark, sf_dir), 2)


@query()
def kmedoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.kmedoids(_scaled_users(spark, sf_dir, None), 2)


@query()
def mean_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.mean_shift(_scaled_users(spark, sf_dir), 2.0)


@query()
def neural_gas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.neural_gas(_scaled_users(spark, sf_dir))


@query()
def agglomerative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.agglomerative(_scaled_users(spark, sf_dir), 2)


GRID_POINTS = {"x0": "CASE WHEN o_orderkey % 60 = 0 THEN 9.0 ELSE 0.5 END", "x1": "3.2", "x2": "o_custkey % 9", "x3": "CASE WHEN o_orderkey % 70 = 1 THEN 9.0 ELSE 6.5 END"}


@query(
    f"""WITH p AS (SELECT o_orderkey AS id, {", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in GRID_POINTS.items())} FROM orders),
r AS (SELECT min(least(x0, x1, x2, x3)) AS lo, max(greatest(x0, x1, x2, x3)) AS hi, count(*) AS n FROM p),
long AS ({" UNION ALL ".join(f"SELECT id, 'Feature_{i}_' || {_bin(k)} AS item FROM p, r" for i, k in enumerate(GRID_POINTS))}),
f AS (SELECT item, count(*) AS c FROM long GROUP BY item HAVING count(*) >= 0.98 * (SELECT n FROM r)),
f2 AS (SELECT a.item AS a, b.item AS b, count(*) AS c FROM long a JOIN long b ON a.id = b.id AND a.item <> b.item GROUP BY 1, 2 HAVING count(*) >= 0.98 * (SELECT n FROM r)),
rules AS (SELECT a, row_number() OVER (ORDER BY a, b) AS rule FROM f2 JOIN f ON f.item = f2.a WHERE f2.c / f.c >= 0.7),
last AS (SELECT p.id, max(rule) AS rule FROM p LEFT JOIN (SELECT id, rule FROM long JOIN rules ON item = a) h ON h.id = p.id GROUP BY p.id),
used AS (SELECT rule, row_number() OVER (ORDER BY rule) - 1 AS cluster, count(*) OVER () AS k FROM (SELECT DISTINCT rule FROM last WHERE rule IS NOT NULL))
SELECT id, CAST(CASE WHEN k <= 2 THEN cluster ELSE -1 END AS INT) AS cluster FROM last LEFT JOIN used ON used.rule = last.rule"""
)
def pmafia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No three cells of these points are frequent together, so the SQL needs pairs only."""
    vector = F.array(*[F.expr(v).cast("double") for v in GRID_POINTS.values()])
    return grid.pmafia(D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), vector.alias("v")))


@query()
def fpmafia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.fpmafia(_users(spark, sf_dir))


# --- evaluation -------------------------------------------------------------------------------------------------------

TABLE = f"""{FLOW}, q AS (SELECT row_id, urgent + pending AS y, CASE WHEN many > 0 THEN 1 ELSE 0 END + CASE WHEN over_150k > 0 THEN 1 ELSE 0 END - CASE WHEN free > 0 THEN 1 ELSE 0 END AS p FROM flow),
c AS (SELECT CAST(y AS BIGINT) AS y, CAST(p AS BIGINT) AS p, count(*) AS n FROM q WHERE p <> -1 GROUP BY 1, 2)"""


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = D.order_flow(spark, sf_dir)
    one = lambda c: F.when(c, 1).otherwise(0)
    return flow.select("row_id", (F.col("urgent") + F.col("pending")).alias("y"), (one(F.col("many") > 0) + one(F.col("over_150k") > 0) - one(F.col("free") > 0)).alias("p"))


def _per_label_sql(table: str) -> str:
    return f"""per_{table} AS (SELECT l AS c, coalesce(sum(n) FILTER (y = l AND p = l), 0) AS tp, coalesce(sum(n) FILTER (p = l), 0) AS pred, coalesce(sum(n) FILTER (y = l), 0) AS sup FROM (SELECT DISTINCT unnest([y, p]) AS l FROM {table}) ls, {table} GROUP BY l),
f_{table} AS (SELECT *, CASE WHEN pred > 0 THEN tp / pred ELSE 0 END AS precision, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS recall, CASE WHEN pred + sup > 0 THEN 2 * tp / (pred + sup) ELSE 0 END AS f1, CASE WHEN pred + sup - tp > 0 THEN tp / (pred + sup - tp) ELSE 0 END AS jaccard FROM per_{table}),
a_{table} AS (SELECT sum(tp) / sum(sup) AS acc FROM per_{table}),
s_{table} AS (SELECT 'accuracy' AS metric, unnest(['macro', 'micro', 'weighted']) AS average, acc AS value FROM a_{table}
""" + "".join(
        f" UNION ALL SELECT '{m}', 'macro', avg({m}) FROM f_{table} UNION ALL SELECT '{m}', 'weighted', sum({m} * sup) / sum(sup) FROM f_{table} UNION ALL SELECT '{m}', 'micro', {'acc / (2 - acc)' if m == 'jaccard' else 'acc'} FROM a_{table}"
        for m in ("precision", "recall", "f1", "jaccard")
    ) + ")"


@query(f"{TABLE} SELECT y, p, n FROM c")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.contingency(_predicted(spark, sf_dir), "y", "p")


@query(f"{TABLE}, {_per_label_sql('c')} SELECT metric, average, round(value, 6) AS value FROM s_c")
def metrics_macro_micro_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.scores(evaluation.contingency(_predicted(spark, sf_dir), "y", "p")), "value")


@query(
    f"""{TABLE}, t AS (SELECT sum(n) FILTER (y = 1 AND p = 1) AS tp, sum(n) FILTER (p = 1) AS pred, sum(n) FILTER (y = 1) AS sup, sum(n) FILTER (y = p) AS same, sum(n) AS n FROM c)
SELECT 'accuracy' AS metric, round(same / n, 6) AS value FROM t UNION ALL SELECT 'precision', round(tp / pred, 6) FROM t UNION ALL SELECT 'recall', round(tp / sup, 6) FROM t
UNION ALL SELECT 'f1', round(2 * tp / (pred + sup), 6) FROM t UNION ALL SELECT 'jaccard', round(tp / (pred + sup - tp), 6) FROM t"""
)
def metrics_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.binary_scores(evaluation.contingency(_predicted(spark, sf_dir), "y", "p")), "value")


@query(
    f"""{TABLE}, j AS (SELECT y, CASE p WHEN 0 THEN 1 ELSE 0 END AS p, n FROM c WHERE p IN (0, 1)), {_per_label_sql("c")}, {_per_label_sql("j")}
SELECT 'Original' AS variant, metric, average, round(value, 6) AS value FROM s_c UNION ALL SELECT 'Adjusted', metric, average, round(value, 6) FROM s_j"""
)
def metrics_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.original_and_adjusted(_predicted(spark, sf_dir), "y", "p"), "value")


@query(
    f"""{TABLE}, k AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY y)) AS a,
(SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY p)) AS b, (SELECT sum(n) FROM c) AS n)
SELECT round((s - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS adjusted_rand_index FROM k"""
)
def rand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.rand_index(evaluation.contingency(_predicted(spark, sf_dir), "y", "p")), "adjusted_rand_index")


@query(
    f"""{TABLE}, t AS (SELECT sum(n) AS t FROM c), yy AS (SELECT y, sum(n) AS ny FROM c GROUP BY y), pp AS (SELECT p, sum(n) AS np FROM c GROUP BY p),
mi AS (SELECT sum(n / t * ln(n * t / (ny * np))) AS mi FROM c JOIN yy ON c.y = yy.y JOIN pp ON c.p = pp.p, t),
h AS (SELECT (SELECT -sum(ny / t * ln(ny / t)) FROM yy, t) AS hy, (SELECT -sum(np / t * ln(np / t)) FROM pp, t) AS hp) SELECT round(mi / ((hy + hp) / 2), 6) AS normalized_mutual_information FROM mi, h"""
)
def nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.mutual_information(evaluation.contingency(_predicted(spark, sf_dir), "y", "p")), "normalized_mutual_information")
