"""Queries of the relational core: scans and sinks, projections, filters, small joins, aggregates, sorts and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import scalar as S
from siltstone.operators import clustering, evaluation, features, mining
from siltstone.operators.graph import components, cut, scratch_dir
from siltstone.plans.registry import query
from siltstone.sources import derived as D
from siltstone.sources import files

# --- scans and sinks --------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/siltstone-files-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_scan_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = D.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = _folder(spark)
    files.write_csv(nations, path)
    return files.read_csv(spark, path, nations.schema, glob="*.csv")


@query("SELECT c_custkey, c_acctbal FROM customer")
def csv_sink_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    path = _folder(spark)
    files.write_csv(rows, path, rows_per_file=10_000)
    return files.read_csv(spark, path, rows.schema)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects beside a broken line per hundred events; broken lines are skipped."""
    events = D.table(spark, sf_dir, "events")
    good = events.select(F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit("}")).alias("value"))
    bad = events.where("event_id % 100 = 0").select(F.lit('{"event_id": 1, "k"').alias("value"))
    path = _folder(spark)
    good.unionByName(bad).write.text(path)
    return files.read_json_lines(spark, path, "event_id long, k long")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS label FROM nation")
def json_dictionary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = D.table(spark, sf_dir, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name")))).alias("value"))
    path = _folder(spark)
    pairs.write.text(path)
    return files.read_dictionary(spark, path)


@query("SELECT CAST(row_number() OVER (ORDER BY r_name) - 1 AS INT) AS group_id, items FROM (SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS items FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name)")
def ragged_groups_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = D.table(spark, sf_dir, "region").join(D.table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    groups = joined.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("items")).coalesce(1).sortWithinPartitions("r_name")
    path = _folder(spark)
    files.write_groups(groups, path)
    return files.read_groups(spark, path).select("group_id", F.array_join("items", ",").alias("items"))


# --- projections and filters ------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS label FROM orders")
def label_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "orders").select("o_orderkey", S.equals_label(F.col("o_orderstatus"), "O", 0).alias("label"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey <> 0 THEN 1 ELSE 0 END AS label FROM nation")
def label_by_last_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = D.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return nations.select("n_nationkey", S.last_column_label(nations).alias("label"))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 1 WHEN 1 THEN 0 END AS swapped, coalesce(CASE n_regionkey WHEN 0 THEN 1 WHEN 1 THEN 0 END, -1) AS filled, 1 - n_regionkey AS inverted FROM nation")
def remap_and_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    swapped = S.remap(F.col("n_regionkey"), {0: 1, 1: 0})
    return D.table(spark, sf_dir, "nation").select("n_nationkey", swapped.alias("swapped"), F.coalesce(swapped, F.lit(-1)).alias("filled"), (1 - F.col("n_regionkey")).alias("inverted"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' OR l_discount = 0.1 OR l_tax = 0.08")
def disjunctive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.table(spark, sf_dir, "lineitem")
    return lines.where("l_returnflag = 'R' or l_discount = 0.1D or l_tax = 0.08D").select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"WITH {D.ORDER_FLOW_SQL} SELECT row_id FROM flow WHERE urgent <> 0 OR pending <> 0 OR costly <> 0")
def filter_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.order_flow(spark, sf_dir).withColumn("anomal", S.any_nonzero(D.STAGES)).where("anomal = 1").select("row_id")


@query(
    "SELECT event_id, a * 0.45::DOUBLE + b * 0.35::DOUBLE AS score FROM (SELECT event_id, CASE WHEN user_id > 0 THEN value / user_id ELSE 0 END AS a, CASE WHEN value > 50 THEN 50 / value ELSE 0 END AS b FROM events)"
)
def guarded_ratio_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = D.table(spark, sf_dir, "events").select(
        "event_id", S.ratio(F.col("value"), F.col("user_id")).alias("a"), F.when(F.col("value") > 50, 50 / F.col("value")).otherwise(0.0).alias("b")
    )
    return scored.select("event_id", S.weighted({"a": 0.45, "b": 0.35}).alias("score"))


@query("SELECT p_partkey AS id, p_brand AS brand FROM part")
def rename_and_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = D.table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_brand", "p_type").drop("p_absent")
    return S.sliced_columns(parts, 1, -1).withColumnsRenamed({"p_partkey": "id", "p_brand": "brand"})


@query("SELECT n_nationkey, rpad(n_name, 20, ' ') AS padded, CAST(strpos('ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(n_name, 1, 1)) - 1 AS INT) AS first_code FROM nation")
def pad_and_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = S.character_codes(F.substring("n_name", 1, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return D.table(spark, sf_dir, "nation").select("n_nationkey", S.pad_text(F.col("n_name"), 20).alias("padded"), code[0].alias("first_code"))


# --- joins ------------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, r_name AS Label FROM nation JOIN region ON n_regionkey = r_regionkey")
def zip_labels_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = D.table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("ID"), "r_name")
    return files.zip_labels(D.table(spark, sf_dir, "nation"), labels, "n_regionkey", "ID").select("n_nationkey", "n_name", "Label")


@query(
    f"""WITH {D.ORDER_FLOW_SQL}, t AS ({" UNION ALL ".join(f"SELECT row_id, '{c}' AS item FROM flow WHERE {c} > 0" for c in D.FLOW)}),
f AS (SELECT item FROM t GROUP BY item HAVING count(*) >= 0.5 * (SELECT count(*) FROM flow)) SELECT a.item || ',' || b.item AS items FROM f a JOIN f b ON a.item < b.item"""
)
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = S.binarize(D.order_flow(spark, sf_dir), ["row_id"], D.FLOW)
    single = mining.frequent_itemsets(mining.transactions(flow, "row_id", D.FLOW), 0.5, max_size=1)
    return mining.candidates(single).select(F.array_join("items", ",").alias("items"))


# --- aggregates, sorts, sets ------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type")


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("kinds"))


@query("SELECT round(min(x), 6) AS low, round(max(x), 6) AS high FROM (SELECT unnest(embedding::DOUBLE[]) AS x FROM embeddings)")
def matrix_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.points(spark, sf_dir).agg(F.round(F.min(F.array_min("v")), 6).alias("low"), F.round(F.max(F.array_max("v")), 6).alias("high"))


@query("SELECT vec_id, CAST(list_position(embedding::DOUBLE[], list_max(embedding::DOUBLE[])) - 1 AS INT) AS at FROM embeddings")
def argmax_of_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.points(spark, sf_dir).select(F.col("id").alias("vec_id"), (F.array_position("v", F.array_max("v")) - 1).cast("int").alias("at"))


@query("SELECT CAST(max(len(embedding)) AS INT) AS longest FROM embeddings")
def longest_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.points(spark, sf_dir).agg(F.max(F.size("v")).alias("longest"))


@query(
    """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), x AS (SELECT id, label, 1.0 / (1 + id % 7) AS w, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e)
SELECT CAST(label AS BIGINT) AS tag, CAST(i - 1 AS INT) AS i, round(sum(w * x) / sum(w), 6) AS mean FROM x GROUP BY label, i"""
)
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.lit(1.0) / (1 + F.col("id") % 7)
    cells = D.points(spark, sf_dir).select("tag", w.alias("w"), F.posexplode("v").alias("i", "x"))
    return cells.groupBy("tag", "i").agg(F.round(F.sum(F.col("w") * F.col("x")) / F.sum("w"), 6).alias("mean"))


@query("SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def top5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(5).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query(
    "WITH t AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) SELECT k, round(c_acctbal, 6) AS c_acctbal FROM t UNION ALL SELECT 'Mean', round(avg(c_acctbal), 6) FROM t"
)
def top5_with_summary_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = D.table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(5).select(F.col("c_custkey").cast("string").alias("k"), "c_acctbal")
    both = best.unionByName(best.agg(F.avg("c_acctbal").alias("c_acctbal")).select(F.lit("Mean").alias("k"), "c_acctbal"))
    return both.select("k", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("SELECT event_id, user_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 300")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 rows by the hash of their id: each task keeps its own least 300, so nothing is sorted as a whole."""
    return D.table(spark, sf_dir, "events").orderBy(F.md5(F.col("event_id").cast("string").cast("binary")), "event_id").limit(300).select("event_id", "user_id")


@query(
    """WITH o AS (SELECT n_regionkey AS k, list(DISTINCT n_name ORDER BY n_name) AS a FROM nation GROUP BY 1), p AS (SELECT x.k AS a, y.k AS b, x.a AS x, list_sort(list_distinct(list_concat(y.a, x.a[1:2]))) AS y FROM o x JOIN o y ON x.k < y.k)
SELECT a, b, array_to_string(list_sort(list_intersect(x, y)), ',') AS both, array_to_string(list_sort(list_filter(x, lambda i: NOT list_contains(y, i))), ',') AS rest, CAST(len(list_distinct(list_concat(x, y))) AS INT) AS n FROM p"""
)
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = D.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_set("n_name")).alias("a"))
    x, y = sets.alias("x"), sets.alias("y")
    pairs = x.join(y, F.col("x.k") < F.col("y.k")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.col("x.a").alias("x"), F.array_union("y.a", F.slice("x.a", 1, 2)).alias("y"))
    return pairs.select(
        "a",
        "b",
        F.array_join(F.array_sort(F.array_intersect("x", "y")), ",").alias("both"),
        F.array_join(F.array_sort(F.array_except("x", "y")), ",").alias("rest"),
        F.size(F.array_union("x", "y")).alias("n"),
    )


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT c_custkey % 25 AS a, 100 + c_custkey % 40 AS b FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, root) AS (SELECT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id) SELECT id AS node, min(root) AS root FROM r GROUP BY id"""
)
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge per customer; the residues make five components."""
    return components(D.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 25).alias("a"), (100 + F.col("c_custkey") % 40).alias("b")))


# --- features and clusters without SQL --------------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str, axes: int = 3) -> DataFrame:
    flow = D.user_flow(spark, sf_dir)
    spec = features.FeatureSpec((features.Block("scale", tuple(c for c in flow.columns if c != "row_id")),))
    return cut(features.pca(features.build(flow, spec, "row_id"), axes))


@query()
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, 5).select("id", *[F.round(F.col("v")[i], 6).alias(f"pc{i}") for i in range(5)])


_WEIGHTS = features.projection_weights(64)


@query(
    "WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) SELECT id, "
    + ", ".join(f"round(greatest(0, list_dot_product(v, [{', '.join(map(repr, map(float, w)))}]::DOUBLE[])), 5) AS h{i}" for i, w in enumerate(_WEIGHTS))
    + " FROM e"
)
def random_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.points(spark, sf_dir).select("id", features.random_projection(F.col("v"), 64).alias("h"))
    return rows.select("id", *[F.round(F.col("h")[i], 5).alias(f"h{i}") for i in range(len(_WEIGHTS))])


@query()
def node_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = features.edges(D.table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey", "n_nationkey", ["n_name"])
    found = features.node_embeddings(graph, size=16, length=10, walks=100)
    return found.select("node", F.array_join(F.transform("v", lambda x: F.round(x, 6).cast("string")), ",").alias("vector"))


@query()
def sequence_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of each user's whole sequence of values, in event order."""
    events = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    values = F.transform(F.filter(events, lambda e: e["value"].isNotNull()), lambda e: e["value"].cast("double"))
    rows = D.table(spark, sf_dir, "events").groupBy("user_id").agg(values.alias("s"))
    return features.sequence_codes(rows, "s", 4).select("user_id", *[F.round(F.col("code")[i], 6).alias(f"c{i}") for i in range(4)])


@query()
def ymeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.ymeans(_points(spark, sf_dir))


@query()
def gmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.gmeans(_points(spark, sf_dir))


@query()
def cann_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cann_centers(_points(spark, sf_dir))


@query()
def attention_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.points(spark, sf_dir).withColumn("label", (F.col("tag") % 2).cast("int"))
    return clustering.attention_score(points).select("id", "label", F.round(F.col("v")[0], 6).alias("score"))


@query()
def silhouette_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.silhouette_score(D.points(spark, sf_dir).withColumnRenamed("tag", "cluster"), sample=300)
