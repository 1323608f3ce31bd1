"""Flow-shaped tables derived from the test tables: one row per order, one per user, one per vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLOW = ["ret_r", "ret_a", "ret_n", "line_o", "line_f", "free", "untaxed", "bulk", "over_150k", "several", "many"]
STAGES = ["urgent", "pending", "costly"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of line kinds per order, with three stage labels. Lines are summed by order before the join; orders without lines have zeros."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            *[F.count_if(F.col("l_returnflag") == x).alias(f"ret_{x.lower()}") for x in "RAN"],
            *[F.count_if(F.col("l_linestatus") == x).alias(f"line_{x.lower()}") for x in "OF"],
            F.count_if(F.col("l_discount") == 0).alias("free"),
            F.count_if(F.col("l_tax") == 0).alias("untaxed"),
            F.count_if(F.col("l_quantity") > 45).alias("bulk"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    orders = table(spark, sf_dir, "orders")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("row_id"),
        *[zero(c).alias(c) for c in FLOW[:8]],
        (F.col("o_totalprice") - 150000).alias("over_150k"),
        (zero("n") - 1).alias("several"),
        (zero("n") - 4).alias("many"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("urgent"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("pending"),
        F.when(F.col("o_totalprice") > 400000, -1).otherwise(0).alias("costly"),
    )


ORDER_FLOW_SQL = """
lines AS (
  SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS ret_r, count(*) FILTER (l_returnflag = 'A') AS ret_a, count(*) FILTER (l_returnflag = 'N') AS ret_n,
         count(*) FILTER (l_linestatus = 'O') AS line_o, count(*) FILTER (l_linestatus = 'F') AS line_f, count(*) FILTER (l_discount = 0) AS free,
         count(*) FILTER (l_tax = 0) AS untaxed, count(*) FILTER (l_quantity > 45) AS bulk, count(*) AS n
  FROM lineitem GROUP BY l_orderkey),
flow AS (
  SELECT o_orderkey AS row_id, coalesce(ret_r, 0) AS ret_r, coalesce(ret_a, 0) AS ret_a, coalesce(ret_n, 0) AS ret_n, coalesce(line_o, 0) AS line_o,
         coalesce(line_f, 0) AS line_f, coalesce(free, 0) AS free, coalesce(untaxed, 0) AS untaxed, coalesce(bulk, 0) AS bulk,
         o_totalprice - 150000 AS over_150k, coalesce(n, 0) - 1 AS several, coalesce(n, 0) - 4 AS many,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS pending,
         CASE WHEN o_totalprice > 400000 THEN -1 ELSE 0 END AS costly
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey)"""


def user_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of events per user and kind."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    kind = F.col("event_type")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("row_id"))
        .agg(*[F.count_if(kind == k).alias(f"{k}_n") for k in kinds], *[F.coalesce(F.sum(F.when(kind == k, F.col("value"))), F.lit(0.0)).alias(f"{k}_sum") for k in kinds])
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v, tag) of the vectors."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("tag"))
