"""What the training-data operators take from the rest of the library, and the tables they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.blocks import by_key
from siltstone.operators.graph import components, cut, release, scratch, scratch_dir

__all__ = ["by_key", "components", "cut", "marks", "possible", "release", "scratch", "scratch_dir", "table", "width"]

#: Words of 64 bits of a filter. It has a row a word at most, which bounds what is broadcast however many keys there are.
FILTER_WORDS = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def marks(slots: DataFrame) -> DataFrame:
    """(word, bits) of the numbers in the one column of ``slots``, taken modulo 64 * FILTER_WORDS."""
    slot = slots.select(F.pmod(F.col(slots.columns[0]), F.lit(64 * FILTER_WORDS)).alias("slot"))
    return slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))


def possible(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: false only where the columns that ``keys`` has hold none of its rows. A true one wants an exact join.

    It spares rows with a long text the way through a shuffle. With very many keys most rows are true, and the join does the work.
    """
    word, bits = f"{name}_word", f"{name}_bits"
    slot: Column = F.xxhash64(*keys.columns)
    held = marks(keys.select(slot.alias("slot"))).select(F.col("word").alias(word), F.col("bits").alias(bits))
    sent = rows.withColumn(name, F.pmod(slot, F.lit(64 * FILTER_WORDS)))
    found = sent.join(F.broadcast(held), F.shiftright(name, 6) == F.col(word), "left")
    return found.withColumn(name, F.expr(f"coalesce(shiftrightunsigned({bits}, cast({name} & 63 as int)) & 1, 0) = 1")).drop(word, bits)
