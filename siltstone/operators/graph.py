"""Scratch tables and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Paths of the tables that ``cut`` has written and nothing has released, oldest first.
_LIVE: dict[str, None] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where it is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="siltstone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = f"file://{folder}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back, which ends its lineage."""
    path = f"{scratch_dir(df.sparkSession)}/siltstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _LIVE[path] = None
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._siltstone_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    _LIVE.pop(path, None)
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(found, True)


def release(df: DataFrame) -> None:
    """Delete the files of a ``cut`` table that nothing reads any more."""
    _delete(df.sparkSession, df._siltstone_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end all tables cut within, except those passed to the function that it gives."""
    before, kept = set(_LIVE), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._siltstone_path)
        return df

    try:
        yield keep
    finally:
        for path in [p for p in _LIVE if p not in before and p not in kept]:
            _delete(spark, path)


def release_all(spark: SparkSession) -> None:
    """Delete all scratch tables of this session, once no result that reads them is wanted any more."""
    for path in list(_LIVE):
        _delete(spark, path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): a row (node, root) per node of an edge, root the least node reachable.

    Alternating large-star and small-star steps. Minima come from partial aggregates and plain equi-joins, so a hub with a
    third of all edges is split by adaptive execution; every step is cut into the shared folder. Nulls and self loops are
    dropped; no edges give an empty result.
    """
    now = cut(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        release(now)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        release(large)
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen["n"] == 0 or (seen["n"], seen["x"]) == state:
            break
        state = (seen["n"], seen["x"])
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
