"""File sources and sinks: flow CSV, ragged groups, headerless wide tables, JSON lines, dictionaries, databases."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.sources import schemas


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, glob: str | None = None) -> DataFrame:
    """CSV with a header; with a schema nothing is inferred. glob: only files of a folder that match, such as ``*.csv``."""
    reader = spark.read.option("header", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.flow_schema())


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """The headerless table of 115 windowed statistics."""
    return spark.read.schema(schemas.window_schema()).csv(path)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, items) of a headerless ragged CSV; the first line is group 0. Padding is dropped."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    items = F.array_sort(F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x)), lambda x: x != ""))
    number = F.row_number().over(Window.orderBy("line")) - 1  # a group file has tens of lines
    return lines.where(F.trim("value") != "").select(number.cast("int").alias("group_id"), items.alias("items"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None, keep_bad: bool = False) -> DataFrame:
    """One object per line. A malformed line is dropped, or kept in ``_corrupt_record``."""
    reader = spark.read.option("mode", "PERMISSIVE" if keep_bad else "DROPMALFORMED")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) of one JSON object; the file is small by nature."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "label"))


def attach_labels(df: DataFrame, annotations: DataFrame, key: str = "id", out: str = "label") -> DataFrame:
    """The annotation of each key, ``unknown`` where there is none. The engine broadcasts the annotations if they are small."""
    lookup = annotations.select(F.col("id").cast("string").alias("_key"), F.col("label").alias("_label"))
    return df.join(lookup, F.col(key).cast("string") == F.col("_key"), "left").withColumn(out, F.coalesce("_label", F.lit("unknown"))).drop("_key", "_label")


def zip_labels(df: DataFrame, labels: DataFrame, row_id: str, label_id: str, out: str = "Label") -> DataFrame:
    """Labels numbered from 1 for rows numbered from 0."""
    shifted = labels.select((F.col(label_id) - 1).alias("_row"), F.col(labels.columns[-1]).alias(out))
    return df.join(shifted, F.col(row_id) == F.col("_row")).drop("_row")


def read_database(spark: SparkSession, table: str, url: str | None = None, user: str | None = None, password: str | None = None, **options: str) -> DataFrame:
    """A table over JDBC; address and credentials come from arguments or SILTSTONE_DB_URL, _USER and _PASSWORD.

    partitionColumn, lowerBound, upperBound and numPartitions may be given to read in parallel. Filters and columns are pushed down.
    """
    url = url or os.environ.get("SILTSTONE_DB_URL")
    if not url:
        raise ValueError("no database address: give url or set SILTSTONE_DB_URL")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for key, value in (("user", user or os.environ.get("SILTSTONE_DB_USER")), ("password", password or os.environ.get("SILTSTONE_DB_PASSWORD")), *options.items()):
        if value is not None:
            reader = reader.option(key, value)
    return reader.load()


def create_flow_table(spark: SparkSession, name: str) -> None:
    """An empty table of flows with an id, if there is none of that name."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.flow_schema(with_id=True).fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


def write_csv(df: DataFrame, path: str, header: bool = True, rows_per_file: int | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).option("header", header)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).csv(path)


def write_groups(groups: DataFrame, path: str, items: str = "items", mode: str = "errorifexists") -> None:
    """A line per group, items joined by commas, no header."""
    groups.select(F.array_join(items, ",").alias("value")).write.mode(mode).text(path)


def write_variants(long: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Metric values with a column that names the variant."""
    write_csv(long.select("variant", *[c for c in long.columns if c != "variant"]), path, mode=mode)
