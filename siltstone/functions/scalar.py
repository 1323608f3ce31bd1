"""Row expressions: labels, binarizing, discretizing, ratios, text and array features. All are native columns.

NaN and null follow the data-frame rules of the data's origin: neither is greater than zero, a null or NaN stage counts as not set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def other_columns(df: DataFrame, excluded: list[str]) -> list[str]:
    """Sorted names without the excluded ones."""
    return sorted(set(df.columns) - set(excluded))


def sliced_columns(df: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    return df.select([F.col(f"`{c}`") for c in df.columns[start:stop]])


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def positive(c: Column) -> Column:
    """1 where c > 0; null, NaN and the rest are 0."""
    return F.when(~F.isnan(c.cast("double")) & (c > 0), 1).otherwise(0)


def nonzero(c: Column) -> Column:
    return F.when(~F.isnan(c.cast("double")) & (c != 0), 1).otherwise(0)


def any_nonzero(columns: list[str]) -> Column:
    return F.greatest(*map(nonzero, map(col, columns))) if len(columns) > 1 else nonzero(col(columns[0]))


def none_nonzero(columns: list[str]) -> Column:
    return 1 - any_nonzero(columns)


def any_positive(columns: list[str]) -> Column:
    return F.greatest(*map(positive, map(col, columns))) if len(columns) > 1 else positive(col(columns[0]))


def binarize(df: DataFrame, keep: list[str], columns: list[str] | None = None) -> DataFrame:
    """0/1 matrix of all other columns; a column that is not numeric is 0."""
    numbers = set(numeric_columns(df))
    columns = other_columns(df, keep) if columns is None else columns
    return df.select(*map(col, keep), *[(positive(col(c)) if c in numbers else F.lit(0)).alias(c) for c in columns])


def on_off(c: Column) -> Column:
    return F.when(positive(c) == 1, "on").otherwise("off")


def on_off_zero(c: Column) -> Column:
    """The library variant: only zero is off, so negatives, NaN and null are on."""
    return F.when(c == 0, "off").otherwise("on")


def positive_items(columns: list[str]) -> Column:
    """Names of the columns that are 1."""
    return F.array_compact(F.array(*[F.when(col(c) == 1, F.lit(c)) for c in columns]))


def contains_all(row: Column, group: Column) -> Column:
    return F.size(F.array_except(group, row)) == 0


def equals_label(c: Column, value: str, when_equal: int) -> Column:
    """when_equal where c is the value, its opposite elsewhere (null included)."""
    return F.when(c == value, when_equal).otherwise(1 - when_equal)


def last_column_label(df: DataFrame) -> Column:
    c = col(df.columns[-1])
    return F.when(F.isnan(c.cast("double")) | c.isNull() | (c != 0), 1).otherwise(0)


def remap(c: Column, pairs: dict[int, int]) -> Column:
    """Mapped value; null where there is none."""
    return reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), list(pairs.items())[1:], F.when(c == next(iter(pairs)), next(iter(pairs.values()))))


def ratio(n: Column, d: Column) -> Column:
    """n / d, or 0 where d is 0."""
    return F.when(d > 0, n / d).otherwise(0.0)


def weighted(metrics: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [col(m) * w for m, w in metrics.items()])


def text_length(c: Column) -> Column:
    """Characters; a missing text counts as the three letters that stand for it in the data's origin."""
    return F.char_length(F.coalesce(c.cast("string"), F.lit("nan")))


def distinct_characters(c: Column) -> Column:
    return F.size(F.array_distinct(F.split(F.coalesce(c.cast("string"), F.lit("nan")), "", -1))) - F.when(F.char_length(F.coalesce(c.cast("string"), F.lit("nan"))) > 0, 0).otherwise(1)


def last_token(c: Column, separator: str = r"\.") -> Column:
    return F.element_at(F.split(c, separator), -1)


def uri_tokens(c: Column) -> Column:
    return F.split(c, "[/?]")


def array_of(c: Column) -> Column:
    return F.from_json(c, "array<double>")


def array_length(c: Column) -> Column:
    return F.coalesce(F.when(F.size(array_of(c)) >= 0, F.size(array_of(c))), F.lit(0))


def array_mean(c: Column) -> Column:
    a = array_of(c)
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(0.0)


def pad_text(c: Column, length: int) -> Column:
    return F.rpad(c, length, " ")


def pad_array(c: Column, length: int) -> Column:
    return F.concat(c, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(length) - F.size(c))))


def character_codes(c: Column, charset: str) -> Column:
    """Places in the charset; -1 for a character that it lacks."""
    letters = F.array(*[F.lit(x) for x in charset])
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: (F.array_position(letters, x) - 1).cast("int"))


def first_seen_codes(df: DataFrame, category: str, order: str) -> DataFrame:
    """(category, code): codes in the order of first appearance. One row a category is sorted, not the table."""
    from pyspark.sql import Window

    first = df.groupBy(category).agg(F.min(order).alias("_first"))
    return first.select(category, (F.row_number().over(Window.orderBy("_first", category)) - 1).alias("code"))


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, nans, infinities)."""
    parts = []
    for c in columns:
        x = col(c).cast("double")
        parts.append(F.struct(F.lit(c).alias("column"), F.count_if(col(c).isNull()).alias("nulls"), F.count_if(F.isnan(x)).alias("nans"), F.count_if(F.abs(x) == float("inf")).alias("infinities")))
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def drop_mixed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop text columns whose values are of more than one kind: some numbers and some not, or some missing."""
    if not columns:
        return df
    facts = df.agg(*[x for c in columns for x in (F.count(col(c)), F.count(col(c).try_cast("double")), F.count(F.lit(1)))]).first()
    mixed = [c for i, c in enumerate(columns) if not (facts[3 * i] == facts[3 * i + 2] and facts[3 * i + 1] in (0, facts[3 * i]))]
    return df.drop(*mixed)
