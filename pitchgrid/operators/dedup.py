"""One row or one value per key, with an explicit order: keep last, first or none, first non-empty, mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.runtime import cut


def _ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``; NULL keys form one group, NULL order values come first."""
    return _ranked(df, keys, [F.col(c).desc_nulls_last() for c in order])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is first in ``order``; NULL order values come last."""
    return _ranked(df, keys, [F.col(c).asc_nulls_last() for c in order])


def keep_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no other row has; every member of a larger group goes."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with the number of rows; counted map-side first."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def filled(c: str | Column) -> Column:
    """The value unless it is NULL, NaN or blank text."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(col.cast("string")) != "", col)


def first_non_empty(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """Per key and column the first non-blank value in ``order``; a plain aggregate, so it combines map-side."""
    ordered = [F.min_by(F.col(c), F.when(filled(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    kept = [F.when(F.count(filled(c)) > 0, m).alias(c) for c, m in zip(columns, ordered)]
    return df.groupBy(*keys).agg(*kept)


def mode_of(df: DataFrame, keys: list[str], value: str, first_seen: str | None = None) -> DataFrame:
    """The most frequent value per key; ties go to the first in text order, or the first seen in ``first_seen``.

    Values are counted before they are ranked, so the window sees one row per key and value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), *([F.min(first_seen).alias("_seen")] if first_seen else []))
    tie = [F.col("_seen").asc()] if first_seen else [F.lower(F.col(value).cast("string")).asc(), F.col(value).asc()]
    return _ranked(counts, keys, [F.col("_n").desc(), *tie]).select(*keys, F.col(value).alias("mode"), F.col("_n").alias("rows"))


def single_valued(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of a key if all its rows agree, else NULL."""
    return df.groupBy(*keys).agg(F.when(F.min(value) == F.max(value), F.max(value)).alias("hint"))


def joined_values(c: str | Column, separator: str = " | ") -> Column:
    """Aggregate: the distinct non-blank values in order, as one text; empty for none."""
    return F.array_join(F.sort_array(F.collect_set(filled(c).cast("string"))), separator)


def number_suffixes(df: DataFrame, base: str, order: str, out: str) -> DataFrame:
    """Ids that clash get ``_2``, ``_3``, ... in ``order``; the first keeps its base.

    Where a suffixed id is itself another row's, the later of the two moves on to its next number, round by
    round, until all ids are unique; a number only grows, so the rounds end. A row whose id is its plain base
    comes before one with a suffix.
    """
    start = F.row_number().over(Window.partitionBy(base).orderBy(order))
    named = lambda n: F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), n.cast("string")))
    rows = cut(df.withColumn("_n", start).withColumn(out, named(F.col("_n"))))
    while rows.groupBy(out).agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
        place = F.row_number().over(Window.partitionBy(out).orderBy((F.col("_n") > 1).cast("int"), "_n", order))
        rows = cut(rows.withColumn("_p", place).withColumn("_n", F.when(F.col("_p") > 1, F.col("_n") + 1).otherwise(F.col("_n"))).drop("_p").withColumn(out, named(F.col("_n"))))
    return rows.drop("_n")
