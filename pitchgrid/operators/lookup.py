"""Keyed lookups: with a fallback key, strict and tolerant maps, gaps and scopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.operators.dedup import keep_last, keep_unique

#: Rows up to which a lookup table is broadcast, after its rows were counted.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most ``rows`` rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fallback_lookup(df: DataFrame, table: DataFrame, exact: list[str], fallback: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Left lookup by ``exact`` (last row of a key counts); rows left without any value look up ``fallback``.

    Of the fallback key, groups of more than one row are dropped. NULL keys meet NULL keys in the exact
    step, none in the fallback. ``found_by`` says which step gave the values.
    """
    first = keep_last(table, exact, order).select(*[F.col(k).alias(f"_e_{k}") for k in exact], *[F.col(v).alias(f"_x_{v}") for v in values])
    second = keep_unique(table.dropna(subset=fallback), fallback).select(*[F.col(k).alias(f"_f_{k}") for k in fallback], *[F.col(v).alias(f"_y_{v}") for v in values])
    joined = df.join(first, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in exact]), "left")
    joined = joined.join(second, [F.col(k) == F.col(f"_f_{k}") for k in fallback], "left")
    missing = reduce(lambda a, b: a & b, [F.col(f"_x_{v}").isNull() for v in values])
    got = reduce(lambda a, b: a | b, [F.col(f"_y_{v}").isNotNull() for v in values])
    return joined.select(
        *df.columns, *[F.when(missing, F.col(f"_y_{v}")).otherwise(F.col(f"_x_{v}")).alias(v) for v in values],
        F.when(~missing, "exact").when(got, "fallback").alias("found_by"),
    )


def strict_map(df: DataFrame, mapping: DataFrame, key: str, out: str) -> DataFrame:
    """``df`` with ``out`` of ``mapping`` (key, out); a non-NULL key without entry raises ValueError."""
    entries = small(mapping.select(F.col(key), F.col(out)).dropDuplicates([key]))
    unmapped = df.where(F.col(key).isNotNull()).join(entries, key, "left_anti").select(key).distinct()
    examples = [r[0] for r in unmapped.limit(5).collect()]
    if examples:
        raise ValueError(f"keys without an entry, for example {examples}")
    return df.join(entries, key, "left")


def tolerant_map(df: DataFrame, mapping: DataFrame, key: str, out: str) -> DataFrame:
    """``df`` with ``out`` of ``mapping``, NULL where it has no entry."""
    return df.join(small(mapping.select(key, out).dropDuplicates([key])), key, "left")


def gaps(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``expected`` whose key ``seen`` does not have; NULL keys are always gaps."""
    return expected.join(seen.select(*keys), keys, "left_anti")


def in_scope(df: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key ``scope`` has; a composite semi-join."""
    return df.join(small(scope.select(*keys).distinct()), keys, "left_semi")


def unresolved(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows) of what :func:`fallback_lookup` found by neither key, the most frequent first."""
    return found.where("found_by is null").groupBy(*keys).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), *keys)


def chained_lookup(df: DataFrame, tables: list[DataFrame], key: str, values: list[str]) -> DataFrame:
    """``df`` with the values of the first table, in order, that has a filled one for the key; each table's first row of a key counts."""
    out = df
    for i, t in enumerate(tables):
        out = out.join(t.dropDuplicates([key]).select(key, *[F.col(v).alias(f"_{i}_{v}") for v in values]), key, "left")
    each = lambda v: [F.when(F.trim(F.col(f"_{i}_{v}").cast("string")) != "", F.col(f"_{i}_{v}")) for i in range(len(tables))]
    return out.select(*df.columns, *[F.coalesce(*each(v)).alias(v) for v in values])
