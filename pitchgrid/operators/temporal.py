"""As-of, latest and nearest rows of another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.operators.dedup import keep_last
from pitchgrid.operators.lookup import small
from pitchgrid.runtime import cut


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row per entity; ties by the further order columns."""
    return keep_last(df, keys, order)


#: Rows of a key from which its time line is cut into pieces that are read side by side.
LONG_KEY = 1_000_000


def _pieces(both: DataFrame, by: list[str], long_key: int) -> tuple[Column, DataFrame]:
    """(number, ``both``): number of the piece of its key's time line a row falls into; keys of few rows are one piece.

    The ends of the pieces are approximate quantiles of the key's times, so that pieces are of one size
    whatever the times; only keys beyond ``long_key`` rows have any, so the list of ends is short.
    """
    sizes = both.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > long_key)
    if not sizes.limit(1).count():
        return F.lit(0), both
    most = sizes.agg(F.max("_n")).first()[0]
    number = min(1000, -(-most // long_key))
    number_t = F.col("_t").cast("double") if dict(both.dtypes)["_t"] != "timestamp" else F.unix_micros("_t").cast("double")
    hot = small(sizes.select(*by, F.lit(True).alias("_hot")))
    ends = both.join(hot, by, "left_semi").groupBy(*by).agg(F.percentile_approx(number_t, F.array(*[F.lit(i / number) for i in range(1, number)]), 10_000).alias("_ends"))
    joined = both.join(small(cut(ends)), by, "left")
    return F.coalesce(F.size(F.filter("_ends", lambda e: e < number_t)), F.lit(0)), joined


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, since: str, values: list[str], long_key: int = LONG_KEY) -> DataFrame:
    """``left`` with the values of the last row of ``right`` whose ``since`` is not after ``at``; NULL without one.

    Both sides are unioned and read once in time order per key (``last`` over a running frame), so no
    pair of rows is formed. A key of more than ``long_key`` rows is cut into pieces of its time line that are
    read by different tasks; what the pieces before it end with is carried into each. At the same time rows of
    ``right`` come first; of several the greatest values count. NULL times find nothing.
    """
    events = right.select(*by, F.col(since).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"), *[F.lit(None).cast(t).alias(f"_l_{c}") for c, t in left.dtypes if c not in by])
    asked = left.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(events.schema["_v"].dataType).alias("_v"), *[F.col(c).alias(f"_l_{c}") for c in left.columns if c not in by])
    both = events.where(F.col("_t").isNotNull()).unionByName(asked)
    piece, both = _pieces(both, by, long_key)
    both = both.withColumn("_piece", piece)
    running = Window.partitionBy(*by, "_piece").orderBy(F.col("_t").asc_nulls_first(), "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    # the last value of every piece is one row; those of the pieces before it are a short window of their own
    ends = both.where("_side = 0").groupBy(*by, "_piece").agg(F.max(F.struct("_t", "_v")).alias("_end"))
    later = Window.partitionBy(*by).orderBy("_piece")
    carried = ends.select(*by, F.col("_piece").alias("_from"), F.col("_end._v").alias("_carry"), F.lead("_piece").over(later).alias("_until"))
    found = both.withColumn("_own", F.last("_v", ignorenulls=True).over(running)).where("_side = 1")
    if "_ends" in both.columns:
        fits = [F.col(f"_a.{k}").eqNullSafe(F.col(f"_c.{k}")) for k in by]
        found = found.alias("_a").join(carried.alias("_c"), [*fits, F.col("_a._piece") > F.col("_c._from"), F.col("_a._piece") <= F.coalesce(F.col("_c._until"), F.lit(1 << 30))], "left")
        found = found.select("_a.*", F.col("_c._carry").alias("_carry"))
        last = F.coalesce("_own", "_carry")
    else:
        last = F.col("_own")
    value = F.when(F.col("_t").isNotNull(), last)
    return found.select(*by, *[F.col(f"_l_{c}").alias(c) for c in left.columns if c not in by], *[value[v].alias(v) for v in values])


def asof_interval(left: DataFrame, right: DataFrame, by: list[str], at: str, since: str, until: str, values: list[str], key: str) -> DataFrame:
    """Like :func:`asof` for intervals with either end open: inclusive ends, the latest start wins.

    A row with only an end counts from that end on, one with neither never. ``key`` identifies a row of
    ``left``. The latest start is found by one sweep; only rows whose latest interval has ended are
    compared with the earlier ones of their key.
    """
    r = right.select(*by, F.coalesce(since, until).alias("_s"), F.when(F.col(since).isNotNull(), F.col(until)).alias("_u"), *values).where("_s is not null")
    asked = left.select(key, *by, F.col(at).alias("_at"))
    # the latest start not after the time, if it still runs, is the answer for most rows
    first = cut(asof(asked, r, by, "_at", "_s", ["_s", *values, "_u"]))
    runs = F.col("_s").isNotNull() & (F.col("_u").isNull() | (F.col("_u") >= F.col("_at")))
    done = first.where(runs)
    # rows whose latest start has ended look among the earlier, longer intervals
    rest = first.where(~runs & F.col("_s").isNotNull()).select(key, *by, "_at")
    fits = (F.col("_s") <= F.col("_at")) & (F.col("_u").isNull() | (F.col("_u") >= F.col("_at")))
    found = rest.join(r, by).where(fits).groupBy(key).agg(F.max(F.struct("_s", *values)).alias("_b")).select(key, *[F.col(f"_b.{v}").alias(v) for v in values])
    best = done.select(key, *values).unionByName(found)
    return left.join(best, key, "left").select(*left.columns, *values)


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, time: str, values: list[str], long_key: int = LONG_KEY) -> DataFrame:
    """``left`` with the row of ``right`` nearest in time; the earlier on ties, NULL without one.

    Two running frames over the union give the neighbours before and after; no pairs are formed.
    """
    pack = F.struct(F.col(time).alias("_time"), *values)
    before = asof(left, right.withColumn("_p", pack), by, at, time, ["_p"], long_key).withColumnRenamed("_p", "_before")
    after_time = right.withColumn("_neg", -F.unix_micros(time)).withColumn("_p", pack)
    both = asof(before.withColumn("_negat", -F.unix_micros(at)), after_time, by, "_negat", "_neg", ["_p"], long_key).withColumnRenamed("_p", "_after")
    gap = lambda side: F.abs(F.unix_micros(F.col(f"{side}._time")) - F.unix_micros(at))
    best = F.when(F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")).otherwise(F.col("_after"))
    return both.withColumn("_best", best).select(*left.columns, *[F.col(f"_best.{v}").alias(v) for v in ["_time", *values]]).withColumnRenamed("_time", f"nearest_{time}")
