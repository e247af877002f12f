"""Values as they are shown: numbers, days, weather, names of matches and options, chart coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitchgrid.functions.text import label_key


def _bare(value: Column) -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def safe_int(value: Column) -> Column:
    """Whole part of a number; 0 where there is none."""
    n = _bare(value).try_cast("double")
    return F.coalesce(F.when(~F.isnan(n), n.cast("bigint")), F.lit(0).cast("bigint"))


def safe_bool(value: Column) -> Column:
    return F.lower(_bare(value)).isin("true", "1", "yes")


def format_number(value: Column, decimals: int = 0, suffix: str = "", missing: str = "-") -> Column:
    """A number with fixed decimals and a suffix; ``missing`` for none, other text as it is. Whole numbers round half to even."""
    text = _bare(value)
    n = text.try_cast("double")
    shown = F.bround(n, 0).cast("bigint").cast("string") if decimals == 0 else F.format_string(f"%.{decimals}f", n)
    return F.when(text == "", missing).when(n.isNull() | F.isnan(n), text).otherwise(F.concat(shown, F.lit(suffix)))


def parse_wall_clock(value: Column) -> Column:
    """The date and time a text is written with, its offset left out; the day alone where only that can be read; else NULL."""
    bare = F.regexp_replace(_bare(value), r"\s*(?:[zZ]|[+-]\d{2}:?\d{2}(?::?\d{2})?)$", "")
    day = F.regexp_extract(_bare(value), r"^(\d{4}-\d{2}-\d{2})", 1)
    whole = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d{1,9})?)?)?)?$"), F.replace(bare, F.lit("T"), F.lit(" ")))
    return F.coalesce(F.when(F.length(whole) > 10, whole.try_cast("timestamp_ntz")), F.when(day != "", day).try_cast("timestamp_ntz"))


def format_match_datetime(moment: Column, day: Column) -> Column:
    """``dd/MM/yyyy HH:mm`` of a match with a time, ``dd/MM/yyyy`` of one without; text that is no date as it is, ``-`` for none."""
    shown = F.when(_bare(moment) != "", _bare(moment)).otherwise(_bare(day))
    parsed = parse_wall_clock(shown)
    form = F.when((_bare(moment) != "") & F.contains(_bare(moment), F.lit(":")), F.date_format(parsed, "dd/MM/yyyy HH:mm")).otherwise(F.date_format(parsed, "dd/MM/yyyy"))
    return F.when(shown == "", "-").when(parsed.isNull(), shown).otherwise(form)


def format_display_date(value: Column) -> Column:
    return format_match_datetime(F.lit(None).cast("string"), value)


def split_match_name(name: Column) -> Column:
    """Struct (home, away) of ``Home vs Away``; without the sign the whole is home and ``-`` away."""
    text = F.coalesce(name, F.lit(""))
    parts = F.split(text, " vs ", 2)
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("home"), F.when(F.size(parts) > 1, F.trim(F.get(parts, F.lit(1)))).otherwise("-").alias("away"))


def resource_id(iri: Column) -> Column:
    """What stands behind the last slash of a resource, percent signs resolved; a plus sign stays."""
    last = F.regexp_replace(F.regexp_replace(_bare(iri), "/+$", ""), "^.*/", "")
    return F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))


def resource_label(iri: Column) -> Column:
    """A resource's id as a label: without a three-letter prefix and with blanks for ``_``."""
    key = resource_id(iri)
    bare = F.when(key.rlike(r"^\p{L}{3}[-_]."), F.substring(key, F.lit(5), F.length(key))).otherwise(key)
    return F.trim(F.translate(bare, "_", " "))


def option_label(label: Column, iri: Column) -> Column:
    """The stored label, or the resource's own where there is none or it says no more than the id."""
    text, own = _bare(label), resource_label(iri)
    return F.when(text == "", F.when(own != "", own).otherwise(resource_id(iri))).when(label_key(text) == label_key(resource_id(iri)), F.when(own != "", own).otherwise(text)).otherwise(text)


def precipitation_text(rain: Column, precipitation: Column) -> Column:
    """``Sin lluvia`` if both are measured as 0, else the rain, else the precipitation, else nothing."""
    there = lambda c: F.when(~F.isnan(c.cast("double")), c.cast("double"))
    r, p = there(rain), there(precipitation)
    return F.when((r == 0) & (p == 0), "Sin lluvia").when(r.isNotNull(), F.concat(F.lit("Lluvia "), format_number(r, 1, " mm"))).when(p.isNotNull(), F.concat(F.lit("Precip. "), format_number(p, 1, " mm"))).otherwise("")


def weather_summary(temperature: Column, rain: Column, precipitation: Column) -> Column:
    """Temperature and rain, ``-`` without either."""
    degrees = F.when(temperature.isNotNull() & ~F.isnan(temperature.cast("double")), format_number(temperature, 1, " C"))
    shown = F.concat_ws(" | ", degrees, F.when(precipitation_text(rain, precipitation) != "", precipitation_text(rain, precipitation)))
    return F.when(shown != "", shown).otherwise("-")


def share_of(own: Column, other: Column) -> Column:
    """Percent of two absolute values that is ``own``; 0 where both are 0 or missing."""
    a, b = (F.abs(F.coalesce(c.cast("double"), F.lit(0.0))) for c in (own, other))
    return F.when(a + b > 0, a / (a + b) * 100).otherwise(F.lit(0.0))


def penalty_goals(goals: Column, without_penalties: Column) -> Column:
    """Goals from penalties; never below 0."""
    return F.greatest(F.coalesce(goals, F.lit(0)) - F.coalesce(without_penalties, F.lit(0)), F.lit(0))


def scaled(value: Column, low: Column, high: Column, begin: float, length: float, reverse: bool = False) -> Column:
    """A value between two ends as a coordinate; ``reverse`` counts from the far end."""
    ratio = (value - low) / F.nullif(high - low, F.lit(0.0))
    return F.lit(begin) + (1 - ratio if reverse else ratio) * length


def padded_range(low: Column, high: Column) -> Column:
    """Struct (low, high) of a chart: 8 percent but 15 at least on either side, 20 around a single value."""
    pad = F.when(low == high, F.lit(20.0)).otherwise(F.greatest((high - low) * 0.08, F.lit(15.0)))
    return F.struct((low - pad).alias("low"), (high + pad).alias("high"))


def season_order(label: Column) -> Column:
    """Struct (start, end, label) by which seasons are sorted; the years a label names, 0 without."""
    parts = F.filter(F.split(F.translate(F.coalesce(label, F.lit("")), "/", "-"), "-"), lambda p: p.rlike(r"^\d+$"))
    start = F.coalesce(F.get(parts, F.lit(0)).cast("int"), F.lit(0))
    return F.struct(start.alias("start"), F.coalesce(F.get(parts, F.lit(1)).cast("int"), start).alias("end"), label.alias("label"))


def preferred(requested: Column, fallback: Column, wanted: Column, available: Column) -> Column:
    """The requested value if it is available, else the fallback (unless ``all``), else the first wanted one, else the first at all."""
    has = lambda c: F.when(F.array_contains(available, c) & (c != ""), c)
    chosen = F.coalesce(has(requested), F.when(fallback != "all", has(fallback)), F.get(F.array_intersect(wanted, available), F.lit(0)), F.get(available, F.lit(0)))
    return F.coalesce(chosen, F.lit(""))


def tie_or_winner(a: Column, b: Column) -> Column:
    """``a``, ``b`` or ``tie`` of two values, missing ones as 0; less than 1e-7 apart is a tie."""
    x, y = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (a, b))
    return F.when(F.abs(x - y) < 1e-7, "tie").when(x > y, "a").otherwise("b")
