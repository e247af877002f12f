"""Mixed timestamp texts to one unambiguous form: one regex alternation, integer day arithmetic."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400
#: Names of months as they are written, by number (fixed values).
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Zone abbreviations that denote one offset, in minutes (fixed values).
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120, "EET": 120, "EEST": 180, "MSK": 180}
#: Zones under the European Union's rule (last Sundays of March and October, 01:00 UTC): winter offset in minutes (fixed values).
EU_ZONES = {
    "Atlantic/Canary": 0, "Atlantic/Madeira": 0, "Europe/Lisbon": 0, "Europe/London": 0, "Europe/Dublin": 0,
    "Africa/Ceuta": 60, "Europe/Madrid": 60, "Europe/Paris": 60, "Europe/Berlin": 60, "Europe/Rome": 60, "Europe/Vienna": 60,
    "Europe/Brussels": 60, "Europe/Amsterdam": 60, "Europe/Zurich": 60, "Europe/Prague": 60, "Europe/Warsaw": 60,
    "Europe/Budapest": 60, "Europe/Copenhagen": 60, "Europe/Stockholm": 60, "Europe/Oslo": 60, "Europe/Belgrade": 60,
    "Europe/Athens": 120, "Europe/Helsinki": 120, "Europe/Bucharest": 120, "Europe/Sofia": 120,
}
#: First year in which all these zones follow that rule; for earlier years, and for zones not listed, the offset is
#: the one of the JVM's own zone rules.
EU_SINCE = 1997
#: First and last year that is taken for real.
YEARS = (1800, 2200)

_NAME = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_ZONE = r"z|[+-]\d{2}(?::?\d{2})?|\(?(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?\)?|\[?[a-z]+(?:/[a-z0-9_+\-]+)+\]?|\(?[a-z]{1,5}\)?"
#: Groups: y year, m month in figures, n month in letters, d day, a and b day or month, k compact day, e epoch, h, i, s, f, p, z.
_DAYS = [
    r"(?<y1>\d{4})(?<q1>[-/.])(?<m1>\d{1,2})\k<q1>(?<d1>\d{1,2})",
    r"(?<a1>\d{1,2})(?<q2>[-/.])(?<b1>\d{1,2})\k<q2>(?<y2>\d{4}|\d{2})",
    rf"{_WEEKDAY}(?<d2>\d{{1,2}})[-/. ]\s*(?<n1>{_NAME})[-/. ,]\s*(?<y3>\d{{4}}|\d{{2}})",
    rf"{_WEEKDAY}(?<n2>{_NAME})\s*(?<d3>\d{{1,2}}),?\s+(?<y4>\d{{4}})",
    r"(?<y5>\d{4})(?<m2>\d{2})(?<d4>\d{2})",
]
_TIME = r"(?<h1>\d{1,2})(?::(?<i1>\d{2})(?::(?<s1>\d{2})(?:[.,](?<f1>\d{1,9}))?)?)?(?:\s*(?<p1>[ap])\.?m\b\.?)?(?:\s*uhr)?"
_COMPACT = r"(?<h2>\d{2})(?<i2>\d{2})(?<s2>\d{2})?(?:[.,](?<f2>\d{1,9}))?"
PATTERN = (
    r"(?is)^\s*(?:(?<e1>\d{12,13})|(?<e2>\d{9,10})|"
    rf"(?:{'|'.join(_DAYS)})(?:(?:t|,?\s+|,)(?:{_COMPACT}(?!:)|{_TIME}))?(?:\s*(?<z1>{_ZONE}))?)\s*$"
)
_GROUPS = {"y": 5, "m": 2, "n": 2, "d": 4, "a": 1, "b": 1, "e": 2, "h": 2, "i": 2, "s": 2, "p": 1, "z": 1}
_SPLIT = "\x01"


def components(text: Column) -> Column:
    """Map-like struct of the groups of :data:`PATTERN`, from one pass of the regex; NULL without a match.

    The replacement names every spelling of a group; only one alternative matches, so the others are empty.
    """
    form = _SPLIT.join("".join(f"${{{g}{i}}}" for i in range(1, n + 1)) for g, n in _GROUPS.items()) + _SPLIT + "${e1}"
    parts = F.split(F.when(text.rlike(PATTERN), F.regexp_replace(text, F.lit(PATTERN), F.lit(form))), _SPLIT, -1)
    return F.struct(*[F.get(parts, F.lit(k)).alias(g) for k, g in enumerate([*_GROUPS, "ms"])])


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers.

    The year is counted from March, so that the leap day is its last; 306 days lie before the year's March 1.
    """
    year = y - (m <= 2).cast("int")
    of_year = F.floor((F.lit(153) * F.pmod(m + 9, F.lit(12)) + 2) / 5) + d - 1
    return (365 * year + F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400) + of_year - 719_468).cast("long")


def month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _switch(year: Column, month: int) -> Column:
    """Second at which the European rule switches: 01:00 UTC on the last Sunday of a month of 31 days."""
    last = days_from_civil(year, F.lit(month), F.lit(31))
    return (last - F.pmod(last + 4, F.lit(7))) * DAY + 3600


def _lookup(keys: dict[str, int], key: Column) -> Column:
    """Number of a constant key; NULL where the key is missing."""
    found = F.lit(None).cast("long")
    for value in sorted(set(keys.values())):
        found = F.when(key.isin(sorted(k.lower() for k, v in keys.items() if v == value)), F.lit(value).cast("long")).otherwise(found)
    return found


def _zone_ids() -> Column:
    """Map literal from every zone name that the JVM knows, in lower case, to its spelling."""
    names = sorted(str(x) for x in SparkContext._active_spark_context._jvm.java.time.ZoneId.getAvailableZoneIds())
    return F.create_map(*[F.lit(x) for name in names if "/" in name for x in (name.lower(), name)])


def _utc_by_rules(local: Column, zone: Column) -> Column:
    """The instant of a wall time in a named zone by the JVM's zone rules; the earlier one if it occurs twice."""
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), zone))


def _year(seconds: Column) -> Column:
    return F.year(F.date_from_unix_date(F.floor(seconds / DAY).cast("int")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def epoch_seconds(text: Column, zone: Column) -> Column:
    """The UTC instant of ``text`` in seconds, fractions dropped; NULL where it denotes none.

    Text without zone is wall time of ``zone``, of UTC where that is NULL. A zone under the European rule is
    integer arithmetic; another named one, or a year before :data:`EU_SINCE`, goes by the JVM's zone rules. Of
    a wall time that occurs twice the earlier instant counts; one inside a gap moves on by it. The day
    precedes the month unless that is impossible. All digits: 8 a day, 9 or 10 epoch seconds, 12 or 13
    epoch milliseconds. Blank or NULL text, parts out of their calendar range and unknown zones give
    NULL; texts of any length are tried whole. Every step is an expression of the JVM.
    """
    return _let(components(text), lambda g: _let(_parts(g), lambda a: _let(_fields(g, a, zone), lambda b: _let(_clock(a, b), lambda c: _instant(g, a, b, c)))))


def _number(g: Column, name: str) -> Column:
    return g[name].try_cast("long")


def _parts(g: Column) -> Column:
    h, pm = _number(g, "h"), F.lower(g["p"])
    return F.struct(
        ((_number(g, "b") > 12) & (_number(g, "a") <= 12)).alias("swap"),
        F.when(F.length(g["y"]) == 2, _number(g, "y") + F.when(_number(g, "y") < 70, 2000).otherwise(1900)).otherwise(_number(g, "y")).alias("y"),
        F.when(g["h"] == "", 0).when(pm == "", h).when(h.between(1, 12), h % 12 + F.when(pm == "p", 12).otherwise(0)).cast("long").alias("h"),
        F.coalesce(_number(g, "i"), F.lit(0)).cast("long").alias("i"),
        F.coalesce(_number(g, "s"), F.lit(0)).cast("long").alias("s"),
        F.lower(F.translate(g["z"], "[]() ", "")).alias("z"),
    )


def _fields(g: Column, a: Column, zone: Column) -> Column:
    named = (F.instr(F.lit("".join(MONTHS)), F.lower(F.substring(g["n"], 1, 3))) + 2) / 3
    z = a["z"]
    offset = F.regexp_replace(F.regexp_extract(z, r"[+-]([\d:]+)$", 1), ":", "")
    return F.struct(
        F.coalesce(_number(g, "m"), F.when(g["n"] != "", named), F.when(a["swap"], _number(g, "a")).otherwise(_number(g, "b"))).cast("long").alias("m"),
        F.coalesce(_number(g, "d"), F.when(a["swap"], _number(g, "b")).otherwise(_number(g, "a"))).alias("d"),
        F.regexp_extract(z, r"([+-])\d", 1).alias("sign"),
        F.when(F.length(offset) <= 2, F.concat(offset, F.lit("00"))).otherwise(offset).try_cast("long").alias("off"),
        _lookup(EU_ZONES, F.when(z == "", F.lower(zone)).otherwise(z)).alias("eu"),
        _lookup(ABBREVIATIONS, z).alias("fixed"),
        F.when(z.contains("/") | ((z == "") & zone.isNotNull()), F.element_at(_zone_ids(), F.when(z == "", F.lower(zone)).otherwise(z))).alias("named"),
    )


def _clock(a: Column, b: Column) -> Column:
    y, m, d, h = a["y"], b["m"], b["d"], a["h"]
    clock = ((h <= 23) | ((h == 24) & (a["i"] == 0) & (a["s"] == 0))) & (a["i"] <= 59) & (a["s"] <= 59)
    valid = y.between(*YEARS) & m.between(1, 12) & (d >= 1) & (d <= month_length(y, m)) & clock
    hours, minutes = F.floor(b["off"] / 100), b["off"] % 100
    return F.struct(
        F.when(valid, days_from_civil(y, m, d) * DAY + h * 3600 + a["i"] * 60 + a["s"]).alias("local"),
        F.when((hours <= 15) & (minutes <= 59), F.when(b["sign"] == "-", -1).otherwise(1) * (hours * 60 + minutes) * 60).alias("shift"),
    )


def _instant(g: Column, a: Column, b: Column, c: Column) -> Column:
    local, early = c["local"], c["local"] - b["eu"] * 60 - 3600
    summer = (early >= _switch(a["y"], 3)) & (early < _switch(a["y"], 10))
    instant = (
        F.when(b["sign"] != "", local - c["shift"])
        .when(b["fixed"].isNotNull(), local - b["fixed"] * 60)
        .when(b["eu"].isNotNull() & (a["y"] >= EU_SINCE), F.when(summer, early).otherwise(early + 3600))
        .when(b["named"].isNotNull(), _utc_by_rules(local, b["named"]))
        .when(a["z"] == "", local)
    )
    epoch = F.when(g["ms"] != "", F.floor(_number(g, "ms") / 1000)).when(g["e"] != "", _number(g, "e"))
    return F.coalesce(epoch, instant).cast("long")


def with_instants(rows: DataFrame, text: str = "text", zone: str = "zone") -> DataFrame:
    """``rows`` and their ``seconds``, see :func:`epoch_seconds`."""
    return rows.withColumn("seconds", epoch_seconds(F.col(text), F.col(zone)))


def iso_instant(seconds: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ``."""
    rest = F.pmod(seconds, F.lit(DAY))
    day = F.date_format(F.date_from_unix_date(F.floor(seconds / DAY).cast("int")), "yyyy-MM-dd")
    return F.concat(day, F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60))


def local_day(seconds: Column, zone: str) -> Column:
    """Calendar day ``YYYY-MM-DD`` of an instant in a zone; see :func:`epoch_seconds` for the rules."""
    by_rules = lambda s: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), zone))

    def day(x: Column) -> Column:
        shifted = by_rules(x["s"])
        if zone in EU_ZONES:
            summer = (x["s"] >= _switch(x["y"], 3)) & (x["s"] < _switch(x["y"], 10))
            shifted = F.when(x["y"] >= EU_SINCE, x["s"] + EU_ZONES[zone] * 60 + F.when(summer, 3600).otherwise(0)).otherwise(shifted)
        return F.date_format(F.date_from_unix_date(F.floor(shifted / DAY).cast("int")), "yyyy-MM-dd")

    return _let(F.struct(seconds.alias("s"), _year(seconds).alias("y")), day)


def normalise_times(df: DataFrame, tab: str, row_id: str, fields: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(tab, row_id, field, norm) of the text columns of one table; texts without a date give no row.

    ``fields`` gives each column's kind, ``day`` or ``instant``, and the zone of texts without one (NULL:
    UTC; days are those of that zone). Repeated rows come out once; NULL ids stay; an empty table gives
    no rows; no other column is read, so none can clash.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("field"), F.lit(kind).alias("kind"), F.lit(zone).cast("string").alias("zone"), F.col(f"`{c}`").cast("string").alias("text"))
        for c, (kind, zone) in fields.items()
    ])
    rows = df.select(F.col(f"`{row_id}`").alias("row_id"), F.inline(cells)).where("text is not null")
    timed = with_instants(rows).where("seconds is not null")
    day = F.when(F.col("kind") == "day", F.lit(None).cast("string"))
    for zone in {zone or "UTC" for kind, zone in fields.values() if kind == "day"}:
        own = iso_instant(F.col("seconds")).substr(1, 10) if zone == "UTC" else local_day(F.col("seconds"), zone)
        day = F.when((F.col("kind") == "day") & (F.coalesce("zone", F.lit("UTC")) == zone), own).otherwise(day)
    norm = F.when(F.col("kind") == "instant", iso_instant(F.col("seconds"))).otherwise(day)
    return timed.select(F.lit(tab).alias("tab"), "row_id", "field", norm.alias("norm")).distinct()
