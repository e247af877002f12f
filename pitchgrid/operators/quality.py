"""Declarative checks: one aggregate per table, one row per rule with its severity and count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUE_WORDS = ["true", "1", "yes", "y", "si", "sí"]
FALSE_WORDS = ["false", "0", "no", "n"]
#: Tolerance of the integer check on text (fixed value).
EPSILON = 1e-9


@dataclass(frozen=True)
class Rule:
    """A named condition that a row must not fulfil."""

    name: str
    fails: Column
    severity: str = "error"


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))


def missing(c: str) -> Rule:
    return Rule(f"missing:{c}", blank(c))


def outside(c: str, low: float | None = None, high: float | None = None, integer: bool = False, severity: str = "error") -> Rule:
    """Text that is no number of the range; NULL and blank pass, NaN fails."""
    n = F.col(c).cast("string").try_cast("double")
    bad = n.isNull() | F.isnan(n)
    for bound, over in ((low, lambda b: n < b), (high, lambda b: n > b)):
        if bound is not None:
            bad = bad | over(bound)
    if integer:
        bad = bad | (F.abs(n - F.round(n)) > EPSILON)
    return Rule(f"range:{c}", ~blank(c) & F.coalesce(bad, F.lit(True)), severity)


def not_in(c: str, allowed: list[str]) -> Rule:
    return Rule(f"allowed:{c}", ~blank(c) & ~F.lower(F.trim(c)).isin(allowed))


def not_boolean(c: str) -> Rule:
    return not_in(c, TRUE_WORDS + FALSE_WORDS)


def not_a_date(c: str) -> Rule:
    return Rule(f"date:{c}", ~blank(c) & F.col(c).cast("string").try_cast("timestamp").isNull())


def bad_minute(c: str) -> Rule:
    """Neither ``start`` nor a number from 0 on."""
    n = F.trim(c).try_cast("double")
    return Rule(f"minute:{c}", ~blank(c) & (F.lower(F.trim(c)) != "start") & F.coalesce(n < 0, F.lit(True)))


def check(df: DataFrame, table: str, rules: list[Rule]) -> DataFrame:
    """(tab, rule, severity, failures) of all rules over one table, in one pass; an empty table fails none."""
    counts = df.agg(*[F.coalesce(F.sum(F.when(r.fails, 1).otherwise(0)), F.lit(0)).alias(f"r{i}") for i, r in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"r{i}").cast("long").alias("failures")) for i, r in enumerate(rules)])
    return counts.select(F.lit(table).alias("tab"), F.inline(rows))


def unique_key(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """The number of keys that more than one row has."""
    twice = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return twice.agg(F.count("*").alias("failures")).select(F.lit(table).alias("tab"), F.lit("unique:" + ",".join(key)).alias("rule"), F.lit("error").alias("severity"), "failures")


def closed_reference(df: DataFrame, table: str, key: str, parents: DataFrame, target: str) -> DataFrame:
    """The number of rows whose non-blank reference has no record."""
    lost = df.where(~blank(key)).select(F.col(key).alias("_k")).join(parents.select(F.col(target).alias("_k")), "_k", "left_anti")
    return lost.agg(F.count("*").alias("failures")).select(F.lit(table).alias("tab"), F.lit(f"reference:{key}").alias("rule"), F.lit("error").alias("severity"), "failures")


def artifact(df: DataFrame, table: str, required: list[str], key: str) -> DataFrame:
    """Artefact check: required columns there, not empty, key filled and unique."""
    lost = [c for c in required if c not in df.columns]
    columns = df.sparkSession.createDataFrame([(table, f"column:{c}", "error", 1) for c in lost], "tab string, rule string, severity string, failures long")
    if key not in df.columns:
        return columns
    size = df.agg((F.count("*") == 0).cast("long").alias("failures")).select(F.lit(table).alias("tab"), F.lit("not_empty").alias("rule"), F.lit("error").alias("severity"), "failures")
    return columns.unionByName(size).unionByName(check(df, table, [missing(key)])).unionByName(unique_key(df, table, [key]))


def _rule_row(df: DataFrame, table: str, rule: str, severity: str = "error") -> DataFrame:
    """The number of rows of ``df`` as the failures of a rule."""
    return df.agg(F.count("*").alias("failures")).select(F.lit(table).alias("tab"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "failures")


def match_cardinality(participation: DataFrame, active: DataFrame, table: str) -> DataFrame:
    """Matches without exactly two teams, matches without exactly one home team, players with two teams in a match.

    ``participation`` has id_match, id_team, id_player and is_home; ``active`` the matches that must be complete. A
    match without any row has no team.
    """
    rows = participation.join(active.select("id_match").distinct(), "id_match", "left_semi")
    per = rows.groupBy("id_match").agg(F.countDistinct(F.when(~blank("id_team"), F.col("id_team"))).alias("teams"), F.countDistinct(F.when(F.col("is_home"), F.col("id_team"))).alias("homes"))
    per = active.select("id_match").distinct().join(per, "id_match", "left")
    twice = rows.where(~blank("id_player")).groupBy("id_match", "id_player").agg(F.countDistinct("id_team").alias("n")).where("n > 1")
    return (
        _rule_row(per.where("coalesce(teams, 0) <> 2"), table, "two_teams")
        .unionByName(_rule_row(per.where("coalesce(homes, 0) <> 1"), table, "one_home_team"))
        .unionByName(_rule_row(twice, table, "one_team_per_player"))
    )


def weather_iff_ground(active: DataFrame, observed: DataFrame, grounds: DataFrame) -> DataFrame:
    """Active matches at a known ground (``venue``) without weather, and those at an unknown one with it."""
    known = active.join(grounds.select("venue").distinct().withColumn("_g", F.lit(True)), "venue", "left").join(observed.select("id_match").distinct().withColumn("_w", F.lit(True)), "id_match", "left")
    return _rule_row(known.where("_g and _w is null"), "weather_observations", "weather_at_known_ground").unionByName(_rule_row(known.where("_g is null and _w"), "weather_observations", "no_weather_without_ground", "warning"))


def reconciled(raw: DataFrame, canonical: DataFrame, key: str, scope: DataFrame, scope_key: str, table: str) -> DataFrame:
    """By how many rows the canonical table differs from the distinct raw ones of the scope."""
    rows = raw.join(scope.select(scope_key).distinct(), scope_key, "left_semi").select(key).distinct().agg(F.count("*").alias("a"))
    own = canonical.join(scope.select(scope_key).distinct(), scope_key, "left_semi").agg(F.count("*").alias("b"))
    both = rows.join(own)  # one row each
    return both.select(F.lit(table).alias("tab"), F.lit("reconciled").alias("rule"), F.lit("error").alias("severity"), F.abs(F.col("a") - F.col("b")).alias("failures"))


def one_id_per_source(players: DataFrame, table: str, ids: list[str], key: str = "id_player") -> DataFrame:
    """Source ids that more than one player holds, one rule per source."""
    out = None
    for c in ids:
        shared = players.where(~blank(c)).groupBy(c).agg(F.countDistinct(key).alias("n")).where("n > 1")
        row = _rule_row(shared, table, f"one_player:{c}")
        out = row if out is None else out.unionByName(row)
    return out


def check_file(path: str, kind: str) -> list[str]:
    """What is wrong with an artefact on disk: not there, empty, JSON that is no object or list, or Turtle without a triple.

    Driver-side and bounded: a file's first bytes and, for JSON, the file itself are read.
    """
    import json
    from pathlib import Path

    file = Path(path)
    if not file.exists():
        return ["missing"]
    if file.is_file() and file.stat().st_size == 0 or file.is_dir() and not any(file.iterdir()):
        return ["empty"]
    if kind == "json":
        try:
            content = json.loads(file.read_text(encoding="utf-8"))
        except ValueError as error:
            return [f"invalid:{error}"]
        return [] if isinstance(content, dict | list) else ["invalid:neither object nor list"]
    if kind == "ttl":
        with file.open(encoding="utf-8") as lines:
            told = any(line.strip().endswith(".") and not line.lstrip().startswith(("#", "@", "PREFIX", "BASE")) for line in lines)
        return [] if told else ["no_triples"]
    return []
