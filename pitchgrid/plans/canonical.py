"""Canonical tables from raw source tables: catalogues, matches, sides, standings, ratings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.functions import text as X
from pitchgrid.operators.dedup import first_non_empty, keep_last
from pitchgrid.operators.lookup import fallback_lookup


def catalogue(sources: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Entities of several sources: per key and column the first value in the order of the sources."""
    parts = [df.select(key, *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns], F.struct(F.lit(i).alias("source"), *[F.col(c).cast("string").alias(f"o{k}") for k, c in enumerate(df.columns)]).alias("_all")) for i, df in enumerate(sources)]
    flat = reduce(DataFrame.unionByName, [p.withColumn("_ord", F.struct(p["_all"]["source"].alias("i"), F.to_json("_all").alias("j"))).drop("_all") for p in parts])
    return first_non_empty(flat.where(F.col(key).isNotNull()), [key], columns, "_ord")


def competitions(raw: DataFrame) -> DataFrame:
    """One row per league: id, display name, source id."""
    rows = raw.select(X.competition_id(F.col("league")).alias("id_competition"), X.competition_name(F.col("league")).alias("name"), X.source_id(F.col("league_id")).alias("idUnderstat"), F.col("league").alias("_ord"))
    return first_non_empty(rows.where("id_competition is not null"), ["id_competition"], ["name", "idUnderstat"], "_ord")


def seasons(raw: DataFrame) -> DataFrame:
    rows = raw.select(X.season_id(F.col("season")).alias("id_season"), X.source_id(F.col("season_id")).alias("id_understat"), F.col("season").alias("_ord"))
    return first_non_empty(rows.where("id_season is not null"), ["id_season"], ["id_understat"], "_ord").withColumn("name", X.season_label(F.col("id_season")))


def _keys(df: DataFrame, day: Column) -> DataFrame:
    comp, season = X.competition_id(F.col("league")), X.season_id(F.col("season"))
    home, away = X.identifier(F.col("home_team")), X.identifier(F.col("away_team"))
    return df.withColumns({"id_competition": comp, "id_season": season, "id_home_team": home, "id_away_team": away, "day": day}).withColumns({
        "match_key": X.key_of(F.col("day"), F.col("id_home_team"), F.col("id_away_team")),
        "matchup_key": X.key_of(F.col("id_competition"), F.col("id_season"), F.col("id_home_team"), F.col("id_away_team")),
    })


def matches(schedule: DataFrame, extra: DataFrame, values: list[str]) -> DataFrame:
    """Matches of the main schedule with ``values`` of another source.

    The other source is found by day and teams, else by competition, season and teams where that is
    unique. The key uses the source's own day; ``date`` is the day in Madrid of the instant. Of repeated
    matches the last row counts.
    """
    base = _keys(schedule, X.date_part(F.col("date"))).withColumn("instant", F.col("date").try_cast("timestamp"))
    base = base.withColumn("date", F.coalesce(F.date_format(F.from_utc_timestamp("instant", "Europe/Madrid"), "yyyy-MM-dd"), "day"))
    other = _keys(extra, X.date_part(F.col("date"))).select("match_key", "matchup_key", *values, "_ord")
    joined = fallback_lookup(base, other, ["match_key"], ["matchup_key"], values, ["_ord"])
    ident = X.match_id(F.col("id_competition"), F.col("id_season"), F.col("date"), F.col("id_home_team"), F.col("id_away_team"))
    return keep_last(joined.withColumn("id_match", ident), ["id_match"], ["_ord"])


def sides(m: DataFrame, stats: list[str]) -> DataFrame:
    """Two rows per match, one per team, with that side's columns ``home_x`` and ``away_x`` as ``x``."""
    side = lambda s, home: F.struct(F.col(f"id_{s}_team").alias("id_team"), F.lit(home).alias("isHome"), *[F.col(f"{s}_{c}").alias(c) for c in stats])
    out = m.select("id_match", F.inline(F.array(side("home", True), side("away", False))))
    return out.withColumn("id_teamMatchParticipation", F.concat_ws("_", "id_match", "id_team"))


def league_positions(table: DataFrame) -> DataFrame:
    """Standings with the position each team has by its place in the input (``_ord``)."""
    rows = table.withColumns({"id_competition": X.competition_id(F.col("league")), "id_season": X.season_id(F.col("season")), "id_team": X.identifier(F.col("team"))})
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("id_competition", "id_season").orderBy("_ord"))).drop("league", "season", "team")


def ratings(history: DataFrame) -> DataFrame:
    """Rating intervals; of the same team and start the last row counts."""
    rows = history.select(X.identifier(F.col("team")).alias("id_team"), F.col("from").try_cast("date").alias("dateFrom"), F.col("to").try_cast("date").alias("dateTo"), X.whole(F.col("rank")).alias("rank"), X.whole(F.col("level")).alias("level"), X.number(F.col("elo")).alias("elo"), "_ord")
    key = F.concat_ws("_", "id_team", F.coalesce(F.col("dateFrom").cast("string"), F.lit("unknown_date")))
    return keep_last(rows.withColumn("id_eloRecord", key), ["id_eloRecord"], ["_ord"]).drop("_ord")


def clear_unavailable(p: DataFrame, columns: list[str]) -> DataFrame:
    """Participations of players who were not available lose their figures; the two words for it become one."""
    gone = F.lower(F.trim("participationStatus")).isin("no disponible", "no convocado")
    cleared = {c: F.when(~F.coalesce(gone, F.lit(False)), F.col(c)) for c in columns}
    return p.withColumns({**cleared, "participationStatus": F.when(gone, "no disponible").otherwise(F.col("participationStatus"))})
