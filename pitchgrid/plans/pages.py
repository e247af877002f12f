"""The pages' queries: match header, events, lines, shares, timeline; player and team sheets; options and comparisons.

Each query answers for all matches, players or teams at once; a page filters one of them. SQL beside a
query is written from the page's rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchgrid.functions import display as D
from pitchgrid.functions import events as E
from pitchgrid.functions.text import first_present, label_key, ratio
from pitchgrid.operators.orphans import bare
from pitchgrid.plans.football import COUNTERS, QUERIES as _FOOTBALL, SQL as _FOOTBALL_SQL, _CTE, events, matches, participations, season_table, sides, team_match_stats  # noqa: F401
from pitchgrid.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = "", more: str = ""):
    """Register a query with its SQL over the cleaned tables; ``more`` are further named subqueries."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _CTE + more + sql
        return f

    return register


_SHOWN = """coalesce(CASE WHEN {c} IS NULL THEN '-' ELSE {c}::varchar END, '-')"""
_WEATHER = r""", w AS (SELECT trim(id_match, E' \t\n\r') AS id_match, max(temperature) FILTER (NOT isnan(temperature)) AS temperature, max(rain) FILTER (NOT isnan(rain)) AS rain, max(precipitation) FILTER (NOT isnan(precipitation)) AS precipitation
FROM weather_observations WHERE trim(id_match, E' \t\n\r') <> '' GROUP BY 1),
names AS (SELECT id_team, min(name) AS label FROM teams GROUP BY id_team),
grounds AS (SELECT trim(v) AS venue, min_by(city, id_stadium) FILTER (trim(city) <> '') AS city, min_by(country, id_stadium) FILTER (trim(country) <> '') AS country FROM (SELECT id_stadium, city, country, unnest(string_split(venue_name, '|')) AS v FROM stadiums) WHERE trim(v) <> '' GROUP BY 1)
"""


def _team_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "teams").groupBy("id_team").agg(F.min("name").alias("label"))


def _weather(spark: SparkSession, d: str) -> DataFrame:
    number = lambda c: F.max(F.when(~F.isnan(c), F.col(c))).alias(c)
    w = table(spark, d, "weather_observations").select(bare(F.col("id_match")).alias("id_match"), "temperature", "rain", "precipitation")
    return w.where("id_match is not null").groupBy("id_match").agg(number("temperature"), number("rain"), number("precipitation"))


def _grounds(spark: SparkSession, d: str) -> DataFrame:
    """(venue, city, country) of every venue name that a ground is reported under."""
    s = table(spark, d, "stadiums").select("id_stadium", "city", "country", F.explode(F.split("venue_name", r"\|")).alias("v")).select("id_stadium", "city", "country", F.trim("v").alias("venue"))
    first = lambda c: F.min_by(c, F.when(F.trim(c) != "", F.col("id_stadium"))).alias(c)
    return s.where("venue <> ''").groupBy("venue").agg(first("city"), first("country"))


def _labelled(m: DataFrame, names: DataFrame) -> DataFrame:
    """Matches with the labels of both teams; an id without a name is its own label."""
    home, away = names.select(F.col("id_team").alias("home"), F.col("label").alias("_h")), names.select(F.col("id_team").alias("away"), F.col("label").alias("_a"))
    return m.join(home, "home", "left").join(away, "away", "left").withColumns({"home_label": F.coalesce("_h", "home"), "away_label": F.coalesce("_a", "away")}).drop("_h", "_a")


def _score(home: str, away: str) -> Column:
    both = F.concat(D.format_number(F.col(home)), F.lit(" - "), D.format_number(F.col(away)))
    return F.when(F.col(home).isNull() & F.col(away).isNull(), "-").otherwise(both)


_SCORE = "CASE WHEN {h} IS NULL AND {a} IS NULL THEN '-' ELSE coalesce({h}::varchar, '-') || ' - ' || coalesce({a}::varchar, '-') END"
_RESULT = "CASE WHEN upper(trim(coalesce({c}, ''))) IN ('H', 'HOME', 'LOCAL') THEN 'Gana ' || home_label WHEN upper(trim(coalesce({c}, ''))) IN ('A', 'AWAY', 'VISITANTE') THEN 'Gana ' || away_label WHEN upper(trim(coalesce({c}, ''))) IN ('D', 'DRAW', 'EMPATE') THEN 'Empate' WHEN trim(coalesce({c}, '')) <> '' THEN trim({c}) ELSE '-' END"
_RAIN = "CASE WHEN rain = 0 AND precipitation = 0 THEN 'Sin lluvia' WHEN rain IS NOT NULL THEN 'Lluvia ' || printf('%.1f', rain) || ' mm' WHEN precipitation IS NOT NULL THEN 'Precip. ' || printf('%.1f', precipitation) || ' mm' END"
_FULL = """, mm AS (SELECT DISTINCT id_match, id_competition, id_season, id_home_team AS home, id_away_team AS away, name, matchDay, homeScore, awayScore, attendance, halftimeHomeScore, halftimeAwayScore, halftimeResult, finalResult, venue, regexp_extract(id_match, '_(\\d{4}-\\d{2}-\\d{2})_', 1) AS day
FROM matches WHERE lower(trim(coalesce(matchStatus, ''))) <> 'abandoned'), ml AS (SELECT mm.*, coalesce(h.label, home) AS home_label, coalesce(a.label, away) AS away_label FROM mm LEFT JOIN names h ON h.id_team = home LEFT JOIN names a ON a.id_team = away)
"""
_HEADER = ["halftimeHomeScore", "halftimeAwayScore", "halftimeResult", "finalResult", "venue"]


@query(
    f"""SELECT id_match, strftime(strptime(day, '%Y-%m-%d'), '%d/%m/%Y') AS shown_day, coalesce(matchDay::varchar, '-') AS week, home_label, away_label, {_SCORE.format(h='homeScore', a='awayScore')} AS score, {_SCORE.format(h='halftimeHomeScore', a='halftimeAwayScore')} AS half_time,
{_RESULT.format(c='halftimeResult')} AS half_result, {_RESULT.format(c='finalResult')} AS result, coalesce(nullif(trim(ml.venue), ''), 'Estadio no disponible') AS ground, nullif(concat_ws(', ', nullif(trim(city), ''), CASE WHEN trim(country) <> trim(coalesce(city, '')) THEN trim(country) END), '') AS place_of,
coalesce(attendance::varchar, 'Informacion no disponible') AS attendance, coalesce(nullif(concat_ws(' | ', printf('%.1f', temperature) || ' C', {_RAIN}), ''), '-') AS weather FROM ml LEFT JOIN w USING (id_match) LEFT JOIN grounds g ON g.venue = trim(ml.venue)""",
    _WEATHER + _FULL,
)
def match_headers(spark: SparkSession, d: str) -> DataFrame:
    """Header of every match: day, week, teams, scores and results of both ends, ground, attendance, weather."""
    m = _labelled(matches(spark, d, *_HEADER), _team_names(spark, d)).withColumn("venue", F.trim("venue"))
    m = m.join(_weather(spark, d), "id_match", "left").join(_grounds(spark, d), "venue", "left")
    city, country = (F.when(F.trim(c) != "", F.trim(c)) for c in ("city", "country"))
    place = F.concat_ws(", ", city, F.when(country != F.coalesce(city, F.lit("")), country))
    result = lambda c: E.result_label(F.col(c), F.col("home_label"), F.col("away_label"))
    return m.select(
        "id_match", D.format_display_date(F.col("day")).alias("shown_day"), F.coalesce(F.col("matchDay").cast("string"), F.lit("-")).alias("week"), "home_label", "away_label",
        _score("homeScore", "awayScore").alias("score"), _score("halftimeHomeScore", "halftimeAwayScore").alias("half_time"), result("halftimeResult").alias("half_result"), result("finalResult").alias("result"),
        F.coalesce(F.when(F.col("venue") != "", F.col("venue")), F.lit("Estadio no disponible")).alias("ground"), F.when(place != "", place).alias("place_of"),
        F.coalesce(F.col("attendance").cast("string"), F.lit("Informacion no disponible")).alias("attendance"), D.weather_summary(F.col("temperature"), F.col("rain"), F.col("precipitation")).alias("weather"),
    )


@query(
    """SELECT id_match, matchDay AS week, day, home_label, away_label, homeScore, awayScore, city, country, temperature, row_number() OVER (ORDER BY CASE WHEN matchDay > 0 THEN matchDay ELSE 999 END, nullif(day, '') NULLS LAST, split_part(label, ' vs ', 1), id_match) AS place
FROM (SELECT ml.* EXCLUDE (home_label, away_label), split_part(coalesce(name, id_match), ' vs ', 1) AS home_label, CASE WHEN contains(coalesce(name, id_match), ' vs ') THEN substr(coalesce(name, id_match), strpos(coalesce(name, id_match), ' vs ') + 4) ELSE '-' END AS away_label, coalesce(name, id_match) AS label, city, country, temperature
FROM ml LEFT JOIN w USING (id_match) LEFT JOIN grounds g ON g.venue = trim(ml.venue)) WHERE day BETWEEN '2023-01-01' AND '2024-12-31' AND matchDay IN (1, 2, 3, 4, 5)""",
    _WEATHER + _FULL,
)
def filtered_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches of the chosen weeks and days with ground and weather, in the page's order; the filter is the page's own.

    The order runs over the filtered result as a whole, as a page shows it.
    """
    m = matches(spark, d, "venue").where("day between '2023-01-01' and '2024-12-31' and matchDay in (1, 2, 3, 4, 5)").withColumn("venue", F.trim("venue"))
    m = m.join(_weather(spark, d), "id_match", "left").join(_grounds(spark, d), "venue", "left").withColumn("n", D.split_match_name(F.coalesce("name", "id_match")))
    order = Window.orderBy(F.when(F.col("matchDay") > 0, F.col("matchDay")).otherwise(999), F.when(F.col("day") != "", F.col("day")).asc_nulls_last(), "home_label", "id_match")
    shown = m.select("id_match", F.col("matchDay").alias("week"), "matchDay", "day", F.col("n.home").alias("home_label"), F.col("n.away").alias("away_label"), "homeScore", "awayScore", "city", "country", "temperature")
    return shown.withColumn("place", F.row_number().over(order)).drop("matchDay")


_EVENT = ["id_match", "id_team", "id_player", "related_player_id", "period", "type", "outcomeType", "isShot", "isGoal", "cardType", "minute", "second", "expandedMinute", "x", "y", "qualifiers"]
_EV = """, es AS (SELECT DISTINCT id_event, trim(id_match) AS id_match, id_team, trim(id_player) AS id_player, trim(related_player_id) AS related, period, type, isGoal, cardType, minute, second, expandedMinute, qualifiers FROM build_events),
known AS (SELECT id_player, min(coalesce(known_as, full_name)) AS label FROM player_identities WHERE id_player IS NOT NULL GROUP BY id_player),
side AS (SELECT id_match, team AS id_team, max(is_home::int) AS home FROM sides GROUP BY ALL)
"""
_MINUTE = """CASE WHEN lower(trim(type)) = 'start' AND lower(trim(period)) = 'firsthalf' AND coalesce(minute, 0) = 0 THEN '0''' WHEN coalesce(minute, 0) < 0 OR lower(trim(period)) IN ('prematch', 'postgame') THEN '-'
WHEN lower(trim(period)) = 'firsthalf' THEN CASE WHEN coalesce(minute, 0) < 45 THEN (coalesce(minute, 0) + 1)::varchar || '''' ELSE '45+' || (minute - 44)::varchar || '''' END
WHEN lower(trim(period)) = 'secondhalf' THEN CASE WHEN coalesce(minute, 0) < 90 THEN (coalesce(minute, 0) + 1)::varchar || '''' ELSE '90+' || (minute - 89)::varchar || '''' END
WHEN coalesce(minute, 0) <= 0 THEN '-' ELSE minute::varchar || '''' END"""


def _players(spark: SparkSession, d: str, key: str, label: str) -> DataFrame:
    p = table(spark, d, "player_identities").where("id_player is not null").groupBy("id_player").agg(F.min(F.coalesce("known_as", "full_name")).alias(label))
    return p.withColumnRenamed("id_player", key)


def _match_events(spark: SparkSession, d: str, where: str | None = None) -> DataFrame:
    """Events of active matches with the labels of both players and the side of the team."""
    e = events(spark, d, *_EVENT, where=where).withColumns({"id_match": F.trim("id_match"), "id_player": F.trim("id_player"), "related": F.trim("related_player_id")})
    side = sides(matches(spark, d)).groupBy("id_match", F.col("team").alias("id_team")).agg(F.max(F.col("is_home").cast("int")).alias("home"))
    active = matches(spark, d).select("id_match").distinct()
    return e.join(active, "id_match").join(side, ["id_match", "id_team"], "left").join(_players(spark, d, "id_player", "player"), "id_player", "left").join(_players(spark, d, "related", "assistant"), "related", "left")


@query(
    f"""SELECT id_match, id_event, es.id_team, k.label AS player, r.label AS assistant, type, {_MINUTE} AS minute_label, round(coalesce(expandedMinute, minute, 0) + coalesce(second, 0) / 60, 6) AS at,
row_number() OVER (PARTITION BY id_match ORDER BY coalesce(expandedMinute, minute, 0), coalesce(second, 0), id_event) AS place
FROM es JOIN (SELECT DISTINCT id_match FROM m) USING (id_match) LEFT JOIN known k ON k.id_player = es.id_player LEFT JOIN known r ON r.id_player = es.related""",
    _EV,
)
def match_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of every match with both players, in the match's order; a match's events are one sorted window."""
    at = F.coalesce("expandedMinute", "minute", F.lit(0))
    order = Window.partitionBy("id_match").orderBy(at, F.coalesce("second", F.lit(0.0)), "id_event")
    return _match_events(spark, d).select(
        "id_match", "id_event", "id_team", "player", "assistant", "type", E.minute_label(F.col("minute"), F.col("period"), F.col("type")).alias("minute_label"),
        F.round(at + F.coalesce("second", F.lit(0.0)) / 60, 6).alias("at"), F.row_number().over(order).alias("place"),
    )


#: What a timeline shows, in the order of precedence: a penalty before a goal before a card before a substitution.
_KIND = """CASE WHEN lower(trim(type)) IN ('goal', 'savedshot', 'missedshots', 'shotonpost') AND contains(lower(coalesce(qualifiers, '')), 'penalty') THEN CASE WHEN coalesce(isGoal, false) OR lower(trim(type)) = 'goal' THEN 'penalty-scored' WHEN lower(trim(type)) = 'savedshot' THEN 'penalty-saved' ELSE 'penalty-missed' END
WHEN coalesce(isGoal, false) THEN 'goal' WHEN coalesce(trim(cardType), '') <> '' OR contains(lower(type), 'card') THEN CASE WHEN regexp_matches(lower(coalesce(nullif(trim(cardType), ''), type)), 'second|segunda') THEN 'second-yellow-card' WHEN regexp_matches(lower(coalesce(nullif(trim(cardType), ''), type)), 'red|roja') THEN 'red-card' ELSE 'yellow-card' END
WHEN lower(trim(type)) = 'substitutionoff' THEN 'substitution' END"""
_ITEMS = f""", ends AS (SELECT id_match, greatest(45, max(minute) FILTER (lower(trim(period)) = 'firsthalf')) AS e1, greatest(90, max(minute) FILTER (lower(trim(period)) = 'secondhalf')) AS e2 FROM es GROUP BY id_match),
items AS (SELECT id_match, id_event, kind, side, "left", row_number() OVER (PARTITION BY id_match, side ORDER BY CASE per WHEN 'firsthalf' THEN 0 WHEN 'secondhalf' THEN 1 ELSE 2 END, mi, clock, kind, id_event) AS place FROM (
SELECT es.id_match, id_event, {_KIND} AS kind, CASE s.home WHEN 1 THEN 'home' WHEN 0 THEN 'away' ELSE 'neutral' END AS side, lower(trim(period)) AS per, coalesce(minute, 0) AS mi, coalesce(expandedMinute, minute, 0) + coalesce(second, 0) / 60 AS clock,
CASE WHEN lower(trim(period)) = 'firsthalf' THEN least(greatest(coalesce(minute, 0)::double / e1 * 50, 0), 49.5) WHEN lower(trim(period)) = 'secondhalf' THEN greatest(least(50 + greatest(coalesce(minute, 0)::double - 45, 0) / greatest(e2 - 45, 45) * 50, 100), 50.5) ELSE least(greatest(coalesce(minute, 0)::double / 90 * 100, 0), 100) END AS "left"
FROM es JOIN (SELECT DISTINCT id_match FROM m) USING (id_match) JOIN ends USING (id_match) LEFT JOIN side s ON s.id_match = es.id_match AND s.id_team = es.id_team) WHERE kind IS NOT NULL)
"""


def timeline_items(e: DataFrame, ends: DataFrame) -> DataFrame:
    """(id_match, id_event, kind, side, left, place) of the events that a timeline shows, numbered by side in its order."""
    card = F.coalesce(F.when(F.trim("cardType") != "", F.trim("cardType")), F.when(F.lower("type").contains("card"), F.col("type")))
    kind = F.coalesce(
        E.penalty_kind(F.col("type"), F.col("qualifiers"), F.col("isGoal")), F.when(F.coalesce("isGoal", F.lit(False)), "goal"), E.card_kind(card),
        F.when(F.lower(F.trim("type")) == "substitutionoff", "substitution"),
    )
    part = F.lower(F.trim("period"))
    shown = e.withColumn("kind", kind).where("kind is not null").join(ends, "id_match")
    side = F.when(F.col("home") == 1, "home").when(F.col("home") == 0, "away").otherwise("neutral")
    at = F.coalesce("expandedMinute", "minute", F.lit(0)) + F.coalesce("second", F.lit(0.0)) / 60
    order = Window.partitionBy("id_match", "side").orderBy(F.when(part == "firsthalf", 0).when(part == "secondhalf", 1).otherwise(2), F.coalesce("minute", F.lit(0)), at, "kind", "id_event")
    placed = shown.withColumns({"side": side, "left": E.timeline_left(F.col("minute"), F.col("period"), F.col("e1").cast("double"), F.col("e2").cast("double"))})
    return placed.withColumn("place", F.row_number().over(order)).select("id_match", "id_event", "kind", "side", "left", "place")


def _half_ends(spark: SparkSession, d: str) -> DataFrame:
    part = F.lower(F.trim("period"))
    rows = table(spark, d, "build_events").select(F.trim("id_match").alias("id_match"), part.alias("part"), "minute")
    end = lambda name, least: F.greatest(F.lit(least), F.max(F.when(F.col("part") == name, F.col("minute"))))
    return rows.groupBy("id_match").agg(end("firsthalf", 45).alias("e1"), end("secondhalf", 90).alias("e2"))


_LANES = """, lanes AS (SELECT id_match, id_event, kind, side, "left", place, 0 AS lane, ["left", -100.0, -100.0, -100.0, -100.0] AS last FROM items WHERE place = 1
UNION ALL SELECT id_match, id_event, kind, side, "left", place, lane, list_transform(last, lambda x, i: CASE WHEN i = lane + 1 THEN "left" ELSE x END) FROM (
SELECT i.*, l.last, coalesce(list_position(list_transform(l.last, lambda x: i."left" - x >= 6.0), true), list_position(l.last, list_min(l.last))) - 1 AS lane FROM lanes l JOIN items i ON i.id_match = l.id_match AND i.side = l.side AND i.place = l.place + 1))
"""


@query('SELECT id_match, id_event, kind, side, round("left", 6) AS "left", place, lane FROM lanes', _EV + _ITEMS + _LANES)
def match_timelines(spark: SparkSession, d: str) -> DataFrame:
    """Penalties, goals, cards and substitutions of every match on its timeline, side by side in five lanes."""
    e = _match_events(spark, d, where="isGoal or cardType is not null or lower(type) like '%card%' or lower(trim(type)) in ('goal', 'savedshot', 'missedshots', 'shotonpost', 'substitutionoff')")
    out = E.lanes(timeline_items(e, _half_ends(spark, d)), ["id_match", "side"], "left", ["place"])
    return out.withColumn("left", F.round("left", 6))


SQL["match_timelines"] = SQL["match_timelines"].replace("WITH m AS", "WITH RECURSIVE m AS", 1)

_LINE = ["participationStatus", "position", "isCaptain", "subIn", "appearances", "minutes", "totalGoals", "goalAssists", "totalShots", "shotsOnTarget", "offsides", "xg", "xa", "keyPasses", "foulsCommitted", "foulsSuffered", "yellowCards", "redCards", "saves"]
_METRICS = ["minutes", "totalGoals", "goalAssists", "totalShots", "shotsOnTarget", "xg", "xa", "keyPasses"]
_STATUS = "lower(trim(coalesce(participationStatus, '')))"
_PART = f"""({_STATUS} NOT IN ('no jugado', 'no_jugado', 'no disponible', 'no_disponible', 'no convocado', 'no_convocado') AND ({_STATUS} <> 'suplente' OR coalesce(minutes, 0) > 0 OR coalesce(appearances, 0) > 0 OR lower(trim(coalesce(subIn, ''))) NOT IN ('', 'start')))"""


@query(
    f"""SELECT id_match, p.id_team, id_player, CASE WHEN {_STATUS} = 'titular' THEN 'Titular' WHEN {_STATUS} = 'suplente' THEN 'Suplente' WHEN {_STATUS} IN ('no jugado', 'no_jugado') THEN 'No jugado' WHEN {_STATUS} IN ('no disponible', 'no_disponible', 'no convocado', 'no_convocado') THEN 'No disponible' ELSE coalesce(nullif(trim(participationStatus), ''), '-') END AS status,
coalesce(isCaptain, false) AS captain, {', '.join(f"CASE WHEN {_PART} THEN CASE WHEN NOT isnan({c}::double) THEN {c} END END AS {c}" for c in _METRICS)},
row_number() OVER (PARTITION BY id_match ORDER BY CASE s.home WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END, CASE WHEN {_STATUS} = 'titular' THEN 0 WHEN {_STATUS} = 'suplente' THEN 1 WHEN {_STATUS} IN ('no jugado', 'no_jugado') THEN 2 WHEN {_STATUS} IN ('no disponible', 'no_disponible', 'no convocado', 'no_convocado') THEN 3 ELSE 4 END, coalesce(minutes, 0) DESC, id_player, p.id_team, id_playerMatchParticipation) AS place
FROM p JOIN (SELECT DISTINCT id_match FROM m) USING (id_match) LEFT JOIN (SELECT id_match, team AS id_team, max(is_home::int) AS home FROM sides GROUP BY ALL) s USING (id_match, id_team) WHERE id_player <> ''"""
)
def match_player_lines(spark: SparkSession, d: str) -> DataFrame:
    """Player table of every match: home team first, then by status, minutes and player; no metrics for those who did not play."""
    p = table(spark, d, "player_match_participation").select("id_playerMatchParticipation", "id_match", "id_team", "id_player", *_LINE).distinct().withColumns({"id_match": F.trim("id_match"), "id_player": F.trim("id_player")}).where("id_player <> ''")
    m = matches(spark, d)
    side = sides(m).groupBy("id_match", F.col("team").alias("id_team")).agg(F.max(F.col("is_home").cast("int")).alias("home"))
    p = p.join(m.select("id_match").distinct(), "id_match").join(side, ["id_match", "id_team"], "left")
    low = F.lower(F.trim(F.coalesce("participationStatus", F.lit(""))))
    group = F.when(low == "titular", 0).when(low == "suplente", 1).when(low.isin(E.UNUSED), 2).when(low.isin(E.UNAVAILABLE), 3).otherwise(4)
    label = F.when(group == 0, "Titular").when(group == 1, "Suplente").when(group == 2, "No jugado").when(group == 3, "No disponible").otherwise(F.coalesce(F.when(F.trim("participationStatus") != "", F.trim("participationStatus")), F.lit("-")))
    played = E.took_part(F.col("participationStatus"), F.col("minutes"), F.col("appearances"), F.col("subIn"))
    order = Window.partitionBy("id_match").orderBy(F.when(F.col("home") == 1, 0).when(F.col("home") == 0, 1).otherwise(2), group, F.coalesce("minutes", F.lit(0)).desc(), "id_player", F.col("id_team").asc_nulls_last(), "id_playerMatchParticipation")
    return p.select(
        "id_match", "id_team", "id_player", label.alias("status"), F.coalesce("isCaptain", F.lit(False)).alias("captain"),
        *[F.when(played & ~F.isnan(F.col(c).cast("double")), F.col(c)).alias(c) for c in _METRICS], F.row_number().over(order).alias("place"),
    )


_SUMS = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in COUNTERS)
_TEAM = f""", ts AS (SELECT id_match, id_team, {_SUMS}, sum(xg) FILTER (NOT isnan(xg)) AS xg FROM p WHERE id_match <> '' AND id_team IS NOT NULL GROUP BY ALL)
"""
_SHARES = ["foulsCommitted", "yellowCards", "redCards", "offsides", "saves", "totalShots", "shotsOnTarget"]


@query(
    """SELECT id_match, metric, h AS home, a AS away, round(CASE WHEN abs(coalesce(h, 0)) + abs(coalesce(a, 0)) > 0 THEN 100.0::double * abs(coalesce(h, 0)) / (abs(coalesce(h, 0)) + abs(coalesce(a, 0))) ELSE 0 END, 6) AS home_pct, round(CASE WHEN abs(coalesce(h, 0)) + abs(coalesce(a, 0)) > 0 THEN 100.0::double * abs(coalesce(a, 0)) / (abs(coalesce(h, 0)) + abs(coalesce(a, 0))) ELSE 0 END, 6) AS away_pct FROM ("""
    + " UNION ALL ".join(f"SELECT m.id_match, '{c}' AS metric, x.{c} AS h, y.{c} AS a FROM m JOIN ts x ON x.id_match = m.id_match AND x.id_team = m.home JOIN ts y ON y.id_match = m.id_match AND y.id_team = m.away" for c in _SHARES)
    + ")",
    _TEAM,
)
def match_team_shares(spark: SparkSession, d: str) -> DataFrame:
    """Both teams' counters of every match side by side, with each side's share of the two."""
    stats = team_match_stats(participations(spark, d, "id_match", "id_team", *COUNTERS, "xg")).select("id_match", "id_team", *_SHARES)
    of = lambda team: stats.select("id_match", F.col("id_team").alias(team), F.struct(*_SHARES).alias(f"_{team}"))
    both = matches(spark, d).select("id_match", "home", "away").join(of("home"), ["id_match", "home"]).join(of("away"), ["id_match", "away"])
    lines = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"_home.{c}").alias("home"), F.col(f"_away.{c}").alias("away")) for c in _SHARES])
    out = both.select("id_match", F.inline(lines))
    return out.withColumns({"home_pct": F.round(D.share_of(F.col("home"), F.col("away")), 6), "away_pct": F.round(D.share_of(F.col("away"), F.col("home")), 6)})


#: Sums of a player's matches, by name: the column, and how a row counts (fixed values).
_COUNTS = ["appearances", "minutes", "totalGoals", "goalAssists", "totalShots", "shotsOnTarget", "keyPasses", "foulsCommitted", "foulsSuffered", "yellowCards", "redCards", "offsides", "saves", "goalsConceded"]
_DOUBLES = ["xg", "xg_chain", "xg_buildup", "xa"]
_FLAGS = {
    "starts": ("titular",), "substitute_appearances": ("suplente",), "unused_matches": ("no jugado", "no_jugado"), "unavailable_matches": ("no disponible", "no_disponible", "no convocado", "no_convocado"),
}
_SUMMARY_SQL = ", ".join(
    [f"coalesce(sum({c}), 0) AS {c}" for c in _COUNTS]
    + [f"round(coalesce(sum({c}) FILTER (NOT isnan({c})), 0), 4) AS {c}" for c in _DOUBLES]
    + [f"count(*) FILTER (lower(participationStatus) IN ({', '.join(repr(v) for v in values)})) AS {name}" for name, values in _FLAGS.items()]
    + ["count(*) FILTER (subOut IS NOT NULL) AS subbed_off", "count(*) FILTER (isCaptain) AS captain_matches"]
)


def player_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All sums of participations per key in one aggregate: matches, counters, expected values, statuses."""
    status = F.lower("participationStatus")
    return rows.groupBy(*keys).agg(
        F.countDistinct("id_match").alias("match_records"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS], *[F.round(F.coalesce(F.sum(F.when(~F.isnan(c), F.col(c))), F.lit(0.0)), 4).alias(c) for c in _DOUBLES],
        *[F.count(F.when(status.isin(*values), 1)).alias(name) for name, values in _FLAGS.items()], F.count("subOut").alias("subbed_off"), F.count(F.when(F.col("isCaptain"), 1)).alias("captain_matches"),
    )


_PMP = ["id_match", "id_team", "id_player", "participationStatus", "isCaptain", "subOut", *_COUNTS, *_DOUBLES]


def _played(spark: SparkSession, d: str) -> DataFrame:
    season = matches(spark, d).select("id_match", "id_competition", "id_season", "day")
    return participations(spark, d, *_PMP).where("id_player <> ''").join(season, "id_match")


@query(f"SELECT id_player, count(DISTINCT id_match) AS match_records, {_SUMMARY_SQL} FROM p JOIN m USING (id_match) WHERE id_player <> '' GROUP BY id_player")
def player_match_summary(spark: SparkSession, d: str) -> DataFrame:
    """Twenty-five sums over the matches of every player."""
    return player_sums(_played(spark, d), ["id_player"])


_GOALS = """, penalties AS (SELECT trim(id_match) AS id_match, trim(id_player) AS id_player, count(*) AS n FROM (SELECT DISTINCT id_event, id_match, id_player FROM build_events WHERE isGoal AND contains(lower(coalesce(qualifiers, '')), 'penalty')) GROUP BY ALL),
season AS (SELECT p.id_player, id_competition, id_season, p.id_team, count(DISTINCT p.id_match) AS matches, coalesce(sum(minutes), 0) AS minutes, coalesce(sum(totalGoals), 0) AS goals, coalesce(sum(totalGoals - coalesce(n, 0)), 0) AS non_penalty_goals, coalesce(sum(goalAssists), 0) AS assists, coalesce(sum(totalShots), 0) AS shots,
round(coalesce(sum(xg) FILTER (NOT isnan(xg)), 0), 4) AS xg, round(coalesce(sum(xa) FILTER (NOT isnan(xa)), 0), 4) AS xa, coalesce(sum(keyPasses), 0) AS key_passes, coalesce(sum(yellowCards), 0) AS yellow, coalesce(sum(redCards), 0) AS red
FROM p JOIN m ON m.id_match = p.id_match LEFT JOIN penalties z ON z.id_match = p.id_match AND z.id_player = p.id_player WHERE p.id_player <> '' GROUP BY ALL)
"""


def season_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sums per player, competition, season and team, with the goals that were no penalties."""
    shot = table(spark, d, "build_events").where("isGoal and contains(lower(coalesce(qualifiers, '')), 'penalty')").select("id_event", F.trim("id_match").alias("id_match"), F.trim("id_player").alias("id_player")).distinct()
    penalties = shot.groupBy("id_match", "id_player").agg(F.count("*").alias("n"))
    rows = _played(spark, d).join(penalties, ["id_match", "id_player"], "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    real = lambda c: F.round(F.coalesce(F.sum(F.when(~F.isnan(c), F.col(c))), F.lit(0.0)), 4).alias(c)
    return rows.groupBy("id_player", "id_competition", "id_season", "id_team").agg(
        F.countDistinct("id_match").alias("matches"), total("minutes").alias("minutes"), total("totalGoals").alias("goals"), total(F.col("totalGoals") - F.coalesce("n", F.lit(0))).alias("non_penalty_goals"), total("goalAssists").alias("assists"), total("totalShots").alias("shots"),
        real("xg"), real("xa"), total("keyPasses").alias("key_passes"), total("yellowCards").alias("yellow"), total("redCards").alias("red"),
    )


@query(
    """SELECT *, greatest(goals - non_penalty_goals, 0) AS penalty_goals, row_number() OVER (PARTITION BY id_player ORDER BY split_part(id_season, '-', 1)::int DESC, id_season DESC, id_competition, id_team) AS place FROM season""",
    _GOALS,
)
def player_season_rows(spark: SparkSession, d: str) -> DataFrame:
    """Season rows of every player, the latest season first."""
    order = Window.partitionBy("id_player").orderBy(D.season_order(F.col("id_season"))["start"].desc(), F.desc("id_season"), "id_competition", F.col("id_team").asc_nulls_last())
    return season_stats(spark, d).withColumns({"penalty_goals": D.penalty_goals(F.col("goals"), F.col("non_penalty_goals")), "place": F.row_number().over(order)})


@query(
    """SELECT * FROM (SELECT id_team, id_season, id_competition, id_player, matches, minutes, goals, greatest(goals - non_penalty_goals, 0) AS penalty_goals, assists, shots, row_number() OVER (PARTITION BY id_team ORDER BY id_season DESC, minutes DESC, id_player, id_competition) AS place FROM season WHERE id_team IS NOT NULL) WHERE place <= 500""",
    _GOALS,
)
def squad_stats(spark: SparkSession, d: str) -> DataFrame:
    """Squad of every team with its season stats: the page's first 500 rows, latest season and most minutes first."""
    order = Window.partitionBy("id_team").orderBy(F.desc("id_season"), F.desc("minutes"), "id_player", "id_competition")
    rows = season_stats(spark, d).where("id_team is not null").withColumns({"penalty_goals": D.penalty_goals(F.col("goals"), F.col("non_penalty_goals")), "place": F.row_number().over(order)})
    return rows.where("place <= 500").select("id_team", "id_season", "id_competition", "id_player", "matches", "minutes", "goals", "penalty_goals", "assists", "shots", "place")


_PER90 = {"goals": "goals", "non_penalty_goals": "non_penalty_goals", "assists": "assists", "goals_assists": "goals + assists", "xg": "xg", "xa": "xa", "xg_xa": "xg + xa", "shots": "shots", "shots_on_target": "shots_on_target", "key_passes": "key_passes", "xg_chain": "xg_chain", "xg_buildup": "xg_buildup", "fouls_committed": "fouls_committed", "fouls_suffered": "fouls_suffered", "offsides": "offsides", "yellow": "yellow", "red": "red", "saves": "saves", "goals_conceded": "goals_conceded", "cards": "yellow + red"}
_SHEET = """, ms AS (SELECT id_player, count(DISTINCT id_match) AS records, coalesce(sum(appearances), 0) AS appearances, coalesce(sum(minutes), 0) AS minutes, coalesce(sum(shotsOnTarget), 0) AS shots_on_target, round(coalesce(sum(xg_chain) FILTER (NOT isnan(xg_chain)), 0), 4) AS xg_chain, round(coalesce(sum(xg_buildup) FILTER (NOT isnan(xg_buildup)), 0), 4) AS xg_buildup,
coalesce(sum(foulsCommitted), 0) AS fouls_committed, coalesce(sum(foulsSuffered), 0) AS fouls_suffered, coalesce(sum(offsides), 0) AS offsides, coalesce(sum(saves), 0) AS saves, coalesce(sum(goalsConceded), 0) AS goals_conceded FROM p JOIN m USING (id_match) WHERE id_player <> '' GROUP BY id_player),
ss AS (SELECT id_player, sum(matches)::bigint AS matches, sum(minutes)::bigint AS minutes, sum(goals)::bigint AS goals, sum(non_penalty_goals)::bigint AS non_penalty_goals, sum(assists)::bigint AS assists, sum(shots)::bigint AS shots, round(sum(xg), 4) AS xg, round(sum(xa), 4) AS xa, sum(key_passes)::bigint AS key_passes, sum(yellow)::bigint AS yellow, sum(red)::bigint AS red FROM season GROUP BY id_player),
sheet AS (SELECT ss.* EXCLUDE (minutes, matches), coalesce(ss.matches, ms.appearances, ms.records) AS matches, coalesce(ss.minutes, ms.minutes) AS minutes, appearances, shots_on_target, xg_chain, xg_buildup, fouls_committed, fouls_suffered, offsides, saves, goals_conceded FROM ss JOIN ms USING (id_player))
"""
_ITEM = ", ".join(f"CASE WHEN minutes > 0 THEN round(90.0::double * ({v}) / minutes + 1e-9, 6) END AS {k}_per90" for k, v in _PER90.items())


def player_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Season values of every player, the match values where a season has none."""
    s = season_stats(spark, d).groupBy("id_player").agg(*[F.sum(c).alias(c) for c in ("matches", "minutes", "goals", "non_penalty_goals", "assists", "shots", "key_passes", "yellow", "red")], *[F.round(F.sum(c), 4).alias(c) for c in ("xg", "xa")])
    p = player_sums(_played(spark, d), ["id_player"])
    own = p.select("id_player", F.col("match_records").alias("_records"), "appearances", F.col("minutes").alias("_minutes"), F.col("shotsOnTarget").alias("shots_on_target"), "xg_chain", "xg_buildup", F.col("foulsCommitted").alias("fouls_committed"), F.col("foulsSuffered").alias("fouls_suffered"), "offsides", "saves", F.col("goalsConceded").alias("goals_conceded"))
    joined = s.join(own, "id_player")
    return joined.withColumns({"matches": first_present(F.col("matches"), F.col("appearances"), F.col("_records")), "minutes": first_present(F.col("minutes"), F.col("_minutes"))}).drop("_records", "_minutes")


def comparison_items(sheet: DataFrame) -> DataFrame:
    """What a comparison shows of every player: values per 90 minutes, accuracy, and goals and assists against the expected."""
    per = lambda n, by, times=1.0: F.round(ratio(n, by, times), 6)
    return sheet.select(
        "id_player", "matches", "minutes", per(F.col("minutes"), F.col("matches")).alias("minutes_per_match"), *[F.round(ratio(F.expr(v), F.col("minutes"), 90.0) + 1e-9, 6).alias(f"{k}_per90") for k, v in _PER90.items()],
        per(F.col("shots_on_target"), F.col("shots"), 100.0).alias("shot_accuracy"), per(F.col("xg"), F.col("shots")).alias("xg_per_shot"),
        F.round(F.expr("goals - xg"), 6).alias("goals_minus_xg"), F.round(F.expr("assists - xa"), 6).alias("assists_minus_xa"),
    )


@query(
    f"""SELECT id_player, matches, minutes, CASE WHEN matches > 0 THEN round(minutes::double / matches, 6) END AS minutes_per_match, {_ITEM}, CASE WHEN shots > 0 THEN round(100.0::double * shots_on_target / shots, 6) END AS shot_accuracy, CASE WHEN shots > 0 THEN round(xg / shots, 6) END AS xg_per_shot,
round(goals - xg, 6) AS goals_minus_xg, round(assists - xa, 6) AS assists_minus_xa FROM sheet""",
    _GOALS + _SHEET,
)
def player_comparison_items(spark: SparkSession, d: str) -> DataFrame:
    return comparison_items(player_sheet(spark, d))


_COMPARED = ["goals", "assists", "shots", "xg", "key_passes", "minutes", "yellow"]


def two_sided(a: DataFrame, b: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, a, b, winner, difference) of two single rows, each metric once, values apart by less than 1e-7 tied."""
    lines = lambda df, side: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(side)) for c in dict.fromkeys(metrics)])))
    both = lines(a, "a").join(lines(b, "b"), "metric")
    winner = D.tie_or_winner(F.col("a"), F.col("b"))
    return both.withColumns({"winner": winner, "difference": F.round(F.when(winner == "tie", 0.0).otherwise(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))), 6)})


@query(
    """, two AS (SELECT *, row_number() OVER (ORDER BY goals DESC, id_player) AS r FROM sheet QUALIFY r <= 2)
SELECT metric, max(v) FILTER (r = 1) AS a, max(v) FILTER (r = 2) AS b, CASE WHEN abs(max(v) FILTER (r = 1) - max(v) FILTER (r = 2)) < 1e-7 THEN 'tie' WHEN max(v) FILTER (r = 1) > max(v) FILTER (r = 2) THEN 'a' ELSE 'b' END AS winner, round(abs(max(v) FILTER (r = 1) - max(v) FILTER (r = 2)), 6) AS difference FROM ("""
    + " UNION ALL ".join(f"SELECT r, '{c}' AS metric, {c}::double AS v FROM two" for c in _COMPARED)
    + ") GROUP BY metric",
    _GOALS + _SHEET,
)
def compare_top_players(spark: SparkSession, d: str) -> DataFrame:
    """The two players of the most goals side by side, metric by metric."""
    top = player_sheet(spark, d).orderBy(F.desc("goals"), "id_player").limit(2).withColumn("r", F.row_number().over(Window.orderBy(F.desc("goals"), "id_player")))
    return two_sided(top.where("r = 1"), top.where("r = 2"), _COMPARED)


_TEAM_ITEM = """, st AS (SELECT team, count(*) AS matches, count(*) FILTER (gf > ga) AS wins, count(*) FILTER (gf = ga) AS draws, count(*) FILTER (gf < ga) AS losses, coalesce(sum(gf), 0) AS goals_for, coalesce(sum(ga), 0) AS goals_against FROM sides GROUP BY team),
tot AS (SELECT id_match, count(*) AS n, sum(totalShots) AS shots, sum(shotsOnTarget) AS on_target, sum(coalesce(xg, 0)) AS xg FROM ts GROUP BY id_match),
tm AS (SELECT id_team AS team, count(*) AS records, sum(ts.totalShots)::bigint AS shots, sum(ts.shotsOnTarget)::bigint AS on_target, round(sum(coalesce(ts.xg, 0)), 4) AS xg, sum(tot.shots - ts.totalShots)::bigint AS shots_conceded, round(sum(tot.xg - coalesce(ts.xg, 0)), 4) AS xg_against, sum(foulsCommitted)::bigint AS fouls, sum(yellowCards)::bigint AS yellow
FROM ts JOIN tot USING (id_match) JOIN (SELECT DISTINCT id_match FROM m) USING (id_match) WHERE n > 1 GROUP BY id_team)
"""


def _per_sql(n: str, by: str, name: str, times: str = "1.0") -> str:
    return f"CASE WHEN {by} > 0 THEN round({times}::double * ({n}) / ({by}), 6) END AS {name}"


_TEAM_RATIOS = [
    ("3 * wins + draws", "matches", "points_per_match", 1.0), ("3 * wins + draws", "matches * 3", "points_pct", 100.0), ("wins", "matches", "win_pct", 100.0), ("draws", "matches", "draw_pct", 100.0), ("losses", "matches", "loss_pct", 100.0),
    ("goals_for", "matches", "goals_per_match", 1.0), ("goals_for", "goals_against", "goal_ratio", 1.0), ("xg", "records", "xg_per_match", 1.0), ("shots", "records", "shots_per_match", 1.0), ("on_target", "shots", "shot_accuracy", 100.0),
    ("shots_conceded", "records", "shots_conceded_per_match", 1.0), ("xg_against", "records", "xg_against_per_match", 1.0), ("fouls", "records", "fouls_per_match", 1.0), ("yellow", "records", "yellow_per_match", 1.0),
]


@query(
    "SELECT st.*, " + ", ".join(_per_sql(n, by, name, str(times)) for n, by, name, times in _TEAM_RATIOS) + " FROM st LEFT JOIN tm USING (team)",
    _TEAM + _TEAM_ITEM,
)
def team_comparison_items(spark: SparkSession, d: str) -> DataFrame:
    """What a comparison shows of every team: results, goals, shots of both sides, all per match or as a share."""
    n = lambda c: F.count(F.when(c, 1))
    m = matches(spark, d)
    gf, ga = F.col("gf"), F.col("ga")
    results = sides(m).groupBy("team").agg(F.count("*").alias("matches"), n(gf > ga).alias("wins"), n(gf == ga).alias("draws"), n(gf < ga).alias("losses"), F.coalesce(F.sum(gf), F.lit(0)).alias("goals_for"), F.coalesce(F.sum(ga), F.lit(0)).alias("goals_against"))
    own = team_match_stats(participations(spark, d, "id_match", "id_team", *COUNTERS, "xg")).where("id_team is not null").withColumn("xg", F.coalesce("xg", F.lit(0.0)))
    total = own.groupBy("id_match").agg(F.count("*").alias("_n"), F.sum("totalShots").alias("_shots"), F.sum("xg").alias("_xg"))
    met = own.join(total, "id_match").where("_n > 1").join(m.select("id_match").distinct(), "id_match", "left_semi")
    stats = met.groupBy(F.col("id_team").alias("team")).agg(
        F.count("*").alias("records"), F.sum("totalShots").alias("shots"), F.sum("shotsOnTarget").alias("on_target"), F.round(F.sum("xg"), 4).alias("xg"), F.sum(F.col("_shots") - F.col("totalShots")).alias("shots_conceded"),
        F.round(F.sum(F.col("_xg") - F.col("xg")), 4).alias("xg_against"), F.sum("foulsCommitted").alias("fouls"), F.sum("yellowCards").alias("yellow"),
    )
    joined = results.join(stats, "team", "left")
    ratios = [F.when(F.expr(by) > 0, F.round(F.lit(times) * F.expr(num) / F.expr(f"({by})"), 6)).alias(name) for num, by, name, times in _TEAM_RATIOS]
    return joined.select(*results.columns, *ratios)


@query(
    """SELECT team, id_season, id_competition, place AS position, points, played, wins, draws, losses, goals_for, goals_against, goal_difference, row_number() OVER (PARTITION BY team ORDER BY id_season DESC, id_competition) AS line, first_value(place) OVER (PARTITION BY team ORDER BY id_season DESC, id_competition) AS current_position FROM ("""
    + _FOOTBALL_SQL["standings"].removeprefix(_CTE)
    + ")"
)
def classification_history(spark: SparkSession, d: str) -> DataFrame:
    """League positions of every team, the latest season first, with the current position beside each."""
    order = Window.partitionBy("team").orderBy(F.desc("id_season"), "id_competition")
    t = season_table(matches(spark, d)).withColumnRenamed("place", "position")
    return t.withColumns({"line": F.row_number().over(order), "current_position": F.first("position").over(order)}).select(
        "team", "id_season", "id_competition", "position", "points", "played", "wins", "draws", "losses", "goals_for", "goals_against", "goal_difference", "line", "current_position"
    )


@query("""SELECT team, opponent, id_match, day, is_home, gf, ga, CASE WHEN gf > ga THEN 'W' WHEN gf = ga THEN 'D' WHEN gf < ga THEN 'L' END AS result, row_number() OVER (PARTITION BY team ORDER BY nullif(day, '') DESC NULLS LAST, id_match) AS place FROM sides""")
def team_schedules(spark: SparkSession, d: str) -> DataFrame:
    """Matches of every team, the latest first; those without a day come last."""
    gf, ga = F.col("gf"), F.col("ga")
    order = Window.partitionBy("team").orderBy(F.when(F.col("day") != "", F.col("day")).desc_nulls_last(), "id_match")
    return sides(matches(spark, d)).select("team", "opponent", "id_match", "day", "is_home", "gf", "ga", F.when(gf > ga, "W").when(gf == ga, "D").when(gf < ga, "L").alias("result")).withColumn("place", F.row_number().over(order))


_CLASS = _FOOTBALL_SQL["participation_classes"].split(" AS minutes, ", 1)[1].rsplit(" AS class FROM (", 1)[0]


@query(
    f"""SELECT id_player, class, count(*) AS matches, string_agg(day || ' ' || coalesce(rival, '-'), ' | ' ORDER BY day DESC, id_match) AS played FROM (SELECT id_player, x.id_match, day, {_CLASS} AS class, CASE WHEN id_team = home THEN away WHEN id_team = away THEN home END AS rival,
row_number() OVER (PARTITION BY id_player ORDER BY day DESC, x.id_match, id_playerMatchParticipation) AS r FROM (SELECT *, lower(trim(coalesce(participationStatus, ''))) AS st, lower(trim(coalesce(subIn, ''))) AS si FROM p) x JOIN m USING (id_match) WHERE id_player <> '') WHERE r <= 800 GROUP BY id_player, class"""
)
def player_matches_by_status(spark: SparkSession, d: str) -> DataFrame:
    """Every player's latest 800 matches, as many as the page shows, grouped by how they took part."""
    cols = ["id_match", "id_team", "id_player", "participationStatus", "minutes", "appearances", "subIn"]
    p = table(spark, d, "player_match_participation").select("id_playerMatchParticipation", *cols).distinct().withColumns({"id_match": F.trim("id_match"), "id_player": F.trim("id_player")}).where("id_player <> ''")
    rows = p.join(matches(spark, d).select("id_match", "day", "home", "away"), "id_match")
    order = Window.partitionBy("id_player").orderBy(F.desc("day"), "id_match", "id_playerMatchParticipation")
    kind = E.participation_class(F.col("participationStatus"), F.col("minutes"), F.col("appearances"), F.col("subIn"))
    rival = F.when(F.col("id_team") == F.col("home"), F.col("away")).when(F.col("id_team") == F.col("away"), F.col("home"))
    rows = rows.withColumn("r", F.row_number().over(order)).where("r <= 800").select("id_player", kind.alias("class"), "r", F.concat("day", F.lit(" "), F.coalesce(rival, F.lit("-"))).alias("line"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"])
    return rows.groupBy("id_player", "class").agg(F.count("*").alias("matches"), F.array_join(listed, " | ").alias("played"))


@query("""SELECT label, id_player, known_as, full_name FROM (SELECT label, id_player, coalesce(nullif(known_as, ''), label) AS known_as, coalesce(nullif(full_name, ''), nullif(known_as, ''), label) AS full_name, row_number() OVER (PARTITION BY label ORDER BY lower(coalesce(known_as, full_name)), id_player) AS r
FROM (SELECT DISTINCT id_player, known_as, full_name, unnest([known_as, full_name]) AS label FROM player_identities) WHERE label <> '') WHERE r = 1""")
def player_identity_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For every name a page may ask for, short or full, the identity that answers to it first."""
    rows = table(spark, d, "player_identities").select("id_player", "known_as", "full_name").distinct().withColumn("label", F.explode(F.array_distinct(F.array("known_as", "full_name")))).where("label <> ''")
    order = Window.partitionBy("label").orderBy(F.lower(F.coalesce("known_as", "full_name")), "id_player")
    known = F.coalesce(F.when(F.col("known_as") != "", F.col("known_as")), F.col("label"))
    full = F.coalesce(F.when(F.col("full_name") != "", F.col("full_name")), known)
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").select("label", "id_player", known.alias("known_as"), full.alias("full_name"))


@query("""SELECT coalesce(known_as, full_name) AS label, count(DISTINCT p.id_player) AS players FROM p JOIN m USING (id_match) JOIN player_identities i ON i.id_player = p.id_player WHERE coalesce(known_as, full_name) IS NOT NULL GROUP BY 1""")
def player_list(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the players who have played, each once."""
    played = participations(spark, d, "id_match", "id_player").join(matches(spark, d).select("id_match"), "id_match", "left_semi").select("id_player").distinct()
    names = table(spark, d, "player_identities").select("id_player", F.coalesce("known_as", "full_name").alias("label")).where("label is not null")
    return played.join(names, "id_player").groupBy("label").agg(F.countDistinct("id_player").alias("players"))


@query("""SELECT label FROM (SELECT DISTINCT coalesce(known_as, full_name) AS label FROM p JOIN player_identities i ON i.id_player = p.id_player) WHERE label IS NOT NULL ORDER BY lower(label), label LIMIT 900""")
def player_options(spark: SparkSession, d: str) -> DataFrame:
    """The first 900 player labels, as many as the page offers."""
    names = table(spark, d, "player_identities").select("id_player", F.coalesce("known_as", "full_name").alias("label")).where("label is not null")
    return names.join(participations(spark, d, "id_player").select("id_player").distinct(), "id_player", "left_semi").select("label").distinct().orderBy(F.lower("label"), "label").limit(900)


@query("""SELECT 'competition' AS kind, id_competition AS id, array_to_string(list_reverse_sort(list(DISTINCT id_season)), ' | ') AS others FROM m GROUP BY id_competition UNION ALL SELECT 'season', id_season, array_to_string(list_sort(list(DISTINCT id_competition)), ' | ') FROM m GROUP BY id_season""")
def onboarding_options(spark: SparkSession, d: str) -> DataFrame:
    """Competitions with their seasons, the latest first, and seasons with their competitions by label."""
    pairs = matches(spark, d).select("id_competition", "id_season").distinct()
    latest = F.transform(F.reverse(F.array_sort(F.collect_set(D.season_order(F.col("id_season"))))), lambda s: s["label"])
    named = F.transform(F.array_sort(F.collect_set(F.struct(label_key(F.col("id_competition")).alias("k"), "id_competition"))), lambda s: s["id_competition"])
    by_competition = pairs.groupBy(F.col("id_competition").alias("id")).agg(F.array_join(latest, " | ").alias("others")).select(F.lit("competition").alias("kind"), "id", "others")
    return by_competition.unionByName(pairs.groupBy(F.col("id_season").alias("id")).agg(F.array_join(named, " | ").alias("others")).select(F.lit("season").alias("kind"), "id", "others"))


def selected_pairs(m: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Which of the literal pairs (competition, season) have matches, with their labels."""
    asked = m.sparkSession.createDataFrame(pairs, "id_competition string, id_season string")
    return m.select("id_competition", "id_season").join(F.broadcast(asked), ["id_competition", "id_season"], "left_semi").distinct().select("id_competition", "id_season", D.resource_label(F.col("id_competition")).alias("label"))


@query("""SELECT DISTINCT id_competition, id_season, trim(replace(regexp_replace(id_competition, '^[A-Za-z]{3}[-_]', ''), '_', ' ')) AS label FROM m WHERE (id_competition, id_season) IN (('SRB-Liga_Dauchau', '2024-2025'), ('SRB-Liga_Dauchau', '1900-1901'), ('XXX-None', '2024-2025'))""")
def selected_pair(spark: SparkSession, d: str) -> DataFrame:
    return selected_pairs(matches(spark, d), [("SRB-Liga_Dauchau", "2024-2025"), ("SRB-Liga_Dauchau", "1900-1901"), ("XXX-None", "2024-2025")])


def union_of(parts: list[DataFrame]) -> DataFrame:
    """All rows of frames with different columns; what a frame lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
