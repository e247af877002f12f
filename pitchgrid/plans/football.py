"""The query catalogue over the football tables: standings, scorers, summaries, comparisons, timelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchgrid.functions.events import body_part, card_kind, clock, has_qualifier, is_failed, participation_class, pitch_point, qualifiers
from pitchgrid.functions.text import label_key, ratio, role_set
from pitchgrid.operators.graph import merged, ntriples, triples
from pitchgrid.operators.orphans import bare
from pitchgrid.operators.quality import artifact, check, closed_reference, missing, not_in, outside
from pitchgrid.operators.spatial import near_groups
from pitchgrid.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Counters of a participation that summaries add up, and what they are called there (fixed values).
COUNTERS = ["totalGoals", "goalAssists", "totalShots", "shotsOnTarget", "foulsCommitted", "foulsSuffered", "yellowCards", "redCards", "offsides", "keyPasses", "saves", "ownGoals"]

#: The cleaned tables as SQL: exact copies once, references without white space, the day from the id.
_CTE = r"""WITH m AS (SELECT DISTINCT id_match, id_competition, id_season, id_home_team AS home, id_away_team AS away, name, matchDay, homeScore, awayScore, attendance, matchStatus,
  regexp_extract(id_match, '_(\d{4}-\d{2}-\d{2})_', 1) AS day FROM matches WHERE lower(trim(coalesce(matchStatus, ''))) <> 'abandoned'),
p AS (SELECT DISTINCT * REPLACE (trim(id_match) AS id_match, trim(id_player) AS id_player) FROM player_match_participation),
ev AS (SELECT DISTINCT * FROM build_events),
sides AS (SELECT id_match, id_competition, id_season, day, home AS team, away AS opponent, true AS is_home, homeScore AS gf, awayScore AS ga FROM m
  UNION ALL SELECT id_match, id_competition, id_season, day, away, home, false, awayScore, homeScore FROM m)
"""


def query(sql: str = ""):
    """Register a query under its name, with its SQL over the cleaned tables where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _CTE + sql
        return f

    return register


def matches(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Played matches, exact copies once; the day is the one in the id; ``more`` names further columns."""
    m = table(spark, d, "matches").where(F.lower(F.trim(F.coalesce("matchStatus", F.lit("")))) != "abandoned")
    return m.select(
        "id_match", "id_competition", "id_season", F.col("id_home_team").alias("home"), F.col("id_away_team").alias("away"), "name", "matchDay", "homeScore", "awayScore", "attendance", "matchStatus",
        F.regexp_extract("id_match", r"_(\d{4}-\d{2}-\d{2})_", 1).alias("day"), *more,
    ).distinct()


def participations(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The named columns of the participations, exact copies once, references without surrounding space.

    Only the row's own id and those columns are read and shuffled; a row's copies share all of them.
    """
    key = "id_playerMatchParticipation"
    rows = table(spark, d, "player_match_participation").select(*dict.fromkeys([key, *columns])).distinct()
    rows = rows.withColumns({c: F.trim(c) for c in ("id_match", "id_player") if c in columns})
    return rows if key in columns else rows.drop(key)


def events(spark: SparkSession, d: str, *columns: str, where: str | None = None) -> DataFrame:
    """The named columns of the events, exact copies once; ``where`` is applied before anything is shuffled."""
    rows = table(spark, d, "build_events")
    rows = rows.where(where) if where else rows
    return rows.select(*dict.fromkeys(["id_event", *columns])).distinct()


def sides(m: DataFrame) -> DataFrame:
    """Each match twice, from either team's side."""
    side = lambda team, other, home, gf, ga: F.struct(F.col(team).alias("team"), F.col(other).alias("opponent"), F.lit(home).alias("is_home"), F.col(gf).alias("gf"), F.col(ga).alias("ga"))
    both = F.array(side("home", "away", True, "homeScore", "awayScore"), side("away", "home", False, "awayScore", "homeScore"))
    return m.select("id_match", "id_competition", "id_season", "day", F.inline(both))


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


@query("""SELECT * FROM (SELECT count(*) AS matches, coalesce(sum(homeScore + awayScore), 0) AS goals, count(*) FILTER (homeScore > awayScore) AS home_wins, count(*) FILTER (homeScore = awayScore) AS draws, count(*) FILTER (homeScore < awayScore) AS away_wins FROM m),
(SELECT count(DISTINCT team) AS teams FROM sides), (SELECT count(DISTINCT id_player) FILTER (id_player <> '') AS players, coalesce(sum(yellowCards), 0) AS yellow, coalesce(sum(redCards), 0) AS red FROM p)""")
def home_kpis(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d)
    won = lambda c: F.count(F.when(c, 1))
    h, a = F.col("homeScore"), F.col("awayScore")
    one = m.agg(F.count("*").alias("matches"), F.coalesce(F.sum(h + a), F.lit(0)).alias("goals"), won(h > a).alias("home_wins"), won(h == a).alias("draws"), won(h < a).alias("away_wins"))
    teams = m.select(F.explode(F.array("home", "away")).alias("t")).agg(F.countDistinct("t").alias("teams"))
    players = participations(spark, d, "id_player", "yellowCards", "redCards").agg(F.countDistinct(F.when(F.col("id_player") != "", F.col("id_player"))).alias("players"), _total("yellowCards").alias("yellow"), _total("redCards").alias("red"))
    return one.join(F.broadcast(teams)).join(F.broadcast(players))  # three rows


@query("SELECT id_match, day, home, away, homeScore, awayScore FROM m ORDER BY day DESC, id_match LIMIT 8")
def recent_matches(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d).select("id_match", "day", "home", "away", "homeScore", "awayScore").orderBy(F.desc("day"), "id_match").limit(8)


_STANDINGS = """SELECT *, row_number() OVER (PARTITION BY id_competition, id_season ORDER BY points DESC, goal_difference DESC, goals_for DESC, team) AS place FROM (
SELECT id_competition, id_season, team, count(*) AS played, count(*) FILTER (gf > ga) AS wins, count(*) FILTER (gf = ga) AS draws, count(*) FILTER (gf < ga) AS losses, coalesce(sum(gf), 0) AS goals_for, coalesce(sum(ga), 0) AS goals_against,
coalesce(sum(gf - ga), 0) AS goal_difference, 3 * count(*) FILTER (gf > ga) + count(*) FILTER (gf = ga) AS points FROM sides GROUP BY id_competition, id_season, team)"""


def season_table(m: DataFrame) -> DataFrame:
    """Standings of every competition and season from the matches."""
    n = lambda c: F.count(F.when(c, 1))
    gf, ga = F.col("gf"), F.col("ga")
    per = sides(m).groupBy("id_competition", "id_season", "team").agg(
        F.count("*").alias("played"), n(gf > ga).alias("wins"), n(gf == ga).alias("draws"), n(gf < ga).alias("losses"), _total("gf").alias("goals_for"), _total("ga").alias("goals_against"),
        F.coalesce(F.sum(gf - ga), F.lit(0)).alias("goal_difference"), (3 * n(gf > ga) + n(gf == ga)).alias("points"),
    )
    order = Window.partitionBy("id_competition", "id_season").orderBy(F.desc("points"), F.desc("goal_difference"), F.desc("goals_for"), "team")
    return per.withColumn("place", F.row_number().over(order))


@query(_STANDINGS)
def standings(spark: SparkSession, d: str) -> DataFrame:
    return season_table(matches(spark, d))


def _leaders(spark: SparkSession, d: str, c: str) -> DataFrame:
    per = participations(spark, d, "id_player", "id_match", c).where("id_player <> ''").groupBy("id_player").agg(F.sum(c).alias("total"), F.countDistinct("id_match").alias("matches"))
    return per.where("total > 0").orderBy(F.desc("total"), "id_player").limit(20)


@query("SELECT id_player, sum(totalGoals) AS total, count(DISTINCT id_match) AS matches FROM p WHERE id_player <> '' GROUP BY id_player HAVING sum(totalGoals) > 0 ORDER BY total DESC, id_player LIMIT 20")
def scorers(spark: SparkSession, d: str) -> DataFrame:
    return _leaders(spark, d, "totalGoals")


@query("SELECT id_player, sum(goalAssists) AS total, count(DISTINCT id_match) AS matches FROM p WHERE id_player <> '' GROUP BY id_player HAVING sum(goalAssists) > 0 ORDER BY total DESC, id_player LIMIT 20")
def assists(spark: SparkSession, d: str) -> DataFrame:
    return _leaders(spark, d, "goalAssists")


@query("""SELECT kind, label, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind, lower(label) ORDER BY rank, label) AS r FROM (SELECT kind, label, CASE WHEN lower(label) = 'real' THEN 0 WHEN starts_with(lower(label), 'real') THEN 1 ELSE 2 END AS rank
FROM (SELECT DISTINCT 'team' AS kind, name AS label FROM teams UNION SELECT DISTINCT 'player', known_as FROM player_identities) WHERE contains(lower(label), 'real'))) WHERE r = 1 ORDER BY rank, lower(label), kind LIMIT 12""")
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    teams = table(spark, d, "teams").select(F.lit("team").alias("kind"), F.col("name").alias("label"))
    players = table(spark, d, "player_identities").select(F.lit("player").alias("kind"), F.col("known_as").alias("label"))
    low = F.lower("label")
    found = teams.unionByName(players).where(F.contains(low, F.lit("real"))).distinct()
    ranked = found.withColumn("rank", F.when(low == "real", 0).when(F.startswith(low, F.lit("real")), 1).otherwise(2))
    first = ranked.withColumn("r", F.row_number().over(Window.partitionBy("kind", F.lower("label")).orderBy("rank", "label"))).where("r = 1").drop("r")
    return first.orderBy("rank", F.lower("label"), "kind").limit(12)


@query("""SELECT m.id_match, day, home, away, temperature, humidity FROM m LEFT JOIN (SELECT trim(id_match, E' \\t\\n\\r') AS id_match, max(temperature) FILTER (NOT isnan(temperature)) AS temperature, max(humidity) FILTER (NOT isnan(humidity)) AS humidity FROM weather_observations WHERE trim(id_match, E' \\t\\n\\r') <> '' GROUP BY 1) w ON w.id_match = m.id_match
WHERE day BETWEEN '2023-01-01' AND '2024-12-31'""")
def matches_with_weather(spark: SparkSession, d: str) -> DataFrame:
    number = lambda c: F.max(F.when(~F.isnan(c), F.col(c))).alias(c)
    w = table(spark, d, "weather_observations").select(bare(F.col("id_match")).alias("id_match"), "temperature", "humidity").where("id_match is not null").groupBy("id_match").agg(number("temperature"), number("humidity"))
    return matches(spark, d).where("day between '2023-01-01' and '2024-12-31'").join(w, "id_match", "left").select("id_match", "day", "home", "away", "temperature", "humidity")


_SUMS = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in COUNTERS)


def team_match_stats(p: DataFrame) -> DataFrame:
    """Counters of a team in a match, from its players' participations."""
    return p.where("id_match <> ''").groupBy("id_match", "id_team").agg(*[_total(c).alias(c) for c in COUNTERS], F.round(F.sum(F.when(~F.isnan("xg"), F.col("xg"))), 4).alias("xg"))


@query(f"SELECT id_match, id_team, {_SUMS}, round(sum(xg) FILTER (NOT isnan(xg)), 4) AS xg FROM p WHERE id_match <> '' GROUP BY id_match, id_team")
def match_team_stats(spark: SparkSession, d: str) -> DataFrame:
    return team_match_stats(participations(spark, d, "id_match", "id_team", *COUNTERS, "xg"))


@query("""SELECT id_match, id_player, coalesce(minutes, 0) AS minutes, CASE WHEN st = 'titular' THEN 'starter' WHEN st IN ('no disponible', 'no_disponible', 'no convocado', 'no_convocado') THEN 'unavailable' WHEN st IN ('no jugado', 'no_jugado') THEN 'unused'
WHEN st = 'suplente' AND (coalesce(minutes, 0) > 0 OR coalesce(appearances, 0) > 0 OR (si <> '' AND si <> 'start')) THEN 'bench' WHEN st = 'suplente' THEN 'unused' ELSE 'all' END AS class FROM (SELECT *, lower(trim(coalesce(participationStatus, ''))) AS st, lower(trim(coalesce(subIn, ''))) AS si FROM p)""")
def participation_classes(spark: SparkSession, d: str) -> DataFrame:
    kind = participation_class(F.col("participationStatus"), F.col("minutes"), F.col("appearances"), F.col("subIn"))
    return participations(spark, d, "id_match", "id_player", "participationStatus", "minutes", "appearances", "subIn").select("id_match", "id_player", kind.alias("class"), F.coalesce("minutes", F.lit(0)).alias("minutes"))


_PER90 = ["totalGoals", "goalAssists", "totalShots", "keyPasses", "foulsCommitted"]


@query("SELECT id_player, coalesce(sum(minutes), 0) AS minutes, " + ", ".join(f"CASE WHEN sum(minutes) > 0 THEN round(90.0::double * coalesce(sum({c}), 0) / sum(minutes), 6) END AS {c}_per90" for c in _PER90) + ", CASE WHEN sum(totalShots) > 0 THEN round(100.0::double * coalesce(sum(shotsOnTarget), 0) / sum(totalShots), 6) END AS accuracy FROM p WHERE id_player <> '' GROUP BY id_player")
def player_per90(spark: SparkSession, d: str) -> DataFrame:
    per = participations(spark, d, "id_player", "minutes", *_PER90, "shotsOnTarget").where("id_player <> ''").groupBy("id_player").agg(F.sum("minutes").alias("m"), *[F.sum(c).alias(c) for c in [*_PER90, "shotsOnTarget"]])
    return per.select(
        "id_player", F.coalesce("m", F.lit(0)).alias("minutes"), *[F.round(ratio(F.col(c), F.col("m"), 90.0), 6).alias(f"{c}_per90") for c in _PER90],
        F.round(ratio(F.col("shotsOnTarget"), F.col("totalShots"), 100.0), 6).alias("accuracy"),
    )


@query("""SELECT id_player, id_competition, id_season, count(*) AS matches, coalesce(sum(minutes), 0) AS minutes, coalesce(sum(totalGoals), 0) AS goals, string_agg(DISTINCT id_team, ', ' ORDER BY id_team) AS teams
FROM p JOIN m USING (id_match) WHERE id_player <> '' GROUP BY id_player, id_competition, id_season""")
def player_seasons(spark: SparkSession, d: str) -> DataFrame:
    season = matches(spark, d).select("id_match", "id_competition", "id_season")
    joined = participations(spark, d, "id_match", "id_player", "id_team", "minutes", "totalGoals").where("id_player <> ''").join(season, "id_match")
    return joined.groupBy("id_player", "id_competition", "id_season").agg(F.count("*").alias("matches"), _total("minutes").alias("minutes"), _total("totalGoals").alias("goals"), F.array_join(F.sort_array(F.collect_set("id_team")), ", ").alias("teams"))


_OWN = ["totalShots", "foulsCommitted", "yellowCards"]


@query("""SELECT o.id_team, count(*) AS matches, """ + ", ".join(f"round(avg(o.{c}), 6) AS own_{c}, round(avg(x.{c}), 6) AS opponent_{c}" for c in _OWN) + f""" FROM (SELECT id_match, id_team, {_SUMS} FROM p WHERE id_match <> '' GROUP BY ALL) o
JOIN (SELECT id_match, id_team, {_SUMS} FROM p WHERE id_match <> '' GROUP BY ALL) x ON o.id_match = x.id_match AND o.id_team <> x.id_team GROUP BY o.id_team""")
def own_against_opponent(spark: SparkSession, d: str) -> DataFrame:
    own = team_match_stats(participations(spark, d, "id_match", "id_team", *COUNTERS, "xg")).select("id_match", "id_team", *_OWN).where("id_team is not null")
    # the opponents' sums of a match are its totals less the own part: one row per match joins, no pairs of teams
    both = own.groupBy("id_match").agg(F.count("*").alias("_teams"), *[F.sum(c).alias(f"_{c}") for c in _OWN])
    met = own.join(both, "id_match").where("_teams > 1")
    other, rivals = lambda c: F.sum(F.col(f"_{c}") - F.col(c)), F.sum(F.col("_teams") - 1)
    mine = lambda c: F.sum(F.col(c) * (F.col("_teams") - 1))
    return met.groupBy("id_team").agg(rivals.alias("matches"), *[x for c in _OWN for x in (F.round(mine(c) / rivals, 6).alias(f"own_{c}"), F.round(other(c) / rivals, 6).alias(f"opponent_{c}"))])


@query("""SELECT team, opponent, day, is_home, gf, ga, CASE WHEN gf > ga THEN 'W' WHEN gf = ga THEN 'D' WHEN gf < ga THEN 'L' END AS result FROM sides WHERE team = 'Real_Kelebion'""")
def team_matches(spark: SparkSession, d: str) -> DataFrame:
    gf, ga = F.col("gf"), F.col("ga")
    return sides(matches(spark, d)).where("team = 'Real_Kelebion'").select("team", "opponent", "day", "is_home", "gf", "ga", F.when(gf > ga, "W").when(gf == ga, "D").when(gf < ga, "L").alias("result"))


@query("SELECT id_team, count(DISTINCT id_player) AS players, coalesce(sum(totalGoals), 0) AS goals, round(avg(coalesce(minutes, 0)), 6) AS mean_minutes FROM p WHERE id_player <> '' GROUP BY id_team")
def squads(spark: SparkSession, d: str) -> DataFrame:
    return participations(spark, d, "id_player", "id_team", "totalGoals", "minutes").where("id_player <> ''").groupBy("id_team").agg(F.countDistinct("id_player").alias("players"), _total("totalGoals").alias("goals"), F.round(F.avg(F.coalesce("minutes", F.lit(0))), 6).alias("mean_minutes"))


@query("SELECT DISTINCT id_team, name, lower(strip_accents(name)) AS sort_key FROM teams")
def team_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "teams").select("id_team", "name", label_key(F.col("name")).alias("sort_key")).distinct()


@query("""SELECT id_competition, array_to_string(list_sort(list(DISTINCT id_season)), ', ') AS seasons FROM m GROUP BY id_competition""")
def available_pairs(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d).groupBy("id_competition").agg(F.array_join(F.sort_array(F.collect_set("id_season")), ", ").alias("seasons"))


@query("""SELECT id_match, id_team, count(*) AS shots, count(*) FILTER (isGoal) AS goals, count(*) FILTER (cardType IS NOT NULL) AS cards FROM ev WHERE isShot OR cardType IS NOT NULL GROUP BY id_match, id_team""")
def shot_summary(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "id_match", "id_team", "isGoal", "cardType", where="isShot or cardType is not null")
    return e.groupBy("id_match", "id_team").agg(F.count("*").alias("shots"), F.count(F.when(F.col("isGoal"), 1)).alias("goals"), F.count("cardType").alias("cards"))


@query("""SELECT id_team, count(*) AS passes, count(*) FILTER (regexp_matches(lower(outcomeType), 'unsuccess|fail|incomplete|inaccurate|error')) AS failed FROM ev WHERE lower(type) = 'pass' GROUP BY id_team""")
def pass_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "id_team", "outcomeType", where="lower(type) = 'pass'").groupBy("id_team").agg(F.count("*").alias("passes"), F.count(F.when(is_failed(F.col("outcomeType")), 1)).alias("failed"))


@query("""SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(qualifiers, '''displayName'': ''([^'']*)''', 1)) AS name FROM ev) GROUP BY name""")
def qualifier_counts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "qualifiers", where="qualifiers is not null").select(F.explode(qualifiers(F.col("qualifiers"))).alias("q")).groupBy(F.col("q.name").alias("name")).agg(F.count("*").alias("n"))


@query("""SELECT id_event, CASE WHEN contains(qualifiers, '''RightFoot''') AND NOT contains(split_part(qualifiers, '''RightFoot''', 1), '''LeftFoot''') AND NOT contains(split_part(qualifiers, '''RightFoot''', 1), '''Head''') THEN 'RightFoot'
WHEN contains(qualifiers, '''LeftFoot''') AND NOT contains(split_part(qualifiers, '''LeftFoot''', 1), '''Head''') THEN 'LeftFoot' WHEN contains(qualifiers, '''Head''') THEN 'Head' END AS part, coalesce(contains(qualifiers, '''displayName'': ''Cross'''), false) AS is_cross FROM ev WHERE lower(type) IN ('pass', 'goal', 'missedshots')""")
def event_features(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "qualifiers", where="lower(type) in ('pass', 'goal', 'missedshots')").withColumn("q", qualifiers(F.col("qualifiers")))
    return e.select("id_event", body_part(F.col("q")).alias("part"), has_qualifier(F.col("q"), "Cross").alias("is_cross"))


@query("""SELECT id_event, round(coalesce(expandedMinute, minute) + coalesce(second, 0) / 60, 6) AS at, CASE WHEN regexp_matches(lower(cardType), 'second|segunda') THEN 'second-yellow-card' WHEN regexp_matches(lower(cardType), 'red|roja') THEN 'red-card' WHEN cardType IS NOT NULL THEN 'yellow-card' END AS card,
least(greatest(CASE WHEN lower(period) = 'secondhalf' THEN 100 - x ELSE x END, 0), 100) AS px FROM ev WHERE isGoal OR cardType IS NOT NULL OR isShot""")
def pitch_events(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "minute", "expandedMinute", "second", "cardType", "x", "y", "period", where="isGoal or cardType is not null or isShot")
    return e.select("id_event", F.round(clock(F.col("minute"), F.col("expandedMinute"), F.col("second")), 6).alias("at"), card_kind(F.col("cardType")).alias("card"), pitch_point(F.col("x"), F.col("y"), F.lower("period") == "secondhalf")["x"].alias("px"))


def match_graph(spark: SparkSession, d: str) -> DataFrame:
    """Matches, teams and weather as one set of triples."""
    m = matches(spark, d)
    parts = [
        triples(m, "Match", "id_match", "name", ["day", "homeScore", "awayScore", "attendance", "matchStatus"], {"belongsToCompetition": ("Competition", "id_competition"), "belongsToSeason": ("Season", "id_season")}),
        triples(table(spark, d, "teams"), "Team", "id_team", "name", ["team_code", "country"]),
        triples(table(spark, d, "weather_observations").withColumn("id_match", bare(F.col("id_match"))), "WeatherObservation", "id_weatherObservation", None, ["temperature", "humidity"], {"ofMatch": ("Match", "id_match")}),
    ]
    return merged(parts)


@query("""SELECT regexp_replace(p, '^.*[/#]', '') AS p, count(*) AS n FROM (
SELECT DISTINCT id_match AS s, p, o FROM m, LATERAL (VALUES ('type', 'Match'), ('label', coalesce(name, id_match)), ('day', day), ('homeScore', homeScore::text), ('awayScore', awayScore::text), ('attendance', attendance::text), ('matchStatus', matchStatus), ('belongsToCompetition', id_competition), ('belongsToSeason', id_season)) v(p, o) WHERE trim(o) <> ''
UNION ALL SELECT DISTINCT id_team, p, o FROM teams, LATERAL (VALUES ('type', 'Team'), ('label', coalesce(name, id_team)), ('team_code', team_code), ('country', country)) v(p, o) WHERE trim(o) <> ''
UNION ALL SELECT DISTINCT id_weatherObservation, p, o FROM weather_observations, LATERAL (VALUES ('type', 'W'), ('label', id_weatherObservation), ('temperature', temperature::text), ('humidity', humidity::text), ('ofMatch', trim(id_match))) v(p, o) WHERE trim(o) <> '') GROUP BY 1""")
def graph_predicates(spark: SparkSession, d: str) -> DataFrame:
    return match_graph(spark, d).groupBy(F.regexp_replace("p", "^.*[/#]", "").alias("p")).agg(F.count("*").alias("n"))


@query(r"""SELECT '<http://example.org/pitchgrid/resource/' || k || '/' || s || '> <' || CASE p WHEN 'type' THEN 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' WHEN 'label' THEN 'http://www.w3.org/2000/01/rdf-schema#label' ELSE 'http://example.org/pitchgrid/ontology/' || p END || '> ' ||
CASE t WHEN 'class' THEN '<http://example.org/pitchgrid/ontology/' || o || '>' WHEN 'string' THEN '"' || replace(replace(o, '\', '\\'), '"', '\"') || '"^^<http://www.w3.org/2001/XMLSchema#string>' WHEN 'integer' THEN '"' || o || '"^^<http://www.w3.org/2001/XMLSchema#integer>' WHEN 'double' THEN '"' || o || '"^^<http://www.w3.org/2001/XMLSchema#double>' ELSE '<http://example.org/pitchgrid/resource/' || t || '/' || o || '>' END || ' .' AS value FROM (
SELECT DISTINCT 'Match' AS k, id_match AS s, p, o, t FROM m, LATERAL (VALUES ('type', 'Match', 'class'), ('label', coalesce(name, id_match), 'string'), ('day', day, 'string'), ('homeScore', homeScore::text, 'integer'), ('awayScore', awayScore::text, 'integer'), ('attendance', attendance::text, 'integer'), ('matchStatus', matchStatus, 'string'), ('belongsToCompetition', id_competition, 'Competition'), ('belongsToSeason', id_season, 'Season')) v(p, o, t) WHERE trim(o) <> ''
UNION ALL SELECT DISTINCT 'Team', id_team, p, o, t FROM teams, LATERAL (VALUES ('type', 'Team', 'class'), ('label', coalesce(name, id_team), 'string'), ('team_code', team_code, 'string'), ('country', country, 'string')) v(p, o, t) WHERE trim(o) <> ''
UNION ALL SELECT DISTINCT 'WeatherObservation', id_weatherObservation, p, o, t FROM weather_observations, LATERAL (VALUES ('type', 'WeatherObservation', 'class'), ('label', id_weatherObservation, 'string'), ('temperature', CASE WHEN isnan(temperature) THEN 'NaN' ELSE temperature::text END, 'double'), ('humidity', CASE WHEN isnan(humidity) THEN 'NaN' ELSE humidity::text END, 'double'), ('ofMatch', nullif(trim(id_match, E' \t\n\r'), ''), 'Match')) v(p, o, t) WHERE trim(o) <> '')""")
def graph_lines(spark: SparkSession, d: str) -> DataFrame:
    """The graph as N-Triples lines."""
    return ntriples(match_graph(spark, d))


@query(""", g AS (SELECT DISTINCT id_stadium AS k, radians(latitude) AS y, radians(longitude) AS x FROM stadiums WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)),
pairs AS (SELECT a.k AS a, b.k AS b FROM g a JOIN g b ON a.k <> b.k AND abs(a.y - b.y) < 0.0001 WHERE 2 * 6371000 * asin(sqrt(least(1, pow(sin((b.y - a.y) / 2), 2) + cos(a.y) * cos(b.y) * pow(sin((b.x - a.x) / 2), 2)))) <= 200),
reach AS (SELECT a AS vertex, a AS seen FROM pairs UNION SELECT vertex, b FROM reach JOIN pairs ON seen = a) SELECT vertex, min(seen) AS component FROM reach GROUP BY vertex""")
def stadium_groups(spark: SparkSession, d: str) -> DataFrame:
    """Grounds that lie within 200 m of each other, directly or through others."""
    return near_groups(table(spark, d, "stadiums"), "id_stadium", "latitude", "longitude")


@query("""SELECT 'matches' AS tab, 'not_empty' AS rule, 'error' AS severity, (count(*) = 0)::bigint AS failures FROM matches UNION ALL SELECT 'matches', 'missing:id_match', 'error', count(*) FROM matches WHERE coalesce(trim(id_match), '') = ''
UNION ALL SELECT 'matches', 'unique:id_match', 'error', count(*) FROM (SELECT 1 FROM matches GROUP BY id_match HAVING count(*) > 1)
UNION ALL SELECT 'weather_observations', 'range:temperature', 'error', count(*) FROM weather_observations WHERE temperature IS NOT NULL AND (isnan(temperature) OR temperature < -50 OR temperature > 60)
UNION ALL SELECT 'weather_observations', 'range:humidity', 'error', count(*) FROM weather_observations WHERE humidity IS NOT NULL AND (isnan(humidity) OR humidity < 0 OR humidity > 100)
UNION ALL SELECT 'player_match_participation', 'allowed:participationStatus', 'error', count(*) FROM player_match_participation WHERE trim(participationStatus) <> '' AND lower(trim(participationStatus)) NOT IN ('titular', 'suplente', 'no jugado', 'no disponible')
UNION ALL SELECT 'player_match_participation', 'missing:id_match', 'error', count(*) FROM player_match_participation WHERE coalesce(trim(id_match), '') = ''
UNION ALL SELECT 'player_match_participation', 'reference:id_match', 'error', count(*) FROM player_match_participation a WHERE trim(id_match) <> '' AND NOT EXISTS (SELECT 1 FROM matches b WHERE b.id_match = a.id_match)""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    m, p = table(spark, d, "matches"), table(spark, d, "player_match_participation")
    w = check(table(spark, d, "weather_observations"), "weather_observations", [outside("temperature", -50, 60), outside("humidity", 0, 100)])
    rules = check(p, "player_match_participation", [not_in("participationStatus", ["titular", "suplente", "no jugado", "no disponible"]), missing("id_match")])
    return artifact(m, "matches", ["id_match"], "id_match").unionByName(w).unionByName(rules).unionByName(closed_reference(p, "player_match_participation", "id_match", m, "id_match"))


@query("""SELECT id_player, array_to_string(list_sort(list(DISTINCT role)), ' | ') AS roles FROM (SELECT id_player, CASE WHEN position = 'GK' THEN 'goalkeeper' WHEN position IN ('DL', 'DC', 'DR', 'D') THEN 'defender' WHEN position LIKE 'FW%' THEN 'forward' WHEN position LIKE '%M%' THEN 'midfielder' END AS role FROM p WHERE id_player <> '' AND position IS NOT NULL) WHERE role IS NOT NULL GROUP BY id_player""")
def player_roles(spark: SparkSession, d: str) -> DataFrame:
    p = participations(spark, d, "id_player", "position").where("id_player <> '' and position is not null").select("id_player", F.explode(role_set(F.col("position"))).alias("role"))
    return p.groupBy("id_player").agg(F.array_join(F.sort_array(F.collect_set("role")), " | ").alias("roles"))


SQL["stadium_groups"] = SQL["stadium_groups"].replace("WITH m AS", "WITH RECURSIVE m AS", 1).replace("away, home, false, awayScore, homeScore FROM m)\n, g AS", "away, home, false, awayScore, homeScore FROM m), g AS")
