"""The whole graph by class, integrity of the canonical tables, and the identity passes over the observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.operators import identities as I
from pitchgrid.operators.graph import RDF_TYPE, local_name, merged, triples
from pitchgrid.operators.orphans import bare
from pitchgrid.operators.quality import Rule, check, closed_reference, match_cardinality, one_id_per_source, outside, reconciled, unique_key, weather_iff_ground
from pitchgrid.functions.text import is_abbreviated
from pitchgrid.plans.football import _CTE, events, matches, participations, season_table, sides
from pitchgrid.plans.pages import _FULL, _WEATHER, _grounds, season_stats
from pitchgrid.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_TP, _TCS = "concat_ws('_', id_match, id_team)", "concat_ws('_', id_competition, id_season, id_team)"


def graph_parts(spark: SparkSession, d: str) -> list[DataFrame]:
    """Triples of the classes with a table: ratings have no table here, see :func:`pitchgrid.operators.graph.ratings_triples`."""
    m = matches(spark, d)
    teams = table(spark, d, "teams")
    p = participations(spark, d, "id_playerMatchParticipation", "id_match", "id_team", "id_player", "participationStatus", "position", "minutes", "totalGoals", "goalAssists", "xg", "xa").where("id_match <> '' and id_team is not null")
    p = p.withColumn("tp", F.expr(_TP))
    e = events(spark, d, "id_match", "id_team", "id_player", "period", "type", "minute", "second", "x", "y").withColumns({"id_match": F.trim("id_match"), "id_player": F.trim("id_player")}).withColumn("tp", F.when(F.col("id_team").isNotNull(), F.expr(_TP)))
    tcs = season_table(m).withColumnRenamed("team", "id_team").withColumn("tcs", F.expr(_TCS))
    stats = season_stats(spark, d).where("id_team is not null").withColumns({"tcs": F.expr(_TCS), "id_stats": F.concat_ws("_", "id_player", "id_competition", "id_season", "id_team")})
    weather = table(spark, d, "weather_observations").withColumn("id_match", bare(F.col("id_match")))
    side = sides(m).select("id_match", F.col("team").alias("id_team"), "is_home", "gf", "ga").withColumn("tp", F.expr(_TP))
    return [
        triples(m, "Match", "id_match", "name", ["day", "matchDay", "homeScore", "awayScore", "attendance", "matchStatus"], {"belongsToCompetition": ("Competition", "id_competition"), "belongsToSeason": ("Season", "id_season")}),
        triples(side, "TeamMatchParticipation", "tp", None, ["is_home", "gf", "ga"], {"ofMatch": ("Match", "id_match"), "correspondsToTeam": ("Team", "id_team")}),
        triples(teams, "Team", "id_team", "name", ["team_code", "country", "id_understat", "id_whoscored"]),
        triples(table(spark, d, "player_identities"), "Player", "id_player", "known_as", ["known_as", "full_name", "id_understat", "id_whoscored"]),
        triples(p, "PlayerMatchParticipation", "id_playerMatchParticipation", None, ["participationStatus", "position", "minutes", "totalGoals", "goalAssists", "xg", "xa"], {"belongsToTeamMatchParticipation": ("TeamMatchParticipation", "tp"), "correspondsToPlayer": ("Player", "id_player")}),
        triples(e, "Event", "id_event", None, ["period", "type", "minute", "second", "x", "y"], {"ofMatch": ("Match", "id_match"), "involvesTeamMatchParticipation": ("TeamMatchParticipation", "tp"), "involvesPlayer": ("Player", "id_player")}),
        triples(tcs, "TeamCompetitionSeason", "tcs", None, ["place", "points", "played", "wins", "draws", "losses", "goals_for", "goals_against"], {"correspondsToTeam": ("Team", "id_team"), "belongsToCompetition": ("Competition", "id_competition"), "belongsToSeason": ("Season", "id_season")}),
        triples(stats, "PlayerCompetitionSeasonStats", "id_stats", None, ["matches", "minutes", "goals", "non_penalty_goals", "assists", "shots", "xg", "xa", "key_passes", "yellow", "red"], {"correspondsToPlayer": ("Player", "id_player"), "belongsToTeamCompetitionSeason": ("TeamCompetitionSeason", "tcs")}),
        triples(table(spark, d, "stadiums"), "Stadium", "id_stadium", "venue_name", ["city", "country", "latitude", "longitude", "idWikidata", "idOsm"]),
        triples(weather, "WeatherObservation", "id_weatherObservation", None, ["temperature", "precipitation", "rain", "windSpeed", "humidity"], {"ofMatch": ("Match", "id_match")}),
        triples(m.select("id_competition").distinct(), "Competition", "id_competition"),
        triples(m.select("id_season").distinct(), "Season", "id_season"),
    ]


_CLASSES = {
    "Match": "SELECT id_match AS k FROM m", "TeamMatchParticipation": "SELECT id_match || '_' || team FROM sides WHERE team IS NOT NULL", "Team": "SELECT id_team FROM teams", "Player": "SELECT id_player FROM player_identities",
    "PlayerMatchParticipation": "SELECT id_playerMatchParticipation FROM p WHERE id_match <> '' AND id_team IS NOT NULL", "Event": "SELECT id_event FROM ev", "TeamCompetitionSeason": "SELECT id_competition || '_' || id_season || '_' || team FROM sides WHERE team IS NOT NULL",
    "PlayerCompetitionSeasonStats": "SELECT id_player || '_' || id_competition || '_' || id_season || '_' || id_team FROM p JOIN m USING (id_match) WHERE id_player <> '' AND id_team IS NOT NULL", "Stadium": "SELECT id_stadium FROM stadiums",
    "WeatherObservation": "SELECT id_weatherObservation FROM weather_observations", "Competition": "SELECT id_competition FROM m", "Season": "SELECT id_season FROM m",
}


@query(_CTE + " UNION ALL ".join(f"SELECT '{c}' AS class, count(DISTINCT k) AS subjects FROM (SELECT * FROM ({q}) t(k)) WHERE trim(k) <> ''" for c, q in _CLASSES.items()))
def graph_classes(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of every class of the whole graph."""
    typed = merged([g.where(F.col("p") == RDF_TYPE) for g in graph_parts(spark, d)], distinct=False)
    return typed.groupBy(local_name("o").alias("class")).agg(F.countDistinct("s").alias("subjects"))


@query(
    _CTE
    + _WEATHER
    + _FULL
    + r""", tp AS (SELECT p.id_match, p.id_team, p.id_player, p.id_team = m.home AS is_home FROM p JOIN m USING (id_match)),
per AS (SELECT m.id_match, count(DISTINCT nullif(trim(tp.id_team), '')) AS teams, count(DISTINCT CASE WHEN is_home THEN tp.id_team END) AS homes FROM (SELECT DISTINCT id_match FROM m) m LEFT JOIN tp USING (id_match) GROUP BY 1),
kn AS (SELECT ml.id_match, g.venue IS NOT NULL AS g, w.id_match IS NOT NULL AS w FROM (SELECT DISTINCT id_match, trim(venue) AS venue FROM ml) ml LEFT JOIN grounds g ON g.venue = ml.venue LEFT JOIN w ON w.id_match = ml.id_match),
pl AS (SELECT DISTINCT id_player, known_as, id_understat, id_whoscored FROM player_identities)
SELECT 'player_match_participation' AS tab, 'two_teams' AS rule, 'error' AS severity, count(*) AS failures FROM per WHERE teams <> 2 UNION ALL SELECT 'player_match_participation', 'one_home_team', 'error', count(*) FROM per WHERE homes <> 1
UNION ALL SELECT 'player_match_participation', 'one_team_per_player', 'error', count(*) FROM (SELECT 1 FROM tp WHERE trim(coalesce(id_player, '')) <> '' GROUP BY id_match, id_player HAVING count(DISTINCT id_team) > 1)
UNION ALL SELECT 'weather_observations', 'weather_at_known_ground', 'error', count(*) FROM kn WHERE g AND NOT w UNION ALL SELECT 'weather_observations', 'no_weather_without_ground', 'warning', count(*) FROM kn WHERE NOT g AND w
UNION ALL SELECT 'build_events', 'reconciled', 'error', abs((SELECT count(DISTINCT id_event) FROM build_events WHERE trim(id_match) IN (SELECT id_match FROM m)) - (SELECT count(*) FROM ev WHERE trim(id_match) IN (SELECT id_match FROM m)))
UNION ALL SELECT 'build_events', 'range:x', 'error', count(*) FROM build_events WHERE x IS NOT NULL AND (isnan(x) OR x < 0 OR x > 100) UNION ALL SELECT 'build_events', 'range:second', 'error', count(*) FROM build_events WHERE second IS NOT NULL AND (isnan(second) OR second < 0 OR second > 59)
UNION ALL SELECT 'build_events', 'range:minute', 'error', count(*) FROM build_events WHERE minute < 0 UNION ALL SELECT 'build_events', 'range:expandedMinute', 'warning', count(*) FROM build_events WHERE expandedMinute > 140
UNION ALL SELECT 'player_identities', 'unique:id_player', 'error', count(*) FROM (SELECT 1 FROM pl GROUP BY id_player HAVING count(*) > 1) UNION ALL SELECT 'player_match_participation', 'reference:id_player', 'error', count(*) FROM p WHERE trim(coalesce(id_player, '')) <> '' AND id_player NOT IN (SELECT id_player FROM pl WHERE id_player IS NOT NULL)
UNION ALL SELECT 'player_identities', 'poor_name', 'warning', count(*) FROM pl WHERE trim(coalesce(known_as, '')) = '' OR regexp_matches(trim(known_as), '(^|[^\p{L}\p{N}_])\p{Lu}\.\s+') OR regexp_matches(trim(known_as), '^\p{Lu}\.\s*\S+') OR regexp_matches(trim(known_as), '(^|[^\p{L}\p{N}_])[\p{L}\p{N}_]{1,3}\.\s*$')
UNION ALL SELECT 'player_identities', 'one_player:id_understat', 'error', count(*) FROM (SELECT 1 FROM pl WHERE trim(id_understat) <> '' GROUP BY id_understat HAVING count(DISTINCT id_player) > 1) UNION ALL SELECT 'player_identities', 'one_player:id_whoscored', 'error', count(*) FROM (SELECT 1 FROM pl WHERE trim(id_whoscored) <> '' GROUP BY id_whoscored HAVING count(DISTINCT id_player) > 1)"""
)
def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    """Cardinality of matches, weather against grounds, counts of events, domain bounds and the rules of players."""
    m = matches(spark, d, "venue").withColumn("venue", F.trim("venue"))
    p = participations(spark, d, "id_playerMatchParticipation", "id_match", "id_team", "id_player")
    sided = p.join(m.select("id_match", "home").distinct(), "id_match").withColumn("is_home", F.col("id_team") == F.col("home"))
    weather = table(spark, d, "weather_observations").select(bare(F.col("id_match")).alias("id_match")).where("id_match is not null")
    raw = table(spark, d, "build_events").select(F.trim("id_match").alias("id_match"), "id_event")
    own = events(spark, d, "id_match", "type", "minute", "second").withColumn("id_match", F.trim("id_match"))
    bounds = check(table(spark, d, "build_events"), "build_events", [outside("x", 0, 100), outside("second", 0, 59), outside("minute", 0), outside("expandedMinute", None, 140, severity="warning")])
    players = table(spark, d, "player_identities").select("id_player", "known_as", "id_understat", "id_whoscored").distinct()
    parts = [
        match_cardinality(sided, m, "player_match_participation"), weather_iff_ground(m.select("id_match", "venue").distinct(), weather, _grounds(spark, d)), reconciled(raw, own, "id_event", m, "id_match", "build_events"), bounds,
        unique_key(players, "player_identities", ["id_player"]), closed_reference(p, "player_match_participation", "id_player", players, "id_player"),
        check(players, "player_identities", [Rule("poor_name", is_abbreviated(F.col("known_as")), "warning")]), one_id_per_source(players, "player_identities", ["id_understat", "id_whoscored"]),
    ]
    return merged(parts, distinct=False)


@query(_CTE + """SELECT id_player, string_agg(position || ' (' || n || ')', ' | ' ORDER BY position) AS evidence FROM (SELECT id_player, position, count(*) AS n FROM p WHERE id_player <> '' AND trim(position) <> '' GROUP BY ALL) GROUP BY id_player""")
def player_position_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How often each player played each position."""
    rows = participations(spark, d, "id_playerMatchParticipation", "id_player", "position").where("id_player <> ''")
    return I.position_evidence(rows, ["id_player"], "position", "id_playerMatchParticipation")


_JOINED = "array_to_string(list_sort(list(DISTINCT {c}) FILTER (trim({c}) <> '')), ' | ')"


@query(
    "WITH a AS (SELECT DISTINCT * FROM player_alias_map) SELECT source_player_key, arg_min(source, alias_id) FILTER (trim(source) <> '') AS source, arg_min(source_player_id, alias_id) FILTER (trim(source_player_id) <> '') AS source_player_id, "
    + ", ".join(f"coalesce({_JOINED.format(c=c)}, '') AS {c}" for c in ("observed_name", "normalized_alias", "id_competition", "id_season", "id_team", "method"))
    + """, arg_min(sample_game, alias_id) FILTER (trim(sample_game) <> '') AS sample_game, coalesce(sum(observations), 0)::bigint AS observations, arg_min(id_player, alias_id) FILTER (trim(id_player) <> '') AS id_player, arg_min(known_as, alias_id) FILTER (trim(known_as) <> '') AS known_as, arg_min(full_name, alias_id) FILTER (trim(full_name) <> '') AS full_name,
coalesce(printf('%.3f', min(confidence)), '') AS confidence, coalesce(bool_or(needs_review), false)::varchar AS needs_review FROM a GROUP BY source_player_key"""
)
def alias_consolidation(spark: SparkSession, d: str) -> DataFrame:
    """One row per source key of the alias map."""
    return I.consolidated_aliases(table(spark, d, "player_alias_map").distinct(), "alias_id", strict=False)


@query(
    _CTE
    + _WEATHER
    + _FULL
    + """, places AS (SELECT trim(v) AS venue, min(struct_pack(i := id_stadium, la := latitude, lo := longitude)) AS at FROM (SELECT id_stadium, latitude, longitude, unnest(string_split(venue_name, '|')) AS v FROM stadiums WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)) WHERE trim(v) <> '' GROUP BY 1)
SELECT "at".la AS latitude, "at".lo AS longitude, id_season, min(day) AS first_day, max(day) AS last_day, count(*) AS matches FROM ml JOIN places ON places.venue = trim(ml.venue) WHERE day <> '' GROUP BY ALL"""
)
def weather_ranges(spark: SparkSession, d: str) -> DataFrame:
    """What a weather source is asked for: the days of a season between which each place has matches."""
    s = table(spark, d, "stadiums").where("latitude is not null and longitude is not null and not isnan(latitude) and not isnan(longitude)").select("id_stadium", "latitude", "longitude", F.explode(F.split("venue_name", r"\|")).alias("v"))
    places = s.select(F.trim("v").alias("venue"), F.struct("id_stadium", "latitude", "longitude").alias("s")).where("venue <> ''").groupBy("venue").agg(F.min("s").alias("s"))
    m = matches(spark, d, "venue").where("day <> ''").withColumn("venue", F.trim("venue"))
    return m.join(places, "venue").groupBy(F.col("s.latitude").alias("latitude"), F.col("s.longitude").alias("longitude"), "id_season").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("matches"))


@query()
def player_identities_built(spark: SparkSession, d: str) -> DataFrame:
    """Identities of the players that the observations speak of, after all passes; tested on fixtures."""
    obs = table(spark, d, "player_observations").where("id_competition is not null and id_season is not null and id_team is not null")
    return I.second_merges(I.identities(I.observation_keys(obs)))


@query()
def identity_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Keys that stayed apart with the five keys each that may mean the same player; tested on fixtures."""
    obs = table(spark, d, "player_observations").where("id_competition is not null and id_season is not null and id_team is not null")
    keys = I.observation_keys(obs)
    rows = I.identities(keys)
    linked = rows.select(F.col("component"), F.explode(F.split("source_player_keys", r" \| ")).alias("vertex")).select("vertex", "component")
    return I.candidate_keys(keys, linked)
