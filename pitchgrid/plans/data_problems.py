"""Queries p2, p3 and p6: packed values, mixed timestamps, references that lead nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.functions.instants import normalise_times
from pitchgrid.operators.orphans import Reference, Relation, orphan_references, orphan_report
from pitchgrid.operators.packed import Packed, infer_signs, long_fields, split_fields
from pitchgrid.runtime import table


def _packed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = long_fields(table(spark, sf_dir, "player_identities"), [Packed("aliases", "identity_no")])
    roles = [Packed("positions", "obs_id", "source"), Packed("position_roles", "obs_id", "source")]
    return aliases.unionByName(long_fields(table(spark, sf_dir, "player_observations"), roles))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of aliases, positions and position_roles with its place."""
    return split_fields(_packed_fields(spark, sf_dir))


def p2_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source divides its fields with, and how sure that is."""
    signs = infer_signs(_packed_fields(spark, sf_dir))
    return signs.select("field", "source", "sign", "rows", F.round("consistency", 6).alias("consistency"), F.round("regularity", 6).alias("regularity"), "accepted")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date text as a Madrid day, every dateTime text as a UTC instant."""
    madrid = "Europe/Madrid"
    matches = normalise_times(table(spark, sf_dir, "matches"), "matches", "id_match", {"date": ("day", madrid), "dateTime": ("instant", madrid)})
    weather = normalise_times(table(spark, sf_dir, "weather_observations"), "weather_observations", "id_weatherObservation", {"dateTime": ("instant", None)})
    return matches.unionByName(weather)


REFERENCES = [
    Reference("player_match_participation", "id_match", "matches", "id_match"),
    Reference("player_match_participation", "id_player", "player_identities", "id_player"),
    Reference("weather_observations", "id_match", "matches", "id_match"),
    Reference("build_events", "related_event_id", "build_events", "id_event"),
]


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = {
        "player_match_participation": Relation(table(spark, sf_dir, "player_match_participation"), "id_playerMatchParticipation", "loaded_at"),
        "weather_observations": Relation(table(spark, sf_dir, "weather_observations"), "id_weatherObservation", "loaded_at"),
        "build_events": Relation(table(spark, sf_dir, "build_events"), "id_event", "loaded_at"),
        "matches": Relation(table(spark, sf_dir, "matches"), "id_match", "loaded_at"),
        "player_identities": Relation(table(spark, sf_dir, "player_identities"), "id_player"),
    }
    return orphan_references(relations, REFERENCES)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose record is nowhere; the direct ones of the cascade."""
    return _orphans(spark, sf_dir).where("kind = 'direct'").select("tab", "field", "row_id", "ref", "period")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans per table, field and period."""
    return orphan_report(_orphans(spark, sf_dir))


_P6_ONE = """SELECT DISTINCT '{tab}' AS tab, '{field}' AS field, {row_id} AS row_id, trim({field}, E' \\t\\n\\r') AS ref, strftime(loaded_at, '%Y-%m') AS period
FROM {tab} t WHERE trim({field}, E' \\t\\n\\r') <> '' AND NOT EXISTS (SELECT 1 FROM {target} k WHERE k.{key} = trim(t.{field}, E' \\t\\n\\r'))"""

_P6_IDS = {"player_match_participation": "id_playerMatchParticipation", "weather_observations": "id_weatherObservation", "build_events": "id_event"}

P6_FOUND_SQL = "\nUNION ALL\n".join(_P6_ONE.format(tab=r.table, field=r.field, row_id=_P6_IDS[r.table], target=r.target, key=r.target_key) for r in REFERENCES)

P6_REPORT_SQL = f"""WITH RECURSIVE direct AS ({P6_FOUND_SQL}),
chain AS (
  SELECT DISTINCT row_id FROM direct WHERE tab = 'build_events'
  UNION
  SELECT e.id_event FROM build_events e JOIN chain c ON trim(e.related_event_id, E' \\t\\n\\r') = c.row_id
),
inherited AS (
  SELECT DISTINCT 'build_events' AS tab, 'related_event_id' AS field, e.id_event AS row_id, trim(e.related_event_id, E' \\t\\n\\r') AS ref, strftime(e.loaded_at, '%Y-%m') AS period
  FROM build_events e JOIN chain c ON trim(e.related_event_id, E' \\t\\n\\r') = c.row_id
  WHERE e.id_event NOT IN (SELECT row_id FROM direct WHERE tab = 'build_events')
)
SELECT tab, field, period, kind, count(*) AS orphans, count(DISTINCT ref) AS missing_refs
FROM (SELECT *, 'direct' AS kind FROM direct UNION ALL SELECT *, 'inherited' AS kind FROM inherited) GROUP BY ALL"""

QUERIES = {"p2_found": p2_found, "p2_signs": p2_signs, "p3_found": p3_found, "p6_found": p6_found, "p6_report": p6_report}
SQL = {"p6_found": P6_FOUND_SQL, "p6_report": P6_REPORT_SQL}
