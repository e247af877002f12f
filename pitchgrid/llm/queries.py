"""Queries over the training-data problems, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.llm.aliases import alias_clusters, alias_pairs
from pitchgrid.llm.canonical import map_clubs, map_venues
from pitchgrid.llm.groups import identity_groups
from pitchgrid.llm.leakage import leaked_items
from pitchgrid.llm.matching import match_observations
from pitchgrid.llm.packing import packed_documents, packing_report
from pitchgrid.llm.truncation import truncation_shares, truncation_signals
from pitchgrid.runtime import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of player_identities that are linked, directly or not, under their group's number."""
    return identity_groups(table(spark, sf_dir, "player_identities"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncation_signals(table(spark, sf_dir, "documents")).where("truncated").select("doc_id").distinct()


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    return truncation_shares(truncation_signals(table(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat a passage of a test item, with the item."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of alias rows of one squad that mean the same player under different names."""
    return alias_pairs(alias_clusters(table(spark, sf_dir, "player_alias_map")))


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching observations of two sources with their confidence."""
    return match_observations(table(spark, sf_dir, "player_observations"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of observations of two sources that describe one player."""
    return p4_matches(spark, sf_dir).select("obs_id_a", "obs_id_b")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed grounds and home teams with their entry of the clean lists, or none."""
    venues = map_venues(table(spark, sf_dir, "stadiums"), table(spark, sf_dir, "venue_list"))
    clubs = table(spark, sf_dir, "teams")
    typed = table(spark, sf_dir, "matches").select(F.col("id_match").alias("row_id"), F.col("id_home_team").alias("value")).distinct()
    typed = typed.join(clubs.select(F.col("id_team").alias("value")), "value", "left_anti")
    mapped = typed.join(map_clubs(typed, clubs), "value", "left").select("row_id", F.coalesce("ref_id", F.lit("none")).alias("ref_id"))
    return (
        venues.select(F.lit("stadiums").alias("tab"), "row_id", F.lit("venue_name").alias("field"), "ref_id")
        .unionByName(mapped.select(F.lit("matches").alias("tab"), "row_id", F.lit("id_home_team").alias("field"), "ref_id"))
        .distinct()
    )


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their containers."""
    return packed_documents(table(spark, sf_dir, "documents"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing_report(packed_documents(table(spark, sf_dir, "documents")))


QUERIES = {
    "p1_found": p1_found,
    "p4_found": p4_found,
    "p4_matches": p4_matches,
    "p5_found": p5_found,
    "p7_found": p7_found,
    "p8_packed": p8_packed,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_shares": p10_shares,
}
#: The rules of the truncation operator: spikes of the length histograms, endings, shared last lines.
_CUTS = r"""WITH t AS (SELECT doc_id, coalesce(source, '') AS source, text, regexp_replace(text, '(?:[\s\p{Z}]+|</?[A-Za-z][^<>]*>|&[A-Za-z]{2,8};)+$', '') AS body FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, source, text, length(text) AS chars, strlen(rtrim(text, '�')) AS bytes, body = '' AS blank, regexp_matches(body, '[.!?…。！？]["''»”’)\]*_]*$') AS terminal, contains(body, chr(10)) AS lined, trim(split_part(body, chr(10), -1)) AS line FROM t),
h AS (SELECT source, measure, at_, count(*) AS texts, count(*) FILTER (NOT terminal) AS open_ FROM (SELECT source, terminal, 'chars' AS measure, chars AS at_ FROM s UNION ALL SELECT source, terminal, 'bytes', bytes FROM s) GROUP BY ALL),
spikes AS (SELECT source, measure, at_ FROM (SELECT *, (sum(texts) OVER (PARTITION BY source, measure ORDER BY at_ RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING) - texts) / 50.0 AS others FROM h) WHERE texts >= 5 AND texts >= 8.0 * greatest(others, 0.2) AND open_ >= 0.6 * texts),
shared AS (SELECT line FROM s WHERE lined AND NOT terminal GROUP BY line HAVING count(DISTINCT text) >= 2 AND count(DISTINCT text) >= 0.0005 * (SELECT count(*) FROM s)),
c AS (SELECT DISTINCT doc_id, source, at_limit, terminal, CASE WHEN terminal OR blank OR (lined AND sign_off) THEN NULL WHEN at_limit THEN 'limit' WHEN NOT ((lined AND note) OR ticker) THEN 'transfer' END AS cause FROM (
SELECT s.*, EXISTS (SELECT 1 FROM spikes p WHERE p.source = s.source AND (p.measure = 'chars' AND p.at_ = chars OR p.measure = 'bytes' AND bytes BETWEEN p.at_ - 3 AND p.at_)) AS at_limit, line IN (SELECT line FROM shared) AS sign_off,
regexp_matches(line, '^(?:\(.+\)|\[.+\])$') OR (regexp_matches(line, '^(?:(?:--|—|–)\s?|\p{Lu}[\p{L}-]+: )\S') AND NOT regexp_matches(regexp_replace(line, '^(?:(?:--|—|–)\s?|\p{Lu}[\p{L}-]+: )\S', ''), '[.!?…]\s')) AS note,
regexp_matches(line, '^\d{1,3}(?:\+\d{1,2})?[''’′]\s+\S+(?:\s+\S+){2,}$') AS ticker FROM s))
"""

#: Links as in the operator's docstring, then groups by recursion; aliases are cut at every sign that can divide them.
SQL: dict[str, str] = {
    "p10_found": _CUTS + "SELECT DISTINCT doc_id FROM c WHERE cause IS NOT NULL",
    "p10_shares": _CUTS + "SELECT source, count(*) AS documents, count(cause) AS truncated, count(*) FILTER (cause = 'limit') AS at_limit, count(*) FILTER (cause = 'transfer') AS in_transfer, round(count(cause) / count(*), 6) AS share FROM c GROUP BY source",
    "p7_found": r"""WITH RECURSIVE rows_ AS (SELECT DISTINCT identity_no AS n, id_player, aliases, source_player_keys FROM player_identities),
parts AS (SELECT n, list_transform(string_split(lower(k), ':'), lambda p: regexp_replace(p, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS p FROM (SELECT n, unnest(regexp_split_to_array(source_player_keys, '[|;,\r\n\t]+')) AS k FROM rows_)),
keys AS (SELECT DISTINCT n, CASE WHEN len(p) = 2 AND p[1] NOT IN ('', 'nan') AND regexp_full_match(p[2], '0*[1-9]\d*(\.0*)?') THEN p[1] || ':' || regexp_extract(p[2], '^0*([1-9]\d*)', 1) WHEN len(p) = 5 AND NOT list_has_any(p, ['', 'nan']) THEN array_to_string(p, ':') END AS key FROM parts),
held AS (SELECT DISTINCT n, lower(regexp_replace(v, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS v FROM (SELECT n, unnest(regexp_split_to_array(aliases, '[|;,/\r\n\t"''\[\]{}]+')) AS v FROM rows_)),
own AS (SELECT n, lower(trim(id_player)) AS v FROM rows_ WHERE trim(id_player) <> ''),
link AS (SELECT a.n AS a, b.n AS b FROM keys a JOIN keys b ON a.key = b.key AND a.n <> b.n UNION SELECT a.n, b.n FROM own a JOIN held b ON a.v = b.v AND a.n <> b.n UNION SELECT b.n, a.n FROM own a JOIN held b ON a.v = b.v AND a.n <> b.n),
reach AS (SELECT a AS identity_no, a AS seen FROM link UNION SELECT identity_no, b FROM reach JOIN link ON seen = a)
SELECT identity_no, min(seen) AS group_no FROM reach GROUP BY identity_no""",
}
