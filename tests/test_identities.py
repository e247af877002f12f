import pytest
from pyspark.sql import functions as F

from pitchgrid.functions.name_rules import differs_in_given_name, rules_of
from pitchgrid.operators.identities import (
    ambiguous_singles, candidate_keys, conflicting_keys, consolidated_aliases, context_overlaps, identities, identity_edges, observation_keys, open_reviews, position_evidence, second_merges, single_token_bridges, valid_id, with_ids,
)
from pitchgrid.plans import canonical as C

COLS = "source string, source_player_key string, source_player_id string, observed_name string, id_competition string, id_season string, id_team string, positions string"


def obs(spark, rows):
    return observation_keys(spark.createDataFrame([(s, k, i, n, "C", y, t, p) for s, k, i, n, y, t, p in rows], COLS))


def test_merges_and_guard(spark):
    keys = obs(spark, [
        ("understat", "understat:1", "1", "Piero Vasovic", "2023-2024", "A", "D"), ("whoscored", "whoscored:9", "9", "Piero Vasovic", "2023-2024", "A", "DC"), ("understat", "understat:2", "2", "Piero Vasovic", "2023-2024", "A", "F"),
        ("espn", "espn:C:2023-2024:L:tionaldo", None, "Tionaldo", "2023-2024", "L", None), ("espn", "espn:C:2024-2025:L:tionaldo", None, "Tionaldo", "2024-2025", "L", None),
        ("espn", "espn:x", None, "Juho Brexi", "2023-2024", "B", None), ("understat", "understat:5", "5", "Juho Brexi", "2024-2025", "Z", None), ("espn", "espn:y", None, "Jonathan Zanko", "2023-2024", "B", None), ("understat", "understat:6", "6", "Jonatan Zanko", "2023-2024", "B", None),
    ])
    out = {r.source_player_keys: r for r in identities(keys).collect()}
    assert "understat:5" in next(k for k in out if "espn:x" in k)
    assert next(r for k, r in out.items() if "tionaldo" in k).seasons == "2023-2024 | 2024-2025"
    assert not any("understat:1" in k and "understat:2" in k for k in out)
    assert any("espn:y" in k and "understat:6" in k for k in out)
    ids = [r.id_player for r in out.values()]
    assert {i for i in ids if ids.count(i) > 1} == {r.id_player for r in out.values() if r.id_method == "duplicate"} == {"Piero_Vasovic"}
    queue = spark.createDataFrame([("espn:x",), ("nobody",)], "source_player_key string")
    assert [r[0] for r in open_reviews(queue, identities(keys)).collect()] == ["nobody"]


def test_ambiguous_and_bridges(spark):
    keys = obs(spark, [("espn", "e1", None, "Alvaro", "S", "T", None), ("espn", "e2", None, "Alvaro Pelrano", "S", "T", None), ("espn", "e3", None, "Luis", "S", "T", None)])
    assert [r.alias for r in ambiguous_singles(keys).collect()] == ["alvaro"]
    rows = [("u1", "alvaro", "g1", True), ("u1", "alvaro", "g2", True), ("e1", "alvaro_pelrano", "g1", True), ("e1", "alvaro_pelrano", "g2", True), ("e2", "alvaro_gonzano", "g1", False), ("u2", "luis", "g1", True), ("e3", "luis_a", "g1", True), ("e4", "luis_b", "g1", True)]
    df = spark.createDataFrame([(k, a, "C", "S", "T", g, p) for k, a, g, p in rows], "source_player_key string, alias string, id_competition string, id_season string, id_team string, game string, played boolean")
    assert [(r.a, r.b, r.votes) for r in single_token_bridges(df).collect()] == [("u1", "e1", 2)]


def test_single_words_need_an_id_and_agreeing_lines(spark):
    """One word in one context joins only beside an id-backed key, with one context each and no contrary line of the team."""
    keys = obs(spark, [
        ("espn", "e1", None, "Tavo", "S", "A", "D"), ("understat", "u1", "1", "Tavo", "S", "A", "D | M"), ("espn", "e2", None, "Rulo", "S", "A", None), ("espn", "e3", None, "Rulo", "S", "A", None),
        ("espn", "e4", None, "Koko", "S", "A", "GK"), ("understat", "u4", "4", "Koko", "S", "A", "F"), ("espn", "e5", None, "Ana Zanko", "S", "A", "F"), ("whoscored", "w5", "5", "Ana Zanko", "T", "B", "FW"), ("whoscored", "w6", "6", "Ana Zanko", "T", "C", "FW"),
    ])
    edges = {(r.a, r.b): r.priority for r in identity_edges(keys).collect()}
    assert edges.get(("u1", "e1")) == 2 and not any({a, b} == {"u4", "e4"} for a, b in edges) and edges.get(("e3", "e2")) == 3
    assert not any(p == 4 for p in edges.values())


def test_bridges_are_edges(spark):
    keys = obs(spark, [("understat", "u1", "1", "Alvaro", "S", "T", None), ("espn", "e1", None, "Alvaro Pelrano", "S", "T", None)])
    lineups = spark.createDataFrame([("u1", "alvaro", "C", "S", "T", "g1", True), ("e1", "alvaro_pelrano", "C", "S", "T", "g1", True)], "source_player_key string, alias string, id_competition string, id_season string, id_team string, game string, played boolean")
    assert identities(keys).count() == 2
    assert identities(keys, identity_edges(keys, lineups=lineups)).count() == 1


def test_candidates(spark):
    keys = obs(spark, [("espn", f"e{i}", None, f"Ana{'bcdefgh'[i]} Zanko", "S", "A", None) for i in range(7)] + [("understat", "understat:1", "1", "Anab Zanko Ruz", "S", "A", None), ("understat", "understat:2", "2", "Anac Zanko Ruz", "S", "A", None), ("espn", "far", None, "Ana Zanko", "S", "B", None)])
    linked = spark.createDataFrame([], "vertex string, component string")
    got = {}
    for r in candidate_keys(keys, linked).orderBy("source_player_key", "place").collect():
        got.setdefault(r.source_player_key, []).append(r.candidate)
    assert len(got["e0"]) == 5 and got["e0"][0].startswith("understat:") and "far" not in got
    assert not any(c.startswith("understat:") for c in got["understat:1"])


ROWS = "component string, known_as string, full_name string, aliases string, source_player_keys string, id_understat string, id_whoscored string, competitions string, seasons string, teams string, observations long, resolution_method string"


def test_second_merges(spark):
    rows = [
        ("a", "Tavo", "Gustavo Zanko Ruz", "Tavo", "u:1", "1", None, "C", "S1", "A", 3, "rule_1"), ("b", "Gus", "Gustavo Zanko Ruz", "Gus", "w:2", None, "2", "D", "S1", "B", 2, "single"),
        ("c", "Ana Brex", "A. Brex", "Ana Brex", "u:3", "3", None, "C", "S1", "A", 5, "single"), ("d", "Ana Brex", None, "Ana Brex", "e:4", None, None, "C", "S2", "A", 1, "single"), ("e", "Ana Brex", None, "Ana Brex", "e:5", None, None, "C", "S2", "Z", 1, "single"),
        ("f", "Kim Vol", "Kim Vol Tan", "Kim", "u:6", "6", None, "C", "S1", "Q", 1, "single"), ("g", "Kim Vol", "Kim Vol Tan", "Kim", "u:7", "7", None, "C", "S1", "Q", 1, "single"),
    ]
    out = {frozenset(r.source_player_keys.split(" | ")): r for r in second_merges(spark.createDataFrame(rows, ROWS)).collect()}
    assert set(out) == {frozenset({"u:1", "w:2"}), frozenset({"u:3", "e:4"}), frozenset({"e:5"}), frozenset({"u:6"}), frozenset({"u:7"})}
    one = out[frozenset({"u:1", "w:2"})]
    assert (one.id_player, one.teams, one.observations, one.id_understat, one.id_whoscored, one.known_as) == ("Gustavo_Zanko_Ruz", "A | B", 5, "1", "2", "Tavo") and "merge_1" in one.resolution_method
    assert {r.id_player for r in out.values() if r.known_as == "Ana Brex"} == {"Ana_Brex_A", "Ana_Brex_Z"} and {r.id_method for r in out.values() if r.known_as == "Kim Vol"} == {"duplicate"}
    assert second_merges(spark.createDataFrame([], ROWS)).count() == 0


def test_ids_and_their_validity(spark):
    rows = [(f"k{i}", known, full, "", "", None, None, "C", "S", team, 1, "single") for i, (known, full, team) in enumerate([("Tavo", "Gus Zanko", "A"), ("Gus", "Gus Zanko", "B"), ("Lia", None, "A"), ("Lia", None, "B"), ("Gus", None, "D"), (None, None, "E")])]
    out = with_ids(spark.createDataFrame(rows, ROWS)).orderBy("component").collect()
    assert [r.id_player for r in out] == ["Tavo", "Gus_Zanko_B", "Lia_A", "Lia_B", "Gus_D", "unknown_player"]
    df = spark.createDataFrame(rows, ROWS)
    ids = with_ids(df)
    valid = ids.select("id_player", valid_id(F.col("id_player"), F.col("full_name"), F.col("known_as"), F.col("teams"), F.col("competitions"), F.col("id_method")).alias("v")).collect()
    assert all(r.v for r in valid)
    assert not ids.select(valid_id(F.lit("Other"), F.col("full_name"), F.col("known_as"), F.col("teams"), F.col("competitions"), F.col("id_method")).alias("v")).where("v").count()


def test_evidence_and_consolidation(spark):
    df = spark.createDataFrame([("k", 1, "DC | MC (3)"), ("k", 2, "dc | | MC"), ("k", 3, None), ("j", 4, " ")], "k string, at int, positions string")
    assert [tuple(r) for r in position_evidence(df, ["k"], "positions", "at").collect()] == [("k", "DC (2) | MC (4)")]
    again = spark.createDataFrame([("k", 1, "DC (2) | MC (4)"), ("k", 2, "DC")], "k string, at int, positions string")
    assert position_evidence(again, ["k"], "positions", "at").first().evidence == "DC (3) | MC (4)"
    cols = "alias_id long, source string, source_player_key string, source_player_id string, observed_name string, normalized_alias string, id_competition string, id_season string, id_team string, sample_game string, observations string, id_player string, known_as string, full_name string, method string, confidence string, needs_review string"
    rows = [(1, "espn", "e:1", None, "B Zan", "b_zan", "C", "S", "T", None, "2", None, None, "Bo Zan", "x", "0.9", "False"), (2, "espn", "e:1", "7", "A Zan", "a_zan", "C", "S", "U", "g", "3.0", "P", "Bo", None, "y", "bad", "TRUE"), (3, "espn", "e:2", None, "C", "c", "C", "S", "T", None, None, None, None, None, None, None, None)]
    got = {r.source_player_key: r for r in consolidated_aliases(spark.createDataFrame(rows, cols), "alias_id").collect()}
    r = got["e:1"]
    assert (r.source_player_id, r.observed_name, r.id_team, r.observations, r.id_player, r.full_name, r.method, r.confidence, r.needs_review) == ("7", "A Zan | B Zan", "T | U", 5, "P", "Bo Zan", "x | y", "0.900", "true")
    assert (got["e:2"].confidence, got["e:2"].observations, got["e:2"].needs_review) == ("", 0, "false")
    clash = spark.createDataFrame([*rows, (4, "espn", "e:1", None, "A", "a", "C", "S", "T", None, "1", "Q", None, None, None, None, None)], cols)
    with pytest.raises(ValueError):
        consolidated_aliases(clash, "alias_id")
    assert consolidated_aliases(clash, "alias_id", strict=False).count() == 2 and [r.players for r in conflicting_keys(clash).collect()] == [2]
    keys = spark.createDataFrame([("a", "C", "S", "T"), ("b", "C", "S", "T"), ("b", "C", "S", "U"), ("c", "C", "S", "U")], "source_player_key string, id_competition string, id_season string, id_team string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("a", "none")], "a string, b string")
    assert {(r.a, r.b): r.overlap for r in context_overlaps(keys, pairs).collect()} == {("a", "b"): True, ("a", "c"): False, ("b", "c"): True, ("a", "none"): False}


def test_name_rules():
    held = lambda a, b: {r for r, v in rules_of(a, b).items() if v}
    assert held("ana_zanko", "maria_ana_zanko") >= {"containment", "token_set"} and held("ana_maria_zanko", "ana_zanko") >= {"token_set"}
    assert held("anastas_zanko", "anast_zanko") >= {"prefix", "surname_variant"} and held("tavo", "tavo_zanko") == {"single_token", "single_variant"} and held("zanko", "tavo_zanko") == {"single_token"}
    assert held("konstandinov_ana", "konstantinov_ana") >= {"orthographic"} and held("ana_zanko", "tom_zanko") == set() and differs_in_given_name("ana_zanko", "tom_zanko")
    assert not differs_in_given_name("ana_zanko", "anna_zanko") and rules_of("tavo", "tavo_zanko", frozenset({"tavo"}))["single_token"] is False


def test_canonical_tables(spark):
    cols = "league string, season string, date string, home_team string, away_team string, home_goals int, away_goals int, _ord int"
    main = spark.createDataFrame([("ESP-La Liga", "2324", "2023-09-01T22:30:00Z", "Real A", "B", 1, 0, 1), ("ESP-La Liga", "2324", "2023-09-08T18:00:00Z", "B", "Real A", 2, 2, 2)], cols)
    extra = spark.createDataFrame([("ESP-La Liga", "2324", "2023-09-01", "Real A", "B", "H1", 1), ("ESP-La Liga", "2324", "2023-09-20", "B", "Real A", "D1", 2)], "league string, season string, date string, home_team string, away_team string, FTR string, _ord int")
    m = C.matches(main, extra, ["FTR"])
    got = {r.id_match: (r.date, r.FTR, r.found_by) for r in m.collect()}
    assert got == {"ESP-La_Liga_2023-2024_2023-09-02_Real_A_B": ("2023-09-02", "H1", "exact"), "ESP-La_Liga_2023-2024_2023-09-08_B_Real_A": ("2023-09-08", "D1", "fallback")}
    assert {(r.id_team, r.isHome, r.goals) for r in C.sides(m, ["goals"]).collect()} == {("Real_A", True, 1), ("B", False, 0), ("B", True, 2), ("Real_A", False, 2)}
    table = spark.createDataFrame([("ESP-La Liga", "2324", "B", 9, 1), ("ESP-La Liga", "2324", "Real A", 9, 2)], "league string, season string, team string, Pts int, _ord int")
    assert {(r.id_team, r.position) for r in C.league_positions(table).collect()} == {("B", 1), ("Real_A", 2)}
    elo = spark.createDataFrame([("A", "2024-01-01", "2024-02-01", "1", "1", "1500.5", 1), ("A", "2024-01-01", None, "2", "1", "1600", 2), ("A", "x", None, None, None, "nan", 3)], "team string, `from` string, `to` string, rank string, level string, elo string, _ord int")
    assert {(r.id_eloRecord, r.elo) for r in C.ratings(elo).collect()} == {("A_2024-01-01", 1600.0), ("A_unknown_date", None)}
    teams = C.catalogue([spark.createDataFrame([("a", None, "X")], "id string, name string, code string"), spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")], "id", ["name", "code"])
    assert {tuple(r) for r in teams.collect()} == {("a", "A", "X"), ("b", "B", None)}
    p = C.clear_unavailable(spark.createDataFrame([("no convocado", 3), ("titular", 4), (None, 5)], "participationStatus string, minutes int"), ["minutes"])
    assert {tuple(r) for r in p.collect()} == {("no disponible", None), ("titular", 4), (None, 5)}
    assert {r.name for r in C.seasons(spark.createDataFrame([("2324", "7")], "season string, season_id string")).collect()} == {"2023-2024"}
    assert C.competitions(spark.createDataFrame([("ESP-La Liga", "7.0")], "league string, league_id string")).first().idUnderstat == "7"
