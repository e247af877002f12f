from pitchgrid.llm.matching import _assigned, club_similarity, match_observations, roles, same_key_pairs, season_start, sorted_neighbours

COLS = "obs_id long, source string, observed_name string, id_competition string, id_season string, id_team string, positions string, key string"


def test_fields():
    assert [season_start(x) for x in ("2023-2024", "2023/24", "2324", "2023 - 2024", "23-24", None, "")] == [2023, 2023, 2023, 2023, 2023, 0, 0]
    assert club_similarity("F.C. Faufliocia", "FC_Faufliocia") == 1 and club_similarity("Quofio", "AS_Quofio") == 1 and club_similarity("Sporting_A1kavax", "Sporting_Jajepirt") == 0 and club_similarity(None, "x") == 0.5
    assert roles('["D (28)", "M (15)"]') == {"d", "m"} and roles("AMC | FW") & roles("Striker; Substitute") and roles("S") == frozenset() and roles(None) == frozenset()


def test_sorted_window_meets_every_neighbour(spark):
    """Every pair nearer than the window in the whole order is compared, across blocks and partitions."""
    import pandas as pd

    df = spark.createDataFrame([(i, f"{(i * 37) % 101:03d}") for i in range(200)], "obs_id long, key string")

    def compare(frame, own):
        return pd.DataFrame([(a, b) for i, a in enumerate(frame.obs_id[:own]) for b in frame.obs_id[i + 1 : i + 4]], columns=["a", "b"])

    got = {tuple(r) for r in sorted_neighbours(df, "key", "obs_id", 4, 16, compare, "a long, b long").collect()}
    order = [i for _, i in sorted((f"{(i * 37) % 101:03d}", i) for i in range(200))]
    assert got == {(order[i], order[j]) for i in range(200) for j in range(i + 1, min(i + 4, 200))}


def test_matches(spark):
    rows = [
        (1, "espn", "Marco Chaga T.", "C", "2023-2024", "Ziaquuses_Rovers", "D", "k"), (2, "understat", "CHAGÁ MARCO", "C", "2324", "ziaquuses-rovers", "Defender", "k"), (3, "whoscored", "M. Chaga", "C", "2023/24", None, "DC", "k"),
        (4, "understat", "Rhys Mirtarro", "C", "2023-2024", "Ziaquuses_Rovers", None, "k"), (5, "espn", "Abdoulaye Mirtarro", "C", "2023-2024", "Ziaquuses_Rovers", None, "k"), (6, "espn", "Marco Chaga", "C", "2022-2023", "Ziaquuses_Rovers", None, "k"),
        (7, "espn", None, "C", "2023-2024", None, None, "k"), (8, None, "Marco Chaga", "C", "2023-2024", None, None, "k"), (1, "espn", "Marco Chaga T.", "C", "2023-2024", "Ziaquuses_Rovers", "D", "k"), (9, "espn", "", "C", "2023-2024", "Ziaquuses_Rovers", None, "k"),
    ]
    df = spark.createDataFrame(rows, COLS)
    got = {(r.obs_id_a, r.obs_id_b) for r in match_observations(df).collect()}
    assert (1, 2) in got and not any({4, 5} & set(p) or 6 in p or 9 in p for p in got)
    assert match_observations(df.limit(0)).count() == 0


def test_long_runs_against_brute_force(spark):
    """Every two records of a run beyond the window meet, each pair once; shorter runs and NULL keys are left out."""
    import pandas as pd

    rows = [(i, "hot") for i in range(60)] + [(100 + i, "warm") for i in range(13)] + [(200 + i, "cold") for i in range(12)] + [(300 + i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "obs_id long, key string")

    def compare(left, right):
        ids = list(left.obs_id)
        return pd.DataFrame([(a, b) for i, a in enumerate(ids) for b in (ids[i + 1 :] if right is None else right.obs_id)], columns=["a", "b"])

    got = sorted((min(r), max(r)) for r in same_key_pairs(df, "key", "obs_id", 12, 7, compare, "a long, b long").collect())
    assert got == sorted([(i, j) for i in range(60) for j in range(i + 1, 60)] + [(100 + i, 100 + j) for i in range(13) for j in range(i + 1, 13)])


def test_a_frequent_name_at_clubs_of_one_word(spark):
    """All five keys fall in runs far longer than the window, one source's records before the other's."""
    clubs = [f"Olympique_{a}{e}{b}" for a, e, b in zip("bcdfghjklmnprstvwxzbcdfghjklmn", "aeiouaeiouaeiouaeiouoiuaeoiuae", "zzxxwwvvttssrrppnnmmllkkjjhhgg")]
    rows = [(100 * k + i, source, "Marco Mirtarro", "C", "2023-2024", club, None, "k") for k, source in enumerate(("espn", "understat")) for i, club in enumerate(clubs)]
    got = {(r.obs_id_a, r.obs_id_b) for r in match_observations(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {(i, 100 + i) for i in range(len(clubs))}


def test_large_components_get_the_greatest_total():
    """A chain of 40 records a side in which the best single pairs are not the best whole."""
    pairs = [(i, 100 + i, 0.6) for i in range(40)] + [(i, 101 + i, 0.7) for i in range(0, 39, 2)]
    got = _assigned(pairs)
    assert len(got) == len({a for a, _, _ in got}) == len({b for _, b, _ in got}) == 40 and abs(sum(w for _, _, w in got) - 24.0) < 1e-9
