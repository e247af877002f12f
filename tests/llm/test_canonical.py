import random

from pitchgrid.llm.canonical import _key, map_clubs, map_venues, similarity_join


def test_join_against_brute_force(spark):
    rnd = random.Random(4)
    left = [(i, sorted(rnd.sample("abcdefghijkl", rnd.randrange(1, 8)))) for i in range(80)]
    right = [(i, sorted(rnd.sample("abcdefghijkl", rnd.randrange(1, 8)))) for i in range(60)] + [(99, [])]
    got = {(r.lid, r.rid): round(r.jaccard, 9) for r in similarity_join(spark.createDataFrame(left, "lid long, tokens array<string>"), spark.createDataFrame(right, "rid long, tokens array<string>"), 0.4).collect()}
    j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert got == {(i, k): round(j(a, b), 9) for i, a in left for k, b in right if j(a, b) >= 0.4}


def test_clubs(spark):
    clubs = spark.createDataFrame([(f"{k}_{n}", f"{k} {n}") for n in ("Kelebion", "Sajalix", "Costica", "Draujoquau") for k in ("Real",)] + [("Union_Sajalix", "Union Sajalix"), ("FC_Sapife", "FC Sapife"), ("FC_Vihawi", "FC Vihawi"), ("FC_Brevex", "FC Brevex"), ("Union_Wosuse", "Union Wosuse"), ("Union_Hagahom", "Union Hagahom")], "id_team string, name string")
    want = {"Kelebion": "Real_Kelebion", "REAL KELEBINO": "Real_Kelebion", "Voltera Real Kelebion": "Real_Kelebion", "Costica Real": "Real_Costica", "R. Costica": "Real_Costica", "union-sajalix": "Union_Sajalix", "Sajalix": "none", "Real Sajalix F.C.": "Real_Sajalix", "TBD": "none", "": "none", "Union Kelebion": "none", "FC Sapifee": "FC_Sapife"}
    df = spark.createDataFrame([(v,) for v in [*want, None, "TBD"]], "value string")
    assert {r.value: r.ref_id for r in map_clubs(df, clubs).collect()} == want


def test_venues(spark):
    venues = spark.createDataFrame([(i, n, c, l, q) for i, (n, c, l, q) in enumerate([("Stade Raudrostia", "Kebrecrar", "Croatia", "Q9100003"), ("Gamiox Road", "Beskabro", "Turkey", "Q9104951"), ("Stade Wavojem", "Rufleseind", "England", "Q9112373"), ("Campo Bitadrox", "Fodecri", "Czechia", "Q9176697")])], "venue_no long, venue_name string, city string, country string, id_wikidata string")
    rows = [("a", "Stade Raudrsotia", "Kebrekrar", None, None), ("b", None, None, None, "wd:Q 9104951"), ("c", "Wavojem Arena", "RUFLESEIND", "England", "Q91"), ("d", "Stade Pliquacio", None, "Turkey", "Q0"), ("e", "Bitdrox - Fodecri", None, None, ""), ("f", None, None, None, None), ("f", None, None, None, None)]
    df = spark.createDataFrame([(i, n, c, l, q, 1) for i, n, c, l, q in rows], "id_stadium string, venue_name string, city string, country string, idWikidata string, words int")
    assert {r.row_id: r.ref_id for r in map_venues(df, venues).collect()} == {"a": "Q9100003", "b": "Q9104951", "c": "Q9112373", "d": "none", "e": "Q9176697", "f": "none"}
    assert {r.ref_id for r in map_venues(df.where("id_stadium <> 'b'"), venues.limit(0)).collect()} == {"none"}
    assert map_venues(df.limit(0), venues).count() == 0


def test_a_null_is_not_its_neighbour(spark):
    """The same texts in other columns are other spellings, each with its own entry."""
    venues = spark.createDataFrame([(1, "Gamiox Road", "Beskabro", "Turkey", "Q1"), (2, "Campo Bitadrox", "Fodecri", "Czechia", "Q2"), (3, "Stade Wavojem", "Rufleseind", "England", "Q3")], "venue_no long, venue_name string, city string, country string, id_wikidata string")
    rows = [("a", "Gamiox", None, "Turkey", None), ("b", "Gamiox", "Turkey", None, None), ("c", None, "Gamiox", "Turkey", None)]
    df = spark.createDataFrame(rows, "id_stadium string, venue_name string, city string, country string, idWikidata string")
    keys = {r.row_id: r.k for r in df.select(df.id_stadium.alias("row_id"), _key("venue_name", "city", "country").alias("k")).collect()}
    assert len(set(keys.values())) == 3
    got = {r.row_id: r.ref_id for r in map_venues(df, venues).collect()}
    assert got["a"] == "Q1" and got["c"] == "none"
