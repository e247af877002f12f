import pytest

from pyspark.sql import functions as F

from pitchgrid.operators import venues as V
from pitchgrid.plans import tasks as K


def test_venue_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(V.query_variants(F.lit("Sponsor Name Longarena"))) == [
        "Sponsor Name Longarena", "Name Longarena", "Longarena", "Estadio Sponsor Name Longarena", "Sponsor Name Longarena stadium", "Sponsor Name Longarena football stadium",
        "Estadio Name Longarena", "Name Longarena stadium", "Name Longarena football stadium", "Estadio Longarena", "Longarena stadium", "Longarena football stadium",
    ]
    assert one(V.query_variants(F.lit("Big Red Park"))) == ["Big Red Park", "Red Park", "Estadio Big Red Park", "Big Red Park stadium", "Big Red Park football stadium", "Estadio Red Park", "Red Park stadium", "Red Park football stadium"]
    assert one(V.query_variants(F.lit("Estadio Brexi"))) == ["Estadio Brexi"] and one(V.query_variants(F.lit(None).cast("string"))) == []
    pen = lambda *x: one(V.country_penalty(*[F.lit(v).cast("string") for v in x]))
    assert (pen("Türkiye", "tr", "Turkey", "TR"), pen("Türkiye", None, "Turkey", None), pen(None, None, "Turkey", None), pen("Turkey", "tr", "Turkey", "gr"), pen("Perú", "", "peru", ""), pen("X", "x", None, "tr")) == (0, 2, 1, 2, 0, 0)
    assert one(V.lookup_keys(F.lit("Estadio Brexi Stadium"))) == ["estadio_brexi_stadium", "brexi_stadium", "estadio_brexi"] and one(V.lookup_keys(F.lit(" "))) == []
    assert one(V.competition_country(F.lit("ENG-Premier_League"))) == "United Kingdom" and one(V.competition_country_code(F.lit("ITA-Serie_A"))) == "it" and one(V.competition_country(F.lit("ESP-Other"))) == ""
    uses = spark.createDataFrame([("v", "A"), ("v", "A"), ("v", "B")], "venue string, home_team string")
    assert V.home_of(uses).first().home_team == "A"


def test_choose_resolve_group(spark):
    cand = spark.createDataFrame([("Brexi Arena", "Palace", "Spain", "Spain", False, 1, 1), ("Brexi Arena", "Estadio Brexi", "Spain", "Spain", True, 2, 2), ("Lost", "Hotel", "Spain", "Spain", False, 1, 1)], "venue string, name string, country string, country_hint string, is_stadium boolean, candidate_rank int, search_rank int")
    assert [(r.venue, r.name) for r in V.choose(cand).collect()] == [("Brexi Arena", "Estadio Brexi")]
    schema = "venue string, step int, name string, city string, country string, latitude double, longitude double, idWikidata string"
    steps = spark.createDataFrame([("Tecnova Stadium", 1, "Wavojem Road", None, "X", 1.0, 1.0, "Q1"), ("Tecnova Stadium", 2, "Wavojem Road", "C", "X", 1.0, 1.0, "Q1"), ("Old Wavojem", 1, "Wavojem Road", "C", "X", 5.0, 5.0, "Q1"), ("Else", 1, "Else", " ", "X", 9.0, 9.0, None)], schema)
    got = V.resolve(steps)
    assert {r.venue: (r.step, r.status) for r in got.collect()} == {"Tecnova Stadium": (2, "resolved"), "Old Wavojem": (1, "resolved"), "Else": (1, "missing_required_fields:city")}
    uses = spark.createDataFrame([("Tecnova Stadium", "A")] * 3 + [("Old Wavojem", "A")], "venue string, home_team string")
    rows = V.grouped(got.where("status = 'resolved'"), uses).collect()
    assert [(r.name, r.venue_name) for r in rows] == [("Wavojem Road", "Tecnova Stadium | Old Wavojem")]


def test_tasks():
    ran = []
    ok = lambda *a: ran.append(a)
    fail = lambda *a: 1 / 0
    audit = K.run([K.Task("c", "graph", ok, ("b",)), K.Task("b", "transform", fail, ("a",)), K.Task("a", "extract", ok, per_scope=True), K.Task("d", "graph", ok, check=lambda: ["empty"])], [("L", "S1"), ("L", "S2")])
    assert ran == [("L", "S1"), ("L", "S2")] and audit.summary() == {"OK": 2, "ERROR": 1, "SKIPPED": 2} and audit.blocked
    with pytest.raises(ValueError):
        K.ordered([K.Task("a", "x", ok, ("b",)), K.Task("b", "x", ok, ("a",))])
    assert K.arguments(["--phases", "all", "--leagues", "L", "--seasons", "S"]).phases == ["all"]
    for bad in (["--phases", "all"], ["--phases", "graph", "--leagues", "L"]):
        with pytest.raises(SystemExit):
            K.arguments(bad)
