import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchgrid.functions import display as D
from pitchgrid.functions import events as E
from pitchgrid.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


def test_text(spark):
    cases = [
        ("FC Vihawi-Sud", X.identifier, "FC_Vihawi_Sud"), ("SRB-Liga 1", X.competition_id, "SRB-Liga_1"), (" Ødemark  (C) ", X.identifier, "Odemark_C"), ("Zemö\u00adra|<x>=%", X.identifier, "Zemo\u00adrax%"), ("Ælva Œst", X.identifier, "Aelva_Oest"), ("Đuro", X.identifier, "Đuro"), ("A - B", X.identifier, "A_B"),
        ("SRB-Liga 1", X.competition_name, "Liga 1"), ("SRB-", X.competition_name, "SRB-"), ("2324", X.season_id, "2023-2024"), ("2024", X.season_id, "2020-2024"), ("2023/24", X.season_id, "2023-24"), ("2023_2024", X.season_id, "2023-2024"), ("2023-2024", X.season_label, "2023-2024"), ("2324", X.season_label, "2023-2024"),
        ("12.0", X.source_id, "12"), ("abc", X.source_id, "abc"), ("nan", X.source_id, None), ("0.0", X.strict_source_id, None), ("5521.0", X.strict_source_id, "5521"), ("Yes", X.boolean, True), ("no", X.boolean, False), ("si", X.boolean, None), ("1.0", X.boolean, None),
        ("x", X.boolean, None), ("nan", X.clean_text, ""), ("1e2", X.whole, 100), ("2024-02-03T10:00", X.date_part, "2024-02-03"), ("Real_Kelebion-Ñ", X.label_key, "real kelebion n"), ("Jean Luc", X.initials, "JL"),
        ("DC, FW", X.role_set, ["defender", "forward"]), ("E. Vihawi", X.is_abbreviated, True), ("Ana Vih.", X.is_abbreviated, True), ("Ana Vihawi", X.is_abbreviated, False), ("", X.is_abbreviated, True), ("Ana Vihawi", X.is_expanded, True), ("Vihawi", X.is_expanded, False), ("É. Vihawi", X.is_expanded, False),
    ]
    for value, f, want in cases:
        assert one(spark, value, f) == want, (value, want)


def test_game_and_keys(spark):
    assert tuple(one(spark, "2025-02-08 Zano SG - Brex", X.game_parts)) == ("2025-02-08", "Zano SG", "Brex")
    assert tuple(one(spark, "2025-02-08 Zano vs Brex v Kele", X.game_parts)) == ("2025-02-08", "Zano", "Brex v Kele")
    assert tuple(one(spark, "Zano - Brex", X.game_parts)) == (None, None, None) and tuple(one(spark, "2025-02-08 Zano", X.game_parts)) == ("2025-02-08", None, None)
    with_home = lambda game, home: tuple(one(spark, game, lambda c: X.game_parts_for(c, F.lit(home))))
    assert with_home("2025-02-08 Sankt-Zano-Brex", "Sankt-Zano") == ("2025-02-08", "Sankt-Zano", "Brex")
    assert with_home("2025-02-08 Sankt-Zano", "Sankt-Zano") == ("2025-02-08", "Sankt", "Zano") and with_home("Sankt-Zano-Brex", "Sankt-Zano") == (None, None, None)
    key = lambda i, n: spark.range(1).select(X.source_player_key(F.lit("whoscored"), F.lit(i), F.lit(n), F.lit("SRB-Liga 1"), F.lit("2526"), F.lit("FC Vihawi")).alias("k")).first().k
    assert key("0.0", "0.0") is None
    assert key("7711.0", "0.0") == "whoscored:7711"
    assert key(None, "Abel Tionozo") == "whoscored:SRB-Liga_1:2025-2026:FC_Vihawi:abel_tionozo"


def test_likeness_and_ratio(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "a")], "a string, b string")
    got = [r.r for r in df.select(X.likeness(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got[0] == 0.75 and (got[1] is None or pd.isna(got[1]))
    assert spark.range(1).select(X.ratio(F.lit(None), F.lit(2)).alias("a"), X.ratio(F.lit(1), F.lit(0)).alias("b")).first()[:] == (0.0, None)


def test_qualifiers(spark):
    text = "[{'type': {'displayName': 'CaptainPlayerId'}, 'value': '123'}, {'type': {'displayName': 'Head'}, 'value': None}]"
    for parse in (E.qualifiers, E.qualifiers_exact):
        assert [tuple(q) for q in one(spark, text, parse)] == [("CaptainPlayerId", "123"), ("Head", None)]
        assert one(spark, None, parse) is None
    assert one(spark, text, lambda c: E.qualifier_value(E.qualifiers(c), "captainplayerid")) == "123"
    assert one(spark, text, lambda c: E.body_part(E.qualifiers(c))) == "Head"


def test_broken_qualifiers_are_an_error(spark):
    good = spark.createDataFrame([("[{'type': {'displayName': 'Head'}}]",), (None,), ("",)], "q string")
    assert E.require_qualifiers(good, "q").count() == 3
    with pytest.raises(ValueError):
        E.require_qualifiers(good.unionByName(spark.createDataFrame([("[{'type': ",)], "q string")), "q")


def test_event_kinds(spark):
    row = lambda *c: spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(c)]).first()[:]
    assert [one(spark, v, E.card_kind) for v in ("SecondYellow", "Segunda amarilla", "Red", "Tarjeta roja", "Yellow", "?", None)] == ["second-yellow-card", "second-yellow-card", "red-card", "red-card", "yellow-card", "yellow-card", None]
    assert one(spark, "Unsuccessful", E.is_failed) is True
    label = lambda m, p, k=None: row(E.minute_label(F.lit(m).cast("long"), F.lit(p).cast("string"), F.lit(k).cast("string")))[0]
    assert [label(12, "FirstHalf"), label(46, "FirstHalf"), label(92, "SecondHalf"), label(0, "firsthalf", "Start"), label(0, "FirstHalf")] == ["13'", "45+2'", "90+3'", "0'", "1'"]
    assert [label(-1, "FirstHalf"), label(3, "PreMatch"), label(0, None), label(7, "Extra"), label(None, "SecondHalf")] == ["-", "-", "-", "7'", "1'"]
    penalty = lambda k, q, g: row(E.penalty_kind(F.lit(k), F.lit(q), F.lit(g)))[0]
    assert [penalty("Goal", "'Penalty'", None), penalty("SavedShot", "penalty", False), penalty("ShotOnPost", "penalty", False), penalty("Foul", "penalty", True), penalty("Goal", "Head", True)] == ["penalty-scored", "penalty-saved", "penalty-missed", None, None]
    result = lambda c: row(E.result_label(F.lit(c).cast("string"), F.lit("Zano"), F.lit("Brex")))[0]
    assert [result(c) for c in (" h", "Visitante", "EMPATE", "W.O.", "", None)] == ["Gana Zano", "Gana Brex", "Empate", "W.O.", "-", "-"]
    kind = lambda s, m=None, a=None, i=None: row(E.participation_class(*[F.lit(x).cast(t) for x, t in ((s, "string"), (m, "long"), (a, "long"), (i, "string"))]))[0]
    assert [kind("Titular"), kind("suplente", 3), kind("suplente", 0, 0, "start"), kind("suplente", 0, 0, "63"), kind("no_jugado"), kind("no convocado"), kind(None, 90), kind("x")] == ["starter", "bench", "unused", "bench", "unused", "unavailable", "all", "all"]
    left = lambda m, p, a=45.0, b=90.0: row(E.timeline_left(F.lit(m).cast("long"), F.lit(p), F.lit(a), F.lit(b)))[0]
    assert [left(9, "FirstHalf"), left(45, "FirstHalf"), left(48, "FirstHalf", 50.0), left(45, "SecondHalf"), left(90, "SecondHalf"), left(94, "SecondHalf", 45.0, 94.0), left(45, "x")] == [10.0, 49.5, 48.0, 50.5, 100.0, 100.0, 50.0]
    status = lambda i, a=None: row(E.lineup_status(F.lit(i).cast("string"), F.lit(a).cast("long")))[0]
    assert [status("Start"), status("63"), status(None, 1), status(None)] == ["titular", "suplente", "suplente", "no jugado"]
    stopped = lambda second: row(E.is_abandoned(F.lit("t"), F.lit("t"), F.lit(second).cast("string"), F.lit("ft"), F.lit("0"), F.lit(0), F.lit(0)))[0]
    assert stopped(None) is True and stopped("nan") is True and stopped("t") is False


def test_display(spark):
    row = lambda *c: spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(c)]).first()[:]
    text = lambda f, *values: [row(f(F.lit(v).cast("string")))[0] for v in values]
    assert text(D.format_number, "2.5", "3.5", "", None, "abc", "nan") == ["2", "4", "-", "-", "abc", "nan"] and text(lambda c: D.format_number(c, 2, "%"), "1.25", "7") == ["1.25%", "7.00%"]
    assert text(D.safe_int, "7.9", "x", None) == [7, 0, 0] and text(D.safe_bool, "Yes", "no", None) == [True, False, False]
    assert row(D.format_match_datetime(F.lit("2024-02-03T20:45:00+01:00"), F.lit(None).cast("string")), D.format_match_datetime(F.lit(""), F.lit("2024-02-03")), D.format_match_datetime(F.lit("soon"), F.lit(""))) == ("03/02/2024 20:45", "03/02/2024", "soon")
    assert tuple(row(D.split_match_name(F.lit("Zano vs Brex vs X")))[0]) == ("Zano", "Brex vs X") and tuple(row(D.split_match_name(F.lit("Zano")))[0]) == ("Zano", "-")
    iri = F.lit("http://x/resource/Competition/SRB-Liga_D%C3%A1n+a/")
    assert row(D.resource_id(iri), D.resource_label(iri), D.option_label(F.lit(""), iri), D.option_label(F.lit("srb liga dán+a"), iri), D.option_label(F.lit("Liga"), iri)) == ("SRB-Liga_Dán+a", "Liga Dán+a", "Liga Dán+a", "Liga Dán+a", "Liga")
    rain = lambda r, p: row(D.precipitation_text(F.lit(r).cast("double"), F.lit(p).cast("double")), D.weather_summary(F.lit(8.25), F.lit(r).cast("double"), F.lit(p).cast("double")))
    assert rain(0, 0) == ("Sin lluvia", "8.3 C | Sin lluvia") or rain(0, 0) == ("Sin lluvia", "8.2 C | Sin lluvia")
    assert rain(1.5, None)[0] == "Lluvia 1.5 mm" and rain(None, 2)[0] == "Precip. 2.0 mm" and rain(None, None)[0] == ""
    assert row(D.share_of(F.lit(3), F.lit(1)), D.share_of(F.lit(None), F.lit(0)), D.penalty_goals(F.lit(3), F.lit(5)), D.scaled(F.lit(5.0), F.lit(0.0), F.lit(10.0), 10, 100, True)) == (75.0, 0.0, 0, 60.0)
    assert tuple(row(D.padded_range(F.lit(1500.0), F.lit(1500.0)))[0]) == (1480.0, 1520.0) and tuple(row(D.padded_range(F.lit(1000.0), F.lit(2000.0)))[0]) == (920.0, 2080.0)
    assert tuple(row(D.season_order(F.lit("2023/2024")))[0])[:2] == (2023, 2024) and tuple(row(D.season_order(F.lit("x")))[0])[:2] == (0, 0)
    pick = lambda a, b, w: row(D.preferred(F.lit(a), F.lit(b), F.array(*[F.lit(x) for x in w]), F.array(F.lit("s1"), F.lit("s2"), F.lit("s3"))))[0]
    assert [pick("s3", "s2", ["s2"]), pick("x", "s2", ["s3"]), pick("", "all", ["y", "s3"]), pick("", "all", ["y"])] == ["s3", "s2", "s3", "s1"]
    assert row(D.tie_or_winner(F.lit(1.0), F.lit(1.00000001)), D.tie_or_winner(F.lit(2), F.lit(None)), D.tie_or_winner(F.lit(0.1), F.lit(0.2))) == ("tie", "a", "b")


def test_lanes(spark):
    df = spark.createDataFrame([("m", float(x)) for x in (1, 2, 3, 8, 20)], "g string, left double")
    assert [r.lane for r in E.lanes(df, ["g"], "left", ["left"]).orderBy("left").collect()] == [0, 1, 2, 0, 0]
