from pitchgrid.operators.packed import Packed, infer_signs, long_fields, split_packed

P = [Packed("v", "id", "source")]


def values(spark, rows):
    df = spark.createDataFrame([(i, "s", v, "x") for i, v in enumerate(rows)], "id long, source string, v string, field string")
    out = split_packed(df, P).orderBy("row_id", "pos").collect()
    return [[r.value for r in out if r.row_id == i] for i in range(len(rows))]


def test_forms(spark):
    got = values(spark, [
        "A | B|C", '["D. del O\'Neil", \'X_1\', "Y"]', "['a', 'b']", "{a,b (3)}", '"Forward, Left (2)"', "Forward, Left (13) | Sub (2)", "DC,\"Sub\"",
        " ; a ;  ; nan ; b ; ", "a\r\nb", "a\tb", "MC; AMC | Sub", "O'Neil, Javier|O'Neil J.", '"a;b";"c"', None, "", "nan", "|",
    ])
    assert got == [
        ["A", "B", "C"], ["D. del O'Neil", "X_1", "Y"], ["a", "b"], ["a", "b (3)"], ["Forward, Left (2)"], ["Forward, Left (13)", "Sub (2)"], ["DC", "Sub"],
        ["a", "b"], ["a", "b"], ["a", "b"], ["MC", "AMC", "Sub"], ["O'Neil, Javier", "O'Neil J."], ["a;b", "c"], [], [], [], [],
    ]


def test_positions_count_real_values(spark):
    df = spark.createDataFrame([(7, "s", " ; a ; nan ; b"), (7, "s", " ; a ; nan ; b")], "id long, source string, v string")
    assert sorted(tuple(r) for r in split_packed(df, P).select("row_id", "pos", "value").collect()) == [(7, 1, "a"), (7, 2, "b")]


def test_long_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "s", "|".join(["word"] * 20000))], "id long, source string, v string")
    assert split_packed(df, P).count() == 20000
    assert split_packed(df.limit(0), P).count() == 0


def test_signs_per_source(spark):
    df = spark.createDataFrame([(i, "s", "a b|c d") for i in range(30)] + [(99, "s", "a b")], "id long, source string, v string")
    signs = {r.sign: r.accepted for r in infer_signs(long_fields(df, P)).collect()}
    assert signs == {"|": True}


def test_blanks_divide_codes_only(spark):
    """Codes that also stand alone are divided at blanks, words of a name or of a position are not."""
    codes = ["D", "M", "S", "D (22)", "M | S", "D", "M"] * 12 + ["D M S", "M  S", "D (2) M (11)", "M S"] * 6
    words = ["Center Back", "Left Back", "Left Midfielder", "Midfielder", "Marco Chaga", "Chaga", "Marco Duflo"] * 12
    rows = [(i, "u", v) for i, v in enumerate(codes)] + [(1000 + i, "e", v) for i, v in enumerate(words)]
    df = spark.createDataFrame(rows, "id long, source string, v string")
    got = {}
    for r in split_packed(df, P).orderBy("row_id", "pos").collect():
        got.setdefault(r.row_id, []).append((r.pos, r.value))
    assert [[v for _, v in got[84 + i]] for i in range(4)] == [["D", "M", "S"], ["M", "S"], ["D (2)", "M (11)"], ["M", "S"]]
    assert [p for p, _ in got[84]] == [1, 2, 3] and got[3] == [(1, "D (22)")]
    assert all(got[1000 + i] == [(1, v)] for i, v in enumerate(words))


def test_evidence_decides_about_a_sign(spark):
    """A source that writes the sign inside its values rejects it, another that divides with it accepts it."""
    rows = [(i, "paths", f"x{i}/{i}-7/..") for i in range(60)] + [(100 + i, "paths", "word") for i in range(20)]
    rows += [(200 + i, "lists", "word/other") for i in range(60)] + [(300 + i, "lists", "word") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, source string, v string")
    fields = long_fields(df, P)
    assert {r.source: r.accepted for r in infer_signs(fields).where("sign = '/'").collect()} == {"paths": False, "lists": True}
    got = {r.row_id: r.value for r in split_packed(df, P).where("pos = 1").collect()}
    assert got[5] == "x5/5-7/.." and got[205] == "word"


def test_uneven_counts_weigh_less(spark):
    even = [(i, "even", "a;b") for i in range(40)]
    uneven = [(100 + i, "uneven", ";".join("ab"[: 1 + i % 2] * (1 + 9 * (i % 4 == 0)))) for i in range(40)]
    df = spark.createDataFrame([*even, *uneven, (900, "even", "a"), (901, "uneven", "a")], "id long, source string, v string")
    share = {r.source: r.consistency for r in infer_signs(long_fields(df, P)).where("sign = ';'").collect()}
    assert share["even"] == 1.0 and share["uneven"] < 0.7
