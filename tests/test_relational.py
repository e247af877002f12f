import random

import pytest
from pyspark.sql import functions as F

from pitchgrid.operators.components import components, guarded_components
from pitchgrid.operators.dedup import duplicated, first_non_empty, keep_first, keep_last, keep_unique, mode_of, number_suffixes, single_valued
from pitchgrid.operators.graph import ntriples, parse_ntriples, require_references, triples
from pitchgrid.operators.lookup import fallback_lookup, gaps, strict_map, tolerant_map
from pitchgrid.operators.quality import artifact, bad_minute, check, not_a_date, outside
from pitchgrid.operators.spatial import near_groups, near_pairs
from pitchgrid.operators.temporal import asof, asof_interval, nearest


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_dedup(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, " "), ("a", 3, "x"), ("b", 4, "y"), (None, 5, "z")], "k string, o int, v string")
    assert rows(keep_last(df, ["k"], ["o"]).select("k", "o")) == [("a", 3), ("b", 4), (None, 5)]
    assert rows(keep_first(df, ["k"], ["o"]).select("k", "o")) == [("a", 1), ("b", 4), (None, 5)]
    assert rows(keep_unique(df, ["k"]).select("k", "o")) == [("b", 4), (None, 5)]
    assert rows(duplicated(df, ["k"])) == [("a", 3)]
    assert rows(first_non_empty(df, ["k"], ["v"], "o")) == [("a", "x"), ("b", "y"), (None, "z")]
    assert keep_last(df.limit(0), ["k"], ["o"]).count() == 0


def test_mode_and_hint(spark):
    df = spark.createDataFrame([("v", "B", 1), ("v", "A", 2), ("v", "A", 3), ("w", "Z", 1), ("w", "Y", 2)], "g string, x string, o int")
    assert rows(mode_of(df, ["g"], "x").select("g", "mode")) == [("v", "A"), ("w", "Y")]
    assert rows(mode_of(df, ["g"], "x", "o").select("g", "mode")) == [("v", "A"), ("w", "Z")]
    assert rows(single_valued(df.where("o <> 1 or g = 'w'"), ["g"], "x")) == [("v", "A"), ("w", None)]


def test_number_suffixes(spark):
    df = spark.createDataFrame([("p", 1), ("p", 2), ("p_2", 3), ("q", 4)], "b string, o int")
    ids = [r.id for r in number_suffixes(df, "b", "o", "id").collect()]
    assert len(set(ids)) == 4 and "p" in ids


def test_lookups(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "c", "z"), (4, "d", "w")], "id int, e string, f string")
    right = spark.createDataFrame([("a", "q", 10, 1), ("a", "q", 11, 2), (None, "n", 12, 3), ("k", "z", 13, 4), ("l", "w", 14, 5), ("m", "w", 15, 6)], "e string, f string, v int, o int")
    got = rows(fallback_lookup(left, right, ["e"], ["f"], ["v"], ["o"]).select("id", "v", "found_by"))
    assert got == [(1, 11, "exact"), (2, 12, "exact"), (3, 13, "fallback"), (4, None, None)]
    mapping = spark.createDataFrame([("a", "A")], "e string, out string")
    with pytest.raises(ValueError, match="without an entry"):
        strict_map(left, mapping, "e", "out")
    assert rows(tolerant_map(left, mapping, "e", "out").select("id", "out")) == [(1, "A"), (2, None), (3, None), (4, None)]
    assert rows(gaps(left.select("e"), mapping, ["e"])) == [("c",), ("d",), (None,)]


def test_asof_and_nearest_against_brute_force(spark):
    rnd = random.Random(3)
    ts = lambda s: f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    left = [(i, rnd.choice("abc"), rnd.randrange(80000)) for i in range(120)]
    right = {(rnd.choice("ab"), rnd.randrange(80000)): i for i in range(150)}
    le = spark.createDataFrame([(i, k, ts(t)) for i, k, t in left], "id int, k string, at string").withColumn("at", F.col("at").cast("timestamp"))
    ri = spark.createDataFrame([(k, ts(t), v) for (k, t), v in right.items()], "k string, s string, v int").withColumn("s", F.col("s").cast("timestamp"))
    got = {r.id: r.v for r in asof(le, ri, ["k"], "at", "s", ["v"]).collect()}
    near = {r.id: r.v for r in nearest(le, ri, ["k"], "at", "s", ["v"]).collect()}
    for i, k, t in left:
        past = [(s, v) for (q, s), v in right.items() if q == k and s <= t]
        assert got[i] == (max(past)[1] if past else None)
        every = [(abs(s - t), s, v) for (q, s), v in right.items() if q == k]
        assert near[i] == (min(every)[2] if every else None)


def test_asof_interval_open_ends(spark):
    left = spark.createDataFrame([(1, "a", "2024-06-01")], "id int, t string, d string").withColumn("d", F.col("d").cast("date"))
    right = spark.createDataFrame([("a", "2024-01-01", "2024-06-01", 1), ("a", "2024-02-01", "2024-03-01", 2), ("a", None, "2024-05-01", 3), ("a", "2023-01-01", None, 4)], "t string, s string, u string, elo int")
    right = right.withColumns({c: F.col(c).cast("date") for c in ("s", "u")})
    assert rows(asof_interval(left, right, ["t"], "d", "s", "u", ["elo"], "id").select("elo")) == [(3,)]
    assert rows(asof_interval(left, right.where("s is not null"), ["t"], "d", "s", "u", ["elo"], "id").select("elo")) == [(1,)]


def test_components_against_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, 1000) for i in range(400, 460)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_guard_refuses_two_ids_of_a_source(spark):
    edges = spark.createDataFrame([("n1", "n2", 1), ("n2", "n3", 2), ("p1", "p2", 1)], "a string, b string, priority int")
    labels = spark.createDataFrame([("n1", "understat", "1"), ("n3", "understat", "2"), ("p1", "understat", "7")], "vertex string, source string, id string")
    got = {r.vertex: r.component for r in guarded_components(edges, labels).collect()}
    assert got["n1"] == got["n2"] != got["n3"] and got["p1"] == got["p2"]


def test_spatial_against_brute_force(spark):
    from math import asin, cos, radians, sin, sqrt

    rnd = random.Random(2)
    pts = [(f"s{i}", 40 + rnd.random() * 0.02, -3 + rnd.random() * 0.02) for i in range(120)] + [("n", None, 1.0)]
    df = spark.createDataFrame(pts, "k string, y double, x double")

    def gap(p, q):
        h = sin(radians(q[1] - p[1]) / 2) ** 2 + cos(radians(p[1])) * cos(radians(q[1])) * sin(radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371000 * asin(sqrt(h))

    want = {(p[0], q[0]) for p in pts[:-1] for q in pts[:-1] if p[0] < q[0] and gap(p, q) <= 200}
    assert {(r.a, r.b) for r in near_pairs(df, "k", "y", "x").collect()} == want
    assert near_groups(df, "k", "y", "x").count() == len({v for e in want for v in e})


def test_graph_round_trip(spark):
    df = spark.createDataFrame([("a", 'say "hi"\n\\x', 3, None), ("a", 'say "hi"\n\\x', 3, None), ("b", " ", None, "a"), (None, "q", 1, "a")], "id string, name string, n int, ref string")
    g = triples(df, "Thing", "id", "name", ["n"], {"knows": ("Thing", "ref")})
    back = parse_ntriples(ntriples(g))
    assert rows(back.select("s", "p", "o", "o_type")) == rows(g.select("s", "p", "o", "o_type")) and back.where("bad").count() == 0
    assert parse_ntriples(spark.createDataFrame([("<a> b .",)], "value string")).where("bad").count() == 1
    with pytest.raises(ValueError, match="without a record"):
        require_references(df, "ref", df.where("id = 'b'"), "id")


def test_quality(spark):
    df = spark.createDataFrame([("a", "12.0", "start"), ("a", "70", "-1"), ("", "x", "45"), ("c", None, None)], "id string, t string, m string")
    got = {r.rule: r.failures for r in check(df, "t", [outside("t", -50, 60), outside("t", integer=True), bad_minute("m"), not_a_date("m")]).collect()}
    assert got["minute:m"] == 1
    art = {r.rule: r.failures for r in artifact(df, "t", ["id", "gone"], "id").collect()}
    assert art == {"column:gone": 1, "not_empty": 0, "missing:id": 1, "unique:id": 1}
    assert {r.rule: r.failures for r in artifact(df.limit(0), "t", ["id"], "id").collect()}["not_empty"] == 1


def test_long_keys_are_cut_into_pieces(spark):
    """A key of most rows, read in pieces, gives what the whole would."""
    rnd = random.Random(9)
    left = [(i, "hot" if i % 5 else "cold", float(rnd.randrange(3000)) if i % 17 else None) for i in range(400)]
    right = [("hot" if i % 4 else "cold", float(rnd.randrange(3000)), i) for i in range(300)] + [("hot", 5.0, 900), ("hot", 5.0, 901), ("hot", None, 7)]
    le = spark.createDataFrame(left, "id int, k string, at double")
    ri = spark.createDataFrame(right, "k string, s double, v int")
    got = {r.id: r.v for r in asof(le, ri, ["k"], "at", "s", ["v"], long_key=20).collect()}
    best = lambda k, t: max(((s, v) for kk, s, v in right if t is not None and kk == k and s is not None and s <= t), default=(None, None))[1]
    assert got == {i: best(k, t) for i, k, t in left}


def test_overlapping_intervals_against_brute_force(spark):
    rnd = random.Random(3)
    right = [("t", s if rnd.random() < 0.9 else None, s + rnd.randrange(1, 60) if rnd.random() < 0.8 else None, i) for i, s in enumerate(rnd.randrange(200) for _ in range(80))]
    left = [(i, "t", rnd.randrange(-5, 260)) for i in range(120)]
    got = {r.id: r.v for r in asof_interval(spark.createDataFrame(left, "id int, k string, at int"), spark.createDataFrame(right, "k string, s int, u int, v int"), ["k"], "at", "s", "u", ["v"], "id").collect()}

    def want(t):
        fits = [(s if s is not None else u, v) for _, s, u, v in right if s is not None and s <= t and (u is None or u >= t) or s is None and u is not None and u <= t]
        return max(fits, default=(None, None))[1]

    assert got == {i: want(t) for i, _, t in left}


def test_near_at_the_date_line_and_the_pole(spark):
    rows = [("a", 10.0, 179.9999), ("b", 10.0, -179.9999), ("c", 89.9999, 0.0), ("d", 89.9999, 180.0), ("e", 0.0, 0.0)] + [(f"f{i}", 20.0, 20.0) for i in range(30)] + [("g", 20.0009, 20.0), ("h", 20.0018, 20.0)]
    df = spark.createDataFrame(rows, "k string, y double, x double")
    groups = {}
    for r in near_groups(df, "k", "y", "x").collect():
        groups.setdefault(r.component, set()).add(r.vertex)
    assert sorted(map(sorted, groups.values())) == sorted([["a", "b"], ["c", "d"], sorted([f"f{i}" for i in range(30)] + ["g", "h"])])
