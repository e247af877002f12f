import json

import pytest
from pyspark.sql import functions as F

from pitchgrid.functions import text as X
from pitchgrid.operators import lookup as L
from pitchgrid.operators.graph import triples
from pitchgrid.operators.quality import check_file
from pitchgrid.plans import tasks as K
from pitchgrid.sources import files as S
from pitchgrid.streaming.replay import event_stream, windowed_counts


def test_scoped_csv(spark, tmp_path):
    (tmp_path / "espn_FRA-Ligue_1_2024-2025.csv").write_text('game,team\n"2025-02-08 A-B",A\n')
    (tmp_path / "espn_ESP-La_Liga_2024-2025.csv").write_text("game,team\nx,B\n")
    df = S.scan_csv(spark, str(tmp_path / "espn_*.csv"), ["game", "missing"], ["FRA-Ligue 1"], ["2024-2025"])
    assert [tuple(r) for r in df.select("game", "missing").collect()] == [("2025-02-08 A-B", None)]
    assert S.scan_csv(spark, str(tmp_path / "none_*.csv"), ["game"]).count() == 0
    assert S.header(spark, str(tmp_path / "espn_ESP-La_Liga_2024-2025.csv")) == ["game", "team"]


def test_caches(spark, tmp_path):
    rows = [{"key": "a", "status": "error", "version": 2, "cached_at": "2024-01-20", "v": 1}, {"key": "b", "status": "not_found", "version": 2, "cached_at": "2024-01-01", "v": 2}, {"key": "c", "status": "ok", "version": 2, "cached_at": "2023-01-01", "v": 3}, {"key": "d", "status": "ok", "version": 1, "cached_at": "2024-01-20", "v": 4}, {"key": "c", "status": "ok", "version": 2, "cached_at": "2023-02-01", "v": 5}]
    path = tmp_path / "cache.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    schema = "key string, status string, version int, cached_at string, v int"
    assert {r.v for r in S.read_cache(spark, str(path), schema, 2, "2024-02-01").collect()} == {3, 5}
    assert {r.v for r in S.read_decisions(spark, str(path), schema, "key", "cached_at").collect()} == {1, 2, 5, 4}


def test_triples_and_hours(spark, tmp_path):
    g = triples(spark.createDataFrame([("a", "A")], "id string, name string"), "Thing", "id", "name")
    S.write_triples(g, str(tmp_path / "g"))
    assert S.read_triples(spark, str(tmp_path / "g")).drop("bad").exceptAll(g).count() == 0
    p = spark.createDataFrame([("m", "2024-01-01 15:30:00", ["2024-01-01T15:00", "2024-01-01T16:00"], [1.0, 2.0])], "id string, k string, time array<string>, temp array<double>")
    assert S.nearest_hour(p.withColumn("k", F.col("k").cast("timestamp")), "id", "k", ["temp"]).first().temp == 1.0


def test_stream_counts(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 10:00:00", "a"), ("2024-01-01 11:00:00", "a"), ("2024-01-02 10:00:00", "b")], "ts string, k string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    counts = windowed_counts(event_stream(spark, str(tmp_path / "in"), "ts timestamp, k string"), "ts", "k")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.n) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}


def test_every_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,n\n1,7\n2,bad\n")
    (tmp_path / "b.csv").write_text('n,y,x\n8,"q ""r"", s",3\n')
    df = S.scan_csv(spark, str(tmp_path / "*.csv"), ["x", "y", "n"], types={"n": "bigint"})
    got = [(r.x, r.y, r.n) for r in df.orderBy("_file", "_ord").collect()]
    assert got == [("1", None, 7), ("2", None, None), ("3", 'q "r", s', 8)] and dict(df.dtypes)["n"] == "bigint"
    (tmp_path / "c.csv").write_text('x,y,n\n9,"two\nlines",1\n')
    assert [r.y for r in S.scan_csv(spark, str(tmp_path / "c.csv"), ["x", "y"], multi_line=True).collect()] == ["two\nlines"]


def test_rows_of_a_split_file_keep_their_order(spark, tmp_path):
    (tmp_path / "big.csv").write_text("n\n" + "\n".join(map(str, range(5000))) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = S.scan_csv(spark, str(tmp_path / "big.csv"), ["n"])
        assert df.rdd.getNumPartitions() > 2
        assert [int(r.n) for r in df.orderBy("_file", "_ord").collect()] == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_runs_and_scopes(spark):
    assert S.paired_by_scope(["d/s_L1_S1.csv", "d/s_L2_S1.csv", "d/x.csv"], "s_", ["e/p_L1_S1.csv"], "p_") == ["d/s_L1_S1.csv"]
    assert [tuple(r) for r in S.target_seasons(spark, ["2023-2024"]).collect()] == [("2023-2024", "2023-2024", "2023")]
    tried = []

    def fetch(item):
        tried.append(item)
        if item == "bad" or (item == "late" and tried.count("late") == 1):
            raise OSError(f"no {item}")
        return item.upper()

    done, lost = S.attempted(["a", "late", "bad"], fetch)
    assert done == ["A", "LATE"] and [(f["item"], f["attempts"], f["error"]) for f in lost] == [("bad", 2, "no bad")]
    assert S.failure_rows(spark, lost).first().attempts == 2
    with pytest.raises(RuntimeError):
        S.attempted(["bad"], fetch)
    previous = spark.range(3)
    assert [S.reusable(previous, q, r).count() for q, r in ((None, None), (spark.range(0), {"pending_review": "0"}), (spark.range(1), None), (None, {"pending_review": 2}))] == [3, 3, 0, 0]
    scope, names = spark.createDataFrame([("A_B",), ("C",)], "id string"), spark.createDataFrame([("C", "Cee"), ("C", "Cee")], "id string, label string")
    assert {tuple(r) for r in S.catalogue_join(scope, names, "id", ["label"]).collect()} == {("A_B", "A B"), ("C", "Cee")}


def test_turtle(spark, tmp_path):
    (tmp_path / "g.ttl").write_text('@prefix ex: <http://x/> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n# note\nex:a a ex:Match ;\n  ex:name "A \\"b\\" . c"@en, "D" ;\n  ex:score 3 ;\n  ex:at "2024-01-01"^^xsd:date .\n<http://x/b> ex:of ex:a .\nex:c ex:broken [ ex:d 1 ] .\nex:e nope:x 1 .\n')
    rows = S.read_turtle(spark, str(tmp_path / "g.ttl")).collect()
    good = {(r.s, r.p, r.o, r.o_type) for r in rows if not r.bad}
    assert good == {
        ("http://x/a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://x/Match", "iri"), ("http://x/a", "http://x/name", 'A "b" . c', "string"), ("http://x/a", "http://x/name", "D", "string"),
        ("http://x/a", "http://x/score", "3", "integer"), ("http://x/a", "http://x/at", "2024-01-01", "date"), ("http://x/b", "http://x/of", "http://x/a", "iri"),
    }
    assert sum(r.bad for r in rows) == 2


def test_columns_and_lookups(spark, tmp_path):
    df = spark.createDataFrame([("1", "2324", "SRB-Liga A"), ("x", "2022-2023", "SRB-Liga B")], "Goals string, season string, league string")
    assert X.resolve_column(df.columns, ["goals", "Goals", "season"]) == "Goals" and X.resolve_column([], ["a"]) is None
    assert [tuple(r) for r in X.renamed(df, {"Goals": ("goals", "int"), "none": ("other", "double")}).collect()] == [(1, None), (None, None)]
    assert X.in_target(df, "season", ["2023-2024"]).count() == 1 and X.in_target(df, "nothing", ["2023-2024"]).count() == 0 and X.in_target(df, "season", ["2023-2024"], "league", ["SRB-Liga_B"]).count() == 0
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    one, two = spark.createDataFrame([("a", " "), ("b", "B1")], "k string, v string"), spark.createDataFrame([("a", "A2"), ("b", "B2")], "k string, v string")
    assert {tuple(r) for r in L.chained_lookup(keys, [one, two], "k", ["v"]).collect()} == {("a", "A2"), ("b", "B1"), ("c", None)}
    found = spark.createDataFrame([("a", None), ("a", None), ("b", "exact"), ("c", None)], "k string, found_by string")
    assert [tuple(r) for r in L.unresolved(found, ["k"]).collect()] == [("a", 2), ("c", 1)]
    for name, text in (("ok.json", "{}"), ("no.json", "{"), ("none.json", "")):
        (tmp_path / name).write_text(text)
    (tmp_path / "x.ttl").write_text("@prefix a: <b> .\n")
    assert [check_file(str(tmp_path / n), k)[:1] for n, k in (("ok.json", "json"), ("none.json", "json"), ("gone", "file"), ("x.ttl", "ttl"))] == [[], ["empty"], ["missing"], ["no_triples"]]
    assert check_file(str(tmp_path / "no.json"), "json")[0].startswith("invalid")
    entry = K.merged_payload({"status": "OK", "metrics": {"a": 1}}, {"status": "warning", "metrics": {"b": 2}, "warnings": ["w"]})
    assert entry == {"status": "WARNING", "metrics": {"a": 1, "b": 2}, "warnings": ["w"]} and K.merged_payload({"status": "ERROR"}, None)["status"] == "ERROR"
    art = K.Artifact("t/{league}_{season}.csv", ("k", "w"), "k", per_scope=True)
    assert art.paths([("L", "S")]) == ["t/L_S.csv"] and K.artifact_failures(art, [("L", "S")], lambda p: keys) == ["t/L_S.csv: column:w"]
