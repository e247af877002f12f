from pitchgrid.operators.orphans import Reference, Relation, orphan_references, orphan_report


def test_cascade(spark):
    parent = spark.createDataFrame([("m1", "x")], "id string, field string")
    child = spark.createDataFrame(
        [("e1", " m1 ", "e2", "2024-01-05 10:00:00"), ("e2", "m9", "e3", "2024-02-01 10:00:00"), ("e3", "  ", None, "2024-03-01 10:00:00"), ("e4", None, "e1", None), ("e2", "m9", "e3", "2024-02-01 10:00:00"), ("e5", "m1", "e6", None), ("e6", "m1", "e5", None)],
        "id string, m string, prev string, at string",
    ).selectExpr("id", "m", "prev", "cast(at as timestamp) at")
    refs = [Reference("child", "m", "parent", "id"), Reference("child", "prev", "child", "id")]
    relations = {"parent": Relation(parent, "id"), "child": Relation(child, "id", "at")}
    got = sorted((r.kind, r.depth, r.field, r.row_id, r.ref, r.period) for r in orphan_references(relations, refs).collect())
    assert got == [("direct", 0, "m", "e2", "m9", "2024-02"), ("inherited", 1, "prev", "e1", "e2", "2024-01"), ("inherited", 2, "prev", "e4", "e1", None)]
    empty = {"parent": Relation(parent.limit(0), "id"), "child": Relation(child, "id", "at")}
    assert orphan_references(empty, refs, inherited=False).where("field = 'm'").count() == 4
    assert orphan_references({"parent": Relation(parent, "id"), "child": Relation(child.limit(0), "id", "at")}, refs).count() == 0
    assert orphan_report(orphan_references(relations, refs)).count() == 3
