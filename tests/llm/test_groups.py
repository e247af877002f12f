import random

import pytest

from pitchgrid.llm.groups import canonical_key, connected_components, identity_groups


@pytest.mark.parametrize("block", [40, 1_000_000])
def test_components_against_union_find(spark, block):
    rnd = random.Random(block)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, 999) for i in range(500, 640)] + [(i, i + 1) for i in range(2000, 2060)] + [(5, 5)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    assert {r.vertex: r.root for r in connected_components(df, block).collect()} == {v: root(v) for v in list(parent)}
    assert connected_components(df.limit(0)).count() == 0


def test_keys(spark):
    cases = {" ESPN : 0012.0": "espn:12", "understat:-1": None, "whoscored:0": None, "whoscored:nan": None, "espn:": None, "x": None, "W:C-1:2023-2024:T:N_a": "w:c-1:2023-2024:t:n_a", "w:c::t:n": None, "espn:1200": "espn:1200"}
    df = spark.createDataFrame([(k,) for k in cases], "k string")
    assert {r.k: r.c for r in df.select("k", canonical_key(df.k).alias("c")).collect()} == cases


def test_groups(spark):
    rows = [(1, "A_1", None, "espn:7|understat:-1"), (2, "B_2", "x | a_1", None), (3, "C_3", None, "ESPN : 007.0; w:3"), (4, "D_4", None, "understat:-1"), (5, "E_5", "Nobody_9", "w:44"), (6, "F_6", "['Nobody_9']", ""), (1, "A_1", None, "espn:7|understat:-1"), (7, None, None, "w:44")]
    df = spark.createDataFrame(rows, "identity_no long, id_player string, aliases string, source_player_keys string")
    assert {tuple(r) for r in identity_groups(df).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (7, 5)}
    assert identity_groups(df.limit(0)).count() == 0
