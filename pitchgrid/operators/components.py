"""Connected components by alternating stars, with and without a conflict guard."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.runtime import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component): the smallest vertex reachable over the edges; vertices of any ordered type.

    Large and small stars alternate: each vertex's neighbours are linked to its smallest neighbour, until
    the edges no longer change. A vertex's neighbours are reduced by ``min`` before the join, so no
    neighbourhood is collected. NULL ends and loops are dropped.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    stamp = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("x"), "m", "u")
        e = cut(small.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == stamp:
            break
        stamp = now
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())


def guarded_components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(vertex, component) where no component may hold two ids of one source.

    ``edges`` has a, b and ``priority``; ``labels`` has vertex, source and id. Components without a
    conflict come straight from :func:`components`; the edges of a conflicting one are taken in order of
    priority, then ends, and an edge that would bring two ids of a source together is refused. The order
    is by edge, not by pass, so it may part from a sequential run where passes interleave.
    """
    whole = components(edges)
    bad = (
        whole.join(labels, "vertex").where("id is not null").groupBy("component", "source").agg(F.countDistinct("id").alias("n")).where("n > 1").select("component").distinct()
    )
    inside = edges.join(whole.select(F.col("vertex").alias("a"), "component"), "a").join(bad, "component", "left_semi")
    held = whole.join(bad, "component", "left_semi").join(labels, "vertex", "left").groupBy("component", "vertex").agg(F.collect_set(F.concat_ws("\x01", "source", "id")).alias("ids"))

    def split(key, links: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        parent = {v: v for v in members["vertex"]}
        ids = {v: dict(x.split("\x01", 1) for x in i if "\x01" in x) for v, i in zip(members["vertex"], members["ids"])}

        def root(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for x, y in links.sort_values(["priority", "a", "b"])[["a", "b"]].itertuples(index=False):
            p, q = sorted((root(x), root(y)))
            if p != q and all(ids[p].get(s, i) == i for s, i in ids[q].items()):
                parent[q] = p
                ids[p].update(ids[q])
        return pd.DataFrame({"vertex": list(parent), "component": [root(v) for v in parent]})

    kind = dict(whole.dtypes)["vertex"]
    inside = inside.select(F.col("component").alias("part"), "a", "b", "priority")
    held = held.select(F.col("component").alias("whole"), "vertex", "ids")
    parts = inside.groupBy("part").cogroup(held.groupBy("whole")).applyInPandas(split, f"vertex {kind}, component {kind}")
    return whole.join(bad, "component", "left_anti").select("vertex", "component").unionByName(parts)
