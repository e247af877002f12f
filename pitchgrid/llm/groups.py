"""Pairwise matches to groups: connected components on a two-dimensional grid of edge blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.operators.lookup import small
from pitchgrid.operators.packed import Packed, long_fields, split_fields
from pitchgrid.runtime import cut

#: Edges a block of the grid holds on average; the grid grows with the number of edges.
BLOCK_EDGES = 200_000
#: Holders from which a key is hot: such keys are joined by broadcast where their number is proven small.
HOT = 10_000


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of an edge list and the smallest vertex each is joined to, by pointer jumping."""
    vertices, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    parent = np.arange(len(vertices))
    while True:
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, before[a], low)
        np.minimum.at(parent, before[b], low)
        while not np.array_equal(jump := parent[parent], parent):
            parent = jump
        if np.array_equal(parent[a], parent[b]):
            return vertices, vertices[parent]


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    vertices, reps = local_components(frame["u"].to_numpy(), frame["v"].to_numpy())
    return pd.DataFrame({"vertex": vertices, "rep": reps})


def connected_components(edges: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(vertex, root) of every vertex that an edge (u, v) of longs touches; root is the group's smallest.

    The vertices are hashed into blocks and every pair of blocks runs a local union-find over its own
    edges. A vertex then takes the smallest representative its row and column of the grid offer, and
    representatives that met in one vertex are the edges of the next round, until no such edge is
    left. A hub's edges spread over a whole row of blocks, and a block of more than twice the average over
    several tasks. Edges with a NULL end and loops are
    dropped; repeated edges count once; without edges the result is empty.
    """
    current = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    rounds: list[DataFrame] = []
    while True:
        current = cut(current)
        number = current.count()
        if not number and rounds:
            break
        side = max(2, math.ceil(math.sqrt(number / block_edges)))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
        placed = current.select("u", "v", block("u").alias("i"), block("v").alias("j")).withColumn("part", F.lit(0).cast("long"))
        if number > 2 * block_edges:
            # a hub fills one row of blocks: a block far above the average is cut into parts
            full = placed.groupBy("i", "j").agg(F.count("*").alias("n")).where(F.col("n") > 2 * block_edges)
            full = small(cut(full.select("i", "j", F.ceil(F.col("n") / block_edges).alias("parts"))))
            placed = placed.join(full, ["i", "j"], "left").withColumn("part", F.pmod(F.xxhash64("u", "v", F.lit(1)), F.coalesce("parts", F.lit(1)))).drop("parts")
        reps = placed.groupBy("i", "j", "part").applyInPandas(_block, "vertex long, rep long")
        reps = cut(reps)
        parents = reps.groupBy("vertex").agg(F.min("rep").alias("parent"))
        current = reps.join(parents, "vertex").where("rep <> parent").select(F.col("rep").alias("u"), F.col("parent").alias("v")).distinct()
        rounds.append(parents.where("vertex <> parent"))
        if not number:
            break
    root = rounds[-1].withColumnRenamed("parent", "root")
    for parents in reversed(rounds[:-1]):
        later = root.select(F.col("vertex").alias("parent"), "root")
        below = parents.join(later, "parent", "left").select("vertex", F.coalesce("root", "parent").alias("root"))
        root = cut(below.unionByName(root.join(parents, "vertex", "left_anti").select("vertex", "root")))
    return root.unionByName(root.select(F.col("root").alias("vertex"), "root").distinct())


def canonical_key(text: Column) -> Column:
    """A source player key in one spelling; NULL where the text is no key.

    Case, white space around the parts, leading zeros and a final ``.0`` do not count. A key is
    ``source:number`` with a positive number or ``source:competition:season:team:name`` without a blank part.
    """
    parts = F.transform(F.split(F.lower(text), ":", -1), lambda p: F.regexp_replace(p, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    number = F.regexp_extract(F.get(parts, F.lit(1)), r"^0*([1-9]\d*)(?:\.0*)?$", 1)
    filled = ~F.exists(parts, lambda p: p.isin("", "nan"))
    by_number = (F.size(parts) == 2) & filled & (number != "")
    return F.when(by_number, F.concat(F.get(parts, F.lit(0)), F.lit(":"), number)).when((F.size(parts) == 5) & filled, F.array_join(parts, ":"))


def shared_key_edges(holders: DataFrame) -> DataFrame:
    """Star edges (u, v): every holder of a key to the key's smallest holder.

    ``holders`` has vertex, key and ``owner``: NULL for keys that join any two holders, else whether
    this vertex owns the key; such a key joins its holders only where one of them owns it. A key is
    reduced to its smallest holder before the holders are joined to it; keys held more than
    :data:`HOT` times are joined by broadcast (after a count, :func:`small`), so that no task gets all their holders.
    """
    rows = cut(holders.where("key is not null and vertex is not null").select("vertex", F.xxhash64("key").alias("k1"), F.xxhash64("key", F.lit(7), F.reverse("key")).alias("k2"), "owner").distinct())
    stars = rows.groupBy("k1", "k2").agg(F.min("vertex").alias("low"), F.count("*").alias("n"), F.max("owner").alias("owned"), F.count("owner").alias("kept"))
    stars = cut(stars.where("n > 1 and (kept = 0 or owned)").select("k1", "k2", "low", "n"))
    joined = rows.join(stars.where(F.col("n") <= HOT), ["k1", "k2"]).unionByName(rows.join(small(stars.where(F.col("n") > HOT)), ["k1", "k2"]))
    return joined.where("vertex <> low").select(F.col("vertex").alias("u"), F.col("low").alias("v"))


def identity_groups(identities: DataFrame) -> DataFrame:
    """(identity_no, group_no) of the rows of player_identities that are linked to another row.

    Two rows are linked if they share a source player key (:func:`canonical_key`), or if one's aliases
    hold the other's id_player, case ignored; links carry on. NULL or blank fields link nothing;
    exact copies of a row are one row; columns beside those named are not looked at.
    """
    rows = identities.select(F.col("identity_no").cast("long").alias("identity_no"), "id_player", "aliases", "source_player_keys")
    keys = rows.select(F.col("identity_no").alias("vertex"), F.explode(F.split("source_player_keys", r"[|;,\r\n\t]+")).alias("key"))
    keys = keys.select("vertex", F.concat(F.lit("k:"), canonical_key(F.col("key"))).alias("key"), F.lit(None).cast("boolean").alias("owner"))
    own = rows.where("trim(id_player) <> ''").select(F.col("identity_no").alias("vertex"), F.concat(F.lit("p:"), F.lower(F.trim("id_player"))).alias("key"), F.lit(True).alias("owner"))
    values = split_fields(long_fields(identities.select("identity_no", "aliases"), [Packed("aliases", "identity_no")]))
    held = values.select(F.col("row_id").cast("long").alias("vertex"), F.concat(F.lit("p:"), F.lower("value")).alias("key"), F.lit(False).alias("owner"))
    groups = connected_components(shared_key_edges(keys.unionByName(own).unionByName(held)))
    return groups.select(F.col("vertex").alias("identity_no"), F.col("root").alias("group_no"))
