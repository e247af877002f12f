"""References to records that do not exist: direct orphans, and what hangs on them, down the key graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.runtime import cut

#: Rows of a fixpoint step up to which the step's keys are broadcast (a number and 16 bytes each: 10 MB at most).
BROADCAST_KEYS = 500_000


@dataclass(frozen=True)
class Reference:
    """``table.field`` names the ``target_key`` of ``target``."""

    table: str
    field: str
    target: str
    target_key: str


@dataclass(frozen=True)
class Relation:
    """A table with the column of its rows' ids and of the time a row arrived."""

    df: DataFrame
    row_id: str
    arrived: str | None = None


def bare(text: Column) -> Column:
    """A reference without surrounding white space; NULL where nothing is left."""
    stripped = F.regexp_replace(text.cast("string"), r"^[\s ]+|[\s ]+$", "")
    return F.when(stripped != "", stripped)


def _digest(text: Column) -> list[Column]:
    """128 bits that stand for a key where long keys would be shuffled."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(7), F.reverse(text)).alias("k2")]


def _edges(relations: dict[str, Relation], references: list[Reference]) -> DataFrame:
    """(ref_no, table, field, row_id, ref, period) of every non-blank reference, exact copies once."""
    parts = []
    for table in dict.fromkeys(r.table for r in references):
        relation = relations[table]
        own = [(i, r) for i, r in enumerate(references) if r.table == table]
        cells = F.array(*[F.struct(F.lit(i).alias("ref_no"), F.lit(r.field).alias("field"), bare(F.col(f"`{r.field}`")).alias("ref")) for i, r in own])
        period = F.date_format(F.col(f"`{relation.arrived}`"), "yyyy-MM") if relation.arrived else F.lit(None).cast("string")
        parts.append(
            relation.df.select(F.lit(table).alias("tab"), F.col(f"`{relation.row_id}`").cast("string").alias("row_id"), period.alias("period"), F.inline(cells))
            .where("ref is not null")
            .select("ref_no", "tab", "field", "row_id", "ref", "period")
        )
    return reduce(DataFrame.unionByName, parts)


def _keys(relations: dict[str, Relation], references: list[Reference]) -> DataFrame:
    """(ref_no, k1, k2) of the target keys of every reference."""
    targets: dict[tuple[str, str], list[int]] = {}
    for i, r in enumerate(references):
        targets.setdefault((r.target, r.target_key), []).append(i)
    parts = [
        relations[t].df.select(F.col(f"`{key}`").cast("string").alias("key")).where("key is not null").select(F.explode(F.array(*[F.lit(i) for i in nos])).alias("ref_no"), *_digest(F.col("key")))
        for (t, key), nos in targets.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def orphan_references(relations: dict[str, Relation], references: list[Reference], inherited: bool = True) -> DataFrame:
    """(kind, depth, tab, field, row_id, ref, period) of references that lead nowhere.

    ``direct``: a non-blank reference whose text without surrounding white space equals no target key,
    whenever the target arrived. ``inherited``: the reference's target is there but is itself a row
    with a direct or inherited orphan; ``depth`` counts the steps to the missing record. The cascade
    semi-joins one step's rows down the key graph until a step finds nothing new; rows in a reference
    cycle come out once. Blank or NULL references are none; exact copies count once; NULL row ids stay;
    an empty target makes every reference to it an orphan; an empty table has none.

    The whole tables are shuffled once, as 128-bit digests of the keys; orphans carry their texts.
    """
    edges = _edges(relations, references)
    hashed = edges.select("*", *_digest(F.col("ref")))
    keys = _keys(relations, references).distinct()
    direct = hashed.join(keys, ["ref_no", "k1", "k2"], "left_anti").drop("k1", "k2").distinct().withColumns({"kind": F.lit("direct"), "depth": F.lit(0)})
    columns = ["kind", "depth", "tab", "field", "row_id", "ref", "period"]
    # a row can only pass its fault on if its table has references itself and some reference names its row ids
    holders = {r.table for r in references}
    down = {i: r for i, r in enumerate(references) if relations[r.target].row_id == r.target_key and r.target in holders}
    if not inherited or not down:
        return direct.select(*columns)
    # only these references are followed, so every step reads them from one narrow table and no base table again
    below = cut(hashed.where(F.col("ref_no").isin(list(down))).distinct())
    direct = cut(direct.select("ref_no", *columns))
    found, step, depth = [direct], direct, 0
    seen = direct.select("tab", F.xxhash64("row_id").alias("id1"), F.xxhash64("row_id", F.lit(7)).alias("id2")).distinct()
    while True:
        depth += 1
        parents = step.select("tab", "row_id").where("row_id is not null").distinct()
        hit = F.array(*[F.struct(F.lit(i).alias("ref_no"), F.lit(r.target).alias("target")) for i, r in down.items()])
        frontier = cut(parents.select(F.inline(hit), "tab", "row_id").where("target = tab").select("ref_no", *_digest(F.col("row_id"))))
        size = frontier.count()
        if not size:
            break
        children = below.join(F.broadcast(frontier) if size <= BROADCAST_KEYS else frontier, ["ref_no", "k1", "k2"], "left_semi").drop("k1", "k2")
        fresh = children.withColumns({"kind": F.lit("inherited"), "depth": F.lit(depth), "id1": F.xxhash64("row_id"), "id2": F.xxhash64("row_id", F.lit(7))})
        fresh = cut(fresh.join(seen, ["tab", "id1", "id2"], "left_anti").select("ref_no", *columns, "id1", "id2"))
        found.append(fresh.drop("id1", "id2"))
        seen = seen.unionByName(fresh.select("tab", "id1", "id2").distinct())
        step = fresh
    return reduce(DataFrame.unionByName, found).select(*columns)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, period and kind."""
    return orphans.groupBy("tab", "field", "period", "kind").agg(F.count("*").alias("orphans"), F.countDistinct("ref").alias("missing_refs"))
