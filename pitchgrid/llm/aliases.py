"""Variant spellings of names: a symmetric-delete index finds neighbours, token assignment compares them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.names import Matcher, deletes, distance, matcher_for, neighbour_keys, token_similarity, tokens
from pitchgrid.runtime import cut

NAME_FIELDS = ["observed_name", "normalized_alias", "known_as", "full_name"]
#: A token is a given name if this share of the squads (and so many squads) use it; at most
#: 1 / GIVEN_SHARE times the tokens of a squad are.
GIVEN_SHARE, GIVEN_SQUADS = 0.05, 3
#: Family names beside which two given names must stand in one row to be nicknames of each other, and their share
#: of all family names beside which the rarer of the two was replaced; a share does not grow with the data.
NICKNAME_SUPPORT, NICKNAME_SHARE = 3, 0.02
#: A nickname is used by this share of the squads; at most 1 / FREQUENT times the tokens of a squad are.
FREQUENT = 0.005


def given_names(squads: DataFrame, share: float = GIVEN_SHARE) -> frozenset[str]:
    """Tokens that a fixed share of the squads use; ``squads`` has block and the name fields."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(block, t) for block, *names in frame.itertuples(index=False) for n in names for t in tokens(n) if len(t) > 2]
            yield pd.DataFrame(set(out), columns=["block", "token"])

    fields = [c for c in NAME_FIELDS if c in squads.columns]
    used = squads.select("block", *fields).mapInPandas(run, "block long, token string").distinct()
    counted = used.groupBy("token").agg(F.count("*").alias("squads"))
    total = squads.select("block").distinct().count()
    kept = counted.where((F.col("squads") >= GIVEN_SQUADS) & (F.col("squads") >= share * total))
    return frozenset(r["token"] for r in kept.select("token").collect())


def nicknames(rows: DataFrame, given: frozenset[str]) -> frozenset[tuple[str, str]]:
    """Pairs of given names that rows use for each other beside at least :data:`NICKNAME_SUPPORT` family names.

    Both must be frequent words, of which there is a fixed number, so that what comes to the driver is bounded too.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = set()
            for names in frame.itertuples(index=False):
                sets = {tokens(n) for n in names if n}
                for a in sets:
                    for b in sets:
                        if a < b and len(a) > 1 and len(b) > 1:
                            left, right = [t for t in a if t not in b], [t for t in b if t not in a]
                            common = [t for t in a if t in b and t not in given]
                            if len(left) == len(right) == 1 and common and left[0] in frequent and right[0] in frequent and min(len(left[0]), len(right[0])) > 2:
                                x, y = sorted((left[0], right[0]))
                                if distance(x, y, 2) > 2 or x[0] != y[0]:
                                    out.add((x, y, max(common, key=len)))
            yield pd.DataFrame(out, columns=["a", "b", "family"])

    fields = [c for c in NAME_FIELDS if c in rows.columns and c != "normalized_alias"]
    if len(fields) < 2:
        return frozenset()
    frequent = given_names(rows, FREQUENT)
    seen = cut(rows.select(*fields).mapInPandas(run, "a string, b string, family string").groupBy("a", "b").agg(F.countDistinct("family").alias("n")))
    ends = F.explode(F.array("a", "b")).alias("token")
    total = seen.select(ends, "n").groupBy("token").agg(F.sum("n").alias("total"))
    of = lambda c: total.select(F.col("token").alias(c), F.col("total").alias(f"total_{c}"))
    kept = seen.where(F.col("n") >= NICKNAME_SUPPORT).join(of("a"), "a").join(of("b"), "b").where(F.col("n") >= NICKNAME_SHARE * F.least("total_a", "total_b"))
    return frozenset((r["a"], r["b"]) for r in kept.select("a", "b").collect())


def candidates(names: list[list[tuple[str, ...]]], matcher: Matcher) -> Iterator[tuple[int, int]]:
    """Pairs of entries with a token of a family name alike (:func:`token_similarity`), through an index of deletes and beginnings."""
    index: dict[str, list[str]] = defaultdict(list)
    holders: dict[str, list[int]] = defaultdict(list)
    for i, own in enumerate(names):
        words = {t for n in own for t in n if len(t) > 2}
        for t in {t for t in words if not matcher.is_given(t)} or words:
            holders[t].append(i)
    for t in holders:
        for key in neighbour_keys(t):
            index[key].append(t)
    near = {(t, t) for t in holders}
    near |= {(a, b) if a < b else (b, a) for held in index.values() if len(held) > 1 for x, a in enumerate(held) for b in held[x + 1 :]}
    seen: set[tuple[int, int]] = set()
    for a, b in near:
        if a == b or token_similarity(a, b) > 0 or deletes(a) & deletes(b):
            seen |= {(min(i, j), max(i, j)) for i in holders[a] for j in holders[b] if i != j}
    yield from seen


def players_of(names: list[list[tuple[str, ...]]], matcher: Matcher) -> list[int]:
    """Number of the player each entry of one squad means.

    Entries of the same name are joined first. An entry with an initial or the family name alone then
    joins the one player it can mean; where several are possible it stays apart.
    """
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    weak: dict[int, dict[int, int]] = defaultdict(dict)
    apart: set[tuple[int, int]] = set()
    for i, j in sorted(candidates(names, matcher)):
        levels = [matcher.level(a, b) for a in names[i] for b in names[j]]
        best = max(levels)
        if best == 3:
            parent[max(root(i), root(j))] = min(root(i), root(j))
        elif best > 0:
            weak[i][j] = weak[j][i] = best
        elif min(levels) < 0:
            apart.add((i, j))
    size: dict[int, int] = defaultdict(int)
    for i in range(len(names)):
        size[root(i)] += 1
    full = {i: any(len([t for t in n if len(t) > 1]) > 1 for n in names[i]) for i in range(len(names))}
    strong = {root(i) for i in range(len(names)) if full[i]}
    for level in (2, 1):
        for i in sorted(weak):
            if root(i) in strong and full[i] and level == 1:
                continue
            reach = {root(j) for j, l in weak[i].items() if l >= level and root(j) in strong and root(j) != root(i)}
            if root(i) not in strong and len(reach) == 1 or root(i) in strong and level == 2 and len(reach) == 1 and not full[i]:
                target = reach.pop()
                parent[root(i)] = target
    for i in sorted(weak):
        if root(i) not in strong:
            for j in weak[i]:
                if root(j) not in strong:
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(names))]


def alias_clusters(aliases: DataFrame) -> DataFrame:
    """(squad, alias_id, observed_name, player): every row with a complete block and the player it means.

    A block is a non-null (id_team, id_season, id_competition). Rows whose names have no letters mean one
    player per spelling; NULL names are skipped; exact copies are one row; a repeated alias_id with other
    names stays once per spelling. Two small word lists learned from all rows go to the tasks: given
    names (at most 20 times the words of a squad) and nicknames.
    """
    keys = ["id_team", "id_season", "id_competition"]
    spelling = [*NAME_FIELDS, "id_player"]
    rows = aliases.where(" and ".join(f"{k} is not null" for k in keys)).select(
        F.xxhash64(*keys).alias("block"), F.concat_ws("|", *keys).alias("squad"), F.col("alias_id").cast("long").alias("alias_id"), *spelling,
        F.md5(F.to_json(F.array(*[F.struct(F.col(c).cast("string").alias("v")) for c in spelling]))).alias("spelled"),
    ).distinct()
    rows = cut(rows)
    given = given_names(rows)
    nick = nicknames(rows, given)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        matcher = matcher_for(given, nick)
        names = []
        for r in frame[spelling].itertuples(index=False):
            own = {tokens(x) for x in r[:4] if isinstance(x, str)}
            if isinstance(r[4], str):
                own.add(tokens(r[4].replace("_", " ")))
            names.append(sorted(n for n in own if n))
        distinct = sorted({tuple(n) for n in names})
        number = dict(zip(distinct, players_of([list(n) for n in distinct], matcher)))
        player = [number[tuple(n)] if n else -1 - k for k, n in enumerate(names)]
        return pd.DataFrame({"squad": frame["squad"], "spelled": frame["spelled"], "player": player})

    # a squad is one task over its different spellings, however many rows repeat them
    spellings = rows.select("block", "squad", "spelled", *spelling).dropDuplicates(["squad", "spelled"])
    players = spellings.groupBy("block", "squad").applyInPandas(run, "squad string, spelled string, player long")
    found = rows.select("squad", "spelled", "alias_id", "observed_name").join(players, ["squad", "spelled"])
    return found.select("squad", "alias_id", "observed_name", "player")


def alias_pairs(clusters: DataFrame) -> DataFrame:
    """(alias_id_a, alias_id_b) of rows that mean one player under different observed_name texts."""
    left = clusters.where("observed_name is not null and alias_id is not null")
    right = left.select("squad", "player", F.col("alias_id").alias("alias_id_b"), F.col("observed_name").alias("other"))
    pairs = left.withColumnRenamed("alias_id", "alias_id_a").join(right, ["squad", "player"])
    return pairs.where("alias_id_a < alias_id_b and observed_name <> other").select("alias_id_a", "alias_id_b").distinct()
