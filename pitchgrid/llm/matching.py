"""Matching records across sources without keys: sorted neighbourhoods, weighted fields, one-to-one assignment."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.aliases import given_names
from pitchgrid.llm.groups import connected_components
from pitchgrid.llm.names import Matcher, fold, matcher_for, may_be_nicknames, may_share_a_word, nickname_bits, signatures, sparse_assignment, token_similarity, tokens
from pitchgrid.runtime import cut

#: Records a record is compared with in each sort order, and records of a sort order one task compares.
WINDOW, BLOCK = 12, 4_000
#: Records of a long run of equal keys that are compared with as many others in one task, and records one call takes.
CHUNK, CALL = 400, 4_000
#: Tasks of one comparison at most; beyond, a task compares several blocks after each other.
MOST_TASKS = 20_000
#: Weights of name, club and positions in a pair's confidence, the confidence that is kept, and the one
#: that is kept where neither record has another candidate in the other source.
NAME, CLUB, ROLE, KEEP, KEEP_ALONE = 0.70, 0.22, 0.08, 0.66, 0.50
#: Similarity of names by :meth:`Matcher.level`.
LEVELS = {3: 1.0, 2: 0.8, 1: 0.6}
#: Two given names that stand beside one family name in one squad, in different sources, are nicknames of each
#: other if so many family names say so and they are this share of those beside which the rarer one stands in
#: squads that name a family in several sources; a share does not grow with the data as chance meetings do.
NICKNAME_SUPPORT, NICKNAME_SHARE = 3, 0.05
#: A nickname is used by this share of the squads; at most 1 / FREQUENT times the tokens of a squad are.
FREQUENT = 0.005
#: Pairs whose components one task assigns.
SHARE = 20_000

#: First letters of position texts by line of the team (fixed values).
ROLES = {"g": "g", "d": "d", "m": "m", "a": "f", "f": "f", "s": "f"}


@lru_cache(maxsize=100_000)
def season_start(text: str | None) -> int:
    """First year of a season in any of its spellings, 0 without one."""
    digits = re.sub(r"\D", "", text or "")
    if len(digits) == 4 and int(digits[2:]) == (int(digits[:2]) + 1) % 100:
        return 2000 + int(digits[:2])
    return int(digits[:4]) if len(digits) >= 4 else 0


@lru_cache(maxsize=100_000)
def club_words(text: str | None) -> tuple[str, ...]:
    return tuple(w for w in re.split(r"[^a-z0-9]+", fold((text or "").replace(".", ""))) if w)


@lru_cache(maxsize=500_000)
def club_similarity(a: str | None, b: str | None) -> float:
    """1 for the same club, 0.5 where one is unknown, 0 for different ones."""
    x, y = club_words(a), club_words(b)
    if not x or not y:
        return 0.5
    few, many = (x, y) if len(x) <= len(y) else (y, x)
    return 1.0 if all(any(token_similarity(w, v) >= 0.5 for v in many) for w in few) else 0.0


@lru_cache(maxsize=100_000)
def roles(text: str | None) -> frozenset[str]:
    """Lines of the team that a position text names; a substitute says nothing."""
    found = set()
    for word in re.split(r"[^A-Za-z\- ]+", text or ""):
        word = word.strip().lower()
        if not word or word in {"s", "sub", "substitute", "nan", "left", "right"}:
            continue
        if len(word) <= 3:
            found.add({"gk": "g"}.get(word, ROLES.get(word[0], "")))
        else:
            found |= {line for line, stem in (("g", "goal"), ("d", "back"), ("d", "defender"), ("m", "midfield"), ("f", "forward"), ("f", "striker"), ("f", "wing")) if stem in word}
    return frozenset(found - {""})


def sorted_neighbours(records: DataFrame, key: str, order: str, width: int, block: int, compare: Callable[[pd.DataFrame, int], pd.DataFrame], schema: str) -> DataFrame:
    """``compare`` every record with the ``width`` - 1 records behind it in the order of ``key``.

    The records are range-partitioned by key and numbered through; blocks of consecutive numbers are
    compared side by side, each with the first records of the next block as its tail. No key's records
    share a task because of their key.
    """
    ordered = cut(records.repartitionByRange(F.col(key), F.col(order)).sortWithinPartitions(key, order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = {r["p"]: r["n"] for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offset, before = F.lit(0).cast("long"), 0
    starts = []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    if starts:
        offset = F.element_at(F.create_map(*[F.lit(x) for pair in starts for x in pair]), part).cast("long")
    placed = ordered.withColumn("_pos", offset + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    own = F.floor(F.col("_pos") / block)
    also = F.when((F.col("_pos") % block < width - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    # comparing costs far more than the bytes suggest, so every block gets a partition that is not coalesced
    blocks = max(1, min(-(-before // block), MOST_TASKS))
    spread = placed.withColumn("_own", own).withColumn("_block", F.explode(also)).repartition(blocks, "_block")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_pos", kind="stable").reset_index(drop=True)
        return compare(frame, int((frame["_own"] == frame["_block"]).sum()))

    return spread.groupBy("_block").applyInPandas(run, schema)


def same_key_pairs(records: DataFrame, key: str, order: str, least: int, chunk: int, compare: Callable[[pd.DataFrame, pd.DataFrame | None], pd.DataFrame], schema: str) -> DataFrame:
    """``compare`` all records of every run of more than ``least`` equal keys with each other; a NULL key is no run.

    A run is cut into chunks by hash of ``order`` and each two chunks meet in one task, so that a long
    run spreads over many tasks; ``compare`` gets two chunks, or one and None for the pairs within it.
    """
    runs = cut(records.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > least).withColumn("_chunks", F.ceil(F.col("_n") / chunk)))
    total = runs.agg(F.sum(F.col("_n") * F.col("_chunks"))).first()[0] or 0
    calls = max(1, min(-(-total // CALL), MOST_TASKS))
    mine = F.pmod(F.xxhash64(order), F.col("_chunks"))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1), lambda d: F.struct(F.least(F.col("_own"), d).alias("_low"), F.greatest(F.col("_own"), d).alias("_high")))
    spread = records.join(runs, key).withColumn("_own", mine).select(*records.columns, "_own", F.inline(meets))
    spread = spread.withColumn("_call", F.pmod(F.xxhash64(key, "_low", "_high"), F.lit(calls)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, low, high), part in frame.groupby([key, "_low", "_high"], sort=True):
            part = part.sort_values(order, kind="stable")
            own = part["_own"] == low
            out.append(compare(part, None) if low == high else compare(part[own], part[~own]))
        return pd.concat(out)

    return spread.repartition(calls, "_call").groupBy("_call").applyInPandas(run, schema)


def _family_nicknames(records: DataFrame, given: frozenset[str]) -> frozenset[tuple[str, str]]:
    """Given names that stand beside the same family name in one squad, over and over.

    Both must be frequent words, of which there is a fixed number, so that what comes to the driver is bounded too.
    """
    frequent = given_names(records, FREQUENT)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(given)
        for frame in frames:
            out = set()
            for source, block, name in frame[["source", "block", "observed_name"]].itertuples(index=False):
                own = tokens(name)
                family = [t for t in own if len(t) > 3 and not matcher.is_given(t)]
                first = [t for t in own if t != family[-1] and len(t) > 2 and t in frequent] if family else []
                if len(own) == 2 and first:
                    out.add((source, block, family[-1], first[0]))
            yield pd.DataFrame(out, columns=["source", "block", "family", "first"])

    # one row per family of a squad: its names are no more than sources x given names
    named = records.mapInPandas(run, "source string, block long, family string, first string").groupBy("block", "family").agg(F.collect_set(F.struct("source", "first")).alias("names"))
    named = cut(named.where(F.size(F.array_distinct(F.col("names.source"))) > 1))
    each = named.select("family", F.explode(F.array_distinct(F.col("names.first"))).alias("first")).groupBy("first").agg(F.countDistinct("family").alias("families"))
    left = named.select("block", "family", "names", F.explode("names").alias("x"))
    met = left.select("family", "x", F.explode("names").alias("y")).where("x.source <> y.source and x.first < y.first").select("family", F.col("x.first").alias("a"), F.col("y.first").alias("b"))
    met = met.where("left(a, 2) <> left(b, 2) or levenshtein(a, b) > 2")
    counted = met.groupBy("a", "b").agg(F.countDistinct("family").alias("n")).where(F.col("n") >= NICKNAME_SUPPORT)
    counted = counted.join(each.select(F.col("first").alias("a"), F.col("families").alias("f_a")), "a").join(each.select(F.col("first").alias("b"), F.col("families").alias("f_b")), "b")
    return frozenset((r["a"], r["b"]) for r in counted.where(F.col("n") >= NICKNAME_SHARE * F.least("f_a", "f_b")).select("a", "b").collect())


def _assigned(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The pairs of one component that give the greatest total confidence, each record once."""
    if len(pairs) == 1:
        return pairs
    weights: dict[int, dict[int, int]] = {}
    kept = {}
    for a, b, w in sorted(pairs):
        # whole numbers, so that equal confidences stay equal in sums
        weights.setdefault(a, {})[b] = round(w * 1e9)
        kept[a, b] = w
    return [(a, b, kept[a, b]) for a, b in sparse_assignment(weights)]


def _assigned_groups(frame: pd.DataFrame) -> pd.DataFrame:
    """:func:`_assigned` of every component of a share of them: one call for many small components."""
    components: dict[int, list[tuple[int, int, float]]] = {}
    for root, a, b, w in zip(frame["root"].tolist(), frame["a"].tolist(), frame["b"].tolist(), frame["confidence"].tolist()):
        components.setdefault(root, []).append((a, b, w))
    return pd.DataFrame([p for pairs in components.values() for p in _assigned(pairs)], columns=["a", "b", "confidence"])


def match_observations(observations: DataFrame, width: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(obs_id_a, obs_id_b, confidence, evidence) of records of two sources that describe one player.

    Records of one competition and season are sorted by family name, by given name, by the family name's
    consonants and by club; in each order a record is compared with the ``width`` - 1 next ones, and with
    all that share its family name, its consonants and initial, or its known club, however many. A pair's
    confidence weighs the names (:meth:`Matcher.level`), clubs and lines of the team; NULL clubs and
    positions count half; a pair below :data:`KEEP` stays only if neither record has another. Of the pairs kept, those are taken that give the greatest total with each
    record at most once per pair of sources; two records of one third that are both free are paired too (:func:`closed_triads`). NULL or empty names match nothing; exact copies are one
    record; of a repeated obs_id one record is kept; no rows give no pairs.
    """
    fields = ["source", "observed_name", "id_competition", "id_season", "id_team", "positions"]
    records = observations.select(F.col("obs_id").cast("long").alias("obs_id"), *fields).where("obs_id is not null and source is not null and observed_name is not null").dropDuplicates(["obs_id"])
    records = cut(records.withColumn("block", F.xxhash64(F.lower("id_competition"), F.regexp_replace(F.lower("id_team"), r"[^\p{L}\d]", ""))))
    squads = records.where("id_team is not null")
    given = given_names(squads)
    nick = _family_nicknames(squads, given)

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = matcher_for(given, nick)
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                own = tokens(r.observed_name)
                if not own:
                    continue
                scope = f"{fold(r.id_competition)}|{season_start(r.id_season)}|"
                family = [t for t in own if not matcher.is_given(t)] or list(own)
                main = max(family, key=len)
                first = next((t for t in own if t != main), "")
                club = max(club_words(r.id_team), key=len, default="~")
                bones = re.sub(r"[aeiouyhw]|(.)(?=\1)", "", main)
                # records of equal keys of the other two kinds share the family name's run
                runs = {0: main, 2: f"{bones}|{first[:1]}", 3: club if club != "~" else None}
                for kind, key in ((0, f"{main}|{first}"), (1, f"{main[::-1]}|{first}"), (2, f"{bones}|{first[:1]}"), (3, f"{club}|{main}"), (4, f"{club}|{first[:3]}|{main}")):
                    run = runs.get(kind)
                    out.append((r.obs_id, r.source, r.observed_name, r.id_team, r.positions, scope, f"{kind}|{scope}{key}", None if run is None else f"{kind}|{scope}{run}"))
            yield pd.DataFrame(out, columns=["obs_id", "source", "observed_name", "id_team", "positions", "scope", "key", "run"])

    schema = "obs_id long, source string, observed_name string, id_team string, positions string, scope string, key string, run string"
    entries = cut(records.drop("block").mapInPandas(keyed, schema))

    def scored(x: tuple, y: tuple, level: int) -> tuple[int, int, str, float] | None:
        left, right = roles(x.positions), roles(y.positions)
        role = 0.5 if not left or not right else 1.0 if left & right else 0.0
        confidence = NAME * LEVELS[level] + CLUB * club_similarity(x.id_team, y.id_team) + ROLE * role
        if confidence < KEEP_ALONE:
            return None
        a, b = (x, y) if x.source < y.source else (y, x)
        return a.obs_id, b.obs_id, f"{a.source}|{b.source}", confidence

    ends = ["a", "b", "sources", "confidence"]

    def compare(frame: pd.DataFrame, own: int) -> pd.DataFrame:
        """Only pairs that may share a word or a nickname (all pairs of a block at once) are compared word by word."""
        matcher = matcher_for(given, nick)
        rows = list(frame[["obs_id", "source", "observed_name", "id_team", "positions"]].itertuples(index=False))
        names = [tokens(r.observed_name) for r in rows]
        (first, letters), bits = signatures(names), nickname_bits(names, nick)
        sources, scopes, kinds = (pd.factorize(c)[0] for c in (frame["source"], frame["scope"], frame["key"].str[:1]))
        found = []
        for d in range(1, width):
            i = np.arange(min(own, len(rows) - d))
            j = i + d
            met = (sources[i] != sources[j]) & (scopes[i] == scopes[j]) & (kinds[i] == kinds[j])
            met &= may_share_a_word((first[i], letters[i]), (first[j], letters[j])) | may_be_nicknames(bits[i], bits[j])
            for x, y in zip(i[met].tolist(), j[met].tolist()):
                level = matcher.level(names[x], names[y])
                if level > 0 and (pair := scored(rows[x], rows[y], level)):
                    found.append(pair)
        return pd.DataFrame(found, columns=ends).drop_duplicates()

    def by_name(frame: pd.DataFrame) -> tuple[list[tuple[str, ...]], list[list[tuple]]]:
        held: dict[tuple[str, ...], list[tuple]] = {}
        for r in frame[["obs_id", "source", "observed_name", "id_team", "positions"]].itertuples(index=False):
            held.setdefault(tokens(r.observed_name), []).append(r)
        return list(held), list(held.values())

    def compare_all(left: pd.DataFrame, right: pd.DataFrame | None) -> pd.DataFrame:
        """Names are compared once for all records that write them so."""
        matcher = matcher_for(given, nick)
        names, held = by_name(left)
        others, theirs = (names, held) if right is None else by_name(right)
        (fa, la), (fb, lb) = signatures(names), signatures(others)
        met = may_share_a_word((fa[:, None], la[:, None]), (fb[None], lb[None])) | may_be_nicknames(nickname_bits(names, nick)[:, None], nickname_bits(others, nick)[None])
        found = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(met) if right is None else met))):
            level = matcher.level(names[i], others[j])
            if level > 0:
                same = right is None and i == j
                pairs = ((x, y) for at, x in enumerate(held[i]) for y in (held[i][at + 1 :] if same else theirs[j]) if x.source != y.source)
                found += [pair for x, y in pairs if (pair := scored(x, y, level))]
        return pd.DataFrame(found, columns=ends)

    kind = "a long, b long, sources string, confidence double"
    near = sorted_neighbours(entries.drop("run"), "key", "obs_id", width, block, compare, kind)
    runs = same_key_pairs(entries.drop("key"), "run", "obs_id", width, CHUNK, compare_all, kind)
    pairs = cut(near.unionByName(runs).groupBy("a", "b", "sources").agg(F.max("confidence").alias("confidence")))
    alone = pairs.groupBy("a", "sources").agg(F.count("*").alias("n_a")), pairs.groupBy("b", "sources").agg(F.count("*").alias("n_b"))
    pairs = pairs.join(alone[0], ["a", "sources"]).join(alone[1], ["b", "sources"]).where((F.col("confidence") >= KEEP) | ((F.col("n_a") == 1) & (F.col("n_b") == 1))).select("a", "b", "sources", "confidence")
    # a record takes part once for each pair of sources
    ends = pairs.select("*", F.xxhash64("a", "sources").alias("u"), F.xxhash64("b", "sources").alias("v"))
    roots = connected_components(ends.select("u", "v"))
    shares = max(1, -(-pairs.count() // SHARE))
    rooted = ends.join(roots.select(F.col("vertex").alias("u"), "root"), "u").withColumn("share", F.pmod(F.xxhash64("root"), F.lit(shares)))
    grouped = rooted.repartition(shares, "share").groupBy("share").applyInPandas(_assigned_groups, "a long, b long, confidence double")
    chosen = closed_triads(cut(grouped), records.select("obs_id", "source"))
    return chosen.select(F.least("a", "b").alias("obs_id_a"), F.greatest("a", "b").alias("obs_id_b"), F.round("confidence", 4).alias("confidence"), "evidence")


def closed_triads(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """``pairs`` (``evidence`` compared) and those of two records matched to the same third (``evidence`` third), where neither has a partner in the other's source.

    Such records write the name too differently to be compared, one by its initial, one by a nickname; the pair is
    right if both matches are, so its confidence is their product. A record has at most one partner per
    source, so a third record joins as many pairs as there are sources.
    """
    ends = pairs.select("a", "b", "confidence").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "confidence"))
    ends = cut(ends.join(sources.select(F.col("obs_id").alias("b"), F.col("source").alias("of")), "b"))
    left = ends.select("a", F.col("b").alias("x"), F.col("of").alias("sx"), F.col("confidence").alias("cx"))
    right = ends.select("a", F.col("b").alias("y"), F.col("of").alias("sy"), F.col("confidence").alias("cy"))
    open_ = left.join(right, "a").where("sx < sy").select("x", "y", "sx", "sy", (F.col("cx") * F.col("cy")).alias("confidence"))
    taken = ends.select(F.col("a").alias("x"), F.col("of").alias("sy"))
    free = open_.join(taken, ["x", "sy"], "left_anti").join(taken.select(F.col("x").alias("y"), F.col("sy").alias("sx")), ["y", "sx"], "left_anti")
    best = free.groupBy("x", "sy").agg(F.max(F.struct("confidence", "y")).alias("m")).select("x", F.col("m.y").alias("y"), F.col("m.confidence").alias("confidence"))
    once = best.groupBy("y").agg(F.max(F.struct("confidence", "x")).alias("m")).select(F.col("m.x").alias("a"), F.col("y").alias("b"), F.col("m.confidence").alias("confidence"))
    return pairs.select("a", "b", "confidence", F.lit("compared").alias("evidence")).unionByName(once.withColumn("evidence", F.lit("third")))
