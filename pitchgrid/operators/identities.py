"""Player identities from observations of several sources: edge rules, guarded components, second merges, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.functions.name_rules import name_rules
from pitchgrid.functions.text import identifier, is_abbreviated, is_expanded, name_tokens, role_set
from pitchgrid.operators.components import guarded_components
from pitchgrid.operators.dedup import filled, joined_values, mode_of
from pitchgrid.operators.lookup import small
from pitchgrid.runtime import cut

#: Sources whose keys carry ids of their own (fixed values).
ID_SOURCES = ["understat", "whoscored"]
#: Order of the sources where one key stands for several (fixed values).
SOURCE_ORDER = ["understat", "whoscored", "espn"]
#: Candidates of a key that are kept for review (fixed value).
CANDIDATES = 5
_CONTEXT = ["id_competition", "id_season", "id_team"]


def observation_keys(observations: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Observations counted per (source, key, id, name, alias, context), of the contexts of ``scope`` only.

    Blank keys and names without letters are dropped; partial counts add up map-side.
    """
    rows = observations.where(filled("source_player_key").isNotNull())
    if scope is not None:
        rows = rows.join(small(scope.select(*_CONTEXT).distinct()), _CONTEXT, "left_semi")
    alias = F.lower(identifier(F.col("observed_name")))
    roles = F.array_join(role_set(F.col("positions")), "|") if "positions" in rows.columns else F.lit("")
    rows = rows.select("source", "source_player_key", "source_player_id", "observed_name", alias.alias("alias"), *_CONTEXT, roles.alias("roles")).where(F.col("alias").rlike(r"\p{L}"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("observations"))


def ambiguous_singles(keys: DataFrame) -> DataFrame:
    """(alias, context) of one-word aliases that longer aliases of the context begin with, or that two of them hold."""
    words = keys.select("alias", *_CONTEXT, name_tokens(F.col("alias")).alias("w")).distinct()
    longer = words.where(F.size("w") > 1).select(*_CONTEXT, F.col("alias").alias("longer"), F.posexplode("w").alias("at", "alias"))
    held = words.where(F.size("w") == 1).join(longer, [*_CONTEXT, "alias"])
    per = held.groupBy("alias", *_CONTEXT).agg(F.countDistinct("longer").alias("n"), F.max((F.col("at") == 0).cast("int")).alias("first"))
    return per.where("first = 1 or n >= 2").select("alias", *_CONTEXT)


def _star(df: DataFrame, by: list[str], priority: int) -> DataFrame:
    """Edges from every key of a group to the group's smallest key."""
    low = df.groupBy(*by).agg(F.min("key").alias("b"), F.countDistinct("key").alias("n")).where("n > 1")
    return df.join(low, by).where("key <> b").select(F.col("key").alias("a"), "b", F.lit(priority).alias("priority"))


def _agreeing(df: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose keys with known lines of the team all share one; a key without any agrees with all."""
    known = df.where("roles <> ''")
    per_key = known.select(*by, "key", F.explode(F.split("roles", r"\|")).alias("role")).where("role <> 'substitute'").distinct()
    needed = per_key.groupBy(*by).agg(F.countDistinct("key").alias("_keys"))
    held = per_key.groupBy(*by, "role").agg(F.countDistinct("key").alias("_held")).groupBy(*by).agg(F.max("_held").alias("_held"))
    apart = needed.join(held, by).where("_held < _keys").select(*by)
    return df.join(apart, by, "left_anti")


def identity_edges(keys: DataFrame, variants: bool = True, lineups: DataFrame | None = None) -> DataFrame:
    """(a, b, priority) of source keys that mean the same player.

    1 the same alias of several words in one context. 2 the same one-word alias in one context, where it is
    not ambiguous, every key has that context alone, one at least is backed by an id and the lines of the
    team agree. 3 the same alias at one club in sources without ids. 4 a transfer inside a competition:
    of the keys of an alias of several words exactly one is backed by an id, and the lines agree. 5 names of
    one context that share a word and are alike by :func:`name_rules`. 6 a one-word alias and the fuller
    name it shares most matches with (:func:`single_token_bridges` of ``lineups``). Groups become stars; only
    rule 5 compares two by two, inside a context and a shared word.
    """
    k = keys.select(F.col("source_player_key").alias("key"), "source", "alias", "roles", *_CONTEXT).distinct()
    k = cut(k.withColumns({"words": F.size(name_tokens(F.col("alias"))), "by_id": F.col("source").isin(ID_SOURCES)}))
    many = k.where("words > 1")
    lone = k.groupBy("key").agg(F.countDistinct(*_CONTEXT).alias("_n")).where("_n = 1").select("key")
    one = k.where("words = 1").join(ambiguous_singles(keys), ["alias", *_CONTEXT], "left_anti").join(lone, "key", "left_semi")
    backed = one.where("by_id").select("alias", *_CONTEXT).distinct()
    one = _agreeing(one.join(backed, ["alias", *_CONTEXT], "left_semi"), ["alias", *_CONTEXT])
    edges = [_star(many, ["alias", *_CONTEXT], 1), _star(one, ["alias", *_CONTEXT], 2), _star(k.where(~F.col("by_id")), ["alias", "id_team"], 3)]
    moved = many.groupBy("alias", "id_competition").agg(F.countDistinct(F.when(F.col("by_id"), F.col("key"))).alias("ids")).where("ids = 1").select("alias", "id_competition")
    edges.append(_star(_agreeing(many.join(moved, ["alias", "id_competition"], "left_semi"), ["alias", "id_competition"]), ["alias", "id_competition"], 4))
    if variants:
        parts = many.select("key", "alias", *_CONTEXT, F.explode(F.array_distinct(name_tokens(F.col("alias")))).alias("word")).where(F.length("word") > 2).distinct()
        other = parts.select(*_CONTEXT, "word", F.col("key").alias("b"), F.col("alias").alias("alias_b"))
        near = parts.withColumnRenamed("key", "a").join(other, [*_CONTEXT, "word"]).where("a > b and alias <> alias_b").select("a", "b", "alias", "alias_b").distinct()
        sure = F.array(*[F.lit(r) for r in ("containment", "token_set", "prefix", "surname_variant", "orthographic")])
        edges.append(near.where(F.arrays_overlap(name_rules("alias", "alias_b"), sure)).select("a", "b", F.lit(5).alias("priority")))
    if lineups is not None:
        edges.append(single_token_bridges(lineups).select("a", "b", F.lit(6).alias("priority")))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.groupBy("a", "b").agg(F.min("priority").alias("priority"))


def source_rank(key: Column) -> Column:
    """Sources with ids first, then by name; other sources last."""
    source = F.lower(F.substring_index(key, ":", 1))
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), source), F.lit(0)), F.lit(99))


def candidate_keys(keys: DataFrame, linked: DataFrame) -> DataFrame:
    """(source_player_key, candidate, place) of keys that may mean the same player but were not joined: the best five of each.

    ``linked`` is (vertex, component). Candidates share a context and are alike by a rule of
    :func:`name_rules`; those of components with another id of the same source are left out; sources with ids come first.
    """
    k = keys.select(F.col("source_player_key").alias("vertex"), "alias", *_CONTEXT).distinct().join(linked, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    ids = keys.where(F.col("source").isin(ID_SOURCES) & filled("source_player_id").isNotNull()).select(F.col("source_player_key").alias("vertex"), F.concat_ws(":", "source", "source_player_id").alias("id"), "source")
    held = ids.join(linked, "vertex", "left").withColumn("component", F.coalesce("component", "vertex")).groupBy("component").agg(F.collect_set("source").alias("sources"))
    k = cut(k.join(held, "component", "left"))
    right = k.select(*_CONTEXT, F.col("vertex").alias("candidate"), F.col("alias").alias("alias_b"), F.col("component").alias("component_b"), F.col("sources").alias("sources_b"))
    pairs = k.join(right, _CONTEXT).where("component <> component_b").where(~F.coalesce(F.arrays_overlap("sources", "sources_b"), F.lit(False)))
    close = pairs.select("vertex", "candidate", "alias", "alias_b").distinct().where(F.size(name_rules("alias", "alias_b")) > 0)
    order = Window.partitionBy("vertex").orderBy(source_rank(F.col("candidate")), "candidate")
    ranked = close.select("vertex", "candidate").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= CANDIDATES)
    return ranked.select(F.col("vertex").alias("source_player_key"), "candidate", "place")


def single_token_bridges(lineups: DataFrame) -> DataFrame:
    """(a, b, votes): keys with a one-word alias and the one fuller name they share most matches with.

    ``lineups`` has source_player_key, alias, context, ``game`` and ``played``. Only players who took part
    vote; a key whose two best candidates have as many votes gets none.
    """
    rows = lineups.where("played").select("source_player_key", "alias", *_CONTEXT, "game", name_tokens(F.col("alias")).alias("w")).distinct()
    single = rows.where(F.size("w") == 1).select(F.col("source_player_key").alias("a"), F.col("alias").alias("token"), *_CONTEXT, "game")
    full = rows.where(F.size("w") > 1).select(F.col("source_player_key").alias("b"), *_CONTEXT, "game", F.explode(F.array_distinct("w")).alias("token"))
    votes = single.join(full, [*_CONTEXT, "game", "token"]).groupBy("a", "b").agg(F.countDistinct("game").alias("votes"))
    order = Window.partitionBy("a").orderBy(F.desc("votes"))
    ranked = votes.withColumns({"place": F.row_number().over(order.orderBy(F.desc("votes"), "b")), "level": F.rank().over(order)})
    tied = ranked.where("level = 1 and place > 1").select("a").distinct()
    return ranked.where("place = 1").join(tied, "a", "left_anti").select("a", "b", "votes")


def _best_name(keys: DataFrame, name: Column) -> DataFrame:
    return mode_of(keys.withColumn("_name", name), ["component"], "_name").select("component", F.col("mode").alias("_best"))


def identities(keys: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row per player: names, aliases, keys, ids, contexts, method and a stable id.

    Components of :func:`identity_edges` in which no source has two ids (see
    :func:`guarded_components`). The id is the slug of the longest name of two or more full words, else of
    the name used most; players with the same slug get their clubs added, then a number.
    """
    edges = identity_edges(keys) if edges is None else edges
    labels = keys.where(F.col("source").isin(ID_SOURCES) & filled("source_player_id").isNotNull()).select(F.col("source_player_key").alias("vertex"), "source", F.col("source_player_id").cast("string").alias("id")).distinct()
    linked = guarded_components(edges, labels).withColumnRenamed("vertex", "source_player_key")
    rows = keys.join(linked, "source_player_key", "left").withColumn("component", F.coalesce("component", "source_player_key"))
    full = F.size(F.filter(name_tokens(F.col("alias")), lambda t: F.length(t) > 1)) > 1
    of = lambda source: F.max(F.when(F.col("source") == source, F.col("source_player_id")))
    per = rows.groupBy("component").agg(
        F.max(F.when(full, F.struct(F.length("observed_name").alias("n"), F.col("observed_name").alias("name")))).alias("_full"),
        joined_values("observed_name").alias("aliases"), joined_values("source_player_key").alias("source_player_keys"), of("understat").alias("id_understat"), of("whoscored").alias("id_whoscored"),
        joined_values("id_competition").alias("competitions"), joined_values("id_season").alias("seasons"), joined_values("id_team").alias("teams"), F.sum("observations").alias("observations"),
    )
    method = edges.join(linked.withColumnRenamed("source_player_key", "a"), "a").groupBy("component").agg(F.min("priority").alias("_p"))
    named = per.join(_best_name(rows, F.col("observed_name")), "component").join(method, "component", "left")
    named = named.select(
        "component", F.col("_best").alias("known_as"), F.col("_full.name").alias("full_name"), "aliases", "source_player_keys", "id_understat", "id_whoscored", "competitions", "seasons", "teams", "observations",
        F.when(F.col("_p").isNull(), "single").otherwise(F.concat(F.lit("rule_"), F.col("_p").cast("string"))).alias("resolution_method"),
    )
    return with_ids(named)


def _words(joined: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(joined), F.lit("")), r" \| "), lambda v: v != "")


def base_id(full: Column, known: Column) -> Column:
    """Slug of the full name if it is expanded, else of the name a player is known by; ``unknown_player`` without either."""
    slug = F.when(is_expanded(full), identifier(full)).otherwise(identifier(known))
    return F.coalesce(F.when(slug != "", slug), F.lit("unknown_player"))


def context_suffix(teams: Column, competitions: Column) -> Column:
    """What tells homonyms apart: their clubs, or their competitions where no club is known."""
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\|\s*", "_")
    return F.when(plain(teams) != "", plain(teams)).otherwise(plain(competitions))


def with_ids(rows: DataFrame) -> DataFrame:
    """``rows`` with ``id_player`` and ``id_method``: the slug of the name, homonyms told apart until nothing changes.

    Rows of one id take the ids of their known-as names if those differ, else the slug with its context
    if those differ; a group neither tells apart keeps its id and ``id_method`` says duplicate. ``component``
    identifies a row. A round decides by counts per id; few rounds are needed, as an id changes twice at most.
    """
    known = F.coalesce(F.when(identifier(F.col("known_as")) != "", identifier(F.col("known_as"))), F.lit("unknown_player"))
    rows = rows.withColumns({"_base": base_id(F.col("full_name"), F.col("known_as")), "_known": known, "_suffix": context_suffix(F.col("teams"), F.col("competitions"))})
    rows = rows.withColumns({"_context": F.when(F.col("_suffix") != "", F.concat_ws("_", "_base", "_suffix")), "id_player": F.col("_base"), "id_method": F.lit("name")})
    while True:
        rows = cut(rows)
        per = rows.groupBy("id_player").agg(F.count("*").alias("_n"), F.countDistinct("_known").alias("_k"), F.countDistinct("_context").alias("_c"), F.max((F.col("id_method") == "contextual_homonym").cast("int")).alias("_late")).where("_n > 1")
        joined = rows.join(per, "id_player", "left")
        # an id with its context is the last resort, so ids never go back and the rounds end
        by_name = (F.col("_k") == F.col("_n")) & (F.col("_late") == 0)
        fresh = F.when(F.col("_n").isNull(), F.col("id_player")).when(by_name, F.col("_known")).when(F.col("_c") == F.col("_n"), F.col("_context")).otherwise(F.col("id_player"))
        how = F.when(F.col("_n").isNull(), F.col("id_method")).when(by_name, "known_as_homonym").when(F.col("_c") == F.col("_n"), "contextual_homonym").otherwise("duplicate")
        after = cut(joined.withColumns({"_fresh": fresh, "_how": how}).drop("_n", "_k", "_c", "_late"))
        changed = after.where("_fresh <> id_player").limit(1).count()
        rows = after.withColumns({"id_player": F.col("_fresh"), "id_method": F.col("_how")}).drop("_fresh", "_how")
        if not changed:
            return rows.drop("_base", "_known", "_suffix", "_context")


def valid_id(id_player: Column, full: Column, known: Column, teams: Column, competitions: Column, method: Column) -> Column:
    """Whether an id follows from the names: the slug, or the form that the method of telling homonyms apart gives."""
    known_id = F.coalesce(F.when(identifier(known) != "", identifier(known)), F.lit("unknown_player"))
    base = base_id(full, known)
    suffix = context_suffix(teams, competitions)
    return F.coalesce(
        (id_player == base) | ((method == "known_as_homonym") & (id_player == known_id)) | ((method == "contextual_homonym") & (suffix != "") & (id_player == F.concat_ws("_", base, suffix))), F.lit(False)
    )


def second_merges(rows: DataFrame) -> DataFrame:
    """Identities merged once more, by what only whole identities show; ids are given anew.

    1 the same expanded full name; 2 the same strong name or alias at one club, where one of the two at least
    has an id; 3 the same id as it follows from the names, at one club; 4 a transfer: the same full and
    known-as names in one competition or in seasons that do not overlap. No merge brings two ids of a source
    together (:func:`guarded_components`); the merged row has the longest expanded full name, the names, keys
    and contexts of all, and every rule that was used.
    """
    r = cut(rows.withColumns({
        "_full": F.when(is_expanded(F.col("full_name")), F.lower(identifier(F.col("full_name")))), "_known": F.lower(identifier(F.col("known_as"))), "_id": base_id(F.col("full_name"), F.col("known_as")),
        "_teams": _words("teams"), "_seasons": _words("seasons"), "_competitions": _words("competitions"), "_backed": F.coalesce("id_understat", "id_whoscored").isNotNull(), "key": F.col("component"),
    }))
    strong = F.filter(F.transform(F.concat(F.array("full_name", "known_as"), _words("aliases")), lambda n: F.lower(identifier(n))), lambda n: F.contains(n, F.lit("_")))
    named = r.select("key", "_backed", F.explode(F.array_distinct(strong)).alias("name"), "_teams").select("key", "_backed", "name", F.explode("_teams").alias("team"))
    backed = named.where("_backed").select("name", "team").distinct()
    at_club = r.select("key", "_id", F.explode("_teams").alias("team"))
    moved = r.where("_full is not null")
    in_one = moved.select("key", "_full", "_known", F.explode("_competitions").alias("competition"))
    apart = moved.groupBy("_full", "_known").agg(F.sum(F.size("_seasons")).alias("_n"), F.size(F.array_distinct(F.flatten(F.collect_list("_seasons")))).alias("_d")).where("_n = _d").select("_full", "_known")
    edges = [
        _star(r.where("_full is not null"), ["_full"], 1), _star(named.join(backed, ["name", "team"], "left_semi"), ["name", "team"], 2), _star(at_club, ["_id", "team"], 3),
        _star(in_one, ["_full", "_known", "competition"], 4), _star(moved.join(apart, ["_full", "_known"], "left_semi"), ["_full", "_known"], 4),
    ]
    links = edges[0]
    for e in edges[1:]:
        links = links.unionByName(e)
    links = cut(links.groupBy("a", "b").agg(F.min("priority").alias("priority")))
    ids = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"id_{s}").cast("string").alias("id")) for s in ID_SOURCES])).alias("i")
    labels = r.select(F.col("key").alias("vertex"), ids).select("vertex", "i.source", "i.id").where("id is not null")
    linked = cut(guarded_components(links, labels)).select(F.col("vertex").alias("key"), F.col("component").alias("_group"))
    rules = links.join(linked.withColumnRenamed("key", "a"), "a").groupBy("_group").agg(F.sort_array(F.collect_set(F.concat(F.lit("merge_"), F.col("priority").cast("string")))).alias("_rules"))
    grouped = r.join(linked, "key", "left").withColumn("_group", F.coalesce("_group", "key"))
    every = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(_words(c))))), " | ").alias(c)
    merged = grouped.groupBy("_group").agg(
        F.max_by("known_as", F.struct("observations", "known_as")).alias("known_as"), F.max(F.when(F.col("_full").isNotNull(), F.struct(F.length("full_name").alias("n"), F.col("full_name").alias("name")))).alias("_best"), F.max("full_name").alias("_any"),
        every("aliases"), every("source_player_keys"), F.max("id_understat").alias("id_understat"), F.max("id_whoscored").alias("id_whoscored"), every("competitions"), every("seasons"), every("teams"), F.sum("observations").alias("observations"),
        F.array_sort(F.collect_set("resolution_method")).alias("_methods"),
    )
    merged = merged.join(rules, "_group", "left").select(
        F.col("_group").alias("component"), "known_as", F.coalesce("_best.name", "_any").alias("full_name"), "aliases", "source_player_keys", "id_understat", "id_whoscored", "competitions", "seasons", "teams", "observations",
        F.array_join(F.array_union(F.col("_methods"), F.coalesce("_rules", F.array().cast("array<string>"))), " | ").alias("resolution_method"),
    )
    return with_ids(merged)


def position_evidence(df: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    """(keys, evidence): how often each position is said, ``value (count)`` in order; counts of its own output add up.

    A position is shown as it was first written in ``order``; blank ones say nothing.
    """
    rows = df.select(*keys, order, F.explode(F.split(F.col(column), r"\|")).alias("_p")).withColumn("_p", F.trim("_p")).where("_p <> ''")
    counted = F.regexp_extract("_p", r"^(.*?)\s+\((\d+)\)$", 2)
    bare = F.when(counted != "", F.trim(F.regexp_extract("_p", r"^(.*?)\s+\((\d+)\)$", 1))).otherwise(F.col("_p"))
    rows = rows.select(*keys, order, bare.alias("_shown"), F.when(counted != "", counted.cast("long")).otherwise(1).alias("_n")).withColumn("_key", F.lower(identifier(F.col("_shown")))).where("_key <> ''")
    per = rows.groupBy(*keys, "_key").agg(F.sum("_n").alias("_n"), F.min_by("_shown", F.col(order)).alias("_shown"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("_key", "_shown", "_n"))), lambda x: F.concat(x["_shown"], F.lit(" ("), x["_n"].cast("string"), F.lit(")")))
    return per.groupBy(*keys).agg(F.array_join(shown, " | ").alias("evidence"))


def conflicting_keys(alias_map: DataFrame) -> DataFrame:
    """Source keys that several players hold, with how many; the key NULL is one like any other."""
    return alias_map.groupBy("source_player_key").agg(F.countDistinct("id_player").alias("players"), F.max(F.col("id_player").isNull().cast("int")).alias("unassigned")).where("players > 1")


def consolidated_aliases(alias_map: DataFrame, order: str, strict: bool = True) -> DataFrame:
    """One row per source key: texts joined, the first filled ids and names in ``order``, the sum of the observations,
    the least confidence, whether any row needs review.

    A key of two players raises ValueError with examples unless ``strict`` is off.
    """
    if strict:
        examples = [r[0] for r in conflicting_keys(alias_map).limit(5).collect()]
        if examples:
            raise ValueError(f"source keys of several players, for example {examples}")
    first = lambda c: F.min_by(F.col(c), F.when(filled(c).isNotNull(), F.col(order))).alias(c)
    number = lambda c, t: F.col(c).cast("string").try_cast("double").cast(t)
    per = alias_map.groupBy("source_player_key").agg(
        first("source"), first("source_player_id"), *[joined_values(c).alias(c) for c in ("observed_name", "normalized_alias", *_CONTEXT)], first("sample_game"),
        F.coalesce(F.sum(number("observations", "bigint")), F.lit(0)).alias("observations"), first("id_player"), first("known_as"), first("full_name"), joined_values("method").alias("method"),
        F.min(number("confidence", "double")).alias("_least"), F.coalesce(F.bool_or(F.lower(F.col("needs_review").cast("string")) == "true"), F.lit(False)).cast("string").alias("needs_review"),
    )
    shown = F.when(F.col("_least").isNotNull(), F.format_string("%.3f", "_least")).otherwise("")
    return per.withColumn("confidence", shown).drop("_least")


def context_overlaps(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of keys with whether they share a context (competition, season, club)."""
    sets = keys.groupBy("source_player_key").agg(F.collect_set(F.struct(*_CONTEXT)).alias("_s"))
    of = lambda c: sets.select(F.col("source_player_key").alias(c), F.col("_s").alias(f"_{c}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce(F.arrays_overlap("_a", "_b"), F.lit(False)).alias("overlap"))


def poor_names(rows: DataFrame) -> DataFrame:
    """Identities whose shown name is abbreviated."""
    return rows.where(is_abbreviated(F.col("known_as")))


def unjustified_duplicates(rows: DataFrame) -> DataFrame:
    """Identities of one full name that no club or id tells apart."""
    per = Window.partitionBy("full_name")
    counted = rows.where("full_name is not null").withColumns({"_n": F.count("*").over(per), "_teams": F.size(F.collect_set("teams").over(per)), "_ids": F.size(F.collect_set(F.coalesce("id_understat", "id_whoscored")).over(per))})
    return counted.where("_n > 1 and _teams < _n and _ids < _n").drop("_n", "_teams", "_ids")


def open_reviews(queue: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries of a review queue (source_player_key) whose key is not yet part of an identity of several keys."""
    done = rows.where(F.contains("source_player_keys", F.lit(" | "))).select(F.explode(F.split("source_player_keys", r" \| ")).alias("source_player_key"))
    return queue.join(done, "source_player_key", "left_anti")
