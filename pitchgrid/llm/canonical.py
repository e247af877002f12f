"""Free-entered values to a canonical list: a prefix-filter set-similarity join, verified and kept best."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.llm.names import distance, fold
from pitchgrid.runtime import cut

#: Jaccard of the letter groups from which a pair is verified further.
JACCARD = 0.3
#: A word of the list is a kind word (stadium, united) if it stands in this share of the entries.
KIND_SHARE = 0.01
#: A typed word says nothing about the entry if it occurs in so many countries.
SPREAD = 4
#: ... and in this share of the different spellings.
SPREAD_SHARE = 0.0005
#: Similarities from which a name alone, a name beside the right place, or a place alone decides.
NAME_ALONE, NAME_WITH_PLACE, PLACE_ALONE = 0.5, 0.3, 0.5
#: Jaccard from which places, and the single words of clubs, are candidates; edits then decide.
PLACE_JACCARD, WORD_JACCARD = 0.2, 0.25

_SPLIT = re.compile(r"[^a-z0-9]+")
_SECOND = re.compile(r"\s+[-–—]\s+|,\s*|\(|/")


def _key(*columns: str) -> Column:
    """128 bits that stand for a spelling; a NULL differs from every text, wherever it stands."""
    return F.md5(F.to_json(F.array(*[F.struct(F.col(c).cast("string").alias("v")) for c in columns])))


def _words(text: str | None) -> list[str]:
    return [w for w in _SPLIT.split(fold(text)) if w]


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded_words(text: pd.Series) -> pd.Series:
    """Words of a value without case, accents, apostrophes and signs; dotted initials as one word."""
    return text.map(lambda x: _words(re.sub(r"\b(\w)\.(?=\w\b)", r"\1", x)) if isinstance(x, str) else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def name_parts(text: pd.Series) -> pd.Series:
    """The name and what stands behind a dash, comma or bracket, which often is the place."""
    return text.map(lambda x: [p for p in _SECOND.split(x.rstrip(") "), maxsplit=1)] if isinstance(x, str) else [])


def grams(words: Column) -> Column:
    """Distinct groups of three letters of padded words."""
    padded = F.transform(words, lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    each = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def similarity_join(left: DataFrame, right: DataFrame, threshold: float = JACCARD) -> DataFrame:
    """(lid, rid, jaccard) of all pairs of sets with at least ``threshold``; exact.

    ``left`` and ``right`` have an id (lid, rid) and distinct ``tokens``. Tokens are ordered by their
    rarity over both sides; two sets that similar share a token among the rarest of each, so only such
    prefixes are joined, with length and positional filters, before the Jaccard is counted exactly.
    Empty sets are similar to nothing.
    """
    both = left.select("tokens").unionByName(right.select("tokens"))
    rarity = both.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    def ordered(side: DataFrame, key: str) -> DataFrame:
        words = side.select(key, F.explode("tokens").alias("token")).join(rarity, "token")
        sets = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("s"))
        size = F.size("s")
        prefix = size - F.ceil(size * threshold - 1e-9).cast("int") + 1
        return sets.select(key, F.transform("s", lambda x: x["token"]).alias("s"), size.alias("size"), prefix.alias("prefix"))

    a = ordered(left, "lid").withColumnsRenamed({"s": "ls", "size": "ln", "prefix": "lp"})
    b = ordered(right, "rid").withColumnsRenamed({"s": "rs", "size": "rn", "prefix": "rp"})
    heads_a = a.select("lid", "ln", F.posexplode(F.slice("ls", F.lit(1), F.col("lp"))).alias("i", "token"))
    heads_b = b.select("rid", "rn", F.posexplode(F.slice("rs", F.lit(1), F.col("rp"))).alias("j", "token"))
    near = heads_a.join(heads_b, "token").where(
        (F.col("rn") >= threshold * F.col("ln") - 1e-9) & (F.col("ln") >= threshold * F.col("rn") - 1e-9)
        & (F.least(F.col("ln") - F.col("i"), F.col("rn") - F.col("j")) + F.least("i", "j") >= threshold / (1 + threshold) * (F.col("ln") + F.col("rn")) - 1e-9)
    )
    pairs = near.select("lid", "rid").distinct().join(left.select("lid", F.col("tokens").alias("ls")), "lid").join(right.select("rid", F.col("tokens").alias("rs")), "rid")
    common = F.size(F.array_intersect("ls", "rs"))
    verified = pairs.select("lid", "rid", (common / (F.size("ls") + F.size("rs") - common)).alias("jaccard"))
    return cut(verified.where(F.col("jaccard") >= threshold))


def _jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(F.lit(0.0))


def _alike(a: Column, b: Column) -> Column:
    """Share of letters that stay when one text is edited into the other; below 0.55 it counts as nothing."""
    share = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when((F.length(a) > 3) & (share >= 0.55), share).otherwise(F.lit(0.0))


def kind_words(words: DataFrame, share: float = KIND_SHARE) -> list[str]:
    """Words of the list's names that say what an entry is, not which: at most words per name / ``share``."""
    total = words.select("rid").distinct().count()
    counted = words.select("rid", F.explode("words").alias("word")).distinct().groupBy("word").agg(F.count("*").alias("n"))
    return sorted(r["word"] for r in counted.where((F.col("n") >= 3) & (F.col("n") >= share * total)).select("word").collect())


def spread_words(spelled: DataFrame) -> list[str]:
    """Typed words that stand beside :data:`SPREAD` countries and in a share of the spellings: sponsors, common adjectives.

    At most words per name / :data:`SPREAD_SHARE` words pass, whatever the number of rows.
    """
    total = spelled.count()
    used = spelled.select("lid", "country", F.explode("l_words").alias("word")).groupBy("word")
    counted = used.agg(F.countDistinct("country").alias("n"), F.count("*").alias("m"))
    return sorted(r["word"] for r in counted.where((F.col("n") >= SPREAD) & (F.col("m") >= SPREAD_SHARE * total)).select("word").collect())


def map_venues(reports: DataFrame, venues: DataFrame) -> DataFrame:
    """(row_id, ref_id) of every report of a ground: the entry of ``venues`` it means, or ``none``.

    An external id whose figures denote an entry decides. Else the rare words of the typed name are
    joined to those of the list (:func:`similarity_join`), the place stands in for a name of words that
    occur in many countries, and the best entry is kept if name and place are near enough; ties go to
    the right country, then to the smallest id. NULL names, places and ids are allowed; spellings that
    occur many times are compared once; exact copies of a row are one row; a row_id with two different
    reports keeps its best. An empty list maps every row to ``none``.
    """
    digits = F.regexp_extract(F.col("idWikidata"), r"^\s*(?:.*[/:])?\s*[Qq]?\s*0*(\d+)\s*$", 1)
    rows = reports.select(F.col("id_stadium").alias("row_id"), "venue_name", "city", "country", F.when(digits != "", F.concat(F.lit("Q"), digits)).alias("qid")).distinct()
    listed = venues.select(F.col("id_wikidata").alias("rid"), F.col("venue_name").alias("v_name"), F.col("city").alias("v_city"), F.col("country").alias("v_country")).where("rid is not null").dropDuplicates(["rid"])
    listed = listed.withColumns({"words": folded_words("v_name"), "r_city": grams(folded_words("v_city"))})
    listed = cut(listed)
    kinds = kind_words(listed)
    listed = listed.withColumn("r_core", F.filter("words", lambda w: ~w.isin(kinds)))
    spelled = rows.select("venue_name", "city", "country").distinct()
    parts = name_parts("venue_name")
    spelled = spelled.withColumn("parts", parts).withColumns({
        "lid": _key("venue_name", "city", "country"),
        "l_words": folded_words(F.get("parts", F.lit(0))), "behind": folded_words(F.get("parts", F.lit(1))), "l_city_words": folded_words("city"),
    })
    spelled = cut(spelled.withColumn("place", F.when(F.size("l_city_words") > 0, F.col("l_city_words")).otherwise(F.col("behind"))))
    empty = sorted({*kinds, *spread_words(spelled)})
    spelled = spelled.withColumn("l_core", F.filter("l_words", lambda w: ~w.isin(empty) & (F.length(w) > 1)))
    spelled = cut(spelled.select("lid", "venue_name", "city", "country", "l_core", F.array_join("place", " ").alias("l_place"), grams(F.col("place")).alias("l_city"), grams(F.col("l_core")).alias("l_name")))
    by_name = similarity_join(spelled.select("lid", F.col("l_name").alias("tokens")), listed.select("rid", grams(F.col("r_core")).alias("tokens")))
    by_place = similarity_join(spelled.select("lid", F.col("l_city").alias("tokens")), listed.select("rid", F.col("r_city").alias("tokens")), PLACE_JACCARD)
    pairs = by_name.select("lid", "rid").unionByName(by_place.select("lid", "rid")).distinct()
    scored = pairs.join(spelled.select("lid", "country", "l_core", "l_name", "l_city", "l_place"), "lid").join(listed.select("rid", "r_core", "r_city", "v_city", "v_country"), "rid")
    name = F.greatest(_jaccard(F.col("l_name"), grams(F.col("r_core"))), _alike(F.array_join("l_core", " "), F.array_join("r_core", " ")))
    place = F.greatest(_jaccard(F.col("l_city"), F.col("r_city")), _alike(F.col("l_place"), F.array_join(folded_words("v_city"), " ")))
    same = F.when(F.col("country").isNull(), 0.0).when(F.col("country") == F.col("v_country"), 1.0).otherwise(-1.0)
    unnamed = F.size("l_core") == 0
    scored = scored.select("lid", "rid", F.when(~unnamed, name).alias("name"), place.alias("place"), same.alias("land"), (F.size("l_city") > 0).alias("placed"))
    decided = (
        ((F.col("name") >= NAME_ALONE) & ((F.col("place") >= 0.2) | ~F.col("placed") | (F.col("name") >= 0.75)))
        | ((F.col("name") >= NAME_WITH_PLACE) & (F.col("place") >= 0.35))
        | ((F.col("name") >= NAME_WITH_PLACE) & (F.col("land") > 0) & ~F.col("placed"))
        | (F.col("name").isNull() & (F.col("place") >= PLACE_ALONE) & (F.col("land") >= 0))
    )
    score = F.coalesce("name", F.lit(0.0)) + 0.6 * F.col("place") + 0.2 * F.col("land")
    ranked = scored.where(decided).withColumn("score", score)
    best = ranked.groupBy("lid").agg(F.max(F.struct("score", "rid", "name")).alias("b"), F.sort_array(F.collect_list("score"), asc=False).alias("all"))
    # a place alone must leave no second ground of that place
    clear = F.col("b.name").isNotNull() | (F.size("all") == 1) | (F.get("all", F.lit(0)) - F.get("all", F.lit(1)) > 0.1)
    best = best.where(clear).select("lid", F.col("b.rid").alias("by_text"), F.col("b.score").alias("score"))
    out = rows.withColumn("lid", _key("venue_name", "city", "country")).join(best, "lid", "left").join(listed.select(F.col("rid").alias("qid"), F.lit(True).alias("known")), "qid", "left")
    ref = F.when(F.col("known"), F.col("qid")).otherwise(F.coalesce("by_text", F.lit("none")))
    ranked = out.select("row_id", F.struct((ref != "none").alias("hit"), F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("score", F.lit(0.0)).alias("score"), ref.alias("ref_id")).alias("r"))
    return ranked.groupBy("row_id").agg(F.max("r").alias("r")).select("row_id", F.col("r.ref_id").alias("ref_id"))


def _kind_fit(typed: list[str], kinds: list[str], listed: list[str]) -> float:
    """1 if a kind word typed is one of the entry's, abbreviated or not; 0 without any; -1 if one is another's."""
    near = lambda w, k: w == k or len(w) > 3 and distance(w, k, 1) <= 1
    fits = [w for w in typed if any(near(w, k) or k.startswith(w) for k in listed)]
    # beside a kind word that fits, a legal form of two letters says nothing
    if any(w not in fits and (len(w) > 2 or not fits) and any(near(w, k) for k in kinds) for w in typed):
        return -1.0
    return 1.0 if fits else 0.0


def kind_fit(kinds: list[str]):
    """:func:`_kind_fit` of two array columns, as a pandas UDF."""

    @F.pandas_udf(T.DoubleType())
    def fit(typed: pd.Series, listed: pd.Series) -> pd.Series:
        return pd.Series([_kind_fit(list(t), kinds, list(l)) for t, l in zip(typed, listed)], dtype="float64")

    return fit


def map_clubs(values: DataFrame, clubs: DataFrame) -> DataFrame:
    """(value, ref_id) of every typed club: the entry of ``clubs`` it means, or ``none``.

    ``values`` has ``value``. Kind words of the list (united, racing) do not identify a club; its other
    words are joined by :func:`similarity_join`. Among near entries the one whose kind words agree
    with the typed ones is kept; one whose kind words contradict them is none. Two entries of the same
    words of which the value names neither kind leave it unmatched. NULL and blank values and
    placeholders give ``none``; repeated values come out once.
    """
    spelled = cut(values.select("value").where("value is not null").distinct().withColumns({"l_words": folded_words("value"), "lid": _key("value")}))
    listed = clubs.select(F.col("id_team").alias("rid"), "name").where("rid is not null").dropDuplicates(["rid"])
    listed = cut(listed.withColumn("words", folded_words(F.coalesce("name", F.replace("rid", F.lit("_"), F.lit(" "))))))
    kinds = kind_words(listed)
    listed = listed.select("rid", F.filter("words", lambda w: ~w.isin(kinds)).alias("core"), F.filter("words", lambda w: w.isin(kinds)).alias("r_kind"))
    # every word of the value may be the club's name, the others kind words, sponsors and suffixes
    typed = spelled.select("lid", "l_words", F.explode(F.filter("l_words", lambda w: ~w.isin(kinds) & (F.length(w) > 3))).alias("word")).distinct()
    typed = cut(typed.withColumn("wid", F.col("word")))
    words = cut(listed.select("rid", "r_kind", F.explode("core").alias("core"), F.size("core").alias("cores")).withColumn("cid", F.col("core")))
    pairs = similarity_join(
        typed.select(F.col("wid").alias("lid"), grams(F.array("word")).alias("tokens")).distinct(),
        words.select(F.col("cid").alias("rid"), grams(F.array("core")).alias("tokens")).distinct(), WORD_JACCARD,
    ).select(F.col("lid").alias("wid"), F.col("rid").alias("cid"), "jaccard")
    scored = pairs.join(typed, "wid").join(words, "cid")
    edits = F.levenshtein("word", "core") / F.length("core")
    near = scored.withColumn("edits", edits).where((F.col("jaccard") >= NAME_ALONE) | (F.col("edits") <= 0.4))
    near = near.withColumn("kind", kind_fit(kinds)(F.filter("l_words", lambda w: (w != F.col("word")) & ~w.rlike(r"^\d+$")), "r_kind"))
    near = near.where((F.col("kind") > 0) | (F.col("kind") == 0) & ((F.col("jaccard") >= NAME_ALONE) | (F.col("edits") <= 0.3)))
    scored = near.groupBy("lid", "rid").agg(F.max(F.col("jaccard") + 0.5 * F.col("kind") - F.col("edits")).alias("score"))
    best = scored.groupBy("lid").agg(F.max(F.struct("score", "rid")).alias("b"), F.sort_array(F.collect_list("score"), asc=False).alias("all"))
    clear = (F.size("all") == 1) | (F.get("all", F.lit(0)) - F.get("all", F.lit(1)) > 1e-6)
    best = best.where(clear).select("lid", F.col("b.rid").alias("ref"))
    return spelled.join(best, "lid", "left").select("value", F.coalesce("ref", F.lit("none")).alias("ref_id"))
