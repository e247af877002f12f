"""Venue resolution from cached candidates: name variants, ranked choice, cascade, grouping, naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.functions.text import identifier, without_accents
from pitchgrid.operators.dedup import joined_values, keep_first, mode_of, single_valued
from pitchgrid.operators.spatial import near_groups

#: Words in front of and behind a ground's name that its lookup keys leave out (fixed values).
GROUND_FRONT, GROUND_BACK = ["estadio_", "estadi_", "stadium_", "stade_", "stadio_"], ["_football_stadium", "_stadium"]
#: Beginnings of a name to which no ground word is added (fixed values).
GROUND_NAMED = ["estadio", "estadi", "stadium", "el "]
#: Country and its code of each competition (fixed values).
COUNTRIES = {"ESP-La_Liga": ("Spain", "es"), "ENG-Premier_League": ("United Kingdom", "gb"), "FRA-Ligue_1": ("France", "fr"), "GER-Bundesliga": ("Germany", "de"), "ITA-Serie_A": ("Italy", "it")}
REQUIRED = ["name", "city", "country", "latitude", "longitude"]


def _of_competition(competition: Column, part: int) -> Column:
    out = F.lit("")
    for key, values in COUNTRIES.items():
        out = F.when(competition == key, values[part]).otherwise(out)
    return out


def competition_country(competition: Column) -> Column:
    """Country of a competition's id, empty where it is none of :data:`COUNTRIES`."""
    return _of_competition(competition, 0)


def competition_country_code(competition: Column) -> Column:
    """Two-letter code of a competition's country, empty where it is none of :data:`COUNTRIES`."""
    return _of_competition(competition, 1)


def _once(texts: Column) -> Column:
    """An array without texts that differ from an earlier one in case only."""
    low = F.transform(texts, lambda t: F.lower(t))
    return F.filter(texts, lambda t, i: (F.array_position(low, F.lower(t)) == i + 1) & (t != ""))


def query_variants(name: Column) -> Column:
    """Texts to look a ground up by: its name, what is left of a name of three words or more without its first
    ones (a sponsor's), longest first, and each of them with ground words added.

    A last word of fewer than 8 letters is no name. Texts that differ in case only come once.
    """
    whole = F.trim(F.coalesce(name, F.lit("")))
    words = F.filter(F.split(F.translate(whole, "-", " "), r"\s+"), lambda w: w != "")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(words), F.lit(2))), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))
    kept = F.when(F.size(words) >= 3, F.filter(tails, lambda t: F.contains(t, F.lit(" ")) | (F.length(t) >= 8))).otherwise(F.array().cast("array<string>"))
    bases = _once(F.concat(F.array(whole), kept))
    plain = F.filter(bases, lambda t: ~F.lower(t).rlike("^(?:" + "|".join(GROUND_NAMED) + ")"))
    forms = F.flatten(F.transform(plain, lambda t: F.array(F.concat(F.lit("Estadio "), t), F.concat(t, F.lit(" stadium")), F.concat(t, F.lit(" football stadium")))))
    return _once(F.concat(bases, forms))


def lookup_keys(name: Column) -> Column:
    """Comparison keys of a name: its slug, and that without a ground word in front or behind, each by itself."""
    key = F.lower(identifier(F.coalesce(name, F.lit(""))))
    cut = [F.when(F.startswith(key, F.lit(w)), F.substring(key, F.lit(len(w) + 1), F.length(key))) for w in GROUND_FRONT]
    cut += [F.when(F.endswith(key, F.lit(w)), F.substring(key, F.lit(1), F.length(key) - len(w))) for w in GROUND_BACK]
    return F.array_distinct(F.filter(F.transform(F.array(key, *cut), lambda k: F.regexp_replace(k, "^_+|_+$", "")), lambda k: F.coalesce(k != "", F.lit(False))))


def country_penalty(country: Column, code: Column, wanted: Column, wanted_code: Column) -> Column:
    """0 for the wanted country, 1 where the country is unknown, 2 for another; 0 where no country is wanted.

    Where both codes are known they alone decide.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.translate(without_accents(F.lower(F.coalesce(c, F.lit("")))), "_", " "), r"\s+", " "))
    short = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    coded = (short(code) != "") & (short(wanted_code) != "")
    by_name = F.when(plain(country) == plain(wanted), 0).when(plain(country) == "", 1).otherwise(2)
    return F.when(plain(wanted) == "", 0).when(coded, F.when(short(code) == short(wanted_code), 0).otherwise(2)).otherwise(by_name)


def country_hints(venues: DataFrame) -> DataFrame:
    """The one country a venue's matches point to; NULL where they point to several."""
    return single_valued(venues, ["venue"], "country").withColumnRenamed("hint", "country_hint")


def choose(candidates: DataFrame) -> DataFrame:
    """One candidate per venue: right country, a ground, an exact name, then candidate and search rank.

    ``candidates`` has venue, name, country, country_hint, is_stadium, candidate_rank, search_rank. A
    candidate that is no ground and shares no name with the venue is rejected.
    """
    exact = F.arrays_overlap(lookup_keys(F.col("venue")), lookup_keys(F.col("name")))
    none = F.lit(None).cast("string")
    ranked = candidates.withColumns({"exact": F.coalesce(exact, F.lit(False)), "penalty": country_penalty(F.col("country"), none, F.col("country_hint"), none)})
    kept = ranked.where("is_stadium or exact").withColumn("_rank", F.struct("penalty", F.when(F.col("is_stadium"), 0).otherwise(1).alias("s"), F.when(F.col("exact"), 0).otherwise(1).alias("e"), "candidate_rank", "search_rank", "name"))
    return keep_first(kept, ["venue"], ["_rank"]).drop("_rank")


def missing_fields(required: list[str] = REQUIRED) -> Column:
    """Names of the required fields that are blank, joined by commas."""
    return F.array_join(F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)), c) for c in required]), lambda c: c.isNotNull()), ",")


def resolve(steps: DataFrame) -> DataFrame:
    """The record of each venue from the steps of a cascade: the first complete one, else the first at all.

    ``steps`` has venue, ``step`` (its place in the cascade) and the record's fields; ``status`` says what
    a kept record lacks.
    """
    lacks = missing_fields()
    graded = steps.withColumn("_lacks", lacks).withColumn("_full", F.when(F.col("_lacks") == "", 0).otherwise(1))
    best = keep_first(graded, ["venue"], ["_full", "step"])
    return best.withColumn("status", F.when(F.col("_lacks") == "", "resolved").otherwise(F.concat(F.lit("missing_required_fields:"), F.col("_lacks")))).drop("_lacks", "_full")


def grouped(resolved: DataFrame, uses: DataFrame) -> DataFrame:
    """One row per ground: venues of one external id or within 200 m are one.

    ``uses`` has venue and ``home_team`` of matches. The name is the most used catalogue name, else that
    of the most used venue; the venue names come in order of use.
    """
    groups = near_groups(resolved, "venue", "latitude", "longitude", "idWikidata").select(F.col("vertex").alias("venue"), "component")
    rows = resolved.join(groups, "venue", "left").withColumn("component", F.coalesce("component", "venue"))
    counts = uses.groupBy("venue").agg(F.count("*").alias("n"))
    rows = rows.join(counts, "venue", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    named = mode_of(rows.where("trim(name) <> ''"), ["component"], "name").select("component", F.col("mode").alias("catalogue_name"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "venue")))
    per = rows.groupBy("component").agg(
        order.alias("_v"), F.min_by("city", F.struct((-F.col("n")).alias("k"), "venue")).alias("city"), F.min_by("country", F.struct((-F.col("n")).alias("k"), "venue")).alias("country"),
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), joined_values("idWikidata").alias("idWikidata"),
    )
    per = per.join(named, "component", "left")
    return per.select(
        "component", F.coalesce("catalogue_name", F.get("_v", F.lit(0))["venue"]).alias("name"), F.array_join(F.transform("_v", lambda v: v["venue"]), " | ").alias("venue_name"),
        "city", "country", "latitude", "longitude", "idWikidata",
    )


def venue_map(ground_rows: DataFrame, key: str = "component") -> DataFrame:
    """(venue, key) of every venue name of the grouped rows."""
    return ground_rows.select(F.explode(F.split("venue_name", r" \| ")).alias("venue"), key)


def home_of(uses: DataFrame) -> DataFrame:
    """The team that plays most at a venue; ties by name."""
    return mode_of(uses, ["venue"], "home_team").select("venue", F.col("mode").alias("home_team"))
