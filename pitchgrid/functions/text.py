"""Cleaning of ids, names, seasons, games and flags as Column builders."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that Unicode does not decompose, with their plain spelling (fixed values).
LETTERS = {"ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ı": "i"}
#: Texts that stand for a missing value (fixed values).
MISSING = ["", "nan", "<na>", "none", "null"]
#: Signs an identifier does not keep (fixed values).
DROPPED = "/<>.,:;()'\"?¿!¡[]{}&#@+*=\\|‚"
#: Letters an identifier spells plainly before marks are taken off (fixed values).
SPELLED = {"ø": "o", "Ø": "O", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "ß": "ss"}


def _folding_table() -> tuple[str, str]:
    """Latin letters with marks and the letter they are built on, from the Unicode data itself."""
    source, target = [], []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if len(base) == 1 and base != letter and base.isascii() and base.isalnum():
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


_FROM, _TO = _folding_table()


def without_accents(text: Column) -> Column:
    """Latin letters without their marks, inside the JVM; combining marks go as well."""
    out = F.translate(F.regexp_replace(text, r"\p{M}+", ""), _FROM, _TO)
    for letter, plain in LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


@F.pandas_udf(T.StringType())
def without_accents_exact(text: pd.Series) -> pd.Series:
    """Like :func:`without_accents` for every script, through the full Unicode tables."""
    table = str.maketrans(LETTERS)
    return text.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x.translate(table)) if not unicodedata.combining(c)))


def redecoded(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; other text as it is."""
    again = F.coalesce(F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string")), text)
    broken = text.rlike("[ÃÅÄ][\\x{0080}-\\x{00BF}]") & ~text.rlike("[^\\x{0000}-\\x{00FF}]")
    return F.when(broken, again).otherwise(text)


def identifier(text: Column, keep_hyphen: bool = False) -> Column:
    """A value as an id: plain letters, words joined by ``_``; case stays; NULL stays NULL.

    UTF-8 that was read as Latin-1 is read again first; ``đ`` and ``ı`` stay, as Unicode has no plain form of them.
    """
    plain = redecoded(F.regexp_replace(text, r"^\s+|\s+$", ""))
    for letter, spelled in SPELLED.items():
        plain = F.replace(plain, F.lit(letter), F.lit(spelled))
    plain = F.translate(F.regexp_replace(plain, r"\p{M}+", ""), _FROM, _TO)
    joined = F.translate(plain, " \u00a0" if keep_hyphen else " \u00a0-", "__" if keep_hyphen else "___")
    return F.regexp_replace(F.regexp_replace(F.translate(joined, DROPPED, ""), "_{2,}", "_"), "^_+|_+$", "")


def clean_text(text: Column) -> Column:
    """The text without surrounding space; empty where it stands for a missing value."""
    bare = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    return F.when(F.lower(bare).isin(MISSING), "").otherwise(bare)


def season_id(text: Column) -> Column:
    """``2324`` as ``2023-2024``, as every four digits are two years of two digits; ``/`` and ``_`` become ``-``."""
    bare = F.translate(F.trim(text.cast("string")), "/_", "--")
    years = F.concat(F.lit("20"), F.substring(bare, 1, 2), F.lit("-20"), F.substring(bare, 3, 2))
    return F.when(bare.rlike(r"^\d{4}$"), years).otherwise(bare)


def season_label(season: Column) -> Column:
    """What a season is shown as: its id, ``2023-2024``."""
    return season_id(season)


def competition_id(league: Column) -> Column:
    return identifier(league, keep_hyphen=True)


def competition_name(league: Column) -> Column:
    """The display name without a three-letter country code in front."""
    return F.trim(F.regexp_replace(F.trim(league), r"^\p{L}{3}-(?=.)", ""))


def source_id(value: Column) -> Column:
    """``12.0`` as ``12``; text that is no number stays, missing values are NULL."""
    bare = clean_text(value)
    number = bare.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), number.cast("bigint").cast("string")).otherwise(F.when(bare != "", bare))


def strict_source_id(value: Column) -> Column:
    """A positive whole number as text; anything else is NULL."""
    number = clean_text(value).try_cast("double")
    return F.when((number > 0) & (number == F.floor(number)), number.cast("bigint").cast("string"))


def boolean(value: Column) -> Column:
    """True, false or NULL of a text."""
    bare = F.lower(clean_text(value))
    return F.when(bare.isin("true", "1", "yes"), True).when(bare.isin("false", "0", "no"), False)


def number(value: Column) -> Column:
    """A double, or NULL where the text is none (NaN included)."""
    parsed = clean_text(value).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def whole(value: Column) -> Column:
    """A long cut to whole units, or NULL."""
    return number(value).cast("bigint")


def date_part(value: Column) -> Column:
    """The ISO day a text begins with, else the day it can be parsed to, else NULL."""
    iso = F.regexp_extract(F.trim(value.cast("string")), r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(iso != "", iso).otherwise(F.date_format(value.cast("string").try_cast("timestamp"), "yyyy-MM-dd"))


#: What divides the teams of a game, in the order of trial (fixed values).
VERSUS = [" - ", "-", " vs ", " v "]
_GAME = r"^\s*(\d{4}-\d{2}-\d{2})\s+(\S.*?)\s*$"


def _divided(rest: Column) -> tuple[Column, Column]:
    home, away = F.lit(None).cast("string"), F.lit(None).cast("string")
    for sign in reversed(VERSUS):
        held, parts = F.contains(rest, F.lit(sign)), F.split(rest, sign, 2)
        home = F.when(held, F.trim(F.get(parts, F.lit(0)))).otherwise(home)
        away = F.when(held, F.trim(F.get(parts, F.lit(1)))).otherwise(away)
    return home, away


def game_parts(game: Column) -> Column:
    """Struct (date, home, away) of ``2025-02-08 Home-Away``; the first of :data:`VERSUS` it holds divides.

    Text that does not begin with a day has no parts at all.
    """
    day, rest = F.regexp_extract(game, _GAME, 1), F.regexp_extract(game, _GAME, 2)
    home, away = _divided(F.when(day != "", rest))
    return F.struct(F.when(day != "", day).alias("date"), home.alias("home"), away.alias("away"))


def game_parts_for(game: Column, home: Column) -> Column:
    """Like :func:`game_parts` where the home team is known, so that hyphens in its name do not divide.

    The text behind the home team must begin with one of :data:`VERSUS` and name an away team; else the plain rule holds.
    """
    own, rest, known = game_parts(game), F.regexp_extract(game, _GAME, 2), F.trim(home)
    behind = F.substring(rest, F.length(known) + 1, F.length(rest))
    away = F.lit(None).cast("string")
    for sign in reversed(VERSUS):
        away = F.when(F.startswith(behind, F.lit(sign)), F.trim(F.substring(behind, F.lit(len(sign) + 1), F.length(rest)))).otherwise(away)
    fits = own["date"].isNotNull() & (F.length(known) > 0) & F.startswith(rest, known) & (F.length(away) > 0)
    return F.struct(own["date"].alias("date"), F.when(fits, known).otherwise(own["home"]).alias("home"), F.when(fits, away).otherwise(own["away"]).alias("away"))


def key_of(*parts: Column) -> Column:
    """Parts joined by ``|``; NULL if one is."""
    return F.concat(*[x for i, p in enumerate(parts) for x in ([p] if i == 0 else [F.lit("|"), p])])


def match_id(competition: Column, season: Column, day: Column, home: Column, away: Column) -> Column:
    return F.concat_ws("_", competition, season, F.coalesce(day, F.lit("unknown_date")), home, away)


def source_player_key(source: Column, player_id: Column, name: Column, competition: Column, season: Column, team: Column) -> Column:
    """``source:id`` where the source has ids, else ``source:competition:season:team:alias``; NULL for a name without letters."""
    alias = F.lower(identifier(name))
    context = F.concat_ws(":", source, competition_id(competition), season_id(season), identifier(team), alias)
    by_id = F.when(source.isin("understat", "whoscored") & strict_source_id(player_id).isNotNull(), F.concat(source, F.lit(":"), strict_source_id(player_id)))
    return F.coalesce(by_id, F.when(alias.rlike(r"\p{L}"), context))


def name_tokens(alias: Column, particles: list[str] | None = None) -> Column:
    """Words of an alias, in order and with repetitions, without the given particles."""
    words = F.filter(F.split(F.lower(alias), "[_\\s]+"), lambda t: t != "")
    return F.filter(words, lambda t: ~t.isin(particles)) if particles else words


def is_abbreviated(name: Column) -> Column:
    """Whether a name holds an abbreviation: a capital with a dot, or a last word of three letters at most with one; blank counts as one."""
    bare = F.trim(F.coalesce(name, F.lit("")))
    return (bare == "") | bare.rlike(r"(?U)(?:\b|^)\p{Lu}\.\s+") | bare.rlike(r"^\p{Lu}\.\s*\S+") | bare.rlike(r"(?U)\b\w{1,3}\.\s*$")


def is_expanded(name: Column) -> Column:
    """Whether a name has two words or more and no abbreviation."""
    return (F.size(name_tokens(F.lower(identifier(F.coalesce(name, F.lit("")))))) >= 2) & ~is_abbreviated(name)


def is_poor_name(name: Column, ambiguous: Column) -> Column:
    """Whether a name is no good to show: abbreviated, or one word that is ambiguous (``ambiguous`` says of the word)."""
    return is_abbreviated(name) | ((F.size(name_tokens(F.lower(identifier(name)))) == 1) & F.coalesce(ambiguous, F.lit(False)))


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts; NULL if one is. Repeated pairs are compared once."""
    from difflib import SequenceMatcher

    memo: dict[tuple[str, str], float] = {}
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        if (x, y) not in memo:
            memo[x, y] = SequenceMatcher(None, x, y).ratio()
        out.append(memo[x, y])
    return pd.Series(out, dtype="float64")


def role_set(positions: Column) -> Column:
    """Sorted lines of the team that a position text names."""
    low = F.lower(F.coalesce(positions, F.lit("")))
    rules = {"goalkeeper": r"\bgk\b|goalkeeper", "defender": r"\bd[lrc]?\b|back|defender", "midfielder": r"\bd?a?m[lrc]\b|\bm\b|midfield", "forward": r"\bfw[lr]?\b|\bf\b|forward|striker|winger", "substitute": r"\bsub\b|\bs\b|substitute"}
    return F.filter(F.array(*[F.when(low.rlike(p), role) for role, p in rules.items()]), lambda x: x.isNotNull())


def label_key(text: Column) -> Column:
    """A label for comparison: lower case, without accents, ``_`` and ``-`` as spaces."""
    return F.trim(F.regexp_replace(F.lower(without_accents(text)), r"[_\-\s]+", " "))


def label_contains(text: Column, wanted: str) -> Column:
    """Whether a label holds another, both as keys."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", wanted.lower().translate(str.maketrans(LETTERS))) if not unicodedata.combining(c))
    return F.contains(label_key(text), F.lit(" ".join(plain.replace("_", " ").replace("-", " ").split())))


def initials(text: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(text, r"[\s_]+"), lambda w: w != ""), lambda w: F.upper(F.substring(w, 1, 1))), "")


def ratio(n: Column, d: Column, times: float = 1.0) -> Column:
    """``times`` n / d; a missing numerator is 0, a missing or not positive denominator gives NULL."""
    return F.when(d > 0, F.coalesce(n, F.lit(0)).cast("double") / d * F.lit(times))


def first_present(*values: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(v.cast("string")) != "", v) for v in values])


def canonical_team(df: DataFrame, team: str, aliases: DataFrame, out: str) -> DataFrame:
    """``df`` with the canonical name of a team by its aliases (alias, canonical); unknown teams keep theirs."""
    from pitchgrid.operators.lookup import small

    table = aliases.select(F.lower(identifier(F.col("alias"))).alias("_k"), F.col("canonical").alias("_c")).dropDuplicates(["_k"])
    return df.withColumn("_k", F.lower(identifier(F.col(team)))).join(small(table), "_k", "left").withColumn(out, F.coalesce("_c", team)).drop("_k", "_c")


def resolve_column(columns: list[str], candidates: list[str]) -> str | None:
    """The first of the candidates that is among the columns."""
    return next((c for c in candidates if c in columns), None)


def renamed(df: DataFrame, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """The columns that ``mapping`` names, as (new name, type); what cannot be cast is NULL, an absent column too."""
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast("string").try_cast(kind).alias(name) for c, (name, kind) in mapping.items()])


def in_target(df: DataFrame, season: str | None, seasons: list[str], competition: str | None = None, competitions: list[str] | None = None) -> DataFrame:
    """Rows of the target seasons and competitions by their normalised labels; without a season column none."""
    if season is None or season not in df.columns:
        return df.limit(0)
    out = df.where(season_id(F.col(f"`{season}`")).isin(seasons))
    return out.where(competition_id(F.col(f"`{competition}`")).isin(competitions or [])) if competition else out


def fill_blank(column: Column, default: str) -> Column:
    """``default`` for a blank or missing value."""
    return F.when(clean_text(column) == "", default).otherwise(column)
