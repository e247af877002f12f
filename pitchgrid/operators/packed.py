"""Several values packed in one text field: infer the dividing signs, split, explode with place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.runtime import cut

#: Signs that may divide a field, with the weight they get before any row was seen.
SIGN_PRIOR = {"|": 0.9, ";": 0.9, "\n": 0.9, "\t": 0.9, "/": 0.6, ",": 0.6}
#: Rows the prior counts for when it is mixed with the observed evidence: some dozens of rows of a source decide alone.
PRIOR_ROWS = 10.0
#: Mixed score from which a sign divides a source's fields.
ACCEPT = 0.4
#: The sign that only divides where no other one does.
WEAK_SIGN = ","
#: White space, which divides only where neither another sign nor the weak one does; a count in brackets stays with its value.
BLANK = " "
_BLANKS = r"[ \u00a0]+(?!\()"
#: Private-use characters that stand for signs inside quotes while a field is split.
_MASK = {sign: chr(0xE000 + i) for i, sign in enumerate([*SIGN_PRIOR, BLANK])}
_SIGNS = "".join(_MASK)
_MASKS = "".join(_MASK.values())


@dataclass(frozen=True)
class Packed:
    """One packed column: where its rows' ids and source names are."""

    field: str
    row_id: str
    source: str | None = None


def _translate(text: Column | str, signs: Column | str, to: Column | str) -> Column:
    """``translate`` whose signs may differ from row to row."""
    as_column = [F.lit(x) if isinstance(x, str) else x for x in (signs, to)]
    return F.call_function("translate", F.col(text) if isinstance(text, str) else text, *as_column)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s ﻿]+|[\s ﻿]+$", "")


def _unwrapped(text: Column) -> Column:
    """The inside of ``[...]`` or ``{...}``, and the quotes of list members as ``"``."""
    stripped = _strip(text)
    listed = stripped.rlike(r"(?s)^\[.*\]$")
    braced = stripped.rlike(r"(?s)^\{.*\}$")
    inner = F.substring(stripped, F.lit(2), F.greatest(F.length(stripped) - 2, F.lit(0)))
    # in a list a single quote is a quote at the edge of a member only
    members = F.regexp_replace(inner, r"(^|,)(\s*)'((?:[^',]|'(?!\s*(?:,|$))|,(?!\s*['\"]))*+)'(?=\s*(?:,|$))", '$1$2"$3"')
    return F.when(listed, members).when(braced, inner).otherwise(stripped)


def _masked(text: Column) -> Column:
    """``text`` with the dividing signs inside double quotes replaced by their masks."""
    parts = F.split(text, '"', -1)
    hidden = F.transform(parts, lambda part, i: F.when((i % 2 == 1) & (i < F.size(parts) - 1), _translate(part, _SIGNS, _MASKS)).otherwise(part))
    return F.array_join(hidden, '"')


def _cleaned(piece: Column) -> Column:
    """A piece without its mask, white space, quotes; NULL where it is no value."""
    bare = _strip(_translate(piece, _MASKS, _SIGNS))
    unquoted = F.regexp_replace(bare, r"(?s)^(?:\"(.*)\"|'(.*)')$", "$1$2")
    value = _strip(F.replace(unquoted, F.lit('""'), F.lit('"')))
    return F.when(~F.lower(value).isin("", "nan"), value)


def _pieces(masked: Column, signs: Column) -> Column:
    """Split at every sign of the text ``signs``; with none the field is one piece."""
    one = F.when(F.length(signs) > 0, _translate(masked, signs, F.rpad(F.lit(""), F.lit(6), F.lit("\x01"))))
    return F.when(one.isNotNull(), F.split(one, "\x01", -1)).otherwise(F.array(masked))


def _blank_pieces(masked: Column) -> Column:
    """Split at white space outside quotes, but not before a count in brackets."""
    return F.split(_strip(masked), _BLANKS, -1)


def _values(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, _cleaned), lambda v: v.isNotNull())


def _shape(piece: Column) -> Column:
    """Type of a piece: words, joints and figures, without a count in brackets."""
    bare = F.regexp_replace(piece, r"\s*\(\d+\)$", "")
    words = F.regexp_replace(bare, r"[\p{L}\p{M}'.]+", "w")
    return F.regexp_replace(F.regexp_replace(words, r"\d+", "9"), r"w([ \-_]w)+", "w+")


def long_fields(df: DataFrame, packed: list[Packed]) -> DataFrame:
    """(field, source, row_id, text) of the packed columns of one table, exact copies once."""
    rows = [
        F.struct(
            F.lit(p.field).alias("field"),
            (F.coalesce(F.col(f"`{p.source}`").cast("string"), F.lit("")) if p.source else F.lit("")).alias("source"),
            F.col(f"`{p.row_id}`").alias("row_id"),
            F.col(f"`{p.field}`").cast("string").alias("text"),
        )
        for p in packed
    ]
    return df.select(F.inline(F.array(*rows))).where(F.col("text").isNotNull() & (F.trim("text") != ""))


def _chosen(fields: DataFrame, signs: DataFrame) -> DataFrame:
    """``fields`` with the masked text, the accepted signs of its source and those among them that divide it."""
    per_source = signs.where("accepted").groupBy("field", "source").agg(F.array_join(F.array_sort(F.collect_list("sign")), "").alias("signs"))
    # at most one row per (field, source): a few kB, whatever the number of rows
    rows = fields.join(F.broadcast(per_source), ["field", "source"], "left").withColumn("masked", _masked(_unwrapped(F.col("text"))))
    strong = _translate(F.coalesce(F.col("signs"), F.lit("")), WEAK_SIGN + BLANK, F.lit(""))
    present = _translate("masked", strong, F.lit("")) != F.col("masked")
    weak = F.contains(F.coalesce("signs", F.lit("")), F.lit(WEAK_SIGN)) & F.contains(F.col("masked"), F.lit(WEAK_SIGN))
    return rows.withColumn("chosen", F.when(present, strong).when(weak, F.lit(WEAK_SIGN)).otherwise(F.lit("")))


def blank_signs(fields: DataFrame, signs: DataFrame) -> DataFrame:
    """Score white space for each (field, source) from the fields that none of ``signs`` divides.

    A piece between blanks counts as regular as far as it also occurs undivided in the same field and
    source: undivided over divided occurrences, 1 at most. A row is as regular as its least regular
    piece, since a name has a part that seldom stands alone. No row where no piece does.
    """
    rows = _chosen(fields, signs).select("field", "source", "masked", "chosen")
    bare = lambda v: F.regexp_replace(v, r"\s*\(\d+\)$", "")
    blank = _values(_blank_pieces(F.col("masked")))
    texts = rows.where("chosen = ''").withColumn("pieces", blank).where(F.size("pieces") > 1).groupBy("field", "source", F.transform("pieces", bare).alias("pieces")).agg(F.count("*").alias("rows"))
    alone = (
        rows.select("field", "source", F.explode(_values(_pieces(F.col("masked"), F.col("chosen")))).alias("value"))
        .select("field", "source", bare(F.col("value")).alias("piece"))
        .where(~F.col("piece").rlike(r"[ \u00a0]"))
        .groupBy("field", "source", "piece")
        .agg(F.count("*").alias("alone"))
    )
    parts = texts.select("field", "source", "pieces", "rows", F.explode("pieces").alias("piece"))
    divided = parts.groupBy("field", "source", "piece").agg(F.sum("rows").alias("divided"))
    known = divided.join(alone, ["field", "source", "piece"]).select("field", "source", "piece", F.least(F.lit(1.0), F.col("alone") / F.col("divided")).alias("share"))
    per_text = parts.join(known, ["field", "source", "piece"], "left").groupBy("field", "source", "pieces").agg(F.max("rows").alias("rows"), F.min(F.coalesce("share", F.lit(0.0))).alias("share"))
    scored = per_text.groupBy("field", "source").agg(F.sum("rows").alias("rows"), (F.sum(F.col("rows") * F.col("share")) / F.sum("rows")).alias("regularity")).where("regularity > 0")
    score = F.col("rows") * F.col("regularity") / (F.col("rows") + F.lit(PRIOR_ROWS))
    return scored.select("field", "source", F.lit(BLANK).alias("sign"), "rows", F.lit(1.0).alias("consistency"), "regularity", score.alias("score"), (score >= ACCEPT).alias("accepted"))


def infer_signs(fields: DataFrame) -> DataFrame:
    """Score each sign for each (field, source): one row per sign seen, :func:`blank_signs` among them."""
    signs = cut(_other_signs(fields))
    return signs.unionByName(blank_signs(fields, signs))


def _other_signs(fields: DataFrame) -> DataFrame:
    """Score each sign of :data:`SIGN_PRIOR` for each (field, source): one row per sign seen.

    For the rows that hold a sign outside quotes (a comma: where no other sign stands), every piece's type
    is looked up among the types of the undivided rows of the same field (type regularity). Piece-count
    consistency weighs it: the squared mean of the rows' piece counts over the mean of their squares, 1
    where all rows have as many, times the share of rows whose pieces are all values. The result has at
    most fields x sources x 6 rows.
    """
    masked = fields.select("field", "source", _masked(_unwrapped(F.col("text"))).alias("masked"))
    strong = [s for s in SIGN_PRIOR if s != WEAK_SIGN]
    present = F.filter(F.array([F.lit(s) for s in strong]), lambda s: F.contains(F.col("masked"), s))
    weak = F.when(F.contains("masked", F.lit(WEAK_SIGN)), F.array(F.lit(WEAK_SIGN)))
    seen = masked.withColumn("sign", F.explode(F.when(F.size(present) > 0, present).otherwise(weak)))
    whole = F.split(_translate("masked", F.col("sign"), F.lit("\x01")), "\x01", -1)
    pieces = seen.select("field", "source", "sign", F.filter(F.transform(whole, _cleaned), lambda p: p.isNotNull()).alias("pieces"), F.size(whole).alias("n"))
    size = F.size("pieces").cast("double")
    steady = pieces.groupBy("field", "source", "sign").agg(
        F.count("*").alias("rows"),
        (F.coalesce(F.avg(size) * F.avg(size) / F.nullif(F.avg(size * size), F.lit(0.0)), F.lit(0.0)) * F.avg((size >= F.col("n") - 1).cast("double"))).alias("consistency"),
    )
    types = (
        pieces.select("field", "source", "sign", F.explode("pieces").alias("piece"))
        .groupBy("field", "source", "sign", _shape(F.col("piece")).alias("shape"))
        .count()
    )
    plain = (
        masked.where(~F.col("masked").rlike(r"[|;\n\t/,]"))
        .select("field", _cleaned(F.col("masked")).alias("piece"))
        .where("piece is not null")
        .groupBy("field", _shape(F.col("piece")).alias("shape"))
        .agg(F.count("*").alias("plain"))
    )
    known = types.join(plain, ["field", "shape"], "left").groupBy("field", "source", "sign").agg(
        (F.sum(F.when(F.col("plain").isNotNull(), F.col("count")).otherwise(0)) / F.sum("count")).alias("regularity")
    )
    prior = F.element_at(F.create_map(*[F.lit(x) for pair in SIGN_PRIOR.items() for x in pair]), F.col("sign"))
    evidence = F.coalesce(F.col("regularity"), F.lit(0.0)) * F.col("consistency")
    return (
        steady.join(known, ["field", "source", "sign"], "left")
        .withColumn("score", (F.col("rows") * evidence + F.lit(PRIOR_ROWS) * prior) / (F.col("rows") + F.lit(PRIOR_ROWS)))
        .withColumn("accepted", F.col("score") >= ACCEPT)
    )


def split_fields(fields: DataFrame, signs: DataFrame | None = None) -> DataFrame:
    """(field, row_id, pos, value) of every value packed in ``fields``.

    ``fields`` has field, source, row_id, text; ``signs`` is what :func:`infer_signs` says of them.
    Every accepted sign that a field holds outside quotes divides it; a comma only where no other one
    does, a blank only where not even a comma does. NULL, blank and ``nan`` pieces are no values; pos counts from 1 over real values; repeated
    rows come out once; repeated values keep their own places. No rows in, no rows out.
    """
    rows = _chosen(fields, infer_signs(fields) if signs is None else signs)
    blank = (F.col("chosen") == "") & F.contains(F.coalesce("signs", F.lit("")), F.lit(BLANK))
    values = _values(F.when(blank, _blank_pieces(F.col("masked"))).otherwise(_pieces(F.col("masked"), F.col("chosen"))))
    return (
        rows.select("field", "row_id", F.posexplode(values).alias("at", "value"))
        .select("field", "row_id", (F.col("at") + 1).cast("long").alias("pos"), "value")
        .distinct()
    )


def split_packed(df: DataFrame, packed: list[Packed]) -> DataFrame:
    """:func:`split_fields` of the packed columns of one table, with signs inferred from the same rows."""
    return split_fields(long_fields(df, packed))
