"""Texts cut off by field limits: length histograms per source, and endings that end nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.operators.lookup import small
from pitchgrid.runtime import cut

#: A spike holds at least so many texts and so many times the mean of the lengths around it.
SPIKE_TEXTS, SPIKE_RATIO, AROUND = 5, 8.0, 25
#: Share of a spike's texts that must end nothing; a common length of finished texts is no limit.
SPIKE_OPEN = 0.6
#: A byte limit that falls inside a character leaves the text up to this much shorter.
BYTE_SLACK = 3
#: A last line is a sign-off if this share of all documents (and two texts at least) end with it.
SIGN_OFF_SHARE = 0.0005

_TAIL = r"(?<![\s\p{Z}])(?:[\s\p{Z}]++|</?[A-Za-z][^<>]*+>|&[A-Za-z]{2,8};)++$"
_TERMINAL = r"[.!?…。！？][\"'»”’)\]*_]*+$"
_TICKER = r"^\d{1,3}(?:\+\d{1,2})?['’′]\s+\S+(?:\s+\S+){2,}$"
#: A line in brackets, or one behind a dash or a label that holds no end of a sentence, whatever its length.
_NOTE = r"^(?:\(.+\)|\[.+\]|(?:(?:--|—|–)\s?|\p{Lu}[\p{L}-]+: )\S(?:(?![.!?…]\s).)*+)$"


def _signals(docs: DataFrame) -> DataFrame:
    """One row per document: lengths, last line and how it ends. Texts stay in their own task."""
    body = F.regexp_replace("text", _TAIL, "")
    return (
        docs.select(F.col("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text"))
        .where("text is not null")
        .select(
            "doc_id", "source", F.xxhash64("text").alias("digest"),
            F.length("text").alias("chars"), F.octet_length(F.rtrim(F.col("text"), F.lit("�"))).alias("bytes"),
            (body == "").alias("blank"),
            body.rlike(_TERMINAL).alias("terminal"),
            F.contains(body, F.lit("\n")).alias("lined"),
            F.trim(F.substring_index(body, "\n", -1)).alias("line"),
        )
        .select(
            "doc_id", "source", "digest", "chars", "bytes", "blank", "terminal", "lined",
            F.xxhash64("line").alias("l1"), F.xxhash64(F.reverse("line"), F.lit(7)).alias("l2"),
            F.col("line").rlike(_NOTE).alias("note"), F.col("line").rlike(_TICKER).alias("ticker"),
        )
    )


def length_spikes(signals: DataFrame) -> DataFrame:
    """(source, measure, at, texts, open_texts): lengths at which a source's texts pile up unfinished.

    The histogram has one row per source and length, so it is bounded by the longest text.
    """
    both = F.array(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("at")), F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("at")))
    histogram = signals.select("source", "terminal", F.inline(both)).groupBy("source", "measure", "at").agg(
        F.count("*").alias("texts"), F.sum(F.when(F.col("terminal"), 0).otherwise(1)).alias("open_texts")
    )
    near = Window.partitionBy("source", "measure").orderBy("at").rangeBetween(-AROUND, AROUND)
    spread = histogram.withColumn("others", (F.sum("texts").over(near) - F.col("texts")) / (2 * AROUND))
    tall = (F.col("texts") >= SPIKE_TEXTS) & (F.col("texts") >= SPIKE_RATIO * F.greatest("others", F.lit(0.2)))
    return spread.where(tall & (F.col("open_texts") >= SPIKE_OPEN * F.col("texts"))).select("source", "measure", "at", "texts", "open_texts")


def truncation_signals(docs: DataFrame) -> DataFrame:
    """(doc_id, source, at_limit, terminal, cause, truncated) of every document with a text.

    ``cause`` is ``limit`` for a text whose length in characters or bytes is a spike of its source
    (:func:`length_spikes`) and that ends without terminal punctuation: whatever its last line looks like,
    only a sign-off that many texts share finishes it. Off the spikes, where no common length tells, it is
    ``transfer`` for a text that ends without terminal punctuation and not with a finished line: a
    sign-off, a bracketed, dashed or labelled note, or a ticker line. Else it is NULL; ``truncated``
    says whether there is one. Trailing white space and markup do not count; blank and NULL texts are
    not truncated; NULL sources are one source; repeated rows come out once; no rows give no rows. The
    text and its last line are read whole whatever their length. Spikes are broadcast after a count,
    and so are the shared lines, of which at most 1 / :data:`SIGN_OFF_SHARE` exist.
    """
    signals = cut(_signals(docs))
    spikes = cut(length_spikes(signals))
    chars = spikes.where("measure = 'chars'").select("source", F.col("at").alias("chars"), F.lit(True).alias("char_limit"))
    # a limit in bytes shows at the whole character before it as well
    widths = F.explode(F.sequence(F.col("at") - BYTE_SLACK, F.col("at")))
    bytes_ = spikes.where("measure = 'bytes'").select("source", widths.alias("bytes")).distinct().withColumn("byte_limit", F.lit(True))
    total = signals.count()
    shared = signals.where(F.col("lined") & ~F.col("terminal")).groupBy("l1", "l2").agg(F.countDistinct("digest").alias("texts"))
    shared = shared.where((F.col("texts") >= 2) & (F.col("texts") >= SIGN_OFF_SHARE * total)).select("l1", "l2", F.lit(True).alias("sign_off"))
    out = (
        signals.join(small(chars), ["source", "chars"], "left")
        .join(small(bytes_), ["source", "bytes"], "left")
        .join(small(cut(shared)), ["l1", "l2"], "left")
    )
    at_limit = F.coalesce("char_limit", F.lit(False)) | F.coalesce("byte_limit", F.lit(False))
    sign_off = F.col("lined") & F.coalesce("sign_off", F.lit(False))
    open_ = ~F.col("terminal") & ~F.col("blank") & ~sign_off
    finished = (F.col("lined") & F.col("note")) | F.col("ticker")
    return out.withColumn("at_limit", at_limit).select(
        "doc_id", "source", "at_limit", "terminal",
        F.when(open_ & F.col("at_limit"), "limit").when(open_ & ~finished, "transfer").alias("cause"),
    ).withColumn("truncated", F.col("cause").isNotNull()).distinct()


def truncation_shares(signals: DataFrame) -> DataFrame:
    """Documents per source, those cut at a limit and in transfer, and the share of both."""
    lost = F.sum(F.col("truncated").cast("long"))
    return signals.groupBy("source").agg(
        F.count("*").alias("documents"), lost.alias("truncated"),
        F.count(F.when(F.col("cause") == "limit", 1)).alias("at_limit"), F.count(F.when(F.col("cause") == "transfer", 1)).alias("in_transfer"),
        F.round(lost / F.count("*"), 6).alias("share"),
    )
