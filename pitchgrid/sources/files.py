"""Readers and writers of the files the pipeline exchanges: scoped CSV, JSON caches, triples."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.operators.dedup import keep_last
from pitchgrid.operators.graph import ntriples, parse_ntriples
from pitchgrid.operators.lookup import small

#: Days after which a cached answer that found nothing is asked again (fixed value).
NEGATIVE_DAYS = 14


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def path_in_scope(path: str, leagues: list[str], seasons: list[str]) -> bool:
    """Whether a file's name holds one of the leagues and one of the seasons (with ``-`` or ``_``)."""
    name = PurePosixPath(path).name.replace("_", "-").lower()
    plain = lambda x: re.sub(r"[_\s]", "-", x).lower()
    return any(plain(x) in name for x in leagues) and any(plain(x) in name for x in seasons)


def scan_csv(
    spark: SparkSession, pattern: str, columns: list[str], leagues: list[str] | None = None, seasons: list[str] | None = None, types: dict[str, str] | None = None, multi_line: bool = False
) -> DataFrame:
    """Files of a pattern, columns chosen by name; a column that a file lacks is NULL in its rows.

    Files outside the scope are not opened. Every file is read by its own header: files of one header are
    one scan, so there are as many scans as headers. ``types`` gives columns another type than text; what
    cannot be cast is NULL. Large files are split unless ``multi_line`` allows line breaks inside quotes. Order
    by ``_file`` and ``_ord``: the rows of a file keep their places (block of the file, then row), across files
    the path decides.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    paths = sorted(str(s.getPath()) for s in found or [])
    if leagues and seasons:
        paths = [p for p in paths if path_in_scope(p, leagues, seasons)]
    place = T.StructType([T.StructField("block", T.LongType()), T.StructField("row", T.LongType())])
    kinds = types or {}
    if not paths:
        empty = spark.createDataFrame([], T.StructType([*text_schema(columns).fields, T.StructField("_file", T.StringType()), T.StructField("_ord", place)]))
        return empty.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in kinds.items()})
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        by_header.setdefault(tuple(header(spark, path)), []).append(path)
    parts = []
    for names, own in by_header.items():
        raw = spark.read.schema(text_schema(list(names))).option("header", True).option("enforceSchema", True).option("multiLine", multi_line).option("escape", '"').csv(own)
        of = lambda c, names=names: (F.col(f"`{c}`") if c in names else F.lit(None).cast("string")).try_cast(kinds.get(c, "string")).alias(c)
        at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        parts.append(raw.select(*map(of, columns), F.col("_metadata.file_path").alias("_file"), at.alias("_ord")))
    return reduce(DataFrame.unionByName, parts)


def scope_of(path: str, prefix: str) -> str | None:
    """What stands between a file's prefix and ``.csv``: its league and season; NULL for another file."""
    name = PurePosixPath(path).name
    return name[len(prefix) : -4] if name.startswith(prefix) and name.endswith(".csv") else None


def paired_by_scope(paths: list[str], prefix: str, others: list[str], other_prefix: str) -> list[str]:
    """The paths whose scope one of ``others`` has too, in order."""
    known = {scope_of(p, other_prefix) for p in others} - {None}
    return sorted(p for p in paths if scope_of(p, prefix) in known)


def target_seasons(spark: SparkSession, seasons: list[str]) -> DataFrame:
    """The configured seasons as a table (id_season, name, id_understat): the source's id is the first year."""
    return spark.createDataFrame([(s, s, s.split("-", 1)[0]) for s in seasons], "id_season string, name string, id_understat string")


def attempted(items: list, fetch, retries: int = 1) -> tuple[list, list[dict]]:
    """(results, failures) of ``fetch`` over the items, each tried again ``retries`` times; all failing raises RuntimeError.

    Driver-side, for sources outside the cluster; failures say the item, the attempts and the last error.
    """
    done, lost = [], []
    for item in items:
        for attempt in range(retries + 1):
            try:
                done.append(fetch(item))
                break
            except Exception as error:  # noqa: BLE001
                if attempt == retries:
                    lost.append({"item": str(item), "attempts": attempt + 1, "error": str(error)})
    if items and not done:
        raise RuntimeError(f"nothing could be read: {lost[0]['error']}")
    return done, lost


def failure_rows(spark: SparkSession, failures: list[dict]) -> DataFrame:
    """The failures of :func:`attempted` as a side table."""
    return spark.createDataFrame([(f["item"], f["attempts"], f["error"]) for f in failures], "item string, attempts int, error string")


def reusable(previous: DataFrame, queue: DataFrame | None, report: dict | None) -> DataFrame:
    """What the previous run found, or nothing unless it was clean: no open review and none reported as pending."""
    clean = (queue is None or not queue.limit(1).count()) and int((report or {}).get("pending_review") or 0) == 0
    return previous if clean else previous.limit(0)


def catalogue_join(scope: DataFrame, catalogue: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``scope`` with the first catalogue entry of each key; a row without one keeps its key as name."""
    entries = small(catalogue.dropDuplicates([key]).select(key, *names))
    label = F.replace(F.col(key), F.lit("_"), F.lit(" "))
    return scope.join(entries, key, "left").withColumns({n: F.coalesce(F.col(n), label) for n in names})


_TERM = r'<([^<>\s]*)>|"((?:[^"\\]|\\.)*)"(?:\^\^<([^<>\s]+)>|\^\^([\w-]*:[\w.-]+)|@[\w-]+)?|([\w-]*:[\w.%-]*)|([;,.])|\b(a)\b|(-?\d+(?:\.\d+)?|true|false)'


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, o_type, bad) of Turtle with prefixes, ``a``, ``;`` and ``,``; nested blank nodes and collections are ``bad``.

    The file is cut into statements where a line ends with a dot, so its blocks are parsed side by side; the
    prefixes, which stand in lines of their own, are collected first and go to every task.
    """
    lines = spark.read.text(path)
    declared = lines.select(F.regexp_extract("value", r"^\s*@?(?i:prefix)\s+([\w-]*:)\s*<([^<>]*)>", 1).alias("k"), F.regexp_extract("value", r"<([^<>]*)>", 1).alias("v")).where("k <> ''").distinct()
    prefixes = {r["k"]: r["v"] for r in declared.collect()}
    statements = spark.read.option("lineSep", ".\n").text(path).where(F.trim("value") != "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        term = re.compile(_TERM)
        whole = lambda name: prefixes[name.split(":", 1)[0] + ":"] + name.split(":", 1)[1]
        for frame in frames:
            out = []
            for text in frame["value"]:
                body = "\n".join(x for x in text.split("\n") if not re.match(r"\s*(?:#|@?(?i:prefix|base)\b)", x)).strip()
                if not body:
                    continue
                try:
                    out += _statement(body.rstrip(". \n"), term, whole)
                except (KeyError, ValueError):
                    out.append((None, None, body[:200], "bad", True))
            yield pd.DataFrame(out, columns=["s", "p", "o", "o_type", "bad"])

    return statements.mapInPandas(run, "s string, p string, o string, o_type string, bad boolean")


def _statement(body: str, term: re.Pattern, whole) -> list[tuple]:
    """Triples of one statement; ValueError where a sign is none of Turtle's simple terms."""
    nodes: list[tuple[str, str]] = []
    at = 0
    for m in term.finditer(body):
        if body[at : m.start()].strip():
            raise ValueError(body[at : m.start()])
        at = m.end()
        iri, text, kind, short_kind, name, sign, a, bare = m.groups()
        if sign:
            nodes.append(("sign", sign))
        elif a:
            nodes.append(("iri", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"))
        elif text is not None:
            nodes.append(((kind or (whole(short_kind) if short_kind else "string")).rsplit("#", 1)[-1], re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e[1], e[1]), text)))
        elif bare is not None:
            nodes.append(("boolean" if bare in ("true", "false") else "decimal" if "." in bare else "integer", bare))
        else:
            nodes.append(("iri", iri if iri is not None else whole(name)))
    if body[at:].strip() or not nodes or nodes[0][0] != "iri":
        raise ValueError(body)
    out, subject, i = [], nodes[0][1], 1
    while i < len(nodes):
        predicate = nodes[i]
        i += 1
        while i < len(nodes):
            kind, value = nodes[i]
            if predicate[0] != "iri" or kind == "sign":
                raise ValueError(body)
            out.append((subject, predicate[1], value, kind, False))
            i += 1
            if i < len(nodes) and nodes[i] == ("sign", ","):
                i += 1
                continue
            break
        if i < len(nodes):
            if nodes[i] != ("sign", ";"):
                raise ValueError(body)
            i += 1
    if not out:
        raise ValueError(body)
    return out


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file; only its first line is read."""
    return spark.read.option("header", True).option("escape", '"').csv(path).columns


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet; the commit protocol leaves either the old or the whole new table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_cache(spark: SparkSession, path: str, schema: str, version: int | None = None, now: str | None = None) -> DataFrame:
    """Entries of a JSON cache that still count.

    Entries with the status ``error`` are dropped; with ``version`` those of another version too, and
    those that found nothing once they are older than :data:`NEGATIVE_DAYS`.
    """
    entries = spark.read.schema(schema).json(path).where("status is null or status <> 'error'")
    if version is not None:
        age = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        fresh = F.col("cached_at").cast("timestamp") > age - F.expr(f"INTERVAL {NEGATIVE_DAYS} DAYS")
        entries = entries.where((F.col("version") == version) & (F.coalesce(F.col("status") != "not_found", F.lit(True)) | F.coalesce(fresh, F.lit(False))))
    return entries


def read_decisions(spark: SparkSession, path: str, schema: str, key: str = "key", order: str = "decided_at") -> DataFrame:
    """The last decision of each key of a JSON-Lines log."""
    return keep_last(spark.read.schema(schema).json(path), [key], [order])


def compact_decisions(spark: SparkSession, path: str, out: str, schema: str, key: str = "key", order: str = "decided_at") -> None:
    read_decisions(spark, path, schema, key, order).write.mode("overwrite").json(out)


def write_triples(graph: DataFrame, path: str) -> None:
    """N-Triples text; a failed job leaves no output behind."""
    ntriples(graph).write.mode("overwrite").text(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files; ``bad`` marks lines that are none."""
    return parse_ntriples(spark.read.text(path))


def statements(graph: DataFrame, subject: str, predicate: str) -> DataFrame:
    """Lines of one subject and predicate."""
    return ntriples(graph.where((F.col("s") == subject) & (F.col("p") == predicate)))


def load_triples(graph: DataFrame, path: str, clear: bool = True) -> None:
    """Load into a triples table, replacing what it holds or adding to it."""
    graph.write.mode("overwrite" if clear else "append").parquet(path)


def nearest_hour(payloads: DataFrame, key: str, kickoff: str, measures: list[str]) -> DataFrame:
    """The hour of parallel ``time`` and measure arrays that is nearest to the kick-off; the first on ties.

    The arrays of a row stay in the row, so nothing is shuffled.
    """
    zipped = F.arrays_zip("time", *measures)
    gap = lambda x: F.abs(F.unix_timestamp(x["time"].cast("timestamp")) - F.unix_timestamp(F.col(kickoff)))
    ranked = F.transform(zipped, lambda x, i: F.struct(gap(x).alias("gap"), i.alias("i"), x.alias("v")))
    best = F.array_min(F.filter(ranked, lambda x: x["gap"].isNotNull()))
    return payloads.select(key, best["v"]["time"].alias("time"), *[best["v"][m].alias(m) for m in measures])


def batches(df: DataFrame, size: int, order: list[str], group: list[str]) -> DataFrame:
    """``df`` with the number of the batch of ``size`` rows that each row of a group falls into."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(place / size))
