"""Tables as triples: set-semantics graph, literals with datatypes, N-Triples text, pattern lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = "http://example.org/pitchgrid/"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
#: Spark types and the XML Schema datatypes of their literals (fixed values).
DATATYPES = {"string": "string", "bigint": "integer", "int": "integer", "double": "double", "boolean": "boolean", "date": "date", "timestamp": "dateTime"}


def iri(kind: str, key: str | Column) -> Column:
    """The resource of a class and an id; NULL or blank ids have none."""
    col = F.col(key) if isinstance(key, str) else key
    return F.when(F.trim(col.cast("string")) != "", F.concat(F.lit(f"{BASE}resource/{kind}/"), col.cast("string")))


def local_name(resource: str | Column) -> Column:
    """What stands behind the last slash."""
    return F.regexp_replace(resource if isinstance(resource, Column) else F.col(resource), "^.*/", "")


def triples(df: DataFrame, kind: str, key: str, label: str | None = None, properties: list[str] | None = None, edges: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(s, p, o, o_type) of one table: type, label, typed literals and edges; NULL and blank values have none.

    ``edges`` maps a predicate to (class, column). One pass over the table: the triples of a row are an
    array that is exploded, not a union of scans. Repeated triples come out once.
    """
    kinds = dict(df.dtypes)
    row = lambda p, o, t: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(t).alias("o_type"))
    cells = [row(RDF_TYPE, F.lit(f"{BASE}ontology/{kind}"), "iri"), row(RDFS_LABEL, F.coalesce(F.col(label).cast("string"), F.col(key).cast("string")) if label else F.col(key), "string")]
    for c in properties or []:
        shown = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") if kinds[c] == "timestamp" else F.col(c)
        cells.append(row(f"{BASE}ontology/{c}", shown, DATATYPES.get(kinds[c], "string")))
    cells += [row(f"{BASE}ontology/{p}", iri(target, c), "iri") for p, (target, c) in (edges or {}).items()]
    out = df.select(iri(kind, key).alias("s"), F.inline(F.array(*cells)))
    return out.where("s is not null and trim(o) <> ''").distinct()


def ratings_triples(ratings: DataFrame) -> DataFrame:
    """Triples of rating records with their team and period; the canonical table of ratings has the columns."""
    return triples(ratings, "EloRecord", "id_eloRecord", None, ["elo", "rank", "level", "dateFrom", "dateTo"], {"correspondsToTeam": ("Team", "id_team")})


def merged(parts: list[DataFrame], distinct: bool = True) -> DataFrame:
    """The union of triple tables; as a set, or as the bag that concatenated files are."""
    whole = reduce(DataFrame.unionByName, parts)
    return whole.distinct() if distinct else whole


def ntriples(graph: DataFrame) -> DataFrame:
    """(value) lines of N-Triples, which are valid Turtle."""
    text = F.col("o")
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    literal = F.concat(F.lit('"'), text, F.lit('"^^<'), F.lit(XSD), F.col("o_type"), F.lit(">"))
    target = F.when(F.col("o_type") == "iri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(literal)
    return graph.select(F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), target, F.lit(" .")).alias("value"))


def parse_ntriples(lines: DataFrame) -> DataFrame:
    """(s, p, o, o_type, bad) of N-Triples lines; blank lines and comments are skipped, ``bad`` marks the rest."""
    rows = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    pattern = r'^\s*<([^<>"\s]+)>\s+<([^<>"\s]+)>\s+(?:<([^<>"\s]+)>|"((?:[^"\\]|\\.)*+)"(?:\^\^<([^<>\s]+)>)?)\s*\.\s*$'
    part = lambda i: F.regexp_extract("value", pattern, i)
    plain = part(4)
    for escaped, sign in (("\\\\", "\x01"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x01", "\\")):
        plain = F.replace(plain, F.lit(escaped), F.lit(sign))
    is_iri = part(3) != ""
    kind = F.when(is_iri, "iri").when(part(5) != "", F.regexp_replace(part(5), "^.*#", "")).otherwise("string")
    return rows.select(part(1).alias("s"), part(2).alias("p"), F.when(is_iri, part(3)).otherwise(plain).alias("o"), kind.alias("o_type"), (part(1) == "").alias("bad"))


def require_references(children: DataFrame, key: str, parents: DataFrame, target: str) -> DataFrame:
    """``children``, or ValueError with examples if a non-NULL reference is missing from ``parents``."""
    lost = children.where(F.col(key).isNotNull()).join(parents.select(F.col(target).alias(key)), key, "left_anti").select(key)
    examples = [r[0] for r in lost.limit(5).collect()]
    if examples:
        raise ValueError(f"{key} without a record, for example {examples}")
    return children
