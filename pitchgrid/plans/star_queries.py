"""Operators restated on the star-schema tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.functions.text import label_contains, ratio, without_accents
from pitchgrid.operators.components import components
from pitchgrid.operators.dedup import first_non_empty, keep_first, keep_last, keep_unique, mode_of, single_valued
from pitchgrid.operators.graph import local_name, triples
from pitchgrid.operators.lookup import fallback_lookup, gaps, in_scope
from pitchgrid.operators.quality import check, closed_reference, missing, outside, unique_key
from pitchgrid.operators.temporal import asof, asof_interval, latest_per, nearest
from pitchgrid.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_LINE = ["l_orderkey", "l_linenumber"]
_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def query(sql: str = ""):
    """Register a query under its name, with its SQL where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""SELECT c_name, n_name, round(sum(l_quantity), 4) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY c_custkey, c_name, n_name HAVING sum(l_quantity) > 0
ORDER BY total DESC, c_name, n_name LIMIT 20""")
def top_scorers(spark: SparkSession, d: str) -> DataFrame:
    # the fact is summed per order before the joins, so a row per order is shuffled, not one per line
    per_order = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    per_customer = per_order.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.round(F.sum("q"), 4).alias("total"))
    named = per_customer.where("total > 0").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("c_name", "n_name", "total").orderBy(F.desc("total"), "c_name", "n_name").limit(20)


@query("""SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) r FROM orders) WHERE r = 1""")
def latest_per_entity(spark: SparkSession, d: str) -> DataFrame:
    return latest_per(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("""SELECT p.event_id, p.user_id, s.value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def asof_value(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), "value")
    return asof(left, right, ["user_id"], "ts", "since", ["value"]).select("event_id", "user_id", "value")


_PERIODS = """SELECT o_custkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS s, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL 400 DAY END AS u, o_orderkey AS v FROM orders"""


@query(f"""WITH p AS ({_PERIODS}), x AS (SELECT c_custkey, p.v, coalesce(p.s, p.u) AS f FROM customer c JOIN p ON p.k = c.c_custkey
WHERE (s IS NOT NULL AND s <= TIMESTAMP '1998-01-01' AND (u IS NULL OR u >= TIMESTAMP '1998-01-01')) OR (s IS NULL AND u <= TIMESTAMP '1998-01-01'))
SELECT c.c_custkey, y.v AS in_force FROM customer c LEFT JOIN (SELECT c_custkey, v FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY f DESC, v DESC) r FROM x) WHERE r = 1) y USING (c_custkey)""")
def asof_open_interval(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    periods = o.select(
        F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("s"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("u"), F.col("o_orderkey").alias("in_force"),
    )
    left = table(spark, d, "customer").select("c_custkey", F.lit("1998-01-01").cast("timestamp").alias("at"))
    return asof_interval(left, periods, ["c_custkey"], "at", "s", "u", ["in_force"], "c_custkey").select("c_custkey", "in_force")


@query("""WITH v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), p AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT event_id, user_id, near_id FROM (SELECT p.event_id, p.user_id, v.event_id AS near_id,
row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(v.ts) - epoch_us(p.ts)) NULLS LAST, v.ts) AS r FROM p LEFT JOIN v ON v.user_id = p.user_id) WHERE r = 1""")
def nearest_event(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("near_id"))
    return nearest(left, right, ["user_id"], "ts", "seen", ["near_id"]).select("event_id", "user_id", "near_id")


_LATEST = ", ".join(f"{c} DESC" for c in _ORDER)


@query(f"SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LATEST}) r FROM lineitem) WHERE r = 1")
def dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return keep_last(table(spark, d, "lineitem"), _LINE, _ORDER)


@query(f"SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_ORDER)}) r FROM lineitem) WHERE r = 1")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return keep_first(table(spark, d, "lineitem"), _LINE, _ORDER)


@query("SELECT * EXCLUDE n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) n FROM lineitem) WHERE n = 1")
def dedup_keep_unique(spark: SparkSession, d: str) -> DataFrame:
    return keep_unique(table(spark, d, "lineitem"), _LINE)


@query("""SELECT r_name, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def group_concat_distinct(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ", ").alias("segments"))


@query("""SELECT DISTINCT regexp_replace(s, '^.*/', '') AS s, p, o, o_type FROM (
SELECT 'x/' || p_partkey AS s, 'type' AS p, 'Part' AS o, 'iri' AS o_type FROM part UNION ALL SELECT 'x/' || p_partkey, 'label', p_name, 'string' FROM part
UNION ALL SELECT 'x/' || p_partkey, 'p_brand', p_brand, 'string' FROM part UNION ALL SELECT 'x/' || p_partkey, 'p_size', p_size::text, 'integer' FROM part)""")
def property_triples(spark: SparkSession, d: str) -> DataFrame:
    graph = triples(table(spark, d, "part"), "Part", "p_partkey", "p_name", ["p_brand", "p_size"])
    short = F.regexp_replace(local_name("p"), "^.*#", "")
    return graph.select(local_name("s").alias("s"), short.alias("p"), F.when(F.col("o_type") == "iri", local_name("o")).otherwise(F.col("o")).alias("o"), "o_type")


@query("""SELECT DISTINCT 'customer' AS kind, c_name AS label FROM customer WHERE contains(lower(c_name), '01') UNION SELECT DISTINCT 'supplier', s_name FROM supplier WHERE contains(lower(s_name), '01')""")
def tagged_union_search(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("label"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("label"))
    return c.unionByName(s).where(F.contains(F.lower("label"), F.lit("01"))).distinct()


@query("""SELECT c_custkey, coalesce(e.s_acctbal, f.s_acctbal) AS balance, CASE WHEN e.s_acctbal IS NOT NULL THEN 'exact' WHEN f.s_acctbal IS NOT NULL THEN 'fallback' END AS found_by
FROM customer LEFT JOIN supplier e ON e.s_suppkey = c_custkey AND e.s_nationkey = c_nationkey LEFT JOIN supplier f ON f.s_suppkey = c_custkey""")
def fallback_lookup_balance(spark: SparkSession, d: str) -> DataFrame:
    """The supplier of a customer's number: in the customer's nation, else anywhere."""
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    asked = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return fallback_lookup(asked, known, ["c_custkey", "nation"], ["c_custkey"], ["balance"], ["balance"]).select("c_custkey", "balance", "found_by")


@query("""WITH per AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT a.l_suppkey, round(sum(a.q), 4) AS own, round(sum(b.q), 4) AS other, count(*) AS meetings FROM per a JOIN per b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY a.l_suppkey""")
def opponent_stats(spark: SparkSession, d: str) -> DataFrame:
    # own and opposing sums without pairing rows: an order's total less the supplier's own part
    per = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    whole = per.groupBy("l_orderkey").agg(F.sum("q").alias("all"), F.count("*").alias("n"))
    met = per.join(whole, "l_orderkey").where("n > 1")
    return met.groupBy("l_suppkey").agg(F.round(F.sum(F.col("q") * (F.col("n") - 1)), 4).alias("own"), F.round(F.sum(F.col("all") - F.col("q")), 4).alias("other"), F.sum(F.col("n") - 1).alias("meetings"))


@query("""SELECT event_type, sum(json_extract_string(props, '$.k')::bigint) AS total FROM events GROUP BY event_type""")
def json_property_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("total"))


@query("""SELECT * FROM (SELECT count(DISTINCT o_orderkey) AS orders, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0) AS finished FROM orders),
(SELECT count(DISTINCT c_custkey) AS customers FROM customer), (SELECT round(sum(l_quantity), 4) AS quantity, count(DISTINCT l_partkey) AS parts FROM lineitem)""")
def kpi_dashboard(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").agg(F.countDistinct("o_orderkey").alias("orders"), F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)), F.lit(0)).alias("finished"))
    customers = table(spark, d, "customer").agg(F.countDistinct("c_custkey").alias("customers"))
    lines = table(spark, d, "lineitem").agg(F.round(F.sum("l_quantity"), 4).alias("quantity"), F.countDistinct("l_partkey").alias("parts"))
    return orders.join(F.broadcast(customers)).join(F.broadcast(lines))  # three rows of one row each


@query("""SELECT user_id, CASE WHEN v > 0 THEN round(c::double / v, 6) END AS per_view, CASE WHEN p > 0 THEN round(100.0::double * c / p, 6) END AS per_purchase FROM (
SELECT user_id, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY user_id)""")
def safe_ratio(spark: SparkSession, d: str) -> DataFrame:
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    per = table(spark, d, "events").groupBy("user_id").agg(n("click").alias("c"), n("view").alias("v"), n("purchase").alias("p"))
    return per.select("user_id", F.round(ratio(F.col("c"), F.col("v")), 6).alias("per_view"), F.round(ratio(F.col("c"), F.col("p"), 100.0), 6).alias("per_purchase"))


@query("""WITH t AS (SELECT r_name, s_name, round(sum(l_extendedprice), 2) AS points FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, s_suppkey, s_name)
SELECT r_name, s_name, points, row_number() OVER (PARTITION BY r_name ORDER BY points DESC, s_name) AS place FROM t""")
def standings_by_region(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    per = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("points"))
    named = per.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    named = named.join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select("r_name", "s_name", "points", F.row_number().over(Window.partitionBy("r_name").orderBy(F.desc("points"), "s_name")).alias("place"))


@query("""SELECT o_orderkey AS id, 'home' AS side, o_custkey AS key FROM orders UNION ALL SELECT o_orderkey, 'away', o_orderkey FROM orders""")
def home_away_unpivot(spark: SparkSession, d: str) -> DataFrame:
    sides = F.array(F.struct(F.lit("home").alias("side"), F.col("o_custkey").alias("key")), F.struct(F.lit("away").alias("side"), F.col("o_orderkey").alias("key")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.inline(sides))


@query("""SELECT user_id, arg_min(event_type, event_id) FILTER (event_type <> 'error') AS event_type, arg_min(value, event_id) AS value FROM events GROUP BY user_id""")
def first_non_empty_value(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("event_type", F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")))
    return first_non_empty(e, ["user_id"], ["event_type", "value"], "event_id")


@query("""SELECT p_type, mode, rows FROM (SELECT p_type, p_brand AS mode, count(*) AS rows, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, lower(p_brand)) AS r FROM part GROUP BY p_type, p_brand) WHERE r = 1""")
def mode_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    return mode_of(table(spark, d, "part"), ["p_type"], "p_brand")


@query("""SELECT l_suppkey, l_partkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN max(l_returnflag) END AS hint FROM lineitem GROUP BY l_suppkey, l_partkey""")
def single_valued_hint(spark: SparkSession, d: str) -> DataFrame:
    return single_valued(table(spark, d, "lineitem"), ["l_suppkey", "l_partkey"], "l_returnflag")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join_gap(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return gaps(table(spark, d, "customer").select("c_custkey", "c_name"), done, ["c_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 3))")
def semi_join_scope(spark: SparkSession, d: str) -> DataFrame:
    scope = table(spark, d, "customer").where("c_nationkey in (1, 3)").select(F.col("c_custkey").alias("o_custkey"))
    return in_scope(table(spark, d, "orders").select("o_orderkey", "o_custkey"), scope, ["o_custkey"])


@query("""SELECT user_id, class, count(*) AS n FROM (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'starter' WHEN event_type IN ('view', 'click') AND value > 10 THEN 'substitute' WHEN event_type = 'error' THEN 'unavailable' ELSE 'unused' END AS class FROM events) GROUP BY ALL""")
def classify_status(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "starter").when(F.col("event_type").isin("view", "click") & (F.col("value") > 10), "substitute").when(F.col("event_type") == "error", "unavailable").otherwise("unused")
    return table(spark, d, "events").groupBy("user_id", kind.alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT * FROM (SELECT n_name AS a_name, round(sum(o_totalprice), 2) AS a_total, count(*) AS a_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = 1 GROUP BY n_name),
(SELECT n_name AS b_name, round(sum(o_totalprice), 2) AS b_total, count(*) AS b_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = 2 GROUP BY n_name)""")
def compare_two(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer").where("c_nationkey in (1, 2)"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    side = lambda k, f: f(F.when(F.col("n_nationkey") == k, F.col("o_totalprice")))
    name = lambda k: F.max(F.when(F.col("n_nationkey") == k, F.col("n_name")))
    return o.agg(name(1).alias("a_name"), F.round(side(1, F.sum), 2).alias("a_total"), side(1, F.count).alias("a_orders"), name(2).alias("b_name"), F.round(side(2, F.sum), 2).alias("b_total"), side(2, F.count).alias("b_orders"))


@query("""SELECT o_custkey, min(o_totalprice) AS low, max(o_totalprice) AS high, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS low_at, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS high_at FROM orders GROUP BY o_custkey HAVING count(*) >= 2""")
def series_extremes(spark: SparkSession, d: str) -> DataFrame:
    by = F.struct("o_totalprice", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.min_by("o_orderkey", by).alias("low_at"), F.max_by("o_orderkey", by).alias("high_at"), F.count("*").alias("n")).where("n >= 2").drop("n")


@query("""SELECT o_orderstatus, count(*) AS n, round(100.0::double * count(*) / (SELECT count(*) FROM orders), 4) AS percent FROM orders GROUP BY o_orderstatus""")
def result_distribution(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("o_orderstatus", "n", F.round(ratio(F.col("n"), F.col("total"), 100.0), 4).alias("percent"))


@query("""SELECT n_name, round(avg(coalesce(b, 0)), 6) AS mean FROM nation LEFT JOIN (SELECT c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS b FROM customer) ON c_nationkey = n_nationkey GROUP BY n_name""")
def zero_imputed_avg(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("b"))
    return table(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.round(F.avg(F.coalesce("b", F.lit(0.0))), 6).alias("mean"))


@query("""SELECT 'lineitem' AS tab, 'unique:l_orderkey,l_linenumber' AS rule, 'error' AS severity, count(*) AS failures FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'events', 'reference:user_id', 'error', count(*) FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'lineitem', 'range:l_quantity', 'warning', count(*) FROM lineitem WHERE l_quantity > 45 OR l_quantity < 2
UNION ALL SELECT 'lineitem', 'missing:l_returnflag', 'error', 0""")
def integrity_checks(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    rules = check(lines, "lineitem", [outside("l_quantity", 2, 45, severity="warning"), missing("l_returnflag")])
    return unique_key(lines, "lineitem", _LINE).unionByName(closed_reference(table(spark, d, "events"), "events", "user_id", table(spark, d, "supplier"), "s_suppkey")).unionByName(rules)


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(replace(replace(p_name, '_', ' '), '-', ' ')), 'blue b')")
def label_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name").where(label_contains(F.col("p_name"), "Blue_B"))


@query("SELECT DISTINCT id_team, replace(lower(strip_accents(name)), ' ', '_') AS slug FROM teams")
def slug_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "teams").select("id_team", F.replace(F.lower(without_accents(F.col("name"))), F.lit(" "), F.lit("_")).alias("slug")).distinct()


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey),
r AS (SELECT a AS vertex, a AS seen FROM e UNION SELECT r.vertex, e.b FROM r JOIN e ON r.seen = e.a) SELECT vertex, min(seen) AS component FROM r GROUP BY vertex""")
def components_of_suppliers(spark: SparkSession, d: str) -> DataFrame:
    full = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    low = full.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("b"))
    return components(full.join(low, "l_orderkey").select(F.col("l_suppkey").alias("a"), "b"))


@query("""SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def daily_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
