"""Registered joins in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as T
from . import corpus as V
from .queries_merge import _HISTORY, _history


def event_version_asof(spark, d):
    """The version of its user's leaf that was in force before each event."""
    versions = _history(spark, d).filter("outcome <> 'skipped'")
    events = V.table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("key"), "ts", "event_type")
    found = T.asof_join(events, versions, ["key"], "ts", "ts", {"version": "version", "body": "body", "ts": "since"}, ties=["version"], strict=True)
    return found.select("event_id", "key", "version", "body", "since")


def lineitem_order_asof(spark, d):
    """The latest order of the supplier's nation, at or before each lineitem was shipped."""
    nations = V.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    items = V.table(spark, d, "lineitem").join(nations, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "nation", "l_shipdate")
    customers = V.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    orders = V.table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("nation", "o_orderdate", "o_orderkey")
    found = T.asof_join(items, orders, ["nation"], "l_shipdate", "o_orderdate", {"o_orderkey": "order", "o_orderdate": "ordered"}, ties=["o_orderkey"])
    return found.groupBy("l_orderkey", "l_linenumber", "nation", "order", "ordered").agg(F.count(F.lit(1)).alias("n"))


def _order_spans(spark, d):
    """An order, once, from its date to its last shipment; one without date or lineitems, or shipped before, has none."""
    last = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("until"))
    orders = V.table(spark, d, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey")).filter("o_orderdate < until")
    return orders.select("o_orderkey", "o_custkey", "o_orderdate", "until").distinct()


def order_overlaps(spark, d):
    """Orders of one customer that were open at the same time."""
    spans = _order_spans(spark, d)
    pairs = T.overlap_join(spans, spans, ["o_custkey"], ("o_orderdate", "until"), ("o_orderdate", "until"))
    return pairs.filter("l.o_orderkey < r.o_orderkey").select(F.col("l.o_custkey").alias("customer"), F.col("l.o_orderkey").alias("a"), F.col("r.o_orderkey").alias("b"))


def shipments_in_force(spark, d):
    """Orders of a customer that were open on the days after each shipment to them, ten days a shipment."""
    owner = V.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    items = V.table(spark, d, "lineitem").filter("l_shipdate IS NOT NULL").join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "l_shipdate", F.expr("l_shipdate + INTERVAL 10 DAYS").alias("until"))
    pairs = T.overlap_join(items, _order_spans(spark, d), ["o_custkey"], ("l_shipdate", "until"), ("o_orderdate", "until"))
    return pairs.groupBy(F.col("l.l_orderkey").alias("l_orderkey"), F.col("l.l_linenumber").alias("l_linenumber")).agg(F.count(F.lit(1)).alias("n_open"), F.min("r.o_orderkey").alias("first_open"))


_SPANS = "spans AS (SELECT o_orderkey, o_custkey, o_orderdate, max(l_shipdate) AS until FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate HAVING max(l_shipdate) > o_orderdate)"

REGISTERED = [
    (
        "event_version_asof",
        event_version_asof,
        f"""WITH {_HISTORY}, versions AS (SELECT key, ts, max(version) AS version, arg_max(body, version) AS body FROM history WHERE outcome <> 'skipped' GROUP BY key, ts)
SELECT e.event_id, e.user_id::VARCHAR AS key, v.version, v.body, v.ts AS since FROM events e ASOF LEFT JOIN versions v ON e.user_id::VARCHAR = v.key AND e.ts > v.ts""",
    ),
    (
        "lineitem_order_asof",
        lineitem_order_asof,
        """WITH items AS (SELECT l_orderkey, l_linenumber, s_nationkey AS nation, l_shipdate FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
o AS (SELECT c_nationkey AS nation, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderdate)
SELECT l_orderkey, l_linenumber, i.nation, o.o_orderkey AS "order", o.o_orderdate AS ordered, count(*) AS n FROM items i ASOF LEFT JOIN o ON i.nation = o.nation AND i.l_shipdate >= o.o_orderdate GROUP BY ALL""",
    ),
    ("order_overlaps", order_overlaps, f"WITH {_SPANS} SELECT a.o_custkey AS customer, a.o_orderkey AS a, b.o_orderkey AS b FROM spans a JOIN spans b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderdate < b.until AND b.o_orderdate < a.until"),
    (
        "shipments_in_force",
        shipments_in_force,
        f"""WITH {_SPANS} SELECT l_orderkey, l_linenumber, count(*) AS n_open, min(s.o_orderkey) AS first_open
FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey JOIN spans s ON s.o_custkey = o.o_custkey AND l_shipdate < s.until AND s.o_orderdate < l_shipdate + INTERVAL 10 DAY GROUP BY l_orderkey, l_linenumber""",
    ),
]
