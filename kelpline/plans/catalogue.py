"""The operators applied to the star-schema tables, each with the SQL that gives the same rows.

``orders`` stand for purchases (status F approved, O begun, P cancelled), ``lineitem`` for item versions (order and line number are
a key with several versions, ordered by shipping date), ``events`` for a change log by user and day, and customer, nation and region
for the subsidiary.  Money is summed in cents, so that sums don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import bitemporal, cdc, impact, metrics, quality, rankings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cents(column: str) -> F.Column:
    return F.round(F.col(column) * 100).cast("bigint")


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'APROVADA' WHEN 'O' THEN 'INICIADA' ELSE 'CANCELADA' END"
CENTS = "CAST(ROUND({} * 100) AS BIGINT)"


def purchases(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as purchases of one supplier's product."""
    orders = _read(spark, d, "orders").select("o_orderkey", F.expr(STATUS).alias("purchase_status"), F.to_date("o_orderdate").alias("release_date"))
    lines = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", cents("l_extendedprice").alias("purchase_total_value"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(F.col("l_orderkey").alias("purchase_id"), F.col("l_linenumber").cast("bigint").alias("purchase_partition"), F.col("l_suppkey").alias("producer_id"), F.col("l_partkey").alias("prod_item_id"), F.lit(1).cast("bigint").alias("prod_item_partition"), "purchase_total_value", "purchase_status", "release_date")


P_SQL = f"""SELECT l_orderkey AS purchase_id, CAST(l_linenumber AS BIGINT) AS purchase_partition, l_suppkey AS producer_id, l_partkey AS prod_item_id,
 1 AS prod_item_partition, {CENTS.format('l_extendedprice')} AS purchase_total_value, {STATUS} AS purchase_status, CAST(o_orderdate AS DATE) AS release_date
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query(f"""WITH p AS (SELECT DISTINCT * FROM ({P_SQL}))
SELECT producer_id, CAST(SUM(purchase_total_value) AS DOUBLE) AS revenue_1996 FROM p
WHERE purchase_status = 'APROVADA' AND release_date >= DATE '1996-01-01' AND release_date < DATE '1997-01-01'
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def top50_producers_year(spark, d):
    return rankings.top_producers(purchases(spark, d), 1996)


@query(f"""WITH p AS (SELECT DISTINCT purchase_id, purchase_partition, producer_id, prod_item_id, prod_item_partition FROM ({P_SQL}) WHERE purchase_status = 'APROVADA'),
s AS (SELECT producer_id, p_partkey AS product_id, SUM({CENTS.format('p_retailprice')}) AS product_revenue FROM p JOIN part ON prod_item_id = p_partkey GROUP BY 1, 2)
SELECT producer_id, product_id, CAST(product_revenue AS DOUBLE) AS product_revenue, product_rank FROM
(SELECT *, ROW_NUMBER() OVER (PARTITION BY producer_id ORDER BY product_revenue DESC, product_id) AS product_rank FROM s) WHERE product_rank <= 2""")
def top2_products_per_producer(spark, d):
    items = _read(spark, d, "part").select(F.col("p_partkey").alias("prod_item_id"), F.lit(1).cast("bigint").alias("prod_item_partition"), F.col("p_partkey").alias("product_id"), cents("p_retailprice").alias("purchase_value"))
    return rankings.top_products(purchases(spark, d), items).withColumn("product_rank", F.col("product_rank").cast("bigint"))


LINE_KEYS = ("l_orderkey", "l_linenumber")


def line_events(spark: SparkSession, d: str) -> DataFrame:
    """Lines as resends: one hash per key, part and quantity; observed in shipping order."""
    return _read(spark, d, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        "l_partkey",
        "l_suppkey",
        F.to_date("l_shipdate").alias("ship"),
        F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), 256).alias("record_hash"),
    )


L_SQL = """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS ship,
 sha256(concat_ws('|', l_orderkey, l_linenumber, l_returnflag, l_linestatus)) AS record_hash FROM lineitem"""


@query(f"""SELECT l_orderkey, l_linenumber, record_hash, COUNT(*) AS resend_duplicate_count, MIN(ship) AS first_ship FROM ({L_SQL}) GROUP BY 1, 2, 3""")
def resend_dedup(spark, d):
    kept = cdc.collapse_resends(line_events(spark, d), LINE_KEYS, first=("ship is null", "ship", "l_partkey", "l_suppkey"))
    return kept.select(*LINE_KEYS, "record_hash", "resend_duplicate_count", F.col("ship").alias("first_ship"))


@query(f"""WITH e AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, ship FROM ({L_SQL}))
SELECT *, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS event_count_for_key,
ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY ship NULLS FIRST, l_partkey, l_suppkey) AS event_version_number,
ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY ship DESC NULLS LAST, l_partkey DESC, l_suppkey DESC) AS event_latest_rank FROM e""")
def version_ordering(spark, d):
    return cdc.number_versions(line_events(spark, d).drop("record_hash").distinct(), LINE_KEYS, ("ship", "l_partkey", "l_suppkey"))


@query(f"""SELECT l_orderkey, l_linenumber, ship, l_partkey, l_suppkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY ship DESC NULLS LAST, l_partkey DESC, l_suppkey DESC) AS r
 FROM ({L_SQL})) WHERE r = 1""")
def latest_version(spark, d):
    return version_ordering(spark, d).where("event_latest_rank = 1").select(*LINE_KEYS, "ship", "l_partkey", "l_suppkey")


@query("""SELECT c_custkey, UPPER(NULLIF(TRIM(c_mktsegment), '')) AS segment, LOWER(NULLIF(TRIM(c_name), '')) AS name FROM customer""")
def string_normalize(spark, d):
    return _read(spark, d, "customer").select("c_custkey", X.clean_text("c_mktsegment", "upper").alias("segment"), X.clean_text("c_name", "lower").alias("name"))


FLAG_SQL = """SELECT o_orderkey, o_orderstatus, o_totalprice, concat_ws(',', CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'invalid_status' END,
 CASE WHEN o_totalprice < 50000 THEN 'low_value' END, CASE WHEN o_custkey IS NULL THEN 'missing_customer' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END) AS quality_flags FROM orders"""


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    conditions = {"invalid_status": ~F.col("o_orderstatus").isin("F", "O"), "low_value": F.col("o_totalprice") < 50000, "urgent": F.col("o_orderpriority") == "1-URGENT", "missing_customer": F.col("o_custkey").isNull()}
    return _read(spark, d, "orders").withColumn("flags", X.flags(conditions))


@query(f"SELECT o_orderkey, quality_flags FROM ({FLAG_SQL})")
def enum_and_flag_array(spark, d):
    return _flagged(spark, d).select("o_orderkey", F.array_join("flags", ",").alias("quality_flags"))


@query(f"""SELECT CASE WHEN o_totalprice < 20000 THEN 'error' WHEN quality_flags <> '' THEN 'warning' ELSE 'valid' END AS quality_status, COUNT(*) AS orders FROM ({FLAG_SQL}) GROUP BY 1""")
def quality_status_rollup(spark, d):
    return _flagged(spark, d).groupBy(X.status(F.col("o_totalprice") < 20000, F.size("flags") > 0).alias("quality_status")).agg(F.count("*").alias("orders"))


@query("""SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_concat(
 CASE WHEN o_totalprice < 50000 THEN ['order:low_value'] ELSE [] END, CASE WHEN o_orderpriority = '1-URGENT' THEN ['order:urgent'] ELSE [] END,
 CASE WHEN c_acctbal < 0 THEN ['customer:negative_balance'] ELSE [] END, ['checked']))), ',') AS quality_flags FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def flag_prefix_merge(spark, d):
    customers = _read(spark, d, "customer").select("c_custkey", X.flags({"negative_balance": F.col("c_acctbal") < 0}).alias("theirs"))
    orders = _read(spark, d, "orders").select("o_orderkey", "o_custkey", X.flags({"low_value": F.col("o_totalprice") < 50000, "urgent": F.col("o_orderpriority") == "1-URGENT"}).alias("own"))
    both = orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
    return both.select("o_orderkey", F.array_join(X.inherit(F.array(F.lit("checked")), {"order": F.col("own"), "customer": F.col("theirs")}), ",").alias("quality_flags"))


@query("""SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has_line, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) AS has_customer FROM orders""")
def reference_exists_flags(spark, d):
    orders = _read(spark, d, "orders").select("o_orderkey", "o_custkey")
    flagged = cdc.with_exists_flag(orders, _read(spark, d, "lineitem"), ["o_orderkey"], ["l_orderkey"], "has_line")
    return cdc.with_exists_flag(flagged, _read(spark, d, "customer"), ["o_custkey"], ["c_custkey"], "has_customer").drop("o_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_rows(spark, d):
    orders = _read(spark, d, "orders").select("o_orderkey")
    return cdc.with_exists_flag(orders, _read(spark, d, "lineitem"), ["o_orderkey"], ["l_orderkey"], "has_line").where("not has_line").drop("has_line")


E_SQL = "SELECT event_id, user_id, event_type, CAST(ROUND(value * 100) AS BIGINT) AS cents, CAST(ts AS DATE) AS day, ts FROM events"


def change_log(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").select("event_id", "user_id", "event_type", cents("value").alias("cents"), F.to_date("ts").alias("day"), "ts")


@query(f"""WITH b AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM (SELECT day AS x FROM ({E_SQL}) UNION ALL SELECT day + 2 FROM ({E_SQL}) WHERE event_type = 'purchase'))
SELECT CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS snapshot_date FROM b""")
def snapshot_calendar(spark, d):
    log = change_log(spark, d)
    later = log.where("event_type = 'purchase'").select(F.date_add("day", 2).alias("day"))
    return bitemporal.calendar([log.select("day"), later], "day")


@query(f"""WITH f AS (SELECT user_id, MIN(day) AS lo FROM ({E_SQL}) GROUP BY 1), h AS (SELECT MAX(day) AS hi FROM ({E_SQL}))
SELECT user_id, CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS snapshot_date FROM f, h WHERE lo <= hi""")
def entity_day_base(spark, d):
    log = change_log(spark, d)
    return bitemporal.entity_days(log, ["user_id"], bitemporal.last_date([log], "day"), "day")


DAYS_SQL = f"""f AS (SELECT user_id, MIN(day) AS lo FROM ({E_SQL}) GROUP BY 1), h AS (SELECT MAX(day) AS hi FROM ({E_SQL})),
b AS (SELECT user_id, CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS snapshot_date FROM f, h)"""


def _states(log: DataFrame) -> DataFrame:
    return bitemporal.validity(log, ["user_id"], ["event_type", "cents"], order=("ts", "event_id"), date_col="day")


@query(f"""WITH {DAYS_SQL}
SELECT user_id, snapshot_date, event_id, event_type, cents FROM (SELECT b.user_id, snapshot_date, event_id, event_type, cents,
ROW_NUMBER() OVER (PARTITION BY b.user_id, snapshot_date ORDER BY ts DESC, event_id DESC) AS r FROM b JOIN ({E_SQL}) e ON e.user_id = b.user_id AND e.day <= b.snapshot_date) WHERE r = 1""")
def asof_state_events(spark, d):
    state = bitemporal.as_of(entity_day_base(spark, d), _states(change_log(spark, d)), {"user_id": "user_id"}, "snapshot_date", "state")
    return state.select("user_id", "snapshot_date", "state.event_id", "state.event_type", "state.cents")


@query(f"""WITH {DAYS_SQL}, e AS ({E_SQL}),
c AS (SELECT user_id, snapshot_date, cents % 50 AS partner FROM (SELECT b.user_id, snapshot_date, cents, ROW_NUMBER() OVER (PARTITION BY b.user_id, snapshot_date ORDER BY ts DESC, event_id DESC) AS r
 FROM b JOIN e ON e.user_id = b.user_id AND e.day <= snapshot_date) WHERE r = 1)
SELECT user_id, snapshot_date, partner, partner_event FROM (SELECT c.user_id, c.snapshot_date, partner, e.event_id AS partner_event,
 ROW_NUMBER() OVER (PARTITION BY c.user_id, c.snapshot_date ORDER BY e.ts DESC NULLS LAST, e.event_id DESC NULLS LAST) AS r FROM c LEFT JOIN e ON e.user_id = partner AND e.day <= c.snapshot_date) WHERE r = 1""")
def asof_chained_two_sources(spark, d):
    """The second source's key comes from the state that the first has that day."""
    states = _states(change_log(spark, d))
    first = bitemporal.as_of(entity_day_base(spark, d), states, {"user_id": "user_id"}, "snapshot_date", "own").withColumn("partner", F.col("own.cents") % 50)
    both = bitemporal.as_of(first, states, {"partner": "user_id"}, "snapshot_date", "theirs")
    return both.select("user_id", "snapshot_date", "partner", F.col("theirs.event_id").alias("partner_event"))


SNAP_SQL = f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS gmv_date, r_name AS subsidiary, {STATUS} AS purchase_status, {CENTS.format('o_totalprice')} AS cents,
 (SELECT COUNT(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
OK_SQL = "lines > 0 AND subsidiary IS NOT NULL AND purchase_status = 'APROVADA' AND gmv_date IS NOT NULL AND cents >= 0"


def order_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Orders in the columns of a snapshot; the region's name is the subsidiary, the number of lines the item quantity."""
    places = _read(spark, d, "nation").join(_read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = _read(spark, d, "customer").select("c_custkey", "c_nationkey").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "r_name")
    lines = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    orders = _read(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("gmv_date"), F.expr(STATUS).alias("purchase_status"), cents("o_totalprice").alias("purchase_total_value"))
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").join(customers, orders.o_custkey == customers.c_custkey, "left")
    wide = joined.select(
        F.last_day("gmv_date").alias("snapshot_date"),
        F.lit(None).cast("timestamp").alias("snapshot_created_at"),
        F.col("o_orderkey").alias("purchase_id"),
        F.lit(1).cast("bigint").alias("purchase_partition"),
        "gmv_date",
        F.col("gmv_date").alias("release_date"),
        "purchase_status",
        "purchase_total_value",
        F.col("r_name").alias("subsidiary"),
        F.col("lines").alias("item_quantity"),
        F.lit(True).alias("has_purchase"),
        F.col("lines").isNotNull().alias("has_product_item"),
        F.col("r_name").isNotNull().alias("has_extra_info"),
        *(F.lit(X.VALID).alias(f"{s}_quality_status") for s in ("purchase", "product_item", "purchase_extra_info")),
    )
    flagged = F.when(F.col("purchase_total_value") < 5_000_000, X.WARNING).otherwise(X.VALID)
    return wide.withColumns({"is_metric_eligible": F.expr(bitemporal.ELIGIBLE), "quality_status": flagged})


@query(f"SELECT o_orderkey AS purchase_id, COALESCE({OK_SQL}, FALSE) AS is_metric_eligible FROM ({SNAP_SQL})")
def metric_eligibility(spark, d):
    return order_snapshot(spark, d).select("purchase_id", "is_metric_eligible")


DAILY_SQL = f"""SELECT last_day(gmv_date) AS snapshot_date, gmv_date, subsidiary, CAST(SUM(cents) AS DOUBLE) AS gmv_daily_amount, COUNT(DISTINCT o_orderkey) AS gmv_daily_purchase_count,
 CAST(SUM(lines) AS BIGINT) AS gmv_daily_item_quantity, CASE WHEN bool_or(cents < 5000000) THEN 'warning' ELSE 'valid' END AS quality_status FROM ({SNAP_SQL}) WHERE {OK_SQL} GROUP BY 1, 2, 3"""
MTD_SQL = f"""SELECT *, SUM(gmv_daily_amount) OVER (PARTITION BY snapshot_date, subsidiary, date_trunc('month', gmv_date) ORDER BY gmv_date ROWS UNBOUNDED PRECEDING) AS gmv_mtd_amount FROM ({DAILY_SQL})"""


@query(DAILY_SQL)
def gmv_daily_by_region(spark, d):
    return metrics.gmv_daily(order_snapshot(spark, d)).drop("gmv_mtd_amount", "snapshot_created_at")


@query(MTD_SQL)
def gmv_mtd_running(spark, d):
    return metrics.gmv_daily(order_snapshot(spark, d)).drop("snapshot_created_at")


@query(f"SELECT * FROM ({DAILY_SQL}) WHERE snapshot_date = (SELECT MAX(snapshot_date) FROM ({DAILY_SQL}))")
def current_snapshot_scalar_subquery(spark, d):
    return spark.sql("SELECT * FROM {gmv} WHERE snapshot_date = (SELECT MAX(snapshot_date) FROM {gmv})", gmv=gmv_daily_by_region(spark, d))


@query(f"WITH g AS ({DAILY_SQL}), m AS (SELECT MAX(snapshot_date) AS newest FROM g) SELECT g.* FROM g CROSS JOIN m WHERE g.snapshot_date = m.newest")
def current_snapshot_cross_join(spark, d):
    """The newest day as one row, joined (the planner broadcasts it)."""
    gmv = gmv_daily_by_region(spark, d)
    newest = gmv.agg(F.max("snapshot_date").alias("newest"))
    return gmv.join(newest, gmv.snapshot_date == newest.newest).drop("newest")


@query(f"SELECT * FROM ({DAILY_SQL}) WHERE snapshot_date = (SELECT MAX(snapshot_date) FROM ({DAILY_SQL}))")
def current_snapshot_operator(spark, d):
    return metrics.latest_snapshot(gmv_daily_by_region(spark, d))


@query(f"""WITH {DAYS_SQL}
SELECT user_id, snapshot_date, event_id, event_type, cents FROM (SELECT b.user_id, snapshot_date, event_id, event_type, cents,
ROW_NUMBER() OVER (PARTITION BY b.user_id, snapshot_date ORDER BY ts DESC, event_id DESC) AS r FROM b JOIN ({E_SQL}) e ON e.user_id = b.user_id AND e.day <= b.snapshot_date) WHERE r = 1""")
def asof_state_events_by_rank(spark, d):
    """The literal form of ``asof_state_events``, kept to compare their speed."""
    log = change_log(spark, d).withColumnRenamed("day", "transaction_date")
    return bitemporal.as_of_by_rank(entity_day_base(spark, d), log, ["user_id"], "snapshot_date", ("ts", "event_id"), ["event_id", "event_type", "cents"])


@query(f"""WITH g AS ({DAILY_SQL}), a AS (SELECT snapshot_date, gmv_date, subsidiary, CASE WHEN day(gmv_date) = 3 THEN gmv_daily_amount + 100 ELSE gmv_daily_amount END AS amount FROM g WHERE day(gmv_date) <> 5)
SELECT g.snapshot_date, g.gmv_date, g.subsidiary, g.gmv_daily_amount AS expected_gmv_daily_amount, a.amount AS gmv_daily_amount FROM g FULL JOIN a USING (snapshot_date, gmv_date, subsidiary) WHERE a.amount IS NULL OR abs(g.gmv_daily_amount - a.amount) > 1e-9""")
def gmv_reconciliation(spark, d):
    """Against an aggregate in which the third of each month is off and the fifth is missing."""
    snapshot = order_snapshot(spark, d)
    off = F.when(F.day("gmv_date") == 3, F.col("gmv_daily_amount") + 100).otherwise(F.col("gmv_daily_amount"))
    published = metrics.gmv_daily(snapshot).where(F.day("gmv_date") != 5).withColumn("gmv_daily_amount", off)
    return metrics.reconciliation(snapshot, published).select(*metrics.GRAIN, "expected_gmv_daily_amount", "gmv_daily_amount")


@query(f"""WITH s AS (SELECT *, LAG(gmv_daily_amount) OVER (PARTITION BY snapshot_date, subsidiary ORDER BY gmv_date) AS previous_amount FROM ({DAILY_SQL}))
SELECT snapshot_date, gmv_date, subsidiary, gmv_daily_amount, previous_amount FROM s WHERE abs(gmv_daily_amount - previous_amount) / previous_amount > 1.5""")
def gmv_swing_anomaly(spark, d):
    swings = metrics.with_swing(gmv_daily_by_region(spark, d)).where(F.col("swing_ratio") > metrics.SWING_RATIO)
    return swings.select(*metrics.GRAIN, "gmv_daily_amount", "previous_amount")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, COUNT(*) AS count FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def duplicate_groups(spark, d):
    return quality.repeated_groups(_read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber")), LINE_KEYS)


@query(f"""WITH e AS ({L_SQL}) SELECT COUNT(*) AS row_count, COUNT(*) - COUNT(DISTINCT record_hash) AS duplicates, (COUNT(*) - COUNT(DISTINCT record_hash)) / CAST(COUNT(*) AS DOUBLE) AS duplicate_rate FROM e""")
def raw_duplicate_rate(spark, d):
    """Counted per hash first, so the global count is of pre-aggregated rows."""
    by_hash = line_events(spark, d).groupBy("record_hash").agg(F.count("*").alias("n"))
    return by_hash.agg(F.sum("n").alias("row_count"), F.sum(F.col("n") - 1).alias("duplicates")).withColumn("duplicate_rate", F.col("duplicates") / F.col("row_count"))


@query("""WITH t AS (SELECT 'orders' AS source, MAX(CAST(o_orderdate AS DATE)) AS latest FROM orders UNION ALL SELECT 'lineitem', MAX(CAST(l_shipdate AS DATE)) FROM lineitem UNION ALL SELECT 'events', MAX(CAST(ts AS DATE)) FROM events)
SELECT source, latest, CAST(date_diff('day', latest, (SELECT MAX(latest) FROM t)) AS BIGINT) AS lag_days, date_diff('day', latest, (SELECT MAX(latest) FROM t)) > 7 AS stale FROM t""")
def freshness_lag(spark, d):
    columns = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
    frames = [_read(spark, d, t).agg(F.max(F.to_date(c)).alias("latest")).select(F.lit(t).alias("source"), "latest") for t, c in columns.items()]
    newest = F.max("latest").over(Window.partitionBy(F.lit(1)))  # three rows
    lagged = frames[0].union(frames[1]).union(frames[2]).withColumn("lag_days", F.datediff(newest, "latest").cast("bigint"))
    return lagged.withColumn("stale", F.col("lag_days") > quality.FRESHNESS_DAYS)


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_shipdate AS DATE) AS ship, CAST(o_orderdate AS DATE) AS ordered FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE)")
def future_leakage_check(spark, d):
    lines = _read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.to_date("l_shipdate").alias("ship"))
    orders = _read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ordered"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).where("ship < ordered").drop("o_orderkey")


@query("SELECT c_custkey, COALESCE(CAST(c_custkey AS VARCHAR), 'null') || '|' || COALESCE(CASE WHEN c_nationkey > 12 THEN CAST(c_nationkey AS VARCHAR) END, 'null') || '|' || COALESCE(c_mktsegment, 'null') AS business_key FROM customer")
def business_key_string(spark, d):
    masked = _read(spark, d, "customer").withColumn("c_nationkey", F.when(F.col("c_nationkey") > 12, F.col("c_nationkey")))
    return masked.select("c_custkey", X.business_key(["c_custkey", "c_nationkey", "c_mktsegment"]).alias("business_key"))


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}') AS record_hash FROM customer""")
def record_hash(spark, d):
    return _read(spark, d, "customer").select("c_custkey", X.record_hash(["c_custkey", "c_name", "c_mktsegment"]).alias("record_hash"))


DAY = date(1997, 6, 2)


@query(f"""SELECT l_orderkey AS k FROM lineitem WHERE CAST(l_shipdate AS DATE) = DATE '{DAY}' UNION SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '{DAY}'""")
def impacted_keys_union(spark, d):
    shipped = _read(spark, d, "lineitem").where(F.to_date("l_shipdate") == F.lit(DAY)).select(F.col("l_orderkey").alias("k"))
    ordered = _read(spark, d, "orders").where(F.to_date("o_orderdate") == F.lit(DAY)).select(F.col("o_orderkey").alias("k"))
    return impact.union_keys(impact.keys_of(shipped, ["k"]), impact.keys_of(ordered, ["k"]))


@query(f"""WITH k AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE CAST(l_shipdate AS DATE) = DATE '{DAY}'),
t AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS ship FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM k))
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS ship FROM lineitem WHERE CAST(l_shipdate AS DATE) IN (SELECT ship FROM t)""")
def impacted_partitions_semi(spark, d):
    lines = _read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", F.to_date("l_shipdate").alias("ship"))
    keys = impact.keys_of(lines.where(F.col("ship") == F.lit(DAY)), ["l_orderkey"])
    return impact.on_dates(lines, impact.dates_of(impact.touched_dates(lines, keys, ["l_orderkey"], DAY, "ship")), "ship")


CHECKS = {"low_value": "o_totalprice < 20000", "not_approved": "o_orderstatus <> 'F'", "urgent_cancelled": "o_orderpriority = '1-URGENT' and o_orderstatus = 'P'", "missing_customer": "o_custkey is null"}


@query(" UNION ALL ".join(f"""SELECT '{n}' AS rule_name, COUNT(*) AS impacted_record_count, COALESCE(array_to_string(list_sort(array_agg(k ORDER BY k) FILTER (WHERE r <= 5)), ','), '') AS impacted_business_keys
 FROM (SELECT k, ROW_NUMBER() OVER (ORDER BY k) AS r FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders WHERE {c}))""" for n, c in CHECKS.items()))
def dq_results_single_pass(spark, d):
    """All rules in one pass; a failing row is an event per rule it breaks."""
    broken = X.flags({n: F.expr(c) for n, c in CHECKS.items()})
    events = _read(spark, d, "orders").select(X.business_key(["o_orderkey"]).alias("key"), F.explode(broken).alias("rule_name"))
    counts = events.groupBy("rule_name").agg(F.count("*").alias("n"))
    first = quality.least_keys(events, ["rule_name"], "key").groupBy("rule_name").agg(F.array_join(F.sort_array(F.collect_list("key")), ",").alias("keys"))
    rules = spark.createDataFrame([(n,) for n in CHECKS], "rule_name string")
    return rules.join(counts, "rule_name", "left").join(first, "rule_name", "left").select("rule_name", F.coalesce("n", F.lit(0)).alias("impacted_record_count"), F.coalesce("keys", F.lit("")).alias("impacted_business_keys"))


@query(ORACLE_SQL["dq_results_single_pass"])
def dq_results_by_rule(spark, d):
    """Two scans a rule, for its count and for its first keys, kept to compare their speed with that of ``dq_results_single_pass``."""
    orders, parts = _read(spark, d, "orders").withColumn("key", X.business_key(["o_orderkey"])), []
    for name, condition in CHECKS.items():
        failing = orders.where(condition)
        keys = F.array_join(F.sort_array(F.collect_list("key")), ",")
        parts.append(failing.agg(F.lit(name).alias("rule_name"), F.count(F.lit(1)).alias("n"), F.lit("").alias("keys")))
        parts.append(failing.select("key").distinct().orderBy("key").limit(5).agg(F.lit(name).alias("rule_name"), F.lit(0).alias("n"), keys.alias("keys")))
    return reduce(DataFrame.unionByName, parts).groupBy("rule_name").agg(F.max("n").alias("impacted_record_count"), F.max("keys").alias("impacted_business_keys"))


@query("""SELECT o_orderstatus AS source, COUNT(*) FILTER (WHERE o_totalprice < 10000) AS error_result_count, COUNT(*) FILTER (WHERE o_totalprice < 50000) AS warning_result_count,
CASE WHEN COUNT(*) FILTER (WHERE o_totalprice < 10000) > 0 THEN 'failed' WHEN COUNT(*) FILTER (WHERE o_totalprice < 50000) > 0 THEN 'completed_with_warnings' ELSE 'succeeded' END AS run_status FROM orders GROUP BY 1""")
def run_log_status(spark, d):
    counts = _read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("source")).agg(F.count_if(F.col("o_totalprice") < 10000).alias("error_result_count"), F.count_if(F.col("o_totalprice") < 50000).alias("warning_result_count"))
    return counts.withColumn("run_status", F.when(F.col("error_result_count") > 0, "failed").when(F.col("warning_result_count") > 0, "completed_with_warnings").otherwise("succeeded"))


from . import composites as composites  # noqa: E402 - its queries register themselves here
