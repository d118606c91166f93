"""The composite operators (silver, snapshot, impact, quality) over the star-schema tables, with the SQL that gives the same rows.

Orders become purchases of two versions with resends, lines become items, orders' priorities subsidiaries, and prices costs; dates
are dealt to a few weeks.  The same text makes the raw events here and there; all that follows is written twice.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bitemporal, cdc, impact, metrics, quality
from ..sources.contracts import GMV_TABLE, GMV_VIEW, SNAPSHOT_TABLE, SOURCES, schema_of
from ..sources.session import delete_at_exit, delete_folders, dropping_shuffles, shared_dir
from ..sources.staged import StagedStore
from ..sources.tables import qualified
from . import loads
from .catalogue import ORACLE_SQL, _read, query

DAY = date(2024, 1, 6)
_META = "{c} AS copy, CASE WHEN {c} = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE TIMESTAMP '2024-02-02 00:00:00' END AS ingestion_ts, concat('b', {c}) AS batch_id, 'f' AS source_file"


#: Three orders in a row share an item, so items grow with the orders.
_ITEM_OF_ORDER, _ITEM_OF_LINE = "(o_orderkey - o_orderkey % 3)", "(l_orderkey - l_orderkey % 3)"
_DAYS = "o_orderkey % 8 + v * (1 + o_orderkey % 3)"


def _when(days: str, name: str = "") -> str:
    at = f"(DATE '2024-01-01' + CAST({days} AS INT))"
    return f"CAST({at} AS TIMESTAMP) AS transaction_datetime, {at} AS transaction_date" if not name else f"{at} AS {name}"


#: Each order and item twice, as two versions, and each version once or twice, as resends: ``{many}`` is the engine's generator.
_PURCHASE = f"""SELECT o_orderkey AS purchase_id, 1 + o_orderkey % 2 AS purchase_partition, o_custkey AS buyer_id, CASE WHEN o_orderkey % 50 <> 0 THEN {_ITEM_OF_ORDER} END AS prod_item_id,
 1 AS prod_item_partition, {_when('o_orderkey % 8', 'order_date')}, CASE WHEN v = 1 OR o_orderkey % 4 = 0 THEN DATE '2024-01-02' + CAST(o_orderkey % 8 AS INT) END AS release_date, o_custkey % 97 AS producer_id,
 ROUND(o_totalprice) * CASE WHEN o_orderkey % 41 = 0 THEN -1 ELSE 1 END AS purchase_total_value,
 CASE WHEN v = 0 AND o_orderkey % 4 <> 0 THEN ' iniciada' WHEN o_orderstatus = 'F' THEN 'aprovada ' WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderstatus = 'O' THEN 'Cancelada' ELSE 'odd' END AS purchase_status,
 CASE WHEN v = 1 AND o_orderkey % 9 = 0 THEN TIMESTAMP '2023-12-31 00:00:00' ELSE CAST(DATE '2024-01-01' + CAST({_DAYS} AS INT) AS TIMESTAMP) END AS transaction_datetime, {_when(_DAYS, 'transaction_date')},
 {_META.format(c='c')}, concat('p', o_orderkey, '-', v) AS record_hash FROM (SELECT *, {{many}}([0, 1]) AS c FROM (SELECT *, {{many}}([0, 1]) AS v FROM {{orders}}) AS versions WHERE v = 0 OR o_orderkey % 3 = 0) AS copies WHERE c = 0 OR o_orderkey % 7 = 0"""
_ITEM = f"""SELECT k AS prod_item_id, 1 AS prod_item_partition, part + v AS product_id, CASE WHEN v = 1 AND k % 13 = 0 THEN 0 WHEN k % 29 = 0 THEN NULL ELSE quantity END AS item_quantity,
 CASE WHEN k % 31 = 0 THEN -price ELSE price END AS purchase_value, {_when('k % 9 + v * 2')}, {_META.format(c=0)}, concat('i', k, '-', v) AS record_hash FROM (SELECT *, {{many}}([0, 1]) AS v FROM
 (SELECT {_ITEM_OF_LINE} AS k, MIN(l_partkey) AS part, MAX(l_quantity) AS quantity, MIN(l_extendedprice) AS price FROM {{lineitem}} WHERE l_orderkey % 11 <> 0 GROUP BY {_ITEM_OF_LINE}) AS items) AS versions WHERE v = 0 OR k % 2 = 0"""


#: Raw events, as SQL that both engines run.
BRONZE = {
    "purchase": _PURCHASE,
    "product_item": _ITEM,
    "purchase_extra_info": f"""SELECT o_orderkey AS purchase_id, 1 + o_orderkey % 2 AS purchase_partition, CASE WHEN o_orderkey % 23 = 0 THEN ' ' ELSE o_orderpriority END AS subsidiary,
 {_when('(o_orderkey * 7) % 10')}, {_META.format(c=0)}, concat('e', o_orderkey) AS record_hash FROM {{orders}} WHERE o_orderkey % 5 <> 0""",
    "order_transaction_cost_hist": f"""SELECT o_orderkey AS purchase_id, 1 + o_orderkey % 2 AS purchase_partition, CASE WHEN o_orderkey % 20 = 0 THEN -1 ELSE o_totalprice END AS order_transaction_cost_vat_value,
 o_totalprice AS order_transaction_cost_installment_value, CASE WHEN o_orderkey % 28 <> 0 THEN DATE '2024-01-03' END AS order_transaction_cost_date, {_when('(o_orderkey * 3) % 11')}, {_META.format(c=0)},
 concat('c', o_orderkey) AS record_hash FROM {{orders}} WHERE o_orderkey % 4 = 0""",
}
_TABLES = {"orders": "orders", "lineitem": "lineitem"}


def bronze(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    frames = {t: _read(spark, d, t) for t in _TABLES}
    out = {}
    for name, sql in BRONZE.items():
        sql = sql.replace("{many}([0, 1])", "explode(array(0, 1))")
        raw = spark.sql(sql, **{t: f for t, f in frames.items() if f"{{{t}}}" in sql})
        out[name] = raw.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema_of(SOURCES[name].bronze_ddl)))
    return out


def _bronze_sql(name: str) -> str:
    return f"b_{name} AS MATERIALIZED ({BRONZE[name].format(many='unnest', **_TABLES)})"


# -- the oracle's own silver -----------------------------------------------------

_P, _I = "purchase_id, purchase_partition", "prod_item_id, prod_item_partition"
_COMMON = {"missing_business_key": "NOT complete", "missing_transaction_datetime": "transaction_datetime IS NULL", "missing_transaction_date": "transaction_date IS NULL", "transaction_date_mismatch": "CAST(transaction_datetime AS DATE) <> transaction_date"}
#: Of each source: key, cleaned columns, references (flag and the query that finds it), warnings.
_ORACLE = {
    "purchase": (
        _P,
        "* REPLACE (UPPER(NULLIF(TRIM(purchase_status), '')) AS purchase_status)",
        {"has_product_item_match": "EXISTS (SELECT 1 FROM b_product_item o WHERE o.prod_item_id = t.prod_item_id AND o.prod_item_partition = t.prod_item_partition)", "has_extra_info_match": "EXISTS (SELECT 1 FROM b_purchase_extra_info o WHERE o.purchase_id = t.purchase_id AND o.purchase_partition = t.purchase_partition)"},
        {"missing_prod_item_key": "prod_item_id IS NULL OR prod_item_partition IS NULL", "missing_purchase_status": "purchase_status IS NULL", "invalid_purchase_status": "purchase_status NOT IN ('APROVADA', 'CANCELADA', 'INICIADA', 'REEMBOLSADA')",
         "missing_purchase_total_value": "purchase_total_value IS NULL", "negative_purchase_total_value": "purchase_total_value < 0", "missing_release_date": "release_date IS NULL",
         "missing_product_item_reference": "prod_item_id IS NOT NULL AND NOT has_product_item_match", "missing_purchase_extra_info_reference": "NOT has_extra_info_match"},
    ),
    "product_item": (
        _I,
        "*",
        {"has_purchase_match": "EXISTS (SELECT 1 FROM b_purchase o WHERE o.prod_item_id = t.prod_item_id AND o.prod_item_partition = t.prod_item_partition)"},
        {"missing_product_id": "product_id IS NULL", "missing_item_quantity": "item_quantity IS NULL", "non_positive_item_quantity": "item_quantity <= 0", "missing_purchase_value": "purchase_value IS NULL", "negative_purchase_value": "purchase_value < 0", "orphan_product_item_reference": "NOT has_purchase_match"},
    ),
    "purchase_extra_info": (
        _P,
        "* REPLACE (LOWER(NULLIF(TRIM(subsidiary), '')) AS subsidiary)",
        {"has_purchase_match": "EXISTS (SELECT 1 FROM b_purchase o WHERE o.purchase_id = t.purchase_id AND o.purchase_partition = t.purchase_partition)"},
        {"missing_subsidiary": "subsidiary IS NULL", "orphan_purchase_extra_info_reference": "NOT has_purchase_match"},
    ),
    "order_transaction_cost_hist": (
        _P,
        "*",
        {"has_purchase_match": "EXISTS (SELECT 1 FROM b_purchase o WHERE o.purchase_id = t.purchase_id AND o.purchase_partition = t.purchase_partition)"},
        {"missing_order_transaction_cost_date": "order_transaction_cost_date IS NULL", "negative_order_transaction_cost_vat_value": "order_transaction_cost_vat_value < 0", "negative_order_transaction_cost_installment_value": "order_transaction_cost_installment_value < 0", "orphan_order_transaction_cost_hist_reference": "NOT has_purchase_match"},
    ),
}


def _named(conditions: dict[str, str]) -> str:
    """A sorted list of the names of conditions that hold."""
    return f"list_sort(list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for n, c in conditions.items())}], lambda x: x IS NOT NULL))"


def _silver_sql(name: str) -> str:
    key, cleaned, links, warnings = _ORACLE[name]
    complete = " AND ".join(f"{k} IS NOT NULL" for k in key.split(", "))
    flagged = ", ".join(f"{sql} AS {flag}" for flag, sql in links.items())
    return f"""s_{name} AS MATERIALIZED (SELECT *, CASE WHEN NOT complete OR NOT dated THEN 'error' WHEN len(flags) > 0 THEN 'warning' ELSE 'valid' END AS quality_status FROM (SELECT *, {_named(_COMMON | warnings)} AS flags FROM (
 SELECT *, {complete} AS complete, transaction_datetime IS NOT NULL AND transaction_date IS NOT NULL AS dated, {flagged} FROM (
 SELECT *, COUNT(*) OVER (PARTITION BY {key}) AS event_count_for_key, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY transaction_datetime NULLS FIRST, transaction_date NULLS FIRST, ingestion_ts NULLS FIRST, record_hash NULLS FIRST) AS event_version_number,
 ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY transaction_datetime DESC NULLS LAST, transaction_date DESC NULLS LAST, ingestion_ts DESC NULLS LAST, record_hash DESC NULLS LAST) AS event_latest_rank FROM (
 SELECT *, COUNT(*) OVER (PARTITION BY {key}, record_hash) AS resend_duplicate_count, ROW_NUMBER() OVER (PARTITION BY {key}, record_hash ORDER BY ingestion_ts, batch_id, source_file) AS place FROM (SELECT {cleaned} FROM b_{name})) WHERE place = 1) AS t)))"""


_BRONZE_SQL = "WITH " + ", ".join(map(_bronze_sql, BRONZE))
_SILVER_SQL = f"{_BRONZE_SQL}, {', '.join(map(_silver_sql, BRONZE))}"
_VERSIONS = "resend_duplicate_count, event_count_for_key, event_version_number, event_latest_rank"


def _silver_query(name: str, columns: str) -> str:
    return f"{_SILVER_SQL} SELECT record_hash, transaction_date, batch_id, {_VERSIONS}, {columns}, {', '.join(_ORACLE[name][2])}, quality_status, array_to_string(flags, ',') AS quality_flags FROM s_{name}"


def _silver(spark: SparkSession, d: str, name: str, columns: str) -> DataFrame:
    frame = cdc.silver_frames(bronze(spark, d))[name]
    return frame.select("record_hash", "transaction_date", "batch_id", *_VERSIONS.split(", "), *columns.split(", "), *_ORACLE[name][2], "quality_status", F.array_join("quality_flags", ",").alias("quality_flags"))


_SHOWN = {
    "purchase": "purchase_id, purchase_partition, purchase_status, purchase_total_value, release_date, prod_item_id",
    "product_item": "prod_item_id, prod_item_partition, product_id, purchase_value",
    "purchase_extra_info": "purchase_id, purchase_partition, subsidiary",
    "order_transaction_cost_hist": "purchase_id, purchase_partition, order_transaction_cost_installment_value, order_transaction_cost_date",
}


@query(_silver_query("purchase", _SHOWN["purchase"]))
def silver_purchase(spark, d):
    return _silver(spark, d, "purchase", _SHOWN["purchase"])


@query(_silver_query("product_item", _SHOWN["product_item"]))
def silver_item(spark, d):
    return _silver(spark, d, "product_item", _SHOWN["product_item"])


@query(_silver_query("purchase_extra_info", _SHOWN["purchase_extra_info"]))
def silver_extra_info(spark, d):
    return _silver(spark, d, "purchase_extra_info", _SHOWN["purchase_extra_info"])


@query(_silver_query("order_transaction_cost_hist", _SHOWN["order_transaction_cost_hist"]))
def silver_cost_hist(spark, d):
    return _silver(spark, d, "order_transaction_cost_hist", _SHOWN["order_transaction_cost_hist"])


# -- impact -------------------------------------------------------------------------


def _today(name: str, key: str) -> str:
    return f"SELECT DISTINCT {key.split(', ')[0]} AS id, {key.split(', ')[1]} AS part FROM b_{name} WHERE transaction_date = DATE '{DAY}' AND {' AND '.join(f'{k} IS NOT NULL' for k in key.split(', '))}"


_IMPACTED = {
    "purchase": f"{_today('purchase', _P)} UNION {_today('purchase_extra_info', _P)} UNION SELECT purchase_id, purchase_partition FROM b_purchase WHERE (prod_item_id, prod_item_partition) IN (SELECT id, part FROM ({_today('product_item', _I)}))",
    "product_item": f"{_today('product_item', _I)} UNION {_today('purchase', _I)}",
    "purchase_extra_info": f"{_today('purchase_extra_info', _P)} UNION {_today('purchase', _P)}",
    "order_transaction_cost_hist": f"{_today('order_transaction_cost_hist', _P)} UNION {_today('purchase', _P)}",
}


@query(f"{_BRONZE_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS source, id, CAST(part AS BIGINT) AS part FROM ({sql})" for n, sql in _IMPACTED.items()))
def impacted_keys(spark, d):
    found = impact.impacted_keys(bronze(spark, d), DAY)
    parts = [f.select(F.lit(n).alias("source"), F.col(SOURCES[n].keys[0]).alias("id"), F.col(SOURCES[n].keys[1]).alias("part")) for n, f in found.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query(f"""{_SILVER_SQL}, k AS ({_IMPACTED['product_item']}), d AS (SELECT transaction_date FROM s_product_item WHERE (prod_item_id, prod_item_partition) IN (SELECT id, part FROM k))
SELECT record_hash, transaction_date, {_VERSIONS}, quality_status FROM s_product_item WHERE transaction_date IN (SELECT transaction_date FROM d)""")
def impacted_rows(spark, d):
    """What an incremental run publishes of one source: versions are numbered over the history of the touched keys only."""
    raw, spec = bronze(spark, d), SOURCES["product_item"]
    days = impact.dates_of(impact.touched_dates(raw["product_item"], impact.impacted_keys(raw, DAY)["product_item"], spec.keys, DAY))
    rows = impact.on_dates(cdc.silver_frame(spec, impact.history_of(raw["product_item"], spec, days), raw), days)
    return rows.select("record_hash", "transaction_date", *_VERSIONS.split(", "), "quality_status")


# -- snapshot -----------------------------------------------------------------------


def _as_of_sql(name: str, on: str, base: str) -> str:
    newest = "ORDER BY r.transaction_datetime DESC NULLS LAST, r.transaction_date DESC NULLS LAST, r.ingestion_ts DESC NULLS LAST, r.record_hash DESC NULLS LAST"
    return f"""a_{name} AS (SELECT * FROM (SELECT l.snapshot_date AS on_day, l.purchase_id AS of_id, l.purchase_partition AS of_part, r.*, ROW_NUMBER() OVER (PARTITION BY l.snapshot_date, l.purchase_id, l.purchase_partition {newest}) AS nth
 FROM {base} AS l JOIN s_{name} AS r ON {on} AND r.transaction_date <= l.snapshot_date WHERE r.complete AND r.dated) WHERE nth = 1)"""


_MATCH = "x.on_day = base.snapshot_date AND x.of_id = base.purchase_id AND x.of_part = base.purchase_partition"
_SNAP_FLAGS = {
    "missing_purchase_snapshot": "NOT has_purchase", "missing_product_item_snapshot": "NOT has_product_item", "missing_purchase_extra_info_snapshot": "NOT has_extra_info", "missing_subsidiary_snapshot": "has_extra_info AND subsidiary IS NULL",
    "missing_purchase_status_snapshot": "purchase_status IS NULL", "metric_ineligible_purchase_status": "purchase_status <> 'APROVADA'", "missing_release_date_snapshot": "release_date IS NULL",
    "missing_purchase_total_value_snapshot": "purchase_total_value IS NULL", "negative_purchase_total_value_snapshot": "purchase_total_value < 0",
}
_SOURCE_FLAGS = ", ".join(f"list_transform(coalesce({a}.flags, []), lambda x: '{n}:' || x)" for a, n in (("p", "purchase"), ("i", "product_item"), ("e", "purchase_extra_info"), ("c", "order_transaction_cost_hist")))
_SNAPSHOT_SQL = f"""{_SILVER_SQL},
usable AS ({' UNION ALL '.join(f'SELECT transaction_date FROM s_{n} WHERE complete AND dated' for n in BRONZE)}),
first_days AS (SELECT purchase_id, purchase_partition, MIN(transaction_date) AS lo FROM s_purchase WHERE complete AND dated GROUP BY 1, 2),
base AS (SELECT purchase_id, purchase_partition, CAST(UNNEST(generate_series(lo, (SELECT MAX(transaction_date) FROM usable), INTERVAL 1 DAY)) AS DATE) AS snapshot_date FROM first_days),
{_as_of_sql('purchase', 'l.purchase_id = r.purchase_id AND l.purchase_partition = r.purchase_partition', 'base')},
{_as_of_sql('purchase_extra_info', 'l.purchase_id = r.purchase_id AND l.purchase_partition = r.purchase_partition', 'base')},
{_as_of_sql('order_transaction_cost_hist', 'l.purchase_id = r.purchase_id AND l.purchase_partition = r.purchase_partition', 'base')},
with_key AS (SELECT on_day AS snapshot_date, of_id AS purchase_id, of_part AS purchase_partition, prod_item_id, prod_item_partition FROM a_purchase),
{_as_of_sql('product_item', 'l.prod_item_id = r.prod_item_id AND l.prod_item_partition = r.prod_item_partition', 'with_key')},
wide AS (SELECT base.*, p.buyer_id, p.producer_id, p.purchase_status, p.order_date, p.release_date, p.purchase_total_value, p.prod_item_id, i.product_id, CAST(i.item_quantity AS INT) AS item_quantity, i.purchase_value, e.subsidiary, c.order_transaction_cost_installment_value,
 p.record_hash IS NOT NULL AS has_purchase, i.record_hash IS NOT NULL AS has_product_item, e.record_hash IS NOT NULL AS has_extra_info, c.record_hash IS NOT NULL AS has_order_transaction_cost_hist,
 p.quality_status AS p_status, i.quality_status AS i_status, e.quality_status AS e_status, c.quality_status AS c_status, p.record_hash AS purchase_source_record_hash, i.record_hash AS product_item_source_record_hash, e.record_hash AS purchase_extra_info_source_record_hash, c.record_hash AS order_transaction_cost_hist_source_record_hash,
 p.transaction_date AS purchase_source_transaction_date, i.transaction_date AS product_item_source_transaction_date, e.transaction_date AS purchase_extra_info_source_transaction_date, c.transaction_date AS order_transaction_cost_hist_source_transaction_date,
 flatten([{_SOURCE_FLAGS}]) AS inherited
 FROM base LEFT JOIN a_purchase p ON {_MATCH.replace('x.', 'p.')} LEFT JOIN a_product_item i ON {_MATCH.replace('x.', 'i.')} LEFT JOIN a_purchase_extra_info e ON {_MATCH.replace('x.', 'e.')} LEFT JOIN a_order_transaction_cost_hist c ON {_MATCH.replace('x.', 'c.')}),
snap AS (SELECT *, COALESCE(has_purchase AND has_product_item AND has_extra_info AND subsidiary IS NOT NULL AND purchase_status = 'APROVADA' AND release_date IS NOT NULL AND purchase_total_value >= 0 AND p_status <> 'error'
 AND COALESCE(i_status, '') <> 'error' AND COALESCE(e_status, '') <> 'error', FALSE) AS is_metric_eligible, list_sort(list_distinct(list_concat(inherited, {_named(_SNAP_FLAGS)}))) AS flags FROM wide),
gold AS (SELECT *, release_date AS gmv_date, CASE WHEN 'error' IN (p_status, COALESCE(i_status, ''), COALESCE(e_status, ''), COALESCE(c_status, '')) THEN 'error' WHEN len(flags) > 0 THEN 'warning' ELSE 'valid' END AS quality_status FROM snap)"""
#: What makes two days of a purchase the same state.
_COMPARED = ("purchase_source_record_hash", "product_item_source_record_hash", "purchase_extra_info_source_record_hash", "order_transaction_cost_hist_source_record_hash")
_STATE = "concat_ws('|', coalesce(purchase_source_record_hash, '-'), coalesce(product_item_source_record_hash, '-'), coalesce(purchase_extra_info_source_record_hash, '-'), coalesce(order_transaction_cost_hist_source_record_hash, '-'))"
_GOLD = "snapshot_date, purchase_id, purchase_partition, buyer_id, producer_id, purchase_status, order_date, release_date, gmv_date, purchase_total_value, prod_item_id, product_id, item_quantity, purchase_value, subsidiary, order_transaction_cost_installment_value, has_purchase, has_product_item, has_extra_info, has_order_transaction_cost_hist, is_metric_eligible, purchase_source_record_hash, product_item_source_record_hash, product_item_source_transaction_date, quality_status"


CREATED = "2024-03-01"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again, as a load does it; the files go when the session's machine ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def silver_layer(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The four silver tables, written side by side: none waits for another's last task."""
    frames = cdc.silver_frames(raw)
    with ThreadPoolExecutor(len(frames)) as pool:
        return dict(zip(frames, pool.map(lambda n: stored(frames[n], f"silver-{n}"), frames)))


def _gold(frame: DataFrame) -> DataFrame:
    return frame.select(*_GOLD.split(", "), F.array_join("quality_flags", ",").alias("quality_flags"))


@query(f"{_SNAPSHOT_SQL} SELECT {_GOLD}, array_to_string(flags, ',') AS quality_flags FROM gold")
def snapshot_full(spark, d):
    """The sweep over the sources' versions, exploded to days."""
    return _gold(bitemporal.purchase_snapshot(silver_layer(bronze(spark, d)), CREATED))


@query(f"{_SNAPSHOT_SQL} SELECT {_GOLD}, array_to_string(flags, ',') AS quality_flags FROM gold WHERE snapshot_date = DATE '{DAY}'")
def snapshot_one_day(spark, d):
    return _gold(bitemporal.purchase_snapshot(silver_layer(bronze(spark, d)), CREATED, DAY))


@query(ORACLE_SQL["snapshot_one_day"])
def snapshot_next_day(spark, d):
    """One day from the published rows of the day before."""
    silver = silver_layer(bronze(spark, d))
    yesterday = stored(bitemporal.purchase_snapshot(silver, CREATED, DAY - timedelta(1)), "snapshot-before")
    return _gold(bitemporal.next_snapshot(yesterday, silver, DAY, CREATED))


@query(f"""{_SNAPSHOT_SQL}, marked AS (SELECT *, {_STATE} AS state FROM gold),
turns AS (SELECT *, LAG(state) OVER (PARTITION BY purchase_id, purchase_partition ORDER BY snapshot_date) AS before FROM marked)
SELECT purchase_id, purchase_partition, COUNT(*) FILTER (WHERE before IS NULL OR before <> state) AS states, COUNT(*) AS days, MIN(snapshot_date) AS first_day, CAST(SUM(CAST(is_metric_eligible AS INT)) AS BIGINT) AS eligible_days FROM turns GROUP BY ALL""")
def snapshot_intervals(spark, d):
    """Change points alone: how many different states a purchase has, over how many days, without a row a day."""
    silver = silver_layer(bronze(spark, d))
    last = bitemporal.last_date([bitemporal.usable(f) for f in silver.values()])
    spans = bitemporal.snapshot_intervals(silver, CREATED).withColumn("_end", F.coalesce("valid_to", F.date_add(last, 1))).where("valid_from < _end")
    spans = spans.withColumns({"_days": F.datediff("_end", "valid_from").cast("bigint"), "_state": F.struct(*(c for c in _COMPARED))})
    w = Window.partitionBy("purchase_id", "purchase_partition").orderBy("valid_from")
    turns = spans.withColumn("_before", F.lag("_state").over(w))
    changed = F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("_state"))
    return turns.groupBy("purchase_id", "purchase_partition").agg(F.count_if(changed).alias("states"), F.sum("_days").alias("days"), F.min("valid_from").alias("first_day"), F.coalesce(F.sum(F.when(F.col("is_metric_eligible"), F.col("_days"))), F.lit(0)).alias("eligible_days"))


# -- quality ------------------------------------------------------------------------


def evaluated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run log, results and quarantine of all published tables after each rule was broken somewhere.  Each layer is written and read
    again, as a load does it, so the rules' plans begin at files."""
    raw = bronze(spark, d)
    silver = silver_layer(raw)
    snapshot = stored(bitemporal.purchase_snapshot(silver, CREATED), "snapshot")
    gmv = stored(metrics.gmv_daily(snapshot), "gmv")
    return quality.evaluate(tampered(raw, silver, snapshot, gmv), "r")


def tampered(raw: dict[str, DataFrame], silver: dict[str, DataFrame], snapshot: DataFrame, gmv: DataFrame) -> dict[str, DataFrame]:
    """Tables that break every rule: a column too many and one too few, days lost and old, keys without order, repeated rows, sources
    from the future, false flags, wrong, repeated and negative days."""
    cost = "order_transaction_cost_hist"
    raw = raw | {
        "purchase": raw["purchase"].withColumn("surplus", F.lit(1)),
        "product_item": raw["product_item"].drop("source_file"),
        "purchase_extra_info": raw["purchase_extra_info"].withColumn("transaction_date", F.expr("if(purchase_id % 97 = 0, null, transaction_date)")),
        cost: raw[cost].withColumn("transaction_date", F.date_sub("transaction_date", 10)),
    }
    silver = silver | {
        "product_item": silver["product_item"].withColumn("is_ordering_valid", F.expr("prod_item_id % 199 <> 0")),
        "purchase_extra_info": silver["purchase_extra_info"].unionAll(silver["purchase_extra_info"].where("purchase_id % 103 = 0")),
    }
    forced = snapshot.withColumns(
        {
            "is_metric_eligible": F.expr("is_metric_eligible or purchase_id % 101 = 0"),
            "purchase_extra_info_source_transaction_date": F.expr("if(purchase_id % 109 = 0, date_add(snapshot_date, 1), purchase_extra_info_source_transaction_date)"),
            "has_order_transaction_cost_hist": F.expr("has_order_transaction_cost_hist <> (purchase_id % 113 = 0)"),
        }
    )
    forced = forced.unionAll(forced.where(f"purchase_id % 107 = 0 and snapshot_date = date'{DAY}'"))
    wrong = F.when(F.day("gmv_date") == 4, F.lit(-1.0)).otherwise(F.col("gmv_daily_amount"))
    gmv = gmv.withColumn("gmv_daily_amount", wrong).unionAll(gmv.where("gmv_date = date'2024-01-06'"))
    tables = {s.bronze_table: raw[n] for n, s in SOURCES.items()} | {s.silver_table: silver[n] for n, s in SOURCES.items()}
    return tables | {SNAPSHOT_TABLE: forced, GMV_TABLE: gmv}


_GRAIN = "snapshot_date, gmv_date, subsidiary"
_SUMS = "SUM(purchase_total_value) AS amount, COUNT(DISTINCT (purchase_id, purchase_partition)) AS purchases, CAST(SUM(COALESCE(item_quantity, 0)) AS BIGINT) AS quantity"
_TAMPERED_SQL = f"""{_SNAPSHOT_SQL},
changed AS (SELECT * REPLACE (CASE WHEN purchase_id % 109 = 0 THEN snapshot_date + 1 ELSE purchase_extra_info_source_transaction_date END AS purchase_extra_info_source_transaction_date, has_order_transaction_cost_hist <> (purchase_id % 113 = 0) AS has_order_transaction_cost_hist),
 is_metric_eligible OR purchase_id % 101 = 0 AS published FROM gold),
forced AS (SELECT * FROM changed UNION ALL SELECT * FROM changed WHERE purchase_id % 107 = 0 AND snapshot_date = DATE '{DAY}'),
t_product_item AS (SELECT * REPLACE (prod_item_id % 199 <> 0 AS dated) FROM s_product_item),
t_purchase_extra_info AS (SELECT * FROM s_purchase_extra_info UNION ALL SELECT * FROM s_purchase_extra_info WHERE purchase_id % 103 = 0),
t_purchase AS (SELECT * FROM s_purchase), t_order_transaction_cost_hist AS (SELECT * FROM s_order_transaction_cost_hist),
r_purchase AS (SELECT * FROM b_purchase), r_product_item AS (SELECT * FROM b_product_item),
r_purchase_extra_info AS (SELECT * REPLACE (CASE WHEN purchase_id % 97 <> 0 THEN transaction_date END AS transaction_date) FROM b_purchase_extra_info),
r_order_transaction_cost_hist AS (SELECT * REPLACE (transaction_date - 10 AS transaction_date) FROM b_order_transaction_cost_hist),
daily AS (SELECT {_GRAIN}, {_SUMS} FROM gold WHERE is_metric_eligible GROUP BY ALL),
gmv AS (SELECT * REPLACE (CASE WHEN day(gmv_date) = 4 THEN -1 ELSE amount END AS amount) FROM daily UNION ALL SELECT * FROM daily WHERE gmv_date = DATE '2024-01-06'),
expected AS (SELECT {_GRAIN}, {_SUMS} FROM forced WHERE published GROUP BY ALL),
swings AS (SELECT *, abs((amount - before) / NULLIF(before, 0)) AS ratio FROM (SELECT *, LAG(amount) OVER (PARTITION BY snapshot_date, subsidiary ORDER BY gmv_date) AS before FROM gmv))"""


def _key(columns: str, of: str = "") -> str:
    return " || '|' || ".join(f"COALESCE(CAST({of}{c} AS VARCHAR), 'null')" for c in columns.split(", "))


_AMOUNTS = {"purchase": "purchase_total_value < 0", "product_item": "purchase_value < 0", "purchase_extra_info": "FALSE", "order_transaction_cost_hist": "order_transaction_cost_vat_value < 0 OR order_transaction_cost_installment_value < 0"}


def _checks() -> list[tuple[str, str, str, str]]:
    """(table, rule, severity, query of the failing rows' key and measure)."""
    out = []
    for n, (key, _, links, _) in _ORACLE.items():
        b, k = f"bronze_{n}_events", _key(key)
        out += [
            (b, "bronze_schema_contract_match", "error", f"SELECT NULL AS k, NULL AS m WHERE {n in ('purchase', 'product_item')}"),
            (b, "bronze_partition_key_completeness", "error", f"SELECT {k} AS k, NULL AS m FROM r_{n} WHERE transaction_date IS NULL"),
            (b, "bronze_raw_duplicate_rate", "warning", f"SELECT {k} AS k, NULL AS m FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY record_hash ORDER BY ingestion_ts) AS place FROM r_{n}) WHERE place > 1"),
            (b, "bronze_freshness_lag_days", "warning", f"SELECT NULL AS k, NULL AS m FROM r_{n} WHERE {n == 'order_transaction_cost_hist'}"),
        ]
    for n, (key, _, links, _) in _ORACLE.items():
        t, k = f"silver_{n}_cdc", _key(key)
        out += [
            (t, "silver_blocking_quality_status", "error", f"SELECT {k} AS k, NULL AS m FROM t_{n} WHERE NOT complete OR NOT dated"),
            (t, "silver_post_dedup_exact_resend_uniqueness", "error", f"SELECT {k} AS k, NULL AS m FROM (SELECT {key}, record_hash FROM t_{n} GROUP BY ALL HAVING COUNT(*) > 1)"),
            *([(t, "silver_purchase_status_contract", "error", f"SELECT {k} AS k, NULL AS m FROM t_{n} WHERE purchase_status IS NULL OR purchase_status NOT IN ('APROVADA', 'CANCELADA', 'INICIADA', 'REEMBOLSADA')")] if n == "purchase" else []),
            (t, "silver_negative_amount_contract", "error", f"SELECT {k} AS k, NULL AS m FROM t_{n} WHERE {_AMOUNTS[n]}"),
            (t, "silver_orphan_reference_contract", "warning", f"SELECT {k} AS k, NULL AS m FROM t_{n} WHERE {' OR '.join(f'NOT {x}' for x in links)}"),
        ]
    k, g = _key(f"snapshot_date, {_P}"), _key(_GRAIN)
    torn = "COALESCE(x.amount IS NULL OR y.amount IS NULL OR abs(x.amount - y.amount) > 1e-9 OR x.purchases <> y.purchases OR x.quantity <> y.quantity, FALSE)"
    both = " || '|' || ".join(f"COALESCE(CAST(COALESCE(x.{c}, y.{c}) AS VARCHAR), 'null')" for c in _GRAIN.split(", "))
    same = " AND ".join(f"x.{c} = y.{c}" for c in _GRAIN.split(", "))
    return [
        *out,
        (SNAPSHOT_TABLE, "gold_snapshot_uniqueness_by_grain", "error", f"SELECT {k} AS k, NULL AS m FROM (SELECT snapshot_date, {_P} FROM forced GROUP BY ALL HAVING COUNT(*) > 1)"),
        (SNAPSHOT_TABLE, "gold_snapshot_no_future_leakage", "error", f"SELECT {k} AS k, NULL AS m FROM forced WHERE {' OR '.join(f'{n}_source_transaction_date > snapshot_date' for n in _ORACLE)}"),
        (SNAPSHOT_TABLE, "gold_snapshot_completeness_flag_contract", "error", f"SELECT {k} AS k, NULL AS m FROM forced WHERE {' OR '.join(f'{flag} <> ({n}_source_record_hash IS NOT NULL)' for n, flag in zip(_ORACLE, ('has_purchase', 'has_product_item', 'has_extra_info', 'has_order_transaction_cost_hist')))}"),
        (SNAPSHOT_TABLE, "gold_snapshot_metric_eligibility_contract", "error", f"SELECT {k} AS k, NULL AS m FROM forced WHERE published <> is_metric_eligible"),
        (GMV_TABLE, "gold_gmv_uniqueness_by_grain", "error", f"SELECT {g} AS k, NULL AS m FROM (SELECT {_GRAIN} FROM gmv GROUP BY ALL HAVING COUNT(*) > 1)"),
        (GMV_TABLE, "gold_gmv_reconciliation_to_snapshot", "error", f"SELECT {both} AS k, NULL AS m FROM expected x FULL JOIN gmv y ON {same} WHERE {torn}"),
        (GMV_TABLE, "gold_gmv_non_negative_amounts", "error", f"SELECT {g} AS k, NULL AS m FROM gmv WHERE amount < 0 OR purchases < 0 OR quantity < 0"),
        (GMV_TABLE, "gold_gmv_daily_swing_anomaly", "warning", f"SELECT {g} AS k, ratio AS m FROM swings WHERE ratio > 1.5"),
    ]


_FAILED_SQL = f"{_TAMPERED_SQL}, failed AS ({' UNION ALL '.join(f'SELECT {chr(39)}{t}{chr(39)} AS table_name, {chr(39)}{r}{chr(39)} AS rule_name, k, CAST(m AS DOUBLE) AS m FROM ({q})' for t, r, _, q in _checks())})"
_ROWS_SQL = " UNION ALL ".join([*(f"SELECT 'bronze_{n}_events' AS table_name, COUNT(*) AS n, MAX(transaction_date) AS newest FROM r_{n}" for n in BRONZE), *(f"SELECT 'silver_{n}_cdc', COUNT(*), MAX(transaction_date) FROM t_{n}" for n in BRONZE), f"SELECT '{SNAPSHOT_TABLE}', COUNT(*), NULL FROM forced", f"SELECT '{GMV_TABLE}', COUNT(*), NULL FROM gmv"])
_RESULTS_SQL = f"""{_FAILED_SQL}, sizes AS ({_ROWS_SQL}), raw AS (SELECT MAX(newest) AS top FROM sizes WHERE table_name LIKE 'bronze%'),
rules AS ({' UNION ALL '.join(f"SELECT '{t}' AS table_name, '{r}' AS rule_name, '{v}' AS severity" for t, r, v, _ in _checks())}),
hits AS (SELECT table_name, rule_name, COUNT(*) AS n, MAX(m) AS most FROM failed GROUP BY ALL),
firsts AS (SELECT table_name, rule_name, string_agg(k, ',' ORDER BY k) AS keys FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY table_name, rule_name ORDER BY k) AS nth FROM (SELECT DISTINCT table_name, rule_name, k FROM failed WHERE k IS NOT NULL)) WHERE nth <= 5 GROUP BY ALL),
results AS (SELECT r.*, COALESCE(h.n, 0) AS n, COALESCE(f.keys, '') AS keys, CASE WHEN r.rule_name = 'bronze_freshness_lag_days' THEN CAST(date_diff('day', s.newest, (SELECT top FROM raw)) AS DOUBLE) WHEN r.rule_name = 'bronze_raw_duplicate_rate' THEN COALESCE(h.n, 0) / CAST(s.n AS DOUBLE)
 WHEN r.rule_name = 'gold_gmv_daily_swing_anomaly' THEN COALESCE(h.most, 0) ELSE CAST(COALESCE(h.n, 0) AS DOUBLE) END AS metric FROM rules r JOIN sizes s USING (table_name) LEFT JOIN hits h USING (table_name, rule_name) LEFT JOIN firsts f USING (table_name, rule_name))"""


@query(f"""{_RESULTS_SQL} SELECT table_name, rule_name, severity, CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS rule_status, n AS impacted_record_count, ROUND(metric, 9) AS metric_value, keys AS impacted_business_keys FROM results""")
def dq_results(spark, d):
    results = evaluated(spark, d)[1]
    return results.select("table_name", "rule_name", "severity", "rule_status", "impacted_record_count", F.round("metric_value", 9).alias("metric_value"), F.array_join("impacted_business_keys", ",").alias("impacted_business_keys"))


@query(f"""{_RESULTS_SQL}, per AS (SELECT table_name, COUNT(*) FILTER (WHERE n > 0 AND severity = 'error') AS errors, COUNT(*) FILTER (WHERE n > 0 AND severity = 'warning') AS warnings FROM results GROUP BY 1),
every AS (SELECT table_name, errors, warnings, s.n AS output_row_count FROM per JOIN sizes s USING (table_name) UNION ALL SELECT 'all_tables', SUM(errors), SUM(warnings), (SELECT n FROM sizes WHERE table_name = '{GMV_TABLE}') FROM per)
SELECT table_name, CAST(errors AS BIGINT) AS error_result_count, CAST(warnings AS BIGINT) AS warning_result_count, CASE WHEN errors > 0 THEN 'failed' WHEN warnings > 0 THEN 'completed_with_warnings' ELSE 'succeeded' END AS run_status, output_row_count FROM every""")
def dq_run_log(spark, d):
    return evaluated(spark, d)[0].select("table_name", "error_result_count", "warning_result_count", "run_status", "output_row_count")


@query(f"""{_FAILED_SQL} SELECT table_name, rule_name, k AS business_key FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY table_name, rule_name ORDER BY k NULLS LAST) AS nth FROM failed) WHERE nth <= 5 AND rule_name NOT IN ('bronze_schema_contract_match', 'bronze_freshness_lag_days')""")
def dq_quarantine(spark, d):
    return evaluated(spark, d)[2].select("table_name", "rule_name", "business_key")


# -- the load path ------------------------------------------------------------------

_LOADED = "snapshot_date, gmv_date, subsidiary, gmv_daily_amount, gmv_daily_purchase_count, gmv_daily_item_quantity, gmv_mtd_amount, quality_status"
_PUBLISHED_SQL = f"""daily AS (SELECT {_GRAIN}, CAST({_SUMS.replace(' AS amount', ' AS DOUBLE) AS gmv_daily_amount', 1).replace('AS purchases', 'AS gmv_daily_purchase_count').replace('AS quantity', 'AS gmv_daily_item_quantity')},
 CASE WHEN bool_or(quality_status = 'error') THEN 'error' WHEN bool_or(quality_status = 'warning') THEN 'warning' ELSE 'valid' END AS quality_status FROM gold WHERE is_metric_eligible GROUP BY ALL),
published AS (SELECT *, SUM(gmv_daily_amount) OVER (PARTITION BY snapshot_date, subsidiary, date_trunc('month', gmv_date) ORDER BY gmv_date ROWS UNBOUNDED PRECEDING) AS gmv_mtd_amount FROM daily)"""
#: The same tables as they were when nothing after the day had come.
_UNTIL_SQL = _SNAPSHOT_SQL
for _name in BRONZE:
    _UNTIL_SQL = _UNTIL_SQL.replace(f"b_{_name} AS MATERIALIZED (", f"b_{_name} AS MATERIALIZED (SELECT * FROM (", 1)
_UNTIL_SQL = _UNTIL_SQL.replace("), b_", f") WHERE transaction_date <= DATE '{DAY}'), b_").replace("), s_purchase AS", f") WHERE transaction_date <= DATE '{DAY}'), s_purchase AS", 1)


def _published(store: StagedStore, days: DataFrame) -> DataFrame:
    """Rows of a namespace that is then removed."""
    kept = stored(days, "published")
    store.spark.sql(f"DROP DATABASE {qualified(None, store.namespace)} CASCADE")
    delete_folders(store.spark, [f"{store.spark.conf.get('spark.sql.warehouse.dir')}/{store.namespace}-staged"])
    return kept


def _loaded(spark: SparkSession, raw: dict[str, DataFrame]) -> StagedStore:
    """All layers of some raw events, loaded in full into a namespace of their own."""
    store = StagedStore(spark, f"load_{uuid4().hex[:12]}")
    for layer in ("bronze", "keys", "silver", "snapshot", "gmv"):
        store.prepare(layer)
    loads.append_events(store, raw, "first")
    loads.load_silver(store)
    loads.load_snapshot(store, created_at=CREATED)
    loads.load_gmv(store)
    return store


@query(f"{_SNAPSHOT_SQL}, {_PUBLISHED_SQL} SELECT {_LOADED} FROM published")
def load_full(spark, d):
    """Raw events through bronze, silver, snapshot and revenue tables, read back from the last."""
    with dropping_shuffles(spark):
        store = _loaded(spark, bronze(spark, d))
        return _published(store, store.read(GMV_TABLE).select(*_LOADED.split(", ")))


@query(f"{_UNTIL_SQL}, {_PUBLISHED_SQL} SELECT {_LOADED} FROM published WHERE snapshot_date = DATE '{DAY}'")
def load_one_day(spark, d):
    """A full load of all but the last day, then an incremental run of that day, read back through the view of the newest day."""
    raw = bronze(spark, d)
    with dropping_shuffles(spark):
        store = _loaded(spark, {n: f.where(F.col("transaction_date") < F.lit(DAY)) for n, f in raw.items()})
        loads.append_events(store, {n: f.where(F.col("transaction_date") == F.lit(DAY)) for n, f in raw.items()}, "second")
        loads.load_silver(store, loads.INCREMENTAL, DAY)
        loads.load_snapshot(store, loads.INCREMENTAL, DAY, CREATED)
        loads.load_gmv(store, loads.INCREMENTAL, DAY)
        return _published(store, spark.table(store.name(GMV_VIEW)).select(*_LOADED.split(", ")))


@query(f"""{_RESULTS_SQL} SELECT 'ops_data_quality_results' AS table_name, COUNT(*) AS rows, COUNT(*) FILTER (WHERE n > 0) AS failed FROM results
UNION ALL SELECT 'ops_pipeline_run_log', 11, (SELECT COUNT(DISTINCT table_name) + 1 FROM results WHERE n > 0)
UNION ALL SELECT 'ops_data_quality_quarantine', COUNT(*), COUNT(DISTINCT (table_name, rule_name)) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY table_name, rule_name ORDER BY k NULLS LAST) AS nth FROM failed) WHERE nth <= 5 AND rule_name NOT IN ('bronze_schema_contract_match', 'bronze_freshness_lag_days')""")
def load_quality_outputs(spark, d):
    """The three outputs of a run over tables that break every rule, appended to the ops tables and counted there."""
    store = StagedStore(spark, f"load_{uuid4().hex[:12]}")
    store.prepare("ops")
    loads.append_outputs(store, evaluated(spark, d))
    bad = {"ops_data_quality_results": "rule_status = 'failed'", "ops_pipeline_run_log": "run_status <> 'succeeded'"}
    counts = [store.read(t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.count_if(F.expr(c)).alias("failed")) for t, c in bad.items()]
    held = store.read("ops_data_quality_quarantine")
    counts.append(held.agg(F.lit("ops_data_quality_quarantine").alias("table_name"), F.count(F.lit(1)).alias("rows"), F.count_distinct("table_name", "rule_name").alias("failed")))
    return _published(store, reduce(DataFrame.unionAll, counts))
