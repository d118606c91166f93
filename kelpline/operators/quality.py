"""Data-quality rules over the ten published tables.

First everything is counted in one job: an aggregate a table has its rows, its newest dates and one count a row rule, and rules on
groups, joins and windows add an aggregate each.  Failing rows are looked at again only for rules that failed, to find the least
``sample_limit`` keys and rows of each; both are limited within tasks before they are exchanged, and only rows that stay are
written out as JSON.  Nothing is cached, and nothing but samples leaves the cluster.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import expressions as X
from ..sources.contracts import GMV, GMV_TABLE, QUARANTINE, RESULTS, RUN_LOG, SNAPSHOT, SNAPSHOT_TABLE, SOURCES, STATUSES, grain, names, schema_of
from . import bitemporal, metrics

ERROR, WARNING = "error", "warning"
FRESHNESS_DAYS, SAMPLE_LIMIT = 7.0, 5
PIPELINE = "kelpline_data_quality"


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    description: str
    #: SQL condition of a failing row; None for rules on groups, joins or whole tables.
    condition: str | None = None
    threshold: float = 0.0


def layer_of(table: str) -> str:
    return {SNAPSHOT_TABLE: "gold", GMV_TABLE: "gold"}.get(table, table.split("_")[0])


def table_order() -> list[str]:
    return [*(s.bronze_table for s in SOURCES.values()), *(s.silver_table for s in SOURCES.values()), SNAPSHOT_TABLE, GMV_TABLE]


def rules_of(table: str) -> list[Rule]:
    """The rules of a table, in the order they are reported."""
    statuses = ", ".join(f"'{s}'" for s in STATUSES)
    for s in SOURCES.values():
        if table == s.bronze_table:
            return [
                Rule("bronze_schema_contract_match", ERROR, "The table's columns are the contract's, no more and no fewer."),
                Rule("bronze_partition_key_completeness", ERROR, "Every row has its partition key, the transaction date.", "transaction_date is null"),
                Rule("bronze_raw_duplicate_rate", WARNING, "Share of rows that resend a payload seen before."),
                Rule("bronze_freshness_lag_days", WARNING, "Days by which the newest row is behind the freshest raw table.", None, FRESHNESS_DAYS),
            ]
        if table == s.silver_table:
            found = [
                Rule("silver_blocking_quality_status", ERROR, "Rows have a complete key and can be ordered in time.", "not is_business_key_complete or not is_ordering_valid"),
                Rule("silver_post_dedup_exact_resend_uniqueness", ERROR, "A payload occurs once per key after resends are collapsed."),
            ]
            if s.name == "purchase":
                found.append(Rule("silver_purchase_status_contract", ERROR, "The status is one of the known ones.", f"purchase_status is null or purchase_status not in ({statuses})"))
            negative = " or ".join(f"{a} < 0" for a in s.amounts) or "false"
            missing = " or ".join(f"not {link.flag}" for link in s.links)
            return [
                *found,
                Rule("silver_negative_amount_contract", ERROR, "Amounts are not negative.", negative),
                Rule("silver_orphan_reference_contract", WARNING, "Referenced rows of other sources exist.", missing),
            ]
    if table == SNAPSHOT_TABLE:
        late = " or ".join(f"{s}_source_transaction_date > snapshot_date" for s in SOURCES)
        torn = " or ".join(f"not ({flag} <=> ({s}_source_record_hash is not null))" for s, flag in bitemporal._HAS.items())
        return [
            Rule("gold_snapshot_uniqueness_by_grain", ERROR, "One row per snapshot day and purchase."),
            Rule("gold_snapshot_no_future_leakage", ERROR, "No source row is newer than the snapshot day.", late),
            Rule("gold_snapshot_completeness_flag_contract", ERROR, "Presence flags agree with the source rows' hashes.", torn),
            Rule("gold_snapshot_metric_eligibility_contract", ERROR, "Eligibility follows from the published columns.", f"not (is_metric_eligible <=> ({bitemporal.ELIGIBLE}))"),
        ]
    return [
        Rule("gold_gmv_uniqueness_by_grain", ERROR, "One row per snapshot day, revenue day and subsidiary."),
        Rule("gold_gmv_reconciliation_to_snapshot", ERROR, "The aggregate equals the sum of eligible snapshot rows."),
        Rule("gold_gmv_non_negative_amounts", ERROR, "Published measures are not negative.", "gmv_daily_amount < 0 or gmv_mtd_amount < 0 or gmv_daily_purchase_count < 0 or gmv_daily_item_quantity < 0"),
        Rule("gold_gmv_daily_swing_anomaly", WARNING, "Revenue moves by at most this share from one day to the next.", None, metrics.SWING_RATIO),
    ]


def _date_or_null(df: DataFrame, column: str) -> F.Column:
    return (F.col(column) if column in df.columns else F.lit(None)).cast("date").alias(column)


def whole_contract(table: str, df: DataFrame) -> DataFrame:
    """The table with columns that it lacks as nulls, so that rules can name them; ``bronze_schema_contract_match`` reports them."""
    lacking = {f.name: F.lit(None).cast(f.dataType) for f in contract_of(table) if f.name not in df.columns}
    return df.withColumns(lacking) if lacking else df


def contract_of(table: str) -> StructType:
    for s in SOURCES.values():
        if table in (s.bronze_table, s.silver_table):
            return schema_of(s.bronze_ddl if table == s.bronze_table else s.silver_ddl)
    return schema_of({SNAPSHOT_TABLE: SNAPSHOT, GMV_TABLE: GMV}[table])


def repeated_groups(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def group_rules(table: str, tables: Mapping[str, DataFrame]) -> dict[str, tuple[Callable[[], DataFrame], Callable[[], DataFrame]]]:
    """Rules on groups, joins and windows: of each, (frame that counts, with ``n`` and ``most``, frame of the failing rows)."""
    df, keys = tables[table], grain(table)
    count = (F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("most"))
    repeated = lambda by: (lambda: repeated_groups(df, by).agg(*count), lambda: repeated_groups(df, by))
    if layer_of(table) == "bronze":
        by_hash = df.groupBy("record_hash").count().where("count > 1")
        in_order = Window.partitionBy("record_hash").orderBy(F.col("ingestion_ts").asc_nulls_last(), *(F.col(k).asc_nulls_last() for k in keys))

        def later() -> DataFrame:
            resent = df.join(by_hash.select(F.col("record_hash").alias("_hash")), F.col("record_hash").eqNullSafe(F.col("_hash")), "left_semi")
            return resent.withColumn("_place", F.row_number().over(in_order)).where("_place > 1").drop("_place")

        return {"bronze_raw_duplicate_rate": (lambda: by_hash.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"), F.lit(None).cast("double").alias("most")), later)}
    if layer_of(table) == "silver":
        return {"silver_post_dedup_exact_resend_uniqueness": repeated((*keys, "record_hash"))}
    if table == SNAPSHOT_TABLE:
        return {"gold_snapshot_uniqueness_by_grain": repeated(keys)}
    unequal = lambda: metrics.reconciliation(tables[SNAPSHOT_TABLE], df)
    swings = lambda: metrics.with_swing(df).where(F.col("swing_ratio") > metrics.SWING_RATIO)
    return {
        "gold_gmv_uniqueness_by_grain": repeated(keys),
        "gold_gmv_reconciliation_to_snapshot": (lambda: unequal().agg(*count), unequal),
        "gold_gmv_daily_swing_anomaly": (lambda: swings().agg(count[0], F.max("swing_ratio").alias("most")), swings),
    }


def counted(tables: Mapping[str, DataFrame]) -> tuple[dict[str, dict], dict[tuple[str, str], dict]]:
    """Rows and newest dates of each table, and (``n``, ``most``) of each rule, by one job."""
    parts = []
    for table in table_order():
        df, checks = tables[table], [r for r in rules_of(table) if r.condition]
        broken = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.count_if(F.expr(r.condition)).alias("n"), F.lit(None).cast("double").alias("most")) for r in checks))
        none = F.expr("cast(array() as array<struct<rule:string,n:bigint,most:double>>)")
        whole = df.agg(F.count(F.lit(1)).alias("rows"), F.max(_date_or_null(df, "transaction_date")).alias("transaction_date"), F.max(_date_or_null(df, "snapshot_date")).alias("snapshot_date"), (broken if checks else none).alias("counts"))
        parts.append(whole.select(F.lit(table).alias("table_name"), "rows", "transaction_date", "snapshot_date", "counts"))
        for rule, (count, _) in group_rules(table, tables).items():
            one = F.array(F.struct(F.lit(rule).alias("rule"), F.col("n").cast("bigint").alias("n"), F.col("most").cast("double").alias("most")))
            parts.append(count().select(F.lit(table).alias("table_name"), F.lit(None).cast("bigint").alias("rows"), F.lit(None).cast("date").alias("transaction_date"), F.lit(None).cast("date").alias("snapshot_date"), one.alias("counts")))
    stats, counts = {}, {}
    for r in reduce(DataFrame.unionAll, parts).collect():
        if r["rows"] is not None:
            stats[r["table_name"]] = {"rows": r["rows"], "transaction_date": r["transaction_date"], "snapshot_date": r["snapshot_date"]}
        counts |= {(r["table_name"], c["rule"]): c.asDict() for c in r["counts"]}
    return stats, counts


def failing_rows(table: str, tables: Mapping[str, DataFrame], failed: set[str]) -> list[DataFrame]:
    """Rows that break the rules in ``failed`` as (rule, key, dates, row); one pass for all row rules."""
    df, groups = tables[table], group_rules(table, tables)
    rules = {r.name: F.expr(r.condition) for r in rules_of(table) if r.condition and r.name in failed}
    found = []
    if rules:  # rows that break none leave by a plain condition, before arrays are made
        found.append(df.where(X.any_true(rules.values())).withColumn("_rule", F.explode(X.flags(rules))))
    return found + [rows().withColumn("_rule", F.lit(rule)) for rule, (_, rows) in groups.items() if rule in failed]


def least_keys(rows: DataFrame, by: Sequence[str], key: str, most: int = SAMPLE_LIMIT) -> DataFrame:
    """The least ``most`` distinct keys of each group.  Equal keys meet within tasks and ranks are limited there too, so few rows move."""
    distinct = rows.where(F.col(key).isNotNull()).select(*by, key).distinct()
    ranked = distinct.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(key)))
    return ranked.where(F.col("_rank") <= most).drop("_rank")


def samples(tables: Mapping[str, DataFrame], failed: Mapping[str, set[str]], most: int = SAMPLE_LIMIT) -> tuple[dict[tuple, list[str]], list]:
    """Least keys and least rows (by key, then by a hash of all columns) of each failed rule.

    The first job finds the keys and reads no other columns than rules and keys need.  The second looks only at rows that have one
    of these, at most ``most`` keys a rule, and writes those that stay as JSON.
    """
    found = [(table, rows, [k for k in grain(table) if k in rows.columns]) for table, rules in failed.items() for rows in failing_rows(table, tables, rules)]
    if not found:
        return {}, []
    by = ["table_name", "rule"]
    placed = [rows.withColumn("_key", X.business_key(own) if own else F.lit(None).cast("string")) for _, rows, own in found]
    keyed = [p.select(F.lit(table).alias("table_name"), F.col("_rule").alias("rule"), F.col("_key").alias("business_key")) for (table, _, _), p in zip(found, placed)]
    keys: dict[tuple, list[str]] = {}
    for r in sorted(least_keys(reduce(DataFrame.unionAll, keyed), by, "business_key", most).collect()):
        keys.setdefault((r["table_name"], r["rule"]), []).append(r["business_key"])
    chosen = []
    for (table, rows, own), p in zip(found, placed):
        columns = sorted(c for c in rows.columns if c != "_rule")
        held = [(F.col("_rule") == rule) & F.col("_key").isin(*some) for (t, rule), some in keys.items() if t == table]
        near = p.where(X.any_true(held)) if own else p
        w = Window.partitionBy("_rule").orderBy(F.col("_key").asc_nulls_last(), F.xxhash64(*columns))
        first = near.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most)
        chosen.append(first.select(F.lit(table).alias("table_name"), F.col("_rule").alias("rule"), F.col("_key").alias("business_key"), _date_or_null(first, "transaction_date"), _date_or_null(first, "snapshot_date"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("payload")))
    return keys, reduce(DataFrame.unionAll, chosen).collect()


def _seconds(value: datetime | str | None) -> datetime:
    value = datetime.now(timezone.utc).replace(tzinfo=None) if value is None else datetime.fromisoformat(value) if isinstance(value, str) else value
    return value.replace(microsecond=0)


def run_status(errors: int, warnings: int) -> str:
    return "failed" if errors else "completed_with_warnings" if warnings else "succeeded"


def evaluate(tables: Mapping[str, DataFrame], run_id: str, pipeline_name: str = PIPELINE, started_at: datetime | str | None = None, evaluated_at: datetime | str | None = None, sample_limit: int = SAMPLE_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run log, results and quarantine of one evaluation: a job for all counts, and two for samples if a rule failed."""
    spark = next(iter(tables.values())).sparkSession
    began = _seconds(started_at)
    found, tables = tables, {t: whole_contract(t, df) for t, df in tables.items()}
    stats, counts = counted(tables)
    failed = {t: {r.name for r in rules_of(t) if counts.get((t, r.name), {"n": 0})["n"]} for t in table_order()}
    keys, sampled = samples(tables, {t: rules for t, rules in failed.items() if rules}, sample_limit)
    ended = _seconds(evaluated_at)

    newest = max((stats[s.bronze_table]["transaction_date"] for s in SOURCES.values() if stats[s.bronze_table]["transaction_date"]), default=None)
    results = [result(found, stats, counts, keys, newest, t, r) for t in table_order() for r in rules_of(t)]
    result_rows = [(run_id, pipeline_name, layer_of(t), t, rule.name, rule.severity, "failed" if bad else "passed", ended, None, None, metric, rule.threshold, n, first, rule.description) for t, rule, bad, metric, n, first in results]
    severity = {r.name: r.severity for t in table_order() for r in rules_of(t)}
    quarantine = [(run_id, pipeline_name, layer_of(s["table_name"]), s["table_name"], s["rule"], severity[s["rule"]], ended, s["transaction_date"], s["snapshot_date"], s["business_key"], s["payload"]) for s in sampled]
    log = run_log(stats, [(t, rule, bad) for t, rule, bad, *_ in results], run_id, pipeline_name, began, ended)
    return frame(spark, log, RUN_LOG), frame(spark, result_rows, RESULTS), frame(spark, quarantine, QUARANTINE)


def frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Local rows with a schema; fine without rows."""
    return spark.createDataFrame(rows, schema_of(ddl))


def result(tables: Mapping[str, DataFrame], stats: dict, counts: dict, keys: dict, newest: date | None, table: str, rule: Rule) -> tuple:
    """(table, rule, failed, metric, impacted rows, sampled keys) of one check."""
    hit = counts.get((table, rule.name), {"n": 0, "most": None})
    n, rows = hit["n"], stats[table]["rows"]
    if rule.name == "bronze_schema_contract_match":
        spec = next(s for s in SOURCES.values() if s.bronze_table == table)
        n = len(set(names(spec.bronze_ddl)) ^ set(tables[table].columns))
        return table, rule, n > 0, float(n), n, []
    if rule.name == "bronze_freshness_lag_days":
        own = stats[table]["transaction_date"]
        lag = float((newest - own).days) if own and newest else None
        failed = lag > rule.threshold if lag is not None else rows == 0
        return table, rule, failed, lag, rows if failed else 0, []
    metric = float(n)
    if rule.name == "bronze_raw_duplicate_rate":
        metric = n / rows if rows else 0.0
    elif rule.name == "gold_gmv_daily_swing_anomaly":
        metric = hit["most"] or 0.0
    return table, rule, n > 0, metric, n, keys.get((table, rule.name), [])


def run_log(stats: dict, outcomes: list[tuple], run_id: str, pipeline_name: str, began: datetime, ended: datetime) -> list[tuple]:
    """A row per table and one for the whole run."""
    rows, inputs = [], {}
    for s in SOURCES.values():
        inputs |= {s.bronze_table: stats[s.bronze_table]["rows"], s.silver_table: stats[s.bronze_table]["rows"]}
    inputs |= {SNAPSHOT_TABLE: sum(stats[s.silver_table]["rows"] for s in SOURCES.values()), GMV_TABLE: stats[SNAPSHOT_TABLE]["rows"]}
    for table in table_order():
        failed = [rule for t, rule, bad in outcomes if t == table and bad]
        errors = sum(r.severity == ERROR for r in failed)
        own = stats[table]
        rows.append((run_id, pipeline_name, layer_of(table), table, run_status(errors, len(failed) - errors), began, ended, inputs[table], own["rows"], own["transaction_date"], own["snapshot_date"], errors, len(failed) - errors, json.dumps({"failed_rules": [r.name for r in failed]})))
    errors, warnings = sum(r[11] for r in rows), sum(r[12] for r in rows)
    newest = [max((r[i] for r in rows if r[i]), default=None) for i in (9, 10)]
    details = json.dumps({"tables": [{"run_status": r[4], "table_name": r[3]} for r in rows]})
    raw = sum(stats[s.bronze_table]["rows"] for s in SOURCES.values())
    rows.append((run_id, pipeline_name, "pipeline", "all_tables", run_status(errors, warnings), began, ended, raw, stats[GMV_TABLE]["rows"], *newest, errors, warnings, details))
    return rows
