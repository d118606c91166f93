"""Daily revenue as known on each day, its running month, and checks between the two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..sources.contracts import GMV, PURCHASE_KEY, names

GRAIN = ("snapshot_date", "gmv_date", "subsidiary")
SWING_RATIO, TOLERANCE = 1.5, 1e-9


def daily_measures() -> list[Column]:
    return [
        F.sum("purchase_total_value").cast("double").alias("gmv_daily_amount"),
        F.count_distinct(*PURCHASE_KEY).alias("gmv_daily_purchase_count"),
        F.sum(F.coalesce(F.col("item_quantity").cast("bigint"), F.lit(0))).alias("gmv_daily_item_quantity"),
    ]


def running_month(amount: str, snapshot: str, by: str, day: str) -> Column:
    """Sum from the month's first row to the current one, per snapshot and group."""
    return F.sum(amount).over(Window.partitionBy(snapshot, by, F.trunc(day, "month")).orderBy(day).rowsBetween(Window.unboundedPreceding, 0))


def gmv_daily(snapshot: DataFrame) -> DataFrame:
    """Eligible purchases by snapshot, day and subsidiary, with the month to date (rows exist only for days with revenue)."""
    worst = [F.bool_or(F.col("quality_status") == s).alias(f"_{s}") for s in (X.ERROR, X.WARNING)]
    daily = snapshot.where("is_metric_eligible").groupBy(*GRAIN).agg(*daily_measures(), F.max("snapshot_created_at").alias("snapshot_created_at"), *worst)
    added = {"gmv_mtd_amount": running_month("gmv_daily_amount", "snapshot_date", "subsidiary", "gmv_date"), "quality_status": X.status(F.col("_error"), F.col("_warning"))}
    return daily.withColumns(added).select(*names(GMV))


def latest_snapshot(df: DataFrame, date_col: str = "snapshot_date") -> DataFrame:
    """Rows of the newest snapshot, found by a scalar subquery (on a partitioned table only that day is then read)."""
    return df.where(F.col(date_col) == df.agg(F.max(date_col)).scalar())


def reconciliation(snapshot: DataFrame, gmv: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Grains where the aggregate and the eligible rows differ, or only one side has the grain.  A null in a grain matches nothing."""
    measures = [c for c in names(GMV) if c.startswith("gmv_daily_")]
    expected = snapshot.where("is_metric_eligible").groupBy(*GRAIN).agg(*daily_measures()).withColumn("_expected", F.lit(True)).withColumnsRenamed({m: f"expected_{m}" for m in measures})
    actual = gmv.select(*GRAIN, *measures).withColumn("_actual", F.lit(True))
    both = expected.join(actual, list(GRAIN), "full_outer")
    amount, *counts = measures
    differs = F.col("_expected").isNull() | F.col("_actual").isNull() | (F.abs(F.col(f"expected_{amount}") - F.col(amount)) > tolerance)
    return both.where(differs | X.any_true(F.col(f"expected_{c}") != F.col(c) for c in counts)).drop("_expected", "_actual")


def with_swing(gmv: DataFrame, amount: str = "gmv_daily_amount") -> DataFrame:
    """``swing_ratio``: change against the day before that has a row, relative to it; null without one or if it was zero."""
    before = F.lag(amount).over(Window.partitionBy("snapshot_date", "subsidiary").orderBy("gmv_date"))
    return gmv.withColumn("previous_amount", before).withColumn("swing_ratio", F.abs(F.try_divide(F.col(amount) - F.col("previous_amount"), F.col("previous_amount"))))
