"""As-of joins, the purchase snapshot and the daily aggregate."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from kelpline.operators import bitemporal, cdc, metrics, rankings
from kelpline.sources.contracts import SNAPSHOT, names

from .test_cdc import bronze, extra, item, purchase


def test_intervals_equal_the_ranked_join(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        day = date(2023, 1, rng.randint(1, 20))
        at = datetime(2023, 1, rng.randint(1, 22), rng.randint(0, 3))
        rows.append((rng.randint(1, 15), at, day, rng.choice([None, datetime(2023, 1, 1, 0, 0, rng.randint(0, 3))]), f"h{i}", i))
    df = spark.createDataFrame(rows, "k int, transaction_datetime timestamp, transaction_date date, ingestion_ts timestamp, record_hash string, v int")
    days = bitemporal.entity_days(df, ["k"], F.lit(date(2023, 1, 25)))
    fast = bitemporal.as_of(days, bitemporal.validity(df, ["k"], ["v"]), {"k": "k"}, "snapshot_date", "s").select("k", "snapshot_date", "s.v")
    slow = bitemporal.as_of_by_rank(days, df, ["k"], "snapshot_date", cdc.ORDERING, ["v"])
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect())) and fast.count() == days.count()


def test_calendar_and_days(spark):
    df = spark.createDataFrame([(1, date(2023, 1, 3)), (2, date(2023, 1, 5))], "k int, transaction_date date")
    assert [r[0].day for r in bitemporal.calendar([df, df.limit(0)]).orderBy("snapshot_date").collect()] == [3, 4, 5]
    assert bitemporal.calendar([df.limit(0)]).count() == 0
    assert bitemporal.entity_days(df, ["k"], F.lit(date(2023, 1, 4))).count() == 2  # nothing runs backwards


def snapshot_of(spark, day=None, **given):
    return bitemporal.purchase_snapshot(cdc.silver_frames(bronze(spark, **given)), "2024-01-01", day)


def test_state_is_carried_forward(spark):
    got = snapshot_of(spark, purchase=[purchase(1)], product_item=[item(1)], purchase_extra_info=[extra(2)]).orderBy("snapshot_date")
    assert got.columns == names(SNAPSHOT)
    assert [(r["snapshot_date"].day, r["has_extra_info"], r["is_metric_eligible"]) for r in got.collect()] == [(1, False, False), (2, True, True)]
    first = got.first()
    assert first["quality_status"] == "warning" and "missing_purchase_extra_info_snapshot" in first["quality_flags"]


def test_item_follows_the_purchases_key_of_the_day(spark):
    got = snapshot_of(
        spark,
        purchase=[purchase(1), purchase(3, prod_item_id=6)],
        product_item=[item(1), item(2, prod_item_id=6, product_id=44), item(4, product_id=10)],
        purchase_extra_info=[extra(1)],
    )
    assert [(r["snapshot_date"].day, r["product_id"]) for r in got.orderBy("snapshot_date").collect()] == [(1, 9), (2, 9), (3, 44), (4, 44)]


def test_late_rows_with_older_times_lose_and_unknown_status_is_not_eligible(spark):
    late = purchase(1, buyer_id=99, transaction_date=date(2023, 1, 3))
    got = snapshot_of(spark, purchase=[purchase(2), late, purchase(4, purchase_status=None)], product_item=[item(1)], purchase_extra_info=[extra(1)]).orderBy("snapshot_date").collect()
    assert [(r["snapshot_date"].day, r["buyer_id"], r["is_metric_eligible"]) for r in got] == [(2, 10, True), (3, 10, True), (4, 10, False)]


def test_later_events_leave_earlier_days_alone(spark):
    given = dict(purchase=[purchase(1), purchase(2, purchase_total_value=70.0)], product_item=[item(1)], purchase_extra_info=[extra(1)])
    before = metrics.gmv_daily(snapshot_of(spark, **given)).drop("snapshot_created_at")
    more = given | {"purchase": [*given["purchase"], purchase(5, purchase_total_value=1.0)]}
    after = metrics.gmv_daily(snapshot_of(spark, **more)).drop("snapshot_created_at")
    assert set(map(str, before.collect())) <= set(map(str, after.collect()))
    for day in (date(2023, 1, 1), date(2023, 1, 2), date(2023, 1, 5)):
        one = metrics.gmv_daily(snapshot_of(spark, day, **more)).drop("snapshot_created_at").collect()
        assert one == after.where(F.col("snapshot_date") == F.lit(day)).collect()


def gmv_frame(spark, rows):
    return spark.createDataFrame([(date(2023, 2, 28), *r) for r in rows], "snapshot_date date, gmv_date date, subsidiary string, purchase_total_value double, purchase_id long, purchase_partition long, item_quantity long, quality_status string, is_metric_eligible boolean").withColumn("snapshot_created_at", F.lit("2024-01-01").cast("timestamp"))


def test_daily_aggregate_and_month_to_date(spark):
    d = date(2023, 2, 1)
    frame = gmv_frame(spark, [(d, "n", 100.0, 1, 1, 1, "valid", True), (d, "n", 50.0, 2, 1, 2, "warning", True), (d + timedelta(1), "n", 200.0, 3, 1, None, "valid", True), (d, "n", 999.0, 4, 1, 9, "valid", False), (date(2023, 3, 1), "n", 5.0, 5, 1, 1, "valid", True)])
    got = metrics.gmv_daily(frame).orderBy("gmv_date").collect()
    assert [(r["gmv_daily_amount"], r["gmv_daily_purchase_count"], r["gmv_daily_item_quantity"], r["gmv_mtd_amount"], r["quality_status"]) for r in got] == [(150.0, 2, 3, 150.0, "warning"), (200.0, 1, 0, 350.0, "valid"), (5.0, 1, 1, 5.0, "valid")]
    assert metrics.reconciliation(frame, metrics.gmv_daily(frame)).count() == 0
    assert metrics.reconciliation(frame, metrics.gmv_daily(frame).where("gmv_daily_amount > 5")).count() == 1
    swing = metrics.with_swing(metrics.gmv_daily(frame)).orderBy("gmv_date").collect()
    assert [r["swing_ratio"] for r in swing][0] is None and abs(swing[1]["swing_ratio"] - 1 / 3) < 1e-9
    assert metrics.latest_snapshot(metrics.gmv_daily(frame)).count() == 3


def test_null_grain_never_reconciles(spark):
    frame = gmv_frame(spark, [(date(2023, 2, 1), None, 10.0, 1, 1, 1, "valid", True)])
    assert metrics.reconciliation(frame, metrics.gmv_daily(frame)).count() == 2


def test_rankings(spark):
    p = spark.createDataFrame([(1, 1, 7, 5, 1, 10.0, "APROVADA", date(2021, 3, 1)), (1, 1, 7, 5, 1, 10.0, "APROVADA", date(2021, 3, 1)), (1, 1, 7, 5, 1, 12.0, "APROVADA", date(2021, 3, 1)), (2, 1, 8, 6, 1, None, "APROVADA", date(2021, 12, 31)), (3, 1, 8, 6, 1, 99.0, "APROVADA", date(2022, 1, 1)), (4, 1, 9, 6, 1, 5.0, "INICIADA", date(2021, 1, 1))], "purchase_id long, purchase_partition long, producer_id long, prod_item_id long, prod_item_partition long, purchase_total_value double, purchase_status string, release_date date")
    assert [tuple(r) for r in rankings.top_producers(p).collect()] == [(7, 22.0), (8, 0.0)]  # differing versions both count
    items = spark.createDataFrame([(5, 1, 50, 3.0), (5, 1, 51, 3.0), (5, 1, 52, 1.0), (6, 1, 60, None)], "prod_item_id long, prod_item_partition long, product_id long, purchase_value double")
    got = [(r["producer_id"], r["product_id"], r["product_rank"]) for r in rankings.top_products(p, items).collect()]
    assert got == [(7, 50, 1), (7, 51, 2), (8, 60, 1)]
