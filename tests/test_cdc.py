"""Contracts, enrichment, resends, versions, references and row quality."""

from datetime import date, datetime
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from kelpline.functions import expressions as X
from kelpline.operators import cdc
from kelpline.sources.contracts import METADATA, SOURCES, grain, names, schema_of, source

T = "transaction_datetime"


def rows_of(name, *given):
    """Bronze rows with defaults; missing columns are null."""
    spec, out = SOURCES[name], []
    for i, row in enumerate(given):
        base = {"ingestion_ts": datetime(2024, 1, 1, 0, 0, i), "batch_id": "b", "source_file": f"{name}.csv", "record_hash": f"{name}-{i}"} | row
        if T in base and "transaction_date" not in base:
            base["transaction_date"] = base[T].date()
        out.append(tuple(base.get(c) for c in names(spec.bronze_ddl)))
    return out


def bronze(spark, **given):
    return {n: spark.createDataFrame(rows_of(n, *given.get(n, ())), schema_of(s.bronze_ddl)) for n, s in SOURCES.items()}


def purchase(day, **more):
    return {"purchase_id": 1, "purchase_partition": 1, "prod_item_id": 5, "prod_item_partition": 1, "buyer_id": 10, "producer_id": 7, "order_date": date(2023, 1, 1), "release_date": date(2023, 1, 1), "purchase_total_value": 100.0, "purchase_status": "aprovada", T: datetime(2023, 1, day, 10)} | more


def item(day, **more):
    return {"prod_item_id": 5, "prod_item_partition": 1, "product_id": 9, "item_quantity": 2, "purchase_value": 100.0, T: datetime(2023, 1, day, 10)} | more


def extra(day, **more):
    return {"purchase_id": 1, "purchase_partition": 1, "subsidiary": " Nacional ", T: datetime(2023, 1, day, 10)} | more


def test_contracts():
    assert source("purchase").keys == ("purchase_id", "purchase_partition")
    with pytest.raises(ValueError, match="product_item"):
        source("nothing")
    assert grain("silver_product_item_cdc") == ("prod_item_id", "prod_item_partition") and grain("x") == ()
    assert names(METADATA) == ["ingestion_ts", "batch_id", "source_file", "record_hash"]


def test_enrichment(spark):
    spec = SOURCES["purchase_extra_info"]
    raw = spark.createDataFrame([("1", "x", "nacional", "2023-01-01 10:00:00", "2023-01-01")], spec.payload[:3] + ["transaction_datetime", "transaction_date"])
    raw = raw.select("purchase_id", F.col("purchase_partition"), "subsidiary", "transaction_datetime", "transaction_date")
    got = cdc.enrich(raw, "purchase_extra_info", "b1", "f.csv", "2024-01-01T00:00:00").first()
    assert got["purchase_id"] == 1 and got["purchase_partition"] is None and got["batch_id"] == "b1" and len(got["record_hash"]) == 64
    again = cdc.enrich(raw, "purchase_extra_info", "b2", "other", "2025-01-01").first()
    assert again["record_hash"] == got["record_hash"]  # metadata doesn't count
    with pytest.raises(ValueError):
        cdc.enrich(raw, "purchase_extra_info", "")
    with pytest.raises(ValueError, match="unexpected"):
        cdc.enrich(raw.withColumn("more", F.lit(1)), "purchase_extra_info", "b")


def test_resends_and_corrections(spark):
    frames = bronze(spark, purchase=[purchase(1, record_hash="same"), purchase(1, record_hash="same"), purchase(2, record_hash="new", buyer_id=11)])
    got = cdc.silver_frames(frames)["purchase"].orderBy("event_version_number").collect()
    assert [(r["buyer_id"], r["record_hash"], r["resend_duplicate_count"], r["event_version_number"], r["event_latest_rank"]) for r in got] == [(10, "same", 2, 1, 2), (11, "new", 1, 2, 1)]
    assert {r["purchase_status"] for r in got} == {"APROVADA"} and got[0]["ingestion_ts"] == datetime(2024, 1, 1)


def test_order_of_arrival_does_not_matter(spark):
    given = rows_of("purchase", purchase(1, record_hash="a"), purchase(1, record_hash="a"), purchase(1, record_hash="b"), purchase(3, record_hash="c", transaction_date=None))
    seen = set()
    for order in list(permutations(given))[::5]:
        frame = spark.createDataFrame(list(order), schema_of(SOURCES["purchase"].bronze_ddl))
        got = cdc.standardize(frame, SOURCES["purchase"]).collect()
        seen.add(tuple(sorted((r["record_hash"], r["event_version_number"], r["event_latest_rank"], r["resend_duplicate_count"]) for r in got)))
    assert len(seen) == 1


def test_flags_and_references(spark):
    frames = bronze(
        spark,
        purchase=[purchase(1), purchase(1, purchase_id=2, prod_item_id=99, purchase_status="odd", purchase_total_value=-1.0), purchase(1, purchase_id=None, purchase_status=" ")],
        product_item=[item(1), item(1, prod_item_id=77, item_quantity=0, purchase_value=None)],
        purchase_extra_info=[extra(1), extra(1, purchase_id=50, subsidiary=""), extra(2, transaction_date=date(2023, 1, 1))],
        order_transaction_cost_hist=[{"purchase_id": 1, "purchase_partition": 1, "order_transaction_cost_vat_value": -2.0, T: datetime(2023, 1, 1)}],
    )
    silver = cdc.silver_frames(frames)
    p = {r["purchase_id"]: r for r in silver["purchase"].collect()}
    assert p[1]["quality_status"] == "valid" and p[1]["quality_flags"] == [] and p[1]["has_product_item_match"] and p[1]["has_extra_info_match"]
    assert p[2]["quality_flags"] == ["invalid_purchase_status", "missing_product_item_reference", "missing_purchase_extra_info_reference", "negative_purchase_total_value"] and p[2]["quality_status"] == "warning"
    assert p[None]["quality_status"] == "error" and "missing_business_key" in p[None]["quality_flags"] and "missing_purchase_status" in p[None]["quality_flags"] and not p[None]["has_extra_info_match"]
    i = {r["prod_item_id"]: r["quality_flags"] for r in silver["product_item"].collect()}
    assert i == {5: [], 77: ["missing_purchase_value", "non_positive_item_quantity", "orphan_product_item_reference"]}
    e = [(r["purchase_id"], r["subsidiary"], r["quality_flags"]) for r in silver["purchase_extra_info"].orderBy("purchase_id", T).collect()]
    assert e == [(1, "nacional", []), (1, "nacional", ["transaction_date_mismatch"]), (50, None, ["missing_subsidiary", "orphan_purchase_extra_info_reference"])]
    c = silver["order_transaction_cost_hist"].first()
    assert c["quality_flags"] == ["missing_order_transaction_cost_date", "negative_order_transaction_cost_vat_value"]
    for name, spec in SOURCES.items():
        assert silver[name].columns == names(spec.silver_ddl)


def test_expressions(spark):
    df = spark.createDataFrame([(1, None, " Ab "), (None, 2, "")], "a int, b int, s string")
    got = df.select(X.business_key(["a", "b"]), X.clean_text("s", "upper"), X.all_present(["a"]), X.any_true([F.lit(False), F.col("b") == 2]), X.all_true([]), X.flags({}), X.inherit(F.array(F.lit("b")), {"p": F.array(F.lit("z"), F.lit("y"), F.lit("z")), "r": F.lit(None).cast("array<string>")}), X.inherit(X.no_flags(), {"q": F.lit(None).cast("array<string>")})).collect()
    assert [tuple(r) for r in got] == [("1|null", "AB", True, None, True, [], ["b", "p:y", "p:z"], []), ("null|2", None, False, True, True, [], ["b", "p:y", "p:z"], [])]
