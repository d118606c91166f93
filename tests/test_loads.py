"""Files to published tables: full and incremental runs, quality outputs, streaming and the command line."""

import glob
import random
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kelpline import cli
from kelpline.operators import bitemporal, cdc, keysets, quality
from kelpline.plans import composites, dates, loads
from kelpline.sources.contracts import GMV_TABLE, KEY_SETS, SNAPSHOT_TABLE, SOURCES
from kelpline.sources.csv_files import Load, folder_loads, item_lookup
from kelpline.sources.session import DROP_SHUFFLES, dropping_shuffles
from kelpline.sources.staged import StagedStore
from kelpline.sources.tables import TableStore, layer_tables, qualified
from kelpline.streaming.bronze import ingest

P = "transaction_datetime,transaction_date,purchase_id,buyer_id,prod_item_id,order_date,release_date,producer_id,purchase_partition,prod_item_partition,purchase_total_value,purchase_status"
FILES = {
    "purchase": f"""{P}
2023-01-01 10:00:00,2023-01-01,1,10,5,2023-01-01,2023-01-01,7,1,1,100.00,aprovada
2023-01-02 10:00:00,2023-01-02,2,11,6,2023-01-02,NULL,8,1,1,50.00,INICIADA
2023-01-04 10:00:00,2023-01-04,2,11,6,2023-01-02,2023-01-03,8,1,1,60.00,APROVADA
""",
    "product_item": "transaction_datetime,transaction_date,purchase_id,product_id,item_quantity,purchase_value\n2023-01-01 11:00:00,2023-01-01,1,9,3,100.00\n2023-01-02 11:00:00,2023-01-02,2,12,1,50.00\n",
    "purchase_extra_info": "transaction_datetime,transaction_date,purchase_id,subsidiary\n2023-01-01 12:00:00,2023-01-01,1,Nacional\n2023-01-03 12:00:00,2023-01-03,2,internacional\n",
}


BOTH = pytest.mark.parametrize("store", [TableStore, StagedStore], indirect=True)


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / f"{name}.txt").write_text(text)
    return str(tmp_path)


@pytest.fixture
def store(spark, request):
    s = getattr(request, "param", TableStore)(spark, f"t{uuid.uuid4().hex[:8]}")
    yield s
    spark.sql(f"DROP DATABASE IF EXISTS `{s.namespace}` CASCADE")


def gmv(store):
    rows = store.read(GMV_TABLE).orderBy("snapshot_date", "gmv_date", "subsidiary").collect()
    return [(r["snapshot_date"].day, r["gmv_date"].day, r["subsidiary"], r["gmv_daily_amount"], r["gmv_daily_item_quantity"], r["gmv_mtd_amount"]) for r in rows]


WANTED = [(d, 1, "nacional", 100.0, 3, 100.0) for d in (1, 2, 3, 4)] + [(4, 3, "internacional", 60.0, 1, 60.0)]


@BOTH
def test_full_refresh(spark, folder, store, capsys):
    done = loads.refresh(store, folder_loads(spark, folder), "b1")
    assert "optional file" in capsys.readouterr().out
    assert done["bronze"] == {"purchase": 3, "product_item": 2, "purchase_extra_info": 2} and done["snapshot"] == 7 and done["gmv"] == (5, True)
    assert gmv(store) == sorted(WANTED)
    assert store.current_gmv().count() == 2 == spark.table(store.name("vw_gmv_daily_by_subsidiary_current")).count()
    loads.load_bronze(store, folder_loads(spark, folder), "b2")  # a rerun resends everything
    again = loads.load_silver(store)
    assert again["purchase"] == 3 and {r[0] for r in store.read("silver_purchase_cdc").select("resend_duplicate_count").collect()} == {2}


def test_incremental_days_equal_a_full_refresh(spark, folder, store):
    for layer in ("bronze", "silver", "snapshot", "gmv"):
        store.prepare(layer)
    for day in (date(2023, 1, d) for d in (1, 2, 3, 4)):
        for _ in range(2 if day.day == 4 else 1):  # publishing a day again changes nothing
            batch = [x for x in folder_loads(spark, folder, day)]
            if _ == 0:
                loads.load_bronze(store, batch, f"b{day}")
            loads.load_silver(store, dates.INCREMENTAL, day)
            loads.load_snapshot(store, dates.INCREMENTAL, day)
            loads.load_gmv(store, dates.INCREMENTAL, day)
    assert gmv(store) == sorted(WANTED)
    full = {n: sorted(map(str, store.read(s.silver_table).drop("ingestion_ts", "batch_id").collect())) for n, s in SOURCES.items()}
    loads.load_silver(store)
    assert full == {n: sorted(map(str, store.read(s.silver_table).drop("ingestion_ts", "batch_id").collect())) for n, s in SOURCES.items()}
    with pytest.raises(ValueError):
        loads.load_silver(store, dates.INCREMENTAL)


@BOTH
def test_a_day_without_rows_loses_its_partition(spark, folder, store):
    loads.refresh(store, folder_loads(spark, folder), "b")
    day = date(2023, 1, 4)
    assert store.replace_day(store.read(GMV_TABLE).limit(0), GMV_TABLE, "snapshot_date", day) == 0
    assert gmv(store) == [r for r in sorted(WANTED) if r[0] != 4]
    assert store.read(SNAPSHOT_TABLE, day, "snapshot_date").count() == 2


def test_replacement_follows_its_mode(spark):
    store = TableStore(spark, f"t{uuid.uuid4().hex[:8]}")
    spark.sql(f"CREATE DATABASE `{store.namespace}`")
    spark.sql(f"CREATE TABLE {store.name('t')} (a INT, d DATE) USING parquet PARTITIONED BY (d)")
    rows = spark.sql("SELECT 1 AS a, DATE'2024-01-01' AS d UNION ALL SELECT 2, DATE'2024-01-02'")
    assert (store.replace_all(rows, "t"), store.replace_all(rows.where("a = 1"), "t"), store.read("t").count()) == (2, 1, 1)
    store.replace_all(rows, "t")
    assert (store.replace_partitions(rows.where("a = 1"), "t"), store.read("t").count()) == (1, 2)


def test_files(spark, folder, tmp_path):
    latest = item_lookup(folder_loads(spark, folder)[0].df)
    assert sorted(map(tuple, latest.collect())) == [(1, 5), (2, 6)]
    (tmp_path / "product_item.txt").write_text(FILES["product_item"].replace(",2,12,", ",77,12,"))
    with pytest.raises(ValueError, match="product item"):
        folder_loads(spark, folder)
    (tmp_path / "purchase.txt").unlink()
    with pytest.raises(FileNotFoundError):
        folder_loads(spark, folder)


def test_store_and_dates(store):
    assert qualified("n", "t", "c") == "`c`.`n`.`t`" and qualified("n", "t") == "`n`.`t`"
    with pytest.raises(ValueError):
        TableStore(store.spark, "")
    with pytest.raises(ValueError):
        layer_tables("x")
    store.prepare("ops", reset=True)
    assert store.tables() == ["ops_data_quality_quarantine", "ops_data_quality_results", "ops_pipeline_run_log"]
    assert dates.target_day("2024-03-01") == date(2024, 2, 29)
    for bad in ("2024-13-01", "x"):
        with pytest.raises(ValueError):
            dates.process_date(bad)
    with pytest.raises(ValueError):
        dates.check_mode("sometimes")
    with pytest.raises(ValueError, match="twice"):
        loads.load_bronze(store, [_load(store), _load(store)], "b")


def _load(store):
    return Load("purchase", store.spark.createDataFrame([], SOURCES["purchase"].schema))


def quality_of(tables):
    log, results, quarantine = quality.evaluate(tables, "r", evaluated_at="2024-01-01T00:00:00.5")
    return log.collect(), {(r["table_name"], r["rule_name"]): r for r in results.collect()}, quarantine.collect()


def test_clean_tables_pass_and_broken_ones_are_reported(spark, folder, store):
    loads.refresh(store, folder_loads(spark, folder), "b1")
    tables = {t: store.read(t) for t in quality.table_order()}
    log, results, quarantine = quality_of(tables)
    assert len(results) == 41 and len(log) == 11
    failed = {k[1] for k, r in results.items() if r["rule_status"] == "failed"}
    assert failed == {"bronze_freshness_lag_days"} and not quarantine  # the absent optional source
    assert log[-1]["table_name"] == "all_tables" and log[-1]["run_status"] == "completed_with_warnings" and log[-1]["input_row_count"] == 7

    one = F.col("purchase_id") == 2
    broken = dict(tables)
    broken["bronze_purchase_events"] = tables["bronze_purchase_events"].unionByName(tables["bronze_purchase_events"].limit(2)).withColumn("more", F.lit(1)).withColumn("transaction_date", F.when(one, None).otherwise(F.col("transaction_date")))
    broken["silver_purchase_cdc"] = tables["silver_purchase_cdc"].withColumn("purchase_status", F.when(one, "odd").otherwise(F.col("purchase_status"))).withColumn("purchase_total_value", F.lit(-1.0)).withColumn("is_ordering_valid", ~one).withColumn("has_extra_info_match", ~one)
    broken["silver_product_item_cdc"] = tables["silver_product_item_cdc"].unionByName(tables["silver_product_item_cdc"])
    snapshot = tables[SNAPSHOT_TABLE]
    broken[SNAPSHOT_TABLE] = snapshot.withColumn("is_metric_eligible", F.lit(True)).withColumn("has_product_item", ~one).withColumn("purchase_source_transaction_date", F.date_add("snapshot_date", 1)).unionByName(snapshot.limit(1))
    wild = tables[GMV_TABLE].where("subsidiary = 'nacional'").limit(1)
    swing = wild.withColumn("gmv_date", F.date_add("gmv_date", 1)).withColumn("gmv_daily_amount", F.lit(1000.0))
    broken[GMV_TABLE] = tables[GMV_TABLE].unionByName(wild).unionByName(swing).unionByName(wild.withColumn("gmv_daily_amount", F.lit(-5.0)))
    log, results, quarantine = quality_of(broken)
    failed = {k for k, r in results.items() if r["rule_status"] == "failed"}
    assert {rule for _, rule in failed} == {r.name for t in quality.table_order() for r in quality.rules_of(t)}
    eligibility = results[SNAPSHOT_TABLE, "gold_snapshot_metric_eligibility_contract"]
    assert eligibility["impacted_record_count"] >= 3 and eligibility["impacted_business_keys"] == sorted(eligibility["impacted_business_keys"])
    assert results["bronze_purchase_events", "bronze_raw_duplicate_rate"]["metric_value"] == pytest.approx(2 / 5)
    assert results[GMV_TABLE, "gold_gmv_daily_swing_anomaly"]["metric_value"] > 1.5
    assert log[-1]["run_status"] == "failed" and all(r["record_payload"].startswith("{") for r in quarantine)
    by_rule = {}
    for r in quarantine:
        by_rule[r["table_name"], r["rule_name"]] = by_rule.get((r["table_name"], r["rule_name"]), 0) + 1
    assert max(by_rule.values()) <= 5


def test_quality_is_published(spark, folder, store):
    loads.refresh(store, folder_loads(spark, folder), "b1")
    store.prepare("ops")
    summary = loads.load_quality(store, "run-1")
    assert (summary.run_status, summary.result_rows, summary.quarantine_rows) == ("completed_with_warnings", 41, 0)
    loads.load_quality(store, "run-2")
    assert store.read("ops_pipeline_run_log").count() == 22


def test_streamed_files(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    columns = SOURCES["purchase_extra_info"].payload
    (tmp_path / "in" / "a.csv").write_text(",".join(columns) + "\n1,1,nacional,2023-01-01 10:00:00,2023-01-01\n")
    store.prepare("bronze")
    for _ in range(2):  # files are taken once
        ingest(store, "purchase_extra_info", str(tmp_path / "in"), str(tmp_path / "check")).awaitTermination()
        assert store.read("bronze_purchase_extra_info_events").count() == 1


def test_command_line(spark, folder, capsys, tmp_path, monkeypatch):
    ns = f"c{uuid.uuid4().hex[:8]}"
    for layer in ("bronze", "silver", "snapshot", "gmv"):
        assert cli.main([layer, "--data-dir", folder, "--namespace", ns]) == 0
    assert cli.main(["silver", "--namespace", ns, "--mode", "incremental", "--process-date", "2023-01-05"]) == 0
    assert cli.main(["quality", "--namespace", ns]) == 0
    assert cli.main(["tables", "--namespace", ns]) == 0 and GMV_TABLE in capsys.readouterr().out
    (tmp_path / "s.sql").write_text(f"SELECT count(*) AS published FROM {ns}.{GMV_TABLE};")
    assert cli.main(["sql", str(tmp_path / "s.sql"), "--namespace", ns]) == 0 and "published" in capsys.readouterr().out
    monkeypatch.setattr("code.interact", lambda banner, local, exitmsg: print(banner, sorted(local)))
    assert cli.main(["console", "--namespace", ns]) == 0 and "['spark', 'store']" in capsys.readouterr().out
    spark.catalog.setCurrentDatabase("default")
    store = StagedStore(spark, ns)
    store.append(store.read(GMV_TABLE).limit(1).withColumn("gmv_daily_amount", F.lit(-1.0)), GMV_TABLE)
    assert cli.main(["quality", "--namespace", ns, "--reset"]) == 1
    spark.sql(f"DROP DATABASE `{ns}` CASCADE")


def test_readers_see_the_old_rows_until_the_new_ones_are_whole(spark, folder, monkeypatch):
    store = StagedStore(spark, f"s{uuid.uuid4().hex[:8]}")
    loads.refresh(store, folder_loads(spark, folder), "b")
    before, reader = gmv(store), store.read(GMV_TABLE).where("gmv_daily_amount > 0")
    seen, real = [], StagedStore._publish

    def look(self, table, generation, old):
        seen.append((gmv(self), self.read(generation).count()))  # written, not yet visible
        real(self, table, generation, old)

    monkeypatch.setattr(StagedStore, "_publish", look)
    one_day = store.read(GMV_TABLE, date(2023, 1, 4), "snapshot_date")
    changed = one_day.withColumn("gmv_daily_amount", F.lit(7.0))
    assert store.replace_partitions(changed, GMV_TABLE) == 2 and seen == [(before, 5)]
    monkeypatch.undo()
    assert reader.count() == 5  # began before, ends after
    assert [r[3] for r in gmv(store)] == [100.0, 100.0, 100.0, 7.0, 7.0]
    broken = store.read(GMV_TABLE).withColumn("gmv_daily_amount", F.raise_error(F.lit("torn")).cast("double"))
    for write in (store.replace_all, store.replace_partitions):
        with pytest.raises(Exception, match="torn"):
            write(broken, GMV_TABLE)
        assert [r[3] for r in gmv(store)] == [100.0, 100.0, 100.0, 7.0, 7.0]
    for amount in (1.0, 2.0, 3.0):  # older generations go, days that the new ones share stay
        store.replace_day(store.read(GMV_TABLE).withColumn("gmv_daily_amount", F.lit(amount)), GMV_TABLE, "snapshot_date", date(2023, 1, 3))
        assert [r[3] for r in gmv(store)] == [100.0, 100.0, amount, 7.0, 7.0]
    held = [t.name for t in spark.catalog.listTables(store.namespace) if t.name.startswith(f"{GMV_TABLE}__")]
    assert len(held) == 2 and store.tables() == sorted({*store.tables()}) and not any("__" in t for t in store.tables())
    spark.sql(f"DROP DATABASE `{store.namespace}` CASCADE")


@pytest.mark.parametrize("store", [StagedStore], indirect=True)
def test_a_day_from_the_day_before_reads_its_keys_only(spark, folder, store, monkeypatch):
    """Late events, items that change under several purchases, and keys that are first seen: each day equals one built from all history."""
    from kelpline.operators import bitemporal

    for layer in ("bronze", "silver", "snapshot"):
        store.prepare(layer)
    calls, real = [], bitemporal.next_snapshot
    monkeypatch.setattr(bitemporal, "next_snapshot", lambda *a, **k: calls.append(a[2]) or real(*a, **k))
    for day in (date(2023, 1, d) for d in (2, 3, 4)):
        loads.load_bronze(store, folder_loads(spark, folder, day), f"b{day}")
        loads.load_silver(store, dates.INCREMENTAL, day)
        loads.load_snapshot(store, dates.INCREMENTAL, day)
        got = store.read(SNAPSHOT_TABLE, day, "snapshot_date").drop("snapshot_created_at")
        want = bitemporal.purchase_snapshot(loads.read_layer(store, "silver"), None, day).drop("snapshot_created_at")
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert calls == [date(2023, 1, d) for d in (3, 4)]
    older = folder_loads(spark, folder, date(2023, 1, 2))[0]  # an older day's event comes late: all history is looked at
    loads.load_bronze(store, [replace(older, df=older.df.withColumn("buyer_id", F.lit(77)))], "late")
    loads.load_silver(store, dates.INCREMENTAL, date(2023, 1, 2))
    loads.load_snapshot(store, dates.INCREMENTAL, date(2023, 1, 4))
    assert len(calls) == 2


def test_filters_choose_the_days_to_read_and_key_sets_replace_history(spark, store):
    for layer in ("bronze", "silver"):
        store.prepare(layer)
    columns = SOURCES["purchase"].schema
    for d in (1, 2, 3, 4, 5, 20):
        day = date(2023, 1, d)
        rows = [Row(**{f.name: None for f in columns} | {"purchase_id": d * 100 + i, "purchase_partition": 1, "prod_item_id": d, "prod_item_partition": 1, "transaction_datetime": datetime(2023, 1, d), "transaction_date": day}) for i in range(5)]
        if d == 20:
            rows.append(Row(**rows[0].asDict() | {"purchase_id": 301}))  # a key of day 3
        loads.load_bronze(store, [Load("purchase", spark.createDataFrame([tuple(r[f.name] for f in columns) for r in rows], columns))], f"b{d}")
    bronze = loads.read_layer(store, "bronze")
    last = date(2023, 1, 20)
    days, history = loads.impacted_history(store, bronze, last)["purchase"]
    assert days == [date(2023, 1, 3), last]
    read = {f.split("transaction_date=")[1][:10] for f in history.inputFiles()}
    assert read == {"2023-01-03", "2023-01-20"} and history.count() == 11
    for _ in range(2):
        loads.load_silver(store, dates.INCREMENTAL, last)
    assert store.read("silver_purchase_cdc").count() == 11
    wanted = spark.createDataFrame([(301, 1), (9_999, 1)], "purchase_id bigint, purchase_partition bigint")
    assert loads.rows_near(store, bronze, "purchase", wanted, ("purchase_id", "purchase_partition")).select("transaction_date").distinct().count() == 2
    # references come from the key sets: the purchases' files aren't read for the items' flags
    items = loads.cdc.silver_frame(SOURCES["product_item"], bronze["product_item"], bronze, loads.known_keys(store))
    assert not any("bronze_purchase_events" in f for f in items.inputFiles()) and any("keys_purchase_by_prod_item_id" in f for f in items.inputFiles())
    kept = {h.table: sorted(map(tuple, store.read(h.table).select(*h.keys).collect())) for h in KEY_SETS}
    loads.ensure_keys(store, rebuild=True)
    assert kept == {h.table: sorted(map(tuple, store.read(h.table).select(*h.keys).collect())) for h in KEY_SETS} and len(kept["keys_purchase_by_purchase_id"]) == 30


def test_filters_never_miss_a_day(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(3000)]), rng.choice([None, 1, 2]), date(2023, 1, rng.randint(1, 30))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, transaction_date date")
    filters = keysets.day_filters(df, ["a", "b"]).withColumn("batch_id", F.lit("x"))
    for wanted in ([(rows[0][0], rows[0][1])], [r[:2] for r in rows[:7]], [(77_777, 1)], [(None, None)]):
        days = {r[0] for r in keysets.days_that_may_hold(filters, spark.createDataFrame(wanted, "a bigint, b bigint"), ["a", "b"]).collect()}
        true = {d for a, b, d in rows if (a, b) in wanted}
        assert true <= days and len(days - true) <= 1


def test_writes_of_a_catalog_of_its_own_change_no_setting(spark):
    """The second writer interface against an embedded database; whole days, which that can't replace, against a stand-in."""
    spark.conf.set("spark.sql.catalog.lake", "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    spark.conf.set("spark.sql.catalog.lake.url", f"jdbc:derby:memory:{uuid.uuid4().hex};create=true")
    spark.conf.set("spark.sql.catalog.lake.driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver")
    store = TableStore(spark, "APP", "lake")
    spark.sql("CREATE TABLE lake.APP.t (a BIGINT, d DATE)")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        rows = spark.range(100).select(F.col("id").alias("a"), F.lit(date(2024, 1, 1)).alias("d"))
        with ThreadPoolExecutor(4) as pool:
            assert sorted(pool.map(lambda i: store.append(rows.where(F.col("a") % 4 == i), "t"), range(4))) == [25] * 4
        assert store.read("t").count() == 100 and store.versioned and store.has("t")
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "static"
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}


def test_a_full_load_by_slices_is_whole_and_keeps_nothing_that_it_exchanged(spark, monkeypatch):
    """Small slices give the rows of a single write, those without a key too, and are published at once; shuffle files go with their query."""
    raw = composites.bronze(spark, "/root/testdata/sf0.001")
    keyless = raw["purchase"].where("purchase_id < 20").withColumn("purchase_id", F.lit(None).cast("bigint"))
    store = StagedStore(spark, f"s{uuid.uuid4().hex[:8]}")
    for layer in ("bronze", "keys", "silver", "snapshot"):
        store.prepare(layer)
    spark.conf.set(DROP_SHUFFLES, "false")  # as in a session that isn't ours
    monkeypatch.setattr(loads, "SLICE_ROWS", 900)
    parts, real, held = {}, StagedStore._insert, shuffle_files(spark)

    def insert(self, df, table, *rest):
        n = real(self, df, table, *rest)
        parts.setdefault(table.split("__")[0], []).append(n)
        return n

    monkeypatch.setattr(StagedStore, "_insert", insert)
    with dropping_shuffles(spark):
        loads.append_events(store, raw | {"purchase": raw["purchase"].unionByName(keyless)}, "b")
        written = loads.load_silver(store)
        days = loads.load_snapshot(store, created_at=composites.CREATED)
        for _ in range(100):
            if shuffle_files(spark) <= held:
                break
            time.sleep(0.1)
        assert shuffle_files(spark) <= held
    assert spark.conf.get(DROP_SHUFFLES) == "false"
    spark.conf.set(DROP_SHUFFLES, "true")
    assert (len(parts["silver_purchase_cdc"]), len(parts[SNAPSHOT_TABLE])) == (3, 5) and 0 < max(parts[SNAPSHOT_TABLE]) < days / 2
    assert written["purchase"] == sum(parts["silver_purchase_cdc"]) and days == sum(parts[SNAPSHOT_TABLE]) == store.read(SNAPSHOT_TABLE).count()

    def rows(df):
        return sorted(map(str, df.collect()))

    whole, silver = cdc.silver_frames(loads.read_layer(store, "bronze")), loads.read_layer(store, "silver")
    assert silver["purchase"].where("purchase_id is null").count() > 0
    for name in SOURCES:
        assert rows(silver[name]) == rows(whole[name].select(*silver[name].columns))
    one = bitemporal.purchase_snapshot(silver, composites.CREATED)
    assert rows(store.read(SNAPSHOT_TABLE)) == rows(one.select(*store.read(SNAPSHOT_TABLE).columns))
    assert all(f.endswith(".zstd.parquet") for f in store.read(SNAPSHOT_TABLE).inputFiles())
    torn = one.withColumn("snapshot_created_at", F.raise_error(F.lit("torn")).cast("timestamp"))
    with pytest.raises(Exception, match="torn"):
        store.replace_by([one, torn], SNAPSHOT_TABLE)  # the first part was written
    assert store.read(SNAPSHOT_TABLE).count() == days
    spark.sql(f"DROP DATABASE `{store.namespace}` CASCADE")
