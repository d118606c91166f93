"""Layer by layer: what a full refresh or an incremental run reads, computes and publishes.  Every frame is executed once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from functools import reduce
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import bitemporal, cdc, impact, keysets, metrics, quality
from ..sources.contracts import FILTERS_TABLE, GMV_TABLE, ITEM_KEY, KEY_SETS, OPS_TABLES, PURCHASE_KEY, SNAPSHOT_TABLE, SOURCES, KeySet
from ..sources.csv_files import Load
from ..sources.tables import TableStore, require_unique
from .dates import FULL, INCREMENTAL, check_mode

T = TypeVar("T")
#: A full load goes by slices of keys of about so many rows, up to so many slices, as what a slice exchanges lies on disk until it
#: is written.  Each slice reads the layer before again, and items' versions, which all purchases may need.
SLICE_ROWS, MOST_SLICES = 1_000_000, 8


def each(store: TableStore, f: Callable[[str], T], names: Iterable[str]) -> dict[str, T]:
    """``f`` of every name; side by side where loads of different tables don't disturb each other."""
    names = list(names)
    if not store.side_by_side or len(names) < 2:
        return {n: f(n) for n in names}
    with ThreadPoolExecutor(len(names)) as pool:
        return dict(zip(names, pool.map(f, names)))


def slices(store: TableStore, frames: Iterable[DataFrame]) -> list[tuple[int, int]]:
    """(i, n) of the slices of keys that the frames' rows are taken in; one where a replacement is a single write."""
    n = min(MOST_SLICES, max(1, -(-sum(f.count() for f in frames) // SLICE_ROWS))) if store.in_parts else 1
    return [(i, n) for i in range(n)]


def load_bronze(store: TableStore, loads: Iterable[Load], batch_id: str, ingestion_ts: datetime | str | None = None) -> dict[str, int]:
    """Append raw events; reruns append again, which silver absorbs."""
    loads = list(loads)
    require_unique(load.source_name for load in loads)
    ensure_keys(store)
    return append_events(store, {x.source_name: cdc.enrich(x.df, x.source_name, batch_id, x.source_file, ingestion_ts) for x in loads}, batch_id)


def append_events(store: TableStore, events: Mapping[str, DataFrame], batch_id: str) -> dict[str, int]:
    """Append a batch of some sources, then what it adds to key sets and, all sources in one write, to day filters.

    A run that ends in between leaves keys out until the batch is loaded again or silver is refreshed in full.
    """

    def one(name: str) -> int:
        written = store.append(events[name], SOURCES[name].bronze_table)
        for held in KEY_SETS:
            if held.source == name and written:
                store.append(keysets.new_keys(events[name], store.read(held.table), held.keys).withColumn("batch_id", F.lit(batch_id)), held.table)
        return written

    written = each(store, one, events)
    filters = [_filters(events[name], name, keys, batch_id) for name, n in written.items() if n for keys in filtered_keys(name)]
    if filters:
        store.append(reduce(DataFrame.unionByName, filters), FILTERS_TABLE)
    return written


def filtered_keys(name: str) -> list[tuple[str, ...]]:
    """The keys that a source's days are looked up by: its own, and those that others refer to."""
    return list(dict.fromkeys([SOURCES[name].keys, *(k.keys for k in KEY_SETS if k.source == name)]))


def _filters(events: DataFrame, name: str, keys: tuple[str, ...], batch_id: str) -> DataFrame:
    return keysets.day_filters(events, keys).withColumns({"source": F.lit(name), "key_name": F.lit(keys[0]), "batch_id": F.lit(batch_id)})


def ensure_keys(store: TableStore, rebuild: bool = False) -> None:
    """Make key sets and day filters of the raw events that are there, unless there are some (or with ``rebuild``)."""
    if store.has(FILTERS_TABLE) and not rebuild:
        return
    store.prepare("keys")
    bronze = read_layer(store, "bronze")
    parts = [_filters(df, name, keys, "all") for name, df in bronze.items() for keys in filtered_keys(name)]
    made = {FILTERS_TABLE: reduce(DataFrame.unionByName, parts)}
    for held in KEY_SETS:
        rows = bronze[held.source]
        made[held.table] = rows.select(*held.keys).where(X.all_present(held.keys)).distinct().withColumn("batch_id", F.lit("all"))
    each(store, lambda table: store.replace_all(made[table], table), made)


def rows_near(store: TableStore, bronze: Mapping[str, DataFrame], name: str, wanted: DataFrame, keys: Sequence[str], also: Iterable[date] = ()) -> DataFrame:
    """A source's rows of the days that may hold one of the wanted keys, of days given, and without a day; all without filters."""
    if not store.has(FILTERS_TABLE):
        return bronze[name]
    filters = store.read(FILTERS_TABLE).where((F.col("source") == name) & (F.col("key_name") == keys[0]))
    days = {*impact.dates_of(keysets.days_that_may_hold(filters, wanted, keys)), *also}
    return bronze[name].where(F.col("transaction_date").isin(*days) | F.col("transaction_date").isNull())


def read_layer(store: TableStore, layer: str) -> dict[str, DataFrame]:
    return {name: store.read(getattr(spec, f"{layer}_table")) for name, spec in SOURCES.items()}


def load_silver(store: TableStore, mode: str = FULL, day: date | None = None) -> dict[str, int]:
    """Replace silver, slice by slice of each source's keys, or only the days that hold rows of keys impacted on ``day``.

    An incremental run numbers versions only of keys that have a row on one of these days, looks for them only on days whose
    filters may hold them, and takes references from the key sets.
    """
    bronze = read_layer(store, "bronze")
    if check_mode(mode) == FULL:
        if store.has(FILTERS_TABLE):
            ensure_keys(store, rebuild=True)
        held = known_keys(store)

        def replace(name: str) -> int:
            spec, rows = SOURCES[name], bronze[name]
            return store.replace_by([cdc.silver_frame(spec, rows.where(X.in_slice(spec.keys, *part)), bronze, held) for part in slices(store, [rows])], spec.silver_table)

        return each(store, replace, SOURCES)
    if day is None:
        raise ValueError("an incremental run needs its day")
    found, known = impacted_history(store, bronze, day), known_keys(store)

    def publish(name: str) -> int:
        days, history = found[name]
        return store.replace_partitions(impact.on_dates(cdc.silver_frame(SOURCES[name], history, bronze, known), days), SOURCES[name].silver_table)

    return each(store, publish, found)


def known_keys(store: TableStore) -> dict[KeySet, DataFrame]:
    return {held: store.read(held.table) for held in KEY_SETS} if store.has(FILTERS_TABLE) else {}


def impacted_history(store: TableStore, bronze: Mapping[str, DataFrame], day: date) -> dict[str, tuple[list[date], DataFrame]]:
    """Of each source, the days to publish again and all rows of the keys that these hold."""
    keys = impact.impacted_keys(bronze, day, lambda items: rows_near(store, bronze, "purchase", items, ITEM_KEY, [day]))

    def of(name: str) -> tuple[list[date], DataFrame]:
        spec = SOURCES[name]
        near = rows_near(store, bronze, name, keys[name], spec.keys, [day])
        days = impact.dates_of(impact.touched_dates(near, keys[name], spec.keys, day))
        among = rows_near(store, bronze, name, impact.keys_on(bronze[name], spec, days), spec.keys, days)
        return days, impact.history_of(bronze[name], spec, days, among)

    return each(store, of, SOURCES)


def load_snapshot(store: TableStore, mode: str = FULL, day: date | None = None, created_at: str | None = None) -> int:
    """All days, or one: from the day before it, if that is published and nothing older came since, else from all history."""
    silver = read_layer(store, "silver")
    if check_mode(mode) == FULL:
        stamp = created_at or datetime.now(timezone.utc).isoformat()  # the same in every slice
        own, last = [f for n, f in silver.items() if SOURCES[n].keys == PURCHASE_KEY], bitemporal.last_usable_date(silver)
        return store.replace_by([bitemporal.purchase_snapshot(silver, stamp, part=part, last=last) for part in slices(store, own)], SNAPSHOT_TABLE)
    if day is None:
        raise ValueError("an incremental run needs its day")
    yesterday = store.read(SNAPSHOT_TABLE, day - timedelta(1), "snapshot_date")
    published = yesterday.agg(F.min("snapshot_created_at")).first()[0]
    if published is None or came_since(silver, published, day):
        rows = bitemporal.purchase_snapshot(silver, created_at, day)
    else:
        rows = bitemporal.next_snapshot(yesterday, silver, day, created_at)
    return store.replace_day(rows, SNAPSHOT_TABLE, "snapshot_date", day)


def came_since(silver: Mapping[str, DataFrame], published: datetime, day: date) -> bool:
    """Whether rows of days before ``day`` were taken in after that time."""
    late = [f.where((F.col("transaction_date") < F.lit(day)) & (F.coalesce(F.col("ingestion_ts") >= F.lit(published), F.lit(True)))).select("transaction_date") for f in silver.values()]
    return not reduce(DataFrame.unionAll, late).isEmpty()


def load_gmv(store: TableStore, mode: str = FULL, day: date | None = None) -> tuple[int, bool]:
    """Rows published, and whether the view of the newest snapshot exists."""
    if check_mode(mode) == FULL:
        rows = store.replace_all(metrics.gmv_daily(store.read(SNAPSHOT_TABLE)), GMV_TABLE)
    else:
        if day is None:
            raise ValueError("an incremental run needs its day")
        rows = store.replace_day(metrics.gmv_daily(store.read(SNAPSHOT_TABLE, day, "snapshot_date")), GMV_TABLE, "snapshot_date", day)
    return rows, store.refresh_current_view()


@dataclass(frozen=True)
class QualitySummary:
    run_status: str
    error_count: int
    warning_count: int
    result_rows: int
    quarantine_rows: int


def append_outputs(store: TableStore, outputs: Sequence[DataFrame]) -> dict[str, int]:
    """Append run log, results and quarantine; returns the rows written of each."""
    return {table: store.append(df.withColumn(f"{stamp[:-3]}_date", F.to_date(stamp)), table) for (table, (_, stamp)), df in zip(OPS_TABLES.items(), outputs)}


def load_quality(store: TableStore, run_id: str, pipeline_name: str = quality.PIPELINE, sample_limit: int = quality.SAMPLE_LIMIT) -> QualitySummary:
    """Evaluate all rules and append run log, results and quarantine."""
    tables = {t: store.read(t) for t in quality.table_order()}
    outputs = quality.evaluate(tables, run_id, pipeline_name, sample_limit=sample_limit)
    written = append_outputs(store, outputs)
    whole = outputs[0].where("table_name = 'all_tables'").first()
    return QualitySummary(whole["run_status"], whole["error_result_count"], whole["warning_result_count"], written["ops_data_quality_results"], written["ops_data_quality_quarantine"])


def refresh(store: TableStore, loads: Iterable[Load], batch_id: str, mode: str = FULL, day: date | None = None, created_at: str | None = None, ingestion_ts: datetime | str | None = None) -> dict[str, object]:
    """All layers in order."""
    full = check_mode(mode) == FULL
    for layer in ("bronze", "silver", "snapshot", "gmv", *(["keys"] if full else [])):
        store.prepare(layer, reset=full)
    return {
        "bronze": load_bronze(store, loads, batch_id, ingestion_ts),
        "silver": load_silver(store, mode, day),
        "snapshot": load_snapshot(store, mode, day, created_at),
        "gmv": load_gmv(store, mode, day),
    }


__all__ = ["FULL", "INCREMENTAL", "QualitySummary", "load_bronze", "load_gmv", "load_quality", "load_silver", "load_snapshot", "refresh"]
