"""As-of operators: calendars, validity intervals, and the purchase snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..sources.contracts import ITEM_KEY, PURCHASE_KEY, SNAPSHOT, names
from .cdc import ORDERING


def usable(df: DataFrame) -> DataFrame:
    """Rows that can be placed in time."""
    return df.where("is_business_key_complete and is_ordering_valid")


def calendar(frames: Sequence[DataFrame], date_col: str = "transaction_date", name: str = "snapshot_date") -> DataFrame:
    """Every day from the first to the last date in any of the frames; none if they are empty."""
    dates = reduce(DataFrame.unionByName, (f.select(F.col(date_col).alias("d")) for f in frames))
    return dates.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias(name))


def last_date(frames: Sequence[DataFrame], date_col: str = "transaction_date") -> Column:
    """The last date in any of the frames, as a scalar subquery."""
    return reduce(DataFrame.unionByName, (f.select(F.col(date_col).alias("d")) for f in frames)).agg(F.max("d")).scalar()


def last_usable_date(silver: Mapping[str, DataFrame]) -> date | None:
    """The day that snapshots end with; None without rows that can be placed in time."""
    return reduce(DataFrame.unionByName, (usable(f).select("transaction_date") for f in silver.values())).agg(F.max("transaction_date")).first()[0]


def first_seen(df: DataFrame, keys: Sequence[str], date_col: str = "transaction_date") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(date_col).alias("first_date"))


def entity_days(df: DataFrame, keys: Sequence[str], last_day: Column, date_col: str = "transaction_date", name: str = "snapshot_date") -> DataFrame:
    """Each key on every day from its first one to ``last_day`` (no join; the guard keeps sequences from running backwards)."""
    bounded = first_seen(df, keys, date_col).withColumn("_last", last_day).where("first_date <= _last")
    return bounded.select(*keys, F.explode(F.sequence("first_date", "_last")).alias(name))


def _state(payload: Sequence[str], order: Sequence[str]) -> Column:
    """A row as a struct that compares by its order first; nulls order lowest."""
    return F.struct(*order, *(c for c in payload if c not in order))


def change_points(histories: Mapping[str, DataFrame], keys: Sequence[str], payloads: Mapping[str, Sequence[str]], order: Sequence[str] = ORDERING, date_col: str = "transaction_date") -> DataFrame:
    """Keys, ``valid_from``, ``valid_to`` (null: open) and one struct a history: its row with the highest order among those dated so far.

    A row a key and day on which any history has a row.  All histories go through one exchange and one sort: each of their rows is
    a point in time that sets one of the structs, and the maximum so far, ties of a day included, is the state from then on.  A
    row that arrives later but is ordered earlier never replaces a state.
    """
    points = [df.select(*keys, F.col(date_col).alias("valid_from"), _state(payloads[name], order).alias(name)) for name, df in histories.items()]
    in_time = Window.partitionBy(*keys).orderBy("valid_from")
    both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), points)
    so_far = {name: F.max(name).over(in_time) for name in histories}
    swept = both.withColumns(so_far | {"valid_to": F.lead("valid_from").over(in_time)})
    return swept.where("valid_to is null or valid_to > valid_from").select(*keys, "valid_from", "valid_to", *histories)


def states_on(histories: Mapping[str, DataFrame], keys: Sequence[str], payloads: Mapping[str, Sequence[str]], day: date, order: Sequence[str] = ORDERING, date_col: str = "transaction_date") -> DataFrame:
    """Keys and one struct a history as known on one day: an aggregate that combines before its only exchange."""
    rows = [df.where(F.col(date_col) <= F.lit(day)).select(*keys, _state(payloads[name], order).alias(name)) for name, df in histories.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows).groupBy(*keys).agg(*(F.max(name).alias(name) for name in histories))


def validity(df: DataFrame, keys: Sequence[str], payload: Sequence[str], order: Sequence[str] = ORDERING, date_col: str = "transaction_date") -> DataFrame:
    """The change points of one history, with ``state``."""
    return change_points({"state": df}, keys, {"state": payload}, order, date_col)


def cut_by(points: DataFrame, intervals: DataFrame, keys: Mapping[str, str], name: str) -> DataFrame:
    """Interval rows cut where the state of other keys changes, with that state as ``name`` (null before the first and without keys).

    The other keys' intervals are given a beginning without a state, so that together they cover all time, and every pair of
    intervals with something in common gives a row.  A key that many rows share is divided by the engine's skew join.
    """
    begins = Window.partitionBy(*keys.values()).orderBy("valid_from")
    own = F.struct(F.col("valid_from").alias("f"), F.col("valid_to").alias("t"), "state")
    before = F.struct(F.lit(None).cast("date").alias("f"), F.col("valid_from").alias("t"), F.lit(None).cast(intervals.schema["state"].dataType).alias("state"))
    placed = intervals.withColumn("_first", F.lag("valid_from").over(begins).isNull()).withColumn("_span", F.explode(F.when(F.col("_first"), F.array(before, own)).otherwise(F.array(own))))
    other = placed.select(*(F.col(t).alias(f"_key{i}") for i, t in enumerate(keys.values())), F.col("_span.state").alias(name), F.col("_span.f").alias("_from"), F.col("_span.t").alias("_to"))
    meets = (F.col("_from").isNull() | F.col("valid_to").isNull() | (F.col("_from") < F.col("valid_to"))) & (F.col("_to").isNull() | (F.col("_to") > F.col("valid_from")))
    same = X.all_true(F.col(k) == F.col(f"_key{i}") for i, k in enumerate(keys))
    both = points.join(other, same & meets, "left")
    kept = [c for c in points.columns if c not in ("valid_from", "valid_to")]
    return both.select(*kept, F.greatest("valid_from", "_from").alias("valid_from"), F.least("valid_to", "_to").alias("valid_to"), name)


def covers(day: Column, side: str) -> Column:
    return (F.col(f"{side}.valid_from") <= day) & (F.col(f"{side}.valid_to").isNull() | (day < F.col(f"{side}.valid_to")))


def as_of(base: DataFrame, intervals: DataFrame, keys: Mapping[str, str], day: str, name: str) -> DataFrame:
    """The base with ``name``: the state valid on ``day`` for its keys, null without one or where a key is null.

    Days and the intervals' beginnings go through one window in order of time, and each day takes the last state before it, so a
    key costs its days plus its versions, not their product.  Days without a key are spread by their values.
    """
    own = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    spread = F.when(X.all_present(keys), F.lit(0)).otherwise(F.xxhash64(day, *(F.col(c) for c in base.columns if base.schema[c].dataType.typeName() not in ("map", "variant"))))
    days = base.select(F.struct(*(F.col(f"`{c}`") for c in base.columns)).alias("_row"), F.col(day).alias("_day"), *own, spread.cast("bigint").alias("_spread"))
    begins = intervals.select(F.col("valid_from").alias("_day"), *(F.col(t).alias(f"_key{i}") for i, t in enumerate(keys.values())), F.lit(0).cast("bigint").alias("_spread"), F.col("state").alias("_state"))
    both = days.unionByName(begins, allowMissingColumns=True)
    in_time = Window.partitionBy("_spread", *(f"_key{i}" for i in range(len(keys)))).orderBy("_day", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("_state", F.last("_state", ignorenulls=True).over(in_time)).where("_row is not null")
    present = X.all_present(f"_key{i}" for i in range(len(keys)))
    return known.select(*(F.col("_row").getField(c).alias(c) for c in base.columns), F.when(present, F.col("_state")).alias(name))


def as_of_by_rank(base: DataFrame, rows: DataFrame, keys: Sequence[str], day: str, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The literal form (join all earlier rows, rank, keep the first), which tests hold the intervals against."""
    right = rows.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"_{c}") for c in dict.fromkeys([*order, *payload, "transaction_date"])))
    same = X.all_true(F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)) & (F.col("_transaction_date") <= F.col(day))
    w = Window.partitionBy(day, *keys).orderBy(*(F.col(f"_{c}").desc_nulls_last() for c in order))
    ranked = base.join(right, same, "left").withColumn("_place", F.row_number().over(w)).where("_place = 1")
    return ranked.select(*base.columns, *(F.col(f"_{c}").alias(c) for c in payload))


_CARRIED = ("quality_status", "quality_flags")
_PAYLOADS = {
    "purchase": ("buyer_id", "producer_id", "purchase_status", "order_date", "release_date", "purchase_total_value", "prod_item_id", "prod_item_partition"),
    "product_item": ("product_id", "item_quantity", "purchase_value"),
    "purchase_extra_info": ("subsidiary",),
    "order_transaction_cost_hist": ("order_transaction_cost_vat_value", "order_transaction_cost_installment_value", "order_transaction_cost_date"),
}
#: Metric eligibility, over the snapshot's columns; unknown parts make it false.
ELIGIBLE = (
    "coalesce(has_purchase and has_product_item and has_extra_info and subsidiary is not null and purchase_status = 'APROVADA' and release_date is not null"
    " and purchase_total_value >= 0 and purchase_quality_status <> 'error' and coalesce(product_item_quality_status, '') <> 'error'"
    " and coalesce(purchase_extra_info_quality_status, '') <> 'error', false)"
)
DERIVED_FLAGS = {
    "missing_purchase_snapshot": "not has_purchase",
    "missing_product_item_snapshot": "not has_product_item",
    "missing_purchase_extra_info_snapshot": "not has_extra_info",
    "missing_subsidiary_snapshot": "has_extra_info and subsidiary is null",
    "missing_purchase_status_snapshot": "purchase_status is null",
    "metric_ineligible_purchase_status": "purchase_status <> 'APROVADA'",
    "missing_release_date_snapshot": "release_date is null",
    "missing_purchase_total_value_snapshot": "purchase_total_value is null",
    "negative_purchase_total_value_snapshot": "purchase_total_value < 0",
}
_HAS = {"purchase": "has_purchase", "product_item": "has_product_item", "purchase_extra_info": "has_extra_info", "order_transaction_cost_hist": "has_order_transaction_cost_hist"}


#: Sources that share the purchase's key.
_OWN = tuple(s for s in _PAYLOADS if s != "product_item")


def _carried(name: str) -> tuple[str, ...]:
    return (*_PAYLOADS[name], *_CARRIED)


def snapshot_intervals(silver: Mapping[str, DataFrame], created_at: str | None = None) -> DataFrame:
    """Every purchase's judged state as intervals [``valid_from``, ``valid_to``), the last one open: a row a change, not a day.

    Two exchanges of the purchases: one by their key, for the three sources that share it, one by the key of the item that they
    have at the time.
    """
    own = change_points({s: usable(silver[s]) for s in _OWN}, PURCHASE_KEY, {s: _carried(s) for s in _OWN}).where("purchase is not null")
    items = validity(usable(silver["product_item"]), ITEM_KEY, _carried("product_item"))
    return _judged(cut_by(own, items, {f"purchase.{k}": k for k in ITEM_KEY}, "product_item"), ("valid_from", "valid_to"), created_at)


def _judged(states: DataFrame, kept: Sequence[str], created_at: str | None) -> DataFrame:
    """The snapshot's columns, but its day, of rows with one struct a source."""
    stamp = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    wide = states.select(
        *kept,
        *PURCHASE_KEY,
        stamp.alias("snapshot_created_at"),
        F.col("purchase.release_date").alias("gmv_date"),
        *(F.col(f"{s}.{c}").alias(c) for s, columns in _PAYLOADS.items() for c in columns),
        *(F.col(s).isNotNull().alias(flag) for s, flag in _HAS.items()),
        *(F.col(f"{s}.quality_status").alias(f"{s}_quality_status") for s in _PAYLOADS),
        *(F.col(f"{s}.{c}").alias(f"{s}_source_{c}") for s in _PAYLOADS for c in ("transaction_datetime", "transaction_date", "record_hash")),
        *(F.col(f"{s}.quality_flags").alias(f"_{s}") for s in _PAYLOADS),
    )
    return judge_snapshot(wide, {s: f"_{s}" for s in _PAYLOADS}).drop(*(f"_{s}" for s in _PAYLOADS))


def purchase_snapshot(silver: Mapping[str, DataFrame], created_at: str | None = None, day: date | None = None, part: tuple[int, int] = (0, 1), last: date | None = None) -> DataFrame:
    """Every purchase's state as known on each day since it was first seen, or on one ``day``.

    All days are the intervals, judged and then exploded; one day is an aggregate of what was known by then.  ``part`` (i, n):
    all days of the purchases of the i-th of n slices.  ``last``: the last day, if it was looked up before.
    """
    if day is None:
        intervals = snapshot_intervals({s: f.where(X.in_slice(PURCHASE_KEY, *part)) if s in _OWN else f for s, f in silver.items()}, created_at)
        end = last_date([usable(f) for f in silver.values()]) if last is None else F.lit(last)
        until = F.coalesce(F.date_sub("valid_to", 1), end)
        # the generator can't read a subquery, so the end is a column first
        days = intervals.withColumn("_until", until).where("valid_from <= _until").withColumn("snapshot_date", F.explode(F.sequence("valid_from", "_until")))
        return days.select(*names(SNAPSHOT))
    own = states_on({s: usable(silver[s]) for s in _OWN}, PURCHASE_KEY, {s: _carried(s) for s in _OWN}, day).where("purchase is not null")
    items = states_on({"product_item": usable(silver["product_item"])}, ITEM_KEY, {"product_item": _carried("product_item")}, day).withColumnsRenamed({k: f"_{k}" for k in ITEM_KEY})
    both = own.join(items, X.all_true(F.col(f"purchase.{k}") == F.col(f"_{k}") for k in ITEM_KEY), "left").withColumn("snapshot_date", F.lit(day))
    return _judged(both, ("snapshot_date",), created_at).select(*names(SNAPSHOT))


def changed_purchases(yesterday: DataFrame, silver: Mapping[str, DataFrame], day: date) -> DataFrame:
    """Keys of the purchases that an event of ``day`` touches: one of their own, or one of the item that they had the day before.

    This covers reference flags too.  They flip when a key is first seen, and then it is either the purchase's own key, or that of
    an item, which its purchases have; an item's own flag was set by the first of them.
    """
    today = {n: f.where(F.col("transaction_date") == F.lit(day)) for n, f in silver.items()}
    items = today["product_item"].select(*ITEM_KEY).where(X.all_present(ITEM_KEY)).distinct()
    own = [today[s].select(*PURCHASE_KEY).where(X.all_present(PURCHASE_KEY)) for s in _OWN]
    return reduce(DataFrame.unionByName, [*own, yesterday.join(items, list(ITEM_KEY), "left_semi").select(*PURCHASE_KEY)]).distinct()


def next_snapshot(yesterday: DataFrame, silver: Mapping[str, DataFrame], day: date, created_at: str | None = None, changed: DataFrame | None = None) -> DataFrame:
    """The snapshot of ``day`` from the rows published for the day before it.

    Purchases that nothing happened to are carried forward as they are; the others (``changed_purchases``, or ``changed``) are
    computed again from their own history.  Equals ``purchase_snapshot(silver, created_at, day)`` if all rows that came since
    are dated ``day``, whatever times they carry; after older days were loaded again, use that.
    """
    keys = changed_purchases(yesterday, silver, day) if changed is None else changed
    stamp = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    carried = yesterday.join(keys, list(PURCHASE_KEY), "left_anti").withColumns({"snapshot_date": F.lit(day), "snapshot_created_at": stamp})
    again = {s: silver[s].join(keys, list(PURCHASE_KEY), "left_semi") for s in _OWN}
    again["product_item"] = silver["product_item"].join(again["purchase"].select(*ITEM_KEY).distinct(), list(ITEM_KEY), "left_semi")
    return carried.select(*names(SNAPSHOT)).unionByName(purchase_snapshot(again, created_at, day))


def judge_snapshot(wide: DataFrame, flag_columns: Mapping[str, str]) -> DataFrame:
    """Merged flags, status and eligibility of snapshot rows."""
    derived = X.flags({name: F.expr(condition) for name, condition in DERIVED_FLAGS.items()})
    bad = X.any_true(F.coalesce(F.col(f"{s}_quality_status") == X.ERROR, F.lit(False)) for s in flag_columns) | ~F.col("has_purchase")
    flagged = wide.withColumns({"quality_flags": X.inherit(derived, {s: F.col(c) for s, c in flag_columns.items()}), "is_metric_eligible": F.expr(ELIGIBLE)})
    return flagged.withColumn("quality_status", X.status(bad, F.size("quality_flags") > 0))
