"""What an incremental run has to publish again, found in the raw events alone."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..sources.contracts import ITEM_KEY, PURCHASE_KEY, Source


def keys_of(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).where(X.all_present(keys)).distinct()


def union_keys(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def impacted_keys(bronze: Mapping[str, DataFrame], day: date, history: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Keys of each source whose rows may change because of what arrived on ``day``, directly or over a reference.

    ``history`` gives the purchases to look for given item keys in; all of them, if there is none.
    """
    today = {n: f.where(F.col("transaction_date") == F.lit(day)) for n, f in bronze.items()}
    purchases, extras, costs = (keys_of(today[n], PURCHASE_KEY) for n in ("purchase", "purchase_extra_info", "order_transaction_cost_hist"))
    items = keys_of(today["product_item"], ITEM_KEY)
    purchases_ever = history(items) if history else bronze["purchase"]
    over_items = keys_of(purchases_ever.join(items, list(ITEM_KEY), "left_semi"), PURCHASE_KEY)
    return {
        "purchase": union_keys(purchases, extras, over_items),
        "product_item": union_keys(items, keys_of(today["purchase"], ITEM_KEY)),
        "purchase_extra_info": union_keys(extras, purchases),
        "order_transaction_cost_hist": union_keys(costs, purchases),
    }


def touched_dates(rows: DataFrame, keys: DataFrame, by: Sequence[str], day: date, date_col: str = "transaction_date") -> DataFrame:
    """Every date that holds a row of an impacted key, and ``day`` if it holds a row without a complete key."""
    impacted = rows.join(keys, list(by), "left_semi").select(date_col)
    incomplete = rows.where((F.col(date_col) == F.lit(day)) & ~X.all_present(by)).select(date_col)
    return impacted.unionByName(incomplete).distinct()


def on_dates(rows: DataFrame, dates: Sequence[date], date_col: str = "transaction_date") -> DataFrame:
    """Rows of the given dates; of a table partitioned by date, only these are read."""
    return rows.where(F.col(date_col).isin(*dates)) if dates else rows.where("false")


def keys_on(rows: DataFrame, spec: Source, dates: Sequence[date]) -> DataFrame:
    """Keys that have a row on one of the dates; null keys count as keys."""
    return on_dates(rows, dates).select(*spec.keys).distinct()


def history_of(rows: DataFrame, spec: Source, dates: Sequence[date], among: DataFrame | None = None) -> DataFrame:
    """All rows, of whatever date, of the keys that have a row on one of the dates, found ``among`` some rows that hold them all."""
    keys = keys_on(rows, spec, dates).withColumnsRenamed({k: f"_{k}" for k in spec.keys})
    return (rows if among is None else among).join(keys, X.all_true(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in spec.keys), "left_semi")


def dates_of(frame: DataFrame) -> list[date]:
    """A frame of distinct days, which a century has 36,525 of, as a list."""
    return sorted(r[0] for r in frame.collect() if r[0] is not None)
