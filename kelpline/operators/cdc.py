"""Change-data-capture operators: contract checks, enrichment, resends, versions, references and row quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..sources.contracts import METADATA, SOURCES, KeySet, Source, names, source

#: What was observed first: by time, rows without one last, then by batch and file (SQL, least first, nulls least).
FIRST = ("ingestion_ts is null", "ingestion_ts", "batch_id", "source_file")
ORDERING = ("transaction_datetime", "transaction_date", "ingestion_ts", "record_hash")


def check_columns(df: DataFrame, spec: Source) -> None:
    """Raise unless the frame has exactly the contract's columns."""
    missing, extra = [c for c in spec.payload if c not in df.columns], [c for c in df.columns if c not in spec.payload]
    if missing or extra:
        raise ValueError(f"{spec.name}: missing columns {missing}, unexpected columns {extra}")


def cast_to_contract(df: DataFrame, spec: Source) -> DataFrame:
    """Contract order and types; values that don't fit become null."""
    return df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in spec.schema))


def enrich(df: DataFrame, source_name: str, batch_id: str, source_file: str | None = None, ingestion_ts: datetime | str | None = None) -> DataFrame:
    """Contract columns plus ingestion time, batch, file and the payload's hash."""
    if not batch_id:
        raise ValueError("a batch id is needed")
    spec = source(source_name)
    check_columns(df, spec)
    when = F.current_timestamp() if ingestion_ts is None else F.lit(ingestion_ts).cast("timestamp")
    added = {"ingestion_ts": when, "batch_id": F.lit(batch_id), "source_file": F.lit(source_file).cast("string"), "record_hash": X.record_hash(spec.payload)}
    return cast_to_contract(df, spec).withColumns(added)


def collapse_resends(df: DataFrame, keys: Sequence[str], hash_col: str = "record_hash", first: Sequence[str] = FIRST) -> DataFrame:
    """One row per key and hash, the first observed, with ``resend_duplicate_count``.

    An aggregate: resends meet within a task before they are exchanged, so a payload that is sent again and again moves once a
    task.  ``first`` compares rows, the least is kept and nulls are least; rows that compare alike are alike but for columns
    outside it, of which one's are kept.  Null keys form a group like any value.
    """
    by = [*keys, hash_col]
    rest = [c for c in df.columns if c not in by]
    kept = F.min_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct(*(F.expr(x) for x in first)))
    found = df.groupBy(*by).agg(F.count(F.lit(1)).alias("resend_duplicate_count"), kept.alias("_kept"))
    return found.select(*(F.col(c) if c in by else F.col("_kept").getField(c).alias(c) for c in df.columns), "resend_duplicate_count")


def number_versions(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDERING) -> DataFrame:
    """``event_count_for_key``, ``event_version_number`` (oldest is 1) and ``event_latest_rank`` (newest is 1).

    The order is total once resends are collapsed, so the rank is count - version + 1 and needs no third window.
    """
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(*(F.col(c).asc_nulls_first() for c in order))).cast("bigint")
    numbered = df.withColumns({"event_count_for_key": F.count(F.lit(1)).over(w), "event_version_number": place})
    return numbered.withColumn("event_latest_rank", F.col("event_count_for_key") - F.col("event_version_number") + 1)


def with_exists_flag(df: DataFrame, other: DataFrame, keys: Sequence[str], their_keys: Sequence[str], flag: str, unique: bool = False) -> DataFrame:
    """``flag``: whether the keys occur in the other frame.  A null key never does.  ``unique``: the other frame is a set of keys."""
    known = other.select(*(F.col(t).alias(f"_{flag}_{i}") for i, t in enumerate(their_keys)))
    if not unique:
        known = known.where(X.all_present(f"_{flag}_{i}" for i in range(len(their_keys)))).distinct()
    same = X.all_true(F.col(k) == F.col(f"_{flag}_{i}") for i, k in enumerate(keys))
    return df.join(known.withColumn(flag, F.lit(True)), same, "left").select(*df.columns, F.coalesce(flag, F.lit(False)).alias(flag))


def assess(df: DataFrame, spec: Source) -> DataFrame:
    """Key and ordering completeness, quality flags and status of every row; rows are flagged, not dropped."""
    complete, dated = X.all_present(spec.keys), X.all_present(("transaction_datetime", "transaction_date"))
    conditions = {
        "missing_business_key": ~complete,
        "missing_transaction_datetime": F.col("transaction_datetime").isNull(),
        "missing_transaction_date": F.col("transaction_date").isNull(),
        "transaction_date_mismatch": F.to_date("transaction_datetime") != F.col("transaction_date"),
    }
    conditions |= {name: F.expr(condition) for name, condition in spec.rules.items()}
    conditions |= {link.missing_flag: X.all_present(link.keys) & ~F.col(link.flag) for link in spec.links}
    flagged = df.withColumns({"is_business_key_complete": complete, "is_ordering_valid": dated, "quality_flags": X.flags(conditions)})
    return flagged.withColumn("quality_status", X.status(~(complete & dated), F.size("quality_flags") > 0))


def standardize(bronze: DataFrame, spec: Source) -> DataFrame:
    """Bronze columns with cleaned text, without resends, with version numbers."""
    cleaned = bronze.select(*spec.payload, *names(METADATA)).withColumns({c: X.clean_text(c, case) for c, case in spec.clean.items()})
    return number_versions(collapse_resends(cleaned, spec.keys), spec.keys)


def silver_frame(spec: Source, own: DataFrame, bronze: Mapping[str, DataFrame], known: Mapping[KeySet, DataFrame] | None = None) -> DataFrame:
    """Silver rows of a source's own bronze rows, which may be those of some keys.

    References look at all history of the other source: at its ``known`` set of keys, if there is one, else at its rows.

    References by the source's own key come first: versions were numbered by it, so these rows needn't move again.
    """
    df = standardize(own, spec)
    for link in sorted(spec.links, key=lambda link: link.keys != spec.keys):
        held = (known or {}).get(KeySet(link.source, link.their_keys))
        df = with_exists_flag(df, bronze[link.source] if held is None else held, link.keys, link.their_keys, link.flag, held is not None)
    return assess(df, spec).select(*names(spec.silver_ddl))


def silver_frames(bronze: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Silver frames of all sources."""
    return {name: silver_frame(spec, bronze[name], bronze) for name, spec in SOURCES.items()}
