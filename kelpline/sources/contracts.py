"""One declarative contract a source; tables, column orders, DDL and rules all follow from it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql.types import StructType

# Names and types that published tables must have.
STATUSES = ("APROVADA", "CANCELADA", "INICIADA", "REEMBOLSADA")
METADATA = "ingestion_ts timestamp, batch_id string, source_file string, record_hash string"
TECHNICAL = "resend_duplicate_count bigint, event_count_for_key bigint, event_version_number bigint, event_latest_rank bigint, is_business_key_complete boolean, is_ordering_valid boolean"
SNAPSHOT = (
    "snapshot_date date, snapshot_created_at timestamp, quality_status string, quality_flags array<string>, purchase_id bigint, purchase_partition bigint, "
    "buyer_id bigint, producer_id bigint, purchase_status string, order_date date, release_date date, gmv_date date, purchase_total_value double, prod_item_id bigint, "
    "prod_item_partition bigint, product_id bigint, item_quantity int, purchase_value double, subsidiary string, order_transaction_cost_vat_value double, "
    "order_transaction_cost_installment_value double, order_transaction_cost_date date, has_purchase boolean, has_product_item boolean, has_extra_info boolean, "
    "has_order_transaction_cost_hist boolean, is_metric_eligible boolean, purchase_quality_status string, product_item_quality_status string, "
    "purchase_extra_info_quality_status string, order_transaction_cost_hist_quality_status string"
) + "".join(f", {s}_source_transaction_datetime timestamp, {s}_source_transaction_date date, {s}_source_record_hash string" for s in ("purchase", "product_item", "purchase_extra_info", "order_transaction_cost_hist"))
GMV = "snapshot_date date, gmv_date date, subsidiary string, gmv_daily_amount double, gmv_daily_purchase_count bigint, gmv_daily_item_quantity bigint, gmv_mtd_amount double, quality_status string, snapshot_created_at timestamp"
RUN_LOG = "run_id string, pipeline_name string, layer_name string, table_name string, run_status string, started_at timestamp, finished_at timestamp, input_row_count bigint, output_row_count bigint, latest_transaction_date date, latest_snapshot_date date, error_result_count bigint, warning_result_count bigint, details string"
RESULTS = "run_id string, pipeline_name string, layer_name string, table_name string, rule_name string, severity string, rule_status string, evaluated_at timestamp, transaction_date date, snapshot_date date, metric_value double, threshold_value double, impacted_record_count bigint, impacted_business_keys array<string>, description string"
QUARANTINE = "run_id string, pipeline_name string, layer_name string, table_name string, rule_name string, severity string, captured_at timestamp, transaction_date date, snapshot_date date, business_key string, record_payload string"

SNAPSHOT_TABLE = "gold_purchase_state_snapshot"
GMV_TABLE = "gold_gmv_daily_by_subsidiary_snapshot"
GMV_VIEW = "vw_gmv_daily_by_subsidiary_current"
OPS_TABLES = {"ops_pipeline_run_log": (RUN_LOG, "finished_at"), "ops_data_quality_results": (RESULTS, "evaluated_at"), "ops_data_quality_quarantine": (QUARANTINE, "captured_at")}


def names(ddl: str) -> list[str]:
    return schema_of(ddl).fieldNames()


def schema_of(ddl: str) -> StructType:
    """A struct type from DDL without a running session."""
    from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, TimestampType

    kinds = {"binary": BinaryType, "bigint": LongType, "int": IntegerType, "double": DoubleType, "string": StringType, "date": DateType, "timestamp": TimestampType, "boolean": BooleanType}
    fields = []
    for part in ddl.split(", "):
        name, kind = part.split()
        required = kind.endswith("!")
        kind = kind.rstrip("!")
        fields.append(StructField(name, ArrayType(StringType()) if kind == "array<string>" else kinds[kind](), not required))
    return StructType(fields)


@dataclass(frozen=True)
class Link:
    """A reference flag: true where ``keys`` occur as ``their_keys`` among all rows of ``source``."""

    flag: str
    source: str
    keys: tuple[str, ...]
    their_keys: tuple[str, ...]
    missing_flag: str


@dataclass(frozen=True)
class Source:
    name: str
    ddl: str
    keys: tuple[str, ...]
    clean: Mapping[str, str] = field(default_factory=dict)
    links: tuple[Link, ...] = ()
    #: Warning flags and the SQL conditions that raise them.
    rules: Mapping[str, str] = field(default_factory=dict)
    #: Columns that must not be negative.
    amounts: tuple[str, ...] = ()
    required_file: bool = True
    defaults: Mapping[str, int] = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        return schema_of(self.ddl)

    @property
    def payload(self) -> list[str]:
        return names(self.ddl)

    @property
    def bronze_table(self) -> str:
        return f"bronze_{self.name}_events"

    @property
    def silver_table(self) -> str:
        return f"silver_{self.name}_cdc"

    @property
    def bronze_ddl(self) -> str:
        return f"{self.ddl}, {METADATA}".replace("!", "")

    @property
    def silver_ddl(self) -> str:
        links = "".join(f", {link.flag} boolean" for link in self.links)
        return f"{self.bronze_ddl}, {TECHNICAL}{links}, quality_status string, quality_flags array<string>"


PURCHASE_KEY, ITEM_KEY = ("purchase_id", "purchase_partition"), ("prod_item_id", "prod_item_partition")
_IN_STATUSES = ", ".join(f"'{s}'" for s in STATUSES)

SOURCES = {
    s.name: s
    for s in (
        Source(
            "purchase",
            "purchase_id bigint!, buyer_id bigint, prod_item_id bigint, order_date date, release_date date, producer_id bigint, purchase_partition bigint!, prod_item_partition bigint, purchase_total_value double, purchase_status string, transaction_datetime timestamp!, transaction_date date!",
            PURCHASE_KEY,
            clean={"purchase_status": "upper"},
            links=(
                Link("has_product_item_match", "product_item", ITEM_KEY, ITEM_KEY, "missing_product_item_reference"),
                Link("has_extra_info_match", "purchase_extra_info", PURCHASE_KEY, PURCHASE_KEY, "missing_purchase_extra_info_reference"),
            ),
            rules={
                "missing_prod_item_key": "prod_item_id is null or prod_item_partition is null",
                "missing_purchase_status": "purchase_status is null",
                "invalid_purchase_status": f"purchase_status not in ({_IN_STATUSES})",
                "missing_purchase_total_value": "purchase_total_value is null",
                "negative_purchase_total_value": "purchase_total_value < 0",
                "missing_release_date": "release_date is null",
            },
            amounts=("purchase_total_value",),
            defaults={"purchase_partition": 1, "prod_item_partition": 1},
        ),
        Source(
            "product_item",
            "prod_item_id bigint!, prod_item_partition bigint!, product_id bigint, item_quantity int, purchase_value double, transaction_datetime timestamp!, transaction_date date!",
            ITEM_KEY,
            links=(Link("has_purchase_match", "purchase", ITEM_KEY, ITEM_KEY, "orphan_product_item_reference"),),
            rules={
                "missing_product_id": "product_id is null",
                "missing_item_quantity": "item_quantity is null",
                "non_positive_item_quantity": "item_quantity <= 0",
                "missing_purchase_value": "purchase_value is null",
                "negative_purchase_value": "purchase_value < 0",
            },
            amounts=("purchase_value",),
            defaults={"prod_item_partition": 1},
        ),
        Source(
            "purchase_extra_info",
            "purchase_id bigint!, purchase_partition bigint!, subsidiary string, transaction_datetime timestamp!, transaction_date date!",
            PURCHASE_KEY,
            clean={"subsidiary": "lower"},
            links=(Link("has_purchase_match", "purchase", PURCHASE_KEY, PURCHASE_KEY, "orphan_purchase_extra_info_reference"),),
            rules={"missing_subsidiary": "subsidiary is null"},
            defaults={"purchase_partition": 1},
        ),
        Source(
            "order_transaction_cost_hist",
            "purchase_id bigint!, purchase_partition bigint!, order_transaction_cost_vat_value double, order_transaction_cost_installment_value double, order_transaction_cost_date date, transaction_datetime timestamp!, transaction_date date!",
            PURCHASE_KEY,
            links=(Link("has_purchase_match", "purchase", PURCHASE_KEY, PURCHASE_KEY, "orphan_order_transaction_cost_hist_reference"),),
            rules={
                "missing_order_transaction_cost_date": "order_transaction_cost_date is null",
                "negative_order_transaction_cost_vat_value": "order_transaction_cost_vat_value < 0",
                "negative_order_transaction_cost_installment_value": "order_transaction_cost_installment_value < 0",
            },
            amounts=("order_transaction_cost_vat_value", "order_transaction_cost_installment_value"),
            required_file=False,
            defaults={"purchase_partition": 1},
        ),
    )
}


@dataclass(frozen=True)
class KeySet:
    """Keys of a source that have occurred in any of its rows: what reference flags look up, and what day filters are kept of."""

    source: str
    keys: tuple[str, ...]

    @property
    def table(self) -> str:
        return f"keys_{self.source}_by_{self.keys[0]}"

    @property
    def ddl(self) -> str:
        return ", ".join(f"{k} bigint" for k in self.keys) + ", batch_id string"


#: One for each pair of a source and keys that a link refers to.
KEY_SETS = tuple(dict.fromkeys(KeySet(link.source, link.their_keys) for s in SOURCES.values() for link in s.links))
#: Which days may hold a key: hashed keys of a batch's day as bitmaps of 32,768 bits, ``part`` of each hash's space.
FILTERS_TABLE = "bronze_day_filters"
FILTERS = "source string, key_name string, transaction_date date, batch_id string, part bigint, bits binary"


def source(name: str) -> Source:
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; known are {', '.join(sorted(SOURCES))}")
    return SOURCES[name]


def grain(table: str) -> tuple[str, ...]:
    """Business key of a published table; empty for others."""
    for s in SOURCES.values():
        if table in (s.bronze_table, s.silver_table):
            return s.keys
    return {SNAPSHOT_TABLE: ("snapshot_date", *PURCHASE_KEY), GMV_TABLE: ("snapshot_date", "gmv_date", "subsidiary")}.get(table, ())
