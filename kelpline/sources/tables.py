"""Tables in the session's catalog: parquet, partitioned by day, written by append, full replacement or whole days."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .contracts import FILTERS, FILTERS_TABLE, GMV, GMV_TABLE, GMV_VIEW, KEY_SETS, OPS_TABLES, SNAPSHOT, SNAPSHOT_TABLE, SOURCES, schema_of

#: Of new tables: snapshots repeat each purchase every day, and take two fifths less than with the engine's defaults.
PARQUET = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6", "parquet.writer.version": "PARQUET_2_0"}
LAYERS = ("bronze", "keys", "silver", "snapshot", "gmv", "ops")


def qualified(namespace: str | None, table: str, catalog: str | None = None) -> str:
    return ".".join(f"`{x}`" for x in (catalog, namespace, table) if x)


def layer_tables(layer: str) -> dict[str, tuple[StructType, str | None]]:
    """A layer's tables: schema and partition column, if any.  Ops tables get a date column from their time stamp."""
    if layer == "keys":
        return {k.table: (schema_of(k.ddl), None) for k in KEY_SETS} | {FILTERS_TABLE: (schema_of(FILTERS), "source")}
    if layer == "bronze":
        return {s.bronze_table: (schema_of(s.bronze_ddl), "transaction_date") for s in SOURCES.values()}
    if layer == "silver":
        return {s.silver_table: (schema_of(s.silver_ddl), "transaction_date") for s in SOURCES.values()}
    if layer == "snapshot":
        return {SNAPSHOT_TABLE: (schema_of(SNAPSHOT), "snapshot_date")}
    if layer == "gmv":
        return {GMV_TABLE: (schema_of(GMV), "snapshot_date")}
    if layer == "ops":
        return {name: (schema_of(f"{ddl}, {stamp[:-3]}_date date"), f"{stamp[:-3]}_date") for name, (ddl, stamp) in OPS_TABLES.items()}
    raise ValueError(f"unknown layer {layer!r}; known are {', '.join(LAYERS)}")


class TableStore:
    """Named tables of one namespace."""

    #: Whether loads of different tables may run at the same time; not here, where overwriting goes by a session's setting.
    side_by_side = False
    #: Whether a replacement can be written in parts, of which readers see nothing until all are there.
    in_parts = False

    def __init__(self, spark: SparkSession, namespace: str = "kelpline", catalog: str | None = None, table_format: str = "parquet") -> None:
        """``table_format``: of new tables, as the catalog knows it; with a transactional one, readers never see half a replacement."""
        if not namespace:
            raise ValueError("a namespace is needed")
        self.spark, self.namespace, self.catalog, self.table_format = spark, namespace, catalog, table_format

    def name(self, table: str) -> str:
        return qualified(self.namespace, table, self.catalog)

    def ddl(self, table: str, schema: StructType, partition: str | None) -> str:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        options = f" OPTIONS ({', '.join(f'{k!r} = {v!r}' for k, v in PARQUET.items())})" if self.table_format == "parquet" else ""
        return f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({columns}) USING {self.table_format}{options}" + (f" PARTITIONED BY (`{partition}`)" if partition else "")

    def prepare(self, layer: str, reset: bool = False) -> None:
        """Create the layer's tables, after dropping them (and what hangs on them) with ``reset``."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {qualified(None, self.namespace, self.catalog)}")
        if reset and layer == "gmv":
            self.drop_current_view()
        for table, (schema, partition) in layer_tables(layer).items():
            if reset:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")
            self.spark.sql(self.ddl(table, schema, partition))

    def read(self, table: str, day: date | None = None, column: str = "transaction_date") -> DataFrame:
        """The table, or one day of it (only that partition is read)."""
        df = self.spark.table(self.name(table))
        return df if day is None else df.where(F.col(column) == F.lit(day))

    @property
    def versioned(self) -> bool:
        """Whether the tables lie in a catalog of their own, which takes writes by the second writer interface."""
        return self.catalog not in (None, "spark_catalog")

    def _insert(self, df: DataFrame, table: str, overwrite: bool, mode: str | None = None) -> int:
        """Write once; the rows written are counted on the way."""
        seen, target = Observation(), self.spark.table(self.name(table)).columns
        rows = df.select(*target).observe(seen, F.count(F.lit(1)).alias("n"))
        if self.versioned:
            writer = rows.writeTo(self.name(table))
            if not overwrite:
                writer.append()
            elif mode == "dynamic":
                writer.overwritePartitions()
            else:
                writer.overwrite(F.lit(True))
        elif not overwrite:
            rows.write.insertInto(self.name(table))
        else:
            # insertInto takes the mode from the session alone, so such loads of one session must not run at the same time
            before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
            try:
                rows.write.insertInto(self.name(table), overwrite=True)
            finally:
                self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        return seen.get["n"]

    def append(self, df: DataFrame, table: str) -> int:
        return self._insert(df, table, False)

    def replace_all(self, df: DataFrame, table: str) -> int:
        return self._insert(df, table, True, "static")

    def replace_by(self, parts: Sequence[DataFrame], table: str) -> int:
        """``replace_all`` by the rows of some frames, one after the other with ``in_parts``."""
        return self.replace_all(reduce(DataFrame.unionByName, parts), table)

    def replace_partitions(self, df: DataFrame, table: str) -> int:
        """Overwrite exactly the days that the frame has; none if it is empty."""
        return self._insert(df, table, True, "dynamic")

    def replace_day(self, df: DataFrame, table: str, column: str, day: date) -> int:
        """Overwrite one day in a single commit; a day that has no rows any more loses its partition."""
        written = self.replace_partitions(df.where(F.col(column) == F.lit(day)), table)
        if not written:
            gone = f"DELETE FROM {self.name(table)} WHERE `{column}` = DATE '{day}'" if self.versioned else f"ALTER TABLE {self.name(table)} DROP IF EXISTS PARTITION (`{column}` = DATE '{day}')"
            self.spark.sql(gone)
        return written

    def has(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table))

    def drop_current_view(self) -> None:
        if not self.versioned:
            self.spark.sql(f"DROP VIEW IF EXISTS {self.name(GMV_VIEW)}")

    def current_view_sql(self) -> str:
        t = self.name(GMV_TABLE)
        return f"CREATE OR REPLACE VIEW {self.name(GMV_VIEW)} AS SELECT g.* FROM {t} g CROSS JOIN (SELECT max(snapshot_date) AS newest FROM {t}) m WHERE g.snapshot_date = m.newest"

    def refresh_current_view(self) -> bool:
        """Create the view of the newest snapshot; False where the catalog has no views."""
        try:
            self.spark.sql(self.current_view_sql())
        except Exception as e:
            if "view" in str(e).lower() and ("not support" in str(e).lower() or "MISSING_CATALOG_ABILITY" in str(e)):
                return False
            raise
        return True

    def current_gmv(self) -> DataFrame:
        t = self.name(GMV_TABLE)
        return self.spark.sql(f"SELECT * FROM {t} WHERE snapshot_date = (SELECT max(snapshot_date) FROM {t}) ORDER BY gmv_date, subsidiary")

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.namespace) if not t.isTemporary)


def require_unique(names: Iterable[str]) -> None:
    seen = list(names)
    if len(seen) != len(set(seen)):
        raise ValueError(f"a source occurs twice: {seen}")
