"""Parquet tables whose replacement readers see in one step."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import delete_folders
from .tables import TableStore, layer_tables

_MARK = "__"


class StagedStore(TableStore):
    """A published name is a view of the table's current generation, which lies in a folder of its own.

    A replacement writes a new generation next to it and then replaces the view, a single catalog entry.  Days that aren't
    replaced are partitions of the new generation at the place where they lie already, so nothing is copied.  Until the view is
    replaced, and if writing fails, readers have the old rows whole.  The generation before stays for readers that began with it;
    the one before that is removed.  No session setting is changed, so loads of different tables can run side by side; two loads
    of one table can't, not even two appends.
    """

    side_by_side = True
    in_parts = True

    # -- generations -------------------------------------------------------

    def _generations(self, table: str) -> tuple[str, str | None]:
        held = {r[0]: r[1] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.name(table)}").collect()}
        return held["generation"], held.get("before")

    def _folder(self, generation: str) -> str:
        return f"{self.spark.conf.get('spark.sql.warehouse.dir')}/{self.namespace}-staged/{generation}"

    def _publish(self, table: str, generation: str, before: str | None) -> None:
        kept = f", 'before' = '{before}'" if before else ""
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name(table)} TBLPROPERTIES ('generation' = '{generation}'{kept}) AS SELECT * FROM {self.name(generation)}")

    def _places(self, generation: str) -> dict[str, str]:
        """Partition (as the catalog shows it) and where it lies; none for a table without partitions."""
        places: dict[str, str] = {}
        if not any(c.isPartition for c in self.spark.catalog.listColumns(self.name(generation))):
            return places
        for (shown,) in self.spark.sql(f"SHOW PARTITIONS {self.name(generation)}").collect():
            said = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name(generation)} PARTITION ({_spec(shown)})").collect()
            places[shown] = next(r["data_type"] for r in said if r["col_name"] == "Location")
        return places

    def _discard(self, generation: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(generation)}")
        delete_folders(self.spark, [self._folder(generation)])

    def _replace(self, parts: Sequence[DataFrame], table: str, keep: str | None, day: tuple[str, date] | None = None) -> int:
        """Publish a new generation of the frames' rows and, with ``keep``, of the days that they have no rows of (but not ``day``)."""
        old, before = self._generations(table)
        new = f"{table}{_MARK}{uuid4().hex[:12]}"
        self.spark.sql(f"CREATE TABLE {self.name(new)} LIKE {self.name(old)} USING {self.table_format} LOCATION '{self._folder(new)}'")
        try:
            written = sum(self._insert(df, new, False) for df in parts)
            if keep == "others" and not written and day is None:
                self._discard(new)
                return 0
            places = self._places(old) if keep else {}
            if keep:
                mine = set(self._places(new))
                if day:
                    mine.add(f"{day[0]}={day[1]}")
                others = [f"PARTITION ({_spec(p)}) LOCATION '{at}'" for p, at in places.items() if p not in mine]
                if others:
                    self.spark.sql(f"ALTER TABLE {self.name(new)} ADD {' '.join(others)}")
        except BaseException:
            self._discard(new)
            raise
        self._publish(table, new, old)
        if before:
            self._remove(before, {*self._places(old).values(), *self._places(new).values()})
        return written

    def _remove(self, generation: str, in_use: set[str]) -> None:
        """Drop a generation and those of its days that no later one has; its folder stays while a day in it is in use."""
        places = set(self._places(generation).values())
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(generation)}")
        delete_folders(self.spark, places - in_use)
        if not any(f"/{generation}/" in p for p in in_use):
            delete_folders(self.spark, [self._folder(generation)])

    # -- what a table store does -------------------------------------------

    def prepare(self, layer: str, reset: bool = False) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.namespace}`")
        if reset and layer == "gmv":
            self.drop_current_view()
        for table, (schema, partition) in layer_tables(layer).items():
            if reset:
                self.spark.sql(f"DROP VIEW IF EXISTS {self.name(table)}")
                for r in self.spark.catalog.listTables(self.namespace):
                    if r.name.startswith(f"{table}{_MARK}"):
                        self._discard(r.name)
            if not self.spark.catalog.tableExists(self.name(table)):
                first = f"{table}{_MARK}{uuid4().hex[:12]}"
                self.spark.sql(f"{self.ddl(first, schema, partition)} LOCATION '{self._folder(first)}'")
                self._publish(table, first, None)

    def append(self, df: DataFrame, table: str) -> int:
        return self._insert(df, self._generations(table)[0], False)

    def replace_all(self, df: DataFrame, table: str) -> int:
        return self._replace([df], table, None)

    def replace_by(self, parts: Sequence[DataFrame], table: str) -> int:
        return self._replace(parts, table, None)

    def replace_partitions(self, df: DataFrame, table: str) -> int:
        return self._replace([df], table, "others")

    def replace_day(self, df: DataFrame, table: str, column: str, day: date) -> int:
        return self._replace([df.where(F.col(column) == F.lit(day))], table, "others", (column, day))

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.namespace) if not t.isTemporary and _MARK not in t.name)


def _spec(shown: str) -> str:
    column, value = shown.split("=", 1)
    return f"`{column}` = {'null' if value == '__HIVE_DEFAULT_PARTITION__' else repr(value)}"
