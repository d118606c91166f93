"""Delimited files to contract frames."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .contracts import SOURCES, Source, source


@dataclass(frozen=True)
class Load:
    """A contract frame and the file it came from."""

    source_name: str
    df: DataFrame
    source_file: str | None = None


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Header, every column a string, ``NULL`` for null; a malformed line fails the read."""
    return spark.read.options(header=True, mode="FAILFAST", nullValue="NULL").csv(path)


def align(raw: DataFrame, spec: Source, mapping: Mapping[str, str] | None = None, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Each contract column from its mapped or equally named column, else its default, else null; others are dropped."""
    mapping, defaults = mapping or {}, spec.defaults if defaults is None else defaults

    def value(name: str):
        given = mapping.get(name, name)
        return F.col(given) if given in raw.columns else F.lit(defaults.get(name))

    return raw.select(*(value(f.name).try_cast(f.dataType).alias(f.name) for f in spec.schema))


def on_date(df: DataFrame, day: date | None, column: str = "transaction_date") -> DataFrame:
    return df if day is None else df.where(F.col(column) == F.lit(day))


def item_lookup(purchases: DataFrame) -> DataFrame:
    """The item id of each purchase's latest version."""
    w = Window.partitionBy("purchase_id").orderBy(F.col("transaction_datetime").desc_nulls_last(), F.col("transaction_date").desc_nulls_last())
    return purchases.withColumn("_place", F.row_number().over(w)).where("_place = 1").select("purchase_id", "prod_item_id")


def load_file(spark: SparkSession, path: str, name: str, day: date | None = None, lookup: DataFrame | None = None) -> Load:
    """One file's contract frame; with a ``lookup``, a file without item ids gets them by purchase, and all must resolve (a job)."""
    spec, raw = source(name), read_text(spark, path)
    if lookup is not None and "prod_item_id" not in raw.columns:
        known = lookup.select(F.col("purchase_id").cast("string").alias("purchase_id"), F.col("prod_item_id").cast("string").alias("prod_item_id"))
        raw = raw.join(known, "purchase_id", "left")
    df = on_date(align(raw, spec), day)
    if name == "product_item" and not df.where("prod_item_id is null").isEmpty():
        raise ValueError(f"{path}: rows without a product item id")
    return Load(name, df, path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def folder_loads(spark: SparkSession, folder: str, day: date | None = None) -> list[Load]:
    """Loads of the folder's ``<source>.txt`` files.  The item lookup sees all purchases, whatever the day."""
    out, lookup = [], None
    for name, spec in SOURCES.items():
        path = f"{folder.rstrip('/')}/{name}.txt"
        if not exists(spark, path):
            if spec.required_file:
                raise FileNotFoundError(path)
            print(f"optional file {path} is absent; going on without it")
            continue
        if name == "purchase":
            lookup = item_lookup(align(read_text(spark, path), spec))
        out.append(load_file(spark, path, name, day, lookup if name == "product_item" else None))
    return out
