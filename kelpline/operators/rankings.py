"""Ranked revenue reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_groups(df: DataFrame, by: str, value: Column, name: str, n: int) -> DataFrame:
    """The n groups with the largest sum; ties by group."""
    return df.groupBy(by).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias(name)).orderBy(F.desc(name), by).limit(n)


def top_within(df: DataFrame, outer: str, inner: str, value: Column, name: str, n: int, rank: str = "product_rank") -> DataFrame:
    """The n inner groups with the largest sum within each outer group; ties by inner group."""
    sums = df.groupBy(outer, inner).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias(name))
    return sums.withColumn(rank, F.row_number().over(Window.partitionBy(outer).orderBy(F.desc(name), inner))).where(F.col(rank) <= n)


def top_producers(purchases: DataFrame, year: int = 2021, n: int = 50) -> DataFrame:
    """Producers with most approved revenue released in a year.  Only exact repeats of a row count once."""
    distinct = purchases.select("purchase_id", "purchase_partition", "producer_id", "prod_item_id", "prod_item_partition", "purchase_total_value", "purchase_status", "release_date").distinct()
    kept = distinct.where(f"purchase_status = 'APROVADA' and release_date >= date'{year}-01-01' and release_date < date'{year + 1}-01-01'")
    return top_groups(kept, "producer_id", F.col("purchase_total_value"), f"revenue_{year}", n)


def top_products(purchases: DataFrame, items: DataFrame, n: int = 2) -> DataFrame:
    """Each producer's products with most approved revenue, of all time; an item's value is its line total."""
    sold = purchases.select("purchase_id", "purchase_partition", "producer_id", "prod_item_id", "prod_item_partition", "purchase_status").distinct().where("purchase_status = 'APROVADA'")
    lines = items.select("prod_item_id", "prod_item_partition", "product_id", "purchase_value").distinct()
    ranked = top_within(sold.join(lines, ["prod_item_id", "prod_item_partition"]), "producer_id", "product_id", F.col("purchase_value"), "product_revenue", n)
    return ranked.orderBy("producer_id", "product_rank", "product_id")
