"""Links within groups too large for one task, whole and without comparing all pairs.

What is wanted of a group are enough links to connect what is connected.  A group is dealt into parts of about ``most`` members;

1. each part is compared by itself, which gives components within the parts;
2. ``FACES`` members of each component, drawn by hash, meet those of the group's other components, so that near copies dealt to
   different parts come together at the cost of a few rows a part;
3. where a group still has several components, all members outside of the largest (strays) meet all members, a part of strays with a
   part of members at a time.  After that no pair of two components is left unseen.

Members of the largest component are copied once per part of strays, so a group of near copies costs little more than its
members.  Only a group without a large component, of members that meet but aren't alike, costs the product of its parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sent
from .components import components

#: Members of a component that stand for it in step 2.
FACES = 16


def parts(size: Column, most: int) -> Column:
    return F.ceil(size / most).cast("int")


def dealt(size: Column, most: int, salt: int) -> Column:
    """The part of a member: by its code, the same in every run."""
    return F.pmod(F.xxhash64("code", F.lit(salt)), F.greatest(F.lit(1), parts(size, most))).cast("int")


def labelled(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The rows with ``label``, the component that the links give their code (itself, without links)."""
    roots = components(links, name)
    return rows.join(roots.withColumnRenamed("node", "code"), "code", "left").withColumn("label", F.coalesce("root", "code")).drop("root")


def links_of_large(rows: DataFrame, compare: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """Links (``a``, ``b``) that connect what is connected in each group of ``rows``.

    rows: ``bucket``, ``code`` (a long, once a bucket), ``size`` (members of the bucket) and what ``compare`` needs.
    compare: rows with ``bucket`` (here a cell of at most about two parts) -> links of each bucket's members.
    """
    rows = cut(rows, "hot-rows")
    alone = cut(compare(rows.withColumn("bucket", F.xxhash64("bucket", dealt(F.col("size"), most, 0)))), "hot-alone")
    labels = labelled(rows.select("bucket", "code", "size"), alone, "hot-alone-links")
    chosen = [F.min(F.struct(F.xxhash64("code", F.lit(100 + i)), "code")).alias(f"f{i}") for i in range(FACES)]
    faces = labels.groupBy("bucket", "label").agg(*chosen).select("bucket", F.explode(F.array_distinct(F.array(*[f"f{i}.code" for i in range(FACES)]))).alias("code"))
    faces = cut(faces, "hot-faces")
    shown = faces.join(sent(faces.groupBy("bucket").agg(F.count("*").alias("shown"))), "bucket")
    met = rows.join(shown.withColumn("cell", F.xxhash64("bucket", dealt(F.col("shown"), most, 1))), ["bucket", "code"])
    links = cut(alone.unionByName(compare(met.drop("bucket").withColumnRenamed("cell", "bucket"))), "hot-links")
    return links.unionByName(compare(cells(labelled(rows, links, "hot-links-links"), most)))


def cells(labels: DataFrame, most: int) -> DataFrame:
    """The rows of groups with several components, once for each cell in which they meet; ``bucket`` names the cell."""
    counts = labels.groupBy("bucket", "size", "label").count()
    largest = counts.groupBy("bucket").agg(F.max_by("label", F.struct("count", "label")).alias("body"), (F.sum("count") - F.max("count")).alias("strays"))
    left = labels.join(sent(cut(largest.where("strays > 0"), "hot-left")), "bucket")
    mine, all_parts = dealt(F.col("size"), most, 2), parts(F.col("size"), most)
    stray, stray_parts = dealt(F.col("strays"), most, 3), parts(F.col("strays"), most)
    member = F.transform(F.sequence(F.lit(0), stray_parts - 1), lambda s: F.xxhash64("bucket", s, mine))
    outside = F.transform(F.sequence(F.lit(0), all_parts - 1), lambda m: F.xxhash64("bucket", stray, m))
    named = F.when(F.col("label") == F.col("body"), member).otherwise(F.array_distinct(F.concat(member, outside)))
    return left.withColumn("cell", F.explode(named)).drop("bucket", "body", "strays", "label").withColumnRenamed("cell", "bucket")
