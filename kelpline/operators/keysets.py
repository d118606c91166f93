"""Small tables kept next to raw events, so that a day's run needn't read their history: key sets, and filters of days by key.

A *key set* holds each key once.  A batch adds the keys that it is the first to have, found by one anti-join.

A *day filter* is a Bloom filter of a batch's keys on one day.  ``PROBES`` hashes put a key at as many bits of ``PARTS`` bitmaps;
bitmaps are made by an aggregate that combines within tasks.  A day may hold a key if some batch has all of its bits there; a
wrong yes costs reading a day, a no is always right.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X

#: Bitmaps of 32,768 bits a hash and day: with a million keys a day and three hashes, one key in 85 is taken for present.
PARTS, PROBES = 128, 3
_BITS = 32_768


def new_keys(batch: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole keys of a batch that aren't known yet, each once."""
    return batch.select(*keys).where(X.all_present(keys)).distinct().join(known.select(*keys), list(keys), "left_anti")


def _plain(keys: Sequence[str]) -> list[Column]:
    """Key columns with a value of their own for null, so that incomplete keys are found too."""
    return [F.coalesce(F.col(k), F.lit(-(2**62) - i)).alias(f"_k{i}") for i, k in enumerate(keys)]


def _spots(n: int) -> Column:
    """Places of a key's bits."""
    return F.array_distinct(F.array(*(F.pmod(F.xxhash64(F.lit(i), *(f"_k{j}" for j in range(n))), F.lit(PARTS * _BITS)) + F.lit(1) for i in range(PROBES))))


def day_filters(batch: DataFrame, keys: Sequence[str], date_col: str = "transaction_date") -> DataFrame:
    """``transaction_date``, ``part`` and ``bits`` of a batch's keys; rows without a day have no filter."""
    spots = batch.where(F.col(date_col).isNotNull()).select(F.col(date_col).alias("transaction_date"), *_plain(keys)).distinct().select("transaction_date", F.explode(_spots(len(keys))).alias("spot"))
    return spots.groupBy("transaction_date", F.bitmap_bucket_number("spot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))


def days_that_may_hold(filters: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Days on which some batch has all bits of some wanted key.  ``filters`` are those of one source and key."""
    own = [f"_k{i}" for i in range(len(keys))]
    spots = wanted.select(*_plain(keys)).distinct().withColumn("_spots", _spots(len(keys))).select(*own, F.size("_spots").alias("needed"), F.explode("_spots").alias("spot"))
    probes = spots.select(*own, "needed", F.bitmap_bucket_number("spot").alias("part"), F.bitmap_bit_position("spot").alias("at"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = probes.join(filters, "part").where(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1)
    hits = met.groupBy(*own, "needed", "transaction_date", "batch_id").count()
    return hits.where(F.col("count") >= F.col("needed")).select("transaction_date").distinct()
