"""Packing of tokenized documents into sequences (operator 5).

First-fit decreasing: a tournament tree over the bins' free space finds the first bin that a span fits.  It runs
independently in groups of documents dealt at random, so no task sees more than about ``GROUP_DOCS`` documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from .common import slices
from .fast_encode import fast

#: Documents a group has on average.
GROUP_DOCS = 4096
#: Bins a group may have; sequence ids are the group's number times this, plus the bin's.
BINS = 1 << 32


class BinTree:
    """Free space of bins in the leaves of a tournament tree; an inner node holds the larger of its children's."""

    def __init__(self, leaves: int, capacity: int) -> None:
        self.base = 1 << max(0, leaves - 1).bit_length()
        self.free = [capacity] * (2 * self.base)

    def place(self, size: int) -> tuple[int, int]:
        """Put a span into the first bin with room; its number, and the space it had left before."""
        free, at = self.free, 1
        while at < self.base:
            at *= 2
            if free[at] < size:
                at += 1
        had = free[at]
        free[at] = had - size
        leaf = at - self.base
        at //= 2
        while at:
            best = free[2 * at] if free[2 * at] >= free[2 * at + 1] else free[2 * at + 1]
            if free[at] == best:
                break
            free[at] = best
            at //= 2
        return leaf, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, largest first; ties keep their order.  Spans that fill a bin take one without a search."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    full = int((sizes == capacity).sum())
    bins[order[:full]] = np.arange(full)
    rest = order[full:]
    tree = BinTree(max(1, len(rest)), capacity)
    for i, size in zip(rest.tolist(), sizes[rest].tolist()):
        leaf, had = tree.place(size)
        bins[i], offsets[i] = full + leaf, capacity - had
    return bins, offsets


def tokenized_spans(docs: DataFrame, tokenizer: str, groups: int, capacity: int = 1024, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents' ids, with ``end_id`` at the end, cut into spans of ``capacity`` and a remainder.

    ``pack_group`` deals documents to groups by a hash of id and ids; equal rows differ in their task and their count within
    it, so copies of one row spread as well.
    """
    id_type = docs.schema[id_col].dataType
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "pack_group", *["ids"] * with_ids]
    types = [to_arrow_type(id_type), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]
    schema = f"{id_col} {id_type.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, pack_group bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, task = fast(tokenizer), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch):
                rows: list[list] = [[] for _ in names]
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4")
                    n = len(ids)
                    data = ids.tobytes()
                    mark = zlib.crc32(str(key).encode(), zlib.crc32(data))
                    seen[mark] += 1
                    group = zlib.crc32(f"{mark}/{seen[mark]}/{task}".encode()) % groups
                    for start in range(0, n, capacity):
                        size = min(capacity, n - start)
                        for to, x in zip(rows, (key, start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), n, group, *[ids[start : start + size].astype(np.int32)] * with_ids)):
                            to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, group_docs: int = GROUP_DOCS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    Returns a row per span: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and,
    with ``with_ids``, the ids.  Every id lies in exactly one span; in a sequence the spans follow one another from offset 0.
    A null or empty text is the single ``end_id``.  Null ids and repeated rows are packed as documents of their own.
    """
    groups = max(1, -(-docs.count() // group_docs))
    spans = tokenized_spans(docs, tokenizer, groups, capacity, end_id, with_ids, id_col, text_col)
    schema = spans.drop("pack_group").schema.add("sequence_id", "long").add("offset", "long")
    fields = to_arrow_schema(schema)

    def pack(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, [("length", "descending"), (id_col, "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        rows = rows.take(order)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        numbers = (rows["pack_group"][0].as_py() * BINS + bins, offsets)
        return pa.Table.from_arrays([*(rows[c] for c in fields.names[:-2]), *map(pa.array, numbers)], schema=fields)

    return spans.groupBy("pack_group").applyInArrow(pack, schema)


def padding(spans: DataFrame, capacity: int = 1024) -> DataFrame:
    """How full sequences are: their number, ids and padding (a sequence whose length is a power of two needs none)."""
    filled = spans.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    power = F.col("filled").bitwiseAND(F.col("filled") - 1) == 0
    return filled.agg(F.count("*").alias("sequences"), F.sum("filled").alias("ids"), F.sum(F.when(power, 0).otherwise(capacity - F.col("filled"))).alias("padding"))
