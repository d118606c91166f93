"""Ranked lexical search of all documents for a set of queries (operator 13), by a hybrid of term and document order.

1. One pass over the texts makes an inverted index of each shard of about ``SHARD_BYTES`` of text, of the queries' terms only,
   and writes it to the shared folder.  Document frequencies and lengths of all shards add up to the collection's statistics.
2. Each shard answers all queries.  The short lists of a query's terms are summed into accumulators term by term; the
   documents that they reach are then one more list with a known largest score.  That list and the long ones are gone through
   document by document in ranges of ``RANGE`` documents: a range whose largest scores can't reach the tenth score so far is
   skipped, in the others only documents of the lists that could still lift one to it are looked up in the rest.
3. A task sends its best few of each query; the best of all are ranked by score, then id.

Scores are whole numbers and exact.  Queries come in blocks of a bounded size; each block reads the documents once.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, drop_cut, slices, without_gc

SHARD_BYTES, SHARD_DOCS = 24_000_000, 65_536
RANGE = 2_048
#: Lists of up to so many postings together are summed term by term.
SHORT = 4_096
#: Characters of queries in a block, and so the size of what tasks are sent.
BLOCK_CHARS = 4_000_000
#: Small letters for A-Z and blanks for all other ASCII characters but digits and letters.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a whole text in order, with repeats: runs of ASCII letters (in small ones), digits and all that isn't ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split() if text else []


@dataclass(frozen=True)
class Block:
    """Queries as (place, term numbers, multiplicities); ``vocabulary`` numbers their terms."""

    vocabulary: dict[bytes, int]
    queries: list[tuple[int, np.ndarray, np.ndarray]]


def make_block(texts: list[str | None]) -> Block:
    vocabulary: dict[bytes, int] = {}
    queries = []
    for place, text in enumerate(texts):
        counts = Counter(terms_of(text))
        at = np.array([vocabulary.setdefault(t, len(vocabulary)) for t in counts], np.int64)
        queries.append((place, at, np.array(list(counts.values()), np.int64)))
    return Block(vocabulary, queries)


INDEX = "n_docs bigint, n_terms bigint, terms array<int>, dfs array<bigint>, lengths binary, docs binary, tfs binary"


def _indexer(block: Block, id_type: pa.DataType, shard_bytes: int) -> tuple[Callable, pa.Schema]:
    """(doc id, text) rows -> a row per shard: its documents that have a query's term, and their postings in order of (term, document)."""
    schema = pa.schema([("ids", pa.list_(id_type)), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.int32())), ("dfs", pa.list_(pa.int64())), ("lengths", pa.binary()), ("docs", pa.binary()), ("tfs", pa.binary())])

    def row(ids: list, lengths: list[int], docs: list[np.ndarray], terms: list[np.ndarray], n_docs: int, n_terms: int) -> pa.RecordBatch:
        doc, term = np.concatenate(docs or [np.zeros(0, np.int64)]), np.concatenate(terms or [np.zeros(0, np.int64)])
        keys, tfs = np.unique(term * len(ids) + doc, return_counts=True) if len(doc) else (doc, doc)
        term, doc = (keys // len(ids), keys % len(ids)) if len(doc) else (term, doc)
        own, dfs = np.unique(term, return_counts=True)
        values = [ids], [n_docs], [n_terms], [own.astype(np.int32)], [dfs], [pa.compress(np.array(lengths, "<i8").tobytes(), "zstd", True)], [pa.compress(doc.astype("<i4").tobytes(), "zstd", True)], [pa.compress(tfs.astype("<i4").tobytes(), "zstd", True)]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, schema.types)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.vocabulary.get
        ids, lengths, docs, terms, n_docs, n_terms, size = [], [], [], [], 0, 0, 0
        with without_gc():
            for batch in batches:
                for part in slices(batch):
                    for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        words = terms_of(text)
                        if not words:
                            continue
                        n_docs, n_terms, size = n_docs + 1, n_terms + len(words), size + len(text)
                        at = np.array([i for i in map(known, words) if i is not None], np.int64)
                        if len(at):
                            docs.append(np.full(len(at), len(ids), np.int64))
                            terms.append(at)
                            ids.append(key)
                            lengths.append(len(words))
                        if size >= shard_bytes or len(ids) >= SHARD_DOCS:
                            yield row(ids, lengths, docs, terms, n_docs, n_terms)
                            ids, lengths, docs, terms, n_docs, n_terms, size = [], [], [], [], 0, 0, 0
            if n_docs:
                yield row(ids, lengths, docs, terms, n_docs, n_terms)

    return run, schema


class Shard:
    """Postings of one shard with the contributions of each, before a term's weight."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, dfs: np.ndarray, docs: np.ndarray, tfs: np.ndarray, total_docs: int, total_terms: int) -> None:
        m = 100 - 75 + (75 * lengths * total_docs) // total_terms
        self.n, self.docs = len(lengths), docs
        tf = tfs.astype(np.int64)
        self.gains = (1_000_000_000 * tf) // (1000 * tf + 8 * m[docs])
        ends = np.cumsum(dfs)
        self.starts = ends - dfs
        self.where = {int(t): i for i, t in enumerate(terms)}
        self.sizes = dfs
        self.most = np.maximum.reduceat(self.gains, self.starts) if len(docs) else np.zeros(0, np.int64)

    def list_of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a = self.starts[i]
        return self.docs[a : a + self.sizes[i]], self.gains[a : a + self.sizes[i]]


class Best:
    """The ``k`` best (score, then smaller id) so far.  Null ids rank behind all others."""

    def __init__(self, k: int) -> None:
        self.k, self.heap, self.count = k, [], 0

    @property
    def least(self) -> int:
        """A score below this one can't come in."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, score: int, key: object) -> None:
        self.count += 1
        entry = (score, Reverse(key), self.count)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry[:2] > self.heap[0][:2]:
            heapq.heapreplace(self.heap, entry)


class Reverse:
    """Orders ids downwards, null lowest, so that a heap drops the largest ids first."""

    __slots__ = ("key",)

    def __init__(self, key: object) -> None:
        self.key = key

    def __lt__(self, other: Reverse) -> bool:
        if self.key is None or other.key is None:
            return self.key is None and other.key is not None
        return self.key > other.key

    def __eq__(self, other: object) -> bool:
        return self.key == other.key


def range_most(docs: np.ndarray, scores: np.ndarray, ranges: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each range of documents begins in a list, and the largest score in it (0 without one)."""
    begins = np.searchsorted(docs, np.arange(ranges + 1) * size)
    most, full = np.zeros(ranges, np.int64), begins[:-1] < begins[1:]
    if full.any():
        most[full] = np.maximum.reduceat(scores, begins[:-1][full])
    return begins, most


def search_shard(shard: Shard, ids: list, terms: np.ndarray, weights: np.ndarray, best: Best, short: int = SHORT, size: int = RANGE) -> None:
    """Add the shard's documents that may be among the best of one query.  ``weights`` are those of its terms times their repeats."""
    held = sorted((int(shard.sizes[i]), i, int(w)) for t, w in zip(terms.tolist(), weights.tolist()) if w > 0 and (i := shard.where.get(t)) is not None)
    lists: list[tuple[np.ndarray, np.ndarray]] = []
    # short lists, term by term
    total, at = 0, 0
    while at < len(held) and total + held[at][0] <= short:
        total, at = total + held[at][0], at + 1
    if at:
        parts = [(*shard.list_of(i), w) for _, i, w in held[:at]]
        docs = np.concatenate([d for d, _, _ in parts])
        gains = np.concatenate([g * w for _, g, w in parts])
        order = np.argsort(docs, kind="stable")
        docs, gains = docs[order], gains[order]
        first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        lists.append((docs[first], np.add.reduceat(gains, first)))
    for _, i, w in held[at:]:
        docs, gains = shard.list_of(i)
        lists.append((docs, gains * w))
    if not lists:
        return
    # lists in order of their largest score: those before `free` can't lift a document to the least score by themselves
    lists.sort(key=lambda x: int(x[1].max()))
    ranges = -(-shard.n // size)
    begins, most = zip(*(range_most(d, s, ranges, size) for d, s in lists))
    most_of = np.stack(most)
    bound = most_of.sum(axis=0)
    below = np.cumsum(most_of, axis=0)  # the most that lists up to this one give together, by range
    for r in np.flatnonzero(bound >= best.least).tolist():
        least = best.least
        if bound[r] < least:
            continue
        free = int(np.searchsorted(below[:, r], least, "left"))  # lists that alone fall short in this range
        spans = [(b[r], b[r + 1]) for b in begins]
        docs = np.concatenate([lists[j][0][slice(*spans[j])] for j in range(free, len(lists))])
        scores = np.concatenate([lists[j][1][slice(*spans[j])] for j in range(free, len(lists))])
        reached, place = np.unique(docs, return_inverse=True)
        sums = np.zeros(len(reached), np.int64)
        np.add.at(sums, place, scores)
        for j in range(free - 1, -1, -1):  # the rest is looked up for documents that can still come in
            keep = sums + below[j, r] >= least
            reached, sums = reached[keep], sums[keep]
            a, b = spans[j]
            if not len(reached) or a == b:
                continue
            own = lists[j][0][a:b]
            p = np.minimum(np.searchsorted(own, reached), len(own) - 1)
            sums = sums + np.where(own[p] == reached, lists[j][1][a:b][p], 0)
        for i in np.flatnonzero(sums >= least).tolist():
            if sums[i] >= best.least:
                best.add(int(sums[i]), ids[reached[i]])


def weights_of(dfs: np.ndarray, total_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * total_docs + 2) / (2 * df + 1))) for df in dfs.tolist()], np.int64)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, shard_bytes: int = SHARD_BYTES, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """The ``k`` documents of the highest score above 0 for each query: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``.

    Equal scores go by ascending id, null ids last; each row of ``docs`` is a document, repeated ones too.  Each different (id,
    text) of ``queries`` is a query, ranked by itself.  Null and empty texts have no terms: such documents aren't found and such
    queries find none.  Whole texts count, and other columns are not read.
    """
    spark = docs.sparkSession
    key_type, id_type = queries.schema[query_col].dataType, docs.schema[id_col].dataType
    asked = queries.select(F.col(query_col).alias("item_id"), F.col(query_text_col).alias("text")).where("text <> ''").distinct()
    chars = asked.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    blocks = -(-chars // block_chars)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"place bigint, doc_id {id_type.simpleString()}, score bigint"
    found = []
    for b in range(blocks):  # one block unless there are millions of characters of queries
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        block = make_block([r["text"] for r in own])
        run, arrow = _indexer(block, to_arrow_type(id_type), shard_bytes)
        index = cut(texts.mapInArrow(run, f"ids array<{id_type.simpleString()}>, {INDEX}"), "search-index")
        totals = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not totals[0]:
            drop_cut(spark, [index])
            continue
        dfs = np.zeros(len(block.vocabulary), np.int64)  # of this block's terms
        for term, df in index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs")).collect():
            dfs[term] = df
        hits = index.mapInArrow(_searcher(block.queries, weights_of(dfs, totals[0]), int(totals[0]), int(totals[1]), k, to_arrow_type(id_type)), schema)
        w = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], f"place bigint, item_id {key_type.simpleString()}")
        found.append(ranked.join(F.broadcast(names), "place").select("item_id", "rank", "doc_id", "score"))
    empty = spark.createDataFrame([], f"item_id {key_type.simpleString()}, rank int, doc_id {id_type.simpleString()}, score bigint")
    for f in found:
        empty = empty.unionAll(f)
    return found[0] if len(found) == 1 else empty


def _searcher(queries: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, total_docs: int, total_terms: int, k: int, id_type: pa.DataType) -> Callable:
    schema = pa.schema([("place", pa.int64()), ("doc_id", id_type), ("score", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {place: Best(k) for place, _, _ in queries}  # kept from shard to shard, so later ones skip more
        with without_gc():
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, _, _, terms, dfs, lengths, docs, tfs = (c[0] for c in batch.slice(i, 1).to_pydict().values())
                    if not ids:
                        continue
                    n = sum(dfs)
                    raw = [np.frombuffer(pa.decompress(x, size, "zstd", True), kind) for x, size, kind in ((lengths, 8 * len(ids), "<i8"), (docs, 4 * n, "<i4"), (tfs, 4 * n, "<i4"))]
                    shard = Shard(raw[0], np.array(terms), np.array(dfs, np.int64), raw[1].astype(np.int64), raw[2], total_docs, total_terms)
                    for place, own, repeats in queries:
                        search_shard(shard, ids, own, weights[own] * repeats, best[place])
        out = [(place, e[1].key, e[0]) for place, b in best.items() for e in b.heap]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run
