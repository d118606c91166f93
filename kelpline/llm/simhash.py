"""SimHash near-duplicates by pivot distance tables (operator 1).

Distinct fingerprints get their Hamming distances to ``PIVOTS`` reference fingerprints once.  Pairs that agree in enough blocks
of bits to be within ``radius`` meet in a bucket; there the largest coordinate difference of their distance tables discards
most of them (by the triangle inequality it is never over their own distance), and the survivors are compared bit by bit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, map_rows, sent
from .components import components

SHINGLE, RADIUS, PIVOTS = 4, 4, 16
#: A fingerprint that more than one in so many rows have is broadcast, so there are fewer of these than this.
OFTEN = 1000
#: Groups over this size are searched breadth-first; smaller ones by shifted comparison of many groups at once.
SHIFTED = 64
#: Hashes that are spread into bits at a time.
BLOCK = 65_536


def shingle_hashes(texts: list[list[bytes]], width: int) -> tuple[bytes, np.ndarray]:
    """XXH64 (seed 42, 8 bytes each, highest first) of all shingles of texts given as words, and how many each text has.

    Repeats are included; a text of fewer words than ``width`` is one shingle, one without words has none.
    """
    h, data, counts = xxhash.xxh64_digest, [], []
    for words in texts:
        n = len(words)
        if n <= width:
            data += [h(b" ".join(words), 42)] * bool(n)
            counts.append(int(n > 0))
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        begins = ends - 1
        begins[1:] = ends[:-1]
        begins[0] = 0
        data += [h(joined[a:b], 42) for a, b in zip(begins[: n - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())]
        counts.append(n - width + 1)
    return b"".join(data), np.array(counts, np.int64)


def fingerprints_from(hashes: bytes, counts: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each text: bit set if set in over half the hashes; zero without any."""
    flat, owner, set_in = np.frombuffer(hashes, np.uint8).reshape(-1, 8), np.repeat(np.arange(len(counts)), counts), np.zeros((len(counts), 64), np.int64)
    for i in range(0, len(flat), BLOCK):  # eight times the size as bits
        bits, own = np.unpackbits(flat[i : i + BLOCK], axis=1), owner[i : i + BLOCK]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        set_in[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    packed = np.packbits(2 * set_in > counts[:, None], axis=1)  # first bit of a digest is the highest
    return packed.reshape(-1).view(">u8").astype(np.uint64)


def fingerprints_of(texts: list[str | None], width: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each whole text, over its lower-case words."""
    return fingerprints_from(*shingle_hashes([t.encode().lower().split() if t else [] for t in texts], width))


def pivot_table(size: int = PIVOTS, seed: int = 11) -> np.ndarray:
    """Reference fingerprints: random ones, the same on every machine."""
    return np.random.default_rng(seed).integers(0, 2**64, size, dtype=np.uint64, endpoint=False)


def distances(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)


def block_scheme(distinct: int, radius: int = RADIUS) -> list[int]:
    """Bit masks such that any two fingerprints within ``radius`` agree under one of them at least.

    With m blocks, radius differing bits leave m - radius blocks untouched, so masks are all choices of that many.  More
    blocks mean more copies of each fingerprint but far fewer chance meetings; m is where the two balance.
    """

    def cost(m: int) -> float:
        return math.comb(m, m - radius) * (1 + 0.01 * distinct / 2 ** (64 * (m - radius) / m))

    m = min(range(radius + 1, radius + 6), key=cost)
    edges = [round(64 * i / m) for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(blocks, m - radius)]


def within(prints: np.ndarray, tables: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs (i, j) are within the radius: pivots discard first, four at a time, then bits decide."""
    alive = np.arange(len(i))
    for c in range(0, tables.shape[1], 4):
        gap = np.abs(tables[i[alive], c : c + 4] - tables[j[alive], c : c + 4]).max(axis=1)
        alive = alive[gap <= radius]
    alive = alive[np.bitwise_count(prints[i[alive]] ^ prints[j[alive]]) <= radius]
    return alive


def spanning_links(prints: np.ndarray, tables: np.ndarray, radius: int, pairs: int = 1 << 18) -> list[tuple[int, int]]:
    """Links that connect what is connected within one large group, at most one per member.

    Breadth-first: a fingerprint meets only those not reached yet, so a dense group costs little more than its size.  About
    ``pairs`` comparisons are made at a time, whatever the group's size.
    """
    links: list[tuple[int, int]] = []
    left, queue = np.arange(len(prints)), np.zeros(0, np.int64)
    while len(left):
        if not len(queue):
            queue, left = left[:1], left[1:]
            continue
        wide = max(1, pairs // len(left))
        front, queue = queue[:wide], queue[wide:]
        found: list[np.ndarray] = []
        for begin in range(0, len(left), pairs):
            some = left[begin : begin + pairs]
            i, j = np.repeat(front, len(some)), np.tile(some, len(front))
            ok = within(prints, tables, i, j, radius)
            reached, first = np.unique(j[ok], return_index=True)
            links += zip(i[ok][first].tolist(), reached.tolist())
            found.append(reached)
        new = np.concatenate(found)
        queue, left = np.concatenate([queue, new]), left[~np.isin(left, new, assume_unique=True)]
    return links


def links_in_buckets(keys: np.ndarray, prints: np.ndarray, tables: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of all groups of equal neighbouring keys: every one in small groups, spanning ones in large groups."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, n in zip(starts[sizes > SHIFTED].tolist(), sizes[sizes > SHIFTED].tolist()):
        found = spanning_links(prints[s : s + n], tables[s : s + n], radius)
        if found:
            pairs = np.array(found) + s
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    rank = np.arange(len(keys)) - np.repeat(starts, sizes)
    size = np.repeat(sizes, sizes)
    i = np.flatnonzero((size > 1) & (size <= SHIFTED))
    for shift in range(1, SHIFTED):
        i = i[rank[i] + shift < size[i]]
        if not len(i):
            break
        ok = within(prints, tables, i, i + shift, radius)
        a.append(i[ok])
        b.append(i[ok] + shift)
    return np.concatenate(a), np.concatenate(b)


def whole_groups(batches: Iterable[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Number columns of rows sorted by the first, in runs that end where a group of equal keys ends."""
    held: list[tuple] = []
    join = lambda parts: tuple(np.concatenate(x) for x in zip(*parts))
    for batch in batches:
        if not batch.num_rows:
            continue
        got = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns))
        if held and held[-1][0][-1] != got[0][0]:
            yield join(held)
            held = []
        last = int(np.searchsorted(got[0], got[0][-1]))  # this group may go on in the next batch
        if last:
            yield join([*held, tuple(x[:last] for x in got)])
            held = []
        held.append(tuple(x[last:] for x in got))
    if held:
        yield join(held)


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, pivots: int = PIVOTS) -> DataFrame:
    """Links (``a``, ``b``) between distinct fingerprints (``fp`` longs) within the radius, enough to connect all that are connected."""
    masks = block_scheme(prints.count(), radius)
    table = pivot_table(pivots)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for number, mask in enumerate(masks):
                key = ((fp & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(number * 0x2545F4914F6CDD1D % 2**64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64))], names=["bucket", "fp"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fp in whole_groups(batches, 2):
            fp = fp.view(np.uint64)
            a, b = links_in_buckets(keys, fp, distances(fp, table), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["a", "b"])

    dealt = prints.select("fp").mapInArrow(deal, "bucket bigint, fp bigint")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(meet, "a bigint, b bigint")


def fingerprints(docs: DataFrame, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint's 64 bits as a signed long) of every row."""
    kind = docs.schema[id_col].dataType

    def make() -> Callable[[list[list]], list[list]]:
        return lambda columns: [columns[0], fingerprints_of(columns[1], width).view(np.int64)]

    return map_rows(docs, [id_col, text_col], f"{id_col} {kind.simpleString()}, fp bigint", make, [to_arrow_type(kind), pa.int64()])


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``id_col``, ``fingerprint`` (16 hex digits) and ``component_id``, the least id reachable over links.

    Two rows link if their fingerprints differ in ``radius`` bits or fewer.  Texts are whole; null and empty ones have
    fingerprint zero and link like any others.  Null ids don't count as least unless a component has no others; repeated rows
    are one fingerprint.  Copies are one fingerprint each from the start, and the answers for fingerprints that many rows have
    are broadcast, so no task gets a group of copies.
    """
    each = cut(fingerprints(docs, width, id_col, text_col), "simhash")
    distinct = each.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("copies"))
    roots = components(fingerprint_links(distinct, radius), "simhash-links")
    named = cut(distinct.join(component_ids(distinct, roots, "fp"), "fp", "left").select("fp", "copies", F.coalesce("component_id", "least").alias("component_id")), "simhash-named")
    often = F.col("copies") > each.count() / OFTEN
    common, others = F.broadcast(named.where(often)), named.where(~often)
    found = each.join(common, "fp").unionByName(each.join(common, "fp", "left_anti").join(others, "fp"))
    return found.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def component_ids(distinct: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``key`` and ``component_id`` (the smallest ``least``) of those that have a root.

    Linked ones are few; the least id of each root goes to them by broadcast up to a bound, so a large component isn't gathered.
    """
    linked = cut(distinct.join(roots, distinct[key] == roots.node).select(key, "least", "root"), "simhash-linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return linked.join(sent(least), "root").select(key, "component_id")
