"""Near-duplicate texts of five-word shingles and a similarity of 0.8 or more, by SimHash with pivots (the pipeline's stage of operator 1).

Fingerprints of most such pairs differ in 5 to 16 of 64 bits, too many to find them by blocks of bits.  Texts therefore meet in
buckets of MinHash bands of the same shingle hashes; there distances to pivots and then the fingerprints' own bits discard pairs
over ``RADIUS``, and the survivors are verified by the exact Jaccard similarity of their shingles.  Equal texts (in lower case,
whatever the white space) are one class from the start.

1. a pass over the texts gives each its class, fingerprint and bands;
2. classes meet by band; those with a partner within the radius go on;
3. their texts are read again for the shingles, which meet by the same bands.  Each group is searched breadth-first, so a group
   of many near copies gives spanning links and not all pairs.  A band of more than ``PART`` such classes is dealt to several tasks
   (``hot_groups``), which changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, map_rows, sent
from .components import components
from .hot_groups import links_of_large
from .simhash import component_ids, distances, fingerprints_from, links_in_buckets, pivot_table, shingle_hashes, whole_groups, within

WIDTH, SIMILARITY, RADIUS, PIVOTS = 5, 0.8, 22, 16
#: Bands, and the minima that a band holds: texts of similarity 0.8 share no band with a probability of 0.0002.
BANDS, MINIMA = 16, 4
#: Classes of a band that one task compares, about 2 kB each for texts of 500 words; a larger band is dealt to several.
PART = 10_000
NONE = np.uint64(2**64 - 1)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def class_of(words: list[bytes]) -> int:
    """A 64-bit code of the normalised text, as a signed number."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - 2**63


def bands_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of each text, from the least hash in each of ``BANDS * MINIMA`` bins; an empty bin has its next neighbour's."""
    bins = BANDS * MINIMA  # 64: the highest 6 bits
    owner = np.repeat(np.arange(len(counts)), counts)
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    least = np.full(len(counts) * bins, NONE)
    np.minimum.at(least, owner * bins + (mixed >> np.uint64(58)).astype(np.int64), mixed << np.uint64(6))
    least = least.reshape(len(counts), bins)
    for _ in range(bins):
        empty = least == NONE
        if not empty.any() or empty.all():
            break
        least = np.where(empty, np.roll(least, -1, axis=1) * np.uint64(0xD6E8FEB86659FD93), least)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(counts), BANDS)).copy()
    for i in range(MINIMA):
        key = (key ^ least[:, i::MINIMA]) * np.uint64(0xE7037ED1A0B428DB)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, ``mark`` (a hash of the text as it is), ``code`` (its class), ``fp`` and ``bands`` of every row."""
    kind = docs.schema[id_col].dataType

    def make() -> Callable[[list[list]], list[list]]:
        def sketch(columns: list[list]) -> list[list]:
            words = [words_of(t) for t in columns[2]]
            data, counts = shingle_hashes(words, WIDTH)
            hashes = np.frombuffer(data, ">u8").astype(np.uint64)
            return [columns[0], columns[1], [class_of(w) for w in words], fingerprints_from(data, counts).view(np.int64), list(bands_of(hashes, counts))]

        return sketch

    marked = docs.select(F.col(id_col), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("words"))
    return map_rows(marked, [id_col, "mark", "words"], f"{id_col} {kind.simpleString()}, mark bigint, code bigint, fp bigint, bands array<bigint>", make, [to_arrow_type(kind), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())])


def shingle_sets(docs: DataFrame, text_col: str) -> DataFrame:
    """``code``, ``fp``, ``bands`` and ``shingles`` (32-bit hashes, each once) of every row."""

    def make() -> Callable[[list[list]], list[list]]:
        def sets(columns: list[list]) -> list[list]:
            words = [words_of(t) for t in columns[0]]
            data, counts = shingle_hashes(words, WIDTH)
            hashes = np.frombuffer(data, ">u8").astype(np.uint64)
            each = [np.unique(h.astype(np.uint32)).tobytes() for h in np.split(hashes, np.cumsum(counts)[:-1])]
            return [[class_of(w) for w in words], fingerprints_from(data, counts).view(np.int64), list(bands_of(hashes, counts)), each]

        return sets

    return map_rows(docs, [text_col], "code bigint, fp bigint, bands array<bigint>, shingles binary", make, [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()])


class Sets:
    """The shingle sets of one group, numbered over the group."""

    def __init__(self, blobs: list[bytes]) -> None:
        self.sizes = np.array([len(b) // 4 for b in blobs])
        self.starts = np.cumsum(self.sizes) - self.sizes
        found, self.flat = np.unique(np.frombuffer(b"".join(blobs), np.uint32), return_inverse=True)
        self.own = np.zeros(len(found), bool)

    def similar(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of the others have a Jaccard similarity of ``SIMILARITY`` or more to the one."""
        mine, sizes = self.flat[self.starts[one] : self.starts[one] + self.sizes[one]], self.sizes[others]
        self.own[mine] = True
        begins = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.starts[others] - begins, sizes)
        both = np.add.reduceat(self.own[self.flat[at]], begins, dtype=np.int64)
        self.own[mine] = False
        return both >= SIMILARITY * (len(mine) + sizes - both) - 1e-9


def verified_links(prints: np.ndarray, pivots: np.ndarray, blobs: list[bytes]) -> list[tuple[int, int]]:
    """Links that connect what is connected within one group, at most one a member: each reached member meets those not reached yet."""
    sets, tables, links = Sets(blobs), distances(prints, pivots), []
    left, queue = np.arange(len(prints)), []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        one = queue.pop()
        near = left[within(prints, tables, np.full(len(left), one), left, RADIUS)]
        if len(near):
            near = near[sets.similar(one, near)]
            links += [(one, j) for j in near.tolist()]
            queue += near.tolist()
            left = left[~np.isin(left, near, assume_unique=True)]
    return links


def partners(classes: DataFrame) -> DataFrame:
    """``bucket``, ``code`` and ``size`` of the classes that have another within the radius in a band; ``size`` is how many do there.

    A bucket is named by its classes, so what meets in many bands is one bucket.
    """
    pivots = pivot_table(PIVOTS)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, code, fp in whole_groups(batches, 3):
            fp = fp.view(np.uint64)
            found = np.unique(np.concatenate(links_in_buckets(keys, fp, distances(fp, pivots), RADIUS)))
            if not len(found):
                continue
            starts = np.flatnonzero(np.concatenate(([True], np.diff(keys[found]) != 0)))
            sizes = np.diff(np.append(starts, len(found)))
            mixed = code[found].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            names = np.add.reduceat((mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9), starts)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names.view(np.int64), sizes)), pa.array(code[found]), pa.array(np.repeat(sizes, sizes))], names=["bucket", "code", "size"])

    dealt = classes.select(F.explode("bands").alias("bucket"), "code", "fp")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "code").mapInArrow(meet, "bucket bigint, code bigint, size bigint").dropDuplicates(["bucket", "code"])


def compared(rows: DataFrame) -> DataFrame:
    """Verified links (``a``, ``b``) of the rows (``bucket``, ``code``, ``fp``, ``shingles``) that meet in a bucket."""
    pivots = pivot_table(PIVOTS)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, code, fp, blobs in whole_groups(batches, 4):
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
                links = verified_links(fp[a:z].view(np.uint64), pivots, list(blobs[a:z])) if z - a > 1 else []
                if links:
                    i, j = np.array(links).T + a
                    yield pa.RecordBatch.from_arrays([pa.array(code[i]), pa.array(code[j])], names=["a", "b"])

    each = rows.select("bucket", "code", "fp", "shingles")
    return each.repartition("bucket").sortWithinPartitions("bucket", "code").mapInArrow(meet, "a bigint, b bigint")


def links_of(partnered: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links (``a``, ``b``) of the classes that meet in a bucket, enough to connect all that are connected."""
    large = F.col("size") > PART
    links = compared(partnered.where(~large).join(sets, "code"))
    if partnered.where(large).isEmpty():
        return links
    rows = partnered.where(large).join(sets, "code").select("bucket", "code", "size", "fp", "shingles")
    return links.unionByName(links_of_large(rows, compared, PART))


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``mark`` and ``component_id`` (the least id reachable over links) of every row with an id.

    Two texts link if they are equal in lower case up to white space, or if their sets of five-word shingles have a Jaccard
    similarity of 0.8 or more (and their fingerprints are within ``RADIUS`` bits, as those of all such pairs in the test tables are).  Texts without
    words are one class.  Repeated rows are one class; columns other than these two are not read.
    """
    named = docs.where(F.col(id_col).isNotNull())
    each = cut(sketches(named, id_col, text_col), "near-sketches")
    distinct = each.groupBy("code").agg(F.min(id_col).alias("least"), F.min("fp").alias("fp"), F.min("bands").alias("bands"))
    partnered = cut(partners(distinct), "near-partners")
    again = each.join(partnered.select("code").distinct(), "code", "left_semi").groupBy("code").agg(F.min(id_col).alias("one")).select("one").distinct()
    texts = named.select(F.col(id_col).alias("one"), F.col(text_col).alias("words"))
    sets = shingle_sets(texts.join(sent(cut(again, "near-read")), "one", "left_semi"), "words").dropDuplicates(["code"])
    roots = components(links_of(partnered, sets), "near-links")
    found = component_ids(distinct.select("code", "least"), roots, "code")
    all_named = distinct.select("code", "least").join(found, "code", "left").select("code", F.coalesce("component_id", "least").alias("component_id"))
    return each.join(all_named, "code").select(id_col, "mark", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the least id of each group of near-duplicates, with all its columns.

    Rows without an id can't be named and stay, and so do rows that repeat the kept id's row.  A dropped row is named by id and text, so
    another text under the same id stays.  The names are broadcast to the texts up to a bound; beyond it both are shuffled.
    """
    gone = near_texts(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id", "mark").distinct()
    gone = sent(cut(gone, "near-gone"))
    same = (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["mark"])
    return docs.join(gone, same, "left_anti")
