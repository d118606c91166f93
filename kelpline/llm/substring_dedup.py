"""Removal of word sequences that an earlier document has (operator 3), by difference-cover anchors.

A window is ``width`` consecutive words.  Positions p with p mod v in a difference cover carry anchors: hashes of the
``width - v + 1`` words from there.  Wherever two documents share a window, at any offsets, some shift below v brings both to
cover positions, so they share an anchor inside it.  The work runs in three steps over blobs of numpy arrays:

1. anchors meet by hash; only those that two rows or more have are reported back to their documents;
2. windows around shared anchors are extended to their full width and meet by hash; those that a smaller id has are reported;
3. each document drops the words of its reported windows.

Occurrences that meet within a task are settled there, and a task sends on one witness of each hash, so a passage that a third
of all documents have costs each later task one entry a sender.  Texts are dealt to parts of about ``PART_BYTES`` once and that
exchange is read by both later steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, without_gc

WIDTH = 13
PART_BYTES, BUCKET_ENTRIES = 8_000_000, 1_000_000
#: Perfect difference sets, each a smallest cover of its period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
LAST = 2**63 - 1
BLOB = "bucket bigint, part bigint, hashes binary, ids binary, refs binary, counts binary, places binary"
FIELDS = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), *((n, pa.binary()) for n in ("hashes", "ids", "refs", "counts", "places"))])


def difference_cover(width: int) -> tuple[int, tuple[int, ...]]:
    """Period and cover: the longest period that leaves anchors at least half a window long."""
    period = max(v for v in COVERS if v <= (width + 1) // 2 or v == 1)
    return period, COVERS[period]


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows_at(hashes: np.ndarray, at: np.ndarray, width: int, seed: int = 5) -> np.ndarray:
    """Hash of the ``width`` words from each place."""
    out = np.zeros(len(at), np.uint64)
    for j, m in enumerate(multipliers(width, seed + width)):
        out += hashes[at + j] * m
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def plane(values: np.ndarray) -> bytes:
    """Bytes of the same significance together: high ones are mostly alike and cost nothing once compressed."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplane(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def blobs(by: np.ndarray, hashes: np.ndarray | None, ids: np.ndarray | None, refs: np.ndarray, places: np.ndarray, out: list[tuple], buckets: int = 1) -> None:
    """A row per bucket (entries with hashes) or part (reports); entries keep their order, so ids and refs are stored once a run.

    Reports have a part and pass through some bucket, entries have none.
    """
    order = np.argsort(by, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(by[order])) + 1):
        if not len(at):
            continue
        r, key = refs[at], int(by[at[0]])
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        lengths = np.diff(np.append(first, len(at))).astype("<i4")
        out.append(
            (
                key if hashes is not None else key % buckets,
                None if hashes is not None else key,
                None if hashes is None else hashes[at].tobytes(),
                None if ids is None else plane(ids[at][first]),
                plane(r[first]),
                plane(lengths),
                plane(places[at].astype("<i4")),
            )
        )


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(FIELDS), FIELDS.types)], schema=FIELDS)


def spread(refs: list, counts: list) -> np.ndarray:
    return np.concatenate([np.repeat(unplane(r, "<i8"), unplane(c, "<i4")) for r, c in zip(refs, counts)])


def anchors(buckets: int, parts: int, width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Step 1, first half: rows (ref, text) -> anchors by bucket, and positions that were settled here, by part."""
    period, cover = difference_cover(width)
    size = width - period + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        with without_gc():
            for batch in batches:
                for part in slices(batch, PART_BYTES):
                    yield to_batch(of_slice(known, part.column(0).to_pylist(), part.column(1).to_pylist()))

    def of_slice(known: WordHashes, keys: list[int], texts: list[str | None]) -> list[tuple]:
        found, refs, places = [], [], []
        for ref, text in zip(keys, texts):
            words = text.encode().split() if text else []
            if len(words) < width:
                continue
            h = known.of(words)
            at = np.concatenate([np.arange(d, len(words) - size + 1, period) for d in cover])
            at.sort()
            found.append(windows_at(h, at, size))
            refs.append(np.full(len(at), ref, np.int64))
            places.append(at)
        out: list[tuple] = []
        if not found:
            return out
        h, r, p = np.concatenate(found), np.concatenate(refs), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        sizes = np.diff(np.append(starts, len(order)))
        low, high = np.minimum.reduceat(r[order], starts), np.maximum.reduceat(r[order], starts)
        shared = np.repeat(low != high, sizes)
        settled = np.sort(order[shared])
        if len(settled):
            blobs(r[settled] % parts, None, None, r[settled], p[settled], out, buckets)
        witness = order[starts[low != high]]  # of a settled hash, for other tasks
        r[witness], p[witness] = 0, -1
        sent = np.sort(np.concatenate([order[~shared], witness]))
        bucket = (h[sent] >> np.uint64(32)) % np.uint64(buckets)
        blobs(bucket.astype(np.int64), h[sent].astype("<u4"), None, r[sent], p[sent], out)
        return out

    return run


def shared_anchors(parts: int) -> Callable[[pa.Table], pa.Table]:
    """Step 1, second half: one bucket's anchors -> places of those that two senders or more have, by part."""

    def run(bucket: pa.Table) -> pa.Table:
        out = passed_on(bucket)
        rows = bucket.filter(pc.is_null(bucket["part"]))
        if rows.num_rows:
            h = np.concatenate([np.frombuffer(x, "<u4") for x in rows["hashes"].to_pylist()])
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            r = spread(rows["refs"].to_pylist(), rows["counts"].to_pylist())
            p = np.concatenate([unplane(x, "<i4") for x in rows["places"].to_pylist()])
            at = np.flatnonzero(twice & (p >= 0))
            if len(at):
                blobs(r[at] % parts, None, None, r[at], p[at], out)
        return pa.Table.from_batches([to_batch(out)])

    return run


def passed_on(bucket: pa.Table) -> list[tuple]:
    """Reports that were settled before they came here."""
    rows = bucket.filter(pc.is_valid(bucket["part"])).to_pylist()
    return [tuple(r[n] for n in FIELDS.names) for r in rows]


def reported(table: pa.Table) -> dict[int, np.ndarray]:
    """Places by ref, from a part's reports."""
    if not table.num_rows:
        return {}
    r = spread(table["refs"].to_pylist(), table["counts"].to_pylist())
    p = np.concatenate([unplane(x, "<i4") for x in table["places"].to_pylist()])
    order = np.argsort(r, kind="stable")
    r, p = r[order], p[order]
    starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    return dict(zip(r[starts].tolist(), np.split(p, starts[1:])))


def extend(buckets: int, parts: int, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Step 2, first half: a part's texts and shared anchors -> full windows by bucket, and windows settled here, by part."""
    period, _ = difference_cover(width)

    def run(texts: pa.Table, reports: pa.Table) -> pa.Table:
        out: list[tuple] = []
        near = reported(reports)
        if near:
            with without_gc():
                of_part(texts, near, out)
        return pa.Table.from_batches([to_batch(out)])

    def of_part(texts: pa.Table, near: dict[int, np.ndarray], out: list[tuple]) -> None:
        known, seen = WordHashes(), set()
        found, ids, refs, places = [], [], [], []
        for ref, key, text in zip(texts["ref"].to_pylist(), texts["order_id"].to_pylist(), texts["text"].to_pylist()):
            if ref not in near or ref in seen:
                continue
            seen.add(ref)  # equal rows have equal windows
            words = text.encode().split()
            n = len(words) - width + 1
            mark = np.zeros(n + period, bool)
            p = near[ref]
            for k in range(period):
                mark[np.maximum(p - k, 0)] |= p >= k
            at = np.flatnonzero(mark[:n])
            found.append(windows_at(known.of(words), at, width))
            ids.append(np.full(len(at), key, np.int64))
            refs.append(np.full(len(at), ref, np.int64))
            places.append(at)
        if not found:
            return
        h, d, r, p = map(np.concatenate, (found, ids, refs, places))
        settled, sent = by_least(h, d)
        if len(settled):
            blobs(r[settled] % parts, None, None, r[settled], p[settled], out, buckets)
        bucket = (h[sent] >> np.uint64(40)) % np.uint64(buckets)
        blobs(bucket.astype(np.int64), h[sent], d[sent], r[sent], p[sent], out)

    return run


def by_least(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries that another with the same hash and a smaller id precedes, and the others; both in their first order."""
    order = np.argsort(h, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
    least = np.repeat(np.minimum.reduceat(d[order], starts), np.diff(np.append(starts, len(order))))
    later = d[order] > least
    return np.sort(order[later]), np.sort(order[~later])


def repeated_windows(parts: int) -> Callable[[pa.Table], pa.Table]:
    """Step 2, second half: one bucket's windows -> places of those that a smaller id has, by part."""

    def run(bucket: pa.Table) -> pa.Table:
        out = passed_on(bucket)
        rows = bucket.filter(pc.is_null(bucket["part"]))
        if rows.num_rows:
            counts = rows["counts"].to_pylist()
            h = np.concatenate([np.frombuffer(x, "<u8") for x in rows["hashes"].to_pylist()])
            later, _ = by_least(h, spread(rows["ids"].to_pylist(), counts))
            if len(later):
                r = spread(rows["refs"].to_pylist(), counts)[later]
                p = np.concatenate([unplane(x, "<i4") for x in rows["places"].to_pylist()])[later]
                order = np.argsort(r, kind="stable")
                blobs(r[order] % parts, None, None, r[order], p[order], out)
        return pa.Table.from_batches([to_batch(out)])

    return run


def remove(width: int, carry: list[str], schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Step 3: a part's texts and repeated windows -> what is kept of each text."""

    def run(texts: pa.Table, reports: pa.Table) -> pa.Table:
        near, sizes, gone, kept = reported(reports), [], [], []
        with without_gc():
            for ref, text in zip(texts["ref"].to_pylist(), texts["text"].to_pylist()):
                words = text.encode().split() if text else []
                drop = 0
                if ref in near:
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = np.unique(near[ref])
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    drop = len(words) - int(stay.sum())
                    left = [words[i] for i in np.flatnonzero(stay).tolist()]
                else:
                    left = words
                sizes.append(len(words))
                gone.append(drop)
                kept.append(b" ".join(left).decode())
        return pa.Table.from_arrays([*(texts[c] for c in carry), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return run


def deduplicate(docs: DataFrame, width: int = WIDTH, carry: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove from every text the words of each ``width``-word window that also starts in a document with a smaller id.

    Returns the ``carry`` columns, ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by blanks).  Windows are those
    of the whole input texts; words are runs without ASCII white space.  Texts that are null, empty or shorter than a window
    lose nothing.  A null id counts as larger than all others; rows with equal ids don't remove each other's words.
    Hashes have 64 bits plus the bucket's for full windows; a shorter hash is used only to find candidates.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    size = docs.agg(F.sum(F.octet_length(text_col).cast("bigint"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    period, cover = difference_cover(width)
    buckets = max(1, int(size / 6 * len(cover) / period / BUCKET_ENTRIES))
    ref = F.xxhash64(id_col, text_col).bitwiseAND(LAST)
    scan = docs.select(ref.alias("ref"), F.col(text_col).alias("text"))
    held = docs.select(ref.alias("ref"), F.coalesce(F.col(id_col), F.lit(LAST)).cast("bigint").alias("order_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry)).withColumn("part", F.pmod("ref", F.lit(parts)))
    texts = held.repartition("part")

    met = scan.mapInArrow(anchors(buckets, parts, width), BLOB).groupBy("bucket").applyInArrow(shared_anchors(parts), BLOB)
    full = texts.groupBy("part").cogroup(met.groupBy("part")).applyInArrow(extend(buckets, parts, width), BLOB)
    again = full.groupBy("bucket").applyInArrow(repeated_windows(parts), BLOB)
    result = docs.select(*carry).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return texts.groupBy("part").cogroup(again.groupBy("part")).applyInArrow(remove(width, [f"carry_{c}" for c in carry], to_arrow_schema(result)), result)


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages removed; texts that lose nothing stay as they are, ``n_chars`` follows the text.

    Columns go by their places meanwhile, so they may have any names.
    """
    place = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    done = deduplicate(docs.toDF(*place.values()), carry=tuple(place.values()), id_col=place["doc_id"], text_col=place["text"])
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("bigint")}
    now = {c: F.when(F.col("n_removed") > 0, changed[c]).otherwise(F.col(p)) if c in changed else F.col(p) for c, p in place.items()}
    return done.select(*(x.alias(c) for c, x in now.items()))
