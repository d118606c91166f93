"""Cross-entropy difference of two matched n-gram models (operator 2).

A target model (chosen good documents) and a background model (all documents) have the same order, smoothing and vocabulary: all
words of the corpus.  A token's loss is ``-log P(word | word before)``; a document's score is the mean of target loss minus
background loss, low where a text is more like the target than like the corpus.  Counts cover every document, word and pair.

Documents become slices of some 5 MB of text, each with its words numbered.  A slice asks for the counts of its distinct words
and pairs by 64-bit keys; keys meet in buckets, where the counts of all slices are added up and sent back in the order asked.
Buckets are as many as the keys need, so nothing that grows with the corpus reaches the driver or every task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, packed, sent, slices, unpacked, without_gc
from .substring_dedup import WordHashes

#: Least size (a power of two) of the vocabulary under the uniform distribution; a corpus with more words has a larger one.
WORD_BITS = 20
#: Pseudo-counts: of the uniform distribution under single words, and of those under pairs.
FLOOR, BACKOFF = 0.1, 4.0
SLICE_BYTES = 5_000_000
#: Keys asked for in a bucket, about, and the fewest buckets of words and of pairs.
BUCKET_KEYS, LEAST_BUCKETS = 1_000_000, 16
START = 0x9E3779B97F4A7C15


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    pair = before * np.uint64(0xD6E8FEB86659FD93) + word * np.uint64(0xA0761D6478BD642F)
    pair ^= pair >> np.uint64(32)
    pair *= np.uint64(0xE7037ED1A0B428DB)
    return pair


def token_keys(known: WordHashes, texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Of all tokens of the texts: 64-bit keys of the word, of the word before (a start mark at first) and of the pair; tokens a text."""
    found = [known.of(t.encode().lower().split()) if t else np.zeros(0, np.uint64) for t in texts]
    sizes = np.array([len(x) for x in found], np.int64)
    h = np.concatenate([*found, np.zeros(0, np.uint64)])
    before = np.empty_like(h)
    before[1:] = h[:-1]
    some = np.flatnonzero(sizes)
    before[np.cumsum(sizes[some]) - sizes[some]] = START
    return h, before, pair_keys(before, h), sizes


def gaps(keys: np.ndarray) -> bytes:
    """Rising keys as differences; in a bucket the highest bytes are zeros."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def from_gaps(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data).view(np.uint64), dtype=np.uint64)


def slice_words(docs: DataFrame, target: F.Column, id_col: str, text_col: str) -> DataFrame:
    """Slices of documents: ids, tokens a document, whether each is a target, the number of each token's word, keys of the words
    (the start mark is the first), and how many tokens, starts and keys there are."""
    kind = docs.schema[id_col].dataType
    fields = [("slice", pa.int64()), ("ids", pa.list_(to_arrow_type(kind))), ("sizes", pa.binary()), ("targets", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary()), ("n_words", pa.int64()), ("n_pairs", pa.int64()), ("total", pa.int64()), ("target_total", pa.int64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = WordHashes(), TaskContext.get().partitionId() << 32
        with without_gc():
            for batch in batches:
                for part in slices(batch, SLICE_BYTES):
                    word, _, _, sizes = token_keys(known, part.column(1).to_pylist())
                    mine = np.array(part.column(2).to_pylist(), bool)
                    keys, place, often = np.unique(word, return_inverse=True, return_counts=True)
                    order = np.argsort(-often, kind="stable")  # common words have small numbers
                    rank = np.empty(len(keys), np.int64)
                    rank[order] = np.arange(1, len(keys) + 1)
                    tokens, keys = rank[place], np.append(np.array([START], np.uint64), keys[order])
                    pairs = len(np.unique(numbered_pairs(tokens, sizes, len(keys))))
                    counts = sizes + (sizes > 0)  # a start counts once a document
                    values = [number, part.column(0).to_pylist(), packed(sizes), mine.tobytes(), packed(tokens), keys.tobytes(), len(keys), pairs, int(counts.sum()), int(counts[mine].sum())]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, fields)], names=[f for f, _ in fields])
                    number += 1

    schema = f"slice bigint, ids array<{kind.simpleString()}>, sizes binary, targets binary, tokens binary, words binary, n_words bigint, n_pairs bigint, total bigint, target_total bigint"
    return docs.select(F.col(id_col), F.col(text_col), F.coalesce(target, F.lit(False))).mapInArrow(run, schema)


def words_before(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.zeros_like(tokens)
    before[1:] = tokens[:-1]
    some = sizes[sizes > 0]
    before[np.cumsum(some) - some] = 0
    return before


def numbered_pairs(tokens: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    return words_before(tokens, sizes) * words + tokens


def asked(words: np.ndarray, pairs: np.ndarray, buckets: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a slice's words and then distinct pairs, the order in which buckets get them, and where each bucket begins in it."""
    keys = np.concatenate([words, pair_keys(words[pairs // len(words)], words[pairs % len(words)])])
    order = np.concatenate([np.argsort(keys[: len(words)]), len(words) + np.argsort(keys[len(words) :])])
    bucket = ((keys[order] >> np.uint64(32)) * np.repeat(np.array(buckets, np.uint64), [len(words), len(pairs)]) >> np.uint64(32)).astype(np.int64)
    bucket[len(words) :] += buckets[0]
    return keys, order, np.searchsorted(bucket, np.arange(sum(buckets) + 1))


def requests(parts: DataFrame, buckets: tuple[int, int]) -> DataFrame:
    """Of every slice and bucket (words', then pairs'): keys, and their counts in the slice's documents and in its targets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                sizes, tokens, words = unpacked(row["sizes"]), unpacked(row["tokens"]), np.frombuffer(row["words"], np.uint64)
                mine = np.frombuffer(row["targets"], bool)
                pairs, place = np.unique(numbered_pairs(tokens, sizes, len(words)), return_inverse=True)
                chosen = np.repeat(mine, sizes)
                counts = []
                for keep, some in ((slice(None), sizes > 0), (chosen, (sizes > 0) & mine)):
                    single = np.bincount(tokens[keep], minlength=len(words))
                    single[0] = some.sum()
                    counts.append(np.concatenate([single, np.bincount(place[keep], minlength=len(pairs))]))
                keys, order, edges = asked(words, pairs, buckets)
                keys, both = keys[order], [c[order] for c in counts]
                rows = [(b, row["slice"], gaps(keys[a:z]), packed(both[0][a:z]), packed(both[1][a:z])) for b, (a, z) in enumerate(zip(edges, edges[1:])) if z > a]
                types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["bucket", "slice", "keys", "counts", "target_counts"])

    return parts.select("slice", "sizes", "targets", "tokens", "words").mapInArrow(run, "bucket int, slice bigint, keys binary, counts binary, target_counts binary")


def replies(wanted: DataFrame) -> DataFrame:
    """The counts over all slices of each slice's keys, in the order asked, and (with one slice of a bucket) how many keys are distinct."""

    def add_up(rows: pa.Table) -> pa.Table:
        data = [from_gaps(x) for x in rows["keys"].to_pylist()]
        sizes = np.array([len(x) for x in data])
        found, place = np.unique(np.concatenate(data), return_inverse=True)
        out = []
        for name in ("counts", "target_counts"):
            own = np.concatenate([unpacked(x) for x in rows[name].to_pylist()])
            total = np.bincount(place, own, len(found)).astype(np.int64)[place]
            out.append([packed(x) for x in np.split(total, np.cumsum(sizes)[:-1])])
        distinct = np.zeros(len(sizes), np.int64)
        distinct[0] = len(found)
        return pa.table({"slice": rows["slice"], "bucket": rows["bucket"], "counts": pa.array(out[0], pa.binary()), "target_counts": pa.array(out[1], pa.binary()), "n_distinct": pa.array(distinct)})

    return wanted.groupBy("bucket").applyInArrow(add_up, "slice bigint, bucket int, counts binary, target_counts binary, n_distinct bigint")


def losses(counts: np.ndarray, totals: tuple[int, int], vocabulary: int, slots: int, words: np.ndarray, before: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """-log P of each token under the models [target, background]: pair counts over a single-word model over a uniform one.

    ``counts`` has, for each model, ``slots`` words and then pairs.
    """
    out = np.empty((2, len(words)))
    for m, (c, total) in enumerate(zip(counts, totals)):
        single = (c[words] + FLOOR) / (total + FLOOR * vocabulary)
        out[m] = -np.log((c[slots + pairs] + BACKOFF * single) / (c[before] + BACKOFF))
    return out


def score_documents(docs: DataFrame, labels: DataFrame, word_bits: int = WORD_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, mean ``target_loss``, ``background_loss`` and ``score`` (their difference) of every row's whole text.

    The target is the documents labelled good and not toxic (by all their labels, if they have several).  Texts without words have no tokens and zeros.  Null ids and
    repeated rows are kept (each row counts in the background); without target documents the target model is the uniform one.
    """
    least = labels.groupBy(F.col(id_col).alias("good_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = least.where("quality = 1 and coalesce(toxic, 0) = 0").select("good_id")
    good = sent(good)  # ids go to the texts; beyond the bound both are shuffled
    marked = docs.select(id_col, text_col).join(good, F.col(id_col) == F.col("good_id"), "left")
    parts = cut(slice_words(marked, F.col("good_id").isNotNull(), id_col, text_col), "lm-slices")
    sums = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_pairs", "total", "target_total")]).first()
    buckets = tuple(max(LEAST_BUCKETS, -(-n // BUCKET_KEYS)) for n in sums[:2])
    answers = cut(replies(requests(parts, buckets)), "lm-replies")
    distinct = answers.where(F.col("bucket") < buckets[0]).agg(F.sum("n_distinct")).first()[0]
    vocabulary, totals = max(1 << word_bits, distinct or 0), (sums[3], sums[2])
    kind = docs.schema[id_col].dataType

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        sizes, tokens, words = unpacked(row["sizes"]), unpacked(row["tokens"]), np.frombuffer(row["words"], np.uint64)
        pairs, place = np.unique(numbered_pairs(tokens, sizes, len(words)), return_inverse=True)
        order = asked(words, pairs, buckets)[1]
        at = np.argsort(found["bucket"].to_numpy())
        counts = np.empty((2, len(order)))
        for m, name in enumerate(("target_counts", "counts")):
            data = found[name].to_pylist()
            counts[m, order] = np.concatenate([unpacked(data[i]) for i in at])
        each = losses(counts, totals, vocabulary, len(words), tokens, words_before(tokens, sizes), place)
        some = np.flatnonzero(sizes)
        means = np.zeros((2, len(sizes)))
        if len(some):
            means[:, some] = np.add.reduceat(each, np.cumsum(sizes[some]) - sizes[some], axis=1) / sizes[some]
        return pa.table({id_col: pa.array(row["ids"], to_arrow_type(kind)), "n_tokens": pa.array(sizes), "target_loss": pa.array(means[0]), "background_loss": pa.array(means[1]), "score": pa.array(means[0] - means[1])})

    schema = f"{id_col} {kind.simpleString()}, n_tokens bigint, target_loss double, background_loss double, score double"
    own = parts.select("slice", "ids", "sizes", "tokens", "words")
    return own.groupBy("slice").cogroup(answers.select("slice", "bucket", "counts", "target_counts").groupBy("slice")).applyInArrow(score, schema)
