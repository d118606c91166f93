"""Quality classifier: a byte-level convolutional network in numpy (operator 8).

A filter spans ``WIDTH`` bytes and has a weight for each byte value at each place.  Chunks of ``CHUNK`` positions, each with
the ``WIDTH - 1`` bytes after it (so chunks overlap and every position of the text is in one), are max-pooled; the document's
largest and mean pooled activations go through a logistic output.  At scoring, weights of two neighbouring places are added up
beforehand for all byte pairs, so a filter costs a lookup per two bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import filter_rows, map_rows, sent

WIDTH, FILTERS, CHUNK = 6, 16, 512
#: Bounds on the labelled rows that the network learns from, per label: their number, and the bytes of their texts.  Rows are whole.
SAMPLE_PER_LABEL, SAMPLE_BYTES = 2_000, 64_000_000
THRESHOLD = 0.3


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


class ConvNet:
    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.pairs: np.ndarray | None = None

    @staticmethod
    def of(w: np.ndarray, rest: tuple[np.ndarray, ...]) -> ConvNet:
        """A network with given weights, ready for scoring."""
        net = ConvNet()
        net.w, (net.b, net.v, net.c) = w, rest
        return net.freeze()

    def freeze(self) -> ConvNet:
        """Add up the weights of byte pairs, for scoring."""
        self.pairs = np.stack([(self.w[2 * j][:, None, :] + self.w[2 * j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(WIDTH // 2)])
        return self

    @staticmethod
    def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All bytes, each text followed by zeros under the last windows; where chunks begin; chunks of each text."""
        pad = b"\0" * (WIDTH - 1)
        flat = np.frombuffer(b"".join([x for t in texts for x in (t or b"\0", pad)]), np.uint8)
        sizes = np.array([max(1, len(t)) for t in texts])
        begins = np.cumsum(sizes + WIDTH - 1) - sizes - (WIDTH - 1)
        chunks = -(-sizes // CHUNK)
        starts = np.repeat(begins, chunks) + (np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * CHUNK
        return flat, starts, chunks

    def scores(self, texts: list[bytes], block: int = 1 << 18) -> np.ndarray:
        """Probability of label 1 of each whole text."""
        flat, starts, chunks = self.lay_out(texts)
        pair = flat[:-1].astype(np.int32) * 256 + flat[1:]
        ends = np.append(starts[1:], len(flat))
        last = np.cumsum(chunks) - 1  # the zeros after a text aren't positions of its last chunk
        ends[last] -= WIDTH - 1
        pooled = np.empty((len(starts), FILTERS), np.float32)
        i = 0
        while i < len(starts):
            k = min(len(starts), max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right"))))
            a, z = int(starts[i]), int(ends[k - 1])
            act = self.pairs[0].take(pair[a:z], axis=0)
            for j in range(1, WIDTH // 2):
                act += self.pairs[j].take(pair[a + 2 * j : z + 2 * j], axis=0)
            cuts = np.stack([starts[i:k], ends[i:k]], axis=1).ravel() - a
            cuts = cuts[:-1]  # the last chunk runs to the end
            pooled[i:k] = np.maximum.reduceat(act, cuts, axis=0)[::2]
            i = k
        hidden = np.maximum(pooled + self.b, 0)
        first = np.cumsum(chunks) - chunks
        features = np.concatenate([np.maximum.reduceat(hidden, first, axis=0), np.add.reduceat(hidden, first, axis=0) / chunks[:, None]], axis=1)
        return 1 / (1 + np.exp(-np.clip(features.astype(np.float64) @ self.v.astype(np.float64) + float(self.c[0]), -60, 60)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 48, rate: float = 0.01, seed: int = 7) -> ConvNet:
        """Adam on the cross-entropy, both labels weighted alike."""
        rng, params = np.random.default_rng(seed), [self.w, self.b, self.v, self.c]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        share = np.bincount(labels, minlength=2) / len(labels)
        weight = 0.5 / np.maximum(share, 1e-9)
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for group in np.split(order, range(batch, len(order), batch)):
                step += 1
                grads = self.gradients([texts[i] for i in group], labels[group], weight)
                lr = rate * (1 - epoch / epochs)
                for p, g, m, s in zip(params, grads, first, second):
                    g = g + 1e-4 * p
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        return self

    def gradients(self, texts: list[bytes], labels: np.ndarray, weight: np.ndarray, block: int = 512) -> list[np.ndarray]:
        flat, starts, chunks = self.lay_out(texts)
        ends = np.append(starts[1:], len(flat))
        ends[np.cumsum(chunks) - 1] -= WIDTH - 1
        where, top = np.empty((len(starts), FILTERS), np.int64), np.empty((len(starts), FILTERS), np.float32)
        for i in range(0, len(starts), block):  # activations of so many chunks at a time, however long a text is
            first = starts[i : i + block, None]
            at = first + np.arange(CHUNK)
            at = np.where(at < ends[i : i + block, None], at, first)
            act = self.w[0][flat[at]]
            for j in range(1, WIDTH):
                act += self.w[j][flat[at + j]]
            best = act.argmax(axis=1)  # chunk, filter
            top[i : i + block] = np.take_along_axis(act, best[:, None, :], axis=1)[:, 0] + self.b
            where[i : i + block] = np.take_along_axis(at, best, axis=1)
        hidden = np.maximum(top, 0)
        begin = np.cumsum(chunks) - chunks
        most, mean = np.maximum.reduceat(hidden, begin, axis=0), np.add.reduceat(hidden, begin, axis=0) / chunks[:, None]
        features = np.concatenate([most, mean], axis=1)
        p = 1 / (1 + np.exp(-np.clip(features @ self.v + self.c[0], -30, 30)))
        err = ((p - labels) * weight[labels] / len(texts)).astype(np.float32)
        owner = np.repeat(np.arange(len(texts)), chunks)
        down = err[owner, None] * self.v[FILTERS:] / chunks[owner, None]
        down = down + np.where(hidden == most[owner], err[owner, None] * self.v[:FILTERS], 0)
        down = (down * (top > 0)).astype(np.float32)
        gw = np.zeros_like(self.w)
        column = np.broadcast_to(np.arange(FILTERS), where.shape)
        for j in range(WIDTH):
            np.add.at(gw[j], (flat[where + j], column), down)
        return [gw, down.sum(axis=0), (err @ features).astype(np.float32), np.array([err.sum()], np.float32)]


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int, most_bytes: int, id_col: str, text_col: str) -> tuple[list[tuple[int, bytes]], dict[int, int]]:
    """A bounded sample of labelled, not held-out rows (label and whole text), and how many such rows each label has in all.

    Of each label these are the rows with the least hashes of id and text, so a run is repeated exactly: at most ``per_label``, and no
    more than come to ``most_bytes`` (the first in any case).  Repeated rows are learnt from once.  An id with several labels has the least.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality")).where(~held_out(id_col))
    usable = docs.select(id_col, text_col).join(sent(known), id_col).withColumn("place", F.xxhash64(id_col, text_col))
    counted = usable.groupBy("quality").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("place").alias("different")).collect()
    odds, key, rows = {r["quality"]: r["rows"] for r in counted}, F.pmod("place", F.lit(1 << 20)), []
    for label, n in ((r["quality"], r["different"]) for r in counted):
        # a threshold on the hash leaves few rows to sort
        some = usable.where((F.col("quality") == label) & (key < int(min(1.0, 2.0 * per_label / n + 1e-4) * (1 << 20))))
        sizes = some.select(key.alias("key"), "place", F.coalesce(F.octet_length(text_col), F.lit(0)).alias("bytes")).distinct().orderBy("key", "place").limit(per_label).collect()
        fits = max(1, int(np.searchsorted(np.cumsum([r["bytes"] for r in sizes]), most_bytes, "right")))
        for last in sizes[:fits][-1:]:
            taken = some.where((key < last["key"]) | ((key == last["key"]) & (F.col("place") <= last["place"])))
            rows += [(label, (r[text_col] or "").encode()) for r in taken.select("place", text_col).dropDuplicates(["place"]).collect()]
    return sorted(rows), odds


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, most_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> ConvNet:
    """A network from at most ``per_label`` rows of each label; without rows of both labels it gives every text the share of label 1."""
    rows, odds = training_rows(docs, labels, per_label, most_bytes, id_col, text_col)
    net, y = ConvNet(), np.array([r[0] for r in rows], np.int64)
    true = (odds.get(1, 0) + 1) / (odds.get(0, 0) + 1)
    if len(set(y.tolist())) < 2:
        net.v[:] = 0
        net.c[0] = np.log(true)
        return net
    net.fit([r[1] for r in rows], y)
    net.c[0] += np.log(true)  # learnt as if both labels were as frequent
    return net


def score_documents(docs: DataFrame, net: ConvNet, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` of every row, from its whole text alone.

    Null and empty texts are scored as a single zero byte.  Repeated rows get the same score; other columns are not read.
    The network (under 1 MB, whatever the input) is sent along with the tasks.
    """
    kind, w, rest = docs.schema[id_col].dataType, net.w, (net.b, net.v, net.c)

    def make() -> Callable[[list[list]], list[list]]:
        own = ConvNet.of(w, rest)

        def score(columns: list[list]) -> list[list]:
            keys, texts = columns
            scores = own.scores([t.encode() if t else b"" for t in texts])
            held = [zlib.crc32(str(k).encode()) % 5 == 0 if k is not None else False for k in keys]
            return [keys, held, scores.tolist(), (scores >= threshold).astype(np.int32).tolist()]

        return score

    schema = f"{id_col} {kind.simpleString()}, held_out boolean, score double, predicted int"
    return map_rows(docs, [id_col, text_col], schema, make, [to_arrow_type(kind), pa.bool_(), pa.float64(), pa.int32()])


def classify(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """Train on the labelled rows that aren't held out, then score all rows."""
    return score_documents(docs, train(docs, labels, **bounds))


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", **bounds: int) -> DataFrame:
    """The rows predicted to be of quality, with all their columns, filtered where they are."""
    net = train(docs, labels, **bounds)
    w, rest = net.w, (net.b, net.v, net.c)

    def make() -> Callable[[list[list]], list[bool]]:
        own = ConvNet.of(w, rest)
        return lambda columns: (own.scores([t.encode() if t else b"" for t in columns[0]]) >= threshold).tolist()

    return filter_rows(docs, [text_col], make)


def held_out_figures(scored: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Accuracy and area under the ROC curve (by mean ranks) over the labelled rows that are held out."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    by_score = scored.where("held_out").join(known, "doc_id").groupBy("score").agg(F.sum("quality").alias("good"), F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("quality")).alias("right"))
    below = F.sum(F.col("n") - F.col("good")).over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1))  # labelled rows only
    ranked = by_score.withColumn("won", F.col("good") * (F.coalesce(below, F.lit(0)) + (F.col("n") - F.col("good")) / 2))
    r = ranked.agg(F.sum("good").alias("good"), F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum("won").alias("won")).first()
    return {"rows": r["n"], "accuracy": r["right"] / r["n"], "auc": r["won"] / (r["good"] * (r["n"] - r["good"]))}
