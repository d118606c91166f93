"""Alignment of two tokenizers' ids over the same bytes (operator 11), composed from fragments of byte ranges.

Byte offsets where tokens of both end cut them into groups; the last two tokens of a group are linked.  A *fragment* is what a
byte range gives: an open prefix (tokens up to the first common end, whose group may begin before the range), closed groups,
and an open suffix.  Putting two neighbours together closes one more group, whichever way a document's fragments are paired:
the operation is associative.  So

1. texts of up to ``CHUNK`` characters are aligned where they are; longer ones are cut into ranges that go to any task, each
   with the text around it that its tokens depend on;
2. their fragments are put together by rounds over ``FAN`` neighbours, each round a shuffle, until a document has one;
3. links are counted over the corpus, and each document's links are looked up in the counts.

Two tokens that end together have the shorter one's bytes in common, so at most as many pairs of ids occur as tokens have
suffixes that are tokens (``most_pairs``, below two million for vocabularies of 50,000 and 32,000).  That bounds the counts
that tasks are sent, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bytebpe import ByteBpe
from .common import cut, packed, slices, unpacked, without_gc
from .fast_encode import LONGEST, fast

CHUNK, FAN = 65_536, 8
#: Characters encoded at a time.
SEGMENT = 4_096
CACHED_CHARS, CACHE_ENTRIES = 48, 400_000
BLANK = "▁"
#: A single blank between two other characters: both tokenizers begin a token there, whatever stands around.
STABLE = re.compile(r"(?<=\S) (?=\S)")


def pieces_of(text: str) -> list[str]:
    """A text (which begins with a blank) cut before its stable blanks; every piece begins with a blank."""
    parts = STABLE.split(text)
    return [parts[0], *(" " + p for p in parts[1:])]


class Aligner:
    """Both tokenizers; A encodes a text as it is, B puts a blank before it, so a text is given with its blank."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.a, self.byte_path = fast(byte_path), byte_path
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(names)]
        if any(BLANK in n.lstrip(BLANK) for n in names):
            raise ValueError("a piece has a blank after another character, so texts can't be cut at blanks")
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.radix = len(names)
        shown = [np.array([f"{i}{end}".encode() for i in range(n)]) for n, ends in ((len(self.a.sizes), ",|"), (len(names), ",;")) for end in ends]
        # decimal ids of A, then of B, each followed by a comma or by what ends its half of a group
        self.names = np.concatenate(shown)
        self.name_sizes = np.char.str_len(self.names).astype(np.int64)
        self.b_from = 2 * len(self.a.sizes)

    def _a_ids(self, text: str) -> np.ndarray:
        if len(text) > LONGEST:
            return np.frombuffer(b"".join(_plain(self.byte_path).encode_batch([text])[0]), "<u4").astype(np.int64)
        return self.a.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)

    def tokens(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and end offsets of A and of B over the joined pieces, the pieces' ends, and which pieces both tokenizers give back.

        A piece that isn't given back has no tokens and no length.
        """
        segments: list[list[int]] = []
        size = 0
        for i, p in enumerate(pieces):
            odd = len(p) < 2 or p[1].isspace() or p[-1].isspace()
            if not segments or odd or size > SEGMENT or segments[-1][0] < 0:
                segments.append([-1] if odd else [])
                size = 0
            segments[-1].append(i)
            size += len(p)
        groups = [s[1:] if s[0] < 0 else s for s in segments]
        joined = ["".join([pieces[i] for i in g]) for g in groups]
        ok = np.ones(len(pieces), bool)
        a_ids, b_ids = [], []
        for g, text, b in zip(groups, joined, self.b.encode([t[1:] for t in joined], num_threads=1)):
            if b"".join([self.b_bytes[i] for i in b]) == text.encode():
                a_ids.append(self._a_ids(text))
                b_ids.append(np.array(b, np.int64))
                continue
            for i in g:  # one of them isn't given back
                b = self.b.encode(pieces[i][1:], num_threads=1)
                ok[i] = b"".join([self.b_bytes[j] for j in b]) == pieces[i].encode()
                if ok[i]:
                    a_ids.append(self._a_ids(pieces[i]))
                    b_ids.append(np.array(b, np.int64))
        a = np.concatenate(a_ids) if a_ids else np.zeros(0, np.int64)
        b = np.concatenate(b_ids) if b_ids else np.zeros(0, np.int64)
        lengths = np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)) * ok
        return a, np.cumsum(self.a.sizes[a]), b, np.cumsum(self.b_sizes[b]), np.cumsum(lengths), ok

    def written(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
        """Closed groups of tokens that end together at last: their ends, each group's last byte in the text of groups, that text
        (``a1,a2|b1;...``, a ``;`` after the last too), the links as numbers, and tokens before each group's end (A, B)."""
        a_last, b_last = _member(a_ends, b_ends), _member(b_ends, a_ends)
        a_upto, b_upto = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate(([0], b_upto))[a_group]] = a + a_last * len(self.a.sizes)
        order[np.arange(len(b)) + a_upto[b_group]] = self.b_from + b + b_last * self.radix
        text = self.names[order].tobytes().translate(None, b"\0")
        at = np.cumsum(self.name_sizes[order])[a_upto + b_upto - 1] if len(order) else np.zeros(0, np.int64)
        return a_ends[a_last], at, text, a[a_last] * self.radix + b[b_last], np.stack([a_upto, b_upto])

    def pairs(self, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(links, return_counts=True)


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


@lru_cache(maxsize=2)
def _plain(path: str) -> ByteBpe:
    codec = ByteBpe(path)
    codec.special, codec.split_special = {}, None
    return codec


def most_pairs(byte_path: str, piece_path: str) -> int:
    """How many pairs of ids can end together: one is a suffix of the other."""
    from .bytebpe import codec

    both = aligner(byte_path, piece_path)
    a, b = [x for x in codec(byte_path).token_bytes if x], [x for x in both.b_bytes if x]
    of_a, of_b = _times(a), _times(b)
    proper = sum(of_b.get(x[i:], 0) for x in a for i in range(len(x)))
    return proper + sum(of_a.get(x[i:], 0) for x in b for i in range(1, len(x)))


def _times(tokens: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for t in tokens:
        out[t] = out.get(t, 0) + 1
    return out


# -- short texts ----------------------------------------------------------


class PieceCache:
    """What is kept of a piece: tokens of A and B, its groups' text and its links; None if it isn't given back."""

    def __init__(self, both: Aligner) -> None:
        self.both, self.known = both, {}

    def fill(self, wanted: set[str]) -> None:
        fresh = [p for p in wanted if p not in self.known]
        if len(self.known) + len(fresh) > CACHE_ENTRIES:
            self.known.clear()
            fresh = list(wanted)
        a, a_ends, b, b_ends, ends, ok = self.both.tokens(fresh)
        common, at, text, links, upto = self.both.written(a, a_ends, b, b_ends)
        last = np.searchsorted(common, ends[ok], "right")  # groups up to each piece's end
        bounds = np.concatenate(([0], last))
        bytes_at, counts = np.concatenate(([0], at))[bounds].tolist(), np.concatenate((np.zeros((2, 1), np.int64), upto), axis=1)[:, bounds]
        n_a, n_b = np.diff(counts[0]).tolist(), np.diff(counts[1]).tolist()
        raw, link_at = links.tobytes(), (8 * bounds).tolist()
        good = iter(range(len(last)))
        for p, fine in zip(fresh, ok.tolist()):
            if not fine:
                self.known[p] = None
                continue
            i = next(good)
            self.known[p] = n_a[i], n_b[i], text[bytes_at[i] : bytes_at[i + 1]], raw[link_at[i] : link_at[i + 1]]

    def forget_long(self, wanted: set[str]) -> None:
        for p in wanted:
            if len(p) > CACHED_CHARS:
                self.known.pop(p, None)


ALIGNED = "n_a bigint, n_b bigint, groups string, pairs binary, times binary"
_ALIGNED = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
NOTHING = (0, 0, "", None, None)


def finished(n_a: int, n_b: int, groups: bytes, links: np.ndarray | tuple[np.ndarray, np.ndarray], both: Aligner, digest: bool) -> tuple:
    pairs, times = links if isinstance(links, tuple) else both.pairs(links)
    text = groups[:-1]
    shown = hashlib.sha256(text).hexdigest() if digest else text.decode()
    return n_a, n_b, shown, packed(np.diff(pairs, prepend=0)), packed(times)


def _short(byte_path: str, piece_path: str, digest: bool, schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_path, piece_path)
        cache = PieceCache(both)
        with without_gc():
            for batch in batches:
                for part in slices(batch):
                    texts = [pieces_of(" " + t) if t else [] for t in part.column(1).to_pylist()]
                    wanted = set().union(*texts)
                    cache.fill(wanted)
                    out = []
                    for pieces in texts:
                        got = [cache.known[p] for p in pieces]
                        if not got or None in got:
                            out.append(NOTHING)
                            continue
                        n_a, n_b, groups, links = zip(*got)
                        out.append(finished(sum(n_a), sum(n_b), b"".join(groups), np.frombuffer(b"".join(links), np.int64), both, digest))
                    cache.forget_long(wanted)
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), _ALIGNED))], schema=schema)

    return run


# -- long texts -----------------------------------------------------------


@dataclass(frozen=True)
class Fragment:
    """What a byte range gives.  ``closed``: it has a common end; if not, all of its tokens are in the prefix.

    ``groups`` are closed on both sides, as written by ``Aligner.written``; ``ok`` is false where bytes aren't given back.
    """

    ok: bool
    closed: bool
    prefix: tuple[np.ndarray, np.ndarray]
    groups: bytes
    pairs: tuple[np.ndarray, np.ndarray]
    counts: tuple[int, int]
    suffix: tuple[np.ndarray, np.ndarray]


NO_IDS = np.zeros(0, np.int64)
EMPTY = Fragment(True, False, (NO_IDS, NO_IDS), b"", (NO_IDS, NO_IDS), (0, 0), (NO_IDS, NO_IDS))


def fragment(both: Aligner, window: str, lo: int, hi: int) -> Fragment:
    """Of the tokens of a window's bytes, those that end in (lo, hi]."""
    a, a_ends, b, b_ends, _, ok = both.tokens(pieces_of(window))
    if not ok.all():
        return Fragment(False, False, (NO_IDS, NO_IDS), b"", (NO_IDS, NO_IDS), (0, 0), (NO_IDS, NO_IDS))
    in_a, in_b = (a_ends > lo) & (a_ends <= hi), (b_ends > lo) & (b_ends <= hi)
    return of_tokens(both, a[in_a], a_ends[in_a], b[in_b], b_ends[in_b])


def of_tokens(both: Aligner, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
    a_at, b_at = np.flatnonzero(_member(a_ends, b_ends)) + 1, np.flatnonzero(_member(b_ends, a_ends)) + 1
    if not len(a_at):
        return Fragment(True, False, (a, b), b"", (NO_IDS, NO_IDS), (len(a), len(b)), (NO_IDS, NO_IDS))
    i, j, m, n = a_at[0], b_at[0], a_at[-1], b_at[-1]
    _, _, text, links, _ = both.written(a[i:m], a_ends[i:m], b[j:n], b_ends[j:n])
    return Fragment(True, True, (a[:i], b[:j]), text, both.pairs(links), (len(a), len(b)), (a[m:], b[n:]))


def compose(both: Aligner, x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges.  Associative; ``EMPTY`` changes nothing."""
    counts = x.counts[0] + y.counts[0], x.counts[1] + y.counts[1]
    ok = x.ok and y.ok
    if not x.closed:
        return Fragment(ok, y.closed, _plus(x.prefix, y.prefix), y.groups, y.pairs, counts, y.suffix)
    if not y.closed:
        return Fragment(ok, True, x.prefix, x.groups, x.pairs, counts, _plus(x.suffix, y.prefix))
    text, pair = group_text(both, *_plus(x.suffix, y.prefix))
    return Fragment(ok, True, x.prefix, x.groups + text + y.groups, _merged(x.pairs, (np.array([pair]), np.array([1])), y.pairs), counts, y.suffix)


def group_text(both: Aligner, a: np.ndarray, b: np.ndarray) -> tuple[bytes, int]:
    return f"{','.join(map(str, a.tolist()))}|{','.join(map(str, b.tolist()))};".encode(), int(a[-1] * both.radix + b[-1])


def _plus(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate((x[0], y[0])), np.concatenate((x[1], y[1]))


def _merged(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pairs, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    times = np.zeros(len(pairs), np.int64)
    np.add.at(times, place, np.concatenate([t for _, t in parts]))
    return pairs, times


def whole(both: Aligner, x: Fragment, digest: bool) -> tuple:
    """A document's row from the fragment of all its bytes, which begins and ends with a group's edge."""
    if not x.ok or not x.closed:
        return NOTHING
    text, pair = group_text(both, *x.prefix)
    return finished(*x.counts, text + x.groups, _merged((np.array([pair]), np.array([1])), x.pairs), both, digest)


def ranges_of(text: str, chunk: int) -> Iterator[tuple[str, int, int]]:
    """Ranges of about ``chunk`` characters of a text that begins with a blank: (window, first and last byte in it).

    Ends are anywhere, and so often within a word; a window reaches from the last stable blank before its range to the first
    one after it.  An end that falls into a longer stretch without such a blank is moved behind the stretch.
    """
    n, begin = len(text), 0
    left = 0  # the last stable blank at or before `begin`
    while begin < n:
        end = min(n, begin + chunk)
        after = STABLE.search(text, end) if end < n else None
        right = after.start() if after else n
        if right - end > chunk:
            end = right
        window = text[left:right]
        lo = len(text[left:begin].encode())
        yield window, lo, lo + len(text[begin:end].encode())
        before = begin if end == right else None
        begin = end
        if before is not None:
            left = right
        else:
            place = text.rfind(" ", left + 1, begin)
            while place > left and not STABLE.match(text, place):
                place = text.rfind(" ", left + 1, place)
            left = max(place, left)


FRAGMENT = "ok boolean, closed boolean, prefix_a binary, prefix_b binary, groups binary, pairs binary, times binary, n_a bigint, n_b bigint, suffix_a binary, suffix_b binary"
_FRAGMENT = [(f.split()[0], {"boolean": pa.bool_(), "binary": pa.binary(), "bigint": pa.int64()}[f.split()[1]]) for f in FRAGMENT.split(", ")]


def to_row(x: Fragment) -> tuple:
    return x.ok, x.closed, packed(x.prefix[0]), packed(x.prefix[1]), x.groups, packed(x.pairs[0]), packed(x.pairs[1]), *x.counts, packed(x.suffix[0]), packed(x.suffix[1])


def of_row(ok, closed, prefix_a, prefix_b, groups, pairs, times, n_a, n_b, suffix_a, suffix_b) -> Fragment:
    return Fragment(ok, closed, (unpacked(prefix_a), unpacked(prefix_b)), groups, (unpacked(pairs), unpacked(times)), (n_a, n_b), (unpacked(suffix_a), unpacked(suffix_b)))


def _long(texts: DataFrame, byte_path: str, piece_path: str, digest: bool, chunk: int, fan: int, schema: pa.Schema, ddl: str) -> DataFrame:
    """Texts of any length: ranges on any task, then rounds that put neighbours together."""
    id_field = schema.field(0)
    parts = pa.schema([("ref", pa.int64()), id_field, ("k", pa.int64()), ("window", pa.string()), ("lo", pa.int64()), ("hi", pa.int64())])
    made = pa.schema([("ref", pa.int64()), id_field, ("k", pa.int64()), *_FRAGMENT])
    id_ddl = ddl.split(", ")[0]

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ref, key, text = (batch.column(i)[row] for i in range(3))
                for k, (window, lo, hi) in enumerate(ranges_of(" " + text.as_py(), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((ref.as_py(), key.as_py(), k, window, lo, hi), parts.types)], schema=parts)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_path, piece_path)
        with without_gc():
            for batch in batches:
                for part in slices(batch):
                    rows = [to_row(fragment(both, *x)) for x in zip(*(part.column(i).to_pylist() for i in (3, 4, 5)))]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FRAGMENT))], schema=made)

    def together(group: pa.Table) -> pa.Table:
        both, rows = aligner(byte_path, piece_path), group.sort_by("k").to_pylist()
        x = of_row(*(rows[0][n] for n, _ in _FRAGMENT))
        for r in rows[1:]:
            x = compose(both, x, of_row(*(r[n] for n, _ in _FRAGMENT)))
        values = rows[0]["ref"], rows[0][id_field.name], rows[0]["k"] // fan, *to_row(x)
        return pa.table([pa.array([v], t) for v, t in zip(values, made.types)], schema=made)

    def last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_path, piece_path)
        for batch in batches:
            for part in slices(batch):
                rows = part.to_pylist()
                done = [whole(both, of_row(*(r[n] for n, _ in _FRAGMENT)), digest) for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(c, t) for c, t in zip(zip(*done), _ALIGNED))], schema=schema)

    longest = texts.agg(F.max(F.length("_text"))).first()[0]
    if longest is None:
        return texts.sparkSession.createDataFrame([], ddl)
    dealt = texts.select(F.monotonically_increasing_id().alias("ref"), "_id", "_text").mapInArrow(split, f"ref bigint, {id_ddl}, k bigint, window string, lo bigint, hi bigint")
    found = cut(dealt.repartition("ref", "k").mapInArrow(encode, f"ref bigint, {id_ddl}, k bigint, {FRAGMENT}"), "alignment-fragments")
    left = -(-(longest + 1) // chunk)
    while left > 1:
        found = found.withColumn("_next", F.floor(F.col("k") / fan)).groupBy("ref", "_next").applyInArrow(together, f"ref bigint, {id_ddl}, k bigint, {FRAGMENT}")
        left = -(-left // fan)
    return found.mapInArrow(last, ddl)


# -- the corpus -----------------------------------------------------------


def align(docs: DataFrame, byte_path: str, piece_path: str, digest: bool = False, chunk: int = CHUNK, fan: int = FAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups and links of every whole text, with the links' counts over the corpus.

    Returns ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is the most frequent of its B id,
    ties included), ``count_sum`` (of the links' counts) and ``groups`` (``a1,a2|b1;a3|b2,b3``), or with ``digest`` its SHA-256 as
    ``groups_sha256`` ('' without tokens).  Texts that are null, empty or not given back by both tokenizers have zeros.  Special
    tokens' strings are plain text.  Null ids and repeated rows are kept and count each; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType
    schema = pa.schema([("_id", to_arrow_type(id_type)), *zip((f.split()[0] for f in ALIGNED.split(", ")), _ALIGNED)])
    ddl = f"_id {id_type.simpleString()}, {ALIGNED}"
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    is_long = F.coalesce(F.length("_text") > chunk, F.lit(False))
    short = texts.where(~is_long).mapInArrow(_short(byte_path, piece_path, digest, schema), ddl)
    rows = cut(short.unionAll(_long(texts.where(is_long), byte_path, piece_path, digest, chunk, fan, schema, ddl)), "alignment")
    counts = pair_counts(rows)
    held = counts.toArrow()
    pairs, n = held.column("pair").to_numpy(), held.column("n").to_numpy()
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    radix = aligner(byte_path, piece_path).radix
    most = np.zeros(radix, np.int64)
    np.maximum.at(most, pairs % radix, n)
    sent = docs.sparkSession.sparkContext.broadcast((pairs, n, n == most[pairs % radix]))
    shown = "groups_sha256" if digest else "groups"
    out = pa.schema([("doc_id", to_arrow_type(id_type)), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), (shown, pa.string())])

    def looked_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times_of, best = sent.value
        with without_gc():
            for batch in batches:
                for part in slices(batch):
                    links, n_best, sums = [], [], []
                    for p, t in zip(part.column("pairs").to_pylist(), part.column("times").to_pylist()):
                        if p is None:
                            links.append(0), n_best.append(0), sums.append(0)
                            continue
                        own, times = np.cumsum(unpacked(p)), unpacked(t)
                        at = np.searchsorted(known, own)
                        links.append(int(times.sum()))
                        n_best.append(int(times[best[at]].sum()))
                        sums.append(int((times * times_of[at]).sum()))
                    numbers = [part.column("n_a"), part.column("n_b"), *(pa.array(x, pa.int64()) for x in (links, links, n_best, sums))]
                    yield pa.RecordBatch.from_arrays([part.column("_id"), *numbers, part.column("groups")], schema=out)

    return rows.mapInArrow(looked_up, f"doc_id {id_type.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, {shown} string")


def pair_counts(rows: DataFrame) -> DataFrame:
    """Links of each pair of ids over all rows: added up within tasks, then over them.  At most ``most_pairs`` rows."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = (NO_IDS, NO_IDS), [], 0
        with without_gc():
            for batch in batches:
                for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    waiting.append((np.cumsum(unpacked(p)), unpacked(t)))
                    size += len(waiting[-1][0])
                    if size > 2_000_000:
                        held, waiting, size = _merged(held, *waiting), [], 0
            pairs, n = _merged(held, *waiting)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], schema=schema)

    return rows.where("pairs is not null").select("pairs", "times").mapInArrow(add, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
