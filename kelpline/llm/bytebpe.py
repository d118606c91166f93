"""Byte-level BPE in batched numpy merge rounds.

The symbols of many words lie in one flat array.  A round looks up every
adjacent pair by binary search over the sorted pair keys, takes the lowest rank
of each word, merges all its occurrences from left to right and drops the words
that have no mergeable pair left.  Words are found once per batch of texts and
kept in a bounded cache, so running text costs a dictionary lookup a word.

Texts are never truncated.  A null text counts as an empty one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex

#: The pre-tokenizer's pattern, and what Unicode calls white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
WORDS = regex.compile(PATTERN)
SPACES = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}

#: Longer pieces are encoded each time they occur, so that the cache stays small.
CACHED_CHARS = 64
CACHE_ENTRIES = 500_000
#: Characters of text that are encoded together.
BATCH_CHARS = 4_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: Latin-1's visible characters stand for themselves, the others follow at 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int32)
        for char, b in alphabet.items():
            self.of_byte[b] = vocab[char]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.radix = size
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.none = len(pairs)
        self.split_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._cache: dict[str, bytes] = {}

    # -- merging ---------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * np.int64(self.radix) + right
        at = np.searchsorted(self.keys, key)
        at[at == self.none] = 0
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(self.none))

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols of words of the given (positive) lengths -> flat ids and lengths, by rounds of lowest-rank merges."""
        n = len(lengths)
        done_ids: list[np.ndarray] = []
        done_words: list[np.ndarray] = []
        word = np.repeat(np.arange(n, dtype=np.int32), lengths)
        ids = symbols
        rank = np.full(len(ids), self.none, np.int32)  # of the pair that begins here
        at = np.flatnonzero(word[:-1] == word[1:])
        rank[at] = self._rank(ids[at], ids[at + 1])
        sizes = lengths
        while len(ids):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(rank, starts)
            open_ = least < self.none
            if not open_.all():
                live = np.repeat(open_, sizes)
                done_ids.append(ids[~live])
                done_words.append(word[~live])
                ids, word, rank, least, sizes = ids[live], word[live], rank[live], least[open_], sizes[open_]
                if not len(ids):
                    break
            hit = rank == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            near = at[1:] == at[:-1] + 1
            if near.any():  # overlapping occurrences: every second one of a run
                first = np.flatnonzero(np.concatenate(([True], ~near)))
                run = np.repeat(first, np.diff(np.append(first, len(at))))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            owners = word[at]
            ids, word, rank = ids[keep], word[keep], rank[keep]
            place = np.cumsum(sizes) - sizes  # dense numbers of the words, to count what each lost
            sizes = sizes - np.bincount(np.searchsorted(place, at, "right") - 1, minlength=len(sizes))
            merged = at - np.arange(len(at))  # where each merged pair stands now
            last = len(ids) - 1
            for begin, owner in ((merged, owners), (merged - 1, owners)):
                ok = begin >= 0
                begin, owner = begin[ok], owner[ok]
                pair = (word[begin] == owner) & (begin < last)
                pair &= word[np.minimum(begin + 1, last)] == owner
                rank[begin[~pair & (word[begin] == owner)]] = self.none
                begin = begin[pair]
                rank[begin] = self._rank(ids[begin], ids[begin + 1])
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        flat, owner = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=n)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokenized words, each as little-endian unsigned 32-bit numbers."""
        raw = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat, sizes = self.merge(self.of_byte[np.frombuffer(b"".join(raw), np.uint8)], lengths)
        data, ends = flat.astype("<u4").tobytes(), np.cumsum(sizes * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    # -- texts -----------------------------------------------------------

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that follow one blank; a key that begins with a blank stands for the piece without it, at a stretch's start."""
        todo = [p for p in pieces if p[0] != " "]
        # a token that begins with a blank begins a piece: pieces have no blank inside
        tokens = WORDS.findall(" " + " ".join(todo)) if todo else []
        starts = [i for i, t in enumerate(tokens) if t[0] == " "]
        for p in pieces.difference(todo):
            todo.append(p)
            starts.append(len(tokens))
            tokens += WORDS.findall(p[1:])
        unique = list(set(tokens))
        known = dict(zip(unique, self.encode_words(unique)))
        ids = list(map(known.__getitem__, tokens))
        return {p: ids[a] if b - a == 1 else b"".join(ids[a:b]) for p, a, b in zip(todo, starts, [*starts[1:], len(tokens)])}

    def _plain(self, text: str) -> bytes:
        """Ids of a stretch without special tokens, by its own pre-tokenization."""
        tokens = WORDS.findall(text)
        unique = list(dict.fromkeys(tokens))
        known = dict(zip(unique, self.encode_words(unique)))
        return b"".join([known[t] for t in tokens])

    def pieces(self, segment: str) -> list[str] | None:
        """The segment cut at its single blanks, which always begin a token; None if white space stands otherwise at a cut."""
        parts = segment.split(" ")
        for p in parts:
            if not p or p[0] in SPACES or p[-1] in SPACES:
                return None
        return parts

    def segments(self, text: str) -> Iterator[str | int]:
        """Stretches between special tokens, and those tokens' ids."""
        if not self.special or self.split_special.search(text) is None:
            yield text
            return
        begin = 0
        for m in self.split_special.finditer(text):
            if m.start() > begin:
                yield text[begin : m.start()]
            yield self.special[m[0]]
            begin = m.end()
        if begin < len(text):
            yield text[begin:]

    def encode_batch(self, texts: Iterable[str | None], table: PieceTable | None = None) -> list[list]:
        """For each text the values of its pieces in order (by default their ids as bytes)."""
        table = table or PieceTable(self)
        plans: list[list[tuple[str | int, list[str] | None]]] = []
        want: set[str] = set()
        for text in texts:
            plan = []
            for s in self.segments(text) if text else ():
                parts = self.pieces(s) if isinstance(s, str) else None
                if parts is not None:
                    parts[0] = " " + parts[0]
                    want.update(parts)
                plan.append((s, parts))
            plans.append(plan)
        table.fill(want)
        out = []
        for plan in plans:
            values = []
            for s, parts in plan:
                if isinstance(s, int):
                    values.append(table.value(np.array([s], "<u4").tobytes()))
                elif parts is None:
                    values.append(table.value(self._plain(s)))
                else:
                    values += map(table.get, parts)
            out.append(values)
        return out

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join([self.token_bytes[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens included; broken UTF-8 is replaced as the library does."""
        return b"".join([self.token_bytes[i] for i in ids]).decode("utf-8", "replace")


class PieceTable:
    """What is kept of each piece that follows a blank: ``value`` of its ids.  Holds at most ``CACHE_ENTRIES`` short pieces between batches."""

    def __init__(self, codec: ByteBpe, value=lambda ids: ids) -> None:
        self.codec, self.value, self.known, self.long = codec, value, {}, []
        self.get = self.known.__getitem__

    def fill(self, want: set[str]) -> None:
        fresh = want.difference(self.known)
        if len(self.known) + len(fresh) > CACHE_ENTRIES:
            self.known.clear()
            fresh = want
        else:
            for p in [p for p in self.long if p not in want]:
                del self.known[p]
        self.long = [p for p in fresh if len(p) > CACHED_CHARS]
        if fresh:
            value = self.value
            self.known.update((p, value(ids)) for p, ids in self.codec._learn(fresh).items())


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    """One codec a process and file."""
    return ByteBpe(path)


def in_batches(texts: list, chars: int = BATCH_CHARS) -> Iterator[slice]:
    """Slices of about so many characters each."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))
