"""The same byte-level vocabulary run by the compiled encoder, for operators that only need ids or their number."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken

from .bytebpe import ByteBpe, byte_alphabet

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The compiled pattern matcher gives up on very long runs; such texts take the numpy encoder.
LONGEST = 400_000


class FastEncoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.path = path
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.sizes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for t, i in ranks.items():
            self.sizes[i] = len(t)
        for t, i in special.items():
            self.sizes[i] = len(t.encode())

    def ids(self, text: str) -> np.ndarray:
        """Ids (unsigned 32 bit) of a whole text; a special token's string becomes its id."""
        if len(text) > LONGEST:
            return np.frombuffer(b"".join(slow(self.path).encode_batch([text])[0]), "<u4")
        return self.encoding.encode_to_numpy(text, allowed_special="all")


@lru_cache(maxsize=2)
def fast(path: str) -> FastEncoder:
    return FastEncoder(path)


@lru_cache(maxsize=2)
def slow(path: str) -> ByteBpe:
    return ByteBpe(path)
