"""Token counts of whole texts by overlap resynchronisation (operator 10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows
from .fast_encode import FastEncoder, fast

#: Characters encoded at a time, and of overlap between two such chunks to begin with.
CHUNK = 32_768
OVERLAP = 256


def stable_points(text: str, begin: int, end: int) -> list[int]:
    """Places in [begin, end) where every encoding begins a token whatever stands around: a single blank between two
    characters that are not white space.  No pre-token and no special token has a blank after its first character,
    unless it is white space throughout."""
    found, at = [], text.find(" ", max(begin, 1), end)
    while at >= 0:
        if at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
            found.append(at)
        at = text.find(" ", at + 1, end)
    return found


def offsets(encoder: FastEncoder, chunk: str) -> np.ndarray:
    """Where the chunk's tokens begin, in UTF-8 bytes, and at last its length."""
    return np.concatenate(([0], np.cumsum(encoder.sizes[encoder.ids(chunk)])))


def count_whole(encoder: FastEncoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, from overlapping chunks spliced where both encodings begin a token at a stable point.

    Where the overlap has no such point, the left chunk is widened to the right, twice as far each time, until it has
    one or reaches the text's end.
    """
    n, total, begin = len(text), 0, 0
    while True:
        end, wide = min(n, begin + chunk), overlap
        if end == n:
            return total + len(encoder.ids(text[begin:]))
        while True:
            right = max(begin + 1, end - wide)  # where the next chunk would begin
            points = stable_points(text, right + 1, end - 1)
            splice = _common(encoder, text, begin, end, right, points) if points else None
            if splice:
                begin, counted = splice
                total += counted
                break
            wide *= 2
            end = min(n, end + wide)
            if end == n:
                return total + len(encoder.ids(text[begin:]))


def _common(encoder: FastEncoder, text: str, begin: int, end: int, right: int, points: list[int]) -> tuple[int, int] | None:
    """The last stable point at which both chunks begin a token, and the left chunk's tokens before it."""
    left_at = offsets(encoder, text[begin:end])
    right_at = set(offsets(encoder, text[right:end]).tolist())
    for p in reversed(points):
        here = len(text[begin:p].encode())
        i = int(np.searchsorted(left_at, here))
        if left_at[i] == here and len(text[right:p].encode()) in right_at:
            return p, i
    return None


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """UTF-8 bytes and tokens of every whole text, and whether it has more than ``limit`` tokens.

    Texts over ``chunk`` characters are encoded in overlapping chunks, so that the encoder's memory doesn't grow with them.
    A null or empty text has 0 bytes and 0 tokens.  Null ids and repeated rows are kept; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType

    def make():
        encoder = fast(tokenizer)
        encode = encoder.encoding.encode_to_numpy

        def count(columns: list[list]) -> list[list]:
            keys, texts = columns
            sizes = [len(t.encode()) if t else 0 for t in texts]
            counts = [0 if not t else len(encode(t, allowed_special="all")) if len(t) <= chunk else count_whole(encoder, t, chunk, overlap) for t in texts]
            return [keys, sizes, counts, [c > limit for c in counts]]

        return count

    from pyspark.sql.pandas.types import to_arrow_type

    return map_rows(docs, [id_col, text_col], f"{id_col} {id_type.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean", make, [to_arrow_type(id_type), pa.int64(), pa.int64(), pa.bool_()])
