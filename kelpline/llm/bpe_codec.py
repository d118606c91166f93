"""BPE encoding and decoding of whole texts (operator 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame

import numpy as np
import pyarrow as pa

from .bytebpe import PieceTable, codec, in_batches
from .common import map_rows

FORMS = {"n_tokens": ("bigint", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "ids_text": ("string", pa.string()), "decoded": ("string", pa.string())}


def encode_decode(docs: DataFrame, tokenizer: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text by rounds of merges, then decode the ids.

    Returns ``id_col`` and the chosen ``outputs`` of each row: ``n_tokens``, ``ids`` (array<int>), ``ids_text`` (decimal
    ids joined by commas) and ``decoded`` (the ids' text).  A null or empty text has no ids, ``ids_text`` and ``decoded`` are
    then empty.  Null ids and repeated rows are kept as they are; other columns are not read.  A special token's string in
    a text becomes its id, as the library does by default.  ``tokenizer`` is the vocabulary file's path on every machine.
    """
    id_type = docs.schema[id_col].dataType

    def make():
        bpe = codec(tokenizer)
        want_ids = "ids" in outputs

        def of_piece(ids: bytes) -> tuple:
            got = np.frombuffer(ids, "<u4").tolist()
            return ",".join(map(str, got)), bpe.decode_bytes(ids), ids

        pieces = PieceTable(bpe, of_piece)

        def encode(columns: list[list]) -> list[list]:
            keys, texts = columns
            out: dict[str, list] = {k: [] for k in outputs}
            for part in in_batches(texts):
                for values in bpe.encode_batch(texts[part], pieces):
                    text = ",".join([v[0] for v in values])
                    if "n_tokens" in out:
                        out["n_tokens"].append(text.count(",") + 1 if text else 0)
                    if want_ids:
                        out["ids"].append(np.frombuffer(b"".join([v[2] for v in values]), "<u4").astype(np.int32))
                    if "ids_text" in out:
                        out["ids_text"].append(text)
                    if "decoded" in out:
                        out["decoded"].append(b"".join([v[1] for v in values]).decode("utf-8", "replace"))
            return [keys, *out.values()]

        return encode

    from pyspark.sql.pandas.types import to_arrow_type

    schema = ", ".join([f"{id_col} {id_type.simpleString()}", *(f"{k} {FORMS[k][0]}" for k in outputs)])
    return map_rows(docs, [id_col, text_col], schema, make, [to_arrow_type(id_type), *(FORMS[k][1] for k in outputs)])
