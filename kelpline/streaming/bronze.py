"""Raw events from arriving files: each micro-batch is appended as a batch load would be, once per batch id and checkpoint."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import cdc
from ..plans.loads import append_events, ensure_keys
from ..sources.contracts import source
from ..sources.csv_files import align
from ..sources.tables import TableStore


def ingest(store: TableStore, source_name: str, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Read the folder's files as they come (all that are there, then stop, unless another trigger is given) into bronze."""
    spec = source(source_name)
    text = StructType([StructField(c, StringType()) for c in spec.payload])
    stream = store.spark.readStream.schema(text).options(header=True, nullValue="NULL").csv(folder)

    ensure_keys(store)

    def write(batch: DataFrame, number: int) -> None:
        batch_id = f"stream-{zlib.crc32(checkpoint.encode()):08x}-{number}"
        done = store.read(spec.bronze_table).where((F.col("batch_id") == batch_id) & (F.col("source_file") == folder))
        if done.isEmpty():  # a batch that is replayed after a failure was written whole or not at all
            append_events(store, {source_name: cdc.enrich(align(batch, spec), source_name, batch_id, folder)}, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
