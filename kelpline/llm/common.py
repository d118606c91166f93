"""What the text operators share: the table readers, the word rule, shared storage and batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most ids that are broadcast (some 16 bytes each, so 32 MB).
SENT_IDS = 2_000_000
#: What separates words: ASCII white space only, as ``bytes.split()`` has it.
BLANKS = b" \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than ASCII white space, as UTF-8; none for null."""
    return text.encode("utf-8").split() if text else []


@contextmanager
def without_gc() -> Iterator[None]:
    """Batches make millions of small objects without cycles; the collector would scan them again and again.

    At the end, memory that the allocators keep goes back to the machine: worker processes live on between tasks.
    """
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[list[list]], list[list]]], arrow: list[pa.DataType]) -> DataFrame:
    """Apply a function of column lists to row batches of at most about 4 MB of text.

    ``make`` is called once a task; it returns the function, which gets the lists of ``columns`` and returns the output's.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        with without_gc():
            for batch in batches:
                for part in slices(batch):
                    out = f([c.to_pylist() for c in part.columns])
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, arrow)], names=names)

    return df.select(*columns).mapInArrow(run, schema)


def filter_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[[list[list]], list[bool]]]) -> DataFrame:
    """The rows for which a function of column lists says so, with all their columns; nothing is shuffled or joined.

    ``make`` is called once a task, as in ``map_rows``.
    """
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        with without_gc():
            for batch in batches:
                for part in slices(batch):
                    yield part.filter(pa.array(f([part.column(i).to_pylist() for i in at]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def sent(ids: DataFrame, limit: int = SENT_IDS) -> DataFrame:
    """A frame of ids marked for broadcast if it has at most ``limit`` rows (a job counts them); larger ones are left to a shuffle."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, lowest bytes first and compressed: small ones come to little also where engines hold rows in memory."""
    data = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    flat = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, n).T).view("<u8").reshape(n).astype(np.int64)


def slices(batch: pa.RecordBatch, limit: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of a batch of about ``limit`` bytes each; a longer row stands alone."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, min(rows, int(rows * limit / max(1, batch.nbytes))))
    for i in range(0, rows, step):
        yield batch.slice(i, step)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on one machine, where it may be unset, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local"):
            base = f"{spark.conf.get('spark.sql.warehouse.dir')}/kelpline-scratch"
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return base


#: Folders that ``cut`` has written and nobody has removed yet, oldest first, and those of the run in progress (each thread's own).
WRITTEN: list[str] = []
OWN: ContextVar[list[str] | None] = ContextVar("OWN", default=None)


@contextmanager
def own_folders() -> Iterator[list[str]]:
    """What ``cut`` writes inside, in this thread: runs side by side in one driver know their tables apart."""
    token = OWN.set([])
    try:
        yield OWN.get()
    finally:
        OWN.reset(token)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    if OWN.get() is not None:
        OWN.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folders(spark: SparkSession, folders: Iterable[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in list(folders):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        if folder in WRITTEN:
            WRITTEN.remove(folder)


def drop_cut(spark: SparkSession, frames: Iterable[DataFrame]) -> None:
    """Remove tables written by ``cut`` that nothing will read again."""
    names = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for df in frames for f in df.inputFiles()}
    drop_folders(spark, [f for f in WRITTEN if f.rsplit("/", 1)[1] in names])
