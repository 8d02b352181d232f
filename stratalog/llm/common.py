"""Storage and Arrow helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels take at a time; a longer text is taken alone.
SLICE_BYTES = 1 << 20
#: Bytes and rows of one Arrow batch between the JVM and a Python worker.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 4000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one in local mode only."""
    conf = spark.sparkContext.getConf()
    at = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="stratalog-")
        spark.conf.set("spark.checkpoint.dir", at) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return at.rstrip("/")


class scratch:  # noqa: N801  used as a function
    """``with scratch() as s``: tables that operators write inside are deleted at the end, but those that ``s.keep`` names."""

    _open: list[scratch] = []

    def __enter__(self) -> scratch:
        self.tables: list[DataFrame] = []
        scratch._open.append(self)
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        self.tables = [x for x in self.tables if x is not table]
        return table

    def __exit__(self, *_) -> None:
        scratch._open.remove(self)
        discard(*self.tables)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratalog/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized = path
    if scratch._open:
        scratch._open[-1].tables.append(out)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``materialize`` gave and that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_materialized", None)
        if path:
            jvm = table.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes and rows, so that long texts don't add up in a worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        now = int("".join(c for c in now if c.isdigit() or c == "-") or 0) if now else 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def fold(column: str, n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def byte_slices(column: pa.Array, most: int = SLICE_BYTES):
    """Yield (first row, last row + 1, bytes as uint8, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def token_bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes that don't cross a text's bounds."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each run of bytes, finalised; equal runs have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    power = np.ones(int(lengths.max()) + 1, np.uint64)
    np.cumprod(np.full(len(power) - 1, base), out=power[1:])
    where = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(int(lengths.sum()))
    step = where - np.repeat(starts, lengths)
    terms = (data[where].astype(np.uint64) + np.uint64(1)) * power[step]
    return mix64(np.add.reduceat(terms, np.concatenate(([0], np.cumsum(lengths)[:-1]))))
