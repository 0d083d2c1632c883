"""Helpers shared by the training-data operators: tables, scratch space, shared arrays, slices of texts and hashes."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words end at one of these; the same class in the DataFrame and the SQL form.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold that decides what a model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


class Scratch:
    """Tables written to the shared folder of the cluster, to cut lineage and to keep a result that several jobs read.

    The folder is that of ``spark.checkpoint.dir``; only on a local master, where none is set (in tests), is a local one made.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="quillspark-")
            spark.sparkContext.setCheckpointDir(base)
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of an Arrow batch of texts; Spark's own limits would let long texts make batches of a GB.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch limits to these, and leaves lower ones; results don't depend on them."""
    in_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = in_bytes(spark.conf.get(key)) if key.endswith("BytesPerBatch") else int(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


MARK = b"quillspark-array"
#: What the pickle of a long bytearray holds before its contents.
_HEAD = pickle.dumps(bytearray(MARK + bytes(1 << 17)), pickle.HIGHEST_PROTOCOL).find(MARK)


class Shared:
    """Named arrays in one broadcast that the workers of an executor map from the executor's one file of it.

    So an executor holds one copy, in pages that the system may drop and read again, whatever the number of its workers.
    Filled on the driver through ``array``, sent by ``send``, read in tasks through ``arrays``. Where the file can't
    be mapped (an encrypted broadcast), the value is loaded as usual.
    """

    def __init__(self, layout: dict[str, tuple[type, int]]):
        self.places, at = {}, len(MARK)
        for name, (kind, n) in layout.items():
            at += -(_HEAD + at) % 64
            self.places[name] = (kind, n, at)
            at += np.dtype(kind).itemsize * n
        self.data, self.held = bytearray(max(at, 1 << 17)), None
        self.data[: len(MARK)] = MARK

    def array(self, name: str) -> np.ndarray:
        kind, n, at = self.places[name]
        return np.frombuffer(self.data, kind, n, at)

    def send(self, spark: SparkSession) -> Shared:
        self.held = spark.sparkContext.broadcast(self.data)
        self.data = None
        return self

    def arrays(self) -> dict[str, np.ndarray]:
        path, raw = getattr(self.held, "_path", None), None
        if path and not hasattr(self.held, "_value"):
            whole = np.memmap(path, np.uint8, "r")
            raw = whole[_HEAD:] if bytes(whole[_HEAD : _HEAD + len(MARK)]) == MARK else None
        if raw is None:
            raw = np.frombuffer(self.held.value, np.uint8)
        return {name: np.asarray(raw[at : at + np.dtype(kind).itemsize * n]).view(kind) for name, (kind, n, at) in self.places.items()}


#: Up to so many rows of a unique side are broadcast; a key of more rows than HOT_ROWS is joined apart from the others.
UNIQUE_ROWS, HOT_ROWS = 2_000_000, 1_000_000


def join_unique(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined to a table of few narrow columns with one row for each key, however many rows share a key.

    Up to UNIQUE_ROWS of the table are broadcast, after a count. Beyond, the keys with more than HOT_ROWS rows (so at most one for each
    HOT_ROWS of rows) are broadcast with their matches, and only the rest is shuffled by key.
    """
    if unique.count() <= UNIQUE_ROWS:
        return rows.join(F.broadcast(unique), key, how)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).select(key)
    if hot.isEmpty():
        return rows.join(unique, key, how)
    few = unique.join(F.broadcast(hot), key, "left_semi")
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(unique, key, how)
    return rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, how).unionByName(cold)


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


# --- texts in Python -------------------------------------------------------------------------


def blobs(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each (one row at least), so that memory doesn't follow the batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
S29, S32 = np.uint64(29), np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> S32)) * M1
    h = (h ^ (h >> S29)) * M2
    return h ^ (h >> S32)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of word hashes."""
    return mix(a * M3 + mix(b))
