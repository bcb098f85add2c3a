"""Helpers that all corpus operators share: durable intermediate tables, let-bindings, and
numpy views of the Arrow batches that Spark hands to Python tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words in most contracts: space and \t to \r.
SPACES = " \t\n\x0b\x0c\r"
_MULTIPLIER = 0x9E3779B97F4A7C15


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local tests a
    temporary folder that is then set as such."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tapeline-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder. It cuts the lineage, survives lost executors,
    and tells the planner its true size, so that joins broadcast it only below Spark's threshold."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of written() that only other written tables were made from."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Most bytes of a table that is broadcast.
BROADCAST = 32 << 20


def broadcast_if_small(table: DataFrame, size: Column) -> DataFrame:
    """A written table, to be broadcast if the sizes of its rows (bytes) sum up to BROADCAST at most; a
    larger one is joined as Spark finds best."""
    total = table.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(table) if total <= BROADCAST else table


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- numpy over Arrow batches


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at.astype(np.int64)


def slices(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of up to `most` bytes; a longer row comes alone."""
    low, rows = 0, len(at) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield low, high
        low = high


def spaced(data: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows low to high with a space after each, and where each row starts."""
    ends = at[low : high + 1] - at[low]
    return np.insert(data[at[low] : at[high]], ends[1:], 32), ends + np.arange(high - low + 1)


def byte_class(members: Callable[[int], bool]) -> np.ndarray:
    return np.array([members(b) for b in range(256)])


LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
NOT_SPACE = byte_class(lambda b: b != 32 and not 9 <= b <= 13)


def word_bounds(buffer: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes of a class; the buffer ends outside of one."""
    mask = inside[buffer]
    turns = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        turns = np.concatenate(([0], turns))
    return turns[0::2], turns[1::2]


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        pair = []
        for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = pair
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(buffer: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(len(buffer))[0], out=sums[1:])
    return sums


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), from prefix_hash."""
    back = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def int64s(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
