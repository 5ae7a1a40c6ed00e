"""What the text operators share: Arrow access to whole texts, vectorised word hashes, checkpoints."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: [\x20\x09-\x0D].
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text that one NumPy pass takes; one longer document is a pass of its own.
BLOCK = 1 << 20
#: Bytes of an Arrow batch, about: executors hold a few at a time for each task, twice over while one grows.
BATCH = 8 << 20
#: What empties the tables that modules keep for a worker's next tasks; the operator whose tasks the worker ran last.
FORGET: list[Callable[[], None]] = []
#: Paths of the tables that operators have written in this session.
TABLES: list[str] = []
#: A key that more rows share is hot: its rows are not dealt by it.
HOT = 500
_OWNER = [""]


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named, a temporary one on a single machine,
    as in tests, and an error on a cluster, whose machines share no such folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there: executors may be lost afterwards. Shuffle files and
    checkpoints that earlier steps left are deleted now instead of when the driver happens to collect its garbage."""
    checkpoint_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    df.sparkSession._jvm.System.gc()
    return out


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder, until release()."""
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever the session's file systems have it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Deletes the tables that operators have written since the first keep ones, when no result needs them any more."""
    while len(TABLES) > keep:
        remove(spark, TABLES.pop())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def residue(doc_id, modulus: int):
    """crc32 of the id's decimal text, modulo modulus; null ids give null."""
    return F.crc32(doc_id.cast("string")) % modulus


def normalised(text):
    """text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Which bytes of a word's last eight count, by how many it has left.
_MASKS = np.array([(1 << 8 * min(k, 8)) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG = 64
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Words:
    """The words of some texts of a batch. starts, ends: byte places in data; first: for each text, and after the last, the index of its first word."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACES):
        n = len(data)
        word = ~separators[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        before = np.concatenate(([False], word[:-1])) if n else word
        after = np.concatenate((word[1:], [False])) if n else word
        self.data, self.bounds = data, bounds
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: eight at a time, mixed after each eight, so that no two words of up to eight
        bytes meet and no arithmetic pattern of longer ones does."""
        size = self.ends - self.starts
        out = mix(size.astype(np.uint64) * _A)
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        eights = np.ndarray((len(self.data) + 1,), "<u8", padded.data, strides=(1,))
        act = np.flatnonzero(size <= _LONG) if len(size) and size.max() > _LONG else np.arange(len(size))
        at, left = self.starts[act], size[act]
        while len(act):
            out[act] = mix(out[act] * _B ^ (eights[at] & _MASKS[np.minimum(left, 8)]))
            go = np.flatnonzero(left > 8)
            act, at, left = act[go], at[go] + 8, left[go] - 8
        for i in np.flatnonzero(size > _LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes())
        return out

    def texts(self, i: int) -> list[bytes]:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes().split()


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width hashes, from those of its halves, quarters and so on."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    out, block, size, at, left = None, mix(hashes ^ _C), 1, 0, width
    while left:
        if left & 1:
            part = block[at : at + n - width + 1]
            out = part if out is None else mix(out * _A ^ part)
            at += size
        left >>= 1
        if left:
            block = mix(block[:-size] * _B ^ block[size:])
            size *= 2
    return out


def meet(rows: DataFrame, groups: DataFrame, keys: list[str], values: list[str], how: str = "inner") -> DataFrame:
    """rows with the values of groups, which has one row for each of the keys and, in n, how many of rows share it.

    Rows are dealt by their keys, but for those of hot keys: these stay spread, and meet their group's row where they are.
    The hot keys are at most four for each shuffle partition, the commonest first, so that what is broadcast is bounded and
    any other key has less than a quarter of a partition's share of the rows. Null keys meet nothing."""
    # n goes along with the values: both uses of groups then ask for the same columns, and read one exchange.
    packed = groups.select(*keys, "n", F.struct(*values, F.col("n").alias("__n")).alias("__cold"))
    hot = packed.where(F.col("n") > HOT).orderBy(F.desc("n"), *keys).limit(4 * partitions(rows.sparkSession)).select(*keys, F.col("__cold").alias("__hot"))
    spread = F.when(F.col("__hot").isNotNull() | F.greatest(*(F.col(k).isNull() for k in [*keys, keys[0]])), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 30))).otherwise(F.lit(0).cast("long"))
    zero = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("long")  # 0, but no constant that Spark would take out of the join
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", spread)
    joined = marked.join(packed.select(*keys, "__cold", zero.alias("__salt")), [*keys, "__salt"], "left").withColumn("__met", F.coalesce("__hot", "__cold"))
    if how == "inner":
        joined = joined.where("__met IS NOT NULL")
    return joined.select(*rows.columns, *(F.col(f"__met.{v}").alias(v) for v in values))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(array: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, their UTF-8 bytes, bounds of the rows in these) of a string column, nulls as empty."""
    if array.null_count:
        array = pc.fill_null(array, "")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    n = len(array)
    if not n:
        return
    offsets = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, side="right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def strings(array: pa.Array) -> list[str]:
    return pc.fill_null(array, "").to_pylist() if array.null_count else array.to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def tidy() -> None:
    """Gives freed memory back to the system: workers are reused, and hold on to it else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def begin(owner: str) -> None:
    """A worker holds the tables of one operator at a time."""
    if _OWNER[0] != owner:
        for forget in FORGET:
            forget()
        tidy()
        _OWNER[0] = owner


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, owner: str = "") -> DataFrame:
    """df.mapInArrow(run, schema) in batches of at most BATCH bytes or one row, by workers that return memory after each
    task. owner: whose tables the worker may keep. The bound on batches is the session's from here on; results don't
    depend on it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))

    def tended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        try:
            yield from run(batches)
        finally:
            tidy()

    return df.mapInArrow(tended, schema)
