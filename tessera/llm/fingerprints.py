"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's five-word shingles. Sketches of parts merge by keeping
the k smallest of their union, and two of them estimate resemblance, containment and the number of distinct shingles. As
a string a sketch is the hex of its hashes in ascending order, 16 digits each, so equal texts have equal strings.

Defined results: a null text counts as empty and has the empty sketch; a text of one to four words has one shingle, all
its words; two empty sketches have likeness 1, an empty and another one 0. Rows may repeat an id: they follow one another
in an order fixed by their text. Rows without an id come last, in an order fixed by their text. Other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Words, column, partitions, scan, strings, windows

K, SHINGLE = 128, 5


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    if len(hashes) > 8 * k:  # most often enough; the rest is for texts that repeat themselves
        low = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(low) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def sketches(values: list[bytes], k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each UTF-8 text."""
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in values]))).astype(np.int64)
    w = Words(np.frombuffer(b"".join(values), np.uint8), bounds)
    h = w.hashes()
    wide, out = windows(h, shingle), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        out.append(bottom(wide[a : b - shingle + 1], k) if b - a >= shingle else windows(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate((a, b)))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard index of the two shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)
    return float(both.mean())


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    union = distinct_shingles(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_shingles(a, k))


def encode(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def document_sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fingerprint, distinct (estimated number of shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [s for part in _parts([x.encode() for x in strings(column(batch, "text"))]) for s in sketches(part, k)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(map(encode, out), pa.string()), pa.array([distinct_shingles(s, k) for s in out], pa.float64())], ["doc_id", "fingerprint", "distinct"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string, distinct double")


def _parts(values: list, most: int = 1 << 20) -> Iterator[list]:
    part, held = [], 0
    for x in values:
        part.append(x)
        held += len(x)
        if held > most:
            yield part
            part, held = [], 0
    if part:
        yield part


def merged_sketches(sketched: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """The sketch of each group of sketches: per key, the k smallest distinct hashes of all its members. Hashes are combined
    within each task before they move, and of a key only the k smallest of each task are gathered. Keys may be null and may
    have any name; null sketches count as empty."""
    named = sketched.select(*(F.col(f"`{c}`").alias(f"key{i}") for i, c in enumerate(keys)), "fingerprint")
    own = [f"key{i}" for i in range(len(keys))]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        schema: list[pa.Field] = []

        def flush() -> pa.RecordBatch:
            table = [(*key, x) for key, s in held.items() for x in (s ^ np.uint64(1 << 63)).view(np.int64).tolist() or [None]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in table], f.type) for i, f in enumerate(schema)] + [pa.array([r[-1] for r in table], pa.int64())], [f.name for f in schema] + ["h"])

        for batch in batches:
            schema = [batch.schema.field(n) for n in own]
            for *key, s in zip(*(column(batch, n).to_pylist() for n in own), column(batch, "fingerprint").to_pylist(), strict=True):
                new = decode(s or "")
                held[tuple(key)] = merge(held[tuple(key)], new, k) if tuple(key) in held else new
            if len(held) > 10_000:
                yield flush()
        if held:
            yield flush()

    kinds = dict(named.dtypes)
    flat = named.mapInArrow(local, ", ".join(f"{c} {kinds[c]}" for c in own) + ", h long").distinct()
    least = flat.withColumn("rank", F.row_number().over(Window.partitionBy(*own).orderBy(F.asc_nulls_last("h")))).where(F.col("rank") <= k)
    # As longs, hashes are shifted by half their range, so that they sort as unsigned ones do.
    digits = F.lpad(F.lower(F.hex(F.col("h").bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")
    merged = least.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("rank", digits.alias("x")))).alias("xs"))
    text = F.array_join(F.transform("xs", lambda r: r["x"]), "")
    return merged.select(*(F.col(o).alias(c) for o, c in zip(own, keys, strict=True)), text.alias("fingerprint"))


def _dealt(docs: DataFrame) -> DataFrame:
    """doc_id, text, part and extra: the rows in descending order of doc_id, dealt by ranges of it (parts), each with the
    first row of the next range at its end (extra 1; after the last range, that of the first).

    Texts move once; the first rows of ranges move once more. The driver sees the ranges' bounds and the ids and hashes of
    their first rows, as many as there are partitions. Rows without an id are dealt by ranges of a hash of their text."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    got = rows.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    bounds = np.array(sorted({int(x) for x in got}), np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series, blank: pd.Series, h: pd.Series) -> pd.Series:
        ranges = len(bounds) - np.searchsorted(bounds, ids.to_numpy(np.int64), side="right")
        last = len(bounds) + 1 + ((h.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)).astype(np.int64) * n // (1 << 32)
        return pd.Series(np.where(blank.to_numpy(bool), last, ranges)).astype("int32")

    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("part", part(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "h"))
    tops = keyed.groupBy("part").agg(F.max("doc_id").alias("top")).collect()
    order = sorted(r["part"] for r in tops)
    if not order:
        return keyed.select("doc_id", "text", "part", F.lit(0).alias("extra"))
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the first range's first row goes to the last range
    known = spark.createDataFrame([(r["part"], r["top"], before[r["part"]]) for r in tops], "part int, top long, to int")
    first = keyed.join(F.broadcast(known), "part").where(F.col("doc_id").eqNullSafe(F.col("top")))  # all rows, in a range without ids
    least = first.groupBy("part").agg(F.min("h").alias("low"))
    heads = first.join(F.broadcast(least), "part").where("h = low").groupBy("to").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"))
    both = keyed.select("doc_id", "text", "part", F.lit(0).alias("extra"), "h").unionByName(heads.select("doc_id", "text", F.col("to").alias("part"), F.lit(1).alias("extra"), F.lit(0).cast("long").alias("h")))
    return both.repartitionByRange(n, "part").sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), "h", "text").select("doc_id", "text", "part", "extra")


def _followed(batches: Iterator[pa.RecordBatch], made, most: int = 1 << 20) -> Iterator[list[tuple]]:
    """Lists of (doc_id, text, what was made of it, next text, what was made of that), of about most characters. made: from
    UTF-8 texts to one thing each."""
    held, out, size = None, [], 0
    for batch in (b.slice(k, 256) for b in batches for k in range(0, len(b), 256)):
        values = column(batch, "text").to_pylist()
        own = [x for p in _parts([v.encode() for v in values]) for x in made(p)]
        for i, t, x, p, extra in zip(column(batch, "doc_id").to_pylist(), values, own, column(batch, "part").to_pylist(), column(batch, "extra").to_pylist(), strict=True):
            if held is not None and held[3] == p:
                out.append((*held[:3], t, x))
                size += len(held[1])
                if size > most:
                    yield out
                    out, size = [], 0
            held = None if extra else (i, t, x, p)
    yield out


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the text of the next row in descending order of doc_id (after the last: of the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _followed(batches, lambda p: p):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in ((0, pa.int64()), (1, pa.string()), (3, pa.string()))], ["doc_id", "text", "next_text"])

    return _dealt(docs).mapInArrow(run, "doc_id long, text string, next_text string")


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the start of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def next_likeness(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text), with its text edited by the next one's: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Each text is sketched once, as its own and as the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _followed(batches, sketches):
            raw = [edited(t, f).encode() for _, t, _, f, _ in out]
            e = [x for p in _parts(raw) for x in sketches(p)]
            cols = [
                pa.array([r[0] for r in out], pa.int64()), pa.array([len(r[1]) for r in out], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array([encode(r[2]) for r in out], pa.string()),
                pa.array(map(encode, e), pa.string()), pa.array([resemblance(r[2], x) for r, x in zip(out, e, strict=True)], pa.float64()), pa.array([resemblance(r[2], r[4]) for r in out], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return _dealt(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_likeness(scan(spark, sf_dir, "documents"))


QUERIES = {"op5_fingerprints": op5_fingerprints}
ORACLES: dict[str, str] = {}
