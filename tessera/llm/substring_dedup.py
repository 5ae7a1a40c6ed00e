"""Substring deduplication by difference-cover anchors.

Two documents that share ``length`` consecutive words share, at some offset below ``period``, a word position that is in
the difference cover (modulo the period) in both of them. So only windows of ``length - period + 1`` words at cover
positions are hashed; anchors that occur in one document alone end there. The others extend: every full window around
them gets a BLAKE2 digest (128 bits) of its words themselves, and the smallest document of each full window decides. An anchor's smallest and
greatest documents tell which side its windows are on: those of documents below the greatest are offered, those of
documents above the smallest are asked for. Nothing pairs documents:
each step is a grouped minimum or a join with one row per hash, so a passage that a third of all documents share costs a
row for each of its occurrences. Anchors that very many documents share are told beforehand, by counts within batches (at
most four for each shuffle partition): these anchors are taken as shared without a join, so that no task gets them all.

Defined results: null texts count as empty; documents of fewer than ``length`` words lose nothing; rows that repeat one
id count as one document (they never remove one another, each row gets its own result); rows whose id is null neither
remove nor lose words. Other columns of the input are ignored unless named in ``carry``.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import Words, column, mapped, meet, normalised, partitions, scan, texts, windows

PERIOD = 31
#: A perfect difference set modulo 31 (fixed values): every offset is a difference of two of its members.
COVER = (1, 5, 11, 24, 25, 27)
#: An anchor that fewer documents of a batch share is not counted towards the hot ones.
OFTEN = 8
assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def _flat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _cover(length: int, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of the windows at cover positions, their documents and positions, for some texts of a batch at a time."""
    width = length - PERIOD + 1
    lut = np.zeros(PERIOD, bool)
    lut[list(COVER)] = True
    ids = column(batch, "doc_id").to_numpy(zero_copy_only=False)
    for a, b, data, bounds in texts(column(batch, "text")):
        w = Words(data, bounds)
        n = np.diff(w.first)
        if not len(n) or n.max() < length:
            continue
        at = np.arange(w.first[0], w.first[-1]) - np.repeat(w.first[:-1], n)
        room = np.repeat(n, n) - at
        keep = np.flatnonzero(lut[at % PERIOD] & (room >= width) & (np.repeat(n, n) >= length))
        h = windows(w.hashes(), width) >> np.uint64(16)  # 48 bits to move: what meets by chance is told apart below
        yield h[keep].view(np.int64), ids[np.repeat(np.arange(a, b), n)[keep]], at[keep].astype(np.int32)


def _heavy(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(_cover(length, batch))
            h, owner = _flat([p[0] for p in parts], np.int64), _flat([p[1] for p in parts], np.int64)
            by = np.lexsort((owner, h))
            h, owner = h[by], owner[by]
            h = h[np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))] if len(h) else h
            kinds, times = np.unique(h, return_counts=True)
            some = times >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(kinds[some]), pa.array(times[some].astype(np.int64))], ["h", "n"])

    return run


def _hot(rows: DataFrame, length: int) -> np.ndarray:
    """Sorted hashes of anchors that very many documents share; which ones are named here changes no result."""
    counted = mapped(rows, _heavy(length), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > common.HOT)
    return np.array(sorted(r["h"] for r in counted.orderBy(F.desc("n"), "h").limit(4 * partitions(rows.sparkSession)).collect()), np.int64)


def _anchors(length: int, hot: np.ndarray, wanted: bool):
    """Anchors (h, doc_id, pos): the hot ones if wanted, else the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, owner, at in _cover(length, batch):
                keep = np.flatnonzero(np.isin(h, hot) == wanted)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(owner[keep]), pa.array(at[keep])], ["h", "doc_id", "pos"])

    return run


def _full_windows(length: int, side: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = column(batch, "doc_id").to_numpy(zero_copy_only=False), column(batch, "th").to_numpy(zero_copy_only=False)
            where = column(batch, side)
            for a, b, data, bounds in texts(column(batch, "text")):
                digests, rows, starts = [], [], []
                for i in range(a, b):
                    words = data[bounds[i - a] : bounds[i - a + 1]].tobytes().split()
                    n = len(words)
                    if n < length:
                        continue
                    p = where[i].values.to_numpy()
                    hit = np.zeros(n - length + 2, np.int32)  # runs of windows that hold an anchor
                    np.add.at(hit, np.clip(p - PERIOD + 1, 0, n - length + 1), 1)
                    np.add.at(hit, np.clip(p + 1, 0, n - length + 1), -1)
                    q = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
                    begins = np.concatenate(([0], ends[:-1] + 1))
                    joined = memoryview(b" ".join(words))
                    digests += [hashlib.blake2b(joined[x:y], digest_size=16).digest() for x, y in zip(begins[q].tolist(), ends[q + length - 1].tolist(), strict=True)]
                    starts.append(q.astype(np.int32))
                    rows.append(np.full(len(q), i))
                r, both = _flat(rows, np.int64), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(ids[r]), pa.array(marks[r]), pa.array(_flat(starts, np.int32))], ["hi", "lo", "doc_id", "th", "pos"])

    return run


def _cut(length: int, texts_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, marks, whole = column(batch, "at"), column(batch, "th").to_numpy(zero_copy_only=False), column(batch, "whole").to_pylist()
            column_text = column(batch, "text")
            rest = [(f.name, k) for k, f in enumerate(batch.schema) if f.name not in (() if texts_too else ("text",)) + ("at", "th", "whole")]
            for a, b, data, bounds in texts(column_text):
                n_words, n_removed, kept, spans = [], [], [], []
                for i in range(a, b):
                    words = data[bounds[i - a] : bounds[i - a + 1]].tobytes().split()
                    n = len(words)
                    cover = np.zeros(n + 1, np.int32)
                    if where[i].is_valid:
                        found = where[i].values
                        p = found.field("pos").to_numpy()[found.field("th").to_numpy() == marks[i]]
                        np.add.at(cover, p, 1)
                        np.add.at(cover, p + length, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    if whole[i] and n >= length:
                        gone[:] = True
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2)
                    kept.append(b" ".join(itertools.compress(words, ~gone) if len(edges) else words))
                    n_words.append(n)
                    n_removed.append(int(gone.sum()))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in edges])
                arrays = [batch.column(k).slice(a, b - a) for _, k in rest]
                arrays += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [name for name, _ in rest] + ["n_words", "n_removed", "spans", "kept_text"])

    return run


def _copies(rows: DataFrame) -> DataFrame:
    """(doc_id, ths): rows all of whose words, in order, are those of a row with a smaller id."""
    digest = F.unhex(F.sha2(F.trim(normalised(F.col("text"))), 256))
    named = rows.select("doc_id", F.xxhash64("text").alias("th"), digest.alias("digest"))
    first = named.groupBy("digest").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b")
    return meet(named, first, ["digest"], ["a"]).where("doc_id > a").groupBy("doc_id").agg(F.collect_set("th").alias("ths"))


def repeated_spans(docs: DataFrame, length: int = 50, carry: tuple[str, ...] = (), texts_too: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, with texts_too the text, the columns of carry, n_words, n_removed, spans (word
    ranges that repeat a passage of a document with a smaller id), kept_text (the other words, joined by one space)."""
    if length < PERIOD + 1:
        raise ValueError(f"length must exceed {PERIOD}")
    spark = docs.sparkSession
    n = partitions(spark)
    kept_as = {c: f"carry_{k}" for k, c in enumerate(carry)}
    others = list(kept_as.values())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *(F.col(c).alias(x) for c, x in kept_as.items()))
    named = rows.where("doc_id IS NOT NULL")
    # The whole texts move once: all three steps read this exchange, and so ask for the same columns.
    moved = named.withColumn("th", F.xxhash64("text")).repartition(n, "doc_id")
    marked = moved.join(_copies(named), "doc_id", "left").withColumn("whole", F.coalesce(F.array_contains("ths", F.col("th")), F.lit(False))).drop("ths")
    hot, fresh = _hot(named.select("doc_id", "text"), length), marked.where("NOT whole").select("doc_id", "text", *others)
    anchors = mapped(fresh, _anchors(length, hot, False), "h long, doc_id long, pos int")
    # Without the hot ones, no anchor has many rows: each partition can look at those of one hash together.
    same = Window.partitionBy("h")
    shared = anchors.select("doc_id", "pos", F.min("doc_id").over(same).alias("a"), F.max("doc_id").over(same).alias("b")).where("a < b")
    sides = shared.select("doc_id", F.when(F.col("doc_id") < F.col("b"), F.col("pos")).alias("offer"), F.when(F.col("doc_id") > F.col("a"), F.col("pos")).alias("ask"))
    if len(hot):
        sides = sides.unionByName(mapped(fresh, _anchors(length, hot, True), "h long, doc_id long, pos int").select("doc_id", F.col("pos").alias("offer"), F.col("pos").alias("ask")))
    met = sides.groupBy("doc_id").agg(F.collect_list("offer").alias("offer"), F.collect_list("ask").alias("ask"))
    placed = marked.where("NOT whole").join(met, "doc_id")
    schema = "hi long, lo long, doc_id long, th long, pos int"
    ask = mapped(placed.where(F.size("ask") > 0).select("doc_id", "th", "text", "ask", *others), _full_windows(length, "ask"), schema)
    offer = mapped(placed.where(F.size("offer") > 0).select("doc_id", "th", "text", "offer", *others), _full_windows(length, "offer"), schema)
    # The key that is always 0 has both sides exchanged for the join itself: Spark then splits partitions with hot passages.
    earliest = offer.groupBy("hi", "lo").agg(F.min("doc_id").alias("a")).withColumn("same", F.pmod("hi", F.lit(1)))
    cuts = ask.withColumn("same", F.pmod("hi", F.lit(1))).join(earliest, ["hi", "lo", "same"]).where("doc_id > a").groupBy("doc_id").agg(F.collect_list(F.struct("th", "pos")).alias("at"))
    inputs = ["doc_id", "text", "th", "whole", "at", *others]
    joined = marked.join(cuts, "doc_id", "left").select(*inputs)
    unnamed = rows.where("doc_id IS NULL").withColumns({"th": F.lit(0).cast("long"), "whole": F.lit(False), "at": F.lit(None).cast(cuts.schema["at"].dataType)}).select(*inputs)
    kinds = dict(docs.dtypes)
    schema = "doc_id long, " + "text string, " * texts_too + "".join(f"{x} {kinds[c]}, " for c, x in kept_as.items()) + "n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"
    out = mapped(joined, _cut(length, texts_too), schema).unionByName(mapped(unnamed, _cut(length, texts_too), schema))
    return out.select("doc_id", *["text"] * texts_too, *(F.col(x).alias(c) for c, x in kept_as.items()), "n_words", "n_removed", "spans", "kept_text")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(scan(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLES: dict[str, str] = {}
