"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is cut into four blocks. Two fingerprints that differ in at most two bits share at least two
whole blocks, so each fingerprint is keyed by its six pairs of blocks; fingerprints that share a key are joined and their
Hamming distance verified. Only distinct fingerprints take part, each under its smallest document, so copies never pair.
A key that more than ``most`` distinct fingerprints share is not joined with itself, which would pair them all: its
fingerprints are keyed by every fingerprint at distance one or less instead (the finest of blocks), and two of them share
such a key exactly if they differ in two bits or fewer. At most 65 fingerprints can share one of these keys, whatever the
group's size, so no link is lost and none is verified in vain.

Defined results: null texts count as empty; a text without words has fingerprint zero and links like any other; rows
whose id is null get a fingerprint and no component, and link nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import column, cut_lineage, mapped, meet, mix, scan, texts
from tessera.llm.components import components
from tessera.llm.minhash import candidates, near_copies

BITS, BLOCKS, DISTANCE, SEED, MOST = 64, 4, 2, 42, 64
#: For resemblance: words of a fingerprint, blocks drawn from its bits, bits that may differ.
WIDE, DRAWN, RADIUS = 4, 64, 72
_SEEDS = mix(np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _text_fingerprint(raw: bytes, shingle: int) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fp (64 bits as long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([_text_fingerprint(data[bounds[i] : bounds[i + 1]].tobytes(), shingle) for a, b, data, bounds in texts(column(batch, "text")) for i in range(b - a)], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def near_links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """Distinct fingerprints (fp, node) to links (u, v) between nodes at most DISTANCE bits apart: each such pair that
    shares a key of at most ``most`` fingerprints, and for larger keys links that join the same nodes."""
    width = BITS // BLOCKS
    masks = [sum(((1 << width) - 1) << (width * b) for b in pair) for pair in itertools.combinations(range(BLOCKS), BLOCKS - DISTANCE)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))
    keyed = prints.select("fp", "node", F.explode(keys).alias("k")).select("k.t", "k.key", "fp", "node")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut_lineage(meet(keyed, sizes.withColumn("size", F.col("n")), ["t", "key"], ["size"]).withColumnRenamed("size", "n"))
    small = members.where(F.col("n") <= most)
    a, b = small.select("t", "key", F.col("fp").alias("fa"), F.col("node").alias("u")), small.select("t", "key", F.col("fp").alias("fb"), F.col("node").alias("v"))
    pairs = a.join(b, ["t", "key"]).where((F.col("fa") < F.col("fb")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= DISTANCE)).select("u", "v")
    large = members.where(F.col("n") > most).select("fp", "node").distinct()
    ball = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    around = large.select("node", F.explode(ball).alias("near"))
    centre = around.groupBy("near").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = around.join(centre, "near").where("node != v").select(F.col("node").alias("u"), "v")
    return pairs.unionByName(stars)


def near_components(docs: DataFrame, shingle: int = 3, most: int = MOST) -> DataFrame:
    """Per row of docs: doc_id, fp, component_id (the smallest doc_id reachable over links)."""
    prints = cut_lineage(fingerprints(docs, shingle))
    distinct = prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"))
    found = components(near_links(distinct, most))
    labels = distinct.join(found, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id"))
    return meet(prints, labels, ["fp"], ["component_id"], "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def wide_prints(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SimHash fingerprints of WIDE words of sets of hashes, which begin at at; zero for empty sets."""
    size = np.diff(at)
    some = np.flatnonzero(size)
    out = np.zeros((len(size), WIDE), np.uint64)
    if not len(some):
        return out
    size = size[some]
    # A word holds eight counters of one byte, each for up to 255 hashes.
    steps = -(-size // 255)
    first = np.cumsum(steps) - steps
    cut = np.repeat(at[some], steps) + 255 * (np.arange(steps.sum()) - np.repeat(first, steps))
    for w in range(WIDE):
        x, votes = mix(h ^ _SEEDS[w]), np.empty((len(some), 8, 8), np.int64)
        for bit in range(8):
            counts = np.add.reduceat((x >> np.uint64(bit)) & np.uint64(0x0101010101010101), cut)
            votes[:, :, bit] = np.add.reduceat(counts.astype("<u8").view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
        out[some, w] = np.packbits((2 * votes > size[:, None, None]).reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def drawn_masks(width: int) -> np.ndarray:
    """DRAWN rows of WIDE words, in each row width bits drawn from all."""
    draw = np.random.RandomState(SEED)
    return np.array([np.packbits(np.isin(np.arange(BITS * WIDE), draw.permutation(BITS * WIDE)[:width]), bitorder="little").view("<u8") for _ in range(DRAWN)])


def block_keys(fp: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Fingerprints, a row of WIDE words each, to their keys by each mask: a hash of the bits that the mask leaves."""
    out = np.zeros((len(fp), len(masks)), np.uint64)
    for w in range(WIDE):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + (fp[:, w : w + 1] & masks[:, w]) + _SEEDS[w])
    return out


def blocks(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes (key, node, fp) to (key, node, bands), bands being the keys of their blocks. Workers make them: as expressions,
    the words of all masks take hundreds of MB of the driver's memory to plan."""
    masks = drawn_masks(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = column(batch, "fp").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WIDE)
            for at in range(0, len(batch), 1 << 13):
                part = batch.slice(at, 1 << 13)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, DRAWN * len(part) + 1, DRAWN, dtype=np.int32)), pa.array(block_keys(fp[at : at + (1 << 13)], masks).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([column(part, "key"), column(part, "node"), bands], ["key", "node", "bands"])

    return mapped(nodes.select("key", "node", "fp"), run, "key long, node long, bands array<long>")


def block_pairs(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, node, fp) to the pairs (ka, u, kb, v) that share a block and differ in at most RADIUS bits, and the members
    (t, band, key, node) of blocks that more than most share. A block is of as many bits as keep strangers apart: two more
    than the number of nodes has, at least 16, drawn from all."""
    nodes = cut_lineage(nodes)
    width = max(16, nodes.count().bit_length() + 1)
    pairs, large = candidates(blocks(nodes, width), most)
    a, b = (nodes.select(F.col("key").alias(k), F.col("fp").alias(x)) for k, x in (("ka", "fa"), ("kb", "fb")))
    bits = sum((F.bit_count(F.col("fa")[w].bitwiseXOR(F.col("fb")[w])) for w in range(WIDE)), F.lit(0))
    return pairs.join(a, "ka").join(b, "kb").where(bits <= RADIUS).select("ka", "u", "kb", "v"), large


def near_documents(docs: DataFrame, shingle: int = 5, least: float = 0.8, most: int = 16) -> DataFrame:
    """The operator at a resemblance of word shingles instead of a number of bits: doc_id, component_id.

    Two texts of five-word resemblance 0.8 differ in about 39 of 256 bits. Whole-block pigeonholes for so many would be of
    few bits each, which join everything with everything. So the blocks are DRAWN draws of bits of wide fingerprints; of
    fingerprints that share one those within RADIUS bits are verified by their shingles in full. What no draw leaves in one
    block is met by min-wise bands too (``minhash``), so that no pair depends on the draws alone."""
    return near_copies(docs, least, shingle, most, wide_prints, block_pairs)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(scan(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
ORACLES: dict[str, str] = {}
