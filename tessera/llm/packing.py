"""Packing of token sequences by order-preserving dynamic programming.

Each task packs the documents it scans in their order, in blocks of about ``BLOCK_TOKENS`` tokens that end with a document.
Places where a sequence may end are the ends of documents, the ends of all sentences (at a price) and, where neither comes
for ``FORCED`` tokens, places in between (at a higher price). The cuts chosen minimise padding plus these prices over all
choices: the cheapest earlier cut within a sequence's length comes from a monotone queue, so a block takes time in
proportion to its places. A sequence is padded to its full length, except that one whose length is a power of two stays as
it is; the places that are a power of two back are tried as well. No data moves between tasks.

Defined results: a null text counts as empty and is its end token; rows that repeat an id are packed each by itself; a
sequence belongs to one block, so its id names the task's part of the input and the sequence's place in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import VOCABULARY, Encoder, automaton, groups, vocabulary_path
from tessera.llm.common import FORGET, column, mapped, scan, strings

LENGTH, END, BLOCK_TOKENS, FORCED = 2048, 1, 1 << 19, 256
#: Prices, in tokens of padding: of a cut at the end of a sentence, and within one.
SENTENCE, WITHIN = 8, 64


@lru_cache(2)
def _encoder(path: str) -> tuple[Encoder, np.ndarray]:
    """The automaton's encoder (its ids are those of the tokenizers library), and which ids end a sentence."""
    _, encoder, labels = automaton(path)
    return encoder, np.array([x in (".</w>", "!</w>", "?</w>", "...</w>", "!!</w>") for x in labels])


FORGET.append(_encoder.cache_clear)


def cuts(stop: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> list[int]:
    """Where the sequences of one block end. stop: whether a token ends a sentence; ends: where documents end."""
    total = int(ends[-1])
    sentence = np.flatnonzero(stop) + 1
    places = np.union1d(np.union1d(sentence, ends), [0])
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > FORCED)
    if len(wide):
        more = np.concatenate([np.arange(places[i] + FORCED, places[i + 1], FORCED) for i in wide])
        places = np.union1d(places, more)
    price = np.full(len(places), WITHIN, np.int64)
    price[np.searchsorted(places, sentence)] = SENTENCE
    price[np.searchsorted(places, ends)] = 0
    exact: list = [()] * len(places)  # places that lie a power of two back
    for k in range(length.bit_length()):
        want = places - (1 << k)
        at = np.searchsorted(places, want)
        hit = np.flatnonzero(places[at] == want) if 1 << k <= length else ()
        for i, j in zip(hit.tolist() if len(hit) else (), at[hit].tolist() if len(hit) else (), strict=True):
            exact[i] += (j,)
    where, cost = places.tolist(), price.tolist()
    best, back = [0], [0]
    # The queue: places, with best + where as keys in ascending order.
    at, keys, names, head = [0], [0], [0], 0
    for i in range(1, len(where)):
        here = where[i]
        floor = here - length
        while at[head] < floor:
            head += 1
        j = names[head]
        low = keys[head] - floor
        for e in exact[i]:
            if best[e] < low:
                low, j = best[e], e
        low += cost[i]
        best.append(low)
        back.append(j)
        key = low + here
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            at.pop()
            names.pop()
        keys.append(key)
        at.append(here)
        names.append(i)
    out, i = [], len(where) - 1
    assert where[i] == total
    while i:
        out.append(where[i])
        i = back[i]
    return out[::-1]


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, ids: bool = True) -> DataFrame:
    """Pieces of the documents (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ids the tokens themselves (array<int>)."""

    def block(part: int, number: int, names: list, raw: list[bytes], stops: np.ndarray) -> tuple[pa.RecordBatch, int]:
        sizes = np.array([len(x) // 4 for x in raw], np.int64)
        ends = np.cumsum(sizes)
        joined = b"".join(raw)
        tokens = np.frombuffer(joined, "<u4")
        at = np.array(cuts(stops[tokens], ends, length), np.int64)
        # A piece ends where a sequence or a document does.
        stop = np.union1d(at, ends)
        start = np.concatenate(([0], stop[:-1]))
        doc, seq = np.searchsorted(ends, start, side="right"), np.searchsorted(at, start, side="right")
        first, opened = (ends - sizes)[doc], np.concatenate(([0], at[:-1]))[seq]
        view = memoryview(joined)
        arrays = [
            pa.array([names[i] for i in doc.tolist()], pa.int64()), pa.array(start - first), pa.array(stop - start), pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], pa.int64()),
            pa.array(sizes[doc]), pa.array((part << 36) + number + seq), pa.array(start - opened),
        ]
        if ids:
            arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate((start, stop[-1:])).astype(np.int32)), pa.array(tokens.view("<i4"))))
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)]), number + len(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stops = _encoder(vocabulary_path(vocabulary))
        part, number, end = TaskContext.get().partitionId(), 0, END.to_bytes(4, "little")
        names: list = []
        raw: list[bytes] = []
        held = 0
        for batch in batches:
            own, at = column(batch, "doc_id").to_pylist(), 0
            for group in groups(strings(column(batch, "text")), 1 << 20):
                for i, x in enumerate(encoder.ids(group), at):
                    names.append(own[i])
                    raw.append(x + end)
                    held += len(raw[-1]) // 4
                    if held >= BLOCK_TOKENS:
                        out, number = block(part, number, names, raw, stops)
                        yield out
                        names, raw, held = [], [], 0
                at += len(group)
        if raw:
            yield block(part, number, names, raw, stops)[0]

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema, "bpe")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(scan(spark, sf_dir, "documents"), ids=False)


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
