"""Caches as tables: results by text, and answers by likeness of their question's vector."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Queries that meet the entries at a time.
BLOCK = 4096
#: Entries that a block of queries meets at a time in a task: with BLOCK it bounds a task's matrices to 8 MB each.
TILE = 256


def nearest_answers(cache: DataFrame, queries: DataFrame, threshold: float = 0.90, now: Column | None = None, others: bool = False) -> DataFrame:
    """For each of queries (query_id, vector) the entry of cache (entry_id, vector, expire_at) of greatest cosine, if that
    reaches the threshold; of equals the smallest id. queries is a stated set: it meets all entries in blocks of about
    BLOCK queries, each a matrix that goes to all tasks, and each task passes on its best entry for each query. others: a
    query's own id is no answer to it. Vectors that are missing or of another length than the query's are no answers."""
    live = cache if now is None else cache.where(F.col("expire_at").isNull() | (F.col("expire_at") > now))
    asked = queries.where("vector IS NOT NULL").withColumn("dims", F.size("vector"))
    sizes = {r["dims"]: r["n"] for r in asked.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}
    kind, entry = (dict(x.dtypes)[c] for x, c in ((queries, "query_id"), (cache, "entry_id")))
    out = None
    for dims, n in sorted(sizes.items()):
        blocks = -(-n // BLOCK)
        for block in range(blocks):
            part = asked.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block))
            found = _best(live.where(F.size("vector") == dims), part, others, kind, entry)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = live.select(F.lit(None).cast(kind).alias("query_id"), "entry_id", F.lit(0.0).alias("similarity")).where(F.lit(False))
    best = out.groupBy("query_id").agg(F.max(F.struct("similarity", -F.col("entry_id").cast("long"))).alias("b"), F.max_by("entry_id", F.struct("similarity", -F.col("entry_id").cast("long"))).alias("entry_id"))
    return best.where(F.col("b.similarity") >= threshold).select("query_id", "entry_id", F.col("b.similarity").alias("similarity"))


def _meet(batches: Iterator[pd.DataFrame], ids: np.ndarray, q: np.ndarray, others: bool) -> pd.DataFrame:
    """The best of all entries for each of a block's queries."""
    high, who = np.full(len(ids), -2.0), np.zeros(len(ids), object)
    for batch in (b.iloc[k : k + TILE] for b in batches for k in range(0, len(b), TILE)):
        v = np.stack(batch["vector"].to_list()).astype(np.float64)
        v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
        names = batch["entry_id"].to_numpy()
        order = np.argsort(names, kind="stable")
        names, s = names[order], q @ v[order].T
        np.clip(s, -1, 1, out=s)
        if others:
            s[ids[:, None] == names[None, :]] = -2
        at = s.argmax(axis=1)
        top = s[np.arange(len(ids)), at]
        better = (top > high) | ((top == high) & (top > -2) & (names[at] < who))
        high[better], who[better] = top[better], names[at[better]]
    some = high > -2
    return pd.DataFrame({"query_id": ids[some], "entry_id": list(who[some]), "similarity": high[some]})


def _best(live: DataFrame, part: DataFrame, others: bool, kind: str, entry: str) -> DataFrame:
    rows = part.select("query_id", "vector").collect()  # a block of the stated set
    ids = np.array([r["query_id"] for r in rows])
    q = np.array([r["vector"] for r in rows], np.float64)
    q /= np.maximum(np.sqrt((q * q).sum(axis=1, keepdims=True)), 1e-12)
    sent = live.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _meet(batches, *sent.value, others)

    return live.select("entry_id", "vector").mapInPandas(run, f"query_id {kind}, entry_id {entry}, similarity double")


class SemanticCache:
    """Answers by their questions' vectors: (entry_id, vector, payload, put_at, expire_at), the newest ``most`` of them."""

    def __init__(self, spark: SparkSession, seconds: int = 300, most: int = 10_000, threshold: float = 0.90):
        self.seconds, self.most, self.threshold = seconds, most, threshold
        self.table = spark.createDataFrame([], "entry_id long, vector array<float>, payload string, put_at timestamp, expire_at timestamp")

    def put(self, rows: DataFrame, now: Column) -> SemanticCache:
        """rows: entry_id, vector, payload. Beyond the cap the oldest go."""
        new = rows.select("entry_id", "vector", "payload", now.cast("timestamp").alias("put_at"), (now.cast("timestamp") + F.make_dt_interval(secs=F.lit(self.seconds))).alias("expire_at"))
        both = self.table.join(new.select("entry_id"), "entry_id", "left_anti").select(*self.table.columns).unionByName(new)
        self.table = both.orderBy(F.desc("put_at"), F.desc("entry_id")).limit(self.most)
        return self

    def sweep(self, now: Column) -> SemanticCache:
        self.table = self.table.where(F.col("expire_at") > now)
        return self

    def get(self, queries: DataFrame, now: Column) -> DataFrame:
        """query_id, entry_id, similarity, payload of the best live answers."""
        found = nearest_answers(self.table, queries, self.threshold, now)
        return found.join(self.table.select("entry_id", "payload"), "entry_id").select("query_id", "entry_id", "similarity", "payload")

    def __len__(self) -> int:
        return self.table.count()


class ResultCache:
    """Cached DataFrames by query text, for a time, first in first out, dropped when a collection they read changes."""

    def __init__(self, seconds: float = 60, most: int = 100):
        self.seconds, self.most = seconds, most
        self.held: OrderedDict[str, tuple[float, set[str], DataFrame]] = OrderedDict()

    def get(self, text: str) -> DataFrame | None:
        found = self.held.get(text)
        if found and found[0] < time.time():
            self.drop(text)
            return None
        return found[2] if found else None

    def put(self, text: str, df: DataFrame, collections: set[str]) -> DataFrame:
        while len(self.held) >= self.most:
            self.drop(next(iter(self.held)))
        self.held[text] = (time.time() + self.seconds, collections, df.cache())
        return df

    def drop(self, text: str) -> None:
        if text in self.held:
            self.held.pop(text)[2].unpersist()

    def invalidate(self, collection: str) -> None:
        for t in [t for t, (_, c, _) in self.held.items() if collection in c]:
            self.drop(t)
