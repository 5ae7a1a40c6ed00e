"""Column statistics, histograms, selectivity and cost estimates, and aggregates over shards."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import hash_slot, size_bytes
from tessera.plans.nodes import All, Always, AnyOf, Leaf, Not
from tessera.plans.pipeline import sort
from tessera.plans.predicates import compile_predicate

BUCKETS = 10


def aggregates(df: DataFrame, name: str) -> DataFrame:
    """sum, avg, min, max and count of a numeric column, nulls left out."""
    x = F.col(name).cast("double")
    return df.agg(F.sum(x).alias("sum"), F.avg(x).alias("avg"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("count"))


def table_stats(df: DataFrame) -> DataFrame:
    """count, bytes and bytes a row."""
    size = sum((F.lit(len(f.name)) + size_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).withColumn("avg_bytes", F.when(F.col("count") > 0, F.col("bytes") / F.col("count")).otherwise(0.0))


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row for each column: nulls, distinct values, and the least and greatest of numbers. Each column is read and counted
    by itself: its values are combined before they move, and no row is repeated for the others."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = columns or [n for n, k in kinds.items() if not isinstance(k, (T.ArrayType, T.MapType, T.StructType))]
    out = None
    for n in names:
        c = F.col("v")
        x = c.cast("double") if isinstance(kinds[n], T.NumericType) else F.lit(None).cast("double")
        values = df.select(F.col(f"`{n}`").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        one = values.agg(F.lit(n).alias("column"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(c.isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count(c).alias("ndv"), F.min(x).alias("min"), F.max(x).alias("max"))
        out = one if out is None else out.unionByName(one)
    return out


def histogram(df: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, low, high, count) of equal widths; the last bucket is closed, equal values make one."""
    x = df.select(F.col(name).cast("double").alias("x")).where("x IS NOT NULL")
    edges = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).withColumn("k", F.least(F.lit(buckets), F.col("n")).cast("int"))
    width = (F.col("hi") - F.col("lo")) / F.col("k")
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / width), F.col("k") - 1)).otherwise(0)
    put = x.crossJoin(F.broadcast(edges)).select(place.cast("int").alias("bucket"), "lo", width.alias("w"))  # edges is one row
    return put.groupBy("bucket").agg(F.min(F.col("lo") + F.col("bucket") * F.col("w")).alias("low"), F.min(F.col("lo") + (F.col("bucket") + 1) * F.col("w")).alias("high"), F.count(F.lit(1)).alias("count"))


@dataclass
class Stats:
    """What estimates know of a table: rows, and for each column nulls, distinct values, bounds and histogram counts."""

    rows: int
    columns: dict[str, dict[str, Any]]

    @classmethod
    def of(cls, df: DataFrame, columns: list[str] | None = None) -> Stats:
        found = {r["column"]: r.asDict() for r in column_stats(df, columns).collect()}
        for n, c in found.items():
            c["histogram"] = {r["bucket"]: r["count"] for r in histogram(df, n).collect()} if c["min"] is not None else {}
        rows = next((c["rows"] for c in found.values()), None)
        return cls(df.count() if rows is None else rows, found)


def _range(c: dict, lo: float, hi: float, present: float) -> float:
    """The share of rows within lo and hi, by the histogram with even spread inside a bucket."""
    counts, total = c["histogram"], sum(c["histogram"].values())
    if not total:
        return 0.3
    if c["max"] == c["min"]:
        return present if lo <= c["min"] <= hi else 0.0
    k = max(BUCKETS if total >= BUCKETS else total, 1)
    w = (c["max"] - c["min"]) / k
    part = sum(n * max(0.0, min(hi, c["min"] + (b + 1) * w) - max(lo, c["min"] + b * w)) / w for b, n in counts.items())
    return min(1.0, part / total) * present


def selectivity(p: Any, s: Stats) -> float:
    """Estimated share of rows that a predicate keeps. Parts of a conjunction count less and less (exponents 1, 0.75,
    0.5625, ... but at least 0.25, strongest first); those of a disjunction are taken as independent."""
    if p is None or isinstance(p, Always):
        return 1.0
    if isinstance(p, Not):
        return 1.0 - selectivity(p.part, s)
    if isinstance(p, All):
        out, power = 1.0, 1.0
        for x in sorted(selectivity(q, s) for q in p.parts):
            out *= x**power
            power = max(0.25, power * 0.75)
        return out
    if isinstance(p, AnyOf):
        return 1.0 - math.prod(1.0 - selectivity(q, s) for q in p.parts)
    c = s.columns.get(p.name)
    nulls = c["nulls"] / s.rows if c and s.rows else 0.0
    each = 1.0 / max(1, c["ndv"]) if c else 0.1
    number = isinstance(p.value, (int, float)) and not isinstance(p.value, bool) and c is not None and c["min"] is not None
    if p.op == "eq":
        return each
    if p.op == "ne":
        return 1.0 - each
    if p.op == "in":
        return min(1.0, each * len(p.value))
    if p.op == "isnull":
        return nulls if c else 0.05
    if p.op == "notnull":
        return 1.0 - nulls if c else 0.95
    if p.op in ("gt", "ge"):
        return _range(c, p.value, math.inf, 1 - nulls) if number else 0.33
    if p.op in ("lt", "le"):
        return _range(c, -math.inf, p.value, 1 - nulls) if number else 0.33
    if p.op == "between":
        return _range(c, p.value[0], p.value[1], 1 - nulls) if c and c["min"] is not None and isinstance(p.value[0], (int, float)) else 0.25
    return {"like": 0.2, "contains": 0.2, "startswith": 0.1, "endswith": 0.15}.get(p.op, 0.3)


@dataclass(frozen=True)
class Costs:
    """Fixed values of the cost model: bytes of a page, and costs of a page read in order or not, a row and an index entry."""

    page: int = 4096
    sequential: float = 1.0
    random: float = 2.0
    row: float = 0.01
    entry: float = 0.005

    def scan(self, rows: float, width: float) -> float:
        return math.ceil(rows * width / self.page) * self.sequential + rows * self.row

    def lookup(self, rows: float, share: float) -> float:
        hit = rows * share
        return math.log2(max(rows, 2)) * self.entry + hit * (self.entry + self.random / 8 + self.row)

    def flat(self, rows: float, dims: int) -> float:
        return rows * dims * self.row / 8

    def lists(self, rows: float, dims: int, probes: int = 8, lists: int = 32) -> float:
        return (lists + rows * probes / lists) * dims * self.row / 8


def plan_choice(p: Any, s: Stats, indexed: set[str], width: float = 200.0) -> dict[str, Any]:
    """seq_scan or index_scan for a predicate, with both costs; only one equality on an indexed field can use the index."""
    share = selectivity(p, s)
    costs = Costs()
    seq = costs.scan(s.rows, width)
    usable = isinstance(p, Leaf) and p.op == "eq" and p.name in indexed
    idx = costs.lookup(s.rows, share) if usable else math.inf
    return {"strategy": "index_scan" if idx < seq else "seq_scan", "selectivity": share, "estimated_rows": s.rows * share, "scan_cost": seq, "index_cost": idx if usable else None}


def join_strategy(left_bytes: float, right_bytes: float, colocated: bool, threshold: int = 10 << 20) -> str:
    return "colocated" if colocated else "broadcast" if min(left_bytes, right_bytes) <= threshold else "shuffle"


# Over shards: the same results by partial and final aggregates.


def by_slot(df: DataFrame, key: str, shards: int = 4) -> DataFrame:
    """df with each row's hash slot and shard."""
    slot = hash_slot(F.col(key).cast("string"))
    return df.withColumn("slot", slot).withColumn("shard", F.floor(slot * shards / 16384).cast("int"))


def partials(df: DataFrame, shard: str, name: str) -> DataFrame:
    x = F.col(name).cast("double")
    return df.groupBy(shard).agg(F.count(x).alias("count"), F.sum(x).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"))


def reduced(parts: DataFrame) -> DataFrame:
    """Final values of partial aggregates; 0.0 where there is nothing."""
    zero = F.lit(0.0)
    n, s = F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum("sum"), zero)
    return parts.agg(n.alias("count"), s.alias("sum"), F.coalesce(s / F.nullif(n, F.lit(0)), zero).alias("avg"), F.coalesce(F.min("min"), zero).alias("min"), F.coalesce(F.max("max"), zero).alias("max"))


# Queries over shards: each shard is asked, and what they give is put together.


@dataclass(frozen=True)
class Scatter:
    """A query for shards, built step by step: rows that match, in an order, from an offset on, or an aggregate of a field."""

    where: Any = None
    order: tuple[tuple[str, bool], ...] = ()
    skip: int = 0
    most: int | None = None
    op: str | None = None
    field: str | None = None

    def matching(self, where: Any) -> Scatter:
        return replace(self, where=where)

    def sorted(self, *order: tuple[str, bool]) -> Scatter:
        return replace(self, order=order)

    def page(self, skip: int = 0, most: int | None = None) -> Scatter:
        return replace(self, skip=skip, most=most)

    def aggregate(self, op: str, field: str) -> Scatter:
        return replace(self, op=op, field=field)

    def shard(self, df: DataFrame) -> DataFrame:
        """What one shard gives: its first rows that the page can need, or its partial aggregate."""
        df = df.where(compile_predicate(df, self.where))
        if self.op:
            return partials(df.withColumn("__shard", F.lit(0)), "__shard", self.field).drop("__shard")
        return df if self.most is None or not self.order else sort(df, list(self.order)).limit(self.skip + self.most)

    def gather(self, shards: list[DataFrame]) -> DataFrame:
        """The shards' rows in the global order, cut once; or the value (one column) of the aggregate."""
        parts = self.shard(shards[0])
        for df in shards[1:]:
            parts = parts.unionByName(self.shard(df))
        if self.op:
            return reduced(parts).select(F.col(self.op).alias("value"))
        if self.order:
            parts = sort(parts, list(self.order))
        if self.skip:
            parts = parts.offset(self.skip)
        return parts if self.most is None else parts.limit(self.most)


def routed(df: DataFrame, key: str, value: Any, shards: int = 4) -> DataFrame:
    """The rows of a key from the one shard that can have them; df has the column shard, by which it may be stored."""
    own = df.sparkSession.range(1).select(F.floor(hash_slot(F.lit(str(value))) * shards / 16384).cast("int")).first()[0]
    return df.where((F.col("shard") == own) & (F.col(key) == value))
