"""Changes to collections as DataFrames: inserts, updates, deletes, merges, replay and mergeable state."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.nodes import Arithmetic
from tessera.plans.predicates import compile_predicate, resolve


class Conflict(ValueError):
    """A duplicate id or a value that a unique index has already."""


def insert(df: DataFrame, more: DataFrame, key: str = "_id", unique: tuple = ()) -> DataFrame:
    """df and more; ids are given where missing. Duplicate ids and unique values are errors."""
    if key not in more.columns:
        more = more.withColumn(key, F.expr("uuid()"))
    for names in [(key,), *((n,) if isinstance(n, str) else tuple(n) for n in unique)]:
        if not {*names} <= {*df.columns} & {*more.columns}:
            continue
        there = more.dropna(subset=list(names))
        known = df.select(*names).join(there.select(*names), list(names), "left_semi")
        twice = there.groupBy(*names).count().where("count > 1").select(*names)
        if not known.unionByName(twice).isEmpty():
            raise Conflict(f"duplicate {', '.join(names)}")
    return df.unionByName(more, allowMissingColumns=True)


def _set(df: DataFrame, name: str, value: Any) -> Column:
    if isinstance(value, Arithmetic):
        c, kind = resolve(df, value.name)
        base = F.coalesce(c, F.lit(0)) if kind is not None else F.lit(0)
        out = base + F.lit(value.amount)
        return out.cast(kind) if isinstance(kind, T.NumericType) and float(value.amount).is_integer() else out
    return F.lit(value)


def update(df: DataFrame, sets: dict[str, Any], where: Any = None) -> DataFrame:
    """Sets fields of the rows that match; all right sides see the row as it was."""
    hit = compile_predicate(df, where)
    new = {}
    for name, value in sets.items():
        to = _set(df, name, value)
        if name in df.columns:
            kind = df.schema[name].dataType
            new[name] = F.when(hit, to.cast(kind) if value is None or not isinstance(value, Arithmetic) else to).otherwise(df[f"`{name}`"])
        else:
            new[name] = F.when(hit, to)
    return df.withColumns(new)


def delete(df: DataFrame, where: Any = None) -> DataFrame:
    return df.where(~compile_predicate(df, where))


def find_and_modify(df: DataFrame, where: Any, sets: dict[str, Any] | None = None, key: str = "_id") -> tuple[DataFrame, DataFrame]:
    """(the first match by key as it was, df with it changed or, without sets, removed)."""
    first = df.where(compile_predicate(df, where)).orderBy(key).limit(1)
    rest = df.join(first.select(key), key, "left_anti").select(*df.columns)
    return first, rest if sets is None else rest.unionByName(update(first, sets), allowMissingColumns=True)


def replaced(df: DataFrame, key: str, value: Any, row: DataFrame) -> DataFrame:
    """df with the row of a key (if there is one) replaced by another; fields that this lacks are missing."""
    there = df.where(F.col(key) == value)
    new = row.join(there.select(F.lit(1).alias("__there")).limit(1), F.lit(True), "left_semi")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    new = new.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in new.columns))
    return df.where(~F.coalesce(F.col(key) == value, F.lit(False))).unionByName(new, allowMissingColumns=True)


def add_column(df: DataFrame, name: str, default: Any = None) -> DataFrame:
    value = F.lit(default) if default is not None else F.lit(None).cast("string")
    return df.withColumn(name, value if name not in df.columns else F.coalesce(df[name], value))


def unique_violations(df: DataFrame, fields: list[str]) -> DataFrame:
    present = df.where(F.concat(*(F.col(f).cast("string") for f in fields)).isNotNull())
    return present.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def latest(log: DataFrame, key: str | list[str], order: str, deleted: Column | None = None) -> DataFrame:
    """Of each key the row with the highest order, unless it is a deletion. Combined in each task before rows move."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in log.columns if c not in keys]
    mark = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest, mark.alias("__gone")), F.col(order)).alias("r"))
    return newest.where(~F.col("r.__gone")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def replay(base: DataFrame, log: DataFrame, until: Any = None, lsn: int | None = None) -> DataFrame:
    """base (collection, doc_id, payload) after the log (sequence, timestamp, op_type 1 put or 2 delete, collection, doc_id,
    payload) up to a time or sequence number; the first record past a time ends the replay."""
    if until is not None:
        first_past = log.where(F.col("timestamp") > F.lit(until)).agg(F.min("sequence")).first()[0]
        if first_past is not None:
            log = log.where(F.col("sequence") < first_past)
    if lsn is not None:
        log = log.where(F.col("sequence") <= lsn)
    start = base.select(F.lit(-1).cast("long").alias("sequence"), F.lit(1).alias("op_type"), "collection", "doc_id", "payload")
    both = start.unionByName(log.select(F.col("sequence").cast("long").alias("sequence"), F.col("op_type").cast("int").alias("op_type"), "collection", "doc_id", "payload"))
    return latest(both, ["collection", "doc_id"], "sequence", F.col("op_type") == 2).select("collection", "doc_id", "payload")


def apply_increment(base: DataFrame, changed: DataFrame, deleted: DataFrame, keys: tuple[str, ...] = ("collection", "doc_id"), base_id: str | None = None, made_for: str | None = None) -> DataFrame:
    """Deleted ids go first, then changed rows replace or join the others. An increment made for another base is an error."""
    if base_id != made_for:
        raise Conflict(f"the increment is for {made_for}, not {base_id}")
    left = base.join(deleted.select(*keys), list(keys), "left_anti").join(changed.select(*keys), list(keys), "left_anti")
    return left.select(*base.columns).unionByName(changed.select(*base.columns))


def conflicts(writes: DataFrame, reads: DataFrame, committed: DataFrame) -> DataFrame:
    """Transactions that may not commit: writes and reads (txn, key, snapshot_ts) of keys committed (key, commit_ts) later."""
    late = committed.groupBy("key").agg(F.max("commit_ts").alias("commit_ts"))
    both = writes.select("txn", "key", "snapshot_ts", F.lit("write-write").alias("kind")).unionByName(reads.select("txn", "key", "snapshot_ts", F.lit("read-write").alias("kind")))
    return both.join(late, "key").where("commit_ts > snapshot_ts").select("txn", "key", "kind")


# State that merges without coordination.


def lww(updates: DataFrame, keys: list[str], value: str = "value", ts: str = "ts", region: str = "region") -> DataFrame:
    """Last writer wins by (ts, region); with a field among the keys this merges whole documents."""
    return updates.groupBy(*keys).agg(F.max_by(value, F.struct(ts, region)).alias(value))


def or_set(ops: DataFrame, keys: list[str], op: str = "op", ts: str = "ts") -> DataFrame:
    """Elements whose last addition is later than their last removal."""
    added, removed = F.max(F.when(F.col(op) == "add", F.col(ts))), F.max(F.when(F.col(op) == "remove", F.col(ts)))
    return ops.groupBy(*keys).agg(added.alias("a"), removed.alias("r")).where("a IS NOT NULL AND (r IS NULL OR a > r)").select(*keys)


def pn_counter(states: DataFrame, keys: list[str], region: str = "region", up: str = "p", down: str = "n") -> DataFrame:
    """Each region's highest counts, summed."""
    per = states.groupBy(*keys, region).agg(F.max(up).alias("p"), F.max(down).alias("n"))
    return per.groupBy(*keys).agg((F.sum("p") - F.sum("n")).alias("value"))


def merge_versions(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def compare_versions(a: Column, b: Column) -> Column:
    """equal, before, after or concurrent."""
    pairs = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    more, less = F.exists(pairs, lambda d: d > 0), F.exists(pairs, lambda d: d < 0)
    return F.when(more & less, "concurrent").when(more, "after").when(less, "before").otherwise("equal")


# Deltas between regions: who changed which field when, to be applied elsewhere in any order.


def deltas(before: DataFrame, after: DataFrame, key: str, region: str, ts: Column) -> DataFrame:
    """(key, field, value, ts, region) of the fields that differ; of rows that are gone, a row with the field null."""
    names = [c for c in after.columns if c != key]
    old = before.select(key, F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in names)).alias("b"))
    new = after.select(key, F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in names)).alias("a"))
    both = old.join(new, key, "full")
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").alias("value"), (F.col("a").isNotNull() & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias("changed")) for c in names))
    gone = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), F.col("a").isNull().alias("changed")))
    rows = both.select(key, F.explode(F.concat(pairs, gone)).alias("d")).where("d.changed")
    return rows.select(F.col(key).alias("key"), "d.field", "d.value", ts.alias("ts"), F.lit(region).alias("region"))


def apply_deltas(state: DataFrame, more: DataFrame) -> DataFrame:
    """Field states (key, field, value, ts, region) with deltas merged in: the last writer of each field wins, and a removal
    takes all fields written before it."""
    merged = lww_state(state.unionByName(more), ["key", "field"])
    gone = merged.where("field IS NULL").select("key", F.struct("ts", "region").alias("gone"))
    kept = merged.where("field IS NOT NULL").join(gone, "key", "left").where(F.col("gone").isNull() | (F.struct("ts", "region") > F.col("gone"))).drop("gone")
    return kept.unionByName(merged.where("field IS NULL"))


def lww_state(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last write of each key, by (ts, region), with both."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("value", "ts", "region"), F.struct("ts", "region")).alias("w"))
    return last.select(*keys, "w.*")


def drained(log: DataFrame, region: str, since: Column) -> DataFrame:
    """What a region has to send: its own deltas after a time."""
    return log.where((F.col("region") == region) & (F.col("ts") > since))
