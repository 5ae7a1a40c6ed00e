"""Aggregation pipelines: a list of stages folded over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.lexer import ParseError
from tessera.plans.predicates import compile_predicate, json_filter, resolve


def _field(df: DataFrame, ref: Any) -> Column:
    if not (isinstance(ref, str) and ref.startswith("$")):
        raise ParseError(f"expected a field such as $name, not {ref!r}")
    return resolve(df, ref[1:])[0]


def _number(df: DataFrame, ref: Any) -> Column:
    """The field as a double where it is a number, else null."""
    column, kind = resolve(df, ref[1:]) if isinstance(ref, str) and ref.startswith("$") else (F.lit(None), None)
    return column.cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")


def average(x: Column) -> Column:
    """Rounded to two places by way of whole hundredths; 0.0 of nothing."""
    return F.coalesce(F.round(F.avg(x) * 100) / 100, F.lit(0.0))


def accumulator(df: DataFrame, op: str, ref: Any, keys: list[tuple[str, int]]) -> Column:
    """keys: what the stages before sorted by; $push, $first and $last follow it."""
    if op == "$count" or op == "$sum" and ref == 1:
        return F.count(F.lit(1))
    if op == "$sum":
        return F.coalesce(F.sum(_number(df, ref)), F.lit(0.0))
    if op == "$avg":
        return average(_number(df, ref))
    if op == "$min":
        return F.min(_number(df, ref))
    if op == "$max":
        return F.max(_number(df, ref))
    if op not in ("$first", "$last", "$push"):
        raise ParseError(f"unknown accumulator {op}")
    order, ways = _key(df, keys)
    if len(set(ways)) == 1:  # one direction: the least or greatest key decides
        up = ways[0] > 0
        if op != "$push":
            return (F.min_by if up == (op == "$first") else F.max_by)(_field(df, ref), order)
        pairs = F.array_sort(F.collect_list(F.struct(order.alias("k"), _field(df, ref).alias("v"))))
        return F.transform(pairs if up else F.reverse(pairs), lambda x: x["v"])
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("k"), _field(df, ref).alias("v"))), lambda x, y: _compared(x["k"], y["k"], ways))
    values = F.transform(pairs, lambda x: x["v"])
    return values if op == "$push" else F.get(values, F.lit(0)) if op == "$first" else F.element_at(values, -1)


def _compared(x: Column, y: Column, ways: list[int]) -> Column:
    """-1, 0 or 1 for keys of several parts, each in its direction; missing parts are lowest."""
    out = F.lit(0)
    for i in reversed(range(len(ways))):
        a, b = x[f"k{i}"], y[f"k{i}"]
        less = F.coalesce(a < b, a.isNull() & b.isNotNull())
        more = F.coalesce(a > b, a.isNotNull() & b.isNull())
        out = F.when(less, F.lit(-ways[i])).when(more, F.lit(ways[i])).otherwise(out)
    return out


def _key(df: DataFrame, keys: list[tuple[str, int]]) -> tuple[Column, list[int]]:
    """The order of the last $sort as one comparable value, with the direction of each part (numbers and times are turned
    round, so that most orders have one direction); without a sort, all columns that can be compared."""
    if keys:
        parts, ways = [], []
        same = len({w > 0 for _, w in keys}) == 1
        for i, (name, way) in enumerate(keys):
            c, kind = resolve(df, name)
            way = 1 if way >= 0 else -1
            if way < 0 and not same and isinstance(kind, T.NumericType):
                c, way = -c, 1
            elif way < 0 and not same and isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                c, way = -F.unix_micros(c.cast("timestamp")), 1
            parts.append(c.alias(f"k{i}"))
            ways.append(way)
        return F.struct(*parts), ways
    plain = [c for c, t in zip(df.columns, df.schema, strict=True) if not isinstance(t.dataType, (T.MapType, T.VariantType))]
    return F.struct(*(df[f"`{c}`"] for c in (["_id"] if "_id" in plain else plain))), [1]


def run_pipeline(df: DataFrame, stages: list[dict], tables: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """tables: where $lookup finds other collections. Unknown stages are errors."""
    keys: list[tuple[str, int]] = []
    for stage in stages:
        if len(stage) != 1:
            raise ParseError(f"a stage has one operator: {stage!r}")
        ((op, spec),) = stage.items()
        if op == "$match":
            df = df.where(compile_predicate(df, json_filter(spec)))
        elif op == "$group":
            ref = spec.get("_id")
            aggs = [accumulator(df, *next(iter(a.items())), keys).alias(name) for name, a in spec.items() if name != "_id"] or [F.count(F.lit(1)).alias("__n")]
            if isinstance(ref, dict):
                group = F.struct(*(_field(df, r).alias(n) for n, r in ref.items()))
            else:
                group = _field(df, ref) if isinstance(ref, str) else None
            if group is None:  # all rows are one group, if there are any
                df = df.agg(*aggs, F.count(F.lit(1)).alias("__rows")).where("__rows > 0").drop("__rows").select(F.lit(None).cast("string").alias("_id"), *(n for n in spec if n != "_id"))
            else:
                df = df.groupBy(group.alias("_id")).agg(*aggs)
            df, keys = df.drop("__n"), []
        elif op == "$sort":
            keys = [(k, int(v)) for k, v in spec.items()]
            df = sort(df, [(k, v >= 0) for k, v in keys])
        elif op == "$limit":
            df = df.limit(int(spec))
        elif op == "$skip":
            df = df.offset(int(spec))
        elif op == "$project":
            include = [k for k, v in spec.items() if v not in (0, False)]
            if include:
                keep = (["_id"] if "_id" in df.columns and spec.get("_id", 1) not in (0, False) and "_id" not in include else []) + include
                df = df.select(*(resolve(df, k)[0].alias(k) for k in keep))
            else:
                df = df.drop(*spec)
        elif op == "$count":
            df, keys = df.agg(F.count(F.lit(1)).alias(spec)), []
        elif op == "$unwind":
            path, keep = (spec, False) if isinstance(spec, str) else (spec["path"], bool(spec.get("preserveNullAndEmptyArrays")))
            name = path.removeprefix("$")
            kind = df.schema[name].dataType if name in df.columns else None
            if not isinstance(kind, T.ArrayType):
                df = df.withColumn(name, F.lit(None).cast("string")) if keep else df.where(F.lit(False))
            else:
                others = [df[f"`{c}`"] for c in df.columns if c != name]
                df = df.select(*others, (F.explode_outer if keep else F.explode)(df[name]).alias(name)).select(*df.columns)
        elif op == "$lookup":
            if tables is None:
                raise ParseError("no collections to look up in")
            df = lookup(df, tables(spec["from"]), spec["localField"], spec["foreignField"], spec["as"])
        else:
            raise ParseError(f"unknown stage {op}")
    return df


def sort(df: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    """Missing values are lowest."""
    return df.orderBy(*((c.asc_nulls_first() if up else c.desc_nulls_last()) for c, up in ((resolve(df, n)[0], up) for n, up in order)))


def lookup(df: DataFrame, other: DataFrame, local: str, foreign: str, name: str) -> DataFrame:
    """Each row with the array of the other collection's rows whose field equals its own; null meets null.

    The other side is grouped before it is joined, so it moves once for each key and not for each pair."""
    theirs, kind = resolve(other, foreign)
    if kind is None:
        theirs = F.lit(None).cast("string")
    grouped = other.groupBy(theirs.alias("__key")).agg(F.collect_list(F.struct(*(other[f"`{c}`"] for c in other.columns))).alias("__rows"))
    mine = resolve(df, local)[0]
    joined = df.join(grouped, mine.eqNullSafe(grouped["__key"]), "left")
    empty = F.array().cast(grouped.schema["__rows"].dataType)
    return joined.select(*(df[f"`{c}`"] for c in df.columns if c != name), F.coalesce("__rows", empty).alias(name))
