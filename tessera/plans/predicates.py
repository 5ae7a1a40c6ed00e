"""Predicates to Columns, with two-valued logic: a comparison with a missing value is false, and its negation true."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.nodes import All, Always, AnyOf, Leaf, Not

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def resolve(df: DataFrame, path: str) -> tuple[Column, T.DataType | None]:
    """A dotted path: fields of structs and maps, places of arrays, and paths into JSON strings. A field that isn't there is null."""
    if path in df.columns:
        return df[f"`{path}`"], df.schema[path].dataType
    parts = path.split(".")
    if parts[0] not in df.columns:
        if path in ("id", "_id"):
            for other in ("_id", "id"):
                if other in df.columns:
                    return df[other], df.schema[other].dataType
        return F.lit(None), None
    column, kind = df[f"`{parts[0]}`"], df.schema[parts[0]].dataType
    for i, part in enumerate(parts[1:], 1):
        if isinstance(kind, T.StructType):
            if part not in kind.fieldNames():
                return F.lit(None), None
            column, kind = column.getField(part), kind[part].dataType
        elif isinstance(kind, T.MapType):
            column, kind = column.getItem(part), kind.valueType
        elif isinstance(kind, T.ArrayType):
            if not part.isdigit():
                return F.lit(None), None
            column, kind = F.get(column, F.lit(int(part))), kind.elementType
        elif isinstance(kind, T.StringType):
            rest = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in parts[i:])
            return F.get_json_object(column, rest), T.StringType()
        else:
            return F.lit(None), None
    return column, kind


def _literal(value: Any, kind: T.DataType | None) -> tuple[Column, bool]:
    """The value as a Column, and whether it can be compared with a column of this kind."""
    if value is None:
        return F.lit(None), True
    if isinstance(value, bool):
        return F.lit(value), isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return F.lit(value), isinstance(kind, _NUMBERS)
    if isinstance(value, (list, tuple)):
        return F.lit(list(value)), isinstance(kind, T.ArrayType)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(value).cast(kind), True
    return F.lit(value), isinstance(kind, (T.StringType, T.CharType, T.VarcharType))


def compile_predicate(df: DataFrame, p: Any) -> Column:
    """p over the columns of df, never null."""
    if p is None or isinstance(p, Always):
        return F.lit(True)
    if isinstance(p, Not):
        return ~compile_predicate(df, p.part)
    if isinstance(p, (All, AnyOf)):
        out = None
        for part in p.parts:
            c = compile_predicate(df, part)
            out = c if out is None else (out & c if isinstance(p, All) else out | c)
        return F.lit(isinstance(p, All)) if out is None else out
    if not isinstance(p, Leaf):
        raise ValueError(f"no predicate: {p!r}")
    c, kind = resolve(df, p.name)
    # Numbers in JSON strings compare as numbers.
    if isinstance(kind, T.StringType) and p.name not in df.columns and isinstance(p.value, (int, float)) and not isinstance(p.value, bool):
        c, kind = c.cast("double"), T.DoubleType()
    never = F.lit(False)
    if p.op == "isnull":
        return c.isNull()
    if p.op == "notnull":
        return c.isNotNull()
    if p.op in ("eq", "ne"):
        v, fits = _literal(p.value, kind)
        same = c.isNull() if p.value is None else F.coalesce(c == v, never) if fits and kind is not None else never
        return same if p.op == "eq" else ~same
    if p.op == "in":
        values = [x for x in p.value if x is not None and _literal(x, kind)[1]]
        found = F.coalesce(c.isin(values), never) if values and kind is not None else never
        return found | c.isNull() if any(x is None for x in p.value) else found
    if kind is None:
        return never
    if p.op == "between":
        (lo, a), (hi, b) = _literal(p.value[0], kind), _literal(p.value[1], kind)
        return F.coalesce(c.between(lo, hi), never) if a and b else never
    if p.op in ("gt", "ge", "lt", "le"):
        v, fits = _literal(p.value, kind)
        if not fits or p.value is None or isinstance(p.value, bool):
            return never
        return F.coalesce({"gt": c > v, "ge": c >= v, "lt": c < v, "le": c <= v}[p.op], never)
    text = isinstance(kind, T.StringType)
    if p.op == "contains":
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.array_contains(c, p.value), never)
        return F.coalesce(c.contains(str(p.value)), never) if text else never
    if not text:
        return never
    if p.op == "startswith":
        return F.coalesce(c.startswith(p.value), never)
    if p.op == "endswith":
        return F.coalesce(c.endswith(p.value), never)
    if p.op == "like":
        return F.coalesce(c.ilike(p.value.replace("\\", "\\\\")), never)
    raise ValueError(f"no operator: {p.op}")


_OPERATORS = {"$eq": "eq", "$ne": "ne", "$neq": "ne", "$gt": "gt", "$gte": "ge", "$lt": "lt", "$lte": "le", "$contains": "contains", "$startsWith": "startswith", "$endsWith": "endswith", "$in": "in"}


def json_filter(spec: dict) -> Any:
    """A filter document: fields are all to hold; $or and $and take lists; unknown operators are errors."""
    parts: list[Any] = []
    for key, value in spec.items():
        if key in ("$or", "$and"):
            kind = AnyOf if key == "$or" else All
            parts.append(kind(tuple(json_filter(x) for x in value)))
        elif key == "$not":
            parts.append(Not(json_filter(value)))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        elif isinstance(value, dict) and any(k.startswith("$") for k in value):
            for op, x in value.items():
                if op == "$nin":
                    parts.append(Not(Leaf("in", key, tuple(x))))
                elif op == "$exists":
                    parts.append(Leaf("notnull" if x else "isnull", key))
                elif op in _OPERATORS:
                    parts.append(Leaf(_OPERATORS[op], key, tuple(x) if op == "$in" else x))
                else:
                    raise ValueError(f"unknown operator {op}")
        else:
            parts.append(Leaf("eq", key, value))
    return parts[0] if len(parts) == 1 else All(tuple(parts)) if parts else Always()


def matches(row: dict, p: Any) -> bool:
    """What a predicate means for one row, in plain Python; tests hold compiled predicates against it."""
    if p is None or isinstance(p, Always):
        return True
    if isinstance(p, Not):
        return not matches(row, p.part)
    if isinstance(p, All):
        return all(matches(row, x) for x in p.parts)
    if isinstance(p, AnyOf):
        return any(matches(row, x) for x in p.parts)
    v, w = row.get(p.name), p.value
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    alike = lambda x, y: x is not None and y is not None and (number(x) and number(y) or type(x) is type(y))
    same = lambda x, y: x is None and y is None or alike(x, y) and x == y
    if p.op in ("isnull", "notnull"):
        return (v is None) == (p.op == "isnull")
    if p.op in ("eq", "ne"):
        return same(v, w) == (p.op == "eq")
    if p.op == "in":
        return any(same(v, x) for x in w)
    if p.op == "between":
        return alike(v, w[0]) and alike(v, w[1]) and w[0] <= v <= w[1]
    if p.op in ("gt", "ge", "lt", "le"):
        return bool(alike(v, w) and not isinstance(v, bool) and {"gt": v > w, "ge": v >= w, "lt": v < w, "le": v <= w}[p.op])
    if p.op == "contains":
        return w in v if isinstance(v, (list, str)) else False
    if not isinstance(v, str):
        return False
    if p.op == "like":
        import re

        return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in w.lower()), v.lower(), re.S) is not None
    return v.startswith(w) if p.op == "startswith" else v.endswith(w)
