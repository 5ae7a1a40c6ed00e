"""Find statements in their fixed order: filter, traversal, vectors, joins, sort, skip and limit, projection."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.nodes import All, AnyOf, Join, Leaf, Not
from tessera.plans.pipeline import sort
from tessera.plans.predicates import compile_predicate, resolve


class Scope:
    """What the names of a statement stand for: tables by name or alias, with the column that each of their fields has in
    the joined rows. A qualifier that names no table and no column is an error where tables have aliases or are joined."""

    def __init__(self, df: DataFrame, name: str, joined: tuple[str, ...] = (), strict: bool = False):
        self.tables: dict[str, dict[str, str]] = {name: {c: c for c in df.columns}}
        self.name, self.joined, self.left, self.strict = name, joined, set(df.columns), strict

    def add(self, alias: str, fields: dict[str, str]) -> None:
        if alias in self.tables:
            raise KeyError(f"two tables are named {alias}")
        self.tables[alias] = fields

    def bound(self, name: str, df: DataFrame) -> str:
        """The path in the joined rows that a name stands for."""
        head, _, rest = name.partition(".")
        if not rest or name in df.columns:
            return name
        if head in self.tables:
            field, dot, more = rest.partition(".")
            column = self.tables[head].get(field)
            return f"{column}{dot}{more}" if column else rest if rest in ("id", "_id") else f"{head}.{rest}"
        if self.strict and head not in df.columns:
            raise KeyError(f"{head} names no table or field")
        return name

    def of_left(self, name: str) -> bool:
        """Whether a name needs none of the joined tables."""
        head, _, rest = name.partition(".")
        if rest and head in self.joined:
            return False
        return rest != "" and head == self.name or head in self.left or head in ("id", "_id")


def rewritten(p: Any, name) -> Any:
    """The predicate with each field's name put through a function."""
    if isinstance(p, (All, AnyOf)):
        return type(p)(tuple(rewritten(x, name) for x in p.parts))
    if isinstance(p, Not):
        return Not(rewritten(p.part, name))
    return Leaf(p.op, name(p.name), p.value) if isinstance(p, Leaf) else p


def fields(p: Any) -> set[str]:
    if isinstance(p, (All, AnyOf)):
        return set().union(*(fields(x) for x in p.parts)) if p.parts else set()
    if isinstance(p, Not):
        return fields(p.part)
    return {p.name} if isinstance(p, Leaf) else set()


def conjuncts(p: Any) -> list:
    return [] if p is None else [y for x in p.parts for y in conjuncts(x)] if isinstance(p, All) else [p]


def join(left: DataFrame, right: DataFrame, j: Join) -> tuple[DataFrame, dict[str, str]]:
    """Equi-join on one field of each side, and which column each of the right side's fields has then; null keys never meet.
    The right side's fields come as {table}_{field} (by its alias where that is taken), and under their own name where the
    left has none of that name."""
    names = right.columns
    right = right.select(*(right[f"`{c}`"].alias(f"__{c}") for c in names))  # a table may be joined with itself
    a, kind_a = resolve(left, j.left)
    b, kind_b = resolve(right, f"__{j.right}" if j.right.split(".")[0] in names else "__" + next((x for x in ("_id", "id") if x in names and j.right in ("_id", "id")), j.right))
    if kind_a is None or kind_b is None:
        condition = F.lit(False)
    elif kind_a == kind_b or isinstance(kind_a, T.NumericType) and isinstance(kind_b, T.NumericType):
        condition = a == b
    else:
        condition = a.cast("string") == b.cast("string")
    taken, named, extra = set(left.columns), {}, []
    for c in names:
        new = f"{j.table}_{c}"
        while new in taken:
            new = f"{j.alias or j.table}_{c}" if new == f"{j.table}_{c}" and j.alias != j.table else f"{new}_"
        named[c] = new
        extra.append(right[f"`__{c}`"].alias(new))
        taken.add(new)
    extra += [right[f"`__{c}`"].alias(c) for c in names if c not in taken]
    return left.join(right, condition, "left" if j.how == "left" else "inner").select(*(left[f"`{c}`"] for c in left.columns), *extra), named


def distinct(df: DataFrame, name: str) -> DataFrame:
    c, _ = resolve(df, name)
    return df.select(c.alias(name.rsplit(".", 1)[-1])).where(F.col(name.rsplit(".", 1)[-1]).isNotNull()).distinct()


def known(df: DataFrame, name: str) -> None:
    """An error unless the rows have the field; a path may lead to nothing in some of them."""
    if name not in df.columns and name.split(".")[0] not in df.columns and resolve(df, name)[1] is None:
        raise KeyError(f"no field {name}")


def project(df: DataFrame, names: list[str]) -> DataFrame:
    """These columns; one that isn't there is an error."""
    for n in names:
        if n not in df.columns:
            raise KeyError(f"no column {n}")
    return df.select(*(df[f"`{n}`"] for n in names))


def finished(df: DataFrame, order, skip: int, limit: int | None, columns: list[tuple[str, str]] | None) -> DataFrame:
    """columns: (path, name) of each."""
    for name, *_ in [*order, *(columns or [])]:
        known(df, name)
    if order:
        df = sort(df, order)
    if skip:
        df = df.offset(skip)
    if limit is not None:
        df = df.limit(limit)
    if columns:
        df = df.select(*(resolve(df, path)[0].alias(name) for path, name in columns))
    return df
