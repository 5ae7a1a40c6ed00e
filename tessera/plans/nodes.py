"""What the front-ends produce: predicates, statements and pipeline stages."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Leaf:
    """A comparison of a field. op: eq ne gt ge lt le contains startswith endswith in between like isnull notnull."""

    op: str
    name: str
    value: Any = None


@dataclass(frozen=True)
class All:
    parts: tuple = ()


@dataclass(frozen=True)
class AnyOf:
    parts: tuple = ()


@dataclass(frozen=True)
class Not:
    part: Any


@dataclass(frozen=True)
class Always:
    pass


@dataclass(frozen=True)
class Join:
    table: str
    left: str
    right: str
    how: str = "inner"
    alias: str | None = None


@dataclass(frozen=True)
class Near:
    """Vector top-k. index: the registered vector index, if named."""

    vector: tuple
    k: int = 10
    index: str | None = None


@dataclass(frozen=True)
class Traverse:
    start: str
    depth: int = 1
    relation: str | None = None
    direction: str = "out"


@dataclass
class Find:
    collection: str
    where: Any = None
    columns: list[Any] | None = None  # fields, or (field, name)
    order: list[tuple[str, bool]] = field(default_factory=list)  # (field, ascending)
    limit: int | None = None
    skip: int = 0
    joins: list[Join] = field(default_factory=list)
    near: Near | None = None
    traverse: Traverse | None = None
    distinct: str | None = None
    count: bool = False
    alias: str | None = None


@dataclass
class Insert:
    collection: str
    rows: list[dict]


@dataclass
class Update:
    collection: str
    sets: dict[str, Any]
    where: Any = None


@dataclass
class Delete:
    collection: str
    where: Any = None


@dataclass(frozen=True)
class Arithmetic:
    """field + amount, of a missing field from 0."""

    name: str
    amount: float


@dataclass
class Create:
    collection: str


@dataclass
class Drop:
    collection: str


@dataclass
class Alter:
    collection: str
    action: str  # add, drop or rename
    name: str
    default: Any = None


@dataclass
class Index:
    collection: str
    name: str
    fields: list[str]
    unique: bool = False
    drop: bool = False


@dataclass
class EdgeChange:
    source: str
    target: str
    relation: str | None
    weight: float = 1.0
    delete: bool = False


@dataclass
class Explain:
    statement: Any
    analyze: bool = False
    verbose: bool = False


@dataclass
class Analyze:
    collection: str


@dataclass(frozen=True)
class Show:
    """What the catalog has: tables, indexes, databases, or the columns of a collection."""

    what: str
    collection: str | None = None


@dataclass(frozen=True)
class Session:
    """A function of the session, such as version()."""

    name: str
    alias: str | None = None


@dataclass
class Acknowledge:
    """Session settings and transaction words, which change nothing here."""

    text: str
