"""The engine: named collections, graphs and vector indexes, and statements in five front-ends run against them."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import changes, find, statistics, text, vector
from tessera.operators.graph import Graph
from tessera.plans import nodes as N
from tessera.plans.cypher import parse_cypher
from tessera.plans.lexer import ParseError
from tessera.plans.mongo import field_changes, parse_mongo
from tessera.plans.pipeline import run_pipeline
from tessera.plans.predicates import compile_predicate
from tessera.plans.sql import parse_sql
from tessera.sources.files import documents
from tessera.streaming import feeds


@dataclass
class Collection:
    df: DataFrame
    key: str = "_id"
    expire: str | None = None  # the column with the time after which a row is gone


@dataclass
class VectorIndex:
    collection: str
    key: str
    column: str
    metric: str = "cosine"
    lists: vector.InvertedLists | None = None
    probes: int = vector.PROBES


def parse(statement: str, args: Sequence[Any] = ()) -> Any:
    """The statement of a text, by its first word: db. is Mongo's shell, MATCH and CREATE ( are Cypher, the rest SQL."""
    head = statement.lstrip()
    first = head.split(None, 1)[0].upper() if head.strip() else ""
    if head.startswith("db."):
        return parse_mongo(head, args)
    if first == "MATCH" or first.startswith("MATCH(") or first.startswith("CREATE(") or first == "CREATE" and head[6:].lstrip().startswith("("):
        return parse_cypher(head.replace("MATCH(", "MATCH (", 1).replace("CREATE(", "CREATE (", 1), args)
    return parse_sql(statement, args)


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.collections: dict[str, Collection] = {}
        self.vectors: dict[str, VectorIndex] = {}
        self.indexes: dict[str, N.Index] = {}
        self.stats: dict[str, statistics.Stats] = {}
        self.cursors: dict[int, Cursor] = {}
        self.now = F.current_timestamp()
        none = spark.createDataFrame([], "id string, label string"), spark.createDataFrame([], "src string, dst string, relation string, weight double")
        self.graph = Graph(*none)

    # Catalog.

    def register(self, name: str, df: DataFrame, key: str = "_id", expire: str | None = None) -> Engine:
        """expire: a column of times; rows are gone from then on, before anything reads them."""
        self.collections[name] = Collection(df, key, expire)
        return self

    def table(self, name: str) -> DataFrame:
        if name.lower() in ("information_schema.tables", "pg_catalog.pg_tables", "information_schema.columns"):
            return self._reflected(name.lower())
        if name not in self.collections:
            raise KeyError(f"no collection {name}")
        c = self.collections[name]
        return c.df if c.expire is None else feeds.live(c.df, self.now, c.expire)

    def _reflected(self, name: str) -> DataFrame:
        if name.endswith("columns"):
            rows = [(n, f.name, i, f.dataType.simpleString()) for n, c in sorted(self.collections.items()) if c.df is not None for i, f in enumerate(c.df.schema.fields, 1)]
            return self.spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string")
        first = "schemaname string, tablename" if "pg_" in name else "table_schema string, table_name"
        return self.spark.createDataFrame([("default", n) for n in sorted(self.collections)], f"{first} string")

    def _replace(self, name: str, df: DataFrame) -> None:
        self.collections[name].df = df
        self.stats.pop(name, None)

    def create_vector_index(self, name: str, collection: str, column: str, metric: str = "cosine", lists: int = 0, probes: int = vector.PROBES) -> None:
        """An index by name; with lists, inverted lists that VECTOR NEAR looks in, and else the vectors themselves."""
        key = self.collections[collection].key
        made = vector.InvertedLists(self.table(collection), column, key, lists, metric=metric) if lists else None
        self.vectors[name] = VectorIndex(collection, key, column, metric, made, probes)

    def drop_vector_index(self, name: str) -> None:
        self.vectors.pop(name)

    def show_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(n, c.key) for n, c in sorted(self.collections.items())], "collection string, key string")

    def describe(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in self.table(name).schema.fields], "field string, type string")

    # Statements.

    def query(self, statement: str, args: Sequence[Any] = ()) -> DataFrame:
        """Runs a statement; $1, $2 ... stand for args. Changes return the number of rows that the collection has then."""
        return self.run(parse(statement, args))

    def run(self, s: Any) -> DataFrame:
        if isinstance(s, N.Find):
            return self.find(s)
        if isinstance(s, N.Explain):
            return self.explain(s)
        if isinstance(s, N.Analyze):
            return statistics.column_stats(self.table(s.collection))
        if isinstance(s, N.Insert):
            return self.insert(s.collection, s.rows)
        if isinstance(s, N.Update):
            self._replace(s.collection, changes.update(self.table(s.collection), s.sets, s.where))
            return self._count(s.collection)
        if isinstance(s, N.Delete):
            self._replace(s.collection, changes.delete(self.table(s.collection), s.where))
            return self._count(s.collection)
        if isinstance(s, N.Create):
            self.collections.setdefault(s.collection, Collection(self.spark.createDataFrame([], "_id string")))
            return self._count(s.collection)
        if isinstance(s, N.Drop):
            self.collections.pop(s.collection, None)
            self.stats.pop(s.collection, None)
            return self.show_tables()
        if isinstance(s, N.Alter):
            return self._alter(s)
        if isinstance(s, N.Index):
            return self._index(s)
        if isinstance(s, N.EdgeChange):
            return self._edge(s)
        if isinstance(s, N.Show):
            return self._show(s)
        if isinstance(s, list):
            return self.spark.range(1).select(*(self._session(x) for x in s))
        if isinstance(s, N.Acknowledge):
            return self.spark.createDataFrame([(s.text,)], "acknowledged string")
        raise ParseError(f"can't run {s!r}")

    def _count(self, name: str) -> DataFrame:
        return self.table(name).agg(F.count(F.lit(1)).alias("count"))

    def find(self, f: N.Find) -> DataFrame:
        c = self.collections.get(f.collection) or Collection(self.table(f.collection), "table_name")
        scope = find.Scope(df := self.table(f.collection), f.alias or f.collection, tuple(j.alias or j.table for j in f.joins), bool(f.joins or f.alias))
        bind = lambda p, rows: find.rewritten(p, lambda n: scope.bound(n, rows))
        parts = find.conjuncts(f.where)
        late = [p for p in parts if f.joins and not all(scope.of_left(n) for n in find.fields(p))]  # of joined tables
        if early := [p for p in parts if p not in late]:
            early = bind(N.All(tuple(early)), df)
            df = df.where(compile_predicate(df, early))
        if f.traverse is not None:
            if self.graph.vertices.where(F.col("id") == f.traverse.start).isEmpty():
                raise KeyError(f"no vertex {f.traverse.start}")
            reached = self.graph.bfs(f.traverse.start, f.traverse.depth, f.traverse.relation, f.traverse.direction).select(F.col("id").alias("__id"))
            df = df.join(reached, df[c.key].cast("string") == reached["__id"], "left_semi")
        if f.near is not None and not late:
            df = self._nearest(f, df, not parts and f.traverse is None)
        for j in f.joins:
            bound = N.Join(j.table, scope.bound(j.left, df), j.right, j.how, j.alias)
            df, named = find.join(df, self.table(j.table), bound)
            scope.add(j.alias or j.table, named)
        if late:
            df = df.where(compile_predicate(df, bind(N.All(tuple(late)), df)))
            if f.near is not None:  # the best of the rows that the joined tables leave
                df = self._nearest(f, df, False)
        if f.count:
            return df.agg(F.count(F.lit(1)).alias("count"))
        if f.distinct:
            return find.distinct(df, scope.bound(f.distinct, df))
        order = [(scope.bound(n, df), up) for n, up in f.order] or ([("distance", True), (c.key, True)] if f.near is not None else [])
        return find.finished(df, order, f.skip, f.limit, self._columns(f, scope, df))

    def _columns(self, f: N.Find, scope: find.Scope, df: DataFrame) -> list[tuple[str, str]] | None:
        """(path, name) of what a statement selects; of two fields of one name the second is {table}_{field}."""
        out: list[tuple[str, str]] = []
        for x in f.columns or ():
            if isinstance(x, str) and x.endswith(".*"):
                out += [(column, column) for column in scope.tables[x[:-2]].values()]
                continue
            path, name = x if isinstance(x, tuple) else (x, x.rsplit(".", 1)[-1])
            bound = scope.bound(path, df)
            out.append((bound, name if name not in [n for _, n in out] else bound))
        return out or None

    def _nearest(self, f: N.Find, df: DataFrame, whole: bool) -> DataFrame:
        """The nearest rows of df; from inverted lists where the index has some and df is its whole collection."""
        index = self._vector_index(f)
        if index.lists is not None and whole and self.collections[f.collection].expire is None:
            return index.lists.search(f.near.vector, f.near.k, index.probes)
        return vector.knn(df, f.near.vector, f.near.k, index.column, index.key if index.key in df.columns else self.collections[f.collection].key, index.metric)

    def _show(self, s: N.Show) -> DataFrame:
        if s.what == "columns":
            return self.describe(s.collection or "")
        if s.what == "indexes":
            rows = [(n, i.collection, i.fields, i.unique) for n, i in self.indexes.items() if s.collection in (None, i.collection)]
            return self.spark.createDataFrame(rows, "name string, collection string, fields array<string>, unique boolean")
        return self.spark.createDataFrame([("default",)], "database string") if s.what == "databases" else self.show_tables()

    @staticmethod
    def _session(x: N.Session) -> Column:
        known = {"version": F.version(), "current_database": F.current_database(), "current_schema": F.current_schema(), "current_user": F.current_user(), "session_user": F.current_user(), "user": F.current_user(), "now": F.current_timestamp(), "current_timestamp": F.current_timestamp()}
        if x.name not in known:
            raise ParseError(f"unknown function {x.name}")
        return known[x.name].alias(x.alias or x.name)

    # Cursors: batches in order of the key, each from where the one before ended.

    def open_cursor(self, name: str, where: Any = None, batch: int = 101) -> tuple[int, DataFrame]:
        """(cursor, first batch) over the rows of a collection that match."""
        n = max(self.cursors, default=0) + 1
        df = self.table(name)
        self.cursors[n] = Cursor(df.where(compile_predicate(df, where)), self.collections[name].key, batch)
        return n, self.get_more(n)

    def get_more(self, cursor: int, batch: int | None = None) -> DataFrame:
        """The next batch; a cursor that is unknown or has been killed is an error, one past its end gives no rows."""
        if cursor not in self.cursors:
            raise KeyError(f"no cursor {cursor}")
        return self.cursors[cursor].next(batch)

    def kill_cursors(self, *cursors: int, idle: float | None = None) -> int:
        """Ends cursors, or all that nobody asked for so many seconds; how many there were."""
        old = [n for n, c in self.cursors.items() if idle is not None and time.monotonic() - c.used >= idle]
        return sum(self.cursors.pop(n, None) is not None for n in {*cursors, *old})

    def _vector_index(self, f: N.Find) -> VectorIndex:
        """The named index, else one of the collection's, else the only one, else the collection's own vector field."""
        if f.near.index:
            if f.near.index not in self.vectors:
                raise KeyError(f"no vector index {f.near.index}")
            return self.vectors[f.near.index]
        own = [v for n, v in self.vectors.items() if n == f.collection or v.collection == f.collection]
        if own or len(self.vectors) == 1:
            return (own or list(self.vectors.values()))[0]
        for name in ("vector", "embedding"):
            if name in self.table(f.collection).columns:
                return VectorIndex(f.collection, self.collections[f.collection].key, name)
        raise KeyError("no vector index or field")

    def aggregate(self, collection: str, stages: list[dict] | str) -> DataFrame:
        return run_pipeline(self.table(collection), json.loads(stages) if isinstance(stages, str) else stages, self.table)

    def search(self, collection: str, query: str, k: int = 10, fuzzy: bool = False, column: str | None = None) -> DataFrame:
        """The k best rows for a text query, with _score and _matched_terms."""
        c = self.collections[collection]
        df = c.df if column else text.searchable(c.df)
        hits = text.bm25(df, query, k, c.key, column or "__text", fuzzy).select(F.col(c.key), F.col("score").alias("_score"), F.col("matched_terms").alias("_matched_terms"))
        return c.df.join(hits, c.key).orderBy(F.desc("_score"), c.key)

    def explain(self, e: N.Explain) -> DataFrame:
        """Estimates for a Find, with its physical plan if verbose and its rows if analysed; other statements never run."""
        s, rows = e.statement, [("statement", type(e.statement).__name__)]
        if isinstance(s, N.Find):
            stats = self.stats.get(s.collection) or self.stats.setdefault(s.collection, statistics.Stats.of(self.table(s.collection)))
            indexed = {i.fields[0] for i in self.indexes.values() if i.collection == s.collection and i.fields}
            rows += [(k, str(v)) for k, v in statistics.plan_choice(s.where, stats, indexed).items()]
            df = self.find(s)
            if e.verbose:
                rows.append(("plan", df._jdf.queryExecution().toString()))
            if e.analyze:
                rows.append(("actual_rows", str(df.count())))
        return self.spark.createDataFrame(rows, "item string, value string")

    def analyze(self, name: str) -> statistics.Stats:
        self.stats[name] = statistics.Stats.of(self.table(name))
        return self.stats[name]

    # Changes.

    def insert(self, name: str, rows: list[dict]) -> DataFrame:
        c = self.collections.setdefault(name, Collection(self.spark.createDataFrame([], "_id string")))
        if not c.df.columns or c.df.columns == ["_id"] and c.key == "_id":
            rows = [r if "_id" in r or "id" not in r else {"_id": str(r["id"]), **r} for r in rows]
        more = documents(self.spark, rows)
        for f in c.df.schema.fields:
            if f.name in more.columns and more.schema[f.name].dataType != f.dataType:
                more = more.withColumn(f.name, F.col(f.name).cast(f.dataType))
        unique = tuple(tuple(i.fields) for i in self.indexes.values() if i.collection == name and i.unique)
        self._replace(name, changes.insert(c.df, more, c.key, unique))
        return self._count(name)

    def _alter(self, s: N.Alter) -> DataFrame:
        if s.action == "rename":
            self.collections[s.name] = self.collections.pop(s.collection)
            return self.show_tables()
        df = self.table(s.collection)
        self._replace(s.collection, changes.add_column(df, s.name, s.default) if s.action == "add" else df.drop(s.name))
        return self.describe(s.collection)

    def _index(self, s: N.Index) -> DataFrame:
        if s.drop:
            self.indexes.pop(s.name, None)
        else:
            if s.unique and not changes.unique_violations(self.table(s.collection), s.fields).isEmpty():
                raise changes.Conflict(f"{s.collection} repeats values of {s.fields}")
            self.indexes[s.name] = s
        return self.spark.createDataFrame([(n, i.collection, i.fields, i.unique) for n, i in self.indexes.items()], "name string, collection string, fields array<string>, unique boolean")

    def _edge(self, s: N.EdgeChange) -> DataFrame:
        if s.delete:
            self.graph = self.graph.remove_edges(s.source, s.target, s.relation)
        else:
            self.graph = self.graph.add_edges(self.spark.createDataFrame([(s.source, s.target, s.relation or "RELATED", s.weight)], "src string, dst string, relation string, weight double"))
        return self.graph.edges.agg(F.count(F.lit(1)).alias("edges"))

    # The names that clients of the store use.

    def find_one(self, name: str, key: Any) -> DataFrame:
        return self.table(name).where(F.col(self.collections[name].key) == key).limit(1)

    def count(self, name: str, where: Any = None) -> int:
        df = self.table(name)
        return df.where(compile_predicate(df, where)).count()

    def vector_search(self, name: str, query: Sequence[float], k: int = 10, where: Any = None) -> DataFrame:
        return self.find(N.Find(name, where, near=N.Near(tuple(query), k)))

    def collection_stats(self, name: str) -> DataFrame:
        return statistics.table_stats(self.table(name))

    def database_stats(self) -> DataFrame:
        """(collections, count, bytes) over all collections."""
        each = [self.collection_stats(n) for n, c in self.collections.items() if c.df is not None]
        total = each[0] if each else self.spark.createDataFrame([], "count long, bytes long")
        for one in each[1:]:
            total = total.unionByName(one)
        return total.agg(F.lit(len(each)).alias("collections"), F.coalesce(F.sum("count"), F.lit(0)).alias("count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))

    def put(self, name: str, key: Any, document: dict) -> DataFrame:
        """Replaces the row of a key: fields that the document lacks are missing then."""
        c = self.collections[name]
        self._replace(name, changes.replaced(c.df, c.key, key, documents(self.spark, [{**document, c.key: key}])))
        return self._count(name)

    def patch(self, name: str, key: Any, spec: dict) -> DataFrame:
        """Changes fields of the row of a key: $set, $inc and $unset, or fields to merge."""
        c = self.collections[name]
        self._replace(name, changes.update(c.df, field_changes(spec), N.Leaf("eq", c.key, key)))
        return self._count(name)


class Cursor:
    """Where the batches of a result stand."""

    def __init__(self, df: DataFrame, key: str, batch: int):
        self.df, self.key, self.batch, self.last, self.used = df, key, batch, None, time.monotonic()

    def next(self, batch: int | None = None) -> DataFrame:
        self.used = time.monotonic()
        rest = self.df.where(F.col(self.key).isNotNull()) if self.last is None else self.df.where(F.col(self.key) > F.lit(self.last))
        out = rest.orderBy(self.key).limit(batch or self.batch)
        last = out.agg(F.max(self.key)).first()[0]
        self.last = last if last is not None else self.last
        return out
