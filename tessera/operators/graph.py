"""Property graphs as two DataFrames: vertices (id, label, ...) and edges (src, dst, relation, weight, ...).

Algorithms that go by rounds keep their state as DataFrames, cut from their lineage with checkpoint(); the driver sees one
count or maximum a round."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. On a single machine without one, a temporary folder; on a cluster its
    machines would not share that, so there it is an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _written(df: DataFrame) -> Iterator[DataFrame]:
    """df as Parquet in the shared folder, which is deleted afterwards: a checkpoint of long tables takes several times that."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4()}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Components whose vertices stay where they are instead of being dealt by their component: the largest ones.
LARGEST = 1000


def _chased(hooks: DataFrame) -> DataFrame:
    """hooks (k, to), of which each to is a k, followed to their ends, by twice as many steps each time."""
    hooks = _cut(hooks)
    while True:
        two = hooks.select(F.col("k").alias("to"), F.col("to").alias("next"))
        hooks = _cut(hooks.join(two, "to").select("k", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        if hooks.where("moved").isEmpty():
            return hooks.select("k", "to")
        hooks = hooks.select("k", "to")


@dataclass
class Graph:
    vertices: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    # Changes give new graphs.

    def add_edges(self, more: DataFrame) -> Graph:
        """Edges are one for each (src, dst, relation), later ones replacing earlier; missing ends become Generic vertices."""
        ranked = self.edges.withColumn("__n", F.lit(0)).unionByName(more.withColumn("__n", F.lit(1)), allowMissingColumns=True)
        last = Window.partitionBy("src", "dst", "relation").orderBy(F.desc("__n"), F.desc("weight"))
        edges = ranked.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r", "__n")
        ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().join(self.vertices.select("id"), "id", "left_anti")
        return Graph(self.vertices.unionByName(ends.withColumn("label", F.lit("Generic")), allowMissingColumns=True), edges)

    def add_vertices(self, more: DataFrame) -> Graph:
        kept = self.vertices.join(more.select("id"), "id", "left_anti")
        return Graph(kept.unionByName(more, allowMissingColumns=True), self.edges)

    def remove_edges(self, src: str, dst: str, relation: str | None = None) -> Graph:
        gone = (F.col("src") == src) & (F.col("dst") == dst) & (F.lit(True) if relation is None else F.col("relation") == relation)
        return Graph(self.vertices, self.edges.where(~F.coalesce(gone, F.lit(False))))

    def remove_vertex(self, vertex: str) -> Graph:
        return Graph(self.vertices.where(F.col("id") != vertex), self.edges.where((F.col("src") != vertex) & (F.col("dst") != vertex)))

    # Reading.

    def along(self, direction: str = "out", relation: str | None = None) -> DataFrame:
        """(u, v, relation, weight) in the direction of travel; both ways a loop counts twice."""
        e = self.edges if relation is None else self.edges.where(F.col("relation") == relation)
        cols = ["relation", "weight"]
        out = e.select(F.col("src").alias("u"), F.col("dst").alias("v"), *cols)
        back = e.select(F.col("dst").alias("u"), F.col("src").alias("v"), *cols)
        return {"out": out, "in": back, "both": out.unionAll(back)}[direction]

    def edges_of(self, vertex: str, direction: str = "out", relation: str | None = None) -> DataFrame:
        return self.along(direction, relation).where(F.col("u") == vertex)

    def by_property(self, name: str, value) -> DataFrame:
        return self.vertices.where(F.col(name) == value)

    def by_label(self, label: str) -> DataFrame:
        return self.vertices.where(F.col("label") == label)

    def counts(self) -> DataFrame:
        return self.vertices.agg(F.count(F.lit(1)).alias("vertices")).crossJoin(self.edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each

    def degrees(self) -> DataFrame:
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
        d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
        return self.vertices.select("id").join(d, "id", "left").na.fill(0, ["in_degree", "out_degree"]).withColumn("total_degree", F.col("in_degree") + F.col("out_degree"))

    def bfs(self, starts: DataFrame | str, depth: int, relation: str | None = None, direction: str = "out", budget: int | None = None) -> DataFrame:
        """(seed, id, depth, via) of what is reached from each start in at most depth steps; starts have a column id. budget
        ends the search before the round after which more have been reached."""
        if isinstance(starts, str):
            starts = self.vertices.where(F.col("id") == starts).select("id")
        steps = _cut(self.along(direction, relation))
        total = 0
        seen = _cut(starts.select(F.col("id").alias("seed"), "id").distinct().withColumn("depth", F.lit(0)).withColumn("via", F.lit(None).cast("string")))
        front = seen
        for d in range(1, depth + 1):
            reached = front.select("seed", F.col("id").alias("u")).join(steps, "u").groupBy("seed", F.col("v").alias("id")).agg(F.min("relation").alias("via"))
            front = _cut(reached.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").select("seed", "id", F.lit(d).alias("depth"), "via"))
            n = front.count()
            if not n:
                break
            seen = seen.unionByName(front)
            total += n
            if budget is not None and total >= budget:
                break
        return seen

    def k_hop(self, start: str, k: int, direction: str = "out") -> DataFrame:
        return self.bfs(start, k, direction=direction).where("depth > 0").select("id").distinct()

    def shortest_path(self, start: str, goal: str) -> DataFrame:
        """(path, cost): the vertices of a path of fewest edges, the least such path in order of ids; no row if there is none.
        The search goes on until the goal is met or nothing new is reached."""
        steps = _cut(self.along().select("u", "v").distinct())
        front = _cut(self.vertices.where(F.col("id") == start).select("id", F.array("id").alias("path")))
        seen = front.select("id")
        while not front.isEmpty():
            hit = front.where(F.col("id") == goal)
            if not hit.isEmpty():
                return hit.select("path", (F.size("path") - 1).cast("double").alias("cost"))
            reached = front.join(steps, front["id"] == steps["u"]).select(F.col("v").alias("id"), F.concat("path", F.array("v")).alias("path")).groupBy("id").agg(F.min("path").alias("path"))
            front = _cut(reached.join(seen, "id", "left_anti"))
            seen = _cut(seen.union(front.select("id")))
        return front.where(F.lit(False)).select("path", F.lit(0.0).alias("cost"))

    def costs(self, start: str) -> DataFrame:
        """(id, cost, parent) of the cheapest paths from start; weights below 0 count as 0. Only what got cheaper in a round
        goes on in the next, until nothing does."""
        steps = _cut(self.along().groupBy("u", "v").agg(F.min(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("w")))
        best = _cut(self.vertices.where(F.col("id") == start).select("id", F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("parent")))
        front = best
        while True:
            tried = front.join(steps, front["id"] == steps["u"]).select(F.col("v").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), F.col("u").alias("parent"))
            tried = tried.groupBy("id").agg(F.min(F.struct("cost", "parent")).alias("b")).select("id", "b.*")
            old = best.select("id", F.col("cost").alias("old"))
            front = _cut(tried.join(old, "id", "left").where("old IS NULL OR cost < old").drop("old"))
            if front.isEmpty():
                break
            best = _cut(best.join(front.select("id"), "id", "left_anti").unionByName(front))
        return best

    def dijkstra(self, start: str, goal: str) -> DataFrame:
        """(path, cost) of the cheapest path; no row if there is none."""
        best = _cut(self.costs(start))
        end = best.where(F.col("id") == goal).select(F.col("parent").alias("at"), F.array("id").alias("path"), "cost")
        while True:
            end = _cut(end)
            if end.where("at IS NOT NULL").isEmpty():
                return end.select("path", "cost")
            end = end.join(best.select(F.col("id").alias("at"), "parent"), "at").select(F.col("parent").alias("at"), F.concat(F.array("at"), "path").alias("path"), "cost")

    def pagerank(self, damping: float = 0.85, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
        """(id, rank); vertices without outgoing edges deal their rank to all. Ends early once no rank moves by tolerance."""
        v = _cut(self.vertices.select("id").distinct())
        n = v.count()
        # Links are dealt by their source once, and stay there: in a round only ranks and sums move.
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        links = self.along().select("u", "v").repartition(parts, "u").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            out = links.groupBy("u").agg(F.count(F.lit(1)).alias("deg"))
            degrees = _cut(v.join(out, v["id"] == out["u"], "left").select("id", "deg"))
            ranks = degrees.withColumn("rank", F.lit(1.0 / max(n, 1)))
            for i in range(rounds):
                dangling = ranks.where("deg IS NULL").agg(F.sum("rank")).first()[0] or 0.0
                shares = ranks.where("deg IS NOT NULL").select(F.col("id").alias("u"), (F.col("rank") / F.col("deg")).alias("share")).repartition(parts, "u").hint("shuffle_hash")
                sums = links.join(shares, "u").groupBy("v").agg(F.sum("share").alias("s"))
                base = (1.0 - damping) / n + damping * dangling / n
                new = _cut(degrees.join(sums, degrees["id"] == sums["v"], "left").select("id", "deg", (F.lit(base) + damping * F.coalesce("s", F.lit(0.0))).alias("rank")))
                if tolerance is not None:
                    moved = new.join(ranks.select("id", F.col("rank").alias("old")), "id").agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
                    if moved is None or moved < tolerance:
                        return new.select("id", "rank")
                ranks = new
        finally:
            links.unpersist()
        return ranks.select("id", "rank")

    def weak_components(self) -> DataFrame:
        """(id, component, size): component is the smallest id that can be reached either way. Vertices are numbered, so that
        edges are pairs of numbers. In a round each vertex hooks to the smallest of its neighbours, and edges go on between the
        ends of these hooks, of which there are half as many at most; so only the first rounds have many edges."""
        ids = _cut(self.vertices.groupBy("id").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.monotonically_increasing_id()))
        # Numbers are what is looked up in, by parts that a task holds: edges aren't sorted for it.
        number = lambda end, to: ids.where("id IS NOT NULL").select(F.col("id").alias(end), F.col("k").alias(to)).hint("shuffle_hash")
        numbered = self.edges.where("src != dst").select("src", "dst").join(number("src", "u"), "src").select("u", "dst").join(number("dst", "v"), "dst").select("u", "v")
        rounds = []
        with _written(numbered) as edges:
            while True:
                low = _cut(edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("p")))
                if low.isEmpty():
                    break
                back = low.select(F.col("u").alias("p"), F.col("p").alias("pp"))
                # Hooks go to ever smaller neighbours' neighbours, hence end in two that hook to each other: the smaller one stays.
                hooks = low.join(back, "p").select(F.col("u").alias("k"), F.when(F.col("pp") == F.col("u"), F.least("u", "p")).otherwise(F.col("pp")).alias("to"))
                rounds.append(hooks := _chased(hooks))
                moved = edges.join(hooks.select(F.col("k").alias("u"), F.col("to").alias("a")).hint("shuffle_hash"), "u").select("a", "v")
                moved = moved.join(hooks.select(F.col("k").alias("v"), F.col("to").alias("b")).hint("shuffle_hash"), "v").where("a != b")
                edges = _cut(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        roots = None
        for hooks in reversed(rounds):
            if roots is not None:
                hooks = _cut(hooks.join(roots.select(F.col("k").alias("to"), F.col("to").alias("root")), "to", "left").select("k", F.coalesce("root", "to").alias("to")))
            roots = hooks
        found = _cut(ids.withColumn("root", F.col("k")) if roots is None else ids.join(roots, "k", "left").select("id", "n", F.coalesce("to", "k").alias("root")))
        sizes = _cut(found.groupBy("root").agg(F.min("id").alias("component"), F.sum("n").alias("size")))
        large = sizes.orderBy(F.desc("size"), "root").limit(LARGEST)
        most = found.join(F.broadcast(large), "root")
        rest = found.join(F.broadcast(large.select("root")), "root", "left_anti").join(sizes, "root")
        rows = most.select("id", "component", "size", "n").unionAll(rest.select("id", "component", "size", "n"))
        return rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n")))).select("id", "component", "size").orderBy(F.desc("size"), "component", "id")

    def match(self) -> Pattern:
        return Pattern(self)

    def context(self, start: str, depth: int = 2, relation: str | None = None, budget: int = 50_000) -> dict[str, DataFrame]:
        """What surrounds a vertex for a prompt: its vertices by depth, the edges among them, and both as Markdown, by lines
        (part, line) and as one text. Of the vertices the budget's nearest count, so that the text stays bounded."""
        reached = _cut(self.bfs(start, depth, relation, budget=budget).select("id", "depth").orderBy("depth", "id").limit(budget))
        vertices = self.vertices.join(reached, "id")
        edges = self.edges.join(reached.select(F.col("id").alias("src")), "src", "left_semi").join(reached.select(F.col("id").alias("dst")), "dst", "left_semi")
        lines = vertices.select(F.lit(0).alias("part"), F.concat(F.lit("- **"), "id", F.lit("** ("), "label", F.lit(")")).alias("line"))
        arrows = edges.select(F.lit(1).alias("part"), F.concat(F.lit("- "), "src", F.lit(" -["), "relation", F.lit("]-> "), "dst").alias("line"))
        sorted_lines = F.array_sort(F.collect_list(F.struct("part", "line")))
        both = lines.unionByName(arrows)
        text = both.agg(F.array_join(F.transform(sorted_lines, lambda x: x["line"]), "\n").alias("markdown"))
        return {"vertices": vertices, "edges": edges, "lines": both, "markdown": text}

    def guided(self, hits: DataFrame, depth: int = 2, alpha: float = 0.6, relation: str | None = None) -> DataFrame:
        """hits (id, similarity) to (id, seed_similarity, hop, score): what can be reached from each hit, scored by its
        likeness and distance, each vertex by its best seed."""
        alpha = min(1.0, max(0.0, alpha))
        seeds = _cut(hits.select("id", F.col("similarity").cast("double").alias("similarity")))
        reached = self.bfs(seeds.join(self.vertices.select("id"), "id", "left_semi").select("id"), depth, relation)
        score = alpha * F.col("similarity") + (1 - alpha) / (1.0 + F.col("depth"))
        named = reached.join(seeds.withColumnRenamed("id", "seed"), "seed").withColumn("score", score)
        best = named.groupBy("id").agg(F.max_by(F.struct(F.col("similarity").alias("seed_similarity"), F.col("depth").alias("hop"), "score"), F.struct("score", "seed")).alias("b"))
        return best.select("id", "b.*").join(self.vertices.select("id"), "id", "left_semi")


@dataclass
class Pattern:
    """(source)-[relation]->(target) with conditions on either end, built step by step."""

    graph: Graph
    source: dict = field(default_factory=dict)
    target: dict = field(default_factory=dict)
    rel: str | None = None
    way: str = "out"
    most: int | None = None

    def from_(self, label: str | None = None, **properties) -> Pattern:
        self.source = {"label": label, **properties} if label else properties
        return self

    def to(self, label: str | None = None, **properties) -> Pattern:
        self.target = {"label": label, **properties} if label else properties
        return self

    def relation(self, name: str | None, direction: str = "out") -> Pattern:
        self.rel, self.way = name, direction
        return self

    def limit(self, n: int) -> Pattern:
        self.most = n
        return self

    def rows(self) -> DataFrame:
        """source_id, relation, weight, target_id."""

        def chosen(conditions: dict, name: str) -> DataFrame:
            v = self.graph.vertices
            for k, x in conditions.items():
                v = v.where(F.col(k) == x)
            return v.select(F.col("id").alias(name))

        e = self.graph.along(self.way, self.rel)
        out = e.join(chosen(self.source, "u"), "u", "left_semi").join(chosen(self.target, "v"), "v", "left_semi")
        out = out.select(F.col("u").alias("source_id"), "relation", "weight", F.col("v").alias("target_id"))
        return out if self.most is None else out.orderBy("source_id", "target_id", "relation").limit(self.most)


@dataclass
class VectorGraph:
    """A graph whose vertices have vectors (id, vector)."""

    graph: Graph
    vectors: DataFrame

    def insert(self, more: DataFrame) -> VectorGraph:
        """more: id, label and vector of new vertices, or of known ones to replace."""
        kept = self.vectors.join(more.select("id"), "id", "left_anti")
        return VectorGraph(self.graph.add_vertices(more.drop("vector")), kept.unionByName(more.select("id", "vector")))

    def connect(self, edges: DataFrame) -> VectorGraph:
        return VectorGraph(self.graph.add_edges(edges), self.vectors)

    def delete(self, vertex: str) -> VectorGraph:
        return VectorGraph(self.graph.remove_vertex(vertex), self.vectors.where(F.col("id") != vertex))
