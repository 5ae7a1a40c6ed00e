"""What queries move and hold for a row of their input, and the same results on odd inputs."""

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import cache, graph, text
from tessera.operators.graph import Graph

EDGE = "src string, dst string, relation string, weight double"


def moved(spark, df) -> float:
    """Bytes shuffled and, on the way, spilled while df() is made and read."""
    status = spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() for s in (stages.apply(i) for i in range(stages.size())))

    before = total()
    df().write.format("noop").mode("overwrite").save()
    return total() - before


def dense(spark, edges: int = 400_000) -> Graph:
    """Each of 10,000 buyers has 40 of 1,000 sellers."""
    e = spark.range(edges).select(F.concat(F.lit("c:"), F.expr("id % 10000")).alias("src"), F.concat(F.lit("s:"), F.expr("pmod(xxhash64(id), 1000)")).alias("dst"), F.lit("R").alias("relation"), F.lit(1.0).alias("weight"))
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("label", F.lit("v"))
    return Graph(v.persist(), e.persist())


def test_components_of_odd_graphs(spark):
    rnd = np.random.default_rng(5)
    pairs = [(f"{a:03d}", f"{b:03d}") for a, b in rnd.integers(0, 300, (190, 2))] + [("a", "a"), ("b", "gone"), ("c", "gone"), (None, "d"), ("e", None), ("f", "g"), ("f", "g"), ("g", "f")]
    pairs += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(200)]
    names = [f"{i:03d}" for i in range(300)] + list("abcdefg") + ["g", "b", None, None] + [f"p{i:03d}" for i in range(201)]
    up = {n: n for n in names}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in pairs:
        if a in up and b in up and a is not None and b is not None:
            low, high = sorted((root(a), root(b)))
            up[high] = low
    got = Graph(spark.createDataFrame([(n, "v") for n in names], "id string, label string"), spark.createDataFrame([(*p, "R", 1.0) for p in pairs], EDGE)).weak_components().collect()
    size = {}
    for n in names:
        size[root(n)] = size.get(root(n), 0) + 1
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((n, root(n), size[root(n)])) for n in names)
    assert [-r.size for r in got] == sorted(-r.size for r in got)


def test_components_move_edges_few_times(spark):
    g = dense(spark)
    assert moved(spark, g.weak_components) / 400_000 < 60


def test_components_without_edges(spark):
    g = Graph(spark.createDataFrame([("a", "v"), ("b", "v")], "id string, label string"), spark.createDataFrame([], EDGE))
    assert [tuple(r) for r in g.weak_components().collect()] == [("a", "a", 1), ("b", "b", 1)]


def test_ranks_write_no_links(spark, monkeypatch):
    """Only vertices go to the shared folder, in each round."""
    g, cut, rows = dense(spark, 22_000), graph._cut, []
    monkeypatch.setattr(graph, "_cut", lambda df: rows.append((out := cut(df)).count()) or out)
    g.pagerank(rounds=2)
    assert len(rows) >= 3 and max(rows) == g.vertices.count()


def test_ranks_of_odd_graphs(spark):
    names = ["a", "b", "c", "d", "d", None]
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "c", 1), ("b", "gone", 1), ("gone", "a", 1), (None, "a", 1)]
    own = sorted(set(names), key=str)
    rank, deg = {v: 1 / len(own) for v in own}, {v: sum(n for a, _, n in edges if a == v) for v in own if v}
    for _ in range(7):
        lost = sum(r for v, r in rank.items() if not deg.get(v))
        rank = {v: (0.15 + 0.85 * lost) / len(own) + 0.85 * sum(n * rank[a] / deg[a] for a, b, n in edges if v and b == v and a in deg) for v in own}
    g = Graph(spark.createDataFrame([(v, "v") for v in names], "id string, label string"), spark.createDataFrame([(a, b, "R", 1.0) for a, b, n in edges for _ in range(n)], EDGE))
    got = {r.id: r["rank"] for r in g.pagerank(rounds=7).collect()}
    assert got.keys() == rank.keys() and all(abs(got[v] - rank[v]) < 1e-12 for v in own)


def test_postings_of_odd_rows(spark, monkeypatch):
    rows = [(1, "zeta alpha zeta"), (1, "alpha the beta"), (2, ""), (3, None), (4, "zeta"), (None, "beta beta"), (None, "beta")]
    want = [("alpha", 1, 2, [0, 1]), ("beta", 1, 1, [1]), ("beta", None, 3, [0, 0, 1]), ("zeta", 1, 2, [0, 2]), ("zeta", 4, 1, [0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (text.SHARED, 1):
        monkeypatch.setattr(text, "SHARED", most)
        assert sorted(map(str, (tuple(r) for r in text.postings(df, "doc_id", "text").collect()))) == sorted(map(str, want))


def test_postings_stay_where_rows_are(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(1000))))).alias("text"))
    assert moved(spark, lambda: text.postings(df, "doc_id", "text")) < 500_000


def test_answers_hold_small_matrices():
    rnd = np.random.default_rng(7)
    q, v = rnd.normal(size=(cache.BLOCK, 8)), rnd.normal(size=(6000, 8)).astype("float32")
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    batch = pd.DataFrame({"entry_id": np.arange(6000), "vector": list(v)})
    tracemalloc.start()
    got = cache._meet(iter([batch]), np.arange(cache.BLOCK), q, True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = q @ (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(float).T
    s[np.arange(cache.BLOCK), np.arange(cache.BLOCK)] = -2
    assert most < 30e6 and (got.entry_id.to_numpy(int) == s.argmax(axis=1)).all()
