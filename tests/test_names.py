"""Names, parameters, cursors, indexes that change, and what else statements do beyond the registered queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.catalog import Engine, parse
from tessera.operators import cache, changes, find, vector
from tessera.operators.graph import Graph, VectorGraph
from tessera.plans import nodes as N
from tessera.plans.lexer import ParseError
from tessera.streaming import feeds


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.register("orders", spark.createDataFrame([(1, 2, 10.0, "$1"), (2, 1, 5.0, "b"), (3, None, 7.0, "c")], "id long, user_id long, amount double, note string"), "id")
    return e.register("users", spark.createDataFrame([(1, "ann", 9.0), (2, "bob", 1.0)], "id long, name string, bal double"), "id")


def test_qualified_names_stand_for_their_own_table(engine):
    assert rows(engine.query("SELECT orders.id, name FROM orders JOIN users ON orders.user_id = users.id WHERE users.id = 1")) == [(2, "ann")]
    got = engine.query("SELECT orders.id, users.id FROM orders JOIN users ON orders.user_id = users.id")
    assert got.columns == ["id", "users_id"] and rows(got) == [(1, 2), (2, 1)]
    assert rows(engine.query("SELECT o.id AS k, u.id AS u FROM orders o JOIN users u ON u.id = o.user_id WHERE u.bal > 5")) == [(2, 1)]
    assert rows(engine.query("SELECT o.id FROM orders o LEFT JOIN users u ON o.user_id = u.id WHERE u.id IS NULL")) == [(3,)]
    assert engine.query("SELECT u.* FROM orders o JOIN users u ON o.user_id = u.id").columns == ["users_id", "users_name", "users_bal"]


@pytest.mark.parametrize("text", ["SELECT x.id FROM orders o JOIN users u ON o.user_id = u.id", "SELECT o.id FROM orders o JOIN users u ON o.user_id = u.id WHERE users.id = 1", "SELECT nothing FROM orders", "SELECT id FROM orders ORDER BY nothing"])
def test_unknown_names_are_errors(engine, text):
    with pytest.raises(KeyError):
        engine.query(text)


def test_parameters_are_values(engine):
    bad = " OR 1=1 OR name = "
    assert engine.query("SELECT id FROM users WHERE name = $2", [bad, "$1"]).count() == 0
    assert rows(engine.query("SELECT id FROM orders WHERE note = '$1'", ["x"])) == [(1,)]
    assert rows(engine.query("SELECT id FROM orders WHERE id IN ($1, $2) AND amount >= $3 ORDER BY id LIMIT $4", [1, 2, 5.0, 1])) == [(1,)]
    assert rows(engine.query('db.orders.find({"note": $1, "id": {"$gte": $2}})', ["b", 1]).select("id")) == [(2,)]
    assert rows(engine.query('db.orders.find({"note": "$1"})', ["b"]).select("id")) == [(1,)]
    engine.query("INSERT INTO users (id, name) VALUES ($1, $2)", [9, "x'); DROP"])
    assert rows(engine.query("SELECT name FROM users WHERE id = 9")) == [("x'); DROP",)]
    with pytest.raises(ParseError):
        engine.query("SELECT id FROM users WHERE name = $3", ["a"])
    assert parse("SELECT id FROM t WHERE a = $1", ["b"]).where == N.Leaf("eq", "a", "b")


def test_cursors(engine):
    cursor, first = engine.open_cursor("orders", batch=2)
    assert [r.id for r in first.collect()] == [1, 2] and [r.id for r in engine.get_more(cursor).collect()] == [3]
    assert engine.get_more(cursor).count() == 0 and engine.kill_cursors(cursor) == 1
    with pytest.raises(KeyError):
        engine.get_more(cursor)
    engine.open_cursor("orders")
    assert engine.kill_cursors(idle=0.0) == 1


def test_catalog_statements(engine):
    assert rows(engine.query("SHOW TABLES")) == [("orders", "id"), ("users", "id")]
    assert ("name", "string") in rows(engine.query("DESCRIBE users")) and engine.query("SELECT version(), current_database() AS db").columns == ["version", "db"]
    assert engine.query("SELECT column_name FROM information_schema.columns WHERE table_name = 'users'").count() == 3
    assert engine.database_stats().first()["collections"] == 2


def test_unique_over_several_fields(engine):
    engine.query("CREATE UNIQUE INDEX both ON users (name, bal)")
    engine.query("INSERT INTO users (id, name, bal) VALUES (5, 'ann', 8.0)")
    with pytest.raises(changes.Conflict):
        engine.query("INSERT INTO users (id, name, bal) VALUES (6, 'bob', 1.0)")


def test_put_needs_its_row_and_increments_their_base(engine, spark):
    engine.put("users", 77, {"name": "new"})
    assert engine.count("users") == 2
    df = spark.createDataFrame([("c", "1", "x")], "collection string, doc_id string, payload string")
    with pytest.raises(changes.Conflict):
        changes.apply_increment(df, df, df, base_id="b1", made_for="b0")
    with pytest.raises(KeyError):
        find.project(engine.table("users"), ["id", "none"])


def test_long_paths(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}", "R", 1.0) for i in range(60)], "src string, dst string, relation string, weight double")
    g = Graph(spark.createDataFrame([(f"{i:03d}", "v") for i in range(61)], "id string, label string"), edges)
    assert g.shortest_path("000", "060").first()["cost"] == 60.0
    hub = VectorGraph(g, spark.createDataFrame([("000", [1.0])], "id string, vector array<double>")).insert(spark.createDataFrame([("z", "v", [2.0])], "id string, label string, vector array<double>"))
    assert hub.delete("000").vectors.count() == 1 and hub.delete("000").graph.edges.count() == 59 and hub.graph.vertices.count() == 62


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_recall_of_inverted_lists(spark, tmp_path, metric):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    odd = df.unionByName(spark.createDataFrame([(10**9, None, 0), (10**9 + 1, [1.0, 2.0], 0)], "vec_id long, embedding array<float>, label int").select(*df.columns))
    index = vector.InvertedLists(odd, lists=32, metric=metric)
    index.save(str(tmp_path / "index"))
    index = vector.InvertedLists.load(spark, str(tmp_path / "index"))
    asked = [r.embedding for r in df.where("vec_id % 20 = 0").orderBy("vec_id").limit(8).collect()]
    hit = sum(len({r.vec_id for r in index.search(q, 10, 24).collect()} & {r.vec_id for r in vector.knn(df, q, 10, metric=metric).collect()}) for q in asked)
    assert hit >= 72  # 24 of 32 lists: these vectors have no clusters


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_registered_index(spark, sf):
    """The index as knn_inverted_lists builds and searches it, over every vector whose id is divisible by 20."""
    index = vector.InvertedLists(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"))
    rows = index.table.select("vec_id", "embedding", "list").toPandas()
    x = np.stack(rows.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.flatnonzero(rows.vec_id.to_numpy() % 20 == 0)
    best = np.argsort(-(x[asked] @ x.T), axis=1)[:, :10]
    lists = np.argsort(-(x[asked] @ index.centroids.T), axis=1)[:, : vector.PROBES]
    assert np.mean([np.isin(rows.list.to_numpy()[b], own).mean() for b, own in zip(best, lists, strict=True)]) >= 0.9
    found = {r.vec_id for r in index.search(x[asked[0]], 10).collect()}
    assert found == set(rows.vec_id.to_numpy()[[b for b in np.argsort(-(x[asked[0]] @ x.T)) if rows.list[b] in lists[0]][:10]].tolist())


def test_answers_in_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(90, 4)).astype("float32")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(90, None), (91, [1.0])], "entry_id long, vector array<float>").withColumn("expire_at", F.lit(None).cast("timestamp"))
    asked = df.select(F.col("entry_id").alias("query_id"), "vector").where("entry_id % 2 = 0")
    want = {(r.query_id, r.entry_id) for r in cache.nearest_answers(df, asked, 0.5, others=True).collect()}
    monkeypatch.setattr(cache, "BLOCK", 7)
    assert {(r.query_id, r.entry_id) for r in cache.nearest_answers(df, asked, 0.5, others=True).collect()} == want
    e = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = e @ e.T
    np.fill_diagonal(s, -2)
    assert want == {(i, int(s[i].argmax())) for i in range(0, 90, 2) if s[i].max() >= 0.5}


def test_dispatch_counts(spark, tmp_path):
    spark.createDataFrame([("1", "users", "insert")], "resume_token string, collection string, operation_type string").write.json(str(tmp_path / "feed"))
    counts, tries = feeds.Deliveries(), []

    def deliver(batch, number):
        tries.append(number)
        if len(tries) == 1:
            raise OSError("once")

    feeds.dispatch(feeds.read_feed(spark, str(tmp_path / "feed")), deliver, str(tmp_path / "ck"), interval=None, counts=counts).start().awaitTermination(60)
    assert (counts.delivered, counts.failed, counts.batches) == (1, 1, 1)
