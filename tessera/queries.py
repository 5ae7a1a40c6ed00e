"""The engine's own queries, each with the same result in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import Engine
from tessera.functions.scalars import hash_slot, tokens
from tessera.operators import cache, changes, statistics, text, vector
from tessera.operators.graph import Graph, checkpoint_folder
from tessera.plans import nodes as N
from tessera.plans.pipeline import run_pipeline
from tessera.sources import files
from tessera.streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey",
    "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id",
}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Lazy(Engine):
    """An engine whose collections are the tables of a folder, read when they are named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark)
        self.sf_dir = sf_dir
        for name, key in KEYS.items():
            self.register(name, None, key)

    def load(self, *names: str) -> Engine:
        for n in names:
            self.collections[n].df = self.spark.read.parquet(f"{self.sf_dir}/{n}.parquet")
        return self


def engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    return Lazy(spark, sf_dir).load(*names)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statement(name: str, tables: tuple[str, ...], text_: str, sql: str) -> None:
    """A query that is one statement in a front-end."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, *tables).query(text_)
    ORACLES[name] = sql


# Predicates, through the SQL and Mongo front-ends.

_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
statement("flt_eq", ("orders",), f"SELECT {_O} FROM orders WHERE o_orderstatus = 'F'", f"SELECT {_O} FROM orders WHERE o_orderstatus = 'F'")
statement("flt_literal_left", ("orders",), f"SELECT {_O} FROM orders WHERE 100000 <= o_totalprice AND 1=1", f"SELECT {_O} FROM orders WHERE o_totalprice >= 100000")
statement("flt_range", ("orders",), f"SELECT {_O} FROM orders WHERE o_totalprice > 50000 AND o_totalprice <= 150000.5 AND o_custkey < 700 AND o_custkey >= 10", f"SELECT {_O} FROM orders WHERE o_totalprice > 50000 AND o_totalprice <= 150000.5 AND o_custkey < 700 AND o_custkey >= 10")
statement("flt_between", ("part",), "FIND part WHERE p_size BETWEEN 5 AND 12", "SELECT * FROM part WHERE p_size BETWEEN 5 AND 12")
statement("flt_not_between", ("part",), "FIND part WHERE p_size NOT BETWEEN 5 AND 45", "SELECT * FROM part WHERE p_size NOT BETWEEN 5 AND 45")
statement("flt_in", ("orders",), f"SELECT {_O} FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')", f"SELECT {_O} FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
statement("flt_like_ci", ("part",), "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%A_L WID%T'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A_L WID%T'")
statement("flt_prefix_suffix", ("customer",), "SELECT c_custkey, c_name FROM customer WHERE c_name STARTS_WITH 'Customer' AND c_name ENDS_WITH '7'", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer') AND ends_with(c_name, '7')")
statement("flt_contains", ("part",), "db.part.find({\"p_type\": {\"$contains\": \"A\"}})", "SELECT * FROM part WHERE contains(p_type, 'A')")
statement("flt_nested_bool", ("part",), "SELECT p_partkey, p_size FROM part WHERE (p_size < 10 OR p_size > 40) AND NOT (p_retailprice >= 1000 AND p_size = 3)", "SELECT p_partkey, p_size FROM part WHERE (p_size < 10 OR p_size > 40) AND NOT (p_retailprice >= 1000 AND p_size = 3)")
statement("flt_nested_path", ("events",), "SELECT event_id, user_id FROM events WHERE props.k > 50", "SELECT event_id, user_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) > 50")
statement("flt_mongo", ("orders",), "db.orders.find({\"o_totalprice\": {\"$gte\": 200000}, \"$or\": [{\"o_orderstatus\": \"O\"}, {\"o_custkey\": {\"$in\": [1, 2, 3]}}]}).sort({\"o_totalprice\": -1})", "SELECT * FROM orders WHERE o_totalprice >= 200000 AND (o_orderstatus = 'O' OR o_custkey IN (1, 2, 3))")


def _blanked(spark: SparkSession, sf_dir: str) -> Engine:
    """Events whose type is missing where it is an error."""
    e = engine(spark, sf_dir, "events")
    return e.register("events", e.table("events").select("event_id", F.expr("nullif(event_type, 'error')").alias("kind"), "value"), "event_id")


_BLANK = "(SELECT event_id, nullif(event_type, 'error') AS kind, value FROM events)"


@query(f"SELECT event_id, kind FROM {_BLANK} WHERE kind IS NULL OR kind <> 'click'")
def flt_neq_null(spark, sf_dir):
    return _blanked(spark, sf_dir).query("SELECT event_id, kind FROM events WHERE kind <> 'click'")


@query(f"SELECT event_id FROM {_BLANK} WHERE kind IS NULL")
def flt_null(spark, sf_dir):
    return _blanked(spark, sf_dir).query("SELECT event_id FROM events WHERE kind IS NULL")


@query(f"SELECT event_id, kind FROM {_BLANK} WHERE kind IS NOT NULL")
def flt_not_null(spark, sf_dir):
    return _blanked(spark, sf_dir).query("SELECT event_id, kind FROM events WHERE kind IS NOT NULL")


@query(f"SELECT event_id, kind FROM {_BLANK} WHERE NOT (coalesce(kind = 'view', false) AND value > 10)")
def flt_not_two_valued(spark, sf_dir):
    return _blanked(spark, sf_dir).query("SELECT event_id, kind FROM events WHERE NOT (kind = 'view' AND value > 10)")


# Joins.

statement("join_inner", ("orders", "customer"), "SELECT o_orderkey, c_name, customer_c_custkey FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE o_totalprice > 100000", "SELECT o_orderkey, c_name, c_custkey AS customer_c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
statement("join_left", ("customer", "orders"), "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON customer.c_custkey = orders.o_custkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
statement("join_chain", ("customer", "nation", "region"), "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON customer.c_nationkey = nation.n_nationkey JOIN region ON nation.n_regionkey = region.r_regionkey", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
statement("join_where_right", ("orders", "customer"), "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE customer.c_acctbal > 5000 AND o_orderstatus = 'O'", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND o_orderstatus = 'O'")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def lookup_array(spark, sf_dir):
    df = engine(spark, sf_dir, "customer", "orders").aggregate("customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}}])
    total = F.aggregate("orders", F.lit(0.0), lambda s, o: s + o["o_totalprice"])
    return df.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), F.round(total, 2).alias("total"))


# Aggregation pipelines.


@query("SELECT l_returnflag AS _id, round(sum(l_extendedprice), 2) AS revenue, round(avg(l_discount) * 100) / 100 AS avg_discount, count(*) AS n FROM lineitem WHERE l_quantity >= 10 GROUP BY 1")
def grp_sum_avg_count(spark, sf_dir):
    stages = [{"$match": {"l_quantity": {"$gte": 10}}}, {"$group": {"_id": "$l_returnflag", "revenue": {"$sum": "$l_extendedprice"}, "avg_discount": {"$avg": "$l_discount"}, "n": {"$sum": 1}}}, {"$sort": {"revenue": -1}}]
    return engine(spark, sf_dir, "lineitem").aggregate("lineitem", stages).withColumn("revenue", F.round("revenue", 2))


@query("SELECT event_type AS _id, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events GROUP BY 1")
def grp_min_max(spark, sf_dir):
    return engine(spark, sf_dir, "events").aggregate("events", [{"$group": {"_id": "$event_type", "lo": {"$min": "$value"}, "hi": {"$max": "$value"}, "n": {"$count": {}}}}])


@query("SELECT CAST(NULL AS VARCHAR) AS _id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders")
def grp_all_null(spark, sf_dir):
    return engine(spark, sf_dir, "orders").aggregate("orders", [{"$group": {"_id": None, "n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}}}]).withColumn("total", F.round("total", 2))


@query("SELECT user_id AS _id, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY 1")
def grp_push_sorted(spark, sf_dir):
    df = engine(spark, sf_dir, "events").aggregate("events", [{"$sort": {"event_id": 1}}, {"$group": {"_id": "$user_id", "types": {"$push": "$event_type"}}}])
    return df.select("_id", F.array_join("types", ",").alias("types"))


@query("SELECT user_id AS _id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1")
def grp_first_last(spark, sf_dir):
    return engine(spark, sf_dir, "events").aggregate("events", [{"$sort": {"event_id": 1}}, {"$group": {"_id": "$user_id", "first_type": {"$first": "$event_type"}, "last_type": {"$last": "$event_type"}}}])


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity < 5")
def stage_count(spark, sf_dir):
    return engine(spark, sf_dir, "lineitem").aggregate("lineitem", '[{"$match": {"l_quantity": {"$lt": 5}}}, {"$count": "n"}]')


statement("count_filter", ("orders",), "SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F'", "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
statement("count_mongo", ("events",), "db.events.count({\"event_type\": \"purchase\"})", "SELECT count(*) AS count FROM events WHERE event_type = 'purchase'")
statement("distinct_field", ("part",), "SELECT DISTINCT p_brand FROM part", "SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL")
statement("distinct_mongo", ("events",), "db.events.distinct(\"user_id\", {\"event_type\": \"signup\"})", "SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'")

# Sort, limits, projection, arrays.

statement("sort_multi", ("part",), "SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_brand ASC, p_retailprice DESC, p_partkey LIMIT 200", "SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_brand ASC NULLS FIRST, p_retailprice DESC NULLS LAST, p_partkey LIMIT 200")
statement("topk", ("orders",), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
statement("skip_limit", ("orders",), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 100", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 100")


@query("SELECT p_partkey, p_name FROM part")
def project_inc(spark, sf_dir):
    return engine(spark, sf_dir, "part").aggregate("part", [{"$project": {"p_partkey": 1, "p_name": 1}}])


@query("SELECT * EXCLUDE (p_type, p_name) FROM part")
def project_exc(spark, sf_dir):
    return engine(spark, sf_dir, "part").aggregate("part", [{"$project": {"p_type": 0, "p_name": 0}}])


_WORDS = "SELECT doc_id, string_split(text, ' ') AS ws FROM documents"


def _worded(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))


@query(f"SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM ({_WORDS})) GROUP BY 1")
def unwind(spark, sf_dir):
    return run_pipeline(_worded(spark, sf_dir), [{"$unwind": "$w"}, {"$group": {"_id": "$w", "n": {"$sum": 1}}}]).withColumnRenamed("_id", "w")


@query(f"SELECT doc_id, greatest(coalesce(len(ws), 0), 1) AS n FROM ({_WORDS})")
def unwind_preserve(spark, sf_dir):
    return run_pipeline(_worded(spark, sf_dir), [{"$unwind": {"path": "$w", "preserveNullAndEmptyArrays": True}}, {"$group": {"_id": "$doc_id", "n": {"$sum": 1}}}]).withColumnRenamed("_id", "doc_id")


# Vectors: the query is a fixed one of 64 places.

_Q = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_QS = "[" + ", ".join(map(str, _Q)) + "]::DOUBLE[]"


def _top(distance: str, where: str = "true") -> str:
    return f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, label, {distance} AS d FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) WHERE {where}) ORDER BY d, vec_id LIMIT 10"


def _knn(metric: str):
    def run(spark, sf_dir):
        return vector.knn(read(spark, sf_dir, "embeddings"), _Q, 10, metric=metric).select("vec_id", F.round("distance", 6).alias("distance"))

    return run


for _name, _metric, _sql in (
    ("knn_cosine", "cosine", f"list_cosine_distance(e, {_QS})"), ("knn_l2", "euclidean", f"list_distance(e, {_QS})"), ("knn_dot", "dot", f"-list_inner_product(e, {_QS})"),
    ("knn_l1", "manhattan", f"list_sum(list_transform(range(1, 65), lambda i: abs(e[i] - ({_QS})[i])))"), ("knn_squared", "squared", f"pow(list_distance(e, {_QS}), 2)"),
):
    QUERIES[_name], ORACLES[_name] = _knn(_metric), _top(_sql)


@query(_top(f"list_cosine_distance(e, {_QS})", "label IN (1, 3)"))
def knn_filtered(spark, sf_dir):
    e = engine(spark, sf_dir, "embeddings")
    e.create_vector_index("emb", "embeddings", "embedding")
    return e.query(f"SELECT vec_id, distance FROM embeddings WHERE label IN (1, 3) VECTOR NEAR {_Q} TOP 10 USING INDEX emb").withColumn("distance", F.round("distance", 6))


@query(_top(f"list_cosine_distance(e, {_QS})", "vec_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 7 = 3)"))
def knn_bitset(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings")
    return vector.knn(vector.restricted(df, df.where("vec_id % 7 = 3")), _Q).select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT vec_id, round(list_cosine_similarity(e, e), 6) AS self, round(sqrt(list_inner_product(e, e)), 5) AS length FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def vector_norm(spark, sf_dir):
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.similarity(vector.distance(e, e)), 6).alias("self"), F.round(vector.norm(e), 5).alias("length"))


#: Vectors as places between their least and greatest value, in 255 steps.
_SQ8 = """q AS (SELECT vec_id, list_min(e) AS lo, (list_max(e) - list_min(e)) / 255 AS s, list_transform(e, lambda x: least(255, greatest(0, floor((x - list_min(e)) / ((list_max(e) - list_min(e)) / 255) + 0.5::DOUBLE)))::INT) AS codes
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))"""


@query(f"WITH {_SQ8} SELECT vec_id, round(lo, 6) AS low, round(s, 8) AS scale, array_to_string(codes, ',') AS codes FROM q")
def sq8_codes(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings").withColumn("q", vector.sq8(F.col("embedding")))
    return df.select("vec_id", F.round("q.low", 6).alias("low"), F.round("q.scale", 8).alias("scale"), F.array_join(F.col("q.codes").cast("array<string>"), ",").alias("codes"))


@query(f"WITH {_SQ8}, d AS (SELECT vec_id, list_distance(list_transform(codes, lambda c: c * s + lo), {_QS}) AS d FROM q) SELECT vec_id, round(d, 6) AS distance FROM d ORDER BY d, vec_id LIMIT 10")
def sq8_knn(spark, sf_dir):
    d = vector.quantised_distance(vector.sq8(F.col("embedding")), vector.vector(_Q), "euclidean")
    return read(spark, sf_dir, "embeddings").select("vec_id", d.alias("d")).orderBy("d", "vec_id").limit(10).select("vec_id", F.round("d", 6).alias("distance"))


@query(f"SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (e[i] > 0) <> (({_QS})[i] > 0) THEN 1 ELSE 0 END)) / 64.0::DOUBLE, 6) AS share FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def hamming_share(spark, sf_dir):
    d = vector.hamming_share(vector.binary_codes(F.col("embedding")), vector.binary_codes(vector.vector(_Q)), 64)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(d, 6).alias("share"))


@query("SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))), 5) AS total, 1.0::DOUBLE AS length FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def unit_vectors(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings").select("vec_id", vector.normalised(F.col("embedding")).alias("u"))
    return df.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(vector.norm(F.col("u")), 6).alias("length"))


@query(_top(f"list_cosine_distance(e, {_QS})", "vec_id % 5 <> 0"))
def index_changes(spark, sf_dir):
    """Rows taken out of an index and put back in, others deleted; all lists are probed, so the result is exact."""
    df = read(spark, sf_dir, "embeddings")
    index = vector.InvertedLists(df.where("vec_id % 3 <> 0"), lists=16)
    index.insert(df.where("vec_id % 3 = 0 OR vec_id % 7 = 0")).delete(df.where("vec_id % 5 = 0"))
    return index.search(_Q, 10, 16).select("vec_id", F.round("distance", 6).alias("distance"))


@query(_top(f"list_cosine_distance(e, {_QS})"))
def knn_by_index(spark, sf_dir):
    """VECTOR NEAR through inverted lists; all are probed, so the result is exact."""
    e = engine(spark, sf_dir, "embeddings")
    e.create_vector_index("emb", "embeddings", "embedding", lists=16, probes=16)
    return e.query(f"SELECT vec_id, distance FROM embeddings VECTOR NEAR {_Q} TOP 10 USING INDEX emb").withColumn("distance", F.round("distance", 6))


@query(f"SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (e[i] > 0) <> (({_QS})[i] > 0) THEN 1 ELSE 0 END))::BIGINT AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) ORDER BY 2, 1 LIMIT 10")
def hamming_topk(spark, sf_dir):
    d = vector.hamming(vector.binary_codes(F.col("embedding")), vector.binary_codes(vector.vector(_Q)))
    return read(spark, sf_dir, "embeddings").select("vec_id", d.alias("distance")).orderBy("distance", "vec_id").limit(10)


@query("""SELECT q.vec_id AS query_id, arg_max(c.vec_id, struct_pack(s := list_cosine_similarity(q.e, c.e), i := -c.vec_id)) AS entry_id
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) c WHERE c.vec_id <> q.vec_id
GROUP BY 1 HAVING max(list_cosine_similarity(q.e, c.e)) >= 0.3""")
def semcache_lookup(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings")
    entries = df.select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vector"), F.lit(None).cast("timestamp").alias("expire_at"))
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return cache.nearest_answers(entries, asked, 0.3, others=True).select("query_id", "entry_id")


@query()
def knn_inverted_lists(spark, sf_dir):
    return vector.InvertedLists(read(spark, sf_dir, "embeddings")).search(_Q, 10).select("vec_id", F.round("distance", 6).alias("distance"))


# Text.

_STOP = "['" + "','".join(text.STOP_WORDS) + "']"
_TERMS = rf"SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: strlen(w) > 1 AND NOT list_contains({_STOP}, w)) AS ts FROM documents"


def _bm25_sql(terms: dict[str, int]) -> str:
    values = ", ".join(f"('{t}', {n})" for t, n in terms.items())
    return f"""WITH d AS (SELECT doc_id, ts, len(ts) AS dl FROM ({_TERMS}) WHERE len(ts) > 0), p AS (SELECT doc_id, dl, unnest(ts) AS term FROM d),
q(term, times) AS (VALUES {values}), tf AS (SELECT p.term, doc_id, any_value(dl) AS dl, any_value(times) AS times, count(*)::DOUBLE AS tf FROM p JOIN q USING (term) GROUP BY 1, 2),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1), s AS (SELECT count(*)::DOUBLE AS n, greatest(1.0, avg(dl)) AS a FROM d)
SELECT doc_id, round(sum(greatest(0.1::DOUBLE, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a)) * times) * 100) / 100 AS score, string_agg(term, ',' ORDER BY term) AS terms
FROM tf JOIN df USING (term), s GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20"""


@query(_bm25_sql({"tion": 1, "thing": 2, "license": 1}))
def bm25_topk(spark, sf_dir):
    return text.bm25(read(spark, sf_dir, "documents"), "Tion, thing thing of the license", 20).select("doc_id", "score", F.array_join("matched_terms", ",").alias("terms"))


@query(_bm25_sql({"license": 1}))
def search_documents(spark, sf_dir):
    found = engine(spark, sf_dir, "documents").search("documents", "license", 20, column="text")
    return found.select("doc_id", F.col("_score").alias("score"), F.array_join("_matched_terms", ",").alias("terms"))


def _fuzzy_sql(terms: dict[str, int]) -> str:
    values = ", ".join(f"('{t}', {n})" for t, n in terms.items())
    return f"""WITH d AS (SELECT doc_id, ts, len(ts) AS dl FROM ({_TERMS}) WHERE len(ts) > 0), p AS (SELECT doc_id, dl, unnest(ts) AS term FROM d),
q(q, times) AS (VALUES {values}), k AS (SELECT DISTINCT term FROM p), w AS (SELECT term, sum(times * CASE WHEN term = q THEN 1.0::DOUBLE WHEN levenshtein(q, term) = 1 THEN 0.75::DOUBLE WHEN levenshtein(q, term) = 2 AND strlen(q) >= 5 THEN 0.5::DOUBLE ELSE 0 END) AS weight FROM k, q GROUP BY 1 HAVING weight > 0),
tf AS (SELECT p.term, doc_id, any_value(dl) AS dl, any_value(weight) AS weight, count(*)::DOUBLE AS tf FROM p JOIN w USING (term) GROUP BY 1, 2),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1), s AS (SELECT count(*)::DOUBLE AS n, greatest(1.0, avg(dl)) AS a FROM d)
SELECT doc_id, round(sum(greatest(0.1::DOUBLE, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a)) * weight) * 100) / 100 AS score, string_agg(term, ',' ORDER BY term) AS terms
FROM tf JOIN df USING (term), s GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20"""


@query(_fuzzy_sql({"licence": 1, "realeased": 1}))
def bm25_fuzzy(spark, sf_dir):
    return text.bm25(read(spark, sf_dir, "documents"), "licence realeased", 20, fuzzy=True).select("doc_id", "score", F.array_join("matched_terms", ",").alias("terms"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM (SELECT doc_id, unnest(ts) AS term FROM ({_TERMS})) GROUP BY 1")
def token_df(spark, sf_dir):
    return text.postings(read(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(F.count("key").alias("df"), F.sum("tf").alias("n"))


@query(f"SELECT term, doc_id AS key, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM (SELECT doc_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM ({_TERMS})) GROUP BY 1, 2")
def inverted_index(spark, sf_dir):
    return text.postings(read(spark, sf_dir, "documents"), "doc_id", "text").select("term", "key", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


# Graphs: customers, suppliers, nations and regions, who buys from whom and where they are.

_GRAPH = """v AS (SELECT 'c:' || c_custkey AS id, 'customer' AS label FROM customer UNION ALL SELECT 's:' || s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'r:' || r_regionkey, 'region' FROM region),
e AS (SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst, 'LIVES_IN' AS relation, 1.0::DOUBLE AS weight FROM customer UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'BASED_IN', 1.0 FROM supplier
UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'PART_OF', 1.0 FROM nation
UNION ALL SELECT 'c:' || o_custkey, 's:' || l_suppkey, 'BOUGHT_FROM', count(*)::DOUBLE FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def graph(spark: SparkSession, sf_dir: str, weighted: bool = True) -> Graph:
    """Not weighted: an edge for each line that was bought, of weight 1, for what asks only who is linked."""
    t = lambda n: read(spark, sf_dir, n)
    ident = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    labels = (("c:", "c_custkey", "customer"), ("s:", "s_suppkey", "supplier"), ("n:", "n_nationkey", "nation"), ("r:", "r_regionkey", "region"))
    vertices = None
    for prefix, key, name in labels:
        part = t(name).select(ident(prefix, key).alias("id"), F.lit(name).alias("label"))
        vertices = part if vertices is None else vertices.unionByName(part)
    one = F.lit(1.0).alias("weight")
    bought = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    bought = bought.groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("weight")) if weighted else bought.withColumn("weight", F.lit(1.0))
    bought = bought.select(ident("c:", "o_custkey").alias("src"), ident("s:", "l_suppkey").alias("dst"), "weight")
    edges = t("customer").select(ident("c:", "c_custkey").alias("src"), ident("n:", "c_nationkey").alias("dst"), F.lit("LIVES_IN").alias("relation"), one)
    edges = edges.unionByName(t("supplier").select(ident("s:", "s_suppkey").alias("src"), ident("n:", "s_nationkey").alias("dst"), F.lit("BASED_IN").alias("relation"), one))
    edges = edges.unionByName(t("nation").select(ident("n:", "n_nationkey").alias("src"), ident("r:", "n_regionkey").alias("dst"), F.lit("PART_OF").alias("relation"), one))
    return Graph(vertices, edges.unionByName(bought.select("src", "dst", F.lit("BOUGHT_FROM").alias("relation"), "weight")))


_REACH = """r(id, depth) AS (SELECT 'c:7', 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.id WHERE depth < 3)"""


@query(f"WITH RECURSIVE {_GRAPH}, {_REACH} SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def bfs_depth(spark, sf_dir):
    return graph(spark, sf_dir).bfs("c:7", 3).select("id", "depth")


@query(f"WITH {_GRAPH} SELECT DISTINCT id FROM (SELECT dst AS id FROM e WHERE src = 'c:7' UNION SELECT b.dst FROM e a JOIN e b ON b.src = a.dst WHERE a.src = 'c:7') WHERE id <> 'c:7'")
def khop(spark, sf_dir):
    return graph(spark, sf_dir).k_hop("c:7", 2)


@query(f"""WITH {_GRAPH}, p AS (SELECT 'c:7,' || a.dst || ',' || b.dst AS path FROM e a JOIN e b ON b.src = a.dst WHERE a.src = 'c:7' AND b.dst LIKE 'r:%' AND b.dst = (SELECT min(b2.dst) FROM e a2 JOIN e b2 ON b2.src = a2.dst WHERE a2.src = 'c:7' AND b2.dst LIKE 'r:%'))
SELECT min(path) AS path, 2.0::DOUBLE AS cost FROM p""")
def shortest_path(spark, sf_dir):
    g = graph(spark, sf_dir)
    goal = g.along().where("u = 'c:7'").select(F.col("v").alias("m")).join(g.along(), F.col("m") == F.col("u")).where("v LIKE 'r:%'").agg(F.min("v")).first()[0]
    return g.shortest_path("c:7", goal).select(F.array_join("path", ",").alias("path"), "cost")


@query(f"""WITH RECURSIVE {_GRAPH}, m AS (SELECT src, dst, min(greatest(weight, 0)) AS w FROM e GROUP BY 1, 2), r(id, cost, d) AS (SELECT 'c:7', 0.0::DOUBLE, 0 UNION SELECT m.dst, cost + m.w, d + 1 FROM r JOIN m ON m.src = r.id WHERE d < 5)
SELECT id, min(cost) AS cost FROM r GROUP BY 1""")
def dijkstra(spark, sf_dir):
    return graph(spark, sf_dir).costs("c:7").select("id", "cost")


def _rank_sql(rounds: int) -> str:
    parts = [f"WITH {_GRAPH}, n AS (SELECT count(*)::DOUBLE AS n FROM v), o AS (SELECT src, count(*)::DOUBLE AS deg FROM e GROUP BY 1), r0 AS (SELECT id, 1 / n AS rank FROM v, n)"]
    for i in range(rounds):
        parts.append(f"""r{i + 1} AS (SELECT v.id, 0.15 / n + 0.85::DOUBLE * d / n + 0.85::DOUBLE * coalesce(s, 0) AS rank FROM v CROSS JOIN n CROSS JOIN (SELECT coalesce(sum(rank), 0) AS d FROM r{i} WHERE id NOT IN (SELECT src FROM o)) x
        LEFT JOIN (SELECT dst, sum(rank / deg) AS s FROM e JOIN r{i} ON r{i}.id = e.src JOIN o ON o.src = e.src GROUP BY 1) y ON y.dst = v.id)""")
    return ", ".join(parts) + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query(_rank_sql(5))
def pagerank(spark, sf_dir):
    return graph(spark, sf_dir).pagerank(rounds=5).select("id", F.round("rank", 9).alias("rank"))


def _wcc_sql(rounds: int) -> str:
    """Labels travel along all edges so many times; more than any shortest path in this graph is long."""
    parts = [f"WITH {_GRAPH}, b AS (SELECT src AS u, dst AS v FROM e UNION SELECT dst, src FROM e), l0 AS (SELECT id, id AS c FROM v)"]
    for i in range(rounds):
        parts.append(f"l{i + 1} AS MATERIALIZED (SELECT l.id, least(l.c, coalesce(m.c, l.c)) AS c FROM l{i} l LEFT JOIN (SELECT u, min(c) AS c FROM b JOIN l{i} x ON x.id = b.v GROUP BY 1) m ON m.u = l.id)")
    return ", ".join(parts) + f" SELECT id, c AS component, count(*) OVER (PARTITION BY c) AS size FROM l{rounds}"


@query(_wcc_sql(12))
def wcc(spark, sf_dir):
    return graph(spark, sf_dir, weighted=False).weak_components()


@query(f"WITH {_GRAPH} SELECT id, coalesce(i, 0)::BIGINT AS in_degree, coalesce(o, 0)::BIGINT AS out_degree, (coalesce(i, 0) + coalesce(o, 0))::BIGINT AS total_degree FROM v LEFT JOIN (SELECT dst AS id, count(*) AS i FROM e GROUP BY 1) USING (id) LEFT JOIN (SELECT src AS id, count(*) AS o FROM e GROUP BY 1) USING (id)")
def degree(spark, sf_dir):
    return graph(spark, sf_dir).degrees()


@query(f"WITH {_GRAPH} SELECT src AS source_id, relation, weight, dst AS target_id FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE a.label = 'customer' AND b.label = 'supplier' AND relation = 'BOUGHT_FROM' AND dst = 's:3'")
def pattern_match(spark, sf_dir):
    return graph(spark, sf_dir).match().from_("customer").relation("BOUGHT_FROM").to("supplier", id="s:3").rows()


@query(f"WITH {_GRAPH} SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM e) AS edges")
def graph_counts(spark, sf_dir):
    return graph(spark, sf_dir).counts()


@query(f"WITH {_GRAPH} SELECT dst AS v, relation FROM e WHERE src = 'c:7' UNION ALL SELECT src, relation FROM e WHERE dst = 'c:7'")
def edges_both(spark, sf_dir):
    return graph(spark, sf_dir).edges_of("c:7", "both").select("v", "relation")


def _rows_graph(spark, sf_dir) -> Engine:
    """Embeddings as vertices, each with an edge to the two after it."""
    e = engine(spark, sf_dir, "embeddings")
    df = e.table("embeddings")
    ids = df.select(F.col("vec_id").cast("string").alias("id"), F.lit("vec").alias("label"))
    steps = df.select("vec_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select(F.col("vec_id").cast("string").alias("src"), (F.col("vec_id") + F.col("k")).cast("string").alias("dst"), F.lit("NEXT").alias("relation"), F.lit(1.0).alias("weight"))
    e.graph = Graph(ids, steps.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "relation", "weight"))
    return e


@query(_top(f"list_cosine_distance(e, {_QS})", "vec_id BETWEEN 5 AND 15"))
def knn_in_subgraph(spark, sf_dir):
    return _rows_graph(spark, sf_dir).query(f"SELECT vec_id, distance FROM embeddings TRAVERSE FROM '5' DEPTH 5 VIA NEXT VECTOR NEAR {_Q} TOP 10").withColumn("distance", F.round("distance", 6))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id BETWEEN 5 AND 11 AND label > 2")
def cypher_traverse(spark, sf_dir):
    return _rows_graph(spark, sf_dir).query("MATCH (a:embeddings {id: '5'})-[:NEXT*1..3]->(b:embeddings) WHERE b.label > 2 RETURN b.vec_id, b.label")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id BETWEEN 5 AND 9")
def mongo_traverse(spark, sf_dir):
    return _rows_graph(spark, sf_dir).query('db.embeddings.find({"$traverse": {"from": "5", "depth": 2, "via": "NEXT"}})').select("vec_id", "label")


@query(f"""WITH h AS (SELECT vec_id, greatest(0, least(1, list_cosine_similarity(embedding::DOUBLE[], {_QS}))) AS s FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], {_QS}), vec_id LIMIT 3),
x AS (SELECT e.vec_id AS id, s, CASE WHEN e.vec_id = h.vec_id THEN 0 ELSE CAST(ceil((e.vec_id - h.vec_id) / 2.0) AS INT) END AS hop FROM h JOIN embeddings e ON e.vec_id BETWEEN h.vec_id AND h.vec_id + 4)
SELECT id::VARCHAR AS id, round(max(0.6::DOUBLE * s + 0.4::DOUBLE / (1 + hop)), 6) AS score FROM x GROUP BY 1""")
def rag_hybrid(spark, sf_dir):
    e = _rows_graph(spark, sf_dir)
    hits = vector.knn(e.table("embeddings"), _Q, 3).select(F.col("vec_id").cast("string").alias("id"), vector.similarity(F.col("distance")).alias("similarity"))
    return e.graph.guided(hits, 2, 0.6).select("id", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT vec_id AS i, (CASE WHEN vec_id = 5 THEN 0 WHEN vec_id <= 7 THEN 1 ELSE 2 END)::INT AS depth FROM embeddings WHERE vec_id BETWEEN 5 AND 9)
SELECT '- **' || i || '** (vec)' AS line, depth FROM v UNION ALL SELECT '- ' || a.i || ' -[NEXT]-> ' || b.i, NULL FROM v a JOIN v b ON b.i - a.i IN (1, 2)""")
def rag_context(spark, sf_dir):
    found = _rows_graph(spark, sf_dir).graph.context("5", 2)
    depth = found["vertices"].select(F.concat(F.lit("- **"), "id", F.lit("** (vec)")).alias("line"), "depth")
    return found["markdown"].select(F.explode(F.split("markdown", "\n")).alias("line")).join(depth, "line", "left").select("line", "depth")


# Statistics.


@query("SELECT round(sum(l_extendedprice), 2) AS sum, round(avg(l_extendedprice), 6) AS avg, min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(l_extendedprice) AS count FROM lineitem")
def col_aggs(spark, sf_dir):
    return statistics.aggregates(read(spark, sf_dir, "lineitem"), "l_extendedprice").withColumns({"sum": F.round("sum", 2), "avg": F.round("avg", 6)})


_STATS = ("p_size", "p_retailprice", "p_brand")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS ndv, {'min' if c != 'p_brand' else 'NULL; '}".replace("NULL; ", "CAST(NULL AS DOUBLE)") + (f"({c})::DOUBLE" if c != "p_brand" else "") + " AS min, " + (f"max({c})::DOUBLE" if c != "p_brand" else "CAST(NULL AS DOUBLE)") + " AS max FROM part" for c in _STATS))
def col_stats(spark, sf_dir):
    return statistics.column_stats(read(spark, sf_dir, "part"), list(_STATS))


@query("""WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), b AS (SELECT least(floor((l_quantity - lo) / ((hi - lo) / 10)), 9)::INT AS bucket, lo, (hi - lo) / 10 AS w FROM lineitem, s)
SELECT bucket, round(min(lo + bucket * w), 6) AS low, round(min(lo + (bucket + 1) * w), 6) AS high, count(*) AS count FROM b GROUP BY 1""")
def histogram(spark, sf_dir):
    return statistics.histogram(read(spark, sf_dir, "lineitem"), "l_quantity").withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query()
def selectivity(spark, sf_dir):
    return engine(spark, sf_dir, "part").query("EXPLAIN SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand = 'Brand#1'")


@query("SELECT count(*) AS count, sum(25 + strlen(n_name) + 24)::BIGINT AS bytes, sum(25 + strlen(n_name) + 24) / count(*) AS avg_bytes FROM nation".replace("25 + strlen(n_name) + 24", "11 + 8 + 6 + strlen(n_name) + 11 + 8"))
def collection_count(spark, sf_dir):
    return engine(spark, sf_dir, "nation").collection_stats("nation")


# Shards, merges, replay, changes.


@query()
def slot_route(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", hash_slot(F.concat(F.lit("o{"), F.col("o_custkey").cast("string"), F.lit("}"))).alias("slot"))


@query("SELECT count(*) AS count, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 6) AS avg, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders")
def partial_final(spark, sf_dir):
    parts = statistics.partials(statistics.by_slot(read(spark, sf_dir, "orders"), "o_orderkey"), "shard", "o_totalprice")
    return statistics.reduced(parts).withColumns({"sum": F.round("sum", 2), "avg": F.round("avg", 6)})


def _updates(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("ts"), (F.col("event_id") % 3).alias("region"), "event_id")


@query("SELECT user_id, event_type, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY 1, 2")
def lww_merge(spark, sf_dir):
    return changes.lww(_updates(spark, sf_dir), ["user_id", "event_type"], "value", "ts", "event_id")


@query("SELECT user_id FROM events GROUP BY 1 HAVING max(CASE WHEN event_type <> 'error' THEN event_id END) IS NOT NULL AND coalesce(max(CASE WHEN event_type <> 'error' THEN event_id END) > max(CASE WHEN event_type = 'error' THEN event_id END), true)")
def orset(spark, sf_dir):
    ops = _updates(spark, sf_dir).withColumn("op", F.when(F.col("event_type") == "error", "remove").otherwise("add"))
    return changes.or_set(ops, ["user_id"], "op", "event_id")


@query("SELECT user_id, (sum(p) - sum(n))::BIGINT AS value FROM (SELECT user_id, event_id % 3 AS region, max(event_id % 100) AS p, max(event_id % 7) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def pncounter(spark, sf_dir):
    s = _updates(spark, sf_dir).withColumns({"p": F.col("event_id") % 100, "n": F.col("event_id") % 7})
    return changes.pn_counter(s, ["user_id"])


def _log(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("sequence"), F.col("event_id").alias("timestamp"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("op_type"), F.lit("users").alias("collection"), F.col("user_id").cast("string").alias("doc_id"), F.col("props").alias("payload"))


@query("""SELECT doc_id, payload FROM (SELECT user_id::VARCHAR AS doc_id, arg_max(props, event_id) AS payload, arg_max(event_type, event_id) AS t FROM events WHERE event_id <= 6000 GROUP BY 1) WHERE t <> 'error'""")
def pitr_replay(spark, sf_dir):
    base = _log(spark, sf_dir).where("false").select("collection", "doc_id", "payload")
    return changes.replay(base, _log(spark, sf_dir), until=6000).select("doc_id", "payload")


@query("""SELECT o_orderkey::VARCHAR AS doc_id, CASE WHEN o_orderkey % 11 = 0 THEN 'new' ELSE o_orderstatus END AS payload FROM orders WHERE o_orderkey % 10 <> 0 OR o_orderkey % 11 = 0""")
def snapshot_apply(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.lit("orders").alias("collection"), F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderstatus").alias("payload"), "o_orderkey")
    changed = o.where("o_orderkey % 11 = 0").withColumn("payload", F.lit("new"))
    return changes.apply_increment(o.drop("o_orderkey"), changed, o.where("o_orderkey % 10 = 0")).select("doc_id", "payload")


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN p_size + 5 ELSE p_size END::INT AS p_size, CASE WHEN p_size > 40 THEN 'big' ELSE p_brand END AS p_brand FROM part")
def update_arith(spark, sf_dir):
    e = engine(spark, sf_dir, "part")
    e.query("UPDATE part SET p_size = p_size + 5, p_brand = 'big' WHERE p_size > 40")
    return e.table("part").select("p_partkey", "p_size", "p_brand")


@query("SELECT event_id FROM events WHERE event_type IS NULL OR event_type <> 'click'")
def delete_where(spark, sf_dir):
    e = engine(spark, sf_dir, "events")
    e.query('db.events.deleteMany({"event_type": "click"})')
    return e.table("events").select("event_id")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100, 'Atlantis' UNION ALL SELECT 101, 'O''Land'")
def insert_rows(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.query("INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (100, 'Atlantis', 0), (101, 'O''Land', 1)")
    return e.table("nation").select("n_nationkey", "n_name")


@query("SELECT event_id FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20 00:00:00'")
def ttl_live(spark, sf_dir):
    e = feeds.with_expiry(read(spark, sf_dir, "events").withColumn("_ttl", F.lit(7 * 86400)), "ts")
    return feeds.live(e, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id")


_CDC = {"op": "$.payload.op", "after_id": "$.payload.after.event_id", "after_value": "$.payload.after.value", "before_value": "$.payload.before.value", "at": "$.payload.ts_ms", "source_at": "$.payload.source.ts_ms", "lsn": "$.payload.source.lsn", "collection": "$.payload.source.collection", "snapshot": "$.payload.source.snapshot"}


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'd' WHEN 'signup' THEN 'c' ELSE 'u' END AS op, event_id::VARCHAR AS after_id, value AS after_value, CASE WHEN event_type <> 'signup' THEN value - 1 END AS before_value,
(event_id * 10)::VARCHAR AS at, (event_id * 10)::VARCHAR AS source_at, event_id::VARCHAR AS lsn, 'events' AS collection, 'false' AS snapshot FROM events""")
def cdc_envelope(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "d").when(F.col("event_type") == "signup", "c").otherwise("u")
    before = F.when(F.col("event_type") != "signup", F.struct("event_id", (F.col("value") - 1).alias("value")))
    out = e.select("event_id", feeds.envelope(before, F.struct("event_id", "value"), op, F.lit("events"), F.col("event_id") * 10, F.col("event_id")).alias("j"))
    named = {n: F.get_json_object("j", p) for n, p in _CDC.items()}
    return out.select("event_id", *(c.cast("double").alias(n) if n.endswith("_value") else c.alias(n) for n, c in named.items()))


@query("SELECT event_id FROM events WHERE event_type = 'view'")
def change_filter(spark, sf_dir):
    return feeds.subscribe(read(spark, sf_dir, "events").withColumn("collection", F.col("event_type")), "view").select("event_id")


@query("SELECT 'update' AS operation_type, count(*) AS n FROM part WHERE p_size > 40 UNION ALL SELECT 'delete', count(*) FROM part WHERE p_size < 3")
def change_events(spark, sf_dir):
    e = engine(spark, sf_dir, "part")
    before = e.table("part")
    e.query("UPDATE part SET p_size = p_size + 1 WHERE p_size > 40")
    e.query("DELETE FROM part WHERE p_size < 3")
    return feeds.events(before, e.table("part"), "part", "p_partkey").groupBy("operation_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'INSERT INTO region (r_regionkey, r_name) VALUES (' || r_regionkey || ', ''' || r_name || ''');' AS line FROM region")
def sql_dump(spark, sf_dir):
    return files.sql_dump(read(spark, sf_dir, "region").select("r_regionkey", "r_name"), "region")


@query("SELECT r_regionkey || ',' || r_name AS line FROM region")
def csv_export(spark, sf_dir):
    return files.csv_lines(read(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query("SELECT user_id::VARCHAR AS key, max(event_id) AS seq FROM events WHERE user_id::VARCHAR LIKE '1%' GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def prefix_scan(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"))
    log = log.withColumn("version", F.col("seq"))
    return files.prefix_scan(log, "1").select("key", F.col("version").alias("seq"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY 1")
def latest_turn(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("at", F.col("turn"))
    return changes.latest(c, "conv_id", "turn").select("conv_id", F.col("at").alias("turn"), "text")


@query("""WITH m AS (SELECT event_id % 50 AS key, max(event_id) AS last FROM events GROUP BY 1), s AS (SELECT user_id AS txn, event_id % 50 AS key, event_id FROM events UNION ALL SELECT user_id, user_id % 50, event_id FROM events)
SELECT txn, key FROM s JOIN m USING (key) WHERE event_id < last""")
def mvcc_conflicts(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    # Each event is a transaction's step: it writes one key and reads its user's.
    writes = e.select(F.col("user_id").alias("txn"), (F.col("event_id") % 50).alias("key"), F.col("event_id").alias("snapshot_ts"))
    reads = e.select(F.col("user_id").alias("txn"), (F.col("user_id") % 50).alias("key"), F.col("event_id").alias("snapshot_ts"))
    committed = e.select((F.col("event_id") % 50).alias("key"), F.col("event_id").alias("commit_ts"))
    return changes.conflicts(writes, reads, committed).select("txn", "key")


# Joins by alias, with fields of one name, and before the nearest vectors.

statement("join_alias", ("orders", "customer"), "SELECT o.o_orderkey AS k, c.c_name AS name, c.c_acctbal FROM orders o JOIN customer AS c ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 5000 AND o.o_orderstatus = 'F' OR o.o_orderkey = 3 ORDER BY c.c_acctbal DESC, k LIMIT 50".replace(", k LIMIT", ", o.o_orderkey LIMIT"), "SELECT o_orderkey AS k, c_name AS name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND o_orderstatus = 'F' OR o_orderkey = 3 ORDER BY c_acctbal DESC, o_orderkey LIMIT 50")


def _places(spark, sf_dir) -> Engine:
    """Nations and regions whose fields have the same names."""
    e = engine(spark, sf_dir, "nation", "region")
    e.register("nation", e.table("nation").toDF("id", "name", "region"), "id")
    return e.register("region", e.table("region").toDF("id", "name"), "id")


@query("SELECT n.n_nationkey AS id, r.r_regionkey AS region_id, r.r_name AS place FROM nation n JOIN region r ON n_regionkey = r_regionkey WHERE r_regionkey IN (1, 3) AND n_nationkey > 2")
def join_same_name(spark, sf_dir):
    return _places(spark, sf_dir).query("SELECT nation.id, region.id, region.name AS place FROM nation JOIN region ON nation.region = region.id WHERE region.id IN (1, 3) AND nation.id > 2")


@query("SELECT a.n_nationkey AS id, b.n_nationkey AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE b.n_nationkey < 5")
def join_itself(spark, sf_dir):
    return _places(spark, sf_dir).query("SELECT a.id, b.id AS other FROM nation a JOIN nation b ON a.region = b.region WHERE b.id < 5")


@query(_top(f"list_cosine_distance(e, {_QS})", "label IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')"))
def join_filter_right_near(spark, sf_dir):
    e = engine(spark, sf_dir, "embeddings", "region")
    return e.query(f"SELECT e.vec_id, distance FROM embeddings e JOIN region r ON e.label = r.r_regionkey WHERE r.r_name STARTS_WITH 'A' VECTOR NEAR {_Q} TOP 10").withColumn("distance", F.round("distance", 6))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_orderkey LIMIT 20")
def parameters(spark, sf_dir):
    return engine(spark, sf_dir, "orders").query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = $2 AND o_totalprice > $1 ORDER BY o_orderkey LIMIT $3", [1000, "F", 20])


@query("SELECT user_id AS _id, string_agg(event_type, ',' ORDER BY event_type DESC, event_id DESC) AS types, arg_max(event_type, event_type) AS top, arg_min(event_type, event_type) AS low FROM events GROUP BY 1")
def grp_push_descending(spark, sf_dir):
    stages = [{"$sort": {"event_type": -1, "event_id": -1}}, {"$group": {"_id": "$user_id", "types": {"$push": "$event_type"}, "top": {"$first": "$event_type"}, "low": {"$last": "$event_type"}}}]
    return engine(spark, sf_dir, "events").aggregate("events", stages).withColumn("types", F.array_join("types", ","))


@query("SELECT user_id AS _id, arg_max(value, event_id) AS value FROM (SELECT * FROM events e WHERE event_type = (SELECT min(event_type) FROM events f WHERE f.user_id = e.user_id)) GROUP BY 1")
def grp_first_mixed(spark, sf_dir):
    stages = [{"$sort": {"event_type": 1, "event_id": -1}}, {"$group": {"_id": "$user_id", "value": {"$first": "$value"}}}]
    return engine(spark, sf_dir, "events").aggregate("events", stages)


# The catalog, cursors, keys, files.


@query("SELECT 'n_nationkey' AS field, 'int' AS type UNION ALL SELECT 'n_name', 'string' UNION ALL SELECT 'n_regionkey', 'int'")
def describe_table(spark, sf_dir):
    return engine(spark, sf_dir, "nation").query("DESCRIBE nation")


@query("SELECT unnest(['" + "', '".join(sorted(KEYS)) + "']) AS table_name")
def reflected_tables(spark, sf_dir):
    return engine(spark, sf_dir).query("SELECT table_name FROM information_schema.tables")


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def key_lookup(spark, sf_dir):
    return engine(spark, sf_dir, "orders").find_one("orders", 7)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def cursor_batches(spark, sf_dir):
    e = engine(spark, sf_dir, "orders")
    cursor, _ = e.open_cursor("orders", N.Leaf("eq", "o_orderstatus", "F"), 100)
    return e.get_more(cursor, 50).select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def index_lookup(spark, sf_dir):
    e = engine(spark, sf_dir, "customer")
    e.query("CREATE INDEX by_nation ON customer (c_nationkey)")
    return e.query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")


@query("SELECT 14::BIGINT AS a, 'x' AS b, 2.5::DOUBLE AS c UNION ALL SELECT 2, NULL, NULL")
def json_import(spark, sf_dir):
    return files.documents(spark, [{"a": 14, "b": "x", "c": 2.5}, {"a": 2}])


def _folder(spark: SparkSession, name: str) -> str:
    """A place for a query's own files, in the shared folder."""
    import uuid

    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4()}"


@query("SELECT * FROM nation")
def csv_import(spark, sf_dir):
    files.write_csv(read(spark, sf_dir, "nation"), path := _folder(spark, "csv"))
    return files.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def snapshot_roundtrip(spark, sf_dir):
    files.write_snapshot({"customer": read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")}, path := _folder(spark, "snapshot"))
    return files.read_snapshot(spark, path)["customer"]


@query(f"WITH {_GRAPH} SELECT relation, count(*) AS n, (SELECT count(*) FROM v) AS vertices FROM e GROUP BY 1")
def graph_roundtrip(spark, sf_dir):
    files.write_graph(graph(spark, sf_dir), path := _folder(spark, "graph"))
    g = files.read_graph(spark, path)
    return g.edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).crossJoin(g.vertices.agg(F.count(F.lit(1)).alias("vertices")))  # one row


# Changes of rows by key, in graphs, in caches and between regions.


@query("SELECT n_nationkey, CASE n_nationkey WHEN 4 THEN 'Four' WHEN 5 THEN NULL WHEN 6 THEN 'Six' ELSE n_name END AS n_name, CASE n_nationkey WHEN 4 THEN NULL WHEN 5 THEN n_regionkey + 10 ELSE n_regionkey END::INT AS n_regionkey FROM nation")
def put_and_patch(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.put("nation", 4, {"n_name": "Four"})
    e.patch("nation", 5, {"$inc": {"n_regionkey": 10}, "$unset": {"n_name": 1}})
    e.patch("nation", 6, {"n_name": "Six"})
    return e.table("nation")


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#5' THEN 'five' ELSE p_type END AS p_type, CASE WHEN p_brand = 'Brand#5' THEN p_size + 1 ELSE p_size END::INT AS p_size FROM part")
def mongo_update(spark, sf_dir):
    e = engine(spark, sf_dir, "part")
    e.query('db.part.updateMany({"p_brand": "Brand#5"}, {"$set": {"p_type": "five"}, "$inc": {"p_size": 1}})')
    return e.table("part").select("p_partkey", "p_type", "p_size")


@query("SELECT p_partkey, CASE WHEN p_partkey = (SELECT min(p_partkey) FROM part WHERE p_size > 40) THEN 0 ELSE p_size END::INT AS p_size FROM part")
def find_and_modify(spark, sf_dir):
    return changes.find_and_modify(read(spark, sf_dir, "part"), N.Leaf("gt", "p_size", 40), {"p_size": 0}, "p_partkey")[1].select("p_partkey", F.col("p_size").cast("int").alias("p_size"))


@query("SELECT n_nationkey, n_regionkey, 7::INT AS rank FROM nation")
def alter_table(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.query("ALTER TABLE nation ADD COLUMN rank INT DEFAULT 7")
    e.query("ALTER TABLE nation DROP COLUMN n_name")
    return e.table("nation")


@query("SELECT label AS _id, count(*) AS n FROM embeddings WHERE vec_id % 10 <> 0 GROUP BY 1")
def ttl_in_find(spark, sf_dir):
    e = engine(spark, sf_dir, "embeddings")
    df = e.table("embeddings").withColumn("gone", F.when(F.col("vec_id") % 10 == 0, F.lit("2001-01-01").cast("timestamp")).when(F.col("vec_id") % 10 == 1, F.lit("2999-01-01").cast("timestamp")))
    return e.register("embeddings", df, "vec_id", "gone").aggregate("embeddings", [{"$group": {"_id": "$label", "n": {"$sum": 1}}}])


@query("SELECT vec_id AS query_id, vec_id AS entry_id, 'v' || vec_id AS payload FROM embeddings WHERE vec_id BETWEEN 30 AND 49")
def semantic_cache(spark, sf_dir):
    """Entries put in two goes, of which the first has expired and the cap lets the newest twenty stay."""
    df = read(spark, sf_dir, "embeddings")
    rows = df.select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vector"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("payload"))
    at = lambda t: F.lit(t).cast("timestamp")
    c = cache.SemanticCache(spark, 300, 20).put(rows.where("entry_id < 10"), at("2024-01-01 00:00:00")).put(rows.where("entry_id < 50"), at("2024-01-01 01:00:00")).sweep(at("2024-01-01 01:01:00"))
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = c.get(asked, at("2024-01-01 01:02:00"))
    return found.where(F.col("similarity") > 0.999999).select("query_id", "entry_id", "payload")


@query(f"WITH {_GRAPH} SELECT id, label FROM v WHERE label = 'supplier' UNION ALL SELECT id, label FROM v WHERE id = 'c:7'")
def vertex_lookup(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.by_label("supplier").unionByName(g.by_property("id", "c:7")).select("id", "label")


@query(f"WITH {_GRAPH} SELECT src, dst, relation, weight FROM e WHERE src <> 's:3' AND dst <> 's:3' AND relation <> 'BOUGHT_FROM' AND NOT (src = 'n:1' AND dst LIKE 'r:%') UNION ALL SELECT 'r:0', 'x:1', 'LINKS', 2.0 UNION ALL SELECT 'r:1', 'r:0', 'LINKS', 1.0")
def graph_changes(spark, sf_dir):
    e = engine(spark, sf_dir)
    g = graph(spark, sf_dir)
    to = g.edges.where("src = 'n:1' AND dst LIKE 'r:%'").first()["dst"]
    e.graph = Graph(g.vertices, g.edges.where("relation <> 'BOUGHT_FROM'")).remove_vertex("s:3")
    e.query("CREATE EDGE FROM 'r:0' TO 'x:1' TYPE LINKS WEIGHT 2.0")
    e.query("CREATE (a:region {id: 'r:1'})-[:LINKS]->(b:region {id: 'r:0'})")
    e.query("DELETE EDGE FROM 'n:1' TO $1", [to])
    return e.graph.edges.select("src", "dst", "relation", "weight")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id BETWEEN 5 AND 11 ORDER BY label DESC, vec_id LIMIT 4 OFFSET 1")
def cypher_order(spark, sf_dir):
    return _rows_graph(spark, sf_dir).query("MATCH (a:embeddings {id: '5'})-[:NEXT*1..3]->(b:embeddings) RETURN b.vec_id, b.label ORDER BY b.label DESC, b.vec_id SKIP 1 LIMIT 4")


@query("SELECT o_orderkey::VARCHAR AS key, 'o_orderstatus' AS field, CASE WHEN o_orderkey % 4 = 0 THEN 'B' WHEN o_orderkey % 2 = 0 THEN 'A' ELSE o_orderstatus END AS value FROM orders WHERE o_orderkey % 10 <> 3")
def geo_merge(spark, sf_dir):
    """Two regions change and remove orders; each one's deltas reach a third in any order."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), "o_orderstatus", "o_orderkey")
    base = o.drop("o_orderkey")
    set_ = lambda m, v: o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % m == 0, v).otherwise(F.col("o_orderstatus"))).drop("o_orderkey")
    first = changes.deltas(base, set_(2, "A"), "key", "east", F.lit(10))
    second = changes.deltas(base, set_(4, "B").where("key NOT LIKE '%3'"), "key", "west", F.lit(20))
    start = base.select("key", F.lit("o_orderstatus").alias("field"), F.col("o_orderstatus").alias("value"), F.lit(0).alias("ts"), F.lit("base").alias("region"))
    merged = changes.apply_deltas(changes.apply_deltas(start, second), first)
    return merged.where("field IS NOT NULL").select("key", "field", "value")


def _shards(spark, sf_dir) -> list[DataFrame]:
    df = statistics.by_slot(read(spark, sf_dir, "orders"), "o_orderkey")
    return [df.where(F.col("shard") == k).drop("slot", "shard") for k in range(4)]


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def scatter_page(spark, sf_dir):
    asked = statistics.Scatter().matching(N.Leaf("eq", "o_orderstatus", "O")).sorted(("o_totalprice", False), ("o_orderkey", True)).page(10, 20)
    return asked.gather(_shards(spark, sf_dir)).select("o_orderkey", "o_totalprice")


@query("SELECT round(avg(o_totalprice), 6) AS value FROM orders WHERE o_orderstatus = 'O'")
def scatter_average(spark, sf_dir):
    return statistics.Scatter().matching(N.Leaf("eq", "o_orderstatus", "O")).aggregate("avg", "o_totalprice").gather(_shards(spark, sf_dir)).select(F.round("value", 6).alias("value"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 11")
def routed_lookup(spark, sf_dir):
    return statistics.routed(statistics.by_slot(read(spark, sf_dir, "orders"), "o_orderkey"), "o_orderkey", 11).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, 'update' AS operation_type FROM part WHERE p_size > 40")
def resumed_feed(spark, sf_dir):
    """The events after a token: the second of two goes."""
    e = engine(spark, sf_dir, "part")
    before = e.table("part")
    gone = feeds.stamped(feeds.events(before, before.where("p_size >= 3"), "part", "p_partkey"), F.lit("2024-01-01").cast("timestamp"))
    e.query("UPDATE part SET p_size = p_size + 1 WHERE p_size > 40")
    changed = feeds.stamped(feeds.events(before, e.table("part"), "part", "p_partkey"), F.lit("2024-01-02").cast("timestamp"), 10**15)
    feed = gone.unionByName(changed)
    return feeds.resumed(feed, f"{10**15 - 1:020d}").select(F.col("document_id").cast("long").alias("p_partkey"), "operation_type")
