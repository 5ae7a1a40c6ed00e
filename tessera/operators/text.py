"""Full-text search: postings and BM25 ranking."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import STOP_WORDS, tokens

K1, B = 1.2, 0.75


def query_terms(query: str) -> list[str]:
    words = re.split(r"[\W_]+", query.lower())
    return [w for w in words if len(w.encode()) > 1 and w not in STOP_WORDS]


def searchable(df: DataFrame) -> DataFrame:
    """All texts of a row (strings and arrays of strings) as one, beside its key columns."""
    parts = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            parts.append(F.col(f"`{f.name}`"))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            parts.append(F.array_join(f"`{f.name}`", " "))
    return df.withColumn("__text", F.concat_ws(" ", *parts) if parts else F.lit(""))


#: Keys that more than one row has, which all tasks may be told.
SHARED = 100_000


def _row_postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf and positions of each term of each row, by sorting a row's terms with their places where the row is."""
    placed = F.sort_array(F.transform(tokens(F.col(text)), lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    rows = df.select(F.col(key).alias("key"), placed.alias("ts")).withColumn("size", F.size("ts"))
    new = lambda i: (i == 0) | (F.col("ts")[i]["w"] != F.col("ts")[F.greatest(i - 1, F.lit(0))]["w"])
    rows = rows.withColumn("at", F.when(F.col("size") > 0, F.filter(F.sequence(F.lit(0), F.col("size") - 1), new)))
    ends = F.concat(F.slice("at", 2, F.size("at")), F.array("size"))
    # What is exploded has each term's own places only: a row's whole terms beside each of them would grow with their square.
    terms = F.zip_with("at", ends, lambda a, z: F.struct(F.col("ts")[a]["w"].alias("term"), (z - a).cast("long").alias("tf"), F.transform(F.slice("ts", a + 1, z - a), lambda x: x["i"]).alias("positions")))
    return rows.select("key", F.explode(terms).alias("p")).select("p.term", "key", "p.tf", "p.positions")


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf and positions of each term of each key. Rows whose key no other row has, which is all of them as a rule,
    are done where they are; only rows that share a key are dealt out, by their terms."""
    shared = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("key")
    own = _row_postings(df, key, text)
    n = shared.limit(SHARED + 1).count()
    if not n:
        return own
    alone = None
    if n <= SHARED:
        some = F.broadcast(shared.select(F.col("key").alias("__key")))  # SHARED keys at most
        both = df[key].eqNullSafe(F.col("__key"))
        alone = _row_postings(df.join(some, both, "left_anti"), key, text)
        own = _row_postings(df.join(some, both, "left_semi"), key, text)
    met = own.groupBy("term", "key").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return met if alone is None else alone.unionByName(met)


def bm25(df: DataFrame, query: str, k: int = 10, key: str = "doc_id", text: str = "text", fuzzy: bool = False) -> DataFrame:
    """The k best rows: key, score (two places) and matched_terms. Terms that a query repeats count each time; fuzzy terms at
    distance 1 weigh 0.75, at distance 2 from a term of five bytes or more 0.5. Rows without terms don't count as rows."""
    counts: dict[str, int] = {}
    for t in query_terms(query):
        counts[t] = counts.get(t, 0) + 1
    rows = df.select(F.col(key).alias("key"), tokens(F.col(text)).alias("ts")).withColumn("dl", F.size("ts")).where("dl > 0")
    # Texts are cut down to what a query can match before they become rows.
    if fuzzy:
        near = F.array(*(F.struct(F.lit(t).alias("q"), F.lit(n).alias("times"), F.lit(len(t.encode())).alias("bytes")) for t, n in counts.items()))
        d = lambda x, w: F.levenshtein(x["q"], w, 2)
        fits = lambda x, w: F.when(F.abs(F.length(w) - F.length(x["q"])) > 2, False).otherwise(d(x, w) >= 0)
        some = F.filter("ts", lambda w: F.exists(near, lambda x: fits(x, w))) if counts else F.slice("ts", 1, 0)
        weight = lambda x: F.when(x["q"] == F.col("term"), 1.0).when(d(x, F.col("term")) == 1, 0.75).when((d(x, F.col("term")) == 2) & (x["bytes"] >= 5), 0.5)
        total = F.aggregate(near, F.lit(0.0), lambda s, x: s + F.coalesce(weight(x), F.lit(0.0)) * x["times"]) if counts else F.lit(0.0)
    else:
        some = F.filter("ts", lambda w: w.isin(list(counts)))
        total = F.lit(0.0)
        for t, n in counts.items():
            total = F.when(F.col("term") == t, float(n)).otherwise(total)
    hits = rows.select("key", "dl", F.explode(some).alias("term")).withColumn("weight", total).where("weight > 0")
    tf = hits.groupBy("term", "key").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"), F.first("weight").alias("weight"))
    size = rows.agg(F.count(F.lit(1)).cast("double").alias("n"), F.greatest(F.lit(1.0), F.avg("dl")).alias("avgdl"))
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    scored = tf.join(df_, "term").crossJoin(F.broadcast(size))  # size is one row
    idf = F.greatest(F.lit(0.1), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))
    score = idf * (F.col("tf") * (K1 + 1.0)) / (F.col("tf") + K1 * (1.0 - B + B * F.col("dl") / F.col("avgdl"))) * F.col("weight")
    ranked = scored.groupBy("key").agg((F.round(F.sum(score) * 100) / 100).alias("score"), F.array_sort(F.collect_set("term")).alias("matched_terms"))
    return ranked.orderBy(F.desc("score"), "key").limit(k).withColumnRenamed("key", key)
