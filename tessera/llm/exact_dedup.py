"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Texts are equal when identical after each run of ASCII white space becomes one space. Digests are counted first (a row of
a few bytes for each document), which tells the hot ones: at most four for each shuffle partition. Then whole normalised
texts are deduplicated locally (the partial aggregate of each task) and merged by digest and text, those of hot digests
under a salt as well; the salts' winners are combined globally. Each of these steps compares whole texts. Once every text
under a digest is known to be one text, the documents find their winner by the digest, and texts don't move again for it;
were one digest to stand for several texts, its documents would find their winner by digest and text.

Defined results: null texts count as empty; of equal texts the smallest id stays, and of rows that repeat this id each is
kept; a null id sorts before all others. Other columns of the input are ignored unless named in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import HOT, meet, normalised, partitions, scan, written

#: Into how many parts the rows of one hot digest are dealt before its winners meet.
SALTS = 64


def exact_groups(docs: DataFrame, salts: int = SALTS, carry: tuple[str, ...] = (), hot: int = HOT, digest_bytes: int = 32) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, and the columns of carry as carry_0,
    carry_1 and so on. hot: a digest of more rows is salted; digest_bytes: how much of the SHA-256 finds equal texts."""
    spark = docs.sparkSession
    names = [f"carry_{k}" for k in range(len(carry))]
    sha = F.unhex(F.sha2(normalised(F.col("text")), 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)), sha.alias("sha"))
    rows = rows.withColumn("digest", F.substring("sha", 1, digest_bytes) if digest_bytes < 32 else F.col("sha"))
    named = written(rows.select("doc_id", "sha", "digest") if digest_bytes < 32 else rows.select("doc_id", "sha")).withColumn("digest", F.col("digest" if digest_bytes < 32 else "sha"))
    common = named.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).orderBy(F.desc("n"), "digest").limit(4 * partitions(spark))
    salt = F.when(F.col("hot"), 1 + F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    marked = rows.select("doc_id", "digest", normalised(F.col("text")).alias("norm")).join(F.broadcast(common.select("digest", F.lit(True).alias("hot"))), "digest", "left")
    # min() skips nulls: a null id is carried by a flag, as it sorts first.
    low, blank = F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull().cast("int")).alias("blank")
    merged = marked.withColumn("salt", salt).groupBy("digest", "salt", "norm").agg(low, F.count(F.lit(1)).alias("n"), blank)
    # Rows without a salt are their text's only ones: of these the text needn't move again.
    apart = merged.select("digest", F.when(F.col("salt") > 0, F.col("norm")).alias("norm"), "low", "n", "blank", (F.col("salt") == 0).cast("int").alias("plain"))
    each = [F.min("low").alias("low"), F.sum("n").alias("n"), F.max("blank").alias("blank")]
    combined = apart.groupBy("digest", "norm").agg(*each, F.greatest(F.sum("plain"), F.lit(1)).alias("texts"))
    winners = written(combined.groupBy("digest").agg(*each, F.sum("texts").alias("texts")))
    keep = F.when(F.col("blank") == 0, F.col("low")).alias("keep_id")
    one = winners.where("texts = 1").select("digest", "n", keep, F.col("n").alias("group_size"))
    found = meet(rows.drop("text") if carry else named, one, ["digest"], ["keep_id", "group_size"])
    if not winners.where("texts > 1").isEmpty():
        several = rows.withColumn("norm", normalised(F.col("text"))).drop("text").join(winners.where("texts > 1").select("digest"), "digest")
        by_text = several.groupBy("digest", "norm").agg(low, F.count(F.lit(1)).alias("n"), blank).select("digest", "norm", "n", keep, F.col("n").alias("group_size"))
        found = found.unionByName(meet(several, by_text, ["digest", "norm"], ["keep_id", "group_size"]).select(found.columns))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), *names)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(scan(spark, sf_dir, "documents"))


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {
    "op6_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n"""
}
