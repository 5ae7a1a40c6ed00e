"""Reading and writing collections: JSON, CSV, dumps, snapshots and graphs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.graph import Graph


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def documents(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """A DataFrame of JSON documents, with the schema they have together."""
    lines = [(json.dumps(r),) for r in rows]
    if not lines:
        return spark.createDataFrame([], "_id string")
    texts = spark.createDataFrame(lines, "value string")
    kinds = texts.agg(F.schema_of_variant_agg(F.parse_json("value")).alias("s")).first()["s"]
    schema = re.sub(r"DECIMAL\([^)]*\)", "DOUBLE", kinds.replace("OBJECT<", "STRUCT<"))
    return texts.select(F.from_json("value", schema).alias("d")).select("d.*")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def csv_lines(df: DataFrame) -> DataFrame:
    """The rows as CSV text, without a header."""
    return df.select(F.to_csv(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("line"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("line"))


def _sql_value(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        text = c.cast("string")
    else:
        text = c.cast("string") if not isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else F.to_json(c)
        text = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def sql_dump(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement for each row."""
    names = ", ".join(df.columns)
    values = F.concat_ws(", ", *(_sql_value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields))
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({names}) VALUES ("), values, F.lit(");")).alias("line"))


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Collections as JSON payloads with checksums, and a manifest with each collection's count and combined checksum."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        json_lines(df).select(F.lit(name).alias("collection"), F.col("line").alias("payload"), F.crc32(F.col("line").cast("binary")).alias("crc")).write.mode("overwrite").parquet(f"{path}/data/{name}")
    manifest = [(n, df.schema.json(), r["n"], r["x"]) for n, df in tables.items() for r in [spark.read.parquet(f"{path}/data/{n}").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor("crc"), F.lit(0)).alias("x")).first()]]
    spark.createDataFrame(manifest, "collection string, schema string, rows long, crc long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The collections of a snapshot; a checksum that doesn't hold is an error."""
    out = {}
    for m in spark.read.parquet(f"{path}/manifest").collect():
        data = spark.read.parquet(f"{path}/data/{m['collection']}")
        own = F.crc32(F.col("payload").cast("binary"))
        r = data.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(own), F.lit(0)).alias("x"), F.count_if(own != F.col("crc")).alias("bad")).first()
        if (r["n"], r["x"], r["bad"]) != (m["rows"], m["crc"], 0):
            raise ValueError(f"snapshot of {m['collection']} is damaged")
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        out[m["collection"]] = data.select(F.from_json("payload", schema).alias("d")).select("d.*")
    return out


def encrypted(df: DataFrame, key: str, column: str = "payload") -> DataFrame:
    """The column under AES-GCM, as base64."""
    return df.withColumn(column, F.base64(F.aes_encrypt(F.col(column).cast("binary"), F.lit(key), F.lit("GCM"))))


def decrypted(df: DataFrame, key: str, column: str = "payload") -> DataFrame:
    return df.withColumn(column, F.aes_decrypt(F.unbase64(F.col(column)), F.lit(key), F.lit("GCM")).cast("string"))


def write_graph(g: Graph, path: str) -> None:
    g.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))


def prefix_scan(log: DataFrame, prefix: str, key: str = "key", order: str = "seq", tombstone: str = "deleted") -> DataFrame:
    """Of each key with the prefix the newest version, deletions left out."""
    from tessera.operators.changes import latest

    return latest(log.where(F.col(key).startswith(prefix)), key, order, F.col(tombstone))
