"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcweave.llm import credentials, docpairs, encode, languages, neardup, neighbours, packing, provenance, syntax
from srcweave.session import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("p8_ids")
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_documents(table(spark, sf, "documents"))


@query("p8_roundtrip", "SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents")
def p8_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return encode.decode_documents(encode.encode_documents(table(spark, sf, "documents")))


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Kept, as the packing reads them twice and encoding costs most."""
    return Scratch(spark).keep(encode.encode_documents(table(spark, sf, "documents")).select("doc_id", F.size("ids").alias("size")))


@query("p9_packed")
def p9_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf)).withColumnRenamed("id", "doc_id")


@query("p9_fill")
def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    boxes = packing.pack(_sizes(spark, sf)).where("container is not null").groupBy("container").agg(F.sum("size").alias("used"))
    return boxes.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.ceil(F.sum("used") / packing.CAPACITY).alias("lower_bound"), F.round(1 - F.sum("used") / (F.count("*") * packing.CAPACITY), 6).alias("unused"))


@query("p6_found")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf, "vectors"))


@query("p6_top")
def p6_top(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar embeddings of every twentieth row, by its hash."""
    return neighbours.top_neighbours(table(spark, sf, "vectors"), queries=lambda i: F.pmod(F.xxhash64(i), F.lit(20)) == 0)


@query("p3_found")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.similar_texts(_file_rows(spark, sf), "id", "content").pairs


@query("p3_groups")
def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.groups(neardup.similar_texts(_file_rows(spark, sf), "id", "content"))


def _file_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").where("chunk_type = 'file'")


@query("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.broken_files(_file_rows(spark, sf))


@query("p4_rates")
def p4_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Broken files, all files and their rate per repository and language."""
    broken = p4_found(spark, sf).withColumn("broken", F.lit(1))
    files = table(spark, sf, "files").select("file_id", "repo", "language").distinct()
    rates = files.join(broken, "file_id", "left").groupBy("repo", "language").agg(F.count("*").alias("files"), F.count("broken").alias("broken"))
    return rates.withColumn("rate", F.round(F.col("broken") / F.col("files"), 6))


@query("p2_found")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _file_rows(spark, sf)
    versions = table(spark, sf, "file_versions").select("file_id", F.col("relative_path").alias("path"))
    return provenance.foreign_files(chunks, [versions, chunks.select("file_id", F.regexp_replace(F.replace("file_path", F.lit("\\"), F.lit("/")), "^/srv/repos/[^/]+/", "").alias("path"))])


@query("p2_hand_written")
def p2_hand_written(spark: SparkSession, sf: str) -> DataFrame:
    """The files left: hand-written source only, per repository and language."""
    files = table(spark, sf, "files").select("file_id", "repo", "language").distinct()
    return files.join(p2_found(spark, sf), "file_id", "left_anti").groupBy("repo", "language").agg(F.count("*").alias("files"))


def _credentials(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.credentials(table(spark, sf, "chunks"), table(spark, sf, "appsettings"))


@query("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _credentials(spark, sf).select("place", "record_id", "line_no").distinct()


@query("p1_redacted")
def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    chunks, settings = table(spark, sf, "chunks"), table(spark, sf, "appsettings")
    texts = chunks.select(F.lit("chunk").alias("place"), F.col("id").alias("record_id"), F.col("content").alias("text"))
    for place, field in (("apikey", "openweatherapi.apikey"), ("defaultconnection", "connectionstrings.defaultconnection")):
        texts = texts.unionByName(settings.select(F.lit(place).alias("place"), F.col("settings_id").cast("string").alias("record_id"), F.col(field).alias("text")))
    return credentials.redact(texts, _credentials(spark, sf))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Documented functions of the files that are hand-written and parse."""
    left_out = p2_found(spark, sf).unionByName(p4_found(spark, sf))
    return docpairs.documented_functions(_file_rows(spark, sf)).join(left_out, "file_id", "left_anti")


@query("p5_found")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("file_id", "line_no").distinct()


@query("p5_pairs")
def p5_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf)


@query("p10_found")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    found = Scratch(spark).keep(languages.identify(table(spark, sf, "documents")))
    return languages.mislabelled(found).select(F.col("id").alias("doc_id"), "line_no", "lang")


@query("p10_stretches")
def p10_stretches(spark: SparkSession, sf: str) -> DataFrame:
    return languages.identify(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")
