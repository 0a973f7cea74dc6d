"""Typed writers of nodes, edges and vector collections: checks first, then the keyed merges of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcweave.operators.store import upsert, with_embedding, write_edges
from srcweave.schema import EDGE_LABELS, NODE_TYPES


def write_nodes(old: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """``new`` over ``old`` by id; a row that isn't of the kind stops the job when it is read."""
    if kind not in NODE_TYPES:
        raise ValueError(f"no node type {kind}")
    wrong = F.coalesce(F.col("node_type") != NODE_TYPES[kind], F.lit(True))
    return upsert(old, new.withColumn("node_type", F.when(wrong, F.raise_error(F.concat(F.lit(f"not a {kind}: "), F.col("id").cast("string"))).cast("int")).otherwise(F.col("node_type"))), ["id"])


def write_typed_edges(old: DataFrame, new: DataFrame, label: str, nodes: DataFrame, src_types: tuple[str, ...] = (), dst_types: tuple[str, ...] = ()) -> DataFrame:
    """Edges (src, dst) of one label over ``old`` (src, dst, label, ...), only between nodes that exist and have the given types."""
    if label not in EDGE_LABELS:
        raise ValueError(f"no edge label {label}")
    of = lambda types: nodes.where(F.col("node_type").isin(*[NODE_TYPES[t] for t in types])) if types else nodes
    typed = new.join(of(src_types).select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(of(dst_types).select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return upsert(old, write_edges(typed.withColumn("label", F.lit(label)), nodes), ["src", "dst", "label"])


def collections(vectors: DataFrame) -> DataFrame:
    """(collection, n): the collections that hold vectors."""
    return with_embedding(vectors).where("collection is not null").groupBy("collection").agg(F.countDistinct("id").alias("n"))


def has_collection(vectors: DataFrame, name: str) -> bool:
    return not vectors.where(F.col("collection") == name).isEmpty()


def drop_collection(vectors: DataFrame, name: str) -> DataFrame:
    return vectors.where(~F.coalesce(F.col("collection") == name, F.lit(False)))


def delete_chunks(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    """Vectors without those of ``gone`` (collection, id)."""
    return vectors.join(gone.select("collection", "id").distinct(), ["collection", "id"], "left_anti")
