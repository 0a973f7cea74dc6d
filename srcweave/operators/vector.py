"""Vector search: exact top-k, several query vectors merged by their best score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcweave.functions.vectors import METRICS

#: Rows of a block of vectors and of queries that are scored against each other at once.
BLOCK, QUERY_BLOCK = 2_048, 256


def keyword_filter(df: DataFrame, where: dict[str, object]) -> DataFrame:
    for name, value in where.items():
        df = df.where(F.col(name).cast("string") == str(value))
    return df


def _blocks(rows: DataFrame, key: str, key_type: str, size: int, name: str) -> DataFrame:
    """Rows (key, v) packed into blocks of vectors of one length: (<name>_keys, <name>_width, <name>_data)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for width, same in b.groupby(b["v"].map(len)):
                same = same.sort_values(key)
                for i in range(0, len(same), size):
                    part = same.iloc[i : i + size]
                    out.append((list(part[key]), width, np.array(list(part["v"]), dtype=np.float64).tobytes()))
            yield pd.DataFrame(out, columns=[f"{name}_keys", f"{name}_width", f"{name}_data"])

    return rows.mapInPandas(pack, f"{name}_keys array<{key_type}>, {name}_width int, {name}_data binary")


def top_k(vectors: DataFrame, queries: DataFrame | list[list[float]], k: int = 10, metric: str = "cosine", id_col: str = "id", vector_col: str = "embedding", least: float | None = None) -> DataFrame:
    """(query, id, score, rank): the k best ids of each query, ties by id; vectors of another length, null or zero are left out.

    ``queries`` is a table (query, vector) of any size, or a list whose places are the queries. Blocks of vectors
    are scored against blocks of queries; only the k best of each block and query are shuffled. Of an id with several
    usable vectors one is taken.
    """
    if not isinstance(queries, DataFrame):
        queries = vectors.sparkSession.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(queries)], "query int, vector array<double>")
    usable = lambda c: (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x)) & (F.exists(c, lambda x: x != 0) if metric == "cosine" else F.lit(True))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v"))).where("id is not null").dropDuplicates(["id"])
    asked = queries.select("query", F.col("vector").cast("array<double>").alias("v")).where(usable(F.col("v")))
    id_type, query_type = rows.schema["id"].dataType.simpleString(), asked.schema["query"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, width, data, qs, q_width, q_data in zip(b["v_keys"], b["v_width"], b["v_data"], b["q_keys"], b["q_width"], b["q_data"]):
                if width != q_width:
                    continue
                x, q = np.frombuffer(data).reshape(-1, width).T, np.frombuffer(q_data).reshape(-1, width).T
                s, xx, qq = np.zeros((q.shape[1], x.shape[1])), np.zeros(x.shape[1]), np.zeros(q.shape[1])
                with np.errstate(all="ignore"):
                    for u, w in zip(x, q):  # summed in the order of the dimensions, so equal vectors score the same
                        s += (u[None] - w[:, None]) ** 2 if metric == "euclid" else u[None] * w[:, None]
                        xx += u * u
                        qq += w * w
                    s = s / (np.sqrt(xx)[None] * np.sqrt(qq)[:, None]) if metric == "cosine" else -np.sqrt(s) if metric == "euclid" else s
                    at = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ids are in order, so ties are too
                best = np.take_along_axis(s, at, 1).ravel()
                keep = ~np.isnan(best) if least is None else best >= least
                yield pd.DataFrame({"query": np.repeat(np.asarray(qs), at.shape[1])[keep], "id": np.asarray(ids)[at.ravel()][keep], "score": best[keep]})

    if metric not in METRICS:
        raise KeyError(metric)
    pairs = _blocks(rows, "id", id_type, BLOCK, "v").crossJoin(_blocks(asked, "query", query_type, QUERY_BLOCK, "q"))
    found = pairs.mapInPandas(score, f"query {query_type}, id {id_type}, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def best_of(hits: DataFrame, k: int) -> DataFrame:
    """(id, score, query): each id's best score and the earliest query that gives it, the k best ids."""
    best = hits.groupBy("id").agg(F.max(F.struct("score", (-F.col("query")).alias("q"))).alias("b"))
    return best.select("id", F.col("b.score").alias("score"), (-F.col("b.q")).alias("query")).orderBy(F.desc("score"), "id").limit(k)


def text_column(with_context: Column, without: Column) -> Column:
    """One row per embedding text: with context, and for conditionals and loops also without."""
    return F.when(F.col("chunk_type").isin("conditional", "loop"), F.array(with_context, without)).otherwise(F.array(with_context))
