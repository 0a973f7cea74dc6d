"""Index build as composable stages: file contexts, pending files, chunks, code graphs, resolved inheritance and calls."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcweave.functions.text import language_of_path, last_segment, sha256
from srcweave.operators import ingest, postprocess, store
from srcweave.operators.codegraph import brace_graph
from srcweave.session import Scratch


def file_contexts(files: DataFrame, known: DataFrame, modified: DataFrame | None = None, commits: DataFrame | None = None, head: str | None = None, is_repository: bool = True) -> DataFrame:
    """(file_id, path, content, file_sha, ephemeral, commit_id) of (path, content), with ids from the ``known`` versions.

    A file is ephemeral if it is in ``modified`` (path), has no last commit in ``commits`` (path, sha), or there is no
    repository; others carry ``head`` if given, else their last commit. Repeated rows count once.
    """
    rows = files.where("path is not null and content is not null").select("path", "content").distinct().withColumn("file_sha", sha256(F.col("content")))
    changed = modified.select("path").distinct().withColumn("_m", F.lit(True)) if modified is not None else rows.limit(0).select("path", F.lit(True).alias("_m"))
    last = commits.groupBy("path").agg(F.min("sha").alias("_sha")) if commits is not None else rows.limit(0).select("path", F.lit("").alias("_sha"))
    joined = rows.join(changed, "path", "left").join(last, "path", "left")
    commit = F.when(F.col("_m") | F.lit(not is_repository), F.lit(None)).otherwise(F.lit(head) if head else F.col("_sha")).cast("string")
    at = joined.withColumn("commit_id", commit).select("path", "content", "file_sha", "commit_id", F.col("commit_id").isNull().alias("ephemeral"))
    at = Scratch(files.sparkSession).keep(at)
    ids = store.assign_file_ids(known, at.withColumnRenamed("path", "relative_path")).groupBy("file_sha", "relative_path", "commit_id").agg(F.min("file_id").alias("file_id"))
    same = (at["file_sha"] == ids["file_sha"]) & (at["path"] == ids["relative_path"]) & at["commit_id"].eqNullSafe(ids["commit_id"])
    return at.join(ids, same).select("file_id", "path", "content", at["file_sha"], "ephemeral", at["commit_id"])


def parse_sources(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Nodes and edges (column ``kind``) of Python, Go, Java and C# sources (file_id, path, content); others give none."""
    names = [c.split()[0] for c in ingest.GRAPH.split(", ")]

    def gen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, lang, t in zip(b["file_id"], b["lang"], b["content"]):
                rows = ingest.graph_of(int(i), t) if lang == "python" else brace_graph(lang, int(i), t)
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("id", "src", "dst")} | {c: "Int32" for c in ("node_type", "file_id", "sl", "el", "position")})

    use = files.select("file_id", language_of_path(F.col(path_col)).alias("lang"), "content").where("file_id is not null and content is not null and lang in ('python', 'go', 'java', 'csharp')")
    return use.mapInPandas(gen, ingest.GRAPH)


def resolve_by_name(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(call_site, dst): calls (id, file_id, repo, module, name) to functions (id, file_id, repo, module, name) of their last name.

    A function of the same file wins, then of the same module, then of the repository, the smallest id among several; each
    step joins one row per key, so frequent names don't multiply. Calls without a function stay unresolved.
    """
    c = calls.select(F.col("id").alias("call_site"), "file_id", "repo", "module", last_segment("name").alias("name"))
    best = lambda *keys: functions.groupBy(*keys).agg(F.min("id").alias("_".join(keys)))
    out = c.join(best("file_id", "name"), ["file_id", "name"], "left").join(best("repo", "module", "name"), ["repo", "module", "name"], "left").join(best("repo", "name"), ["repo", "name"], "left")
    return out.select("call_site", F.coalesce("file_id_name", "repo_module_name", "repo_name").alias("dst")).where("dst is not null")


@dataclass
class Index:
    nodes: DataFrame  # id, node_type, file_id, name, sl, el, extends
    edges: DataFrame  # src, dst, label, position
    chunks: DataFrame


def build_index(files: DataFrame, done: DataFrame | None = None) -> Index:
    """Index of (file_id, path, content, repo, module): files with a version of status done in ``done`` are left out.

    Nodes and edges are written once before the resolution reads them; inheritance and calls are resolved for all repositories
    at once and join the edges as INHERITS and CALLS_FUNCTION, once each and only between nodes that exist.
    """
    todo = store.pending_files(files, done) if done is not None else files
    todo = todo.dropDuplicates(["file_id"])
    graph = Scratch(files.sparkSession).keep(parse_sources(todo))
    nodes = graph.where("kind = 'node'").select("id", "node_type", "file_id", "name", "sl", "el", "extends")
    edges = graph.where("kind = 'edge'").select("src", "dst", "label", "position")
    place = todo.select("file_id", "repo", F.coalesce("module", F.lit("")).alias("module"))
    placed = nodes.join(place, "file_id")
    inherits = postprocess.resolve_inheritance(placed.where("node_type = 8")).withColumn("label", F.lit("INHERITS"))
    calls = resolve_by_name(placed.where("node_type = 10"), placed.where("node_type = 7")).select(F.col("call_site").alias("src"), "dst", F.lit("CALLS_FUNCTION").alias("label"))
    edges = edges.unionByName(inherits.unionByName(calls).withColumn("position", F.lit(None).cast("int")))
    return Index(nodes, edges, ingest.chunk_files(todo))
