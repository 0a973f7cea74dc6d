"""Registered queries of the index build over the sources of the chunks, the summary store and typed writers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcweave.functions import text as X
from srcweave.operators import graph as G
from srcweave.operators import pipeline as P
from srcweave.operators import reader as R
from srcweave.operators import summary as M
from srcweave.operators import writers as W
from srcweave.plans.core import GRAPH, WHOLE, _calls, _node, _reach, query
from srcweave.session import table
from srcweave.sources import files as FS
from srcweave.sources import star as S


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """One text per file row with its place."""
    chunks = table(spark, sf, "chunks").where("chunk_type = 'file' and content is not null").groupBy("file_id").agg(F.min("content").alias("content"))
    files = table(spark, sf, "files").groupBy("file_id").agg(F.min_by(F.struct("repo", "path", "module"), F.struct("repo", "path")).alias("f"))
    return chunks.join(files, "file_id").select("file_id", "f.repo", "f.path", "f.module", "content")


@query("d09_graph_by_language", None)
def d09_all(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes by type and edges by label of every language's sources."""
    src = _sources(spark, sf)
    rows = P.parse_sources(src).join(src.select("file_id", X.language_of_path(F.col("path")).alias("language")), "file_id")
    return rows.groupBy("language", "kind", F.coalesce(F.col("node_type").cast("string"), F.col("label")).alias("what")).agg(F.count("*").alias("n"))


@query("d01_index", None)
def d01(spark: SparkSession, sf: str) -> DataFrame:
    """The index of all pending files: nodes, edges by label and chunks per repository."""
    src = _sources(spark, sf)
    ix = P.build_index(src, table(spark, sf, "file_versions"))
    at = src.select("file_id", "repo")
    rows = ix.nodes.select("file_id", F.lit("node").alias("what")).unionByName(ix.edges.select(F.when(F.col("src") < F.lit(1 << 32), F.col("src")).otherwise(F.shiftright("src", 32)).cast("int").alias("file_id"), F.col("label").alias("what"))).unionByName(ix.chunks.select("file_id", F.concat(F.lit("chunk "), "chunk_type").alias("what")))
    return rows.groupBy("file_id", "what").agg(F.count("*").alias("n")).join(at, "file_id").groupBy("repo", "what").agg(F.sum("n").alias("n"))


@query("g24_resolved", None)
def g24(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved calls and parents of all files, by the names of their ends."""
    ix = P.build_index(_sources(spark, sf))
    names = ix.nodes.select("id", "name")
    made = ix.edges.where("label in ('INHERITS', 'CALLS_FUNCTION')").join(names.select(F.col("id").alias("src"), F.col("name").alias("source")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("target")), "dst")
    return made.groupBy("label", "source", "target").agg(F.count("*").alias("n"))


@query("g04_parsed_callgraph", None)
def g04_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Callees up to two steps of the first function of every repository, over the parsed sources."""
    src = _sources(spark, sf)
    ix = P.build_index(src)
    first = ix.nodes.where("node_type = 7").join(src.select("file_id", "repo"), "file_id").groupBy("repo").agg(F.min("id").alias("root")).select("root", F.col("root").alias("id"))
    return G.call_graph(G.Calls.of(ix.nodes, ix.edges), first, "outgoing", 2).nodes


@query("d02_file_contexts", "WITH c AS (SELECT file_id, min(content) AS content FROM chunks WHERE chunk_type = 'file' AND content IS NOT NULL GROUP BY file_id), f AS (SELECT DISTINCT repo || '/' || path AS path, sha256(content) AS file_sha FROM c JOIN files USING (file_id)), m AS (SELECT DISTINCT repo || '/' || path AS path FROM files WHERE module IS NULL OR module = '') SELECT path, file_sha, path IN (SELECT path FROM m) AS ephemeral, CASE WHEN path NOT IN (SELECT path FROM m) THEN 'head' END AS commit_id FROM f")
def d02(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts of all sources at a head, where the files without module count as modified."""
    src = _sources(spark, sf).withColumn("path", F.concat("repo", F.lit("/"), "path"))
    modified = table(spark, sf, "files").where("module is null or module = ''").select(F.concat("repo", F.lit("/"), "path").alias("path"))
    every = src.select("path", F.lit("s").alias("sha"))
    known = table(spark, sf, "file_versions").select("file_id", "file_sha", "relative_path", "commit_id").distinct()
    return P.file_contexts(src.select("path", "content"), known, modified, every, head="head").select("path", "file_sha", "ephemeral", "commit_id")


# ---------------------------------------------------------------- summaries


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").where("docstring is not null and id is not null")
    return c.groupBy(F.col("id").alias("entity_id"), F.col("chunk_type").alias("entity_type")).agg(F.min("name").alias("entity_name"), F.min("file_path").alias("file_path"), F.min("docstring").alias("summary"), F.timestamp_seconds(F.min("start_line")).alias("updated_at"))


SUMMARIES = "sums AS (SELECT id AS entity_id, chunk_type AS entity_type, min(name) AS entity_name, min(file_path) AS file_path, min(docstring) AS summary, min(start_line) AS line FROM chunks WHERE docstring IS NOT NULL AND id IS NOT NULL GROUP BY id, chunk_type)"


@query("s20_summaries_of_file", f"WITH {SUMMARIES} SELECT entity_id, summary, (row_number() OVER (ORDER BY entity_type, entity_name NULLS FIRST, entity_id))::INT AS place FROM sums WHERE file_path = (SELECT min(file_path) FROM sums WHERE entity_type = 'function') AND entity_type = 'function'")
def s20_file(spark: SparkSession, sf: str) -> DataFrame:
    s = _summaries(spark, sf)
    path = s.where("entity_type = 'function'").agg(F.min("file_path")).first()[0]
    hit = M.find_summaries(s, file_path=path, entity_type="function")
    return hit.select("entity_id", "summary", F.row_number().over(Window.partitionBy("entity_type").orderBy("entity_name", "entity_id")).alias("place"))


@query("s20_recent_summaries", f"WITH {SUMMARIES} SELECT entity_id, entity_type FROM sums WHERE line > 60")
def s20_recent(spark: SparkSession, sf: str) -> DataFrame:
    return M.find_summaries(_summaries(spark, sf), since=F.timestamp_seconds(F.lit(60))).select("entity_id", "entity_type")


@query("k16_delete_summaries", f"WITH {SUMMARIES} SELECT entity_id, entity_type FROM sums WHERE NOT (entity_type = 'class' AND coalesce(file_path = (SELECT min(file_path) FROM sums WHERE entity_type = 'class'), false))")
def k16(spark: SparkSession, sf: str) -> DataFrame:
    s = _summaries(spark, sf)
    path = s.where("entity_type = 'class'").agg(F.min("file_path")).first()[0]
    return M.delete_summaries(s, entity_type="class", file_path=path).select("entity_id", "entity_type")


@query("j16_with_summaries", f"WITH {SUMMARIES} SELECT c.id AS entity_id, s.summary FROM (SELECT DISTINCT id FROM chunks WHERE chunk_type = 'function') c LEFT JOIN (SELECT * FROM sums WHERE entity_type = 'function') s ON s.entity_id = c.id")
def j16(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "chunks").where("chunk_type = 'function'").select(F.col("id").alias("entity_id")).distinct()
    return M.with_summaries(f, _summaries(spark, sf), "function")


@query("a19_top_imports", "WITH i AS (SELECT DISTINCT repo, CASE WHEN module IS NULL OR module = '' THEN './' || path ELSE module END AS name FROM files) SELECT repo, name, (row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN name LIKE '.%' OR name LIKE '/%' THEN 0 ELSE 1 END, name))::INT AS place FROM i QUALIFY place <= 20")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    """Modules stand for imports, files without one for local imports."""
    name = F.when(F.coalesce("module", F.lit("")) == "", F.concat(F.lit("./"), "path")).otherwise(F.col("module"))
    return M.top_imports(table(spark, sf, "files").select("repo", name.alias("name")), "repo")


@query(
    "o09_budget",
    """WITH i AS (SELECT DISTINCT file_id AS key, id, coalesce(name, '') AS name, coalesce(docstring, '') AS summary FROM chunks WHERE chunk_type = 'function'), p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id, name, summary) AS place, count(*) OVER (PARTITION BY key) AS n, sum(length(name) + length(summary) + 10) OVER (PARTITION BY key) AS total, FROM i), q AS (SELECT *, 600 // n AS share, greatest(600 // n - length(name) - 10, 0) AS room FROM p)
SELECT key, place::INT AS place, name, CASE WHEN total <= 600 OR share < 50 OR length(summary) <= room THEN summary WHEN room > 3 THEN substr(summary, 1, room - 3) || '...' ELSE substr(summary, 1, room) END AS summary FROM q WHERE total <= 600 OR share >= 50 OR place <= 12""",
)
def o09(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "chunks").where("chunk_type = 'function'").select(F.col("file_id").alias("key"), "id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("docstring", F.lit("")).alias("summary")).distinct()
    return M.fit_budget(i.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("id", "name", "summary"))), 600)


@query("o06_folder_order", "WITH d AS (SELECT DISTINCT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS path FROM files) SELECT path, len(list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.'))::INT AS depth FROM d")
def o06(spark: SparkSession, sf: str) -> DataFrame:
    return M.deepest_first(table(spark, sf, "files").select(X.dir_name(F.col("path")).alias("path")).distinct())


@query("f31_levels", "SELECT DISTINCT chunk_type, CASE chunk_type WHEN 'function' THEN 1 WHEN 'class' THEN 2 WHEN 'file' THEN 3 ELSE 0 END AS number, CASE level WHEN 1 THEN 'function' WHEN 2 THEN 'class' WHEN 3 THEN 'file' WHEN 4 THEN 'folder' WHEN 5 THEN 'project' ELSE '' END AS name FROM chunks")
def f31(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("chunk_type", F.coalesce(M.level_number(F.col("chunk_type")), F.lit(0)).alias("number"), F.coalesce(M.level_name(F.col("level")), F.lit("")).alias("name")).distinct()


# ---------------------------------------------------------------- lookups, predicates and writers


@query("rd12_class_in_module", f"WITH {GRAPH} SELECT c.id, c.name FROM cls c JOIN files_ USING (file_id) WHERE repo = 'ASIA' AND c.name = (SELECT min(c.name) FROM cls c JOIN files_ USING (file_id) WHERE repo = 'ASIA')")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    name = R.find_classes(g.nodes, g.files, repo="ASIA", limit=1).first()["name"]
    return R.class_in_module(g.nodes, g.edges, name, "mod_asia").select("id", "name")


@query("rd11_classes_with_inheritance", f"WITH {GRAPH} SELECT c.id AS class_id, c.name, p.name AS parent FROM cls c LEFT JOIN inh ON inh.src = c.id LEFT JOIN cls p ON p.id = inh.dst")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return R.classes_with_inheritance(g.nodes, g.edges).select("class_id", "name", F.explode_outer("parents").alias("parent"))


@query("rd19_lines", "SELECT DISTINCT id, array_to_string(string_split(content, chr(10))[3:least(7, len(string_split(content, chr(10))))], chr(10)) AS code FROM chunks WHERE content IS NOT NULL AND len(string_split(content, chr(10))) > 2")
def p19(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").where("content is not null").select("id", "content").distinct()
    return c.select("id", X.lines_between(F.col("content"), F.lit(2), F.lit(6)).alias("code")).where("code is not null").distinct()


@query("s05_files_to_parse", "SELECT file_id FROM files JOIN repos ON repo = name WHERE NOT regexp_matches(files.path, '\\.git|node_modules|\\.vscode|\\.idea|vendor|target|build|dist|__pycache__|\\.pytest_cache|coverage|site-packages') AND lower(regexp_extract(files.path, '(\\.[^./]+)$', 1)) IN ('.go','.py','.java','.js','.jsx','.ts','.tsx','.cs') AND (NOT coalesce(skip_other_languages, false) OR CASE lower(trim(repos.language)) WHEN 'golang' THEN 'go' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'cs' THEN 'csharp' WHEN 'c#' THEN 'csharp' ELSE lower(trim(repos.language)) END = CASE lower(regexp_extract(files.path, '(\\.[^./]+)$', 1)) WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.cs' THEN 'csharp' END) AND file_id NOT IN (SELECT file_id FROM files WHERE module = '')")
def s05(spark: SparkSession, sf: str) -> DataFrame:
    """Files without a module name count as indexed at their id as time."""
    f = table(spark, sf, "files").withColumn("modified", F.col("file_id"))
    r = table(spark, sf, "repos").withColumn("test", F.lit(None).cast("string"))
    return FS.parse_files(f, r, f.where("module = ''")).select("file_id")


@query("a15_impact_totals", f"WITH RECURSIVE {GRAPH}, {_reach('ce', '(SELECT id FROM fn WHERE p_partkey = 7)', 3, False)} SELECT (SELECT id FROM fn WHERE p_partkey = 7) AS root, count(*) AS total, count(*) AS by_calls, 0::BIGINT AS by_data, max(d)::INT AS deepest FROM (SELECT id, min(d) AS d FROM r GROUP BY id) WHERE d > 0")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    g, calls = _calls(spark, sf)
    return M.impact_totals(G.impact(calls, g.edges, g.nodes, _node(g, 7, 2_000_000, 7)))


@query("k04_typed_edges", f"WITH {WHOLE} SELECT DISTINCT src, dst, label FROM all_edges WHERE label = 'INHERITS' UNION SELECT src, dst, 'CALLS' FROM ce")
def k04(spark: SparkSession, sf: str) -> DataFrame:
    """Inheritance as the store, function to function calls written over it with the types of both ends checked."""
    g = S.star_graph(spark, sf)
    old = g.edges.where("label = 'INHERITS'").distinct()
    calls = G.call_edges(g.nodes, g.edges).select("src", "dst").distinct()
    return W.write_typed_edges(old, calls, "CALLS", g.nodes, ("Function",), ("Function",)).select("src", "dst", "label")


@query("k05_typed_nodes", f"WITH {GRAPH} SELECT id, name, 'new' AS source FROM cls")
def k05(spark: SparkSession, sf: str) -> DataFrame:
    c = S.star_graph(spark, sf).of_type(8).select("id", "node_type", "name")
    return W.write_nodes(c.withColumn("source", F.lit("old")), c.withColumn("source", F.lit("new")), "Class").select("id", "name", "source")


@query("k12_collections", "WITH v AS (SELECT DISTINCT collection, id FROM vectors WHERE collection IS NOT NULL AND len(embedding) > 0), m AS (SELECT min(collection) AS lo, max(collection) AS hi FROM v) SELECT collection, count(*) AS n FROM v, m WHERE collection <> lo AND NOT (collection = hi AND id = (SELECT min(id) FROM v WHERE collection = (SELECT max(collection) FROM v))) GROUP BY collection")
def k12(spark: SparkSession, sf: str) -> DataFrame:
    """The collections left after dropping the first and deleting one chunk of the last."""
    v = table(spark, sf, "vectors").where("size(embedding) > 0 and collection is not null").select("collection", "id", "embedding")
    ends = v.agg(F.min("collection").alias("lo"), F.max("collection").alias("hi")).first()
    gone = v.where(F.col("collection") == ends["hi"]).groupBy("collection").agg(F.min("id").alias("id"))
    return W.collections(W.delete_chunks(W.drop_collection(v, ends["lo"]), gone))
