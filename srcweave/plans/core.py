"""Registered queries of the core operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcweave.functions import text as X
from srcweave.operators import churn as C
from srcweave.operators import graph as G
from srcweave.operators import hierarchy as H
from srcweave.operators import ingest as I
from srcweave.operators import postprocess as PP
from srcweave.operators import reader as R
from srcweave.operators import store as T
from srcweave.operators import vector as V
from srcweave.session import Scratch, table
from srcweave.sources import files as FS
from srcweave.sources import star as S

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


CLEAN = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(12288))), '')"
LINKS_SQL = f"""
pairs AS (SELECT DISTINCT {CLEAN.format('id')} AS id, {CLEAN.format('parent_id')} AS parent FROM chunks WHERE {CLEAN.format('id')} IS NOT NULL),
links AS (SELECT p.id, min(k.id) AS parent FROM pairs p LEFT JOIN (SELECT DISTINCT id FROM pairs) k ON p.parent = k.id GROUP BY p.id),
tree AS (SELECT id, id AS root_id, 0 AS depth, id AS path, [id] AS chain FROM links WHERE parent IS NULL
  UNION ALL SELECT l.id, t.root_id, t.depth + 1, t.path || '/' || l.id, list_append(t.chain, l.id) FROM tree t JOIN links l ON l.parent = t.id),
below AS (SELECT a AS id, count(*) - 1 AS n FROM (SELECT unnest(chain) AS a FROM tree) GROUP BY a)"""


@query(
    "p7_found",
    f"""WITH RECURSIVE {LINKS_SQL}
SELECT l.id, coalesce(t.root_id, 'cycle') AS root_id, coalesce(t.depth, -1)::INT AS depth, coalesce(b.n, -1)::INT AS n_descendants
FROM links l LEFT JOIN tree t ON l.id = t.id LEFT JOIN below b ON l.id = b.id""",
)
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return H.hierarchy(table(spark, sf, "chunks"))


@query(
    "p7_paths",
    f"""WITH RECURSIVE {LINKS_SQL}
SELECT l.id, coalesce(t.root_id, 'cycle') AS root_id, coalesce(t.depth, -1)::INT AS depth, coalesce(b.n, -1)::INT AS n_descendants, t.path
FROM links l LEFT JOIN tree t ON l.id = t.id LEFT JOIN below b ON l.id = b.id""",
)
def p7_paths(spark: SparkSession, sf: str) -> DataFrame:
    return H.hierarchy(table(spark, sf, "chunks"), with_path=True)


@query(
    "p7_descendants",
    f"""WITH RECURSIVE {LINKS_SQL}
SELECT a AS ancestor_id, id AS descendant_id, (depth - list_position(chain, a) + 1)::INT AS distance
FROM (SELECT id, depth, chain, unnest(chain) AS a FROM tree) WHERE a <> id""",
)
def p7_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return H.descendants(table(spark, sf, "chunks"))


# ---------------------------------------------------------------- the star-schema graph

GRAPH = """
sizes AS MATERIALIZED (SELECT (SELECT count(*) FROM supplier) AS ns, (SELECT count(*) FROM part) AS np),
sup AS (SELECT s_suppkey AS k, (s_nationkey + 1)::INT AS file_id, s_name AS name FROM supplier),
files_ AS (SELECT (n_nationkey + 1)::INT AS file_id, r_name AS repo, lower(r_name) || '/' || lower(n_name) || '.' || (['go','py','java','js','cs'])[n_nationkey % 5 + 1] AS path,
  (['go','python','java','javascript','csharp'])[n_nationkey % 5 + 1] AS language FROM nation JOIN region ON n_regionkey = r_regionkey),
cls AS (SELECT (file_id::BIGINT << 32) + 1000000 + k AS id, file_id, name, k FROM sup),
fn AS (SELECT (s.file_id::BIGINT << 32) + 2000000 + p_partkey AS id, s.file_id, p_name AS name, (p_partkey % 500)::INT AS sl, (p_partkey % 500 + p_size)::INT AS el,
  (s.file_id::BIGINT << 32) + 1000000 + s.k AS class_id, s.name AS class_name, (s.file_id::BIGINT << 32) + 4000000 + p_partkey AS block, p_partkey FROM (SELECT *, p_partkey % ns AS owner FROM part, sizes) JOIN sup s ON owner = s.k),
small AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn, l_orderkey % np AS caller FROM lineitem, sizes WHERE l_quantity <= 4),
calls AS (SELECT 4611686018427387904 + l_orderkey * 64 + rn AS call_site, f.id AS src, g.id AS dst, l_suppkey, l_returnflag, l_discount FROM small JOIN fn f ON caller = f.p_partkey JOIN fn g ON l_partkey = g.p_partkey),
ce AS (SELECT DISTINCT src, dst FROM calls),
touched AS (SELECT src AS method, (s.file_id::BIGINT << 32) + 200000000 + l_suppkey * 4 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS field, l_discount < 0.03 AS writes FROM calls JOIN sup s ON l_suppkey = s.k),
ord AS (SELECT ((c_nationkey + 1)::BIGINT << 32) + 100000000 + o_orderkey AS id, o_custkey, o_orderdate, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
flow AS (SELECT id AS src, lead(id) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM ord QUALIFY dst IS NOT NULL),
inh AS (SELECT c.id AS src, p.id AS dst FROM cls c JOIN cls p ON p.k = (c.k - 1) // 2 WHERE c.k > 0)"""
#: All nodes and edges of the graph.
WHOLE = GRAPH + """,
fields_ AS (SELECT DISTINCT t.field, (t.field >> 32)::INT AS file_id, s.id AS owner, 'flag_' || l_returnflag AS name FROM (SELECT (s.file_id::BIGINT << 32) + 200000000 + l_suppkey * 4 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS field, l_suppkey, l_returnflag FROM calls JOIN sup s ON l_suppkey = s.k) t JOIN cls s ON s.k = l_suppkey),
sites AS (SELECT c.call_site, c.src, c.dst, f.block, f.file_id, g.name, (s.file_id::BIGINT << 32) + 200000000 + l_suppkey * 4 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS field, l_discount < 0.03 AS writes FROM calls c JOIN fn f ON c.src = f.id JOIN fn g ON c.dst = g.id JOIN sup s ON l_suppkey = s.k),
all_nodes AS (SELECT file_id::BIGINT AS id, 'FileScope' AS label, file_id, path AS name, NULL::INT AS sl, NULL::INT AS el FROM files_ UNION ALL SELECT (file_id::BIGINT << 32) + 1, 'ModuleScope', file_id, 'mod_' || lower(repo), NULL, NULL FROM files_
  UNION ALL SELECT id, 'Class', file_id, name, NULL, NULL FROM cls UNION ALL SELECT id, 'Function', file_id, name, sl, el FROM fn UNION ALL SELECT call_site, 'FunctionCall', file_id, name, NULL, NULL FROM sites UNION ALL SELECT field, 'Field', file_id, name, NULL, NULL FROM fields_
  UNION ALL SELECT id, 'Variable', (id >> 32)::INT, 'order_' || o_orderkey, NULL, NULL FROM ord UNION ALL SELECT DISTINCT block, 'Block', file_id, 'block', NULL::INT, NULL::INT FROM sites),
all_edges AS (SELECT file_id::BIGINT AS src, (file_id::BIGINT << 32) + 1 AS dst, 'CONTAINS' AS label FROM files_ UNION ALL SELECT (file_id::BIGINT << 32) + 1, id, 'CONTAINS' FROM cls UNION ALL SELECT class_id, id, 'CONTAINS' FROM fn UNION ALL SELECT class_id, id, 'HAS_FIELD' FROM fn UNION ALL SELECT owner, field, 'CONTAINS' FROM fields_
  UNION ALL SELECT owner, field, 'HAS_FIELD' FROM fields_ UNION ALL SELECT DISTINCT src, block, 'CONTAINS' FROM sites UNION ALL SELECT block, call_site, 'CONTAINS' FROM sites UNION ALL SELECT call_site, dst, 'CALLS_FUNCTION' FROM sites UNION ALL SELECT src, dst, 'INHERITS' FROM inh
  UNION ALL SELECT call_site, field, 'HAS_FIELD' FROM sites UNION ALL SELECT call_site, field, 'DATA_FLOW' FROM sites WHERE writes UNION ALL SELECT src, dst, 'DATA_FLOW' FROM flow)"""
FN7, VAR0, CLS1 = "(SELECT id FROM fn WHERE p_partkey = 7)", "(SELECT id FROM ord WHERE o_orderkey = 0)", "(SELECT id FROM cls WHERE k = 1)"


def _reach(edges: str, seed: str, depth: int | None, forward: bool = True) -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    if depth is None:
        return f"r(id, d) AS (SELECT {seed}, 0 UNION ALL SELECT e.{b}, d + 1 FROM r JOIN {edges} e ON e.{a} = r.id)"
    return f"r(id, d) AS (SELECT {seed}, 0 UNION SELECT e.{b}, d + 1 FROM r JOIN {edges} e ON e.{a} = r.id WHERE d < {depth})"


def _node(g: S.Graph, kind: int, offset: int, key: int) -> DataFrame:
    hit = g.nodes.where((F.col("node_type") == kind) & (F.col("id") % F.lit(1 << 32) == offset + key))
    return hit.select(F.col("id").alias("root"), "id")


def _graph(spark: SparkSession, sf: str) -> tuple[S.Graph, DataFrame]:
    g = S.star_graph(spark, sf)
    return g, Scratch(spark).keep(G.call_edges(g.nodes, g.edges))


def _calls(spark: SparkSession, sf: str) -> tuple[S.Graph, G.Calls]:
    g = S.star_graph(spark, sf)
    return g, G.Calls.of(g.nodes, g.edges)


@query("s12_nodes_by_type", f"WITH {GRAPH} SELECT 7 AS node_type, count(*) AS n FROM fn UNION ALL SELECT 8, count(*) FROM cls UNION ALL SELECT 2, count(*) FROM files_ UNION ALL SELECT 4, count(*) FROM ord UNION ALL SELECT 9, count(DISTINCT field) FROM touched")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    return S.star_graph(spark, sf).of_type(2, 4, 7, 8, 9).groupBy("node_type").agg(F.count("*").alias("n"))


@query("g01_closure", f"""WITH {GRAPH} SELECT f.class_id AS anc, c.call_site AS "desc", 3 AS depth FROM calls c JOIN fn f ON c.src = f.id UNION ALL SELECT src, call_site, 2 FROM calls""")
def g01(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    c = G.closure(g.labelled("CONTAINS"))
    calls = g.of_type(10).select(F.col("id").alias("desc"))
    ends = g.of_type(7, 8).select(F.col("id").alias("anc"))
    return c.join(calls, "desc", "left_semi").join(ends, "anc", "left_semi").select("anc", "desc", "depth")


@query("g02_call_edges", f"WITH {GRAPH} SELECT src, dst, call_site FROM calls")
def g02(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)[1]


@query("g04_callgraph_out", f"WITH RECURSIVE {GRAPH}, {_reach('ce', FN7, 3)} SELECT r.id, name, min(d)::INT AS depth FROM r JOIN fn ON fn.id = r.id GROUP BY ALL")
def g04(spark: SparkSession, sf: str) -> DataFrame:
    g, calls = _calls(spark, sf)
    r = G.call_graph(calls, _node(g, 7, 2_000_000, 7), "outgoing", 3)
    return r.nodes.join(g.of_type(7).select("id", "name"), "id").select("id", "name", "depth")


@query("g04_callgraph_in", f"WITH RECURSIVE {GRAPH}, {_reach('ce', FN7, 2, False)} SELECT id, -min(d)::INT AS depth FROM r GROUP BY id")
def g04_in(spark: SparkSession, sf: str) -> DataFrame:
    g, calls = _calls(spark, sf)
    return G.call_graph(calls, _node(g, 7, 2_000_000, 7), "incoming", 2).nodes.select("id", "depth")


@query("g04_callgraph_edges", f"WITH RECURSIVE {GRAPH}, {_reach('ce', FN7, 2)} SELECT src, dst, call_site FROM calls WHERE src IN (SELECT id FROM r GROUP BY id HAVING min(d) < 2)")
def g04_edges(spark: SparkSession, sf: str) -> DataFrame:
    g, calls = _calls(spark, sf)
    return G.call_graph(calls, _node(g, 7, 2_000_000, 7), "outgoing", 2).edges.select("src", "dst", "call_site")


@query(
    "g04_callgraph_both",
    f"""WITH RECURSIVE {GRAPH}, o(id, d) AS (SELECT {FN7}, 0 UNION SELECT dst, d + 1 FROM o JOIN ce ON src = id WHERE d < 2), od AS (SELECT id, min(d) AS d FROM o GROUP BY id),
i(id, d) AS (SELECT {FN7}, 0 UNION SELECT ce.src, d + 1 FROM i JOIN ce ON dst = i.id WHERE d < 2 AND ce.src NOT IN (SELECT id FROM od))
SELECT id, d::INT AS depth FROM od UNION ALL SELECT id, -min(d)::INT FROM i WHERE d > 0 GROUP BY id""",
)
def g04_both(spark: SparkSession, sf: str) -> DataFrame:
    g, calls = _calls(spark, sf)
    return G.call_graph(calls, _node(g, 7, 2_000_000, 7), "both", 2).nodes.select("id", "depth")


@query("g07_data_dependents", f"WITH RECURSIVE {GRAPH}, {_reach('flow', VAR0, None)} SELECT id, d::INT AS depth FROM r")
def g07(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return G.data_flow(g.edges, g.nodes, _node(g, 4, 100_000_000, 0)).nodes.select("id", "depth")


@query("g07_data_sources", f"WITH RECURSIVE {GRAPH}, {_reach('flow', '(SELECT id FROM ord WHERE o_orderkey = 5)', 3, False)} SELECT id, min(d)::INT AS depth FROM r GROUP BY id")
def g07_sources(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return G.data_flow(g.edges, g.nodes, _node(g, 4, 100_000_000, 5), False, 3).nodes.select("id", "depth")


@query("g09_field_accessors", f"WITH {GRAPH}, t AS (SELECT method, field, writes, count(*) AS n FROM (SELECT * FROM touched) GROUP BY ALL) SELECT field, method, CASE WHEN writes THEN 'write' ELSE 'read' END AS access, n FROM t")
def g09(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return G.field_accessors(g.nodes, g.edges)


@query("g11_inheritance", f"WITH RECURSIVE {GRAPH}, u(id, d) AS (SELECT {CLS1}, 0 UNION ALL SELECT dst, d - 1 FROM u JOIN inh ON src = id), w(id, d) AS (SELECT {CLS1}, 0 UNION ALL SELECT src, d + 1 FROM w JOIN inh ON dst = id) SELECT id, d::INT AS depth FROM u UNION ALL SELECT id, d FROM w WHERE d > 0")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return G.inheritance_tree(g.edges, _node(g, 8, 1_000_000, 1)).select("id", "depth")


@query("g13_impact", f"WITH RECURSIVE {GRAPH}, {_reach('ce', FN7, 3, False)} SELECT id, min(d)::INT AS depth, 'call_graph' AS via FROM r WHERE id <> {FN7} GROUP BY id")
def g13(spark: SparkSession, sf: str) -> DataFrame:
    g, calls = _calls(spark, sf)
    return G.impact(calls, g.edges, g.nodes, _node(g, 7, 2_000_000, 7)).select("id", "depth", "via")


@query(
    "g13_impact_both_ways",
    f"""WITH RECURSIVE {GRAPH}, back AS (SELECT dst AS src, src AS dst FROM flow WHERE dst % 3 <> 0), c(root, id, d) AS (SELECT id, id, 0 FROM ord UNION SELECT root, back.src, d + 1 FROM c JOIN back ON back.dst = c.id WHERE d < 2), f(root, id, d) AS (SELECT id, id, 0 FROM ord UNION SELECT root, dst, d + 1 FROM f JOIN flow ON src = f.id WHERE d < 2),
cg AS (SELECT root, id, min(d) AS d FROM c WHERE d > 0 GROUP BY ALL) SELECT root, id, d::INT AS depth, 'call_graph' AS via FROM cg UNION ALL SELECT root, id, min(d)::INT, 'data_flow' FROM f WHERE d > 0 AND NOT EXISTS (SELECT 1 FROM cg WHERE cg.root = f.root AND cg.id = f.id) GROUP BY root, id""",
)
def g13_both(spark: SparkSession, sf: str) -> DataFrame:
    """All variables as seeds; most data flows are calls backwards too, so both halves reach the same nodes and the calls come first."""
    g = S.star_graph(spark, sf)
    orders = g.of_type(4).select(F.col("id").alias("root"), "id")
    flow = g.labelled("DATA_FLOW").join(orders.select(F.col("id").alias("src")), "src", "left_semi")
    back = G.reverse(flow).where(F.col("src") % 3 != 0)
    return G.impact(back, g.edges, g.nodes, orders, 2)


@query(
    "g15_class_callgraph",
    f"WITH RECURSIVE {GRAPH}, r(root, id, d) AS (SELECT id, id, 0 FROM fn WHERE class_id = {CLS1} UNION SELECT root, dst, d + 1 FROM r JOIN ce ON src = r.id WHERE d < 2) SELECT root, id, min(d)::INT AS depth FROM r GROUP BY root, id",
)
def g15(spark: SparkSession, sf: str) -> DataFrame:
    g, calls = _calls(spark, sf)
    owner = _node(g, 8, 1_000_000, 1).select(F.col("id").alias("parent"))
    methods = G.class_methods(g.edges, g.nodes).join(owner, "parent", "left_semi").select(F.col("id").alias("root"), "id")
    return G.call_graph(calls, methods, "outgoing", 2).nodes


@query("g18_class_members", f"WITH {GRAPH} SELECT class_id, count(*) FILTER (WHERE k = 'm') AS methods, count(*) FILTER (WHERE k = 'f') AS fields FROM (SELECT class_id, 'm' AS k, id FROM fn UNION ALL SELECT DISTINCT (s.file_id::BIGINT << 32) + 1000000 + (field & 4294967295 - 200000000) // 4, 'f', field FROM touched JOIN sup s ON s.k = ((field & 4294967295) - 200000000) // 4) GROUP BY class_id".replace("(field & 4294967295 - 200000000)", "((field & 4294967295) - 200000000)"))
def g18(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    m = G.class_methods(g.edges, g.nodes).select(F.col("parent").alias("class_id"), F.lit(1).alias("m"), F.lit(0).alias("f"))
    f = G.class_fields(g.edges, g.nodes).select(F.col("parent").alias("class_id"), F.lit(0).alias("m"), F.lit(1).alias("f"))
    return m.unionByName(f).groupBy("class_id").agg(F.sum("m").alias("methods"), F.sum("f").alias("fields"))


@query("g19_fields_accessed", f"WITH {GRAPH} SELECT DISTINCT method, field FROM touched")
def g19(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return G.fields_accessed(g.nodes, g.edges)


# ---------------------------------------------------------------- entity search; rdNN is operator PNN of the inventory


@query("rd01_repos", "SELECT DISTINCT repo FROM files WHERE repo IS NOT NULL")
def p01_(spark: SparkSession, sf: str) -> DataFrame:
    return R.list_repos(table(spark, sf, "files"))


@query("rd02_find_files", "SELECT file_id, repo, path, language FROM files WHERE language = 'go' AND contains(path, 'query') ORDER BY path, file_id LIMIT 50 OFFSET 2")
def p02_(spark: SparkSession, sf: str) -> DataFrame:
    return R.find_files(table(spark, sf, "files"), language="go", path_like="query", offset=2, limit=50).select("file_id", "repo", "path", "language")


@query("rd03_file_by_path", "SELECT file_id, repo, path, language FROM files WHERE repo = (SELECT min(repo) FROM files) AND path = (SELECT min(path) FROM files WHERE repo = (SELECT min(repo) FROM files)) ORDER BY file_id LIMIT 1")
def p03_(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "files")
    first = f.agg(F.min(F.struct("repo", "path")).alias("k")).first()["k"]
    return R.file_by_path(f, first["repo"], first["path"]).select("file_id", "repo", "path", "language")


@query("rd03_first_version_of_paths", "SELECT repo, path, min(file_id) AS file_id, count(*) AS versions FROM files GROUP BY repo, path")
def p03_versions(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_versions(table(spark, sf, "files"))


@query("rd04_find_classes", f"WITH {GRAPH} SELECT c.id, c.name, repo, path FROM cls c JOIN files_ USING (file_id) WHERE repo = 'ASIA' AND contains(c.name, '1')")
def p04_(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return R.find_classes(g.nodes, g.files, repo="ASIA", name_like="1").select("id", "name", "repo", "path")


@query("rd06_find_methods", f"WITH {GRAPH} SELECT id, name FROM fn JOIN files_ USING (file_id) WHERE repo = 'EUROPE' ORDER BY name, id LIMIT 100")
def p06_(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return R.find_methods(g.nodes, g.edges, g.files, is_method=True, repo="EUROPE", limit=100).select("id", "name")


@query("rd08_find_fields", f"WITH {GRAPH} SELECT DISTINCT field AS id, repo FROM touched t JOIN files_ f ON (t.field >> 32) = f.file_id WHERE repo = 'AFRICA'")
def p08_(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return R.find_fields(g.nodes, g.edges, g.files, repo="AFRICA").select("id", "repo")


@query("rd17_references", f"WITH {GRAPH} SELECT '12' AS ref, 12::BIGINT AS id UNION ALL SELECT ref, min(id) FROM (SELECT class_name || '.' || name AS ref, id FROM fn) GROUP BY ref")
def p17_(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    some = g.of_type(7).select("class_id", "name").join(g.of_type(8).select(F.col("id").alias("class_id"), F.col("name").alias("c")), "class_id").select(F.concat("c", F.lit("."), "name").alias("ref"))
    refs = some.unionByName(spark.createDataFrame([("12",)], "ref string"))
    # the oracle's rows hold every function of the same reference
    return R.resolve_reference(refs, g.nodes, g.edges)


@query("rd18_snippets", "SELECT id, array_to_string((string_split(replace(regexp_replace(content, '\\n$', ''), chr(13), ''), chr(10)))[3:5], chr(10)) AS code, CASE WHEN coalesce(content, '') = '' THEN 0 ELSE len(string_split(regexp_replace(content, '\\n$', ''), chr(10))) END::INT AS total_lines FROM (SELECT DISTINCT id, content FROM chunks WHERE chunk_type = 'function' AND content IS NOT NULL)")
def p18_(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").where("chunk_type = 'function' and content is not null").select("id", "content").distinct()
    return c.select("id", R.snippet(F.col("content"), 3, 5).alias("code"), R.line_count(F.col("content")).alias("total_lines"))


@query("s17_chunks_by_path", "SELECT DISTINCT id, chunk_type, start_line, end_line FROM chunks WHERE file_path = (SELECT min(file_path) FROM chunks WHERE chunk_type = 'file')")
def s17(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    first = c.where("chunk_type = 'file'").agg(F.min("file_path").alias("file_path"))
    return c.join(F.broadcast(first), "file_path", "left_semi").select("id", "chunk_type", "start_line", "end_line").distinct()


@query("s19_versions_newest", "SELECT relative_path, file_id, file_sha, status, (row_number() OVER (PARTITION BY relative_path ORDER BY created_at DESC NULLS LAST, file_id, file_sha))::INT AS place FROM (SELECT DISTINCT file_id, file_sha, relative_path, status, created_at FROM file_versions WHERE relative_path IS NOT NULL)")
def s19(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "file_versions").select("file_id", "file_sha", "relative_path", "status", "created_at").distinct()
    return T.newest_first(v.where("relative_path is not null"), "relative_path").select("relative_path", "file_id", "file_sha", "status", "place")


@query("s19_versions_by_sha", "SELECT DISTINCT file_id, file_sha, status FROM file_versions WHERE file_sha = (SELECT min(file_sha) FROM file_versions)")
def s19_sha(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "file_versions")
    return T.versions_of(v, file_sha=v.agg(F.min("file_sha")).first()[0]).select("file_id", "file_sha", "status").distinct()


# ---------------------------------------------------------------- vectors


@query(
    "o02_vector_topk",
    """WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.e::DOUBLE[]), 6) AS score FROM embeddings v, q)
SELECT query::INT AS query, id, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10""",
)
def o02(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").cast("int").alias("query"), F.col("embedding").alias("vector"))
    return V.top_k(e, queries, 10, id_col="vec_id").select("query", "id", F.round("score", 6).alias("score"))


@query(
    "a11_best_per_chunk",
    """WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id AS id, list_cosine_similarity(v.embedding::DOUBLE[], q.e::DOUBLE[]) AS score FROM embeddings v, q),
t AS (SELECT query, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) <= 10) SELECT id, max(score) AS score, arg_min(query, (-score, query))::INT AS query FROM t WHERE id <> query GROUP BY id ORDER BY score DESC, id LIMIT 10""",
)
def a11(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").cast("int").alias("query"), F.col("embedding").alias("vector"))
    hits = V.top_k(e, queries, 10, id_col="vec_id").where("id != query")  # a query's own row tells nothing
    return V.best_of(hits.withColumn("score", F.round("score", 6)), 10).select("id", "score", F.col("query").cast("int").alias("query"))


@query("o04_typed_search", "WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.e::DOUBLE[]), 6) AS score FROM embeddings v, q WHERE label = 2) SELECT query, id, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10")
def o04(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return V.top_k(V.keyword_filter(e, {"label": 2}), q, 10, id_col="vec_id").select("query", "id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- churn

EVENTS = "ev AS (SELECT event_id, sha256(event_id::VARCHAR) AS sha, 'user_' || user_id AS author, ts, event_type || '/' || (user_id % 20) || '.go' AS path, floor(value)::INT AS added, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 0) AS deleted FROM events)"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("sha"), F.concat(F.lit("user_"), "user_id").alias("author"), "ts", F.concat("event_type", F.lit("/"), F.col("user_id") % 20, F.lit(".go")).alias("path"),
        F.floor("value").cast("int").alias("added"), F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)).alias("deleted"), F.lit(False).alias("is_merge"),
    )


@query(
    "a08_file_churn",
    f"""WITH {EVENTS}, m AS (SELECT path, sum(added)::BIGINT AS lines_added, sum(deleted)::BIGINT AS lines_deleted, count(*) AS commit_count, count(DISTINCT author) AS author_count, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM ev WHERE author <> 'user_1' GROUP BY path)
SELECT path, lines_added, lines_deleted, commit_count, author_count, first_us, last_us, round((lines_added + lines_deleted) * 0.5 + commit_count * 0.3 + author_count * 0.2, 6) AS score, round(((lines_added + lines_deleted) * 0.5 + commit_count * 0.3 + author_count * 0.2) / 100, 6) AS density FROM m""",
)
def a08(spark: SparkSession, sf: str) -> DataFrame:
    ev = _events(spark, sf)
    files = ev.select("path", F.lit(100).alias("loc")).distinct()
    m = C.file_churn(ev.select("sha", "path", "added", "deleted"), ev.select("sha", "author", "ts", "is_merge"), files, exclude_authors=("user_1",))
    return m.select("path", "lines_added", "lines_deleted", "commit_count", "author_count", F.unix_micros(F.col("first_commit").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_commit").cast("timestamp")).alias("last_us"), F.round("score", 6).alias("score"), F.round("density", 6).alias("density"))


@query(
    "o05_top_churn",
    f"""WITH {EVENTS}, m AS (SELECT path, round((sum(added) + sum(deleted)) * 0.5 + count(*) * 0.3 + count(DISTINCT author) * 0.2, 6) AS score FROM ev WHERE author <> 'user_1' GROUP BY path)
SELECT path, score FROM m QUALIFY row_number() OVER (ORDER BY score DESC, path) <= greatest(1, (SELECT count(*) * 10 // 100 FROM m))""",
)
def o05(spark: SparkSession, sf: str) -> DataFrame:
    return C.top_share(a08(spark, sf), 10).select("path", "score")


@query(
    "a09_function_churn",
    f"""WITH {EVENTS}, h AS (SELECT sha, author, path, (event_id % 400)::INT AS s, (1 + deleted % 20)::INT AS c, added, deleted FROM ev), paths AS (SELECT path AS p, row_number() OVER (ORDER BY path) - 1 AS n FROM (SELECT DISTINCT path FROM ev)), f AS (SELECT p_partkey AS id, p, (p_partkey % 500)::INT AS sl, (p_partkey % 500 + p_size)::INT AS el FROM (SELECT *, p_partkey % (SELECT count(*) FROM paths) AS n FROM part) JOIN paths USING (n)),
j AS (SELECT f.id, sha, author, trunc(added * ((least(el, s + c) - greatest(sl, s)) / c::DOUBLE))::INT AS a, trunc(deleted * ((least(el, s + c) - greatest(sl, s)) / c::DOUBLE))::INT AS d FROM f JOIN h ON h.path = f.p AND sl <= s + c AND s <= el)
SELECT f.id, coalesce(sum(a), 0)::BIGINT AS lines_added, coalesce(sum(d), 0)::BIGINT AS lines_deleted, count(DISTINCT sha) AS commit_count, count(DISTINCT author) AS author_count, round(((coalesce(sum(a), 0) + coalesce(sum(d), 0)) * 0.5 + count(DISTINCT sha) * 0.3 + count(DISTINCT author) * 0.2) / (any_value(el) - any_value(sl) + 1), 6) AS density FROM f LEFT JOIN j ON f.id = j.id GROUP BY f.id""",
)
def a09(spark: SparkSession, sf: str) -> DataFrame:
    ev = _events(spark, sf)
    hunks = ev.select("sha", "author", "path", (F.col("event_id") % 400).cast("int").alias("new_start"), (1 + F.col("deleted") % 20).cast("int").alias("new_count"), "added", "deleted")
    # functions are dealt out over all paths
    paths = Scratch(spark).keep(ev.select("path").distinct().withColumn("n", F.row_number().over(Window.orderBy("path")) - 1))
    n = F.pmod("p_partkey", F.lit(paths.count()))
    f = table(spark, sf, "part").withColumn("n", n).join(paths, "n").select(F.col("p_partkey").alias("id"), "path", (F.col("p_partkey") % 500).cast("int").alias("sl"), (F.col("p_partkey") % 500 + F.col("p_size")).cast("int").alias("el"))
    return C.function_churn(f, hunks).select("id", "lines_added", "lines_deleted", "commit_count", "author_count", F.round("density", 6).alias("density"))


@query("s09_last_commit", f"WITH {EVENTS} SELECT path, arg_max(sha, (ts, sha)) AS sha FROM ev GROUP BY path")
def s09(spark: SparkSession, sf: str) -> DataFrame:
    ev = _events(spark, sf)
    return C.last_commit(ev.select("sha", "path"), ev.select("sha", "ts"))


@query("a07_author_activity", "SELECT author, count(*) AS commits, sum(CASE WHEN is_merge THEN 1 ELSE 0 END)::BIGINT AS merges FROM (SELECT DISTINCT sha, coalesce(nullif(author, ''), 'unknown') AS author, is_merge FROM commits) GROUP BY author")
def a07(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "commits").select("sha", F.coalesce(F.nullif("author", F.lit("")), F.lit("unknown")).alias("author"), "is_merge").distinct()
    return c.groupBy("author").agg(F.count("*").alias("commits"), F.sum(F.when(F.col("is_merge"), 1).otherwise(0)).alias("merges"))


# ---------------------------------------------------------------- stores


@query("a05_version_stats", "SELECT count(*) AS total, coalesce(sum(CASE WHEN ephemeral THEN 1 ELSE 0 END), 0)::BIGINT AS ephemeral, coalesce(sum(CASE WHEN commit_id IS NOT NULL THEN 1 ELSE 0 END), 0)::BIGINT AS committed FROM (SELECT DISTINCT * FROM file_versions)")
def a05(spark: SparkSession, sf: str) -> DataFrame:
    return T.version_stats(table(spark, sf, "file_versions").distinct())


@query("d03_pending_files", "SELECT file_id FROM files WHERE file_id NOT IN (SELECT file_id FROM file_versions WHERE status = 'done')")
def d03(spark: SparkSession, sf: str) -> DataFrame:
    return T.pending_files(table(spark, sf, "files"), table(spark, sf, "file_versions")).select("file_id")


@query(
    "k13_file_ids",
    """WITH k AS (SELECT DISTINCT file_id, file_sha, relative_path, commit_id FROM file_versions WHERE file_id % 2 = 0), s AS (SELECT DISTINCT file_sha, relative_path, commit_id FROM file_versions)
SELECT count(*) AS n, count(DISTINCT file_id) AS ids, min(file_id) AS lo FROM (SELECT file_id FROM k UNION ALL SELECT (SELECT max(file_id) FROM k) + row_number() OVER () FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.file_sha = s.file_sha AND k.relative_path = s.relative_path AND k.commit_id IS NOT DISTINCT FROM s.commit_id))""",
)
def k13(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "file_versions")
    out = T.assign_file_ids(v.where("file_id % 2 = 0").select("file_id", "file_sha", "relative_path", "commit_id").distinct(), v)
    return out.agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("ids"), F.min("file_id").alias("lo"))


@query("j08_new_chunks", "SELECT DISTINCT id FROM chunks WHERE id NOT IN (SELECT id FROM chunks WHERE chunk_type IN ('file', 'class'))")
def j08(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select("id", "chunk_type", "content")
    return T.new_chunks(c, c.where("chunk_type in ('file', 'class')")).select("id").distinct()


@query("k01_upsert", "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS source FROM part")
def k01(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return T.upsert(p.withColumn("source", F.lit("old")), p.where("id % 3 = 0").withColumn("source", F.lit("new")), ["id"])


@query("k03_edges", f"WITH {GRAPH} SELECT DISTINCT src, dst FROM ce WHERE src IN (SELECT id FROM fn WHERE p_partkey % 2 = 0) AND dst IN (SELECT id FROM fn WHERE p_partkey % 2 = 0)")
def k03(spark: SparkSession, sf: str) -> DataFrame:
    g, calls = _graph(spark, sf)
    even = g.of_type(7).where(F.col("id") % 2 == 0)
    return T.write_edges(calls.withColumn("label", F.lit("CALLS")), even).select("src", "dst")


@query("k09_delete_repo", f"WITH {GRAPH}, keep AS (SELECT id, file_id FROM fn WHERE file_id NOT IN (SELECT file_id FROM files_ WHERE repo = 'ASIA')) SELECT (SELECT count(*) FROM keep) AS functions, count(*) AS call_edges FROM ce WHERE src IN (SELECT id FROM keep) AND dst IN (SELECT id FROM keep)")
def k09(spark: SparkSession, sf: str) -> DataFrame:
    g, calls = _graph(spark, sf)
    _, nodes, edges = T.delete_repository(g.files, g.of_type(7), calls.select("src", "dst").distinct(), "ASIA")
    return nodes.agg(F.count("*").alias("functions")).join(edges.agg(F.count("*").alias("call_edges")), F.lit(True))


# ---------------------------------------------------------------- scalar functions


@query("f16_hashes", "SELECT id, sha256(content) AS content_hash, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS chunk_id FROM (SELECT DISTINCT id, content, sha256(file_path || ':' || name || ':' || start_line) AS h FROM chunks WHERE content IS NOT NULL AND name IS NOT NULL AND start_line IS NOT NULL AND file_path IS NOT NULL)")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").where("content is not null and name is not null and start_line is not null and file_path is not null").select("id", "content", "file_path", "name", "start_line").distinct()
    return c.select("id", X.sha256(F.col("content")).alias("content_hash"), X.chunk_id(F.col("file_path"), F.col("name"), F.col("start_line")).alias("chunk_id")).distinct()


@query("f13_languages", "SELECT path, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.cs' THEN 'csharp' END AS language, regexp_extract(path, '[^/]*$') AS base, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS folder FROM (SELECT DISTINCT path FROM files)")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return table(spark, sf, "files").select("path").distinct().select("path", X.language_of_path(p).alias("language"), X.base_name(p).alias("base"), X.dir_name(p).alias("folder"))


@query("f01_camel_split", "SELECT DISTINCT name, regexp_replace(name, '(\\p{Ll})(\\p{Lu})', '\\1 \\2', 'g') AS words FROM chunks WHERE name IS NOT NULL")
def f01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").where("name is not null").select("name").distinct().select("name", X.camel_split(F.col("name")).alias("words"))


@query("f21_searchable_text", "SELECT DISTINCT id, sha256(CASE WHEN length(h) >= 8000 THEN h WHEN length(b) > 8000 - length(h) THEN h || substr(b, 1, 8000 - length(h) - 20) || chr(10) || '// ... (truncated)' ELSE h || b END) AS text_hash FROM (SELECT id, coalesce('Module: ' || nullif(module_name, '') || chr(10), '') || coalesce('Class: ' || nullif(class_name, '') || chr(10), '') || coalesce(nullif(signature, '') || chr(10), '') || coalesce(nullif(docstring, '') || chr(10), '') AS h, coalesce(content, '') AS b FROM chunks)")
def f21(spark: SparkSession, sf: str) -> DataFrame:
    t = X.searchable_text(*[F.col(x) for x in ("module_name", "class_name", "signature", "docstring", "content")])
    return table(spark, sf, "chunks").select("id", X.sha256(t).alias("text_hash")).distinct()


SKIP_SQL = ", ".join(f"'{x}'" for x in FS.SKIP_NAMES)


@query(
    "s04_skipped_files",
    f"""SELECT file_id, path FROM files WHERE lower(regexp_extract(path, '[^/]*$')) IN ({SKIP_SQL}) OR regexp_extract(path, '[^/]*$') IN ({', '.join(f"'{x}'" for x in FS.LOCK_FILES)}) OR lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ({', '.join(f"'{x}'" for x in FS.SKIP_EXTENSIONS)})
  OR len(list_filter(string_split(regexp_replace(path, '/?[^/]*$', ''), '/'), lambda d: d IN ({', '.join(f"'{x}'" for x in FS.SKIP_PARTS)}))) > 0 OR (CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.cs' THEN 'csharp' END) IS DISTINCT FROM language""",
)
def s04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").where(FS.skip_file(F.col("path"), F.col("language"))).select("file_id", "path")


@query("f06_signatures", None)
def f06(spark: SparkSession, sf: str) -> DataFrame:
    return I.signature_chunks(table(spark, sf, "chunks"))


# ---------------------------------------------------------------- roll-ups


@query("a12_folders", "SELECT repo, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS folder, count(*) AS files FROM files GROUP BY ALL")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").groupBy("repo", X.dir_name(F.col("path")).alias("folder")).agg(F.count("*").alias("files"))


@query("a13_projects", "WITH f AS (SELECT repo, path, len(string_split(path, '/')) - 1 AS depth FROM files) SELECT repo, count(*) AS files, min(depth)::INT AS min_depth, sum(CASE WHEN regexp_matches(lower(regexp_extract(path, '[^/]*$')), 'main|^index|^app\\.') THEN 1 ELSE 0 END)::BIGINT AS entry_points FROM f GROUP BY repo")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "files")
    return f.groupBy("repo").agg(F.count("*").alias("files"), F.min(F.size(F.split("path", "/")) - 1).alias("min_depth"), F.sum(X.is_entry_point(F.col("path")).cast("int")).alias("entry_points"))


@query("d10_summaries", None)
def d10(spark: SparkSession, sf: str) -> DataFrame:
    return I.summaries(table(spark, sf, "chunks"), table(spark, sf, "files"))


@query("d05_chunks", None)
def d05(spark: SparkSession, sf: str) -> DataFrame:
    return I.chunk_files(table(spark, sf, "chunks").where("chunk_type = 'file'").select("file_id", F.col("file_path").alias("path"), "content").distinct())


@query("d09_python_graph", None)
def d09(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "chunks").where("chunk_type = 'file'").select("file_id", "file_path", "content").distinct()
    return I.parse_graph(rows.where(X.language_of_path(F.col("file_path")) == "python").select("file_id", "content"))


@query("j11_inheritance", None)
def j11(spark: SparkSession, sf: str) -> DataFrame:
    rows = d09(spark, sf)
    classes = rows.where("kind = 'node' and node_type = 8").select("id", "file_id", "name", "extends")
    modules = table(spark, sf, "files").select("file_id", "repo", F.coalesce("module", F.lit("")).alias("module")).dropDuplicates(["file_id"])
    return PP.resolve_inheritance(classes.join(modules, "file_id"))
