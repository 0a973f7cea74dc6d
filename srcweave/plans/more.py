"""Further registered queries: lookups, by-name analyses, statistics and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcweave.functions import text as X
from srcweave.operators import churn as C
from srcweave.operators import graph as G
from srcweave.operators import reader as R
from srcweave.operators import store as T
from srcweave.operators import vector as V
from srcweave.plans.core import CLS1, EVENTS, FN7, GRAPH, VAR0, WHOLE, _calls, _events, _graph, _node, _reach, query
from srcweave.session import table
from srcweave.sources import files as FS
from srcweave.sources import star as S


@query("s14_node_by_id", f"WITH {GRAPH} SELECT id, name, file_id FROM fn WHERE id = {FN7}")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return R.node_by_id(g.nodes, _node(g, 7, 2_000_000, 7).first()["id"], 7).select("id", "name", "file_id")


@query("s16_nodes_of_file", f"WITH {GRAPH} SELECT id FROM (SELECT id, file_id FROM cls UNION ALL SELECT id, file_id FROM fn UNION ALL SELECT DISTINCT f.block, f.file_id FROM calls c JOIN fn f ON c.src = f.id UNION ALL SELECT call_site, f.file_id FROM calls c JOIN fn f ON c.src = f.id UNION ALL SELECT DISTINCT field, (field >> 32)::INT FROM touched UNION ALL SELECT id, (id >> 32)::INT FROM ord UNION ALL SELECT (file_id::BIGINT << 32) + 1, file_id FROM files_) WHERE file_id = 3")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    return S.star_graph(spark, sf).nodes.where("file_id = 3 and node_type not in (2, 11)").select("id")


@query("s18_chunk_by_id", "SELECT id, chunk_type, start_line FROM chunks WHERE id = (SELECT min(id) FROM chunks) GROUP BY ALL")
def s18(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    return c.join(F.broadcast(c.agg(F.min("id").alias("id"))), "id", "left_semi").select("id", "chunk_type", "start_line").distinct()


@query("s02_pruned_paths", "SELECT file_id FROM files WHERE len(list_filter(string_split(regexp_replace(path, '/?[^/]*$', ''), '/'), lambda d: d IN ('.git','node_modules','.vscode','.idea','vendor','target','build','dist','__pycache__','.pytest_cache','coverage','site-packages','.next','.nuxt','.cache','tmp','temp') OR (starts_with(d, '.') AND d NOT IN ('.', '..')))) > 0")
def s02(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").where(FS.skip_directory(F.col("path"))).select("file_id")


@query("g03_callers", f"WITH {GRAPH} SELECT DISTINCT src AS id FROM ce WHERE dst = {FN7}")
def g03(spark: SparkSession, sf: str) -> DataFrame:
    g, calls = _calls(spark, sf)
    return G.call_graph(calls, _node(g, 7, 2_000_000, 7), "incoming", 1).nodes.where("depth = -1").select("id")


@query("g05_callgraph_by_name", f"WITH RECURSIVE {GRAPH}, {_reach('ce', '(SELECT min(id) FROM fn WHERE name = (SELECT name FROM fn WHERE p_partkey = 7))', 2)} SELECT id, min(d)::INT AS depth FROM r GROUP BY id")
def g05(spark: SparkSession, sf: str) -> DataFrame:
    g, calls = _calls(spark, sf)
    name = table(spark, sf, "part").where("p_partkey = 7").first()["p_name"]
    return G.call_graph(calls, G.lookup(g.nodes, g.files, 7, name), "outgoing", 2).nodes.select("id", "depth")


@query("g08_variable_dependents", f"WITH RECURSIVE {GRAPH}, {_reach('flow', VAR0, None)} SELECT id, d::INT AS depth FROM r")
def g08(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return G.data_flow(g.edges, g.nodes, G.lookup(g.nodes, g.files, 4, "order_0")).nodes.select("id", "depth")


@query("g10_accessors_by_name", f"WITH {GRAPH} SELECT field, method, CASE WHEN writes THEN 'write' ELSE 'read' END AS access, count(*) AS n FROM touched WHERE field IN (SELECT DISTINCT field FROM touched t JOIN sup s ON s.k = ((field & 4294967295) - 200000000) // 4 WHERE s.k = 1 AND ((field & 4294967295) - 200000000) % 4 = 0) GROUP BY ALL")
def g10(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    owner = table(spark, sf, "supplier").where("s_suppkey = 1").first()["s_name"]
    field = G.lookup(g.nodes, g.files, 9, "flag_A", owners=G.members_of_class(g.nodes, g.edges, owner))
    return G.field_accessors(g.nodes, g.edges, field)


@query("g12_parents", f"WITH RECURSIVE {GRAPH}, u(id, d) AS (SELECT id, 0 FROM cls WHERE k = 20 UNION ALL SELECT dst, d + 1 FROM u JOIN inh ON src = id) SELECT id, d::INT AS depth FROM u WHERE d > 0")
def g12(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return G.parents(g.edges, _node(g, 8, 1_000_000, 20)).select("id", "depth")


@query("g12_children", f"WITH RECURSIVE {GRAPH}, u(id, d) AS (SELECT {CLS1}, 0 UNION ALL SELECT src, d + 1 FROM u JOIN inh ON dst = id WHERE d < 2) SELECT id, d::INT AS depth FROM u WHERE d > 0")
def g12_children(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return G.subclasses(g.edges, _node(g, 8, 1_000_000, 1), 2).select("id", "depth")


@query("g14_impact_of_variable", f"WITH RECURSIVE {GRAPH}, {_reach('flow', VAR0, 3)} SELECT id, min(d)::INT AS depth, 'data_flow' AS via FROM r WHERE d > 0 GROUP BY id")
def g14(spark: SparkSession, sf: str) -> DataFrame:
    g, calls = _calls(spark, sf)
    return G.impact(calls, g.edges, g.nodes, G.lookup(g.nodes, g.files, 4, "order_0")).select("id", "depth", "via")


@query("g16_method_context", f"WITH {GRAPH} SELECT id, name, path, class_name, (SELECT count(*) FROM ce WHERE dst = fn.id) AS callers, (SELECT count(*) FROM ce WHERE src = fn.id) AS callees FROM fn JOIN files_ USING (file_id)")
def g16(spark: SparkSession, sf: str) -> DataFrame:
    g, calls = _graph(spark, sf)
    return G.method_context(g.nodes, g.edges, g.files, calls)


@query("g17_find_and_analyze", f"WITH RECURSIVE {GRAPH}, r(root, id, d) AS (SELECT id, id, 0 FROM cls WHERE name LIKE '%1' UNION ALL SELECT root, src, d + 1 FROM r JOIN inh ON dst = r.id) SELECT root, count(*) - 1 AS descendants FROM r GROUP BY root")
def g17(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    seeds = R.find_classes(g.nodes, g.files, name_like="*1", glob=True).select(F.col("id").alias("root"), "id")
    return G.inheritance_tree(g.edges, seeds).where("depth >= 0").groupBy("root").agg((F.count("*") - 1).alias("descendants"))


@query("g21_fields_written", f"WITH {GRAPH} SELECT DISTINCT method, field FROM touched WHERE writes")
def g21(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return G.fields_written(g.nodes, g.edges)


@query("g22_module_names", f"WITH {GRAPH} SELECT file_id, 'mod_' || lower(repo) AS module FROM files_")
def g22(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return G.module_names(g.nodes, g.edges)


@query("a14_calls_by_function", f"WITH {GRAPH} SELECT src AS function_id, count(DISTINCT call_site) AS calls FROM calls GROUP BY src")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return G.calls_by_function(g.nodes, g.edges)


@query("a16_dump_totals", f"WITH {WHOLE}, e AS (SELECT n.file_id, count(*) AS n FROM all_edges JOIN all_nodes n ON n.id = src GROUP BY 1), c AS (SELECT file_id, count(*) AS n FROM all_nodes GROUP BY 1) SELECT path, 'total nodes ' || c.n || ', edges ' || coalesce(e.n, 0) AS line FROM files_ JOIN c USING (file_id) LEFT JOIN e USING (file_id)")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return G.dump(g.files, g.nodes, g.edges).where("section = 3").select("path", "line")


@query(
    "k10_dump",
    f"""WITH {WHOLE}, lines AS (SELECT path, 0 AS section, '' AS ord, 'File: ' || path AS line FROM files_ UNION ALL SELECT path, 1, lpad(id::VARCHAR, 20, '0'), '[' || label || '] ID:' || id || ' Name:"' || name || '"' || CASE WHEN sl IS NULL THEN '' ELSE ' Range:(' || sl || ',0)-(' || el || ',0)' END FROM all_nodes JOIN files_ USING (file_id)
  UNION ALL SELECT path, 2, lpad(src::VARCHAR, 20, '0') || ' ' || e.label || ' ' || lpad(dst::VARCHAR, 20, '0'), '(' || src || ') -[' || e.label || ']-> (' || dst || ')' FROM all_edges e JOIN all_nodes n ON n.id = src JOIN files_ USING (file_id))
SELECT path, section, (row_number() OVER (PARTITION BY path, section ORDER BY ord, line))::INT AS place, line FROM lines""",
)
def k10(spark: SparkSession, sf: str) -> DataFrame:
    """The dump of every node and edge with the place of each line in its file's section."""
    g = S.star_graph(spark, sf)
    place = F.row_number().over(Window.partitionBy("path", "section").orderBy("ord", "line")).alias("place")
    return G.dump(g.files, g.nodes, g.edges).where("section < 3").select("path", "section", place, "line")


@query("rd05_class_full", f"WITH {GRAPH}, f AS (SELECT DISTINCT ((field & 4294967295) - 200000000) // 4 AS k, field FROM touched) SELECT id AS class_id, name, (SELECT count(*) FROM fn WHERE class_id = cls.id)::INT AS methods, (SELECT count(*) FROM f WHERE f.k = cls.k)::INT AS fields FROM cls")
def p05(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return R.class_full(g.nodes, g.edges).select("class_id", "name", F.coalesce(F.size("methods"), F.lit(0)).alias("methods"), F.coalesce(F.size("fields"), F.lit(0)).alias("fields"))


@query("rd09_file_classes", f"WITH {GRAPH} SELECT id, name FROM cls WHERE file_id = 3")
def p09(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return R.find_classes(g.nodes, g.files, file_id=3).select("id", "name")


@query("rd10b_classes_over_modules", f"WITH {GRAPH} SELECT c.id, path FROM cls c JOIN files_ USING (file_id)")
def p10b(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    modules = G.children(g.edges, g.nodes, "CONTAINS", 2, (1,)).select(F.col("parent").alias("file"), F.col("id").alias("parent"))
    return G.children(g.edges, g.nodes, "CONTAINS", 1, (8,)).select("parent", "id").join(modules, "parent").join(g.files.select(F.col("file_id").cast("long").alias("file"), "path"), "file").select("id", "path")


@query("rd21_outgoing", f"WITH {GRAPH} SELECT src, dst, 'INHERITS' AS label FROM inh WHERE dst = {CLS1}")
def p21(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    one = _node(g, 8, 1_000_000, 1).first()["id"]
    return R.incoming(g.edges, one, "INHERITS").select("src", "dst", "label")


@query("rd22_edges_of_file", f"WITH {WHOLE} SELECT DISTINCT src, dst, label FROM all_edges WHERE src IN (SELECT id FROM all_nodes WHERE file_id = 3) OR dst IN (SELECT id FROM all_nodes WHERE file_id = 3)")
def p22(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    return R.edges_of_file(g.nodes, g.edges, 3).select("src", "dst", "label")


@query("rd23_free_sql", f"WITH {GRAPH} SELECT c.name, count(*) AS methods FROM cls c JOIN fn ON fn.class_id = c.id GROUP BY c.id, c.name")
def p23(spark: SparkSession, sf: str) -> DataFrame:
    g = S.star_graph(spark, sf)
    R.sql_views(spark, g.nodes, g.edges, g.files)
    return spark.sql("SELECT c.name, count(*) AS methods FROM nodes c JOIN edges e ON e.src = c.id AND e.label = 'CONTAINS' JOIN nodes m ON m.id = e.dst WHERE c.node_type = 8 AND m.node_type = 7 GROUP BY c.id, c.name")


@query("rd20_keyword_filter", "SELECT vec_id FROM embeddings WHERE label = 4")
def p20(spark: SparkSession, sf: str) -> DataFrame:
    return V.keyword_filter(table(spark, sf, "embeddings"), {"label": 4}).select("vec_id")


@query("a04_distinct_counts", "SELECT repo, count(DISTINCT path) AS paths, count(*) AS versions FROM files GROUP BY repo")
def a04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").groupBy("repo").agg(F.countDistinct("path").alias("paths"), F.count("*").alias("versions"))


@query("a06_summary_stats", "SELECT chunk_type AS entity_type, count(*) AS n, sum(start_line)::BIGINT AS prompt_tokens, sum(end_line)::BIGINT AS output_tokens FROM chunks GROUP BY chunk_type")
def a06(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select(F.col("chunk_type").alias("entity_type"), F.col("start_line").alias("prompt_tokens"), F.col("end_line").alias("output_tokens"))
    return T.summary_stats(c)


@query("a18_index_results", "SELECT coalesce(status, 'none') AS status, count(*) AS n, count(DISTINCT file_id) AS files FROM file_versions GROUP BY 1")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "file_versions").groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))


@query("d12_churn_windows", f"WITH {EVENTS} SELECT path, (epoch_us(ts) // 604800000000) * 604800 AS start, sum(added + deleted)::BIGINT AS lines_changed FROM ev GROUP BY ALL")
def d12(spark: SparkSession, sf: str) -> DataFrame:
    ev = _events(spark, sf)
    w = C.windowed_churn(ev.select("sha", "path", "added", "deleted"), ev.select("sha", "ts"))
    return w.select("path", F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "lines_changed")


@query("k14_without_ephemeral", "SELECT DISTINCT file_id, file_sha FROM file_versions WHERE NOT coalesce(ephemeral, false)")
def k14(spark: SparkSession, sf: str) -> DataFrame:
    return T.without_ephemeral(table(spark, sf, "file_versions")).select("file_id", "file_sha").distinct()


@query("k14_set_status", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN file_id % 3 = 0 THEN 'done' ELSE status END AS status FROM file_versions) GROUP BY status")
def k14_status(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "file_versions")
    return T.set_status(v, v.where("file_id % 3 = 0").select("file_id"), "done", F.col("created_at")).groupBy("status").agg(F.count("*").alias("n"))


@query("k15_save_summaries", "WITH c AS (SELECT name AS entity_id, chunk_type AS entity_type, max(start_line)::INT AS line FROM chunks WHERE name IS NOT NULL AND start_line IS NOT NULL GROUP BY ALL), n AS (SELECT name AS entity_id, chunk_type AS entity_type, max(start_line)::INT AS line FROM chunks WHERE name IS NOT NULL AND start_line > 40 GROUP BY ALL) SELECT c.entity_id, c.entity_type, coalesce(n.line, c.line + 1000) AS line, CASE WHEN n.line IS NULL THEN 'old' ELSE 'new' END AS source FROM c LEFT JOIN n USING (entity_id, entity_type)")
def k15(spark: SparkSession, sf: str) -> DataFrame:
    """A store of all names is overwritten by the rows that start behind line 40, the latest of each name."""
    s = table(spark, sf, "chunks").where("name is not null and start_line is not null").select(F.col("start_line").alias("id"), F.col("name").alias("entity_id"), F.col("chunk_type").alias("entity_type"), F.timestamp_seconds("start_line").alias("updated_at"))
    old = T.latest(s, ["entity_id", "entity_type"], F.desc("id")).withColumns({"id": F.col("id") + 1_000, "source": F.lit("old")})
    return T.save_summaries(old, s.where("id > 40").withColumn("source", F.lit("new"))).select("entity_id", "entity_type", F.col("id").cast("int").alias("line"), "source")


@query("k11_vector_upsert", "WITH v AS (SELECT DISTINCT collection, id, len(embedding) AS n FROM vectors WHERE len(embedding) > 0), o AS (SELECT collection, id, max(n) AS n FROM v GROUP BY ALL), w AS (SELECT collection, id, max(n) AS n FROM v WHERE n = 64 GROUP BY ALL) SELECT collection, id, coalesce(w.n, o.n)::INT AS n, CASE WHEN w.n IS NULL THEN 'old' ELSE 'new' END AS source FROM o LEFT JOIN w USING (collection, id)")
def k11(spark: SparkSession, sf: str) -> DataFrame:
    """A store of all vectors, rows without embedding dropped, is overwritten by those of full width."""
    v = T.with_embedding(table(spark, sf, "vectors")).select("id", "collection", F.size("embedding").alias("n"))
    old = T.latest(v, ["collection", "id"], F.desc("n")).withColumn("source", F.lit("old"))
    return T.upsert(old, v.where("n = 64").withColumn("source", F.lit("new")), ["collection", "id"]).select("collection", "id", "n", "source")


@query("f19_needs_update", "SELECT count(*) AS n FROM (SELECT DISTINCT id, sha256(content) AS h FROM chunks WHERE content IS NOT NULL) c WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT id, sha256(content) AS h FROM chunks WHERE content IS NOT NULL AND chunk_type = 'function') s WHERE s.id = c.id AND s.h = c.h)")
def f19(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").where("content is not null").select(F.col("id").alias("entity_id"), F.lit("x").alias("entity_type"), X.context_hash(F.col("content")).alias("context_hash"), "chunk_type").distinct()
    return T.needs_update(c.drop("chunk_type").distinct(), c.where("chunk_type = 'function'").drop("chunk_type").distinct()).agg(F.count("*").alias("n"))


@query("f09_last_segments", "SELECT DISTINCT module_name, regexp_extract(module_name, '[^.]*$') AS last FROM chunks WHERE module_name IS NOT NULL")
def f09(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").where("module_name is not null").select("module_name", X.last_segment(F.col("module_name")).alias("last")).distinct()


@query("f12_range_codec", "SELECT DISTINCT id, '(' || start_line || ',' || length(coalesce(name, '')) || ')-(' || end_line || ',' || level || ')' AS range, start_line AS a, length(coalesce(name, ''))::INT AS b, end_line AS c, level AS d FROM chunks WHERE start_line IS NOT NULL AND end_line IS NOT NULL AND level IS NOT NULL")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    from srcweave.schema import range_part, range_text

    c = table(spark, sf, "chunks").where("start_line is not null and end_line is not null and level is not null")
    r = c.select("id", range_text(F.col("start_line"), F.length(F.coalesce("name", F.lit(""))), F.col("end_line"), F.col("level")).alias("range")).distinct()
    return r.select("id", "range", *[range_part(F.col("range"), i).alias(n) for i, n in enumerate("abcd", 1)])


@query("f14_language_alias", "SELECT DISTINCT language, CASE lower(trim(language)) WHEN 'golang' THEN 'go' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'cs' THEN 'csharp' WHEN 'c#' THEN 'csharp' ELSE CASE WHEN lower(trim(language)) IN ('go','python','java','javascript','typescript','csharp') THEN lower(trim(language)) END END AS canonical FROM chunks")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("language", X.language_alias(F.col("language")).alias("canonical")).distinct()


@query(
    "f20_truncated",
    """WITH c AS (SELECT DISTINCT id, content, substr(content, 1, 200) AS cut FROM chunks WHERE content IS NOT NULL), p AS (SELECT *, CASE WHEN contains(cut, chr(10)) THEN 200 - strpos(reverse(cut), chr(10)) END AS nl, CASE WHEN contains(cut, ' ') THEN 200 - strpos(reverse(cut), ' ') END AS sp FROM c)
SELECT id, sha256(CASE WHEN length(content) <= 200 THEN content WHEN nl > 150 THEN substr(content, 1, nl) || chr(10) || '... (truncated)' WHEN sp > 150 THEN substr(content, 1, sp) || ' ... (truncated)' ELSE cut || '... (truncated)' END) AS text_hash FROM p""",
)
def f20(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").where("content is not null").select("id", "content").distinct()
    return c.select("id", X.sha256(X.truncate(F.col("content"), 200)).alias("text_hash"))


@query("f23_globs", "SELECT DISTINCT path FROM files WHERE regexp_matches(path, '^(pkg|src)/(.*/)?[^/]*\\.go$')")
def f23(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return table(spark, sf, "files").where(X.matches_glob(p, "pkg/**/*.go") | X.matches_glob(p, "src/**/*.go")).select("path").distinct()


@query("f29_table_names", "SELECT DISTINCT name, regexp_replace(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS table_name FROM repos")
def f29(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "repos").select("name", X.table_name(F.col("name")).alias("table_name")).distinct()


@query("f38_similarities", "SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS dot, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS euclid FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def f38(spark: SparkSession, sf: str) -> DataFrame:
    from srcweave.functions.vectors import dot, euclid

    e = table(spark, sf, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 0").first()["embedding"]])
    return e.select("vec_id", F.round(dot(F.col("embedding"), q), 4).alias("dot"), F.round(euclid(F.col("embedding"), q), 4).alias("euclid"))
