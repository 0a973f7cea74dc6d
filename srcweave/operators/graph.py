"""Graph operators: containment closure, call edges, bounded searches, and the analyses built on them.

Searches keep one written table per level, so lineage stays flat and a small frontier is broadcast only because
its size on disk is known. Depths are shortest distances; an edge list holds every edge out of an expanded node.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcweave.schema import NODE_TYPES, label_of_type, range_text
from srcweave.session import Scratch

FUNCTION, CLASS, FIELD, VARIABLE = (NODE_TYPES[x] for x in ("Function", "Class", "Field", "Variable"))


def closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(anc, desc, depth, paths): proper ancestors and descendants over acyclic (src, dst) edges, one row per pair and depth.

    ``starts`` (id) limits the ancestors. ``paths`` counts the ways, so per-path counts can be summed. A cycle has no end of
    paths and is an error.
    """
    scratch = Scratch(edges.sparkSession)
    e = scratch.keep(edges.where("src is not null and dst is not null and src != dst").distinct())
    level = e.select(F.col("src").alias("anc"), F.col("dst").alias("desc"), F.lit(1).alias("depth"), F.lit(1).cast("long").alias("paths"))
    if starts is not None:
        level = level.join(starts.select(F.col("id").alias("anc")).distinct(), "anc", "left_semi")
    schema, found = level.schema, [scratch.write(level)]
    while True:
        last = scratch.read(schema, found[-1])
        nxt = last.join(e, last["desc"] == e["src"]).groupBy("anc", F.col("dst").alias("desc"), (F.col("depth") + 1).alias("depth")).agg(F.sum("paths").alias("paths"))
        path = scratch.write_some(nxt.select("anc", "desc", "depth", "paths"))
        if path is None:
            return scratch.read(schema, *found)
        if not scratch.read(schema, path).where("anc = desc").isEmpty():
            raise ValueError("the edges hold a cycle")
        found.append(path)


@dataclass
class Found:
    nodes: DataFrame  # root, id, depth
    edges: DataFrame  # root, src, dst, ...: all edges out of expanded nodes
    truncated: bool


def bfs(edges: DataFrame | Callable[[DataFrame], DataFrame], seeds: DataFrame, max_depth: int | None = None, expand: Column | None = None, blocked: DataFrame | None = None, node_info: DataFrame | None = None) -> Found:
    """Breadth-first search over (src, dst, ...) from every seed (root, id) on its own.

    ``edges`` is a table, or a function that gives the edges out of a frontier (src); only edges at the frontier are read.
    A node counts at its shortest distance. Nodes that fail ``expand`` (a condition over the columns of ``node_info``, keyed by
    id) are reached but not expanded nor returned; ``blocked`` (root, id) are treated as seen. ``truncated`` says that
    a node was found at ``max_depth``. Unknown seeds give themselves at depth 0; null seeds are left out.
    """
    scratch = Scratch(seeds.sparkSession)
    if isinstance(edges, DataFrame):
        e = scratch.keep(edges.where("src is not null and dst is not null").distinct())
        edges = lambda ids: e.join(ids, "src", "left_semi")
    start = seeds.where("id is not null").select("root", "id", F.lit(0).alias("depth"), F.lit(True).alias("open")).distinct()
    schema, found, used = start.schema, [scratch.write(start)], []
    depth = 0
    while True:
        frontier = scratch.read(schema, found[-1]).where("open").select("root", F.col("id").alias("src"))
        if max_depth is not None and depth >= max_depth:
            break
        out = edges(frontier.select("src").distinct())
        used.append(scratch.write(frontier.join(out, "src").select("root", *out.columns)))
        hop = scratch.read(_with_root(out), used[-1])
        seen = scratch.read(schema, *found).select("root", "id")
        nxt = hop.select("root", F.col("dst").alias("id")).distinct().join(seen, ["root", "id"], "left_anti")
        if blocked is not None:
            nxt = nxt.join(blocked.select("root", "id"), ["root", "id"], "left_anti")
        if expand is not None:
            nxt = nxt.join(node_info, "id", "left").withColumn("open", F.coalesce(expand, F.lit(False)))
        else:
            nxt = nxt.withColumn("open", F.lit(True))
        path = scratch.write_some(nxt.select("root", "id", F.lit(depth + 1).alias("depth"), "open"))
        if path is None:
            break
        found.append(path)
        depth += 1
    nodes = scratch.read(schema, *found).where("open").select("root", "id", "depth")
    if not used:
        return Found(nodes, frontier.join(edges(frontier.select("src").distinct()), "src").where(F.lit(False)), max_depth is not None)
    return Found(nodes, scratch.read(_with_root(out), *used), max_depth is not None and depth >= max_depth)


def _with_root(edges: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("root", T.LongType()), *edges.schema.fields])


def reach(contains: DataFrame, ids: DataFrame, up: bool = False) -> DataFrame:
    """(start, id) of all nodes below (``up``: above) each of ``ids`` (src) over kept CONTAINS edges, the starts among them."""
    scratch = Scratch(ids.sparkSession)
    a, b = ("dst", "src") if up else ("src", "dst")
    level = ids.select(F.col("src").alias("start"), F.col("src").alias("id")).distinct()
    schema, found, last = level.schema, [], level
    while True:
        nxt = last.join(contains.select(F.col(a).alias("id"), F.col(b).alias("next")), "id").select("start", F.col("next").alias("id")).distinct()
        seen = level.unionByName(scratch.read(schema, *found)) if found else level
        path = scratch.write_some(nxt.join(seen, ["start", "id"], "left_anti"))
        if path is None:
            return seen
        found.append(path)
        last = scratch.read(schema, path)


@dataclass
class Calls:
    """The calls of a graph, looked up for a frontier of functions instead of for all of them.

    A call in a nested function counts for each function around it; calls outside any function have no caller.
    """

    contains: DataFrame  # src, dst
    sites: DataFrame  # call_site, dst
    functions: DataFrame  # id

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> Calls:
        keep = Scratch(nodes.sparkSession).keep
        ends = lambda label: edges.where((F.col("label") == label) & F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst")
        return cls(keep(ends("CONTAINS")), keep(ends("CALLS_FUNCTION").withColumnRenamed("src", "call_site")), keep(nodes.where(F.col("node_type") == FUNCTION).select("id")))

    def callees(self, ids: DataFrame) -> DataFrame:
        """(src, dst, call_site) of the calls inside the functions ``ids`` (src)."""
        inside = reach(self.contains, ids.join(self.functions.withColumnRenamed("id", "src"), "src", "left_semi"))
        return inside.join(self.sites, inside["id"] == self.sites["call_site"]).select(F.col("start").alias("src"), "dst", "call_site").distinct()

    def callers(self, ids: DataFrame) -> DataFrame:
        """(src, dst, call_site) with src called and dst the caller, for the functions ``ids`` (src)."""
        sites = self.sites.join(ids.withColumnRenamed("src", "dst"), "dst", "left_semi")
        above = reach(self.contains, sites.select(F.col("call_site").alias("src")), up=True).join(self.functions, "id", "left_semi")
        return sites.join(above, sites["call_site"] == above["start"]).select(F.col("dst").alias("src"), F.col("id").alias("dst"), "call_site").distinct()


def call_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, call_site): caller, callee and call of every function that contains a call, at any depth.

    A call in a nested function counts for each function around it; calls outside any function have no caller.
    """
    functions = nodes.where(F.col("node_type") == FUNCTION).select("id")
    calls = edges.where("label = 'CALLS_FUNCTION'").select(F.col("src").alias("call_site"), F.col("dst").alias("dst"))
    inside = closure(edges.where("label = 'CONTAINS'").select("src", "dst"), functions)
    return inside.join(calls, inside["desc"] == calls["call_site"]).select(F.col("anc").alias("src"), "dst", "call_site").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "dst_", "dst": "src_"}).withColumnsRenamed({"dst_": "dst", "src_": "src"})


def seeds_of(spark, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(i, i) for i in ids], "root long, id long")


def call_graph(calls: DataFrame | Calls, seeds: DataFrame, direction: str = "outgoing", max_depth: int = 3) -> Found:
    """Call graph around each seed. Callers have negative depths; with ``both``, callees come first and are not added again."""
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError("direction is outgoing, incoming or both")
    max_depth = max_depth if max_depth > 0 else 3
    parts = []
    if direction != "incoming":
        parts.append(bfs(calls.callees if isinstance(calls, Calls) else calls, seeds, max_depth))
    if direction != "outgoing":
        blocked = parts[0].nodes.where("depth > 0").select("root", "id") if parts else None
        up = bfs(calls.callers if isinstance(calls, Calls) else reverse(calls), seeds, max_depth, blocked=blocked)
        parts.append(Found(up.nodes.select("root", "id", (-F.col("depth")).alias("depth")), reverse(up.edges), up.truncated))
    nodes = parts[0].nodes if len(parts) == 1 else parts[0].nodes.unionByName(parts[1].nodes.where("depth < 0"))
    edges = parts[0].edges if len(parts) == 1 else parts[0].edges.unionByName(parts[1].edges).distinct()
    return Found(nodes, edges, any(p.truncated for p in parts))


def data_flow(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, forward: bool = True, max_depth: int | None = None, types: tuple[int, ...] = (), indirect: bool = True) -> Found:
    """Dependents (forward) or sources (backward) over DATA_FLOW; a node of another type is seen but not expanded, its edge stays."""
    flow = edges.where("label = 'DATA_FLOW'").select("src", "dst")
    flow = flow if forward else reverse(flow)
    depth = 1 if not indirect else None if not max_depth or max_depth < 0 else max_depth
    info = nodes.select("id", "node_type")
    r = bfs(flow, seeds, depth, F.col("node_type").isin(*types) if types else None, node_info=info)
    return r if forward else Found(r.nodes, reverse(r.edges), r.truncated)


def inheritance_tree(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, id, depth): ancestors at negative depths, descendants at positive ones, over child -> parent edges."""
    up_edges = edges.where("label = 'INHERITS'").select("src", "dst")
    depth = None if max_depth is None or max_depth < 0 else max_depth
    up, down = bfs(up_edges, seeds, depth), bfs(reverse(up_edges), seeds, depth)
    return up.nodes.select("root", "id", (-F.col("depth")).alias("depth")).unionByName(down.nodes.where("depth > 0"))


def field_accessors(nodes: DataFrame, edges: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(field, method, access, n): how often each function's inner nodes read or write each field, counted per path."""
    inside = closure(edges.where("label = 'CONTAINS'").select("src", "dst"), nodes.where(F.col("node_type") == FUNCTION).select("id"))
    is_field = nodes.where(F.col("node_type") == FIELD).select(F.col("id").alias("dst"))
    if fields is not None:
        is_field = is_field.join(fields.select(F.col("id").alias("dst")), "dst", "left_semi")
    reads = edges.where("label = 'HAS_FIELD'").select("src", "dst").join(is_field, "dst", "left_semi")
    writes = edges.where("label = 'DATA_FLOW'").select("src", "dst").join(is_field, "dst", "left_semi").distinct()
    access = reads.distinct().join(writes, ["src", "dst"], "left_anti").withColumn("access", F.lit("read")).unionByName(writes.withColumn("access", F.lit("write")))
    joined = inside.join(access, inside["desc"] == access["src"])
    return joined.groupBy(F.col("dst").alias("field"), F.col("anc").alias("method"), "access").agg(F.sum("paths").alias("n"))


def impact(calls: DataFrame | Calls, edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_depth: int = 3, by_calls: bool = True, by_data: bool = True) -> DataFrame:
    """(root, id, depth, via): callers and data dependents of each seed; what both reach counts as call_graph. Depth <= 0 means 3."""
    max_depth = max_depth if max_depth > 0 else 3
    out = seeds.sparkSession.createDataFrame([], "root long, id long, depth int, via string")
    if by_calls:
        callers = call_graph(calls, seeds, "incoming", max_depth).nodes.where("depth < 0")
        out = callers.select("root", "id", F.abs("depth").cast("int").alias("depth"), F.lit("call_graph").alias("via"))
    if by_data:
        data = data_flow(edges, nodes, seeds, True, max_depth).nodes.where("depth > 0")
        data = data.join(out.select("root", "id"), ["root", "id"], "left_anti") if by_calls else data
        out = out.unionByName(data.select("root", "id", "depth", F.lit("data_flow").alias("via")))
    return out


def children(edges: DataFrame, nodes: DataFrame, label: str, parent_type: int | None = None, child_types: tuple[int, ...] = ()) -> DataFrame:
    """(parent, id, ...) of one hop over ``label``, optionally by the types of both ends."""
    kids = nodes.where(F.col("node_type").isin(*child_types)) if child_types else nodes
    hop = edges.where(F.col("label") == label).select(F.col("src").alias("parent"), F.col("dst").alias("id")).distinct()
    if parent_type is not None:
        hop = hop.join(nodes.where(F.col("node_type") == parent_type).select(F.col("id").alias("parent")), "parent", "left_semi")
    return hop.join(kids, "id")


def class_methods(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return children(edges, nodes, "CONTAINS", CLASS, (FUNCTION,))


def class_fields(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Declared fields are variables or fields that a class has; its methods are left out."""
    return children(edges, nodes, "HAS_FIELD", CLASS, (FIELD, VARIABLE))


def fields_accessed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, field): distinct fields that a function's inner nodes touch."""
    return field_accessors(nodes, edges).select("method", "field").distinct()


def this_fields(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, field): fields reached over the receiver: function contains v, v THIS class, v HAS_FIELD* field."""
    inside = closure(edges.where("label = 'CONTAINS'").select("src", "dst"), nodes.where(F.col("node_type") == FUNCTION).select("id"))
    this = edges.where("label = 'THIS'").select(F.col("src").alias("v")).distinct()
    owned = closure(edges.where("label = 'HAS_FIELD'").select("src", "dst"), this.select(F.col("v").alias("id")))
    fields = nodes.where(F.col("node_type") == FIELD).select(F.col("id").alias("field"))
    hit = inside.join(this, inside["desc"] == this["v"]).select(F.col("anc").alias("method"), "v")
    return hit.join(owned.select(F.col("anc").alias("v"), F.col("desc").alias("field")), "v").join(fields, "field", "left_semi").select("method", "field").distinct()


def lookup(nodes: DataFrame, files: DataFrame, node_type: int, name: str, repo: str | None = None, path: str | None = None, owners: DataFrame | None = None) -> DataFrame:
    """(root, id) of the entity of that name, the smallest id among several; repo and path are resolved over the file.

    ``owners`` (id) restricts to the contained entities that it lists. Without a match the result is empty.
    """
    hit = nodes.where((F.col("node_type") == node_type) & (F.col("name") == name))
    if repo or path:
        where = F.lit(True)
        where = where & (F.col("repo") == repo) if repo else where
        where = where & (F.col("path") == path) if path else where
        hit = hit.join(files.where(where).select("file_id"), "file_id", "left_semi")
    if owners is not None:
        hit = hit.join(owners.select("id"), "id", "left_semi")
    best = hit.agg(F.min("id").alias("id")).first()["id"]  # one row: a constant keeps the plans of what follows small
    return seeds_of(nodes.sparkSession, [] if best is None else [best])


def members_of_class(nodes: DataFrame, edges: DataFrame, class_name: str, label: str = "CONTAINS") -> DataFrame:
    owners = nodes.where((F.col("node_type") == CLASS) & (F.col("name") == class_name)).select(F.col("id").alias("src"))
    return edges.where(F.col("label") == label).join(owners, "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def parents(edges: DataFrame, seeds: DataFrame, max_depth: int = -1) -> DataFrame:
    return bfs(edges.where("label = 'INHERITS'").select("src", "dst"), seeds, None if max_depth < 0 else max_depth).nodes.where("depth > 0")


def subclasses(edges: DataFrame, seeds: DataFrame, max_depth: int = -1) -> DataFrame:
    return bfs(reverse(edges.where("label = 'INHERITS'").select("src", "dst")), seeds, None if max_depth < 0 else max_depth).nodes.where("depth > 0")


def method_context(nodes: DataFrame, edges: DataFrame, files: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, name, path, class_name, callers, callees): every function with its file, class and numbers of direct neighbours."""
    f = nodes.where(F.col("node_type") == FUNCTION).select("id", "name", "file_id")
    owner = edges.where("label = 'CONTAINS'").join(nodes.where(F.col("node_type") == CLASS).select(F.col("id").alias("src"), F.col("name").alias("class_name")), "src").select(F.col("dst").alias("id"), "class_name")
    pairs = calls.select("src", "dst").distinct()
    out_n, in_n = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees")), pairs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    joined = f.join(files.select("file_id", "path"), "file_id", "left").join(owner, "id", "left").join(out_n, "id", "left").join(in_n, "id", "left")
    return joined.select("id", "name", "path", "class_name", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))


def fields_written(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, field): distinct fields that a function's inner nodes write."""
    return field_accessors(nodes, edges).where("access = 'write'").select("method", "field").distinct()


def calls_by_function(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(function_id, calls): the calls inside each function, at any depth."""
    inside = closure(edges.where("label = 'CONTAINS'").select("src", "dst"), nodes.where(F.col("node_type") == FUNCTION).select("id"))
    calls = nodes.where(F.col("node_type") == NODE_TYPES["FunctionCall"]).select(F.col("id").alias("desc"))
    return inside.join(calls, "desc", "left_semi").groupBy(F.col("anc").alias("function_id")).agg(F.countDistinct("desc").alias("calls"))


def module_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, module): the module that a file contains, the first by id."""
    hop = children(edges, nodes, "CONTAINS", NODE_TYPES["FileScope"], (NODE_TYPES["ModuleScope"],))
    return hop.groupBy(F.col("parent").cast("int").alias("file_id")).agg(F.min_by("name", "id").alias("module"))


def dump(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, section, ord, line): a text dump of the graph; order by these columns and write the lines.

    A header names the file, nodes come by id with their range and sorted metadata where the tables have them, edges by
    their ends and label, totals last.
    """
    at = files.select("file_id", "path")
    have = set(nodes.columns)
    none = F.lit(None).cast("int")
    part = [F.col(c) if c in have else none for c in ("sl", "sc", "el", "ec")]
    where = F.when(part[0].isNotNull() & part[2].isNotNull(), F.concat(F.lit(" Range:"), range_text(part[0], F.coalesce(part[1], F.lit(0)), part[2], F.coalesce(part[3], F.lit(0))))).otherwise(F.lit(""))
    facts = F.array_sort(F.transform(F.map_entries("md"), lambda e: F.concat(F.lit(" "), e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))) if "md" in have else F.array().cast("array<string>")
    line = F.concat(F.lit("["), F.coalesce(label_of_type(F.col("node_type")), F.lit("")), F.lit("] ID:"), F.col("id").cast("string"), F.lit(' Name:"'), F.coalesce("name", F.lit("")), F.lit('"'), where, F.coalesce(F.array_join(facts, ""), F.lit("")))
    n = nodes.join(at, "file_id").select("path", F.lit(1).alias("section"), F.format_string("%020d", "id").alias("ord"), line.alias("line"))
    owner = nodes.select(F.col("id").alias("src"), "file_id").join(at, "file_id").select("src", "path")
    e = edges.join(owner, "src").select("path", F.lit(2).alias("section"), F.format_string("%020d %s %020d", "src", "label", "dst").alias("ord"), F.concat(F.lit("("), F.col("src").cast("string"), F.lit(") -["), "label", F.lit("]-> ("), F.col("dst").cast("string"), F.lit(")")).alias("line"))
    both = n.select("path", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(e.select("path", F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy("path").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    frame = both.select("path", F.explode(F.array(F.struct(F.lit(0).alias("section"), F.concat(F.lit("File: "), "path").alias("line")), F.struct(F.lit(3).alias("section"), F.format_string("total nodes %d, edges %d", "a", "b").alias("line")))).alias("x"))
    return n.unionByName(e).unionByName(frame.select("path", "x.section", F.lit("").alias("ord"), "x.line"))
