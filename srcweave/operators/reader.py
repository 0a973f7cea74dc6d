"""Entity search over files, nodes and edges: lazy builders, ordered with a unique tie-break, then paged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcweave.functions.text import glob_regex, is_numeric_ref, last_segment, ref_class
from srcweave.schema import NODE_TYPES


def page(df: DataFrame, *order: str, offset: int = 0, limit: int = 0) -> DataFrame:
    """Ordered rows from ``offset``; a limit of 0 or less means all."""
    out = df.orderBy(*order)
    out = out.offset(offset) if offset > 0 else out
    return out.limit(limit) if limit > 0 else out


def like(c: Column, text: str | None, glob: bool = False) -> Column:
    return F.lit(True) if not text else c.rlike(glob_regex(text)) if glob else F.contains(c, F.lit(text))


def equal(c: Column, value) -> Column:
    return F.lit(True) if value is None or value == "" else c == value


def list_repos(files: DataFrame) -> DataFrame:
    return files.select("repo").where("repo is not null").distinct()


def find_files(files: DataFrame, repo: str | None = None, path: str | None = None, path_like: str | None = None, language: str | None = None, glob: bool = False, offset: int = 0, limit: int = 0) -> DataFrame:
    hit = files.where(equal(F.col("repo"), repo) & equal(F.col("path"), path) & like(F.col("path"), path_like, glob) & equal(F.col("language"), language))
    return page(hit, "path", "file_id", offset=offset, limit=limit)


def file_by_path(files: DataFrame, repo: str, path: str) -> DataFrame:
    """At most one row, the smallest id among several versions."""
    return files.where((F.col("repo") == repo) & (F.col("path") == path)).orderBy("file_id").limit(1)


def first_versions(files: DataFrame) -> DataFrame:
    """(repo, path, file_id, versions): the id that each path resolves to, the smallest of its versions."""
    return files.groupBy("repo", "path").agg(F.min("file_id").alias("file_id"), F.count("*").alias("versions"))


def entities(nodes: DataFrame, files: DataFrame, kind: str, repo: str | None = None, name: str | None = None, name_like: str | None = None, path: str | None = None, file_id: int | None = None, glob: bool = False) -> DataFrame:
    """Nodes of a kind with their file; repo and path are resolved over the file."""
    hit = nodes.where((F.col("node_type") == NODE_TYPES[kind]) & equal(F.col("name"), name) & like(F.col("name"), name_like, glob) & equal(F.col("file_id"), file_id))
    return hit.join(files.where(equal(F.col("repo"), repo) & equal(F.col("path"), path)).select("file_id", "repo", "path", "language"), "file_id")


def find_classes(nodes, files, offset: int = 0, limit: int = 0, **filters) -> DataFrame:
    return page(entities(nodes, files, "Class", **filters), "name", "id", offset=offset, limit=limit)


def find_methods(nodes, edges, files, is_method: bool | None = None, class_name: str | None = None, offset: int = 0, limit: int = 0, **filters) -> DataFrame:
    """Functions; ``is_method`` keeps those in (True) or outside (False) a class, ``class_name`` those of a class."""
    out = entities(nodes, files, "Function", **filters)
    owners = nodes.where((F.col("node_type") == NODE_TYPES["Class"]) & equal(F.col("name"), class_name)).select(F.col("id").alias("src"))
    owned = edges.where("label = 'CONTAINS'").select("src", F.col("dst").alias("id")).join(owners, "src", "left_semi")
    if class_name or is_method:
        out = out.join(owned, "id", "left_semi")
    elif is_method is False:
        out = out.join(owned, "id", "left_anti")
    return page(out, "name", "id", offset=offset, limit=limit)


def find_fields(nodes, edges, files, class_name: str | None = None, offset: int = 0, limit: int = 0, **filters) -> DataFrame:
    out = entities(nodes, files, "Field", **filters)
    if class_name:
        owners = nodes.where((F.col("node_type") == NODE_TYPES["Class"]) & (F.col("name") == class_name)).select(F.col("id").alias("src"))
        out = out.join(edges.where("label = 'HAS_FIELD'").select("src", F.col("dst").alias("id")).join(owners, "src", "left_semi"), "id", "left_semi")
    return page(out, "name", "id", offset=offset, limit=limit)


def node_by_id(nodes: DataFrame, id_: int, *types: int) -> DataFrame:
    hit = nodes.where(F.col("id") == id_)
    return hit.where(F.col("node_type").isin(*types)) if types else hit


def class_in_module(nodes: DataFrame, edges: DataFrame, name: str, module: str) -> DataFrame:
    """Classes of a name that a module of the other name contains."""
    owner = nodes.where((F.col("node_type") == NODE_TYPES["ModuleScope"]) & (F.col("name") == module)).select(F.col("id").alias("src"))
    inside = edges.where("label = 'CONTAINS'").join(owner, "src", "left_semi").select(F.col("dst").alias("id"))
    return nodes.where((F.col("node_type") == NODE_TYPES["Class"]) & (F.col("name") == name)).join(inside, "id", "left_semi")


def constructor_calls(nodes: DataFrame, file_id: int) -> DataFrame:
    """Calls in a file that make an object."""
    return nodes.where((F.col("node_type") == NODE_TYPES["FunctionCall"]) & (F.col("file_id") == file_id) & F.coalesce("is_constructor", F.lit(False)))


def constructors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(class_id, id, name): the constructors that each class contains."""
    made = nodes.where((F.col("node_type") == NODE_TYPES["Function"]) & F.coalesce("is_constructor", F.lit(False))).select("id", "name")
    owner = nodes.where(F.col("node_type") == NODE_TYPES["Class"]).select(F.col("id").alias("class_id"))
    return edges.where("label = 'CONTAINS'").select(F.col("src").alias("class_id"), F.col("dst").alias("id")).distinct().join(made, "id").join(owner, "class_id", "left_semi")


def classes_with_inheritance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(class_id, name, parents): every class with the sorted names of its direct parents."""
    c = nodes.where(F.col("node_type") == NODE_TYPES["Class"]).select(F.col("id").alias("class_id"), "name")
    up = edges.where("label = 'INHERITS'").select(F.col("src").alias("class_id"), F.col("dst").alias("id")).distinct().join(c.select(F.col("class_id").alias("id"), F.col("name").alias("parent")), "id")
    return c.join(up.groupBy("class_id").agg(F.array_sort(F.collect_list("parent")).alias("parents")), "class_id", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))


def exactly_one(df: DataFrame) -> DataFrame:
    """The only row; none or several are an error."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"wanted one row, found {'several' if rows else 'none'}")
    return df.sparkSession.createDataFrame(rows, df.schema)


def class_full(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every class with its sorted method and field names."""
    members = edges.where("label in ('CONTAINS', 'HAS_FIELD')").select(F.col("src").alias("class_id"), F.col("dst").alias("id")).distinct().join(nodes.select("id", "node_type", "name"), "id")
    named = lambda t: F.array_sort(F.collect_list(F.when(F.col("node_type").isin(*t), F.col("name"))))
    lists = members.groupBy("class_id").agg(named([7]).alias("methods"), named([4, 9]).alias("fields"))
    return nodes.where(F.col("node_type") == NODE_TYPES["Class"]).select(F.col("id").alias("class_id"), "name").join(lists, "class_id", "left")


def outgoing(edges: DataFrame, id_: int, label: str | None = None) -> DataFrame:
    return edges.where((F.col("src") == id_) & equal(F.col("label"), label))


def incoming(edges: DataFrame, id_: int, label: str | None = None) -> DataFrame:
    return edges.where((F.col("dst") == id_) & equal(F.col("label"), label))


def edges_of_file(nodes: DataFrame, edges: DataFrame, file_id: int) -> DataFrame:
    """All edges with an end in the file, once each."""
    own = nodes.where(F.col("file_id") == file_id).select("id")
    return edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")).distinct()


def resolve_reference(refs: DataFrame, nodes: DataFrame, edges: DataFrame, column: str = "ref") -> DataFrame:
    """(ref, id): a number is an id, ``Class.method`` and ``name`` the function with the smallest id; null if there is none."""
    functions = nodes.where(F.col("node_type") == NODE_TYPES["Function"]).select("id", "name")
    owner = edges.where("label = 'CONTAINS'").join(nodes.where(F.col("node_type") == NODE_TYPES["Class"]).select(F.col("id").alias("src"), F.col("name").alias("class_name")), "src").select(F.col("dst").alias("id"), "class_name")
    known = functions.join(owner, "id", "left")
    r = refs.select(F.col(column).alias("ref")).distinct()
    by_name = r.where(~is_numeric_ref(F.col("ref"))).withColumn("m", last_segment(F.col("ref"))).withColumn("c", ref_class(F.col("ref")))
    hit = by_name.join(known, F.col("m") == F.col("name")).where((F.col("c") == "") | (F.col("c") == F.col("class_name"))).groupBy("ref").agg(F.min("id").alias("id"))
    return r.join(hit, "ref", "left").select("ref", F.when(is_numeric_ref(F.col("ref")), F.col("ref").cast("long")).otherwise(F.col("id")).alias("id"))


def snippet(text: Column, first: int, last: int) -> Column:
    """Lines first..last, counted from 1, both included; carriage returns go, an empty last line doesn't count."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, "\n$", ""), "\r", ""), "\n")
    return F.array_join(F.slice(lines, first, max(0, last - first + 1)), "\n")


def line_count(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n")))


def sql_views(spark, nodes: DataFrame, edges: DataFrame, files: DataFrame) -> None:
    """Views for free queries: nodes, edges, files."""
    for name, df in (("nodes", nodes), ("edges", edges), ("files", files)):
        df.createOrReplaceTempView(name)
