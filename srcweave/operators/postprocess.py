"""Resolution after parsing, for whole repositories at once: calls, inheritance and constructors by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcweave.functions.text import last_segment


def first_match(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def resolve_inheritance(classes: DataFrame) -> DataFrame:
    """(src, dst): child to parent over (id, file_id, name, extends, repo, module).

    A type name is taken by its last segment within the repository; a class of the same module wins, then the smallest
    id. Names without a class stay unresolved; a class is never its own parent.
    """
    wanted = classes.select(F.col("id").alias("src"), "repo", F.col("module").alias("m"), F.explode("extends").alias("t")).withColumn("name", last_segment(F.regexp_replace("t", "<.*$", "")))
    hit = wanted.join(classes.select(F.col("id").alias("dst"), "repo", "module", "name"), ["repo", "name"]).where("src != dst")
    return first_match(hit, ["src", "t"], F.col("module") != F.col("m"), "dst").select("src", "dst").distinct()


def resolve_constructors(calls: DataFrame, classes: DataFrame, constructors: DataFrame) -> DataFrame:
    """(call_site, dst, external): constructor calls (id, repo, module, name) to the first constructor (class_id, id) of their class."""
    hit = calls.withColumn("class_name", last_segment("name")).join(classes.select(F.col("id").alias("class_id"), "repo", F.col("name").alias("class_name"), F.col("module").alias("class_module")), ["repo", "class_name"], "left")
    best = first_match(hit, ["id"], F.col("class_module").isNull(), F.coalesce(F.col("class_module") != F.col("module"), F.lit(True)), "class_id")
    firsts = constructors.groupBy("class_id").agg(F.min("id").alias("dst"))
    return best.join(firsts, "class_id", "left").select(F.col("id").alias("call_site"), "dst", F.col("dst").isNull().alias("external"))


def names_match(a, b):
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))


def resolve_calls(calls: DataFrame, dependencies: DataFrame, functions: DataFrame) -> DataFrame:
    """(call_site, dst): calls (id, function_id, name, sl, sc) over language-server dependencies to definitions.

    A dependency (caller_id, callee_name, callee_path, sl, sc, el, ec, def_sl, def_el, external) fits if the call lies in
    its range and the names agree; a definition (id, path, name, sl, el) fits by path, name and containment of
    either range. Equi-joined on the containing function and on path, ranges as residual; the first fit wins.
    """
    d = dependencies.where("not coalesce(external, false)").withColumnsRenamed({c: f"d_{c}" for c in ("sl", "sc", "el", "ec")})
    at, lo, hi = F.struct("sl", "sc"), F.struct(F.col("d_sl").alias("sl"), F.col("d_sc").alias("sc")), F.struct(F.col("d_el").alias("sl"), F.col("d_ec").alias("sc"))
    hit = calls.where(~F.startswith("name", F.lit("__lambda__"))).join(d, calls["function_id"] == d["caller_id"]).where((at >= lo) & (at <= hi) & names_match(F.col("name"), F.col("callee_name")))
    hit = first_match(hit, ["id"], "d_sl", "d_sc", "callee_name").select(F.col("id").alias("call_site"), "callee_name", "callee_path", "def_sl", "def_el")
    f = functions.select(F.col("id").alias("dst"), F.col("path").alias("callee_path"), F.col("name").alias("fname"), F.col("sl").alias("fsl"), F.col("el").alias("fel"))
    inside = ((F.col("fsl") <= F.col("def_sl")) & (F.col("def_el") <= F.col("fel"))) | ((F.col("def_sl") <= F.col("fsl")) & (F.col("fel") <= F.col("def_el")))
    out = hit.join(f, "callee_path").where(names_match(F.col("callee_name"), F.col("fname")) & inside)
    return first_match(out, ["call_site"], "dst").select("call_site", "dst")


def lsp_call_graph(lsp: DataFrame, roots: DataFrame, max_depth: int = 2):
    """Call graph over (src, dst, external) dependencies; external functions are reached but not expanded."""
    from srcweave.operators.graph import bfs

    info = lsp.groupBy(F.col("dst").alias("id")).agg(F.max(F.coalesce("external", F.lit(False))).alias("ext"))
    edges = lsp.where("not coalesce(external, false)").select("src", "dst").distinct()
    found = bfs(edges, roots, max_depth)
    leaves = found.nodes.where(F.col("depth") < max_depth).select("root", F.col("id").alias("src"), "depth").join(lsp.where("external").select("src", "dst"), "src").groupBy("root", F.col("dst").alias("id")).agg((F.min("depth") + 1).alias("depth"))
    return found.nodes.unionByName(leaves.join(info.where("ext").select("id"), "id", "left_semi").select("root", "id", "depth")).groupBy("root", "id").agg(F.min("depth").alias("depth"))
