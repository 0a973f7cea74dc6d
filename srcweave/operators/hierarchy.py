"""Parent-child links to full hierarchies by parallel tree contraction.

A round rakes every leaf into its parent, then splices out an independent set of unary nodes
(a hash coin per node and round picks nodes whose parent was not picked). Depth halves in
expectation on chains and shrinks by one level on bushy trees, so the number of rounds is
logarithmic for chains and never more than the height. Each round's removals are kept; replaying
them backwards gives root, depth, path and subtree size. What cannot be contracted further is a
self-loop, the remnant of a cycle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcweave.session import Scratch

BLANKS = " \t\n\r\u000b\f\u00a0\u3000"
CYCLE = "cycle"


def clean_id(c: Column) -> Column:
    """Ids compare without surrounding blanks and in lower case; empty is null."""
    return F.nullif(F.lower(F.trim(c, F.lit(BLANKS))), F.lit(""))


def links(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """One (id, parent) per distinct id; parent is null for roots.

    Repeated rows count once. If repeats name different parents, the smallest parent that exists
    in the table wins, and a repeat without a usable parent never hides one that has it. Rows whose
    id is null or blank are no nodes and are left out.
    """
    pairs = rows.select(clean_id(F.col(id_col)).alias("id"), clean_id(F.col(parent_col)).alias("parent")).where("id is not null").distinct()
    ids = pairs.select(F.col("id").alias("known")).distinct()
    usable = pairs.where("parent is not null").join(ids, F.col("parent") == F.col("known"), "left_semi")
    return pairs.select("id", F.lit(None).cast("string").alias("parent")).unionByName(usable).groupBy("id").agg(F.min("parent").alias("parent"))


def _coin(c: Column, round_no: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(round_no)), F.lit(2)) == 1


def contract(tree: DataFrame, with_path: bool = False) -> DataFrame:
    """(id, root_id, depth, n_descendants[, path]) of every node of ``tree`` (id, parent).

    ``tree`` must hold each id once and only parents that are ids (see ``links``). Nodes on or
    below a cycle get root_id 'cycle', depth -1, n_descendants -1 and a null path. The path is the array of
    ids from the root to the node. An empty table gives an empty result.
    """
    scratch = Scratch(tree.sparkSession)
    via0 = F.array().cast("array<string>")
    kids = tree.where("parent is not null").groupBy("parent").agg(F.count("*").alias("kids")).withColumnRenamed("parent", "p")
    start = tree.join(kids, F.col("id") == F.col("p"), "left").select(
        "id", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), F.lit(1).alias("len"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("carry"), via0.alias("via")
    )
    temp = [scratch.write(start)]
    active = scratch.read(start.schema, temp[0])
    raked: list[DataFrame] = []
    spliced: list[DataFrame] = []
    done: list[DataFrame] = []
    while True:
        # roots without children are complete trees, self-loops are what is left of cycles
        done.append(active.where("parent is null and kids = 0").select("id", "size"))
        open_nodes = active.where("not (parent is null and kids = 0)")
        if open_nodes.where("parent is not null and parent != id").isEmpty():
            core = open_nodes.select("id")
            break
        leaf = F.expr("kids = 0")
        raked.append(open_nodes.where(leaf).select("id", "parent", "len", "size", "via"))
        gain = (
            open_nodes.where("parent is not null")
            .groupBy(F.col("parent").alias("p"))
            .agg(F.sum(F.when(leaf, F.col("size") + F.col("carry")).otherwise(0)).alias("gain"), F.sum(F.when(leaf, 0).otherwise(1)).alias("left_kids"))
        )
        r = len(spliced)
        pick = F.expr("kids = 1 and parent is not null and parent != id") & _coin(F.col("id"), r) & ~_coin(F.col("parent"), r)
        rest = (
            open_nodes.where("kids > 0")
            .join(gain, F.col("id") == F.col("p"), "left")
            .select("id", "parent", F.coalesce("left_kids", F.lit(0)).alias("kids"), "len", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"), "carry", "via")
            .withColumn("pick", pick)
        )
        v = rest.where("pick").select(F.col("id").alias("v"), F.col("parent").alias("vp"), F.col("len").alias("vlen"), F.col("size").alias("vsize"), F.col("carry").alias("vcarry"), F.col("via").alias("vvia"))
        joined = rest.where("not pick").join(v, F.col("parent") == F.col("v"), "left").drop("pick")
        temp.append(scratch.write(joined))
        joined = scratch.read(joined.schema, temp[-1])
        spliced.append(joined.where("v is not null").select(F.col("v").alias("id"), F.col("vp").alias("parent"), F.col("vlen").alias("len"), F.col("id").alias("child"), (F.col("vsize") + F.col("carry")).alias("own"), F.col("vvia").alias("via")))
        new_via = F.concat("vvia", F.array("v"), "via") if with_path else via0
        active = joined.select(
            "id",
            F.coalesce("vp", "parent").alias("parent"),
            "kids",
            (F.col("len") + F.coalesce("vlen", F.lit(0))).alias("len"),
            "size",
            (F.col("carry") + F.coalesce(F.col("vsize") + F.col("vcarry"), F.lit(0))).alias("carry"),
            F.when(F.col("v").isNotNull(), new_via).otherwise(F.col("via")).alias("via"),
        )

    none = F.lit(None).cast("array<string>")
    first = reduce(DataFrame.unionByName, done).select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), "size", (F.array("id") if with_path else none).alias("path"))
    first = first.unionByName(core.select("id", F.lit(CYCLE).alias("root_id"), F.lit(-1).alias("depth"), F.lit(-1).cast("long").alias("size"), none.alias("path")))
    found = [scratch.write(first)]
    schema = first.schema

    def below(known: DataFrame, rec: DataFrame, size: Column, child: bool) -> DataFrame:
        up = known.select(F.col("id").alias("u"), "root_id", F.col("depth").alias("udepth"), F.col("path").alias("upath"))
        out = rec.join(up, F.col("parent") == F.col("u"))
        if child:
            down = known.select(F.col("id").alias("d"), F.col("size").alias("dsize"))
            out = out.join(down, F.col("child") == F.col("d"))
        cyc = F.col("root_id") == CYCLE
        path = F.when(~cyc, F.concat("upath", "via", F.array("id"))) if with_path else none
        return out.select("id", "root_id", F.when(cyc, -1).otherwise(F.col("udepth") + F.col("len")).alias("depth"), F.when(cyc, -1).otherwise(size).cast("long").alias("size"), path.alias("path"))

    for r in reversed(range(len(spliced))):
        known = scratch.read(schema, *found)
        more = below(known, spliced[r], F.col("own") + F.col("dsize"), True)
        found.append(scratch.write(more.unionByName(below(known.unionByName(more), raked[r], F.col("size"), False))))
    scratch.drop(*temp)
    return scratch.read(schema, *found).select("id", "root_id", "depth", F.when(F.col("root_id") == CYCLE, -1).otherwise(F.col("size") - 1).cast("int").alias("n_descendants"), *(["path"] if with_path else []))


def _tree(rows: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    return Scratch(rows.sparkSession).keep(links(rows, id_col, parent_col))


def hierarchy(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id", with_path: bool = False) -> DataFrame:
    """Roots, depths, subtree sizes and optionally paths, ids joined by ``/``, of all ids in ``rows``; other columns are ignored."""
    out = contract(_tree(rows, id_col, parent_col), with_path)
    return out.withColumn("path", F.array_join("path", "/")) if with_path else out


def descendants(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(ancestor_id, descendant_id, distance): one row per proper ancestor of each node outside cycles; ids may hold any character."""
    h = contract(_tree(rows, id_col, parent_col), True).where(F.col("depth") > 0)
    return h.select("id", "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("pos", "ancestor_id")).select("ancestor_id", F.col("id").alias("descendant_id"), (F.col("depth") - F.col("pos")).alias("distance"))
