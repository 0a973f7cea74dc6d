"""The property graph that the star-schema tables stand for, as typed node and edge tables.

Keys are dense from 0: nations are files, suppliers classes (a heap of inheritance), parts functions, small line
items calls, orders variables with a data flow along each customer's orders. Call ids are built per order, so no
global ordering is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcweave.schema import node_id
from srcweave.session import table

LANGUAGES = ("go", "python", "java", "javascript", "csharp")
EXTENSIONS = ("go", "py", "java", "js", "cs")
CALL_BASE = 1 << 62


@dataclass
class Graph:
    files: DataFrame  # file_id, repo, path, language, module
    nodes: DataFrame  # id, node_type, file_id, name, sl, el, class_id
    edges: DataFrame  # src, dst, label

    def labelled(self, label: str) -> DataFrame:
        return self.edges.where(F.col("label") == label).select("src", "dst")

    def of_type(self, *types: int) -> DataFrame:
        return self.nodes.where(F.col("node_type").isin(*types))


def star_graph(spark: SparkSession, sf: str) -> Graph:
    pick = lambda k, values: F.element_at(F.array(*map(F.lit, values)), (k % len(values)).cast("int") + 1)
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    files = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        (F.col("n_nationkey") + 1).cast("int").alias("file_id"), F.col("r_name").alias("repo"),
        F.concat(F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit("."), pick(F.col("n_nationkey"), EXTENSIONS)).alias("path"),
        pick(F.col("n_nationkey"), LANGUAGES).alias("language"), F.concat(F.lit("mod_"), F.lower("r_name")).alias("module"),
    )
    supplier, part = table(spark, sf, "supplier"), table(spark, sf, "part")
    classes_n, functions_n = supplier.count(), part.count()
    file_of_class = supplier.select(F.col("s_suppkey").alias("class_key"), (F.col("s_nationkey") + 1).cast("int").alias("file_id"), F.col("s_name").alias("class_name"))
    seq = lambda base, key: node_id(F.col("file_id"), F.lit(base) + F.col(key))
    classes = file_of_class.select(seq(1_000_000, "class_key").alias("id"), "file_id", F.col("class_name").alias("name"), "class_key")
    functions = part.withColumn("class_key", F.col("p_partkey") % classes_n).join(file_of_class, "class_key").select(
        seq(2_000_000, "p_partkey").alias("id"), seq(4_000_000, "p_partkey").alias("block"), "file_id", F.col("p_name").alias("name"), (F.col("p_partkey") % 500).cast("int").alias("sl"), (F.col("p_partkey") % 500 + F.col("p_size")).cast("int").alias("el"), seq(1_000_000, "class_key").alias("class_id"), "p_partkey",
    )
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    small = table(spark, sf, "lineitem").where("l_quantity <= 4").select("*", (F.lit(CALL_BASE) + F.col("l_orderkey") * 64 + rank).alias("call"), (F.col("l_orderkey") % functions_n).alias("caller"))
    callers = functions.select(F.col("p_partkey").alias("caller"), F.col("id").alias("caller_id"), "block", "file_id")
    callees = functions.select(F.col("p_partkey").alias("l_partkey"), F.col("id").alias("callee_id"), F.col("name").alias("callee"))
    calls = small.join(callers, "caller").join(callees, "l_partkey")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    owner = file_of_class.select(F.col("class_key").alias("l_suppkey"), F.col("file_id").alias("owner_file"))
    touched = small.join(owner, "l_suppkey").select("call", "l_discount", node_id(F.col("owner_file"), F.lit(200_000_000) + F.col("l_suppkey") * 4 + flag).alias("field"), node_id(F.col("owner_file"), F.lit(1_000_000) + F.col("l_suppkey")).alias("class_id"), "owner_file", "l_returnflag")
    fields = touched.select("field", "class_id", F.col("owner_file").alias("file_id"), F.concat(F.lit("flag_"), "l_returnflag").alias("name")).distinct()
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") + 1).cast("int").alias("file_id"))
    orders = table(spark, sf, "orders").join(customer, "o_custkey").select("o_custkey", "o_orderdate", "o_orderkey", "file_id", seq(100_000_000, "o_orderkey").alias("id"))
    flows = orders.select(F.col("id").alias("src"), F.lead("id").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("dst")).where("dst is not null")

    none = F.lit(None).cast("int")
    node = lambda df, t, id_, name, sl=none, el=none, cls=F.lit(None).cast("long"): df.select(F.col(id_).cast("long").alias("id"), F.lit(t).alias("node_type"), "file_id", name.alias("name"), sl.alias("sl"), el.alias("el"), cls.alias("class_id"))
    module = files.select(node_id(F.col("file_id"), F.lit(1)).alias("id"), "file_id", "module")
    nodes = (
        node(files, 2, "file_id", F.col("path"))
        .unionByName(node(module, 1, "id", F.col("module")))
        .unionByName(node(classes, 8, "id", F.col("name")))
        .unionByName(node(functions, 7, "id", F.col("name"), F.col("sl"), F.col("el"), F.col("class_id")))
        .unionByName(node(calls, 10, "call", F.col("callee")))
        .unionByName(node(fields, 9, "field", F.col("name"), none, none, F.col("class_id")))
        .unionByName(node(orders, 4, "id", F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))))
    )
    blocks = calls.select("caller_id", "block", "file_id").distinct()
    nodes = nodes.unionByName(node(blocks, 3, "block", F.lit("block")))
    edge = lambda df, src, dst, label: df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), F.lit(label).alias("label"))
    heap = classes.where("class_key > 0").withColumn("parent_key", F.floor((F.col("class_key") - 1) / 2))
    parents = classes.select(F.col("class_key").alias("parent_key"), F.col("id").alias("parent_id"))
    edges = (
        edge(module, "file_id", "id", "CONTAINS")
        .unionByName(edge(classes.withColumn("m", node_id(F.col("file_id"), F.lit(1))), "m", "id", "CONTAINS"))
        .unionByName(edge(functions, "class_id", "id", "CONTAINS"))
        .unionByName(edge(fields, "class_id", "field", "CONTAINS"))
        .unionByName(edge(blocks, "caller_id", "block", "CONTAINS"))
        .unionByName(edge(calls, "block", "call", "CONTAINS"))
        .unionByName(edge(calls, "call", "callee_id", "CALLS_FUNCTION"))
        .unionByName(edge(heap.join(parents, "parent_key"), "id", "parent_id", "INHERITS"))
        .unionByName(edge(touched, "call", "field", "HAS_FIELD"))
        .unionByName(edge(touched.where("l_discount < 0.03"), "call", "field", "DATA_FLOW"))
        .unionByName(edge(flows, "src", "dst", "DATA_FLOW"))
        .unionByName(edge(functions, "class_id", "id", "HAS_FIELD"))
        .unionByName(edge(fields, "class_id", "field", "HAS_FIELD"))
    )
    return Graph(files, nodes, edges)
