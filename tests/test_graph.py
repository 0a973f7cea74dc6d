"""Micro graphs that define the semantics of the searches."""

import pytest
from pyspark.sql import functions as F

from srcweave.operators import graph as G
from srcweave.operators.components import components


def calls(spark, pairs):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src long, dst long, call_site long")


def run(spark, pairs, seed=1, direction="outgoing", depth=3):
    f = G.call_graph(calls(spark, pairs), G.seeds_of(spark, [seed]), direction, depth)
    return {r["id"]: r["depth"] for r in f.nodes.collect()}, {(r["src"], r["dst"]) for r in f.edges.collect()}, f.truncated, f.edges.count()


def test_chain_is_cut_at_the_cap(spark):
    n, _, cut, _ = run(spark, [(1, 2), (2, 3), (3, 4), (4, 5)])
    assert n == {1: 0, 2: 1, 3: 2, 4: 3} and cut
    assert not run(spark, [(1, 2), (2, 3)])[2]


def test_diamond_and_shortcut(spark):
    n, e, _, _ = run(spark, [(1, 2), (1, 3), (2, 4), (3, 4)])
    assert n[4] == 2 and len(e) == 4
    assert run(spark, [(1, 2), (2, 3), (1, 3), (3, 4)], depth=2)[0] == {1: 0, 2: 1, 3: 1, 4: 2}


def test_cycles_end_and_keep_their_edges(spark):
    n, e, _, _ = run(spark, [(1, 2), (2, 1), (1, 1)])
    assert n == {1: 0, 2: 1} and e == {(1, 2), (2, 1), (1, 1)}


def test_two_call_sites_are_two_edges(spark):
    n, _, _, edges = run(spark, [(1, 2), (1, 2)])
    assert n == {1: 0, 2: 1} and edges == 2


def test_both_directions_share_what_was_seen(spark):
    n, e, _, _ = run(spark, [(0, 1), (1, 2), (2, 1)], direction="both")
    assert n == {1: 0, 2: 1, 0: -1} and (2, 1) in e


def test_call_in_a_nested_function_counts_for_both(spark):
    nodes = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (9, 10)], "id long, node_type int")
    edges = spark.createDataFrame([(1, 2, "CONTAINS"), (2, 9, "CONTAINS"), (9, 3, "CALLS_FUNCTION")], "src long, dst long, label string")
    assert {(r["src"], r["dst"]) for r in G.call_edges(nodes, edges).collect()} == {(1, 3), (2, 3)}


def test_data_flow_filter_keeps_the_edge_but_not_the_node(spark):
    nodes = spark.createDataFrame([(1, 9), (2, 4), (3, 9)], "id long, node_type int")
    edges = spark.createDataFrame([(1, 2, "DATA_FLOW"), (2, 3, "DATA_FLOW")], "src long, dst long, label string")
    f = G.data_flow(edges, nodes, G.seeds_of(spark, [1]), types=(9,))
    assert {r["id"] for r in f.nodes.collect()} == {1} and {(r["src"], r["dst"]) for r in f.edges.collect()} == {(1, 2)}
    assert {r["id"] for r in G.data_flow(edges, nodes, G.seeds_of(spark, [3]), forward=False).nodes.collect()} == {1, 2, 3}
    assert {r["id"] for r in G.data_flow(edges, nodes, G.seeds_of(spark, [1]), indirect=False).nodes.collect()} == {1, 2}


def test_inheritance_heap(spark):
    edges = spark.createDataFrame([(k, (k - 1) // 2, "INHERITS") for k in range(1, 7)], "src long, dst long, label string")
    got = {r["id"]: r["depth"] for r in G.inheritance_tree(edges, G.seeds_of(spark, [1])).collect()}
    assert got == {1: 0, 0: -1, 3: 1, 4: 1}


def test_field_access(spark):
    nodes = spark.createDataFrame([(1, 7), (2, 3), (3, 10), (4, 10), (5, 9)], "id long, node_type int")
    edges = spark.createDataFrame([(1, 2, "CONTAINS"), (2, 3, "CONTAINS"), (2, 4, "CONTAINS"), (3, 5, "HAS_FIELD"), (4, 5, "HAS_FIELD"), (4, 5, "DATA_FLOW")], "src long, dst long, label string")
    assert {(r["access"], r["n"]) for r in G.field_accessors(nodes, edges).collect()} == {("read", 1), ("write", 1)}


def test_impact_counts_what_both_reach_once(spark):
    nodes = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "id long, node_type int")
    edges = spark.createDataFrame([(1, 2, "DATA_FLOW"), (1, 3, "DATA_FLOW")], "src long, dst long, label string")
    got = {r["id"]: r["via"] for r in G.impact(calls(spark, [(2, 1)]), edges, nodes, G.seeds_of(spark, [1])).collect()}
    assert got == {2: "call_graph", 3: "data_flow"}


def test_closure_counts_paths(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "src long, dst long")
    assert G.closure(e).where("anc = 1 and desc = 4").first()["paths"] == 2


def test_empty_edges_and_bad_direction(spark):
    empty = spark.createDataFrame([], "src long, dst long, call_site long")
    assert G.call_graph(empty, G.seeds_of(spark, [1])).nodes.count() == 1
    with pytest.raises(ValueError):
        G.call_graph(empty, G.seeds_of(spark, [1]), "sideways")


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("q", "q"), (None, "a")], "src string, dst string")
    assert {tuple(r) for r in components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert components(path).select(F.min("component"), F.max("component"), F.count("*")).first() == (0, 0, 61)
    assert components(e.limit(0)).count() == 0
