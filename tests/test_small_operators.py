import subprocess

import pytest
from pyspark.sql import functions as F

from srcweave.functions import config
from srcweave.operators import churn, graph, reader, store, summary, writers
from srcweave.schema import range_in_range
from srcweave.sources import files


@pytest.mark.parametrize("text, out", [("${A}", "1"), ("$A", "1"), ("${B:-d}", "d"), ("${B}", ""), ("$B", "$B"), ("${A:-d}x", "1x"), ("", "")])
def test_expand(text, out):
    assert config.expand(text, {"A": "1"}) == out


def test_repositories(spark):
    text = "source:\n  # the list\n  - name: a\n    path: ${ROOT}/a\n    language: go\n    disabled: true\n  - name: b\n    path: /b  # here\n"
    rows = config.repositories(spark, text, {"ROOT": "/r"}).collect()
    assert [(r["name"], r["path"], r["language"], r["disabled"]) for r in rows] == [("a", "/r/a", "go", True), ("b", "/b", None, False)]


def test_range_in_range(spark):
    cases = [((1, 0, 2, 0), (1, 0, 2, 0), True), ((1, 1, 1, 5), (1, 0, 2, 0), True), ((0, 9, 1, 5), (1, 0, 2, 0), False), ((1, 1, 2, 1), (1, 0, 2, 0), False), ((3, 0, 4, 0), (1, 0, 2, 0), False)]
    df = spark.createDataFrame([(*a, *b) for a, b, _ in cases], "a int, b int, c int, d int, e int, f int, g int, h int")
    assert [r[0] for r in df.select(range_in_range([F.col(c) for c in "abcd"], [F.col(c) for c in "efgh"])).collect()] == [x for _, _, x in cases]


def test_constructors_and_single_rows(spark):
    nodes = spark.createDataFrame([(1, 8, 5, "A", None), (2, 7, 5, "A", True), (3, 7, 5, "f", None), (4, 10, 5, "A", True), (5, 10, 5, "f", False)], "id long, node_type int, file_id int, name string, is_constructor boolean")
    edges = spark.createDataFrame([(1, 2, "CONTAINS"), (1, 2, "CONTAINS"), (1, 3, "CONTAINS")], "src long, dst long, label string")
    assert [tuple(r) for r in reader.constructors(nodes, edges).select("class_id", "id").collect()] == [(1, 2)]
    assert [r["id"] for r in reader.constructor_calls(nodes, 5).collect()] == [4]
    assert reader.exactly_one(nodes.where("id = 1")).count() == 1
    for bad in ("id = 9", "id < 3"):
        with pytest.raises(LookupError):
            reader.exactly_one(nodes.where(bad))


def test_typed_writers_check(spark):
    nodes = spark.createDataFrame([(1, 7, "f"), (2, 8, "c")], "id long, node_type int, name string")
    with pytest.raises(Exception, match="not a Function"):
        writers.write_nodes(nodes, nodes, "Function").collect()
    with pytest.raises(ValueError):
        writers.write_typed_edges(nodes, nodes, "NOPE", nodes)
    assert writers.has_collection(spark.createDataFrame([("c", "i")], "collection string, id string"), "c")


def test_upsert_takes_the_newest(spark):
    old = spark.createDataFrame([(1, "x", 0), (2, "y", 0)], "id int, v string, at int")
    new = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (1, "c", 1)], "id int, v string, at int")
    assert {tuple(r) for r in store.upsert(old, new, ["id"], F.desc("at")).collect()} == {(1, "b", 3), (2, "y", 0)}


def test_closure_of_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        graph.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long"))


def test_lazy_calls_are_the_full_ones(spark):
    nodes = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 10), (5, 10), (6, 3)], "id long, node_type int")
    edges = spark.createDataFrame([(1, 2, "CONTAINS"), (2, 6, "CONTAINS"), (6, 4, "CONTAINS"), (4, 3, "CALLS_FUNCTION"), (3, 5, "CONTAINS"), (5, 1, "CALLS_FUNCTION")], "src long, dst long, label string")
    every = graph.call_edges(nodes, edges)
    lazy = graph.Calls.of(nodes, edges)
    for direction in ("outgoing", "incoming", "both"):
        a, b = (graph.call_graph(c, graph.seeds_of(spark, [1, 3]), direction, 2) for c in (every, lazy))
        rows = lambda d, *c: sorted(map(tuple, d.select(*c).collect()))
        assert rows(a.nodes, "root", "id", "depth") == rows(b.nodes, "root", "id", "depth") != []
        assert sorted(set(rows(a.edges, "root", "src", "dst", "call_site"))) == sorted(set(rows(b.edges, "root", "src", "dst", "call_site")))
        assert a.truncated == b.truncated


def test_top_share(spark):
    df = spark.createDataFrame([(f"p{i:03d}", float(i % 50)) for i in range(200)], "path string, score double")
    want = sorted(((-(i % 50), f"p{i:03d}") for i in range(200)))[:20]
    assert {r["path"] for r in churn.top_share(df, 10).collect()} == {p for _, p in want}
    assert churn.top_share(df, 0.01).count() == 1 and churn.top_share(df.limit(0), 10).count() == 0


def test_summary_orders(spark):
    s = spark.createDataFrame([("b", "function", "n", "p", "t", 2), ("a", "class", None, "p", "t", 1)], "entity_id string, entity_type string, entity_name string, file_path string, summary string, updated_at int")
    assert [r["entity_id"] for r in summary.in_order(s).collect()] == ["a", "b"] and summary.in_order(s, True).first()["entity_id"] == "b"
    assert summary.delete_summaries(s).count() == 0
    with pytest.raises(ValueError):
        summary.find_summaries(s, summary="t")


def test_head_log_and_patches(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 2\n")
    (tmp_path / "new.py").write_text("y\n")
    assert {tuple(r) for r in files.read_head(spark, str(tmp_path), ["a.py", "new.py"]).collect()} == {("a.py", "x = 2\n")}
    commits, changes = files.parse_log(files.log_lines(spark, str(tmp_path)))
    assert commits.count() == 1 and [(r["path"], r["added"]) for r in changes.collect()] == [("a.py", 1)]
    assert [(r["new_start"], r["added"]) for r in files.parse_hunks(files.patch_lines(spark, str(tmp_path), "a.py")).collect()] == [(1, 1)]
