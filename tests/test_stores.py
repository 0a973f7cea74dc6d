import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from srcweave.operators import churn as C
from srcweave.operators import ingest as I
from srcweave.operators import postprocess as P
from srcweave.operators import reader as R
from srcweave.operators import store as T
from srcweave.operators import vector as V
from srcweave.streaming.incremental import Versioned, merge_stream


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    once = T.upsert(old, new, ["id"])
    assert rows(once) == {(1, "a"), (2, "B"), (3, "c")} == rows(T.upsert(once, new, ["id"]))


def test_file_ids_treat_null_commits_as_equal(spark):
    known = spark.createDataFrame([(4, "s", "p", None)], "file_id int, file_sha string, relative_path string, commit_id string")
    seen = spark.createDataFrame([("s", "p", None), ("s", "p", "c"), ("t", "p", None), ("t", "p", None)], "file_sha string, relative_path string, commit_id string")
    got = rows(T.assign_file_ids(known, seen))
    assert {r[0] for r in got} == {4, 5, 6} and (4, "s", "p", None) in got


def test_placeholder_classes_merge(spark):
    nodes = spark.createDataFrame([(1, 8, "A", True), (2, 8, "A", False), (3, 8, "B", True)], "id long, node_type int, name string, fake boolean")
    edges = spark.createDataFrame([(1, 9, "CONTAINS"), (3, 9, "CONTAINS")], "src long, dst long, label string")
    modules = spark.createDataFrame([(1, "m"), (2, "m"), (3, "m")], "id long, module string")
    n, e = T.merge_placeholders(nodes, edges, modules)
    assert {r["id"] for r in n.collect()} == {2, 3} and {(r["src"], r["dst"]) for r in e.collect()} == {(2, 9), (3, 9)}


def test_metadata_patch(spark):
    n = spark.createDataFrame([(1, {"a": "1"}), (2, None)], "id long, md map<string,string>")
    p = spark.createDataFrame([(1, {"a": "2", "b": "3"})], "id long, md map<string,string>")
    assert {r["id"]: r["md"] for r in T.patch_metadata(n, p).collect()} == {1: {"a": "2", "b": "3"}, 2: {}}


def test_summaries_latest_wins_and_hash_decides(spark):
    d = dt.datetime(2025, 1, 1)
    schema = "id long, entity_id string, entity_type string, summary string, context_hash string, updated_at timestamp"
    old = spark.createDataFrame([(1, "e", "file", "x", "h", d)], schema)
    new = spark.createDataFrame([(2, "e", "file", "y", "k", d), (3, "e", "file", "z", "k", d + dt.timedelta(1))], schema)
    s = T.save_summaries(old, new)
    assert [r["summary"] for r in s.collect()] == ["z"]
    ctx = spark.createDataFrame([("e", "file", "k"), ("f", "file", "k")], "entity_id string, entity_type string, context_hash string")
    assert {r["entity_id"] for r in T.needs_update(ctx, s).collect()} == {"f"}


def test_empty_stores(spark):
    v = spark.createDataFrame([], "file_id int, ephemeral boolean, commit_id string, status string")
    assert rows(T.version_stats(v)) == {(0, 0, 0)}
    assert T.pending_files(spark.createDataFrame([(1,)], "file_id int"), v).count() == 1


def test_churn(spark):
    d = dt.datetime(2025, 1, 1)
    cf = spark.createDataFrame([("s1", "a", 10, 2), ("s2", "a", 4, 0), ("s1", "b", None, None), ("m", "a", 99, 0)], "sha string, path string, added int, deleted int")
    commits = spark.createDataFrame([("s1", "x", d, False), ("s1", "x", d, False), ("s2", "y", d, None), ("m", "x", d, True)], "sha string, author string, ts timestamp, is_merge boolean")
    files = spark.createDataFrame([("a", 8), ("c", 0)], "path string, loc int")
    got = {r["path"]: r for r in C.file_churn(cf, commits, files).collect()}
    assert (got["a"]["lines_added"], got["a"]["commit_count"], got["a"]["author_count"]) == (14, 2, 2)
    assert abs(got["a"]["score"] - (16 * 0.5 + 2 * 0.3 + 2 * 0.2)) < 1e-9 and got["c"]["score"] == 0 and got["c"]["density"] == 0
    assert [r["path"] for r in C.top_share(C.file_churn(cf, commits, files), 10).collect()] == ["a"]


def test_function_churn_shares_are_cut(spark):
    f = spark.createDataFrame([(1, "p", 10, 20), (2, "p", 100, 110)], "id long, path string, sl int, el int")
    h = spark.createDataFrame([("s", "x", "p", 15, 10, 7, 3)], "sha string, author string, path string, new_start int, new_count int, added int, deleted int")
    got = {r["id"]: (r["lines_added"], r["lines_deleted"], r["commit_count"]) for r in C.function_churn(f, h).collect()}
    assert got == {1: (3, 1, 1), 2: (0, 0, 0)}


def churn_by_pairs(functions, hunks):
    out = {}
    for fid, path, sl, el in functions:
        hit = [h for h in hunks if None not in (path, sl, el, h[2], h[3], h[4]) and h[2] == path and sl <= h[3] + h[4] and h[3] <= el]
        share = lambda h, x: int(x * ((min(el, h[3] + h[4]) - max(sl, h[3])) / h[4])) if h[4] > 0 else 0  # noqa: B023, E731
        out[fid] = (sum(share(h, h[5]) for h in hit if h[5] is not None), sum(share(h, h[6]) for h in hit if h[6] is not None), len({h[0] for h in hit} - {None}), len({h[1] for h in hit} - {None}))
    return out


FUNCTIONS, HUNKS = "id long, path string, sl int, el int", "sha string, author string, path string, new_start int, new_count int, added int, deleted int"


@pytest.mark.parametrize("few", [0, 10_000])
def test_function_churn_as_by_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW", few)
    rnd = random.Random(5)
    f = [(i, rnd.choice("pqr"), s := rnd.randrange(300), s + rnd.choice((-6, 0, 3, 20, 90, 250))) for i in range(200)]
    f += [(1000, None, 1, 9), (1001, "p", None, 9), (1002, "p", 1, None), (1003, "none", 1, 9), (1004, "p", 0, 400)]
    h = [(rnd.choice((None, *(f"c{i}" for i in range(60)))), rnd.choice((None, "x", "y", "z", *(f"u{i}" for i in range(40)))), rnd.choice("pq"), rnd.randrange(330), rnd.choice((0, 0, 1, 5, 12, 70, 200)), rnd.choice((None, 0, 7, 333)), rnd.randrange(50)) for _ in range(400)]
    h += [(f"one{i}", "x", "p", rnd.randrange(330), 9, 5, 5) for i in range(50)] + [("n", "x", None, 1, 5, 5, 5), ("n", "x", "p", None, 5, 5, 5), ("n", "x", "p", 1, None, 5, 5), ("n", "neg", "p", 90, -40, 5, 5)]
    for hunks in (h, [x for x in h if (x[0] or "").startswith("one")], []):
        got = C.function_churn(spark.createDataFrame(f, FUNCTIONS), spark.createDataFrame(hunks, HUNKS)).collect()
        assert {r["id"]: (r["lines_added"], r["lines_deleted"], r["commit_count"], r["author_count"]) for r in got} == churn_by_pairs(f, hunks) and len(got) == len(f)


def test_function_churn_shuffles_no_pairs(spark):
    store = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    stages = lambda: [x for s in [store()] for x in map(s.apply, range(s.size()))]
    before = max((x.stageId() for x in stages()), default=-1)
    f = [(i, "p", 10, 20 + i % 3) for i in range(300)]
    h = [(f"c{i}", f"a{i}", "p", 12 + i % 5, 6, 4, 2) for i in range(300)]
    got = C.function_churn(spark.createDataFrame(f, FUNCTIONS), spark.createDataFrame(h, HUNKS)).collect()
    assert {(r["commit_count"], r["author_count"]) for r in got} == {(300, 300)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert sum(x.shuffleWriteRecords() for x in stages() if x.stageId() > before) < 10_000  # of 90,000 pairs


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [0.0, 0.0]), ("e", None), ("f", [1.0])], "id string, embedding array<float>")
    hits = V.top_k(v, [[1.0, 0.0], [0.0, 1.0]], 2)
    assert [(r["id"], r["rank"]) for r in hits.where("query = 0").orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert V.best_of(hits, 1).first()["id"] == "a"


def test_reader(spark):
    f = spark.createDataFrame([(1, "r", "a/x.go", "go"), (2, "r", "b/y.py", "python"), (3, None, "z", None)], "file_id int, repo string, path string, language string")
    assert rows(R.list_repos(f)) == {("r",)}
    assert [r["file_id"] for r in R.find_files(f, repo="r", offset=1).collect()] == [2]
    assert [r["file_id"] for r in R.find_files(f, path_like="*/x.go", glob=True).collect()] == [1]
    t = spark.createDataFrame([("a\r\nb\nc\n",), ("",)], "t string")
    assert [r[0] for r in t.select(R.snippet(F.col("t"), 1, 2)).collect()][0] == "a\nb"
    assert [r[0] for r in t.select(R.line_count(F.col("t"))).collect()] == [3, 0]


def test_inheritance_prefers_the_module(spark):
    c = spark.createDataFrame([(1, 1, "Base", [], "r", "m1"), (2, 2, "Base", [], "r", "m2"), (3, 2, "Kid", ["pkg.Base<T>", "Gone"], "r", "m2"), (4, 3, "Other", ["Base"], "r", "m9")], "id long, file_id int, name string, extends array<string>, repo string, module string")
    assert rows(P.resolve_inheritance(c)) == {(3, 2), (4, 1)}


def test_constructors(spark):
    calls = spark.createDataFrame([(10, "r", "m", "A"), (11, "r", "m", "Gone")], "id long, repo string, module string, name string")
    classes = spark.createDataFrame([(1, "r", "A", "x"), (2, "r", "A", "m")], "id long, repo string, name string, module string")
    ctors = spark.createDataFrame([(2, 21), (2, 20), (1, 5)], "class_id long, id long")
    assert rows(P.resolve_constructors(calls, classes, ctors)) == {(10, 20, False), (11, None, True)}


def test_calls_resolve_by_range_and_name(spark):
    calls = spark.createDataFrame([(1, 100, "svc.save", 5, 3)], "id long, function_id long, name string, sl int, sc int")
    deps = spark.createDataFrame([(100, "save", "p", 5, 0, 5, 20, 40, 45, False), (100, "load", "p", 5, 0, 5, 20, 1, 2, False)], "caller_id long, callee_name string, callee_path string, sl int, sc int, el int, ec int, def_sl int, def_el int, external boolean")
    fns = spark.createDataFrame([(7, "p", "save", 40, 50), (8, "p", "load", 1, 2)], "id long, path string, name string, sl int, el int")
    assert rows(P.resolve_calls(calls, deps, fns)) == {(1, 7)}


def test_chunks_and_python_graph(spark):
    py = "class A(Base):\n    def f(self, x):\n        y = x\n        z = g(y)\n        if z:\n            a = 1\n            b = 2\n            c = 3\n            d = 4\n        return y\n"
    java = "public class B {\n  int add(int a) {\n    // {\n    for (int i = 0; i < a; i++) {\n      a += 1;\n      a += 2;\n      a += 3;\n    }\n    return a;\n  }\n}\n"
    f = spark.createDataFrame([(1, "a.py", py), (2, "B.java", java), (3, "bad.py", "def ("), (4, "n.py", None)], "file_id int, path string, content string")
    got = {(r["file_id"], r["chunk_type"], r["start_line"], r["end_line"]) for r in I.chunk_files(f).collect()}
    assert {(1, "class", 0, 9), (1, "function", 1, 9), (1, "conditional", 4, 8), (2, "class", 0, 10), (2, "function", 1, 9), (2, "loop", 3, 7), (3, "file", 0, 0)} <= got
    g = I.parse_graph(f.where("file_id = 1").select("file_id", "content")).collect()
    assert {(r["node_type"], r["name"]) for r in g if r["kind"] == "node"} >= {(8, "A"), (7, "f"), (10, "g"), (4, "x")}
    assert any(r["label"] == "DATA_FLOW" for r in g) and [r["extends"] for r in g if r["name"] == "A"] == [["Base"]]


def test_stream_merge_is_repeatable(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a")], "id int, v string").write.parquet(src)
    store = Versioned(spark, str(tmp_path / "store"))
    merge = lambda old, new: new.dropDuplicates(["id"]) if old is None else T.upsert(old, new, ["id"])
    run = lambda ck: merge_stream(spark.readStream.schema("id int, v string").parquet(src), store, merge, str(tmp_path / ck)).awaitTermination()
    run("ck")
    spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string").write.mode("append").parquet(src)
    run("ck")
    assert rows(store.read()) == {(1, "b"), (2, "c")}


def test_summaries_take_every_child(spark, monkeypatch):
    monkeypatch.setattr(I, "FAN", 10, raising=False)
    schema = "id string, file_id int, chunk_type string, name string, docstring string, signature string, start_line int, end_line int"
    chunks = [(f"f{i}", 1, "function", f"n{i}", f"<doc{i}>", None, 10 * i, 10 * i + 5) for i in range(60)]
    chunks += [("c", 1, "class", "C", "<class doc>", None, 0, 309), ("g", 2, "function", "g", None, "<sig>", 0, 9)]
    files = [(1, "r", "a/b/x.py"), (2, "r", "a/y.py"), (3, "r", "z.py")] + [(i, "r", f"d{i}/w.py") for i in range(10, 50)]
    got = I.summaries(spark.createDataFrame(chunks, schema), spark.createDataFrame(files, "file_id int, repo string, path string")).collect()
    text = {(r["entity_type"], r["entity_id"]): r["summary"] for r in got}
    assert len(text) == len(got) == 61 + 1 + 43 + 42 + 1
    docs = [f"<doc{i}>" for i in range(60)]
    assert all((d in text["class", "c"]) == (i <= 30) for i, d in enumerate(docs)) and "<class doc>" in text["class", "c"]
    for x in (("file", "1"), ("folder", "r/a/b"), ("folder", "r/a"), ("project", "r")):
        assert all(text[x].count(d) == 1 for d in [*docs, "<class doc>"]), x
    assert "<sig>" in text["folder", "r/a"] and "<sig>" not in text["folder", "r/a/b"]
    assert all(f"d{i}/w.py" in text["project", "r"] for i in range(10, 50)) and text["file", "3"] == "z.py" and "z.py" in text["project", "r"]


def test_summaries_of_nothing(spark):
    schema = "id string, file_id int, chunk_type string, name string, docstring string, signature string, start_line int, end_line int"
    assert I.summaries(spark.createDataFrame([], schema), spark.createDataFrame([], "file_id int, repo string, path string")).count() == 0


def test_every_twentieth_vector_against_all(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 700, raising=False)
    import numpy as np

    x = np.random.default_rng(3).integers(-4, 5, (21_000, 3)).astype(float)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<float>")
    queries = v.where("id % 20 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    got = {}
    for r in V.top_k(v, queries, 3).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"], round(r["score"], 9)))
    used = [i for i in range(0, 21_000, 20) if x[i].any()]
    assert sorted(got) == used and len(used) > 1_000
    n = np.sqrt((x * x).sum(1))
    for i in used[:: 50]:
        with np.errstate(all="ignore"):
            s = np.where(n > 0, x @ x[i] / (n * n[i]), -9).round(9)
        want = np.lexsort((np.arange(len(s)), -s))[:3]
        assert [y for _, _, y in sorted(got[i])] == [s[j] for j in want]
    lists = V.top_k(v.limit(10), [[1.0, 2.0, 3.0]] * 1_001, 1)
    assert lists.select("query").distinct().count() == 1_001
