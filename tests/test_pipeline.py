import pytest
from pyspark.sql import functions as F

from srcweave.operators import graph as G
from srcweave.operators import pipeline as P
from srcweave.operators.codegraph import brace_graph

SOURCES = {
    "java": 'package a.b;\n\nimport java.util.List;\n\npublic class Dog extends Animal implements Runner, Barker<String> {\n    private int age = 1;\n    Dog(int age) { this.age = age; }\n    /* void hidden() { } */\n    public String bark(String text, int times) throws Oops {\n        if (times > 1) { return join(text); }\n        String out = text;\n        for (int i = 0; i < times; i++) { log.write("x(" + out); }\n        return new Box(out).get();\n    }\n}\n',
    "csharp": 'using System;\nnamespace A.B\n{\n    public class Dog : Animal, IRunner\n    {\n        private int _age;\n        public string Bark(string text, int times)\n        {\n            while (times > 1) { times = Less(times); }\n            _age = times;\n            return Text.Join(text);\n        }\n    }\n}\n',
    "go": 'package dog\n\nimport (\n\t"fmt"\n\t"os"\n)\n\ntype Dog struct {\n\tAnimal\n\tage int\n}\n\nfunc (d *Dog) Bark(text string, times int) string {\n\tif times > 1 {\n\t\tfmt.Println(text)\n\t}\n\tout := text\n\td.age = times\n\treturn join(out)\n}\n\nfunc join(s string) string {\n\treturn s\n}\n',
}


def parsed(language):
    rows = brace_graph(language, 5, SOURCES[language])
    return {r[1]: r for r in rows if r[0] == "node"}, [(r[8], r[9], r[10]) for r in rows if r[0] == "edge"]


@pytest.mark.parametrize("language, calls", [("java", {"join", "log.write", "Box"}), ("csharp", {"Less", "Text.Join"}), ("go", {"fmt.Println", "join"})])
def test_nodes(language, calls):
    nodes, edges = parsed(language)
    of = lambda t: {r[4] for r in nodes.values() if r[2] == t}
    assert of(8) == {"Dog"} and of(10) >= calls and "hidden" not in of(7)
    assert {x.lower() for x in of(7)} >= {"bark"} and {"text", "times"} <= of(4) and {x.strip("_") for x in of(9)} == {"age"}
    assert {"Animal"} <= set(next(r[7] for r in nodes.values() if r[2] == 8))
    named = {(nodes[a][4], nodes[b][4]) for a, b, label in edges if label == "HAS_FIELD"}
    assert ("Dog", "Bark" if language != "java" else "bark") in named
    assert len({r[2] for r in nodes.values()} & {6, 12}) >= 1
    assert all(a in nodes or a == 5 for a, _, _ in edges) and all(b in nodes for _, b, _ in edges)


def test_bases_of_java_and_flow():
    nodes, edges = parsed("java")
    assert next(r[7] for r in nodes.values() if r[2] == 8) == ["Animal", "Runner", "Barker<String>"]
    assert ("text", "out") in {(nodes[a][4], nodes[b][4]) for a, b, label in edges if label == "DATA_FLOW"}
    assert brace_graph("java", 1, "") == [] and brace_graph("go", 1, "func (") == [] and brace_graph("java", 1, "class A { void f() { g(") != []


def test_index_resolves_calls_and_inheritance(spark):
    rows = [(1, "Dog.java", SOURCES["java"], "r", "m"), (2, "Animal.java", "class Animal { String join(String s) { return s; } }", "r", "m"), (3, "x.go", SOURCES["go"], "r", "n"), (4, "a.py", "class B(A):\n    def f(self):\n        return g(1)\n\ndef g(x):\n    return x\n", "r", None), (5, "A.java", None, "r", "m"), (4, "a.py", "x = 1", "r", None)]
    files = spark.createDataFrame(rows, "file_id int, path string, content string, repo string, module string")
    ix = P.build_index(files.where("not (file_id = 4 and content = 'x = 1')"), spark.createDataFrame([(9, "done")], "file_id int, status string"))
    names = ix.nodes.select("id", "name")
    pairs = ix.edges.join(names.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    got = {(r["a"], r["b"]) for r in pairs.where("label in ('INHERITS', 'CALLS_FUNCTION')").collect()}
    assert {("Dog", "Animal"), ("join", "join"), ("g", "g")} <= got
    bark = ix.nodes.where("name = 'bark'").select(F.col("id").alias("root"), "id")
    found = G.call_graph(G.Calls.of(ix.nodes, ix.edges), bark, "outgoing", 2).nodes.join(names, "id")
    assert {(r["name"], r["depth"]) for r in found.collect()} >= {("bark", 0), ("join", 1)}
    assert {r["chunk_type"] for r in ix.chunks.collect()} >= {"file", "class"}


def test_file_contexts(spark):
    files = spark.createDataFrame([("a.py", "x"), ("b.py", "y"), ("c.py", "z"), ("a.py", "x"), (None, "q"), ("d.py", None)], "path string, content string")
    known = spark.createDataFrame([(7, "h", "old.py", None)], "file_id int, file_sha string, relative_path string, commit_id string")
    out = P.file_contexts(files, known, files.where("path = 'b.py'").select("path"), spark.createDataFrame([("a.py", "s1"), ("b.py", "s2")], "path string, sha string"))
    got = {r["path"]: (r["ephemeral"], r["commit_id"]) for r in out.collect()}
    assert got == {"a.py": (False, "s1"), "b.py": (True, None), "c.py": (True, None)}
    assert sorted(r["file_id"] for r in out.collect()) == [8, 9, 10]
    assert {r["ephemeral"] for r in P.file_contexts(files, known, is_repository=False).collect()} == {True}
