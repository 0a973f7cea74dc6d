import pytest
from pyspark.sql import functions as F

from srcweave.llm import provenance as P


@pytest.mark.parametrize(
    "path, expected",
    [("src/Vendor/x/a.py", True), ("third_party\\x\\a.go", True), ("a/node_modules/b.js", True), ("packages/.store/x/a.ts", True), ("build/generated/a.java", True), ("a/x.min.js", True), ("a/y.pb.go", True), ("a/Z.Designer.cs", True), ("a/z_pb2.py", True), ("dist/app-8fcf8d28.js", True)]
    + [("src/vendors/a.py", False), ("app/generators/a.ts", False), ("src/external_api/a.go", False), ("lib/build/a.py", False), ("pkg/distance/a.ts", False), ("a/minifyThing.ts", False), (None, False)],
)
def test_paths(spark, path, expected):
    assert spark.createDataFrame([(path,)], "p string").select(P.path_flag(F.col("p"))).first()[0] is expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("// Code generated by tool. DO NOT EDIT.\npackage x", True),
        ("# This file is machine-written. Run make x to renew it.\n\nimport os", True),
        ("// <auto-generated>\n//  This file was produced by x 1.2\n// </auto-generated>\n\nusing A;", True),
        ("// Vendored copy of libx @ abc. Send changes upstream.\n\nx", True),
        ("# libx 1.2 - released under a permissive licence by the libx authors\n# upstream: https://x.example\n\nimport os", True),
        ("// Writes files that start with the usual generated notice; this one is maintained by hand.\npackage x", False),
        ('package x\n\nvar a = "Code generated by x. DO NOT EDIT."\n// DO NOT EDIT', False),
        ("/** Auto-generated stub, fill in before the release. */\nfunction f() {}", False),
        ("", False),
    ],
)
def test_notices(text, expected):
    assert P.notice(text) is expected


def test_minified_and_data():
    assert P.minified("var a=1;" * 200)
    assert not P.minified("x = 1\n" * 300 + "# " + "word " * 100)
    table = "T = [\n" + "".join("    " + " ".join(f"{i * 7 % 256}," for i in range(16)) + "\n" for _ in range(20)) + "]\n"
    assert P.data(table) and not P.data('NAMES = [\n    "a", "b", "c",\n]\n')


def test_operator(spark):
    f = spark.createDataFrame([(1, "// @generated by x from y"), (2, "x"), (2, "x"), (3, None), (None, "z"), (4, "y")], "file_id int, content string")
    paths = spark.createDataFrame([(4, "vendor/a.go", 1), (2, None, 2), (None, "vendor/b.go", 3)], "file_id int, path string, content int")
    assert {r[0] for r in P.foreign_files(f, [paths]).collect()} == {1, 4}
    assert P.foreign_files(f.limit(0), [paths.limit(0)]).count() == 0
