import pytest
from pyspark.sql import functions as F

from srcweave import schema as SC
from srcweave.functions import text as X
from srcweave.functions.signatures import parse_signature, parsed_signature
from srcweave.functions.vectors import cosine, dot, euclid
from srcweave.sources import files as FS


def one(spark, build, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").select(F.col("i"), build(F.col("s")).alias("o")).orderBy("i").select("o").collect()]


def test_camel_split_and_types(spark):
    assert one(spark, X.camel_split, "findByEmail", "UserService", "getHTTPClient", "ID", "XMLParser", "") == ["find By Email", "User Service", "get HTTPClient", "ID", "XMLParser", ""]
    assert one(spark, X.normalize_type, "List<User>", "Map<String, User>", "com.example.User", "String[]", "ResponseEntity<List<UserDto>>") == ["List User", "Map String User", "User", "String", "Response Entity List User Dto"]


def test_signature_text(spark):
    df = spark.createDataFrame([(["email"], ["String"], "User"), ([], [], "")], "n array<string>, t array<string>, r string")
    p = X.zip_params(F.col("n"), F.col("t"))
    got = df.select(X.signature_text(F.lit("UserService"), F.lit("findByEmail"), p, F.col("r")).alias("a"), X.format_signature(F.lit("findByEmail"), p, F.col("r")).alias("b")).collect()
    assert tuple(got[0]) == ("User Service find By Email String email returns User", "User findByEmail(String email)")
    assert got[1]["a"] == "User Service find By Email returns void"


@pytest.mark.parametrize(
    "language, sig, method, expected",
    [
        ("java", "public User findByEmail(String email)", "findByEmail", (["email"], ["String"], "User")),
        ("java", "public static Map<String, User> all(final Map<String, Integer> m, int n)", "all", (["m", "n"], ["final Map<String, Integer>", "int"], "Map<String, User>")),
        ("go", "func Save(ctx context.Context, user *User) (int, error)", "Save", (["ctx", "user"], ["context.Context", "*User"], "int")),
        ("python", "def f(self, a: dict[str, int] = {}, *args) -> list[int]", "f", (["a", "args"], ["dict[str, int]", ""], "list[int]")),
        ("typescript", "run(x: Map<string, number>, y?: string): Promise<void>", "run", (["x", "y"], ["Map<string, number>", "string"], "Promise<void>")),
        ("java", None, None, ([], [], "")),
        ("java", "noParens", "noParens", ([], [], "")),
    ],
)
def test_parse_signature(language, sig, method, expected):
    assert parse_signature(language, sig, method) == expected


def test_parse_signature_column(spark):
    df = spark.createDataFrame([("go", "func A(x int) int", "A"), (None, None, None)], "l string, s string, m string")
    assert [r[0]["returns"] for r in df.select(parsed_signature(F.col("l"), F.col("s"), F.col("m"))).collect()] == ["int", ""]


def test_names_and_paths(spark):
    assert one(spark, X.last_segment, "com.example.MyClass.Method", "pkg.", ".Method", "Method", "") == ["Method", "", "Method", "Method", ""]
    assert one(spark, X.java_symbol_name, "findByOwnerId(Long) : List<PetDto>", "Optional<User> findById(Long)", "getName : String", "") == ["findByOwnerId", "findById", "getName", ""]
    assert one(spark, X.rename_target, "a => b", "p/{a => b}/s", "p/{ => b}/s", "p/{a => }/s", "plain") == ["b", "p/b/s", "p/b/s", "p/s", "plain"]
    assert one(spark, X.table_name, "bot-go", "my repo!@#$name", "-bot-go-", "my.repo/name") == ["bot_go", "my_repo_name", "bot_go", "my_repo_name"]
    assert one(spark, X.language_of_path, "a/B.PY", "x.tsx", "README", "m.go") == ["python", "typescript", None, "go"]
    assert one(spark, X.is_entry_point, "a/main.go", "index.ts", "src/App.tsx", "other.py", "remain.py") == [True, True, True, False, True]
    assert one(spark, lambda c: X.matches_glob(c, "src/**/*.go"), "src/a/b.go", "src/b.go", "src/b.py", "x/src/b.go") == [True, True, False, False]


def test_truncate_and_chunk_ids(spark):
    assert one(spark, lambda c: X.truncate(c, 10), "short", "aaaaaaaa bbbb", "aaaaaaaaaaaaaa", "aaaaaaaa\nbbb") == ["short", "aaaaaaaa ... (truncated)", "aaaaaaaaaa... (truncated)", "aaaaaaaa\n... (truncated)"]
    a = one(spark, lambda c: X.chunk_id(c, F.lit("f"), F.lit(3)), "p.py")[0]
    assert len(a) == 36 and a.count("-") == 4


def test_ranges(spark):
    df = spark.range(1).select(SC.range_text(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("r"))
    assert df.select("r", SC.range_part(F.col("r"), 3)).first() == ("(1,2)-(3,4)", 3)
    inside = lambda line, ch: spark.range(1).select(SC.in_range(F.lit(line), F.lit(ch), F.lit(1), F.lit(2), F.lit(3), F.lit(4))).first()[0]
    assert inside(1, 2) and inside(3, 4) and inside(2, 0) and not inside(1, 1) and not inside(3, 5)
    assert spark.range(1).select(SC.file_of(SC.node_id(F.lit(5), F.lit(77)))).first()[0] == 5


def test_similarities(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    r = df.select(F.round(cosine(F.col("a"), F.col("b")), 6), dot(F.col("a"), F.col("b")), F.round(euclid(F.col("a"), F.col("b")), 6)).collect()
    assert tuple(r[0]) == (0.707107, 1.0, 1.0) and r[1][0] is None and r[2][0] is None


def test_skip_rules(spark):
    assert one(spark, FS.skip_directory, "a/.git/x", "src/vendor/x.go", "src/x.go", "x") == [True, True, False, False]
    assert one(spark, FS.skip_file, "a/README.md", "go.sum", "a/b.PNG", "x/node_modules/a.js", "src/a.js") == [True, True, True, True, False]
    assert one(spark, lambda c: FS.skip_file(c, F.lit("go")), "a.go", "a.py") == [False, True]


def test_log_and_hunks(spark):
    log = ["abcdef1|ann|2025-01-02T03:04:05+00:00", "", "3\t1\tsrc/{a => b}/x.go", "-\t-\tlogo.png", "abcdef2|bob|2025-01-03T00:00:00+00:00", "5\t0\ty.go"]
    commits, files = FS.parse_log(spark.createDataFrame(list(enumerate(log)), "n long, value string"))
    assert {(r["sha"], r["author"]) for r in commits.collect()} == {("abcdef1", "ann"), ("abcdef2", "bob")}
    assert {tuple(r) for r in files.collect()} == {("abcdef1", "src/b/x.go", 3, 1), ("abcdef2", "y.go", 5, 0)}
    patch = ["--- a/x", "+++ b/x", "@@ -1,2 +1,3 @@ f", " a", "+b", "-c", "+d", "@@ -9 +10 @@", "+z"]
    h = FS.parse_hunks(spark.createDataFrame([("x", i, v) for i, v in enumerate(patch)], "path string, n int, value string"))
    assert {tuple(r) for r in h.collect()} == {("x", 1, 2, 1, 3, 2, 1), ("x", 9, 1, 10, 1, 1, 0)}


def test_read_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "node_modules/b.py").write_text("y = 1\n")
    assert [(r["path"], r["content"]) for r in FS.read_tree(spark, str(tmp_path)).collect()] == [("src/a.py", "x = 1\n")]
