import pytest

from srcweave.llm import docpairs as D
from srcweave.llm.peg import Grammar

SOURCES = {
    "python": 'class A:\n    @wrap("x")\n    async def load_rows(\n        self, a: dict[str, int] = {"(": 1},\n    ) -> int:\n        """Reads every row once and drops empty ones.\n\n        Args:\n            a: the map\n        """\n\ndef bare():\n    return "def fake(): \'\'\'no text here at all, really\'\'\'"\n',
    "go": "package p\n\n// LoadRows: Reads every row once and drops empty ones.\nfunc (s *S) LoadRows(a int) error {\n}\n\n// Detached words that stand above a blank line.\n\nfunc Bare() {}\n",
    "java": "class A {\n    /**\n     * Reads every row once and drops empty ones.\n     *\n     * @param a the map\n     */\n    @Ann(\"x\")\n    public static Map<String, List<B>> loadRows(final int a) throws X {\n    }\n\n    /** A field that is described with words. */\n    private int x = f(1);\n}\n",
    "typescript": "export class A {\n  /**\n   * Reads every row once and drops empty ones.\n   * @returns rows\n   */\n  private async loadRows<T>(a: Map<string, T>): Promise<T[]> {\n  }\n}\n",
    "javascript": "const s = `/** not a real comment, just text */\nfunction no() {}`;\n/** Reads every row once and drops empty ones. */\nexport const loadRows = async (a, b = {}) => {\n};\n",
    "csharp": "class A\n{\n    /// <summary>\n    /// Reads every row once and drops empty ones.\n    /// </summary>\n    /// <param name=\"a\">the map</param>\n    [HttpGet(\"x\")]\n    public async Task<Dictionary<string, int>> LoadRows(int a) {\n    }\n}\n",
}
LINES = {"python": 2, "go": 3, "java": 7, "typescript": 5, "javascript": 3, "csharp": 7}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_pairs(language):
    t = SOURCES[language]
    got = [(t[:a].count("\n"), D.plain(language, raw)) for a, n, s, raw in D.functions(language, t) if D.informative(D.plain(language, raw), n)]
    assert [g[0] for g in got] == [LINES[language]]
    assert "Reads every row once" in got[0][1] and "the map" not in got[0][1]


@pytest.mark.parametrize("text", ["", "Gets the row.", "TODO: write the documentation for this function later.", "{@inheritDoc}", "------------------------------", "loadRows(a, b);", "Load the rows of the loader.", "Auto-generated stub, fill in before the release.", "FIXME"])
def test_trivial(text):
    assert not D.informative(text, "loadRows")


@pytest.mark.parametrize("text", ["Reads every row once and drops empty ones.", "Si deux branches changent la même ligne, la plus récente l'emporte.", "読み込み処理は正しく動き、警告も消えました。"])
def test_real(text):
    assert D.informative(text, "loadRows")


def test_packrat():
    g = Grammar("S <- A* end:'x' !~.~\nA <- '(' A* ')' / ~[ab]~")
    assert g.match("(a(b))bx", "S", 0) == (8, {"end": (7, 8)})
    assert g.match("(a", "S", 0) is None


def test_operator(spark):
    rows = [(1, "a.go", None, SOURCES["go"], "k"), (1, "a.go", None, SOURCES["go"], "k"), (2, "b.txt", None, "x", "k"), (3, "c.py", None, None, "k"), (4, "d.py", None, "", "k")]
    df = spark.createDataFrame(rows, "file_id int, file_path string, language string, content string, name string")
    assert [(r["file_id"], r["line_no"], r["name"]) for r in D.documented_functions(df).collect()] == [(1, 3, "LoadRows")]


@pytest.mark.parametrize("depth", [200, 5_000, 300_000])
def test_deep_nesting_ends(spark, depth):
    doc = "/** Adds the given numbers up in their order. */\n"
    text = doc + "int first(int a) {\n}\n" + doc + "int f(" + "(" * depth + "\n" + doc + "int last(int a) {\n}\n"
    rows = [(1, "A.java", None, text)]
    out = D.documented_functions(spark.createDataFrame(rows, "file_id int, file_path string, language string, content string")).collect()
    assert {r["name"] for r in out} >= {"first", "last"}


JAVADOC, XMLDOC, GODOC, PYDOC = "/** Adds the given numbers up in their order. */\n", "/// <summary>Adds the given numbers up in their order.</summary>\n", "package p\n\n// Adds the given numbers up in their order.\n", '"""Adds the given numbers up in their order."""'


@pytest.mark.parametrize(
    "language, name, text",
    [
        ("java", "été", JAVADOC + "void été(int a) {\n}\n"),
        ("java", "f", JAVADOC + "public /* x */ static\n  java.lang.@N String @M [] f() {\n}\n"),
        ("java", "f", JAVADOC + '@A("""\n a "b" c\n""")\nvoid f() {\n}\n'),
        ("java", "Point", "record Point(int a) {\n" + JAVADOC + "public Point {\n}\n"),
        ("java", "f", JAVADOC + "@A(" + "(" * 300_000 + "1" + ")" * 300_000 + ")\nvoid f() {\n}\n"),
        ("java", None, "enum E {\n" + JAVADOC + "Point {\n}\n"),
        ("csharp", "Bar", XMLDOC + "void IFoo.Bar(int a) {\n}\n"),
        ("csharp", "Bar", XMLDOC + "Task<int> A.IFoo<int>.Bar<T>(T a) where T : class => x;\n"),
        ("csharp", "operator +", XMLDOC + "public static X operator +(X a, X b) {\n}\n"),
        ("csharp", "operator Y", XMLDOC + "public static implicit operator Y(X a) => a;\n"),
        ("csharp", "F", XMLDOC + "public ref readonly global::System.Int32 F(int x) {\n}\n"),
        ("csharp", "F", XMLDOC + '[A(@"c:\\")]\npublic void F(int x) {\n}\n'),
        ("csharp", "A", XMLDOC + "~A() {\n}\n"),
        ("csharp", None, XMLDOC + "public int F => G(1);\n"),
        ("javascript", "f", JAVADOC + "f: async function (a) {\n}\n"),
        ("javascript", "f", JAVADOC + "A.prototype.f = (a) => {\n}\n"),
        ("javascript", "f", JAVADOC + "f(a = /[)]/g, b = `x${`)`}`) {\n}\n"),
        ("javascript", "f", "const r = /[/*]/;\n" + JAVADOC + "function f(a) {\n}\n"),
        ("javascript", "f", "const r = `a ${b ? `http://x` : c} d`;\n" + JAVADOC + "function f(a) {\n}\n"),
        ("javascript", None, "const r = `a ${b ? `\n" + JAVADOC + "function f(a) {}\n` : c} d`;\n"),
        ("javascript", "f", "const r = `a ${ b\n" + JAVADOC + "function f(a) {\n}\n"),
        ("javascript", "f", JAVADOC + "function f(a = " + "(" * 300_000 + "1" + ")" * 300_000 + ") {\n}\n"),
        ("javascript", None, JAVADOC + "exports.f = g(1);\n"),
        ("typescript", "f", JAVADOC + "const f = (a: number): { x: number } => {\n};\n"),
        ("typescript", "f", JAVADOC + "private f: (a: T) => void = (a) => {\n}\n"),
        ("typescript", None, JAVADOC + "f: (a: T) => void;\n"),
        ("go", "Été", GODOC + "func Été /* x */ (a int) {\n}\n"),
        ("python", "f", f'def f[T: (int, "]")](a: T) -> \\\n  T:\n    {PYDOC}\n'),
        ("python", "f", 'def f(a):\n    "Adds the given " \\\n    "numbers up in their order."\n'),
        ("python", "f", f"def f(a):\n    ({PYDOC})\n"),
        ("python", None, f"def f(a):\n    {PYDOC}.format(a)\n"),
        ("python", None, f"def f(a):\n    f{PYDOC}\n"),
    ],
)
def test_no_function_is_left_out(language, name, text):
    got = [n for _, n, _, raw in D.functions(language, text) if D.informative(D.plain(language, raw), n)]
    assert got == ([name] if name else [])
