import pytest

from srcweave.llm import syntax
from srcweave.llm.grammars import permitted_pairs

GOOD = {
    "python": "import os\n\n@wrap(1)\nasync def f(a: int, *b, c=1, **d) -> dict[str, int]:\n    '''doc'''\n    x = [i for i in b if i not in (1, 2)]\n    with open(a) as g, h:\n        pass\n    return {**d, 'k': x[1:2], 'l': lambda y: y * -1} if a else None\n\nmatch = 3\ntype X = int\nmatch x:\n    case [1, *_]:\n        y = 1\n",
    "go": 'package p\n\nimport (\n\t"fmt"\n\tm "math"\n)\n\ntype T[K comparable] struct {\n\ta, b int `json:"a"`\n\t*M\n}\n\nfunc (t *T) F(a int, b ...string) (x int, err error) {\n\tfor i, v := range b {\n\t\tif v == "" || i < 3 {\n\t\t\tcontinue\n\t\t}\n\t}\n\tgo func() { t.c <- 1 }()\n\tdefer x.y()\n\tswitch z := a.(type) {\n\tcase int:\n\t\treturn m[1:2][0], nil\n\tdefault:\n\t\tx++\n\t}\n\tvar q = map[string][]int{"a": {1, 2}}\n\treturn\n}\n',
    "java": 'package a.b;\n\nimport java.util.*;\n\n@Ann(x = 1)\npublic final class C<T extends D & E> extends F<G<H>> implements I, J {\n  private static final int[] A = {1, 2};\n  @Override public <R> R m(final List<? super T> a, int... b) throws K {\n    for (int i = 0, j = 1; i < 10; i++, j--) { a.get(i).<X>n()[j] += (int) b[i] >>> 2; }\n    for (var v : a) if (v instanceof Q q) continue; else break;\n    Runnable r = () -> System.out.println("x" + \'c\' + C::new);\n    return switch (x) { case 1, 2 -> 3; default -> { yield 4; } };\n  }\n  enum N { P, Q(1) { } ; }\n  record R(int a) { }\n}\n',
    "csharp": 'using A.B;\nusing static C.D;\n\nnamespace E.F;\n\n[Attr("x", Y = 1)]\npublic sealed class G<T> : H, I<T> where T : class, new()\n{\n    private readonly Dictionary<string, int?> _d = new();\n    public int P { get; private set; } = 3;\n    public async Task<int> M(ref int a, params string[] b) => await Q(a, out var c);\n    void N() {\n        foreach (var (k, v) in _d) { if (v is int n && n > 3) yield return k; }\n        var s = $"a{1}" + @"c\\" ?? x?.y![1];\n        var z = q switch { > 1 and < 3 => "a", null => "b", _ => throw new X() };\n        try { } catch (E e) when (e.F) { } finally { }\n        var l = from i in s where i > 1 select i;\n    }\n}\n',
    "javascript": "import a, { b as c } from './d';\nexport default class E extends F {\n  static #g = 1;\n  get h() { return this.i?.j ?? [1, , 2]; }\n  async *k(l = 2, ...m) { for await (const n of m) yield* n; }\n}\nconst o = async (p) => ({ ...p, [q]: r => r ** 2, s })\nlet re = /[/]x+/g.test(t) ? `u${v}` : w\nif (x) y(); else z()\nexport { o as default }\n",
    "typescript": "import type { A } from './b';\n@Comp({ x: 1 })\nexport abstract class C<T extends A = B> implements D<T> {\n  private readonly e?: Map<string, F[]>;\n  constructor(public g: number, @Inj() private h!: I) { super(); }\n  abstract j(k: (l: string) => void): asserts k is M;\n}\ntype N = { [K in keyof O]?: P extends infer Q ? Q[] : never } & R | 'lit';\nenum S { T = 1, U }\nfunction v<W>(x: W): x is Y { return <any>x as unknown as Z; }\nlet aa: [b: string, c?: number] = ['x']\n",
}


def broken(language, text):
    pairs, brackets, bad = syntax.lex(language, text)
    stack = ""
    for c in brackets:
        stack = stack[:-1] if c in ")]}" and stack[-1:] == {")": "(", "]": "[", "}": "{"}[c] else stack + c
    return (bad or bool(stack) or any((p[0], p[1]) not in permitted_pairs(language) for p in pairs)) and syntax.confirmed(language, text)


@pytest.mark.parametrize("language", sorted(GOOD))
def test_valid_sources_pass(language):
    pairs, _, bad = syntax.lex(language, GOOD[language])
    from srcweave.llm.lexing import kinds

    n = kinds(language).names
    assert not [f"{n[p[0]]} {n[p[1]]}" for p in pairs if (p[0], p[1]) not in permitted_pairs(language)]
    assert not bad and not broken(language, GOOD[language])


@pytest.mark.parametrize("language", sorted(GOOD))
def test_breakage_is_found(language):
    t = GOOD[language]
    lines = t.split("\n")
    assert broken(language, t[: t.rindex("(") + 1])
    assert broken(language, "\n".join([*lines[:4], "<<<<<<< HEAD", lines[4], "=======", lines[4], ">>>>>>> other", *lines[5:]]))
    assert broken(language, "# Some heading\n\nThis file holds plain words, not code; it's a note.\n" + t[:0])
    assert broken(language, "--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n-x = 1\n+x = (2\n")
    others = [x for x in GOOD if x != language and not (x == "javascript" and language == "typescript")]
    assert all(broken(language, GOOD[x]) for x in others), [x for x in others if not broken(language, GOOD[x])]


def test_strings_and_comments_hide_their_content():
    assert not broken("java", 'class A { String s = "x = ("; // }\n /* { */ }')
    assert not broken("csharp", 'class A { string s = @"\n<<<<<<< ours\n"; }')


def test_operator(spark):
    rows = [(1, "a.py", None, "x = (1"), (2, "b.PY", "java", "x = 1"), (3, "noext", "Java ", "class A {"), (4, "c.txt", None, "(("), (5, "d.go", None, None), (6, "e.py", None, ""), (6, "e.py", None, ""), (7, "f.js", None, ""), (8, "g.go", None, "package p\n" + "// x\n" * 50_000)]
    df = spark.createDataFrame(rows, "file_id int, file_path string, language string, content string").withColumnsRenamed({})
    assert {r[0] for r in syntax.broken_files(df).collect()} == {1, 3}
    assert syntax.broken_files(df.limit(0)).count() == 0
