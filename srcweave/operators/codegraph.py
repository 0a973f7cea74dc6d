"""Code graphs of Go, Java and C# sources: declarations by their braces, then calls, parameters, fields and data flow inside them.

Comments and strings are blanked first, so offsets stay. What opens a brace is told by the header before it; everything else
belongs to the innermost declaration or block around it. Sources need not parse: what has no closing brace ends with the file.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from srcweave.functions.signatures import MODIFIERS, top_level

MODULE, VARIABLE, CONDITIONAL, FUNCTION, CLASS, FIELD, CALL, LOOP, IMPORT = 1, 4, 6, 7, 8, 9, 10, 12, 13
_HIDE = re.compile(r"(?s)/\*.*?\*/|//[^\n]*|`[^`]*`|@\"(?:[^\"]|\"\")*\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_NAME = r"[A-Za-z_]\w*"
_TYPED = rf"(?:class|interface|struct|enum|record)\s+(?P<name>{_NAME})(?P<rest>[^;{{}}]*)$"
_GO_TYPE = re.compile(rf"\btype\s+(?P<name>{_NAME})(?:\[[^\]]*\])?\s+(?P<what>struct|interface)\s*$")
_GO_FUNC = re.compile(rf"\bfunc\s*(?:\((?P<recv>[^()]*)\)\s*)?(?P<name>{_NAME})\s*(?:\[[^\]]*\])?\s*\((?P<params>(?:[^()]|\([^()]*\))*)\)(?P<rest>[^{{}};]*)$")
_CLASS = re.compile(rf"\b{_TYPED}")
_METHOD = re.compile(rf"(?P<name>{_NAME})\s*(?:<[^<>]*>\s*)?\((?P<params>(?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)\s*(?:throws\s[^{{}};]*|where\s[^{{}};]*|:\s*(?:base|this)\s*\([^{{}};]*)?$")
_CONTROL = re.compile(r"^\s*(?:\}?\s*else\b|if\b|switch\b|select\b|for\b|foreach\b|while\b|do\b|try\b|catch\b|finally\b|using\b|lock\b|synchronized\b|fixed\b|go\b|defer\b|case\b|default\b)")
_LOOPS = ("for", "foreach", "while", "do")
#: Words before a parenthesis that call nothing.
NO_CALL = {"if", "for", "foreach", "while", "switch", "catch", "return", "new", "throw", "using", "lock", "fixed", "synchronized", "typeof", "nameof", "sizeof", "func", "else", "in", "is", "as", "and", "or", "not", "when", "where", "assert", "go", "defer", "select", "range", "case", "await", "yield", "super", "this", "base"}
_CALLS = re.compile(rf"(?<![\w.@])(?P<new>new\s+)?(?P<name>{_NAME}(?:\s*\??\.\s*{_NAME})*)\s*(?:<[\w\s,.<>\[\]?]*>\s*)?\(")
_ASSIGN = re.compile(rf"(?P<to>{_NAME}(?:\.{_NAME})*)\s*(?::=|(?<![=!<>+\-*/%&|^])=(?![=>]))(?P<value>[^;\n{{}}]*)")
_IMPORTS = {"java": re.compile(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"), "csharp": re.compile(r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;"), "go": re.compile(r"(?m)^\s*import\s+(?:[\w.]+\s+)?\"([^\"\n]+)\"|^\s+(?:[\w.]+\s+)?\"([^\"\n]+)\"\s*$")}
_PACKAGE = {"java": re.compile(r"(?m)^\s*package\s+([\w.]+)\s*;"), "csharp": re.compile(r"(?m)^\s*namespace\s+([\w.]+)"), "go": re.compile(r"(?m)^\s*package\s+(\w+)")}
_MEMBER = re.compile(rf"(?:^|[;{{}}])\s*(?:(?:\[[^\]]*\]|@{_NAME}(?:\([^()]*\))?)\s*)*(?P<type>(?:{_NAME}\s+)*[\w.<>\[\],? ]+?)\s+(?P<name>{_NAME})\s*(?:=[^;{{}}]*)?(?=;)")


def _bases(language: str, rest: str, body: str) -> list[str]:
    """Names of the types that a class extends, implements or embeds."""
    if language == "java":
        parts = re.findall(r"\b(?:extends|implements)\s+((?:(?!\bimplements\b|\bpermits\b)[^{])+)", rest)
    elif language == "csharp":
        parts = re.findall(r"(?:^|[\s>)]):\s*((?:(?!\bwhere\b)[^{])+)", " " + rest)
    else:
        return re.findall(rf"(?m)^[ \t]*\*?({_NAME}(?:\.{_NAME})?)[ \t]*$", body)
    return [re.sub(r"\(.*", "", t).strip() for p in parts for t in top_level(p) if t.strip()]


class _Builder:
    def __init__(self, file_id: int, text: str):
        self.file_id, self.seq, self.rows = file_id, 1, []
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]

    def node(self, kind: int, name: str, a: int, b: int, parent: int, extends: list[str] | None = None) -> int:
        self.seq += 1
        id_ = (self.file_id << 32) + self.seq
        self.rows.append(("node", id_, kind, self.file_id, name, bisect_left(self.breaks, a), bisect_left(self.breaks, b), extends or [], None, None, None, None))
        self.edge(parent, id_, "CONTAINS")
        return id_

    def edge(self, a: int, b: int, label: str, position: int | None = None) -> None:
        self.rows.append(("edge", None, None, self.file_id, None, None, None, [], a, b, label, position))


def _header(language: str, head: str, in_class: bool) -> tuple[int, re.Match | None] | None:
    if language == "go":
        if m := _GO_TYPE.search(head):
            return CLASS, m
        if m := _GO_FUNC.search(head):
            return FUNCTION, m
    elif m := _CLASS.search(head):
        return CLASS, m
    if m := _CONTROL.match(head):
        word = m[0].strip().lstrip("}").strip()
        return (LOOP if word in _LOOPS else CONDITIONAL if word in ("if", "else", "switch", "select") else 0), None
    if language != "go" and in_class and (m := _METHOD.search(head)) and m["name"] not in NO_CALL and "=" not in head[: m.start()]:
        return FUNCTION, m
    return None


def brace_graph(language: str, file_id: int, text: str) -> list[tuple]:
    """Rows of nodes and edges, in the layout of the Python graphs."""
    code = _HIDE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    g = _Builder(file_id, text)
    close, stack = {}, []
    for i, c in enumerate(code):
        if c == "{":
            stack.append(i)
        elif c == "}" and stack:
            close[stack.pop()] = i
    top = file_id
    if m := _PACKAGE[language].search(code):
        top = g.node(MODULE, m[1], m.start(1), m.end(1), file_id)
    for m in _IMPORTS[language].finditer(text):
        g.node(IMPORT, m[1] or m[2], m.start(), m.end(), top)

    opens = [i for i, c in enumerate(code) if c == "{"]
    scopes: list[tuple[int, int, int, int]] = []  # start of the body, end, node, kind
    open_: list[tuple[int, int, int]] = []  # end, node, kind
    classes: dict[str, int] = {}
    heads: set[int] = set()
    receivers: list[tuple[str, int]] = []
    for i in opens:
        end = close.get(i, len(code))
        while open_ and open_[-1][0] < i:
            open_.pop()
        a = max(code.rfind(x, 0, i) for x in ";{}") + 1
        in_class = any(k == CLASS for _, _, k in open_[-1:])
        found = _header(language, code[a:i], in_class)
        if not found or not found[0]:
            continue
        kind, m = found
        start = a + len(code[a:i]) - len(code[a:i].lstrip())
        parent = open_[-1][1] if open_ else top
        name = m["name"] if m else code[start:i].split(None, 1)[0].strip("(")
        if kind == CLASS:
            id_ = g.node(kind, name, start, end, parent, _bases(language, m["rest"] if language != "go" else "", code[i + 1 : end] if language == "go" and m["what"] == "struct" else ""))
            classes[name] = id_
        else:
            id_ = g.node(kind, name, start, end, parent)
        if kind == FUNCTION:
            heads.add(a + m.start("name"))
            if in_class:
                g.edge(parent, id_, "HAS_FIELD")
            if language == "go" and m["recv"]:
                receivers.append((re.sub(r"\[.*", "", m["recv"]).split()[-1].lstrip("*"), id_))
            for n, p in enumerate(top_level(m["params"])):
                words = [w for w in re.sub(r"=.*", "", p).split() if w not in MODIFIERS and not w.startswith("@") and w not in ("ref", "out", "in", "params", "this")]
                if words:
                    v = g.node(VARIABLE, (words[0] if language == "go" else words[-1]).strip("*.&"), a + m.start("params"), a + m.end("params"), id_)
                    g.edge(id_, v, "FUNCTION_ARG", n)
        open_.append((end, id_, kind))
        scopes.append((i, end, id_, kind))
    for name, id_ in receivers:
        if name in classes:
            g.edge(classes[name], id_, "HAS_FIELD")

    starts = [s[0] for s in scopes]

    def around(at: int, *kinds: int) -> tuple[int, int, int, int] | None:
        """The innermost scope of these kinds, any by default, that holds the offset."""
        k = bisect_right(starts, at) - 1
        while k >= 0 and (scopes[k][1] < at or kinds and scopes[k][3] not in kinds):
            k -= 1
        return scopes[k] if k >= 0 else None

    variables: dict[tuple[int, str], int] = {}

    def variable(name: str, at: int) -> int:
        f = around(at, FUNCTION)
        owner = f[2] if f else top
        if (owner, name) not in variables:
            variables[owner, name] = g.node(VARIABLE, name, at, at, owner)
        return variables[owner, name]

    for a, end, id_, kind in scopes:
        if kind == CLASS:  # fields are the members between the inner blocks
            body, at = list(code[a + 1 : end]), a + 1
            for b, e, _, _ in scopes[bisect_right(starts, a) :]:
                if b > end:
                    break
                body[b - at : e - at + 1] = ";" * len(body[b - at : e - at + 1])
            flat = "".join(body)
            lines = re.finditer(rf"(?m)^[ \t]*(?P<name>{_NAME})[ \t]+[\w.*\[\]{{}}]+[^\n(]*$", flat) if language == "go" else _MEMBER.finditer(flat)
            for m in lines:
                if language == "go" or m["type"].split()[-1] not in ("return", "using", "import", "package", "namespace", "new", "throw"):
                    f = g.node(FIELD, m["name"], at + m.start("name"), at + m.end("name"), id_)
                    g.edge(id_, f, "HAS_FIELD")
                    variables[id_, m["name"]] = f
    for m in _CALLS.finditer(code):
        name = re.sub(r"[\s?]", "", m["name"])
        if name in NO_CALL or m.start("name") in heads or (language == "go" and code[: m.start()].rstrip().endswith("func")):
            continue
        scope = around(m.start())
        if scope is None or scope[3] == CLASS and not m["new"] and language != "go" and not re.search(r"=[^;{}]*$", code[max(0, m.start() - 200) : m.start()]):
            continue
        g.node(CALL, name, m.start(), m.end(), scope[2])
    for m in _ASSIGN.finditer(code):
        f = around(m.start(), FUNCTION)
        if f is None:
            continue
        owner = around(f[0] - 1, CLASS)
        to = m["to"].split(".")
        field = variables.get((owner[2], to[-1])) if owner and (len(to) == 1 or to[0] == "this" or language == "go") and (f[2], to[0]) not in variables else None
        dst = field or variable(to[0], m.start())
        for s in dict.fromkeys(re.findall(rf"(?<![\w.]){_NAME}(?!\s*[(\w])", m["value"])):
            if s not in NO_CALL and s not in ("true", "false", "null", "nil", "var", "int", "string"):
                src = variable(s, m.start())
                if src != dst:
                    g.edge(src, dst, "DATA_FLOW")
    return g.rows
