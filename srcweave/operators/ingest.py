"""Row generators of the index: chunks, signature chunks, Python code graphs and level-ordered summaries."""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcweave.functions.signatures import parsed_signature
from srcweave.functions.text import LANGUAGE_BY_EXT, context_hash, dir_name, format_signature, signature_chunk_id, signature_text, zip_params
from srcweave.session import Scratch

MIN_LINES = 5
CHUNKS = "id string, file_id int, chunk_type string, level int, parent_id string, start_line int, end_line int, name string, signature string, docstring string, content string"
_HEADER = re.compile(
    r"(?P<cls>\b(?:class|interface|struct|enum|record)\s+(?P<cname>\w+)[^{};]*|\btype\s+(?P<tname>\w+)\s+(?:struct|interface)\s*)\{|(?P<cond>\b(?:if|switch|else)\b[^{};]*)\{|(?P<loop>\b(?:for|foreach|while|do)\b(?:[^{}]*?))\{|(?P<fn>(?:\bfunc\s+(?:\([^)]*\)\s*)?|\bfunction\s*\*?\s*|(?<=[\s.>\]])|^)(?P<fname>[A-Za-z_]\w*)\s*(?:<[^<>(){}]*>\s*)?\((?:[^(){}]|\([^(){}]*\))*\)[^(){};]*)\{",
    re.M,
)
_CONTROL = {"if", "for", "foreach", "while", "switch", "catch", "else", "do", "return", "new", "synchronized", "using", "lock", "fixed"}
_HIDE = re.compile(r"(?s)/\*.*?\*/|//[^\n]*|`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")


def _uuid(text: str) -> str:
    h = hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:32]))


def _python_blocks(text: str) -> list[tuple[str, str, int, int, str, str]]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    kinds = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.If: "conditional", ast.Match: "conditional", ast.For: "loop", ast.AsyncFor: "loop", ast.While: "loop"}
    out = []
    for n in ast.walk(tree):
        if kind := kinds.get(type(n)):
            doc = (ast.get_docstring(n) or "") if kind in ("class", "function") else ""
            sig = f"{n.name}({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "") if kind == "function" else ""
            out.append((kind, getattr(n, "name", ""), n.lineno - 1, n.end_lineno - 1, sig, doc))
    return out


def _brace_blocks(text: str) -> list[tuple[str, str, int, int, str, str]]:
    code = _HIDE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    match, stack = {}, []
    for i, c in enumerate(code):
        if c == "{":
            stack.append(i)
        elif c == "}" and stack:
            match[stack.pop()] = i
    out = []
    pos = 0
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    while m := _HEADER.search(code, pos):
        pos = m.start() + 1 if m["fn"] and m["fname"] in _CONTROL else m.end()
        end = match.get(m.end() - 1)
        if end is None or m["fn"] and m["fname"] in _CONTROL:
            continue
        kind = "class" if m["cls"] else "conditional" if m["cond"] else "loop" if m["loop"] else "function"
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        name = m["cname"] or m["tname"] or m["fname"] or ""
        out.append((kind, name, bisect_left(breaks, start), bisect_left(breaks, end), " ".join(text[start : m.end() - 1].split()) if kind == "function" else "", ""))
    return out


def chunk_file(file_id: int, path: str, text: str, min_lines: int = MIN_LINES) -> list[tuple]:
    """File, class, function, conditional and loop chunks; blocks under ``min_lines`` lines are left out, as are short conditionals and loops."""
    lines = text.split("\n")
    ext = "." + path.rsplit(".", 1)[-1].lower()
    language = LANGUAGE_BY_EXT.get(ext)
    blocks = _python_blocks(text) if language == "python" else _brace_blocks(text) if language else []
    top = _uuid(f"{path}:{path}:0")
    out = [(top, file_id, "file", 1, "", 0, len(lines) - 1, path, "", "", text)]
    level = {"class": 2, "function": 3, "conditional": 4, "loop": 4}
    open_: list[tuple[int, str]] = []
    for kind, name, a, b, sig, doc in sorted(blocks, key=lambda x: (x[2], -x[3])):
        while open_ and open_[-1][0] < a:
            open_.pop()
        if b - a + 1 < min_lines and kind != "class":
            continue
        id_ = _uuid(f"{path}:{name or kind}:{a}")
        out.append((id_, file_id, kind, level[kind], open_[-1][1] if open_ else top, a, b, name, sig, doc, "\n".join(lines[a : b + 1]).lstrip()))
        open_.append((b, id_))
    return out


def chunk_files(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Chunks of (file_id, path, content); null texts give none."""

    def gen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        for b in batches:
            yield pd.DataFrame([r for x in zip(b["file_id"], b["path"], b["content"]) for r in chunk_file(*x, min_lines)], columns=names)

    return files.select("file_id", "path", "content").where("path is not null and content is not null").mapInPandas(gen, CHUNKS)


def signature_chunks(chunks: DataFrame) -> DataFrame:
    """(id, function_id, signature, text): a signature chunk for each function chunk that has one."""
    lang = F.lower(F.trim(F.coalesce("language", F.lit(""))))
    f = chunks.where("chunk_type = 'function' and coalesce(signature, '') != ''").select("id", "file_path", "name", "class_name", "start_line", "signature", lang.alias("language")).dropDuplicates(["id"])
    p = f.withColumn("p", parsed_signature(F.col("language"), F.col("signature"), F.col("name"))).withColumn("params", zip_params(F.col("p.names"), F.col("p.types")))
    text = signature_text(F.col("class_name"), F.col("name"), F.col("params"), F.col("p.returns"))
    return p.select(signature_chunk_id(F.col("file_path"), F.col("name"), F.col("start_line")).alias("id"), F.col("id").alias("function_id"), format_signature(F.col("name"), F.col("params"), F.col("p.returns")).alias("signature"), text.alias("text"))


# ---------------------------------------------------------------- code graph of Python sources

GRAPH = "kind string, id long, node_type int, file_id int, name string, sl int, el int, extends array<string>, src long, dst long, label string, position int"


class _Graph(ast.NodeVisitor):
    """Nodes and edges of one module: containment, parameters, calls, fields and data flow."""

    def __init__(self, file_id: int):
        self.file_id, self.seq, self.rows = file_id, 1, []
        self.scope: list[tuple[int, dict[str, int]]] = [(file_id, {})]

    def node(self, kind: int, name: str, n: ast.AST, extends: list[str] | None = None) -> int:
        self.seq += 1
        id_ = (self.file_id << 32) + self.seq
        self.rows.append(("node", id_, kind, self.file_id, name, getattr(n, "lineno", 1) - 1, (getattr(n, "end_lineno", None) or getattr(n, "lineno", 1)) - 1, extends or [], None, None, None, None))
        self.edge(self.scope[-1][0], id_, "CONTAINS")
        return id_

    def edge(self, a: int, b: int, label: str, position: int | None = None) -> None:
        self.rows.append(("edge", None, None, self.file_id, None, None, None, [], a, b, label, position))

    def inside(self, id_: int, body: list[ast.AST]) -> None:
        self.scope.append((id_, {}))
        for x in body:
            self.visit(x)
        self.scope.pop()

    def variable(self, name: str, n: ast.AST) -> int:
        for _, known in reversed(self.scope):
            if name in known:
                return known[name]
        id_ = self.node(4, name, n)
        self.scope[-1][1][name] = id_
        return id_

    def visit_ClassDef(self, n: ast.ClassDef) -> None:
        id_ = self.node(8, n.name, n, [ast.unparse(b) for b in n.bases])
        self.inside(id_, n.body)

    def visit_FunctionDef(self, n) -> None:
        id_ = self.node(7, n.name, n)
        if self.scope[-1][0] != self.file_id:
            self.edge(self.scope[-1][0], id_, "HAS_FIELD")
        self.scope.append((id_, {}))
        args = [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]
        for i, a in enumerate(args):
            v = self.node(4, a.arg, a)
            self.scope[-1][1][a.arg] = v
            self.edge(id_, v, "FUNCTION_ARG", i)
        block = self.node(3, "block", n)
        self.edge(id_, block, "BODY")
        self.scope.append((block, {}))
        for x in n.body:
            self.visit(x)
        self.scope.pop()
        self.scope.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Assign(self, n) -> None:
        targets = n.targets if isinstance(n, ast.Assign) else [n.target]
        sources = [self.variable(x.id, x) for x in ast.walk(n.value) if isinstance(x, ast.Name)] if n.value is not None else []
        if n.value is not None:
            self.visit(n.value)
        for t in targets:
            for x in ast.walk(t):
                if isinstance(x, ast.Name):
                    dst = self.variable(x.id, x)
                    for s in dict.fromkeys(sources):
                        self.edge(s, dst, "DATA_FLOW")
                elif isinstance(x, ast.Attribute):
                    self.edge(self.attribute(x), self.attribute(x), "DATA_FLOW") if not sources else [self.edge(s, self.attribute(x), "DATA_FLOW") for s in dict.fromkeys(sources)]

    visit_AnnAssign = visit_AugAssign = visit_Assign

    def attribute(self, n: ast.Attribute) -> int:
        f = self.node(9, n.attr, n)
        if isinstance(n.value, ast.Name):
            self.edge(self.variable(n.value.id, n.value), f, "HAS_FIELD")
        return f

    def visit_Attribute(self, n: ast.Attribute) -> None:
        self.attribute(n)

    def visit_Call(self, n: ast.Call) -> None:
        id_ = self.node(10, ast.unparse(n.func), n)
        for i, a in enumerate(n.args):
            if isinstance(a, ast.Name):
                self.edge(id_, self.variable(a.id, a), "FUNCTION_CALL_ARG", i)
        for a in [*n.args, *[k.value for k in n.keywords]]:
            self.visit(a)

    def visit_If(self, n: ast.If) -> None:
        id_ = self.node(6, "if", n)
        self.visit(n.test)
        for i, body in enumerate(b for b in (n.body, n.orelse) if b):
            self.scope.append((id_, {}))
            block = self.node(3, "block", body[0])
            self.edge(id_, block, "BRANCH", i)
            self.inside(block, body)
            self.scope.pop()

    def visit_For(self, n) -> None:
        id_ = self.node(12, type(n).__name__.lower(), n)
        if hasattr(n, "iter"):
            self.visit(n.iter)
        self.scope.append((id_, {}))
        block = self.node(3, "block", n)
        self.edge(id_, block, "BODY")
        self.inside(block, n.body + n.orelse)
        self.scope.pop()

    visit_AsyncFor = visit_While = visit_For

    def visit_Import(self, n) -> None:
        for a in n.names:
            self.node(13, a.name, n)

    visit_ImportFrom = visit_Import


def graph_of(file_id: int, text: str) -> list[tuple]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    g = _Graph(file_id)
    for x in tree.body:
        g.visit(x)
    return g.rows


def parse_graph(files: DataFrame) -> DataFrame:
    """Nodes and edges (column ``kind``) of Python sources (file_id, content); files that don't parse give none."""
    names = [c.split()[0] for c in GRAPH.split(", ")]

    def gen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            df = pd.DataFrame([r for i, t in zip(b["file_id"], b["content"]) for r in graph_of(int(i), t)], columns=names)
            yield df.astype({c: "Int64" for c in ("id", "src", "dst")} | {c: "Int32" for c in ("node_type", "file_id", "sl", "el", "position")})

    return files.where("file_id is not null and content is not null").mapInPandas(gen, GRAPH)


# ---------------------------------------------------------------- summaries


#: Children that are written up at once; more are folded into partial summaries of about so many first.
FAN = 1_000


def extractive(title: Column, parts: Column) -> Column:
    """Stand-in for a language model: the title and all parts."""
    return F.when(F.size(parts) > 0, F.concat(title, F.lit(": "), F.array_join(parts, "; "))).otherwise(title)


def summaries(chunks: DataFrame, files: DataFrame, write: Callable[[Column, Column], Column] = extractive) -> DataFrame:
    """(entity_id, entity_type, summary, context_hash) of functions, classes, files, folders and projects, each level from the ones below.

    ``write`` turns a title and an array of parts into a text and may be a model's user-defined function; it gets every
    child. A function belongs to the innermost class whose lines hold it, else to its file; classes belong to their
    file. Each row of ``files`` has a summary, also without chunks. Folders are made from their files and subfolders, deepest
    first; projects from their top folders and the files outside of any. Beyond FAN children, salted shares of them are
    written up first and the texts of the shares are the parts.
    """
    scratch = Scratch(chunks.sparkSession)
    text = lambda c: F.nullif(c, F.lit(""))
    cols = ["entity_id", "entity_type", "summary", "context_hash"]
    blocks = chunks.where("chunk_type in ('function', 'class') and id is not null").dropDuplicates(["id"]).select("id", "chunk_type", "file_id", "start_line", "end_line", "docstring", "signature", F.coalesce("name", F.lit("")).alias("title"), "name")
    f, c = blocks.where("chunk_type = 'function'"), scratch.keep(blocks.where("chunk_type = 'class'"))
    what = F.coalesce(text("docstring"), text("signature"), F.col("name"), F.lit(""))
    own = f.withColumn("parts", F.array(what)).withColumn("summary", write(F.col("title"), F.col("parts"))).withColumn("context_hash", context_hash(F.col("title"), F.array_join("parts", "")))
    around = c.select("file_id", F.col("id").alias("class"), F.col("start_line").alias("cs"), F.col("end_line").alias("ce"))
    inner = f.join(around, "file_id").where("cs <= start_line and end_line <= ce").groupBy("id").agg(F.max_by("class", F.struct("cs", -F.col("ce"), "class")).alias("class"))
    functions = scratch.keep(own.join(inner, "id", "left").select(F.col("id").alias("entity_id"), F.lit("function").alias("entity_type"), "summary", "context_hash", "file_id", "class"))

    def level(kind: str, parents: DataFrame, children: DataFrame) -> DataFrame:
        """``parents`` (key, title, ...) with the summary of all their ``children`` (key, entity_id, summary)."""
        titled = children.join(parents.select("key", "title"), "key")
        sums = titled.groupBy("key").agg(F.sum(F.xxhash64("entity_id", "summary").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"))
        rows = titled.join(sums.select("key", "n"), "key")
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "summary"))), lambda x: x["summary"])
        few = rows.where(F.col("n") <= FAN).select("key", "entity_id", "summary")
        salt = F.pmod(F.xxhash64("entity_id"), F.ceil(F.col("n") / FAN).cast("long"))
        shares = rows.where(F.col("n") > FAN).groupBy("key", "title", salt.alias("salt")).agg(in_order.alias("parts"))
        many = shares.select("key", F.format_string("%012d", "salt").alias("entity_id"), write(F.col("title"), F.col("parts")).alias("summary"))
        parts = few.unionByName(many).groupBy("key").agg(in_order.alias("parts"))
        # the hash covers the children order-free
        h = F.sha2(F.concat_ws("|", F.lit(kind), F.col("key").cast("string"), F.coalesce("total", F.lit(0).cast("decimal(38,0)")).cast("string"), F.coalesce("n", F.lit(0)).cast("string")), 256)
        g = parents.join(sums, "key", "left").join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<string>")))
        g = g.withColumn("summary", write(F.col("title"), F.col("parts"))).withColumn("entity_type", F.lit(kind)).withColumn("entity_id", F.col("key").cast("string")).withColumn("context_hash", h)
        return scratch.keep(g.select(*cols, *[x for x in parents.columns if x not in ("key", "title")]))

    child = lambda df, key: df.select(F.col(key).alias("key"), "entity_id", "summary")
    described = c.where(text("docstring").isNotNull()).select(F.col("id").alias("key"), F.lit("").alias("entity_id"), F.col("docstring").alias("summary"))
    classes = level("class", c.select(F.col("id").alias("key"), "title", "file_id"), child(functions.where("class is not null"), "class").unionByName(described))

    paths = files.where("file_id is not null").select("file_id", "repo", F.coalesce("path", F.lit("")).alias("path")).dropDuplicates(["file_id"])
    folder = F.when(dir_name(F.col("path")) == "", F.lit(".")).otherwise(dir_name(F.col("path")))
    depth = lambda c: F.size(F.filter(F.split(c, "/"), lambda x: (x != "") & (x != ".")))
    in_file = child(classes, "file_id").unionByName(child(functions.where("class is null"), "file_id"))
    by_file = level("file", paths.select(F.col("file_id").alias("key"), F.col("path").alias("title"), "repo", folder.alias("path")), in_file)
    above = by_file.select("repo", "path", depth(F.col("path")).alias("depth"), "entity_id", "summary")
    deepest = above.agg(F.max("depth")).first()[0] or 0

    name = F.concat_ws("/", "repo", "path")
    below, folders = None, []
    for d in range(deepest, 0, -1):
        inside = above.where(F.col("depth") == d).select("repo", "path", "entity_id", "summary")
        if below is not None:
            inside = inside.unionByName(below.select("repo", folder.alias("path"), "entity_id", "summary"))
        inside = inside.withColumn("key", name)
        below = level("folder", inside.groupBy("key").agg(F.first("key").alias("title"), F.first("repo").alias("repo"), F.first("path").alias("path")), child(inside, "key"))
        folders.append(below)
    top = above.where("depth = 0").select("repo", "entity_id", "summary")
    if below is not None:
        top = top.unionByName(below.select("repo", "entity_id", "summary"))
    top = top.withColumn("key", F.coalesce("repo", F.lit("")))
    by_project = level("project", top.groupBy("key").agg(F.first("key").alias("title")), child(top, "key"))
    out = functions.select(cols)
    for x in (classes, by_file, *folders, by_project):
        out = out.unionByName(x.select(cols))
    return out
