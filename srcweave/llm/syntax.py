"""Source files that do not parse.

Each file is lexed into one row: the distinct pairs of adjacent tokens, its brackets in order, and
what the lexer itself rejects. Pairs are exploded and anti-joined with the pairs that the language's
grammar permits. Nesting is validated by reducing windows of brackets, statements by reducing
innermost groups to one symbol and looking for windows that no production gives. A file is broken if
any of the three objects. For Python, whose grammar the interpreter has, objections are confirmed exactly.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcweave.llm.grammars import permitted_pairs
from srcweave.llm.lexing import PATTERNS, classes, kinds, semicolons, tokens

EXTENSIONS = {"py": "python", "pyi": "python", "pyw": "python", "go": "go", "java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "cs": "csharp", "csx": "csharp"}
NAMES = {n: n for n in PATTERNS} | {"py": "python", "golang": "go", "js": "javascript", "ts": "typescript", "c#": "csharp", "cs": "csharp"}


def language_of(path: Column, label: Column) -> Column:
    """The language by the path's extension, else by the label in any case; null if neither tells."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)\s*$", 1))
    ext_map = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    name_map = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(ext_map, ext), F.try_element_at(name_map, F.lower(F.trim(label))))


_GROUPS = re.compile(r"\(([^(){}\[\]]*)\)|\[([^(){}\[\]]*)\]|\{([^(){}\[\]]*)\}")
_ANNOTATION = re.compile(r"@i(?:\.i)*P?")


def _w(language: str, *words: str) -> str:
    return "".join(kinds(language).words[w] for w in words)


def _windows(language: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Windows that no production gives, in parentheses, in brackets and in blocks, after inner groups became P, B and R."""
    never = [r"X", r"[a=o][;,)]", r"[;{(,][o.a]" if language != "typescript" else r"[;{(,][.a]"]
    block, paren = [], []
    if language in ("java", "csharp"):
        block += [r"iP[ins]", r"(?:^|[;R])ii\.", r"iii", r"[;R](?:i\.)*i[ns]"]
        paren += [r"iP[ins]"]
    if language == "java":
        never += [r"[=a+o?!]ii"]
    if language == "go":
        never += [r"[=do+!]ii"]
    if language in ("javascript", "typescript"):
        block += [r"iP[ins]"]
    if language == "javascript":
        let = _w(language, "let", "const", "var")
        block += [rf"[{let}]i:", r"i[:!]=", r"(?:^|[;R])i:i="]
        paren += [r"^[^?]*i:[^?]*$", r"^D?i\?"]
    return re.compile("|".join(never + paren)), re.compile("|".join(never)), re.compile("|".join(never + block))


_WINDOWS: dict[str, tuple[re.Pattern, re.Pattern, re.Pattern]] = {}
_SEEN: dict[tuple[str, int, str], bool] = {}


def objects(language: str, s: str) -> bool:
    """Whether a window of the token string ``s`` is none of a production's, reducing groups from the inside."""
    if language not in _WINDOWS:
        _WINDOWS[language] = _windows(language)
    seen = _SEEN
    if len(seen) > 300_000:
        seen.clear()
    bad = False

    def group(m: re.Match) -> str:
        nonlocal bad
        which = m.lastindex - 1
        body = m[m.lastindex]
        key = (language, which, body)
        if key not in seen:
            flat = _ANNOTATION.sub("", body)
            seen[key] = bool(_WINDOWS[language][which].search(flat))
        bad |= seen[key]
        return "PBR"[which]

    n = 1
    while n:
        s, n = _GROUPS.subn(group, s)
    return bad or bool(_WINDOWS[language][2].search(_ANNOTATION.sub("", s)))


_HEADS = "class def if elif else for while try except finally with".split()
_PY = re.compile(r"[()\[\]{}\n]")


def python_lines(toks: list[str]) -> tuple[str, bool]:
    """The class string with one newline per logical line, and whether indentation is broken."""
    k = kinds("python")
    heads, colon, soft = {k.words[h] for h in _HEADS} | {k.words["async"]}, ":", (k.words["match"], k.words["case"])
    out: list[str] = []
    depth, stack, bad = 0, [0], False
    line: list[str] = []
    width, opens = 0, False
    for t in toks:
        c = k[t]
        if c == "\n":
            if depth == 0:
                if line:
                    first, last = line[0], line[-1]
                    if width > stack[-1]:
                        bad |= not opens
                        stack.append(width)
                    else:
                        bad |= opens
                        while width < stack[-1]:
                            stack.pop()
                        bad |= width != stack[-1]
                    head = first in heads
                    opens = last == colon and (head or first in soft)
                    if head and not opens and colon not in line:
                        bad = True
                    out += line
                    out.append("\n")
                    line = []
                width = len(t[1:].expandtabs(8))
            continue
        if c and c in "([{":
            depth += 1
        elif c and c in ")]}":
            depth = max(0, depth - 1)
        if c:
            line.append(c)
    if line:
        bad |= opens and width <= stack[-1] or not opens and width > stack[-1]
        opens = line[-1] == colon and line[0] in heads
        out += line + ["\n"]
    return "".join(out), bad or opens


def lex(language: str, text: str) -> tuple[list[str], str, bool]:
    """(distinct adjacent pairs, brackets, whether lexer or productions object)."""
    toks = tokens(language, text)
    if language == "python":
        s, bad = python_lines(["\n" + re.match(r"[ \t\f]*", text)[0], *toks])
        bad |= "X" in s
    else:
        s = classes(language, toks)
        if language != "java" and language != "csharp":
            s = semicolons(language, s)
        bad = "X" in s or objects(language, s)
        if language == "go":
            bad |= not s.startswith(kinds("go").words["package"])
    return sorted({a + b for a, b in zip(s, s[1:])}), "".join(c for c in s if c in "()[]{}"), bad


def confirmed(language: str, text: str) -> bool:
    """Exact check of an objection where there is a parser."""
    if language != "python":
        return True
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return False
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return True


def nesting_fails(brackets: Column) -> Column:
    """Reduce the brackets from the left; an opening one and its closing one next to each other vanish."""
    closes = {")": "(", "]": "[", "}": "{"}

    def step(open_: Column, b: Column) -> Column:
        matched = F.lit(False)
        for c, o in closes.items():
            matched = matched | ((b == c) & F.endswith(open_, F.lit(o)))
        return F.when(matched, F.substring(open_, F.lit(1), F.length(open_) - 1)).otherwise(F.concat(open_, b))

    return F.length(F.aggregate(F.split(brackets, ""), F.lit(""), step)) > 0


def broken_files(files: DataFrame, key: str = "file_id", path_col: str = "file_path", language_col: str = "language", text_col: str = "content") -> DataFrame:
    """(key): files whose text is not valid in their language, once each.

    The language is that of the path's extension, else the label; files of other or unknown languages and
    null texts are not judged. Empty texts are valid but for Go, Java and C# sources, where only Go needs a declaration.
    Repeated rows count once; a key with several texts is broken if one of them is.
    """
    rows = files.select(F.col(key).alias("key"), language_of(F.col(path_col), F.col(language_col)).alias("lang"), F.col(text_col).alias("t")).where("lang is not null and t is not null")
    key_type = rows.schema["key"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lexed = [lex(lang, t.removeprefix("﻿")) for lang, t in zip(b["lang"], b["t"])]
            yield pd.DataFrame({"key": b["key"], "lang": b["lang"], "pairs": [x[0] for x in lexed], "brackets": [x[1] for x in lexed], "bad": [x[2] for x in lexed], "t": [t if lang == "python" else "" for lang, t in zip(b["lang"], b["t"])]})

    lexed = rows.mapInPandas(scan, f"key {key_type}, lang string, pairs array<string>, brackets string, bad boolean, t string")
    spark = files.sparkSession
    permitted = spark.createDataFrame([(lang, a + b) for lang in PATTERNS for a, b in permitted_pairs(lang)], "lang string, pair string")
    judged = lexed.select("key", "lang", "t", F.explode(F.concat(F.when(F.col("bad") | nesting_fails(F.col("brackets")), F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>")), "pairs")).alias("pair"))
    found = judged.join(F.broadcast(permitted), ["lang", "pair"], "left_anti")

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.drop_duplicates()
            yield b.loc[[confirmed(lang, t.removeprefix("﻿")) for lang, t in zip(b["lang"], b["t"])], ["key"]]

    return found.select("key", "lang", "t").mapInPandas(confirm, f"key {key_type}").distinct().withColumnRenamed("key", key)
