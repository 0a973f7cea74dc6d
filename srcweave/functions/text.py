"""Scalar functions on names, types, signatures, paths, ids and hashes, as column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension and alias tables, fixed values.
LANGUAGE_BY_EXT = {".go": "go", ".py": "python", ".java": "java", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".cs": "csharp"}
LANGUAGE_ALIASES = {"go": "go", "golang": "go", "py": "python", "python": "python", "java": "java", "js": "javascript", "javascript": "javascript", "ts": "typescript", "typescript": "typescript", "cs": "csharp", "csharp": "csharp", "c#": "csharp"}


def camel_split(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\p{Ll})(?=\p{Lu})", " ")


def last_segment(c: Column, sep: str = ".") -> Column:
    return F.substring_index(c, sep, -1)


def normalize_type(c: Column) -> Column:
    """Array marks dropped, generics opened, package removed, camel case split, blanks collapsed."""
    t = F.regexp_replace(c, r"\[\]", "")
    t = F.regexp_replace(t, "[<>,]", " ")
    return F.trim(F.regexp_replace(camel_split(last_segment(t)), r"\s+", " "))


def signature_text(class_name: Column, method: Column, params: Column, returns: Column) -> Column:
    """Text of a signature for embedding; ``params`` is an array of (name, type). An empty return type is void."""
    parts = F.flatten(F.transform(params, lambda p: F.array(normalize_type(F.coalesce(p["type"], F.lit(""))), camel_split(F.coalesce(p["name"], F.lit(""))))))
    ret = F.when(F.coalesce(returns, F.lit("")) == "", F.lit("void")).otherwise(normalize_type(returns))
    words = F.concat(F.array(camel_split(F.coalesce(class_name, F.lit(""))), camel_split(method)), F.coalesce(parts, F.array().cast("array<string>")), F.array(F.concat(F.lit("returns "), ret)))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def format_signature(method: Column, params: Column, returns: Column) -> Column:
    args = F.array_join(F.transform(params, lambda p: F.trim(F.concat_ws(" ", p["type"], p["name"]))), ", ")
    return F.concat(F.when(F.coalesce(returns, F.lit("")) == "", F.lit("")).otherwise(F.concat(returns, F.lit(" "))), method, F.lit("("), args, F.lit(")"))


def zip_params(names: Column, types: Column) -> Column:
    """Array of (name, type); the shorter side is padded with empty strings."""
    z = F.arrays_zip(names.alias("name"), types.alias("type"))
    return F.transform(z, lambda p: F.struct(F.coalesce(p["name"], F.lit("")).alias("name"), F.coalesce(p["type"], F.lit("")).alias("type")))


def symbols_match(a: Column, b: Column) -> Column:
    """Equal, or equal in the last segment, with or without case."""
    return (F.lower(a) == F.lower(b)) | (F.lower(last_segment(a)) == F.lower(last_segment(b)))


def java_symbol_name(c: Column) -> Column:
    """Method name of a Java language-server symbol such as ``Optional<User> findById(Long) : User``."""
    head = F.when(F.instr(c, "(") > 1, F.substring_index(c, "(", 1)).when(F.contains(c, F.lit(" : ")), F.substring_index(c, " : ", 1)).otherwise(c)
    return F.substring_index(F.trim(head), " ", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def language_of_path(path: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_EXT.items() for x in kv]), extension(path))


def language_alias(c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv]), F.lower(F.trim(c)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Folder of a path, '.' at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def uri_to_path(uri: Column) -> Column:
    return F.url_decode(F.regexp_replace(uri, "^file://", ""))


def path_to_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), path)


def relative_path(path: Column, root: Column) -> Column:
    r = F.regexp_replace(root, "/+$", "")
    return F.when(F.startswith(path, F.concat(r, F.lit("/"))), F.substring(path, F.length(r) + 2, F.length(path))).otherwise(path)


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def uuid_of(text: Column) -> Column:
    h = sha256(text)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def chunk_id(path: Column, name: Column, line: Column) -> Column:
    return uuid_of(F.concat_ws(":", path, name, line.cast("string")))


def signature_chunk_id(path: Column, name: Column, line: Column) -> Column:
    return uuid_of(F.concat_ws(":", path, name, line.cast("string"), F.lit("signature")))


def no_context_id(chunk: Column) -> Column:
    return uuid_of(F.concat(chunk, F.lit(":nocontext")))


def context_hash(*parts: Column) -> Column:
    """Hash of the concatenated parts, nulls as empty; list parts are joined by the caller in a stable order."""
    return sha256(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]))


def truncate(c: Column, limit: int) -> Column:
    """Cut to ``limit`` characters at the last newline, else blank, behind three quarters, with a marker."""
    cut = F.substring(c, 1, limit)
    nl = F.lit(limit) - F.instr(F.reverse(cut), "\n")
    sp = F.lit(limit) - F.instr(F.reverse(cut), " ")
    at = lambda n: F.substring(c, F.lit(1), n)
    floor = limit * 3 // 4
    return (
        F.when(F.length(c) <= limit, c)
        .when((F.instr(cut, "\n") > 0) & (nl > floor), F.concat(at(nl), F.lit("\n... (truncated)")))
        .when((F.instr(cut, " ") > 0) & (sp > floor), F.concat(at(sp), F.lit(" ... (truncated)")))
        .otherwise(F.concat(cut, F.lit("... (truncated)")))
    )


def searchable_text(module: Column, class_name: Column, signature: Column, docstring: Column, content: Column, limit: int = 8000) -> Column:
    """Context lines and content, the content cut so that the whole keeps to ``limit`` characters."""
    line = lambda c, label: F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(label), c, F.lit("\n")))
    head = F.concat(line(module, "Module: "), line(class_name, "Class: "), line(signature, ""), line(docstring, ""))
    rest, body = F.lit(limit) - F.length(head), F.coalesce(content, F.lit(""))
    return F.when(rest <= 0, head).when(F.length(body) > rest, F.concat(head, F.substring(body, F.lit(1), rest - 20), F.lit("\n// ... (truncated)"))).otherwise(F.concat(head, body))


def rename_target(path: Column) -> Column:
    """New path of a rename such as ``a => b`` or ``p/{a => b}/s``."""
    inner = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    return F.regexp_replace(F.when(F.contains(path, F.lit("{")), inner).when(F.contains(path, F.lit(" => ")), F.split(path, " => ")[1]).otherwise(path), "//", "/")


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob; ``**`` spans folders, ``*`` and ``?`` do not."""
    out = ""
    for part in re.split(r"(\*\*/?|\*|\?|\[[^\]]*\])", pattern):
        out += ".*" if part == "**" else "(?:.*/)?" if part == "**/" else "[^/]*" if part == "*" else "[^/]" if part == "?" else part.replace("[!", "[^") if part.startswith("[") and part.endswith("]") and len(part) > 1 else re.escape(part)
    return f"^{out}$"


def matches_glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def table_name(repo: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(repo, r"[^A-Za-z0-9_\-. !@#$]", "_"), r"[^A-Za-z0-9]+", "_")
    return F.regexp_replace(t, "^_+|_+$", "")


def is_entry_point(path: Column) -> Column:
    return F.lower(base_name(path)).rlike(r"main|^index|^app\.")


def hunk_field(header: Column, part: int) -> Column:
    """1..4 = old start, old count, new start, new count of ``@@ -a,b +c,d @@``; a missing count is 1."""
    pat = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    v = F.regexp_extract(header, pat, part)
    return F.when(~header.rlike(pat), F.lit(None)).when(v == "", F.lit(1)).otherwise(v.cast("int")).cast("int")


def has_annotation(annotations: Column, name: str) -> Column:
    """Whether a list of annotation JSON strings holds one of that name."""
    return F.exists(annotations, lambda a: F.get_json_object(a, "$.name") == name)


def strip_thinking(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", ""))


def is_numeric_ref(c: Column) -> Column:
    return c.rlike(r"^-?\d+$")


def ref_class(c: Column) -> Column:
    """Class of a ``Class.method`` reference, split at the last dot; empty without one."""
    return F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, r"\.[^.]*$", "")).otherwise(F.lit(""))


def external_module(path: Column, language: Column) -> Column:
    """Whether a symbol's path lies outside the repository's own sources."""
    hit = lambda *parts: F.greatest(*[F.contains(path, F.lit(p)) for p in (*parts, parts[0])])
    return (
        F.when(language == "go", hit("/go/pkg/mod/", "/usr/local/go/src/", "/vendor/"))
        .when(language == "java", hit("jdt://", ".jar", "/jdk"))
        .when(language == "python", hit("site-packages", "/lib/python", "typeshed"))
        .when(language == "csharp", hit("/.nuget/", "/dotnet/", "$metadata$"))
        .when(language.isin("typescript", "javascript"), hit("node_modules"))
        .otherwise(F.lit(False))
    )


def lines_between(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last counted from 0, both included; a last line before 0 or behind the end is the end. Null if the first line is no line."""
    lines = F.split(text, "\n", -1)
    end = F.when((last < 0) | (last >= F.size(lines)), F.size(lines) - 1).otherwise(last)
    return F.when((first >= 0) & (first < F.size(lines)) & (first <= end), F.array_join(F.slice(lines, first + 1, F.greatest(end - first + 1, F.lit(0))), "\n"))
