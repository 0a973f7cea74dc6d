"""Files that nobody wrote by hand: generated, minified, vendored or data saved as code.

Paths are matched by rules on their segments and suffixes. Notices are found by one multi-pattern automaton
run over the comment lines of the file's header only, so code that speaks of notices doesn't count.
Minified and data files are known by the shape of their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of header notices and their weights; a line's phrases add up and 2 decides. Fixed values.
NOTICES = {
    "code generated by": 2, "generated by": 1, "@generated": 2, "automatically generated": 2, "auto-generated": 1, "<auto-generated": 2, "autogenerated": 2, "auto generated": 1, "machine-written": 2, "machine-generated": 2, "machine generated": 2, "generated from": 1, "generated code": 1, "generated file": 2,
    "file was generated": 2, "file is generated": 2, "do not edit": 2, "do not modify": 2, "don't edit": 1, "not be edited": 1, "manual changes": 1, "will be lost": 1, "be overwritten": 2, "was produced by": 2, "produced by": 1, "to renew it": 1, "to regenerate": 1,
    "vendored copy": 2, "vendored from": 2, "send changes upstream": 2, "upstream:": 1, "released under": 1, "imported verbatim": 2, "copied verbatim": 2, "verbatim from": 2, "verbatim copy": 2, "copied from": 2, "taken from": 1, "see its own notice": 1, "all rights reserved": 1, "third-party": 1, "third party": 1, "forked from": 2,
    "maintained by hand": -9, "written by hand": -9, "auto-generated stub": -9, "fill in before": -9, "usual generated notice": -9,
}
#: Directories of copied or generated files, and suffixes of generated and bundled ones. Fixed values.
VENDOR_DIRS = "vendor third_party thirdparty third-party 3rdparty 3rd_party node_modules bower_components jspm_packages site-packages dist-packages external externals extern deps godeps pods carthage .store .yarn .venv venv"
PATHS = [
    r"(^|/)(" + "|".join(re.escape(d) for d in VENDOR_DIRS.split()) + ")/",
    r"(^|/)(generated|__generated__|gen-out|gen-src|autogen|generated-sources|generated-test-sources|generated_src|obj/(debug|release)|bin/(debug|release)|__pycache__|_build)/",
    r"\.(min|bundle|generated|designer|g|g\.i|pb|pb\.gw|pb\.validate|chunk|packed|gen)\.[a-z]{1,3}$",
    r"(_pb2|_pb2_grpc|_pb|_grpc_pb|_gen|_generated|_easyjson)\.[a-z]{1,3}$",
    r"[-_]min\.(js|mjs|css)$",
    r"(^|/)(zz_generated[^/]*|bindata\.go|assemblyinfo\.cs|temporarygeneratedfile_[^/]*|package-lock\.json|yarn\.lock|pnpm-lock\.yaml|go\.sum|poetry\.lock|cargo\.lock|npm-shrinkwrap\.json)$",
    r"(^|/)(dist|public|static|assets|wwwroot|build)/(.*/)?[^/]*[-.](?=[a-z]*[0-9])[0-9a-f]{8,20}\.[a-z]{1,3}$",
]


def path_flag(path: Column) -> Column:
    """Whether the path's place or name shows it; separators and case don't matter, nor blanks around."""
    p = F.lower(F.regexp_replace(F.trim(path), r"[\\/]+", "/"))
    return F.coalesce(p.rlike("|".join(f"(?:{x})" for x in PATHS)), F.lit(False))


@lru_cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, weight in NOTICES.items():
        a.add_word(phrase, (phrase, weight))
    a.make_automaton()
    return a


_HEADER = re.compile(r"\s*(?:(?:(?://|#(?!include|define|if|pragma|region)|--|;;|%)[^\n]*|/\*(?!\*)(?:[^*]|\*(?!/))*\*/|/\*\*(?:[^*]|\*(?!/))*\*/(?=[ \t]*\r?\n[ \t]*\r?\n)|<!--.*?-->)\s*)*", re.S)
_LITERAL = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`|\b(?:0[xX][0-9a-fA-F]+|\d[\d_.]*(?:[eE][+-]?\d+)?)[a-zA-Z]?\b")
_COMMENT = re.compile(r"/\*(?:[^*]|\*(?!/))*\*/|(?://|#)[^\n]*")


def notice(text: str) -> bool:
    header = _HEADER.match(text)[0].lower()
    if not header:
        return False
    upstream = 0
    for line in header.split("\n"):
        hits = {p: w for _, (p, w) in automaton().iter(line)}
        score = sum(hits.values())
        if score >= 2:
            return True
        upstream += max(0, score) if hits.keys() & {"upstream:", "released under"} else 0
    return upstream >= 2


def minified(text: str) -> bool:
    """Most of the text stands in very long lines with hardly a blank."""
    if len(text) < 300:
        return False
    long = [x for x in text.split("\n") if len(x) > 300 and not x.lstrip().startswith(("//", "#", "*", "/*", '"', "'"))]
    size = sum(map(len, long))
    return size >= 0.5 * len(text) and sum(x.count(" ") + x.count("\t") for x in long) < 0.15 * size


def data(text: str) -> bool:
    """Nearly all of the text is long runs of literals; short lists don't count."""
    if len(text) < 600 or text.count("(") * 150 > len(text):
        return False
    code = _COMMENT.sub("", text) if text.count('"') + text.count("'") < 8 else text
    found = _LITERAL.findall(code)
    size = sum(map(len, found))
    solid = len(code) - sum(map(code.count, " \t\n\r,"))
    return (len(found) >= 15 or len(found) >= 6 and size >= 40 * len(found)) and size >= 400 and size >= 0.75 * solid


def not_by_hand(text: str | None) -> bool:
    return bool(text) and (notice(text) or minified(text) or data(text))


def foreign_files(files: DataFrame, paths: list[DataFrame], key: str = "file_id", text_col: str = "content", path_col: str = "path") -> DataFrame:
    """(key): files made by a tool, minified, copied or consisting of data, once each.

    ``files`` has (key, text), each of ``paths`` (key, path): any path or text of a key is enough. Null keys,
    paths and texts are not judged. Repeated rows count once. The result is unioned from both tests without a join.
    """
    rows = files.select(F.col(key).alias("key"), F.col(text_col).alias("t")).where("key is not null and t is not null")
    key_type = rows.schema["key"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[not_by_hand(t) for t in b["t"]], ["key"]]

    out = rows.mapInPandas(scan, f"key {key_type}")
    for p in paths:
        out = out.unionByName(p.where(F.col(key).isNotNull() & path_flag(F.col(path_col))).select(F.col(key).cast(key_type).alias("key")))
    return out.distinct().withColumnRenamed("key", key)
