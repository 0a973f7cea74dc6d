"""Parsing of method signatures into class, method, parameters and return type, batch-wise over Arrow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modifiers of Java signatures, fixed values.
MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "transient", "volatile", "default", "strictfp"}


def top_level(text: str, sep: str = ",") -> list[str]:
    """Split at separators outside of brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "<([{":
            depth += 1
        elif c in ">)]}":
            depth -= 1
        elif c == sep and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


def _enclosed(sig: str) -> tuple[str, str, str] | None:
    """Text before, inside and behind the parentheses that end the parameters."""
    a = sig.find("(")
    if a < 0:
        return None
    depth = 0
    for i in range(a, len(sig)):
        depth += (sig[i] == "(") - (sig[i] == ")")
        if depth == 0:
            return sig[:a].strip(), sig[a + 1 : i], sig[i + 1 :].strip()
    return None


def parse_signature(language: str | None, sig: str | None, method: str | None) -> tuple[list[str], list[str], str]:
    """(parameter names, parameter types, return type); names and types have equal lengths."""
    cut = _enclosed(sig) if sig else None
    if not cut:
        return [], [], ""
    before, inside, behind = cut
    names, types, ret = [], [], ""
    for p in top_level(inside):
        default = top_level(p, "=")[0]
        words = default.split()
        if language == "go":
            name, kind = (words[0], " ".join(words[1:])) if len(words) > 1 else ("", words[0])
        elif language in ("python", "javascript", "typescript"):
            name, _, kind = (x.strip() for x in default.partition(":"))
            name = name.lstrip("*").removeprefix("...").rstrip("?")
            if language == "python" and name in ("self", "cls", "", "/"):
                continue
        else:
            words = [w for w in words if not w.startswith("@")] or words
            name, kind = (words[-1], " ".join(words[:-1])) if len(words) > 1 else ("", words[0])
        names.append(name)
        types.append(kind)
    if language == "go":
        ret = top_level(behind[1:-1])[0].strip() if behind.startswith("(") and len(behind) > 2 else behind.removesuffix("{").strip()
    elif language == "python":
        ret = behind.removeprefix("->").strip().removesuffix(":").strip() if behind.startswith("->") else ""
    elif language in ("javascript", "typescript"):
        ret = behind[1:].removesuffix("{").strip() if behind.startswith(":") else ""
    else:
        head = before[: before.rfind(method)] if method and method in before else before.rpartition(" ")[0]
        words = [w for w in top_level(head.strip(), " ") if w not in MODIFIERS and not w.startswith("@")]
        ret = words[-1] if words else ""
    return names, types, ret


def parsed_signature(language: Column, sig: Column, method: Column) -> Column:
    """Struct of parameter names, parameter types and the return type."""

    @F.pandas_udf("struct<names:array<string>,types:array<string>,returns:string>")
    def parse(language: pd.Series, sig: pd.Series, method: pd.Series) -> pd.DataFrame:
        rows = [parse_signature(*x) for x in zip(language, sig, method)]
        return pd.DataFrame({"names": [r[0] for r in rows], "types": [r[1] for r in rows], "returns": [r[2] for r in rows]})

    return parse(language, sig, method)
