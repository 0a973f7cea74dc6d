"""Configuration texts: environment expansion and repository rows."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

SOURCES = "name string, path string, test string, language string, disabled boolean, skip_other_languages boolean"


def expand(text: str, env: Mapping[str, str] | None = None) -> str:
    """``${V}`` and ``${V:-d}`` give the value, else the default or nothing; ``$V`` stays as it is without a value."""
    env = os.environ if env is None else env
    text = re.sub(r"\$\{([^}:]+)(?::-([^}]*))?\}", lambda m: env.get(m[1], m[2] or ""), text)
    return re.sub(r"\$([A-Za-z_]\w*)", lambda m: env.get(m[1], m[0]), text)


def repositories(spark: SparkSession, text: str, env: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of a source list: ``- key: value`` items of flat keys, comments and other sections left out."""
    rows, kinds = [], {"true": True, "false": False}
    names = [c.split()[0] for c in SOURCES.split(", ")]
    for line in expand(text, env).splitlines():
        m = re.match(r"\s*(-\s+)?(\w+):\s*(.*?)\s*(?:#.*)?$", line)
        if not m or line.lstrip().startswith("#"):
            continue
        if m[1]:
            rows.append({})
        if rows and m[2] in names:
            value = m[3].strip("\"'")
            rows[-1][m[2]] = kinds.get(value.lower(), False) if m[2] in names[4:] else value or None
    return spark.createDataFrame([tuple(r.get(n, False if n in names[4:] else None) for n in names) for r in rows], SOURCES)
