"""Connected components of an undirected link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcweave.session import Scratch


def components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): the smallest id of each component, by alternating large and small stars.

    Each round links every larger neighbour, then every smaller one, to the smallest neighbour; the
    links become stars around the minimum after a logarithmic number of rounds. Null ends and
    self-links are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(links.sparkSession)
    a, b = F.col(src), F.col(dst)
    edges = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    path = scratch.write(edges)
    edges = scratch.read(edges.schema, path)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new_path = scratch.write(small)
        new = scratch.read(edges.schema, new_path)
        changed = not new.join(edges, ["u", "v"], "left_anti").isEmpty() or new.count() != edges.count()
        scratch.drop(path)
        edges, path = new, new_path
        if not changed:
            break
    centres = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(centres)
