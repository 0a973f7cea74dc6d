"""Summary store: lookups, deletes, contexts for the next level, and the lists that go into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcweave.schema import LEVELS


def find_summaries(summaries: DataFrame, since=None, **where) -> DataFrame:
    """Summaries by any of entity_id, entity_type, entity_name and file_path; with ``since`` those updated after it."""
    for name, value in where.items():
        if name not in ("entity_id", "entity_type", "entity_name", "file_path"):
            raise ValueError(f"no lookup by {name}")
        summaries = summaries.where(F.col(name) == value)
    return summaries if since is None else summaries.where(F.col("updated_at") > F.lit(since))


def in_order(summaries: DataFrame, recent: bool = False) -> DataFrame:
    """By type, name and id, or the latest first."""
    return summaries.orderBy(F.desc_nulls_last("updated_at"), "entity_id") if recent else summaries.orderBy("entity_type", "entity_name", "entity_id")


def delete_summaries(summaries: DataFrame, **where) -> DataFrame:
    """What stays after deleting by entity_type and/or file_path; without a condition everything goes. Nulls never match."""
    hit = F.lit(True)
    for name, value in where.items():
        if name not in ("entity_type", "file_path"):
            raise ValueError(f"no delete by {name}")
        hit = hit & F.coalesce(F.col(name) == value, F.lit(False))
    return summaries.where(~hit)


def with_summaries(entities: DataFrame, summaries: DataFrame, kind: str) -> DataFrame:
    """Entities (entity_id, ...) with their summary of that kind, null without one; one join instead of a lookup per entity."""
    s = summaries.where(F.col("entity_type") == kind).groupBy("entity_id").agg(F.max_by("summary", F.struct("updated_at", "summary")).alias("summary"))
    return entities.join(s, "entity_id", "left")


def level_number(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for n, i in LEVELS.items() for x in (n, i)]), F.lower(name))


def level_name(number: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for n, i in LEVELS.items() for x in (i, n)]), number.cast("int"))


def top_imports(imports: DataFrame, by: str = "file_id", most: int = 20) -> DataFrame:
    """(by, name, place): the first ``most`` imports of each key, local ones (``.`` or ``/`` in front) first, then by name; repeats count once."""
    local = F.startswith("name", F.lit(".")) | F.startswith("name", F.lit("/"))
    rows = imports.where("name is not null").select(by, "name").distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.when(local, 0).otherwise(1), "name"))).where(F.col("place") <= most)


def fit_budget(items: DataFrame, budget: int, by: str = "key") -> DataFrame:
    """(by, place, name, summary): the summaries of each key cut to a budget of characters.

    An item costs its name, its summary and 10. If all fit, they stay; if the average share is below 50 characters, the
    first budget / 50 items stay, at least one; else each summary is cut to its share less name and 10, ending in dots.
    """
    of_key = Window.partitionBy(by)
    rows = items.withColumn("_n", F.count("*").over(of_key)).withColumn("_total", F.sum(F.length("name") + F.length("summary") + 10).over(of_key))
    share = F.floor(F.lit(budget) / F.col("_n")).cast("int")
    room = F.greatest(share - F.length("name") - 10, F.lit(0))
    cut = F.when(F.length("summary") <= room, F.col("summary")).when(room > 3, F.concat(F.substring("summary", F.lit(1), room - 3), F.lit("..."))).otherwise(F.substring("summary", F.lit(1), room))
    fits = F.col("_total") <= budget
    keep = fits | (share >= 50) | (F.col("place") <= max(1, budget // 50))
    return rows.where(keep).select(by, "place", "name", F.when(fits | (share < 50), F.col("summary")).otherwise(cut).alias("summary"))


def deepest_first(folders: DataFrame, path_col: str = "path") -> DataFrame:
    """Folders with their ``depth`` and the ``place`` in which they are summarised: the deepest first, then by path."""
    depth = F.size(F.filter(F.split(path_col, "/"), lambda x: (x != "") & (x != ".")))
    return folders.withColumn("depth", depth).orderBy(F.desc("depth"), path_col)


def impact_totals(impact: DataFrame) -> DataFrame:
    """(root, total, by_calls, by_data, deepest) of an impact (root, id, depth, via)."""
    n = lambda via: F.sum(F.when(F.col("via") == via, 1).otherwise(0))
    return impact.groupBy("root").agg(F.count("*").alias("total"), n("call_graph").alias("by_calls"), n("data_flow").alias("by_data"), F.max("depth").alias("deepest"))
