"""Keyed stores as DataFrame to DataFrame functions: upserts, incremental loads, lookups, deletes and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *newest: Column) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; columns that one side lacks become null.

    Of several new rows of a key the first by ``newest`` stays; without it, the largest by all its columns, maps apart.
    """
    plain = [F.desc_nulls_last(f.name) for f in new.schema.fields if f.name not in keys and f.dataType.typeName() not in ("map", "variant")]
    fresh = latest(new, keys, *(newest or plain or [F.lit(0)]))
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def with_embedding(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows that have an embedding; null and empty ones are dropped."""
    return vectors.where(F.coalesce(F.size(column), F.lit(0)) > 0)


def write_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist, once per (src, dst, label)."""
    ids = nodes.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return out.dropDuplicates(["src", "dst", "label"])


def patch_metadata(nodes: DataFrame, patch: DataFrame, map_col: str = "md") -> DataFrame:
    """Metadata of ``patch`` (id, md) over the nodes' own; keys of the patch win, ids it doesn't name stay."""
    p = patch.select("id", F.col(map_col).alias("_p"))
    joined = nodes.join(p, "id", "left")
    own, new = F.coalesce(F.col(map_col), F.create_map().cast("map<string,string>")), F.coalesce("_p", F.create_map().cast("map<string,string>"))
    return joined.withColumn(map_col, F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(new, k)), new)).drop("_p")


def delete_repository(files: DataFrame, nodes: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, nodes and edges without the repository; an edge goes with either end."""
    gone = files.where(F.col("repo") == repo).select("file_id")
    dead = nodes.join(gone, "file_id", "left_semi").select("id")
    keep = edges.join(dead.withColumnRenamed("id", "src"), "src", "left_anti").join(dead.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return files.join(gone, "file_id", "left_anti"), nodes.join(gone, "file_id", "left_anti"), keep


def merge_placeholders(nodes: DataFrame, edges: DataFrame, module_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Placeholder classes (fake) give their edges to the one real class of the same name and module and vanish.

    ``module_of`` (id, module). Placeholders without exactly one real class stay.
    """
    classes = nodes.where("node_type = 8").join(module_of, "id")
    real = classes.where("not coalesce(fake, false)").groupBy("name", "module").agg(F.min("id").alias("real_id"), F.count("*").alias("n")).where("n = 1")
    moves = classes.where("coalesce(fake, false)").join(real, ["name", "module"]).select(F.col("id").alias("old"), "real_id")
    at = lambda e, c: e.join(moves.withColumnsRenamed({"old": c, "real_id": f"_{c}"}), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return nodes.join(moves.select(F.col("old").alias("id")), "id", "left_anti"), at(at(edges, "src"), "dst").where("src != dst").dropDuplicates(["src", "dst", "label"])


def assign_file_ids(known: DataFrame, seen: DataFrame) -> DataFrame:
    """(file_id, file_sha, relative_path, commit_id): known versions plus new ones with ids after the largest.

    A null commit equals a null commit. New ids are ranks within hash partitions plus the partitions' offsets, so no task
    holds all new versions.
    """
    keys = ["file_sha", "relative_path", "commit_id"]
    k = known.select("file_id", *keys)
    s = seen.select(*keys).distinct()
    match = (s["file_sha"] == k["file_sha"]) & (s["relative_path"] == k["relative_path"]) & s["commit_id"].eqNullSafe(k["commit_id"])
    new = s.join(k, match, "left_anti").withColumn("p", F.pmod(F.xxhash64(*keys), F.lit(256)))
    offsets = new.groupBy("p").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = known.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("top")).first()["top"]
    ranked = new.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("file_sha", "relative_path", F.col("commit_id").asc_nulls_first())))
    return k.unionByName(ranked.join(offsets.select("p", "before"), "p").select((F.lit(top) + F.col("before") + F.col("r")).cast("int").alias("file_id"), *keys))


def pending_files(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Files without a version of status ``done``."""
    return files.join(versions.where("status = 'done'").select("file_id").distinct(), "file_id", "left_anti")


def new_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks that aren't stored yet, or whose content changed at the same id."""
    h = F.sha2(F.coalesce("content", F.lit("")), 256)
    return chunks.withColumn("_h", h).join(stored.select("id", h.alias("_h")).distinct(), ["id", "_h"], "left_anti").drop("_h")


def version_stats(versions: DataFrame) -> DataFrame:
    eph = F.coalesce("ephemeral", F.lit(False))
    return versions.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.when(eph, 1).otherwise(0)), F.lit(0)).alias("ephemeral"), F.coalesce(F.sum(F.when(F.col("commit_id").isNotNull(), 1).otherwise(0)), F.lit(0)).alias("committed"))


def versions_of(versions: DataFrame, **where) -> DataFrame:
    for name, value in where.items():
        versions = versions.where(F.col(name).eqNullSafe(value))
    return versions.orderBy(F.desc("created_at"), "file_id")


def newest_first(versions: DataFrame, key: str) -> DataFrame:
    """Versions with their ``place`` within the key, 1 for the newest; ties by id and hash."""
    return versions.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("created_at"), "file_id", "file_sha")))


def set_status(versions: DataFrame, file_ids: DataFrame, status: str, now: Column | None = None) -> DataFrame:
    hit = versions.join(file_ids.select("file_id").distinct().withColumn("_hit", F.lit(True)), "file_id", "left")
    return hit.withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("_hit"), now if now is not None else F.current_timestamp()).otherwise(F.col("updated_at"))).drop("_hit")


def without_ephemeral(versions: DataFrame) -> DataFrame:
    return versions.where("not coalesce(ephemeral, false)")


def save_summaries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert on (entity_id, entity_type); of several new rows the latest wins."""
    return upsert(old, new, ["entity_id", "entity_type"], F.desc_nulls_last("updated_at"), F.desc("id"))


def needs_update(contexts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Contexts (entity_id, entity_type, context_hash) without a summary or with another hash."""
    s = summaries.select("entity_id", "entity_type", F.col("context_hash").alias("_old"))
    return contexts.join(s, ["entity_id", "entity_type"], "left").where(~F.col("context_hash").eqNullSafe(F.col("_old"))).drop("_old")


def summary_stats(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("entity_type").agg(F.count("*").alias("n"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
