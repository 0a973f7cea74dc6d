"""Git churn: per file and per function measures, weighted scores, the top share of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcweave.session import Scratch

#: Weights of changed lines, commits and authors, fixed values.
WEIGHTS = (0.5, 0.3, 0.2)
#: Lines of a block by which functions and hunks of a file are joined.
LINES = 64
#: Keys of repeated commits up to which hunks are told by joining them; beyond, all commits go the way of repeated ones.
FEW = 10_000


def _scored(df: DataFrame, loc: str) -> DataFrame:
    changed = F.col("lines_added") + F.col("lines_deleted")
    score = changed * F.lit(WEIGHTS[0]) + F.col("commit_count") * F.lit(WEIGHTS[1]) + F.col("author_count") * F.lit(WEIGHTS[2])
    return df.withColumn("lines_changed", changed).withColumn("score", score).withColumn("density", F.when(F.col(loc) > 0, score / F.col(loc)).otherwise(F.lit(0.0))).withColumn("avg_change", F.when(F.col("commit_count") > 0, changed / F.col("commit_count")))


def file_churn(commit_files: DataFrame, commits: DataFrame, files: DataFrame, since=None, exclude_authors: tuple[str, ...] = (), exclude_paths: tuple[str, ...] = ()) -> DataFrame:
    """One row per (path, loc) of ``files``; files without commits get zeros. Merges and binary changes don't count.

    ``exclude_paths`` are regular expressions (see ``glob_regex``).
    """
    use = commits.where("not coalesce(is_merge, false)")
    use = use.where(F.col("ts") >= F.lit(since)) if since is not None else use
    use = use.where(~F.coalesce(F.col("author"), F.lit("")).isin(*exclude_authors)) if exclude_authors else use
    rows = commit_files.where("added is not null and deleted is not null")
    for p in exclude_paths:
        rows = rows.where(~F.col("path").rlike(p))
    m = rows.join(use.select("sha", "author", "ts").dropDuplicates(["sha"]), "sha").groupBy("path").agg(
        F.sum("added").alias("lines_added"), F.sum("deleted").alias("lines_deleted"), F.count("*").alias("commit_count"), F.countDistinct("author").alias("author_count"), F.min("ts").alias("first_commit"), F.max("ts").alias("last_commit")
    )
    zero = {c: 0 for c in ("lines_added", "lines_deleted", "commit_count", "author_count")}
    return _scored(files.select("path", "loc").join(m, "path", "left").fillna(zero), "loc")


def _stairs(hunks: DataFrame, who: str) -> DataFrame:
    """Rows (path, s, e, n): ``n`` summed over the rows that overlap an interval is the number of distinct ``who`` of its hunks.

    Per path and ``who`` hunks that lie within others are left out. Of the rest, ordered by start and so by end, an interval overlaps
    a run without gaps: each counts 1, and each two neighbours -1 if both overlap, which the row from the later start to the
    earlier end (it may lie before) tells. Tasks sort what they send, as equal names in a row take half the room.
    """
    w = Window.partitionBy("path", who).orderBy("s", F.desc("e"))
    top = hunks.where(F.col(who).isNotNull() & F.col("s").isNotNull() & F.col("e").isNotNull()).select("path", who, "s", "e")
    top = top.sortWithinPartitions("path", who).select("*", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("top"))
    steps = top.where("top is null or e > top").select("path", "s", "e", F.lead("s").over(w).alias("then"))
    row = lambda s, n: F.struct(F.col(s).alias("s"), F.col("e").alias("e"), F.lit(n).alias("n"))
    return steps.select("path", F.explode(F.array(row("s", 1), row("then", -1))).alias("x")).select("path", "x.*").where("s is not null")


def function_churn(functions: DataFrame, hunks: DataFrame) -> DataFrame:
    """Per function: changes of the hunks that overlap it, shared in proportion and cut to whole lines per hunk.

    ``functions`` (id, path, sl, el) with one row per id, ``hunks`` (sha, author, path, new_start, new_count, added, deleted). Overlap
    is closed with new_start + new_count as the end. Functions with the same lines are one interval. Intervals and hunks are laid
    out over blocks of LINES lines and joined by path and block, so a hot file is cut up; a pair counts in the first block that both
    share. All measures are sums, distinct commits and authors too (``_stairs``), so pairs are added up in the join's own tasks.
    A commit counts with its hunk if that is its only one in the path; to tell so, hashes travel, and the commits of equal ones are told apart.
    """
    scratch = Scratch(functions.sparkSession)
    at = lambda c: F.floor(F.col(c) / LINES).cast("int")
    over = lambda a, b: F.explode(F.sequence(at(a), F.greatest(at(a), at(b)))).alias("block")
    f = scratch.keep(functions.select("path", "sl", "el").distinct().select("*", over("sl", "el")).withColumn("f_first", F.col("block") == at("sl")))
    h = hunks.select("sha", "author", "path", F.col("new_start").alias("s"), (F.col("new_start") + F.col("new_count")).alias("e"), F.col("new_count").alias("c"), "added", "deleted", F.lit(0).alias("authors"))
    key = F.when(F.col("sha").isNotNull(), F.xxhash64("path", "sha"))
    often = scratch.write_some(h.select(key.alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    keys = scratch.read(T.StructType([T.StructField("key", T.LongType())]), often) if often else None
    if keys and keys.count() <= FEW:
        told = h.withColumn("key", key).join(keys.withColumn("again", F.lit(1)), "key", "left")
    else:
        told = h.withColumn("again", F.lit(1 if keys else None).cast("int"))
    commits = [_stairs(told.where("again = 1"), "sha").withColumnRenamed("n", "commits")] if keys else []
    rows = told.withColumn("commits", F.when(F.col("sha").isNotNull() & F.col("again").isNull(), 1).otherwise(0)).drop("sha", "author", "key", "again")
    for more in (_stairs(h, "author").withColumnRenamed("n", "authors"), *commits):
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = rows.select("*", over("s", "e")).withColumn("first", F.col("block") == at("s"))
    hit = rows.join(f, ["path", "block"]).where((F.col("sl") <= F.col("e")) & (F.col("s") <= F.col("el")) & (F.col("first") | F.col("f_first")))
    ratio = F.when(F.col("c") > 0, (F.least("el", "e") - F.greatest("sl", "s")) / F.col("c")).otherwise(F.lit(0.0))
    share = lambda c: (F.col(c) * ratio).cast("int")
    m = hit.groupBy("path", "sl", "el").agg(F.sum(share("added")).alias("lines_added"), F.sum(share("deleted")).alias("lines_deleted"), F.sum("commits").alias("commit_count"), F.sum("authors").alias("author_count"))
    zero = {c: 0 for c in ("lines_added", "lines_deleted", "commit_count", "author_count")}
    each = functions.select("id", "path", "sl", "el", (F.col("el") - F.col("sl") + 1).alias("loc")).join(m, ["path", "sl", "el"], "left")
    return _scored(each.drop("path", "sl", "el").fillna(zero), "loc")


def top_share(scored: DataFrame, percent: float, key: str = "path") -> DataFrame:
    """The best ``percent`` of the rows by score, at least one; ties by key.

    The rows are sorted in range partitions; those before the one that holds the last place are taken whole, only that one is ranked.
    """
    scratch = Scratch(scored.sparkSession)
    order = (F.desc("score"), F.col(key))
    ranged = scratch.keep(scored.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect())
    n = sum(x for _, x in sizes)
    left = max(1, int(n * percent / 100)) if n else 0
    for part, size in sizes:
        if size >= left:
            last = ranged.where(F.col("_part") == part).withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).where(F.col("_n") <= left).drop("_n")
            return ranged.where(F.col("_part") < part).unionByName(last).drop("_part")
        left -= size
    return ranged.drop("_part")


def windowed_churn(commit_files: DataFrame, commits: DataFrame, width: str = "7 days") -> DataFrame:
    """Changes per path and tumbling window."""
    return commit_files.join(commits.select("sha", "ts").dropDuplicates(["sha"]), "sha").groupBy(F.window("ts", width).alias("w"), "path").agg(F.sum(F.col("added") + F.col("deleted")).alias("lines_changed")).select(F.col("w.start").alias("start"), "path", "lines_changed")


def last_commit(commit_files: DataFrame, commits: DataFrame) -> DataFrame:
    return commit_files.join(commits.select("sha", "ts").dropDuplicates(["sha"]), "sha").groupBy("path").agg(F.max_by("sha", F.struct("ts", "sha")).alias("sha"))

