"""Source scans: files of a directory tree, prune and skip rules, git logs and patches as tables."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcweave.functions.text import base_name, extension, hunk_field, language_alias, language_of_path, rename_target

#: Fixed lists of what is never read.
SKIP_DIRS = (".git", "node_modules", ".vscode", ".idea", "vendor", "target", "build", "dist", "__pycache__", ".pytest_cache", "coverage", "site-packages", ".next", ".nuxt", ".cache", "tmp", "temp")
CHUNK_SKIP_DIRS = (".git", ".env", ".venv", "venv", "env", "node_modules", "vendor", "target", "build", "dist", "bin", "obj", "__pycache__", ".idea", ".vscode", ".pytest_cache", ".mypy_cache", ".tox", "coverage", ".next", ".nuxt", "out")
SKIP_NAMES = ("dockerfile", "docker-compose.yml", "docker-compose.yaml", ".dockerignore", "makefile", ".gitignore", ".gitattributes", ".editorconfig", ".prettierrc", ".eslintrc", ".pylintrc", ".flake8", "license", "readme.md", "readme.txt", "changelog.md", "contributing.md", "code_of_conduct.md", "security.md")
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "gemfile.lock", "pipfile.lock", "poetry.lock", "cargo.lock", "go.sum")
SKIP_EXTENSIONS = (".exe", ".dll", ".so", ".dylib", ".a", ".o", ".obj", ".pyc", ".pyo", ".class", ".jar", ".war", ".wasm", ".bin", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".webm", ".mp3", ".wav", ".ogg", ".flac", ".aac", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".tgz", ".log", ".tmp", ".temp", ".swp", ".swo")
SKIP_PARTS = ("node_modules", "vendor", "target", "build", "dist", "__pycache__", ".pytest_cache", "coverage", "site-packages", ".next", ".nuxt", "bin", "obj", ".git")


#: Parts of a path that a parser never reads, fixed values.
PARSE_SKIP = (".git", "node_modules", ".vscode", ".idea", "vendor", "target", "build", "dist", "__pycache__", ".pytest_cache", "coverage", "site-packages")


def parse_files(files: DataFrame, repos: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files (repo, path, modified) that a parser has to read.

    Left out are paths that hold a part of PARSE_SKIP or not the repository's ``test`` filter, files of unknown languages, of
    other languages where the repository (name, language, test, skip_other_languages) asks for it, and those
    in ``indexed`` (repo, path, modified) with the same time.
    """
    path, lang = F.col("path"), language_of_path(F.col("path"))
    r = repos.select(F.col("name").alias("repo"), F.col("language").alias("_l"), F.col("test").alias("_t"), F.coalesce("skip_other_languages", F.lit(False)).alias("_s"))
    use = files.join(r, "repo").where(lang.isNotNull() & ~F.greatest(*[F.contains(path, F.lit(p)) for p in PARSE_SKIP]))
    use = use.where((F.coalesce("_t", F.lit("")) == "") | F.contains(path, F.col("_t"))).where(~F.col("_s") | (lang == language_alias(F.col("_l")))).drop("_l", "_t", "_s")
    return use.join(indexed.select("repo", "path", "modified").distinct(), ["repo", "path", "modified"], "left_anti")


def skip_directory(path: Column, names: tuple[str, ...] = SKIP_DIRS) -> Column:
    """Whether a folder on the way to the file is pruned by name or hidden."""
    folders = F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/")
    return F.exists(folders, lambda d: d.isin(*names) | (F.startswith(d, F.lit(".")) & ~d.isin(".", "..")))


def skip_file(path: Column, language: Column | None = None) -> Column:
    base = base_name(path)
    out = F.lower(base).isin(*SKIP_NAMES) | base.isin(*LOCK_FILES) | extension(path).isin(*SKIP_EXTENSIONS)
    out = out | F.exists(F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/"), lambda d: d.isin(*SKIP_PARTS))
    return out if language is None else out | ~language_of_path(path).eqNullSafe(language)


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content, length, modified) of all kept files under ``root``; texts that aren't UTF-8 lose their bad bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rel = F.regexp_replace(F.col("path"), "^file:/*", "/")
    rel = F.substring(rel, F.lit(len(root.rstrip("/")) + 2), F.length(rel))
    kept = raw.withColumn("rel", rel).where(~skip_directory(F.col("rel")) & ~skip_file(F.col("rel")))
    return kept.select(F.col("rel").alias("path"), F.decode("content", "UTF-8").alias("content"), "length", F.col("modificationTime").alias("modified"))


def git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True).stdout


def git_info(repo: str) -> dict[str, object]:
    """Head commit, its subject and the set of modified files; read on the driver."""
    changed = [line[3:] for line in git(repo, "status", "--porcelain").splitlines()]
    return {"root": git(repo, "rev-parse", "--show-toplevel").strip(), "head": git(repo, "rev-parse", "HEAD").strip(), "message": git(repo, "log", "-1", "--format=%s").strip(), "modified": {c.split(" -> ")[-1].strip('"') for c in changed}}


def read_head(spark: SparkSession, repo: str, paths: list[str]) -> DataFrame:
    """(path, content) at HEAD for unmodified tracked files, from the working tree for modified ones; untracked files are left out.

    The repository's files are read on the driver and staged, as git has no reader on executors.
    """
    info = git_info(repo)
    tracked = set(git(repo, "ls-tree", "-r", "--name-only", "HEAD").splitlines())
    rows = []
    for p in paths:
        if p in tracked:
            rows.append((p, open(f"{repo}/{p}", encoding="utf-8", errors="replace").read() if p in info["modified"] and os.path.exists(f"{repo}/{p}") else git(repo, "show", f"HEAD:{p}")))
    return spark.createDataFrame(rows, "path string, content string")


def log_lines(spark: SparkSession, repo: str, since: str | None = None) -> DataFrame:
    """(n, value): the lines of the commit log with line counts, without merges, newest first, for ``parse_log``."""
    args = ["log", "--no-merges", "--numstat", "--date=iso-strict", "--format=%H|%an|%ad", *([f"--since={since}"] if since else [])]
    return spark.createDataFrame(list(enumerate(git(repo, *args).splitlines())), "n long, value string")


def patch_lines(spark: SparkSession, repo: str, path: str) -> DataFrame:
    """(path, n, value): the lines of all patches of one file over its renames, for ``parse_hunks``."""
    out = git(repo, "log", "-p", "--follow", "--format=", "--", path).splitlines()
    return spark.createDataFrame([(path, n, v) for n, v in enumerate(out)], "path string, n long, value string")


def parse_log(lines: DataFrame, line_col: str = "value", order_col: str = "n") -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of a log in the format ``hash|author|iso date`` with numstat lines below.

    A header belongs to the lines up to the next one; they are found by a running maximum within blocks and the
    blocks' last headers, so one task never holds the log. Binary counts (``-``) are dropped; renames give the new path.
    """
    v = F.col(line_col)
    is_head = v.rlike(r"^[0-9a-f]{7,40}\|[^|]*\|")
    parts = F.split(v, r"\|")
    rows = lines.select(F.col(order_col).alias("n"), v.alias("v"), F.when(is_head, parts[0]).alias("head"), (F.col(order_col) / 100_000).cast("long").alias("block"))
    inside = Window.partitionBy("block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("own", F.last("head", ignorenulls=True).over(inside))
    lasts = rows.where("head is not null").groupBy("block").agg(F.max_by("head", "n").alias("last"))
    carried = rows.select("block").distinct().join(lasts, "block", "left").select("block", F.last("last", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    full = local.join(carried, "block", "left").withColumn("sha", F.coalesce("own", "carry"))
    commits = rows.where("head is not null").select(F.col("head").alias("sha"), F.split("v", r"\|")[1].alias("author"), F.split("v", r"\|")[2].try_cast("timestamp").alias("ts")).dropDuplicates(["sha"])
    cols = F.split("v", "\t")
    stat = full.where(F.col("v").rlike(r"^(\d+|-)\t(\d+|-)\t")).select("sha", rename_target(cols[2]).alias("path"), cols[0].try_cast("int").alias("added"), cols[1].try_cast("int").alias("deleted"))
    return commits, stat.where("added is not null and deleted is not null")


def parse_hunks(lines: DataFrame, file_col: str = "path", line_col: str = "value", order_col: str = "n") -> DataFrame:
    """(path, old_start, old_count, new_start, new_count, added, deleted) of patch lines numbered within each path."""
    v = F.col(line_col)
    by = Window.partitionBy(file_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("hunk", F.sum(v.rlike("^@@ -").cast("int")).over(by)).where("hunk > 0")
    header = F.max(F.when(v.rlike("^@@ -"), v))
    agg = rows.groupBy(file_col, "hunk").agg(header.alias("h"), F.sum((v.rlike(r"^\+") & ~v.rlike(r"^\+\+\+ ")).cast("int")).alias("added"), F.sum((v.rlike("^-") & ~v.rlike("^--- ")).cast("int")).alias("deleted"))
    return agg.select(F.col(file_col).alias("path"), *[hunk_field(F.col("h"), i).alias(n) for i, n in enumerate(("old_start", "old_count", "new_start", "new_count"), 1)], "added", "deleted")
