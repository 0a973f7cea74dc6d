"""Nearest neighbours by low-dimensional stable projections in kd-trees with a chi-square stop.

Unit vectors are projected on a few Gaussian directions. For two vectors at distance d, the squared
projected distance over d^2 is chi-square with as many degrees of freedom, whatever the data. A kd-tree
over the projections cuts a collection into leaves of about ``LEAF`` vectors, each searched in a task of its own.
A query is searched in its own leaf first, which gives its k-th distance so far; it then visits only the leaves whose
bounding boxes say that a closer vector may lie there: it stops at the box whose projected distance shows that nothing in
it or behind it is closer than the k-th neighbour, except with probability ``miss``. Inside a leaf the same test runs over
boxes of ``BUCKET`` vectors. The vectors of the boxes left are compared at full width, in single precision with a margin first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcweave.session import Scratch

DIMS, MISS, SEED = 8, 0.003, 20_240_501
LEAF, BUCKET, QUERIES_PER_TASK = 8_192, 64, 65_536
#: More than rounding takes from the product of two unit vectors in single precision.
MARGIN = 1e-5
#: Leaves of all collections together; beyond LEAF times so many vectors leaves hold more, so boxes and splits that travel to all tasks keep to about 30 MB.
MOST_LEAVES = 1 << 18
#: Rows of a cell that a tree is fitted on, at least and at most, 16 a leaf in between; every row is indexed.
SAMPLE, MOST_SAMPLE = 4_096, 65_536


def chi2_quantile(p: float, dof: int) -> float:
    """Inverse chi-square distribution by bisection on the regularised gamma series."""

    def cdf(x: float) -> float:
        a, h = dof / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-12:
            n += 1
            term *= h / n
            total += term
        return total * math.exp(-h + a * math.log(h) - math.lgamma(a)) if h > 0 else 0.0

    lo, hi = 0.0, 20.0 * dof + 100
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def directions(width: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, dims))


def unit(rows: pd.Series) -> np.ndarray:
    x = np.array(rows.tolist(), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, width: int, id_col: str, group_col: str, vector_col: str) -> DataFrame:
    """(collection, id, h1, h2, v) of the rows with ``width`` finite numbers, not all zero; h1 and h2 stand for v."""
    v, inf = F.col(vector_col), float("inf")
    number = vectors.select(v).schema[0].dataType.elementType.simpleString()
    # compiled, unlike a function of each element: without an infinite one array_contains is null if one is null, NaN is the largest
    most, least = F.array_max(v), F.array_min(v)
    ok = F.col(id_col).isNotNull() & (F.size(v) == width) & ~F.array_contains(v, F.lit(inf).cast(number)) & (most < inf) & (least > -inf) & ((most > 0) | (least < 0))
    return vectors.where(ok).select(F.coalesce(F.col(group_col), F.lit("")).alias("collection"), F.col(id_col).alias("id"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"), v.alias("v"))


def upper_tree(points: np.ndarray, depth: int) -> tuple[list[int], list[float]]:
    """Heap of (dimension, value) splits at medians of the widest dimension."""
    dims, vals, level = [], [], [points]
    for _ in range(depth):
        nxt = []
        for p in level:
            d = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
            v = float(np.median(p[:, d])) if len(p) else 0.0
            dims.append(d)
            vals.append(v)
            nxt += [p[p[:, d] <= v], p[p[:, d] > v]]
        level = nxt
    return dims, vals


def route(x: np.ndarray, dims: np.ndarray, vals: np.ndarray) -> np.ndarray:
    """The leaf that holds each row."""
    node, inner = np.zeros(len(x), dtype=np.int64), len(dims)
    while len(node) and node[0] < inner:
        node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > vals[node])
    return node - inner


def buckets(p: np.ndarray, size: int = BUCKET) -> list[np.ndarray]:
    """Leaves of a balanced kd-tree over ``p`` as row numbers, neighbours next to each other."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        d = int(np.argmax(np.ptp(p[at], axis=0)))
        half = len(at) // 2
        order = np.argpartition(p[at, d], half)
        todo += [at[order[half:]], at[order[:half]]]
    return out


def search(q: np.ndarray, qp: np.ndarray, x: np.ndarray, xp: np.ndarray, k: int, most: np.ndarray, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, squared distance) of each query's k nearest points within its ``most``; self included."""
    leaves = buckets(xp)
    lo, hi = np.array([xp[a].min(0) for a in leaves]), np.array([xp[a].max(0) for a in leaves])
    short = [x[a].astype(np.float32) for a in leaves]
    found = []
    for block in buckets(qp):
        b, bp, bs = q[block], qp[block], q[block].astype(np.float32)
        bound = most[block].copy()
        # distance of each query to each bucket's box, nearest boxes first
        gap = np.maximum(np.maximum(lo[None] - bp[:, None], bp[:, None] - hi[None]), 0)
        box = np.einsum("qlm,qlm->ql", gap, gap)
        order = np.argsort(box.min(0), kind="stable")
        rows: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * 2 + [np.empty(0)]
        for s in range(0, len(order), 16):
            part = order[s : s + 16]
            part = part[(box[:, part] <= stop * bound[:, None]).any(0)]
            if not len(part):
                if box[:, order[s]].min() > stop * bound.max():
                    break
                continue
            at = np.concatenate([leaves[i] for i in part])
            cosine = bs @ np.concatenate([short[i] for i in part]).T
            qi, pi = np.divmod(np.flatnonzero(cosine >= (1 - bound / 2 - MARGIN).astype(np.float32)[:, None]), len(at))
            if len(qi) * 16 > cosine.size:  # many candidates: all products at once
                d2 = np.maximum(2 - 2 * (b @ x[at].T)[qi, pi], 0)
            else:
                d2 = ((b[qi] - x[at[pi]]) ** 2).sum(1)
            ok = d2 <= bound[qi] + 1e-12
            if ok.any():
                rows = [np.concatenate([a, n]) for a, n in zip(rows, (qi[ok], at[pi[ok]], d2[ok]))]
                o = np.lexsort((rows[2], rows[0]))
                rows = [a[o] for a in rows]
                first = np.searchsorted(rows[0], rows[0])
                kth = np.arange(len(rows[0])) - first == k - 1
                bound[rows[0][kth]] = rows[2][kth]
        found.append((block[rows[0]], rows[1], rows[2]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0),)


class Cells:
    """Nested kd-trees per collection; a vector's cell is the leaf that its projection falls into, 0 without a tree."""

    def __init__(self) -> None:
        self.trees: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}

    def of(self, collection: str, p: np.ndarray) -> np.ndarray:
        cell, todo = np.zeros(len(p), dtype=np.int64), [(0, np.arange(len(p)))]
        while todo:
            at, rows = todo.pop()
            tree = self.trees.get((collection, at))
            if tree is None or not len(rows):
                cell[rows] = at
                continue
            below = at * (MOST_SAMPLE + 1) + route(p[rows], *tree) + 1
            todo += [(int(c), rows[below == c]) for c in np.unique(below)]
        return cell


def fit_cells(points: DataFrame, sizes: DataFrame, width: int, leaf: int) -> Cells:
    """Trees for the collections of ``sizes`` (collection, total), refitted below where the sample bounded their depth."""
    cells, spark = Cells(), points.sparkSession
    big = [(r["collection"], 0, r["total"]) for r in sizes.where(F.col("total") > leaf).collect()]  # at most vectors / leaf rows

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        wanted = math.ceil(math.log2(g["total"].iloc[0] / leaf))
        depth = max(1, min(wanted, int(math.log2(len(g) / 16)) if len(g) > 32 else 1))
        dims, vals = upper_tree(unit(g["v"]) @ directions(width), depth)
        return pd.DataFrame({"collection": [g["collection"].iloc[0]], "cell": [g["cell"].iloc[0]], "short": [wanted > depth], "dims": [dims], "vals": [vals]})

    while big:
        so_far = spark.sparkContext.broadcast(cells)
        wide = spark.createDataFrame(big, "collection string, cell long, total long")

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for c, g in b.groupby("collection", sort=False):
                    yield g.assign(cell=so_far.value.of(c, unit(g["v"]) @ directions(width)))

        mine = points.join(wide.select("collection").distinct(), "collection", "left_semi").select("collection", "h1", "v")
        placed = mine.mapInPandas(place, "collection string, h1 long, v array<float>, cell long") if cells.trees else mine.withColumn("cell", F.lit(0).cast("long"))
        few = F.greatest(F.lit(SAMPLE), F.least(F.lit(MOST_SAMPLE), F.ceil(F.col("total") / leaf) * 16))
        picked = placed.join(wide, ["collection", "cell"]).where(F.pmod(F.xxhash64("h1"), F.col("total")) < few)
        fitted = picked.groupBy("collection", "cell").applyInPandas(fit, "collection string, cell long, short boolean, dims array<int>, vals array<double>").collect()
        fresh = Cells()
        fresh.trees = cells.trees | {(r["collection"], r["cell"]): (np.array(r["dims"]), np.array(r["vals"])) for r in fitted}
        short = [(r["collection"],) for r in fitted if r["short"]]
        cells, big = fresh, []
        if short:
            again = spark.sparkContext.broadcast(cells)

            def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    for c, g in b.groupby("collection", sort=False):
                        yield pd.DataFrame({"collection": c, "cell": again.value.of(c, unit(g["v"]) @ directions(width))})

            counted = points.join(spark.createDataFrame(short, "collection string").distinct(), "collection", "left_semi").select("collection", "v").mapInPandas(count, "collection string, cell long")
            big = [tuple(r) for r in counted.groupBy("collection", "cell").agg(F.count("*").alias("total")).where(F.col("total") > 2 * leaf).collect() if (r[0], r[1]) not in cells.trees]
    return cells


POINT = "collection string, h1 long, h2 long, rep string, ids array<string>, v array<float>"
HIT = "collection string, h1 long, h2 long, rep string, other string, similarity double, shared boolean, rank int"


NONE = pd.DataFrame({"collection": pd.Series(dtype=object), "h1": pd.Series(dtype="int64"), "h2": pd.Series(dtype="int64"), "rep": pd.Series(dtype=object), "other": pd.Series(dtype=object), "similarity": pd.Series(dtype=float), "shared": pd.Series(dtype=bool), "rank": pd.Series(dtype="int32")})


def top_neighbours(vectors: DataFrame, k: int = 5, least: float = 0.85, width: int = 64, id_col: str = "id", group_col: str = "collection", vector_col: str = "embedding", queries=None) -> DataFrame:
    """(collection, id, neighbour, similarity, rank): each vector's k most similar with cosine >= ``least``.

    Only vectors with ``width`` finite numbers, not all zero, take part; repeated rows count once; an id with different
    vectors takes part with each of them, its neighbours are those of all its vectors, at their best similarity. A null
    collection is the collection ''. Equal similarities rank by id. Vectors that are equal number for number form a
    class that is searched once: its k + 1 smallest ids stand for it as neighbours, which is exact,
    as larger ids can't rank before them. ``queries`` is an optional condition on the id column for
    which rows to search.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, width, id_col, group_col, vector_col)
    keys = ["collection", "id", "h1", "h2"]
    scratch = Scratch(spark)
    picked = scratch.keep(rows.select(keys).distinct())
    # different vectors of one id; with them, so many more entries are needed for k other ids
    versions = picked.groupBy("collection", "id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    want = (k + 1) * versions
    # the k + 1 smallest ids of each class, first by salt, as a class may be large
    salted = picked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)))
    firsts = salted.withColumn("n", F.row_number().over(Window.partitionBy("collection", "h1", "h2", "salt").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = scratch.keep(firsts.groupBy("collection", "h1", "h2").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids")))
    several = scratch.keep(classes.where(F.size("ids") > 1))
    others = scratch.keep(picked.join(several, ["collection", "h1", "h2"]).where(F.col("id") != F.col("ids")[0]).select(keys))
    points = rows.join(others, keys, "left_anti").withColumnRenamed("id", "rep").join(several, ["collection", "h1", "h2"], "left").select("collection", "h1", "h2", "rep", "ids", "v")

    sizes = scratch.keep(classes.groupBy("collection").agg(F.count("*").alias("total")))
    leaf = max(LEAF, (sizes.agg(F.sum("total")).first()[0] or 0) // MOST_LEAVES)
    cells = fit_cells(points, sizes, width, leaf)
    split = {c for c, _ in cells.trees}
    tree = spark.sparkContext.broadcast(cells)
    stop, most = chi2_quantile(1 - MISS, DIMS), 2 - 2 * least
    # a class is searched for any of its ids; the condition is applied to its members below
    wanted = F.lit(True) if queries is None else queries(F.col("rep")) | F.col("ids").isNotNull()

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, g in b.groupby("collection", sort=False):
                yield g.assign(leaf=tree.value.of(c, unit(g["v"]) @ directions(width)))

    placed = points.withColumn("wanted", wanted)
    placed = placed.mapInPandas(home, f"{POINT}, wanted boolean, leaf long") if split else placed.withColumn("leaf", F.lit(0).cast("long"))

    def hits(q: pd.DataFrame, x: pd.DataFrame, bound: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
        """(HIT rows, squared distance of the last wanted neighbour of each query, at most ``bound``)"""
        qv, xv, r = unit(q["v"]), unit(x["v"]), directions(width)
        qi, xi, d2 = search(qv, qv @ r, xv, xv @ r, want, bound, stop)
        last = bound.copy()
        full = np.bincount(qi, minlength=len(q)) >= want
        far = np.zeros(len(q))
        np.maximum.at(far, qi, d2)
        last[full] = np.minimum(last, far)[full]
        # classes become ids; the own class is found as the point itself and counts as similarity 1
        same = (q["h1"].to_numpy()[qi] == x["h1"].to_numpy()[xi]) & (q["h2"].to_numpy()[qi] == x["h2"].to_numpy()[xi])
        near = pd.DataFrame({"q": qi, "rep": q["rep"].to_numpy(dtype=object)[qi], "similarity": np.round(np.where(same, 1.0, 1 - d2 / 2), 12)})
        names = x["rep"].to_numpy(dtype=object)[xi]
        many = {i: list(c) for i, c in enumerate(x["ids"]) if c is not None}
        near["other"] = [many.get(i, [n]) for i, n in zip(xi, names)] if many else names
        near = near.explode("other") if many else near
        near["shared"] = q["ids"].notna().to_numpy()[near["q"]]
        near = near[(near["similarity"] >= least) & (near["shared"] | (near["rep"] != near["other"]))].sort_values(["q", "similarity", "other"], ascending=[True, False, True])
        if not len(near):
            return NONE, last
        near["rank"] = near.groupby("q").cumcount()
        near = near[near["rank"] < np.where(near["shared"] | (versions > 1), want, k)]
        out = {c: q[c].to_numpy()[near["q"]] for c in ("collection", "h1", "h2")}
        return pd.DataFrame(out | {c: near[c].to_numpy() for c in ("rep", "other", "similarity", "shared", "rank")}), last

    def at_home(g: pd.DataFrame) -> pd.DataFrame:
        """The hits in the own leaf; for split collections also each query with its bound and the leaf's box."""
        x = g.drop_duplicates(["h1", "h2"]).reset_index(drop=True)
        q = x[x["wanted"]].reset_index(drop=True)
        near, last = hits(q, x, np.full(len(q), most)) if len(q) else (NONE, None)
        c, at = x["collection"].iloc[0], x["leaf"].iloc[0]
        parts = [near]
        if c in split:
            p = unit(x["v"]) @ directions(width)
            parts += [q[["collection", "h1", "h2", "rep", "ids", "v"]].assign(bound=last)] if len(q) else []
            parts += [pd.DataFrame({"collection": [c], "h1": [0], "h2": [0], "box": [np.concatenate([p.min(0), p.max(0)])]})]
        out = pd.concat(parts).reindex(columns=[x.split()[0] for x in f"{HIT}, ids, v, bound, box".split(", ")]).assign(leaf=at).astype({"h1": "int64", "h2": "int64", "rank": "Int32", "shared": "boolean"})
        return out.assign(**{a: out[a].astype(object).where(out[a].notna(), None) for a in ("collection", "rep", "other", "ids", "v", "box")})

    own = placed.groupBy("collection", "leaf").applyInPandas(at_home, f"{HIT}, ids array<string>, v array<float>, bound double, box array<double>, leaf long")
    near = own.where("other is not null").select(*[c.split()[0] for c in HIT.split(", ")])
    if split:
        own = scratch.keep(own)
        near = own.where("other is not null").select(near.columns)
        away = _away(own, None if queries is None else placed, stop, hits, width)
        far = near.where(F.col("collection").isin(*split)) if len(split) <= 1_000 else near
        ranked = far.unionByName(away).withColumn("rank", F.row_number().over(Window.partitionBy("collection", "h1", "h2").orderBy(F.desc("similarity"), "other")) - 1)
        ranked = ranked.where(F.col("rank") < F.when(F.col("shared") | F.lit(versions > 1), want).otherwise(k))
        near = ranked if len(split) > 1_000 else near.where(~F.col("collection").isin(*split)).unionByName(ranked)
    single = near.where("not shared").select("collection", F.col("rep").alias("id"), F.col("other").alias("neighbour"), "similarity", (F.col("rank") + 1).alias("rank"))
    # every member of a class takes the class's neighbours without itself
    members = picked.join(several.select("collection", "h1", "h2"), ["collection", "h1", "h2"])
    if queries is not None:
        members = members.where(queries(F.col("id")))
        single = single.where(queries(F.col("id")))
    lists = near.where("shared").groupBy("collection", "h1", "h2").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "similarity"))).alias("near"))
    each = members.join(lists, ["collection", "h1", "h2"]).select("collection", "id", F.posexplode(F.slice(F.filter("near", lambda n: n["other"] != F.col("id")), 1, want if versions > 1 else k)).alias("pos", "n"))
    out = single.unionByName(each.select("collection", "id", F.col("n.other").alias("neighbour"), "n.similarity", (F.col("pos") + 1).alias("rank")))
    if versions > 1:
        best = out.groupBy("collection", "id", "neighbour").agg(F.max("similarity").alias("similarity"))
        out = best.withColumn("rank", F.row_number().over(Window.partitionBy("collection", "id").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("rank") <= k)
    return out


def _away(own: DataFrame, placed: DataFrame | None, stop: float, hits, width: int) -> DataFrame:
    """HIT rows of the queries in the leaves besides their own that their bounds reach.

    Queries travel once per leaf visited, points once per QUERIES_PER_TASK queries of their leaf. Without ``placed`` all
    points are queries, and are read from them.
    """
    spark = own.sparkSession
    found = own.where("box is not null").select("collection", "leaf", "box").collect()  # at most about MOST_LEAVES rows
    by: dict[str, list] = {}
    for r in found:
        by.setdefault(r["collection"], []).append((r["leaf"], r["box"]))
    boxes = spark.sparkContext.broadcast({c: (np.array([x for x, _ in v]), np.array([b for _, b in v])) for c, v in by.items()})

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, g in b.groupby("collection", sort=False):
                ids, box = boxes.value[c]
                p, reach = unit(g["v"]) @ directions(width), stop * g["bound"].to_numpy()
                for i in range(0, len(ids), 4_096):
                    gap = np.zeros((len(g), len(ids[i : i + 4_096])))
                    for d in range(p.shape[1]):
                        lo, hi = box[i : i + 4_096, d], box[i : i + 4_096, d + p.shape[1]]
                        gap += np.maximum(np.maximum(lo[None] - p[:, d : d + 1], p[:, d : d + 1] - hi[None]), 0) ** 2
                    at, to = np.nonzero((gap <= reach[:, None]) & (ids[i : i + 4_096][None] != g["leaf"].to_numpy()[:, None]))
                    for s in range(0, len(at), 10_000):
                        yield g.iloc[at[s : s + 10_000]].assign(leaf=ids[i + to[s : s + 10_000]])

    asked = own.where("bound is not null").select("collection", "h1", "h2", "rep", "ids", "v", "bound", "leaf")
    sent = asked.mapInPandas(visits, f"{POINT}, bound double, leaf long")
    # the visits are counted first, so that no task gets more than about QUERIES_PER_TASK of them
    parts = Scratch(spark).keep(sent.groupBy("collection", "leaf").agg(F.ceil(F.count("*") / QUERIES_PER_TASK).cast("int").alias("parts")))
    there = (asked if placed is None else placed).join(parts, ["collection", "leaf"]).select("collection", "h1", "h2", "rep", "ids", "v", F.lit(None).cast("double").alias("bound"), "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("h1"), F.col("parts"))).otherwise(F.lit(0)).cast("int")
    both = sent.join(parts, ["collection", "leaf"]).withColumn("part", part).drop("parts").unionByName(there)

    def visit(g: pd.DataFrame) -> pd.DataFrame:
        q = g[g["bound"].notna()].drop_duplicates(["h1", "h2"]).reset_index(drop=True)
        x = g[g["bound"].isna()].drop_duplicates(["h1", "h2"]).reset_index(drop=True)
        return hits(q, x, q["bound"].to_numpy())[0] if len(q) and len(x) else NONE

    return both.groupBy("collection", "leaf", "part").applyInPandas(visit, HIT)


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.85, **columns) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which one is among the k most similar of the other."""
    t = top_neighbours(vectors, k, least, **columns)
    return t.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
