import numpy as np
import pytest

from srcweave.llm import neighbours as N


def vectors():
    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 64))
    rows = [(f"{i:04d}", "c" if i % 7 else "d", [float(np.float32(x)) for x in base[rng.integers(150)] + rng.standard_normal(64) * rng.choice([0, 0.1, 0.3])]) for i in range(400)]
    return rows + rows[:20] + [("z1", "c", None), ("z2", "c", []), ("z3", "c", [0.0] * 64), ("z4", "c", [float("nan")] * 64), ("z5", "c", [1.0])]


def brute(rows, k=5, least=0.85):
    d = {i: (c, np.float32(v).astype(float)) for i, c, v in rows if v and len(v) == 64 and np.isfinite(v).all() and any(v)}
    out = set()
    for c in {c for c, _ in d.values()}:
        ids = sorted(i for i in d if d[i][0] == c)
        x = np.array([d[i][1] for i in ids])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = np.round(x @ x.T, 9)
        np.fill_diagonal(s, -1)
        for i in range(len(ids)):
            for j in np.lexsort((np.arange(len(ids)), -s[i]))[:k]:
                if s[i, j] >= least:
                    out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


@pytest.mark.parametrize("leaf", [64, 16_384])
def test_recall_against_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(N, "LEAF", leaf)
    monkeypatch.setattr(N, "SAMPLE", 256)
    monkeypatch.setattr(N, "QUERIES_PER_TASK", 150)
    rows = vectors()
    got = {tuple(r) for r in N.similar_pairs(spark.createDataFrame(rows, "id string, collection string, embedding array<float>")).collect()}
    want = brute(rows)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_cells_are_refitted_where_the_sample_was_too_small(spark, monkeypatch):
    for name, value in (("LEAF", 16), ("SAMPLE", 40), ("MOST_SAMPLE", 64)):
        monkeypatch.setattr(N, name, value)
    rows = vectors()
    df = spark.createDataFrame(rows, "id string, collection string, embedding array<float>")
    points = N.usable(df, 64, "id", "collection", "embedding")
    cells = N.fit_cells(points, points.groupBy("collection").count().withColumnRenamed("count", "total"), 64, 16)
    assert {at > 0 for c, at in cells.trees if c == "c"} == {True, False}
    got, want = {tuple(r) for r in N.similar_pairs(df).collect()}, brute(rows)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


@pytest.mark.parametrize("leaf", [2, 4_096])
def test_an_id_with_different_vectors_keeps_the_links_of_each(spark, monkeypatch, leaf):
    monkeypatch.setattr(N, "LEAF", leaf)
    e = np.eye(64, dtype=np.float32)
    rows = [("a", "c", e[0]), ("a", "c", e[1]), ("b", "c", e[0] + 0.1 * e[5]), ("d", "c", e[1] + 0.1 * e[6]), ("f", "c", e[1]), ("g", "c", e[9])]
    df = spark.createDataFrame([(i, c, [float(x) for x in v]) for i, c, v in rows], "id string, collection string, embedding array<float>")
    assert {tuple(r) for r in N.similar_pairs(df).collect()} == {("a", "b"), ("a", "d"), ("a", "f"), ("d", "f")}


def test_a_query_set_is_searched_against_all(spark):
    df = spark.createDataFrame(vectors(), "id string, collection string, embedding array<float>")
    some = N.top_neighbours(df, queries=lambda i: i.cast("int") % 20 == 0)
    every = N.top_neighbours(df).where("cast(id as int) % 20 = 0")
    key = lambda d: {(r["id"], r["neighbour"], r["rank"]) for r in d.collect()}
    assert key(some) == key(every) != set()


def test_quantile_and_empty(spark):
    assert abs(N.chi2_quantile(0.95, 10) - 18.307) < 0.01
    assert N.similar_pairs(spark.createDataFrame([], "id string, collection string, embedding array<float>, leaf int")).count() == 0


def test_points_of_a_visited_box_are_compared_at_full_width():
    r = np.random.default_rng(3)
    x = r.standard_normal((60, 64)) + 4 * r.standard_normal(64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = x @ N.directions(64)
    qi, xi, d2 = N.search(x, p, x, p, 60, np.full(60, 0.3), 0.01)
    exact = ((x[:, None] - x[None]) ** 2).sum(2)
    assert set(zip(qi.tolist(), xi.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(exact <= 0.3)))) and len(qi) > 120
    assert np.allclose(d2, exact[qi, xi], atol=1e-12)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_usable(spark, kind):
    inf, nan = float("inf"), float("nan")
    rows = [("a", [1.0, 0.0]), ("b", [-1.0, 0.0]), ("c", [inf, 0.0]), ("d", [-inf, 0.0]), ("e", [nan, 1.0]), ("f", [None, 1.0]), ("g", [0.0, -0.0]), ("h", None), ("i", [1.0]), ("j", [None, None]), (None, [1.0, 1.0]), ("k", [nan, inf]), ("l", [None, -1.0]), ("m", [None, inf])]
    v = spark.createDataFrame([(i, "c", e) for i, e in rows], f"id string, collection string, embedding array<{kind}>")
    assert {r["id"] for r in N.usable(v, 2, "id", "collection", "embedding").collect()} == {"a", "b"}
