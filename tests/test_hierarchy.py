import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from srcweave.operators.hierarchy import descendants, hierarchy, links


def brute(pairs):
    clean = lambda x: (x or "").strip(" \t\n\r").lower() or None
    rows = {(clean(i), clean(p)) for i, p in pairs if clean(i)}
    ids = {i for i, _ in rows}
    par = {i: min((p for j, p in rows if j == i and p in ids), default=None) for i in ids}
    out, below = {}, dict.fromkeys(ids, 0)
    for i in ids:
        seen, x = [i], i
        while par[x] is not None and par[x] not in seen:
            x = par[x]
            seen.append(x)
        if par[x] is not None:
            out[i] = ("cycle", -1, None)
        else:
            out[i] = (x, len(seen) - 1, "/".join(reversed(seen)))
            for a in seen[1:]:
                below[a] += 1
    return {(i, r, d, below[i] if d >= 0 else -1, p) for i, (r, d, p) in out.items()}


def check(spark, pairs):
    got = {tuple(r) for r in hierarchy(spark.createDataFrame(pairs, "id string, parent_id string"), with_path=True).collect()}
    assert got == brute(pairs)


def test_chain_star_cycle_and_dirty_ids(spark):
    chain = [(f"c{i:03d}", f"c{i - 1:03d}" if i else None) for i in range(70)]
    star = [(f"s{i}", "S0 ") for i in range(1, 40)] + [("s0", "")]
    cyc = [("x", "y"), ("y", "z"), ("z", "x"), ("below", "X\t"), ("under", "below"), ("self", "self"), ("kid", "self")]
    dirty = [("A", " gone "), ("a", None), ("b", "\tA"), ("b", "\tA"), (None, "a"), ("", "a")]
    check(spark, chain + star + cyc + dirty)


def test_empty_table(spark):
    assert hierarchy(spark.createDataFrame([], "id string, parent_id string")).count() == 0


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("a", None, 1, "k"), ("b", "a", 2, "v")], "id string, parent_id string, kids int, parent string")
    assert sorted(map(tuple, hierarchy(df).collect())) == [("a", "a", 0, 1), ("b", "a", 1, 0)]


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "id string, parent_id string")
    assert {tuple(r) for r in descendants(df).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000))
def test_random_forests(spark, seed):
    r = random.Random(seed)
    ids = [f"n{i}" for i in range(40)]
    check(spark, [(ids[i], r.choice([None, *ids[max(0, i - 2) : i]]) if r.random() < 0.9 else r.choice(ids)) for i in range(40)])


def test_ids_with_slashes(spark):
    df = spark.createDataFrame([("a/b", None), ("c", "a/b"), ("d", "c"), ("e/\u001f", "d")], "id string, parent_id string")
    got = {tuple(r) for r in descendants(df).collect()}
    e = links(df).where("parent = 'd'").first()["id"]
    assert got == {("a/b", "c", 1), ("a/b", "d", 2), ("c", "d", 1), ("a/b", e, 3), ("c", e, 2), ("d", e, 1)}
    assert {r["id"]: r["path"] for r in hierarchy(df, with_path=True).collect()}["d"] == "a/b/c/d"
