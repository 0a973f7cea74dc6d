import random
import re

from srcweave.llm import neardup as N


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[a-z0-9_]+", (t or "").lower())
        if i and len(w) >= 40:
            sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}


def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for f in range(12):
        base = [r.choice(words) for _ in range(120)]
        for v in range(4):
            t = list(base)
            for _ in range(v * 2):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((f"d{f}_{v}", " ".join(t)))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = texts() + [("copy1", texts()[0][1].upper()), ("copy2", texts()[0][1] + " !"), ("short", "a b c"), ("none", None), ("", ""), (None, "x " * 60)]
    rows += rows[:3]
    got = {tuple(r) for r in N.similar_texts(spark.createDataFrame(rows, "id string, t string"), "id", "t").pairs.collect()}
    assert got == brute(rows)


def test_large_classes_are_linked_through_their_representative(spark, monkeypatch):
    monkeypatch.setattr(N, "EXPAND", 8)
    t = texts()
    rows = [(f"c{i:02d}", t[0][1]) for i in range(10)] + [t[1]]
    found = N.similar_texts(spark.createDataFrame(rows, "id string, t string"), "id", "t")
    assert {tuple(r) for r in found.pairs.collect()} == {("c00", f"c{i:02d}") for i in range(1, 10)} | {("c00", "d0_1")}
    g = {r["id"]: (r["group_id"], r["n_links"]) for r in N.groups(found).collect()}
    assert {x[0] for x in g.values()} == {"c00"} and g["c05"][1] == 1


def test_reformatted_versions_are_paired_in_full(spark, monkeypatch):
    monkeypatch.setattr(N, "EXPAND", 8)
    monkeypatch.setattr(N, "BLOCK", 3, raising=False)
    t = texts()
    rows = [(f"c{i:02d}", t[0][1] + " !" * i) for i in range(20)] + [(f"e{i:02d}", t[1][1] + " ?" * i) for i in range(10)]
    found = N.similar_texts(spark.createDataFrame(rows, "id string, t string"), "id", "t")
    got = [tuple(r) for r in found.pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) == 30 * 29 // 2
    assert {(r["group_id"], r["n_links"]) for r in N.groups(found).collect()} == {("c00", 29)}


def test_empty(spark):
    f = N.similar_texts(spark.createDataFrame([], "id string, t string, a int, b int"), "id", "t")
    assert f.pairs.count() == 0 and N.groups(f).count() == 0
