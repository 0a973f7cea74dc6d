import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from srcweave.llm import encode as E
from srcweave.llm import packing as P

pytest.importorskip("tiktoken")


def texts():
    r = random.Random(3)
    return [None, "", " ", "a", "it's  \n\n x " * 20, "x" * 300, " " * 200 + "y", "日本語" * 80, "".join(r.choice("ab '1.\n \tsé日") for _ in range(3_000)), "<|endoftext|> hi", "ab" * 50 + " " * 100 + "''s" * 30]


@pytest.mark.parametrize("chunk, overlap", [(16, 8), (50, 20), (32_768, 1_024)])
def test_chunks_encode_like_whole_texts(spark, chunk, overlap):
    enc = E.encoding(E.TOKENIZERS)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    ids = E.encode_documents(df, chunk=chunk, overlap=overlap)
    got = {r["doc_id"]: list(r["ids"]) for r in ids.collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in rows}
    assert {r["doc_id"]: r["text"] for r in E.decode_documents(ids).collect()} == {i: t or "" for i, t in rows}


def test_empty_table(spark):
    assert E.encode_documents(spark.createDataFrame([], "doc_id long, text string, ids int")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=15))
def test_fills_hold_every_item_once(counts):
    left = dict(counts)
    for times, use in P.fills(counts, 60):
        assert sum(s * n for s, n in use.items()) <= 60
        for s, n in use.items():
            left[s] -= times * n
    assert not any(left.values())


def test_fullest_is_optimal():
    assert sum(s * n for s, n in P.fullest({7: 3, 5: 2, 3: 1}, 20).items()) == 20
    assert P.fullest({9: 5}, 8) == {}


@pytest.mark.parametrize("ranked", [2, 100_000])
def test_pack(spark, monkeypatch, ranked):
    monkeypatch.setattr(P, "RANKED", ranked)
    rows = [(1, 10), (2, 6), (3, 4), (4, 27), (5, 0), (6, None), (7, 6), (8, 4), (8, 4)]
    out = [r.asDict() for r in P.pack(spark.createDataFrame(rows, "doc_id long, size int"), capacity=10).collect()]
    assert sorted((r["id"], r["part"], r["size"]) for r in out if r["id"] == 4) == [(4, 0, 10), (4, 1, 10), (4, 2, 7)]
    used = {}
    for r in out:
        if r["container"] is None:
            assert r["id"] in (5, 6)
        else:
            used.setdefault(r["container"], []).append((r["position"], r["start"], r["size"]))
    assert len(used) == 6
    for items in used.values():
        items.sort()
        assert [p for p, _, _ in items] == list(range(len(items)))
        assert all(a[1] + a[2] == b[1] for a, b in zip(items, items[1:])) and items[-1][1] + items[-1][2] <= 10
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([], "doc_id long, size int"), capacity=0)
    assert P.pack(spark.createDataFrame([], "doc_id long, size int")).count() == 0
