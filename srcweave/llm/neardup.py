"""Near-duplicate texts by multi-index hashing.

A text's fingerprint is a string of ``SEGMENTS * WIDTH`` minhash symbols; two texts differ in a symbol
with probability 1 - Jaccard, so their Hamming distance over symbols estimates their similarity. Each
segment of WIDTH symbols is indexed under its whole Hamming ball of radius 1 (one symbol left open
at a time), table matches are fetched by an equi-join, the complete distance over all symbols is
checked, and what remains is compared exactly on the sets of word runs.

A pair at similarity s shares a ball in a segment with probability s^4 + 4 s^3 (1 - s). At s = 0.7
eight segments miss 0.02 % of the pairs and the bound on the complete distance another 0.01 %.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcweave.operators.components import components
from srcweave.session import Scratch

SEGMENTS, WIDTH = 8, 4
SHINGLE, MIN_WORDS, LEAST = 4, 40, 0.7
#: Symbols that must agree: the expected number at LEAST less 3.8 standard deviations.
AGREE = 12
#: Exact copies of two texts are paired off one by one up to so many pairs; beyond, through the representatives.
EXPAND = 4_096
#: Different texts of one word sequence that are paired off in one block.
BLOCK = 64
WORD = regex.compile(r"[a-z0-9_]+")
_MUL = np.random.default_rng(11).integers(1, 2**63, size=SEGMENTS * WIDTH, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(12).integers(0, 2**63, size=SEGMENTS * WIDTH, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of all runs of ``n`` consecutive word hashes."""
    h = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(3) + words[i : i + len(h)])
    return np.unique(h)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    out = np.empty(len(_MUL), dtype=np.uint64)
    for i in range(0, len(shingles), 65_536):  # bounds the memory for very long texts
        part = mix(shingles[None, i : i + 65_536] * _MUL[:, None] + _ADD[:, None]).min(axis=1)
        out = part if i == 0 else np.minimum(out, part)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


@dataclass
class Similar:
    pairs: DataFrame  # (id_a, id_b), id_a < id_b
    links: DataFrame  # (a, b): pairs that connect all similar texts, without the multiples of equal word sequences
    classes: DataFrame  # (id, rep): every text that takes part, with the smallest id of the same content
    degrees: DataFrame  # (rep, n_links): the number of other contents a content is similar to


def similar_texts(rows: DataFrame, id_col: str, text_col: str, least: float = LEAST, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> Similar:
    """Pairs of different ids whose texts share at least ``least`` of their word runs.

    Words are maximal runs of a-z, 0-9 and _ in the lower-cased text; texts with fewer than
    ``min_words`` (null and empty ones among them) take no part. Repeated (id, text) rows count once; of
    an id with several texts the smallest is taken; null ids take no part. Texts with equal word sequences are compared
    once, through the smallest id (``head``); exact copies of one content form a class with the smallest id as
    representative. ``pairs`` has all pairs of different contents, in blocks where many share a word sequence, and
    the pairs of their copies, except where the copies of two contents would give more than EXPAND pairs: those
    are linked through their representatives, each copy with its own.
    """
    scratch = Scratch(rows.sparkSession)
    texts = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null").groupBy("id").agg(F.min("t").alias("t"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["t"]):
                words = WORD.findall(t.lower())
                if len(words) < max(min_words, shingle):
                    continue
                for w in set(words).difference(known):
                    known[w] = xxhash.xxh3_64_intdigest(w)
                h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
                if len(known) > 1_000_000:
                    known.clear()
                s = runs(h, shingle)
                d = xxhash.xxh3_128(h.tobytes()).intdigest()
                k = xxhash.xxh3_128(t.encode("utf-8", "replace")).intdigest()
                out.append((i, d >> 65, d & (2**63 - 1), k >> 65, k & (2**63 - 1), len(s), fingerprint(s), (s >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pd.DataFrame(out, columns=["id", "c1", "c2", "k1", "k2", "n", "sig", "shingles"])

    signed = scratch.keep(texts.mapInPandas(sign, "id string, c1 long, c2 long, k1 long, k2 long, n int, sig array<int>, shingles array<int>"))
    words, content = ["c1", "c2"], ["c1", "c2", "k1", "k2"]
    ids = signed.select("id", *content)
    copies = ids.groupBy(content).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    heads = copies.groupBy(words).agg(F.min("rep").alias("head"), F.count("*").alias("contents"))
    classes = scratch.keep(ids.join(copies.join(heads, words), content).select("id", "rep", "copies", "head", "contents"))
    only = signed.join(classes.where("id = head").select("id"), "id", "left_semi")

    balls = F.flatten(F.array(*[F.array(*[F.xxhash64(F.lit(s * WIDTH + o), *[F.col("sig")[s * WIDTH + i] for i in range(WIDTH) if i != o]) for o in range(WIDTH)]) for s in range(SEGMENTS)]))
    keys = only.select("id", F.explode(balls).alias("key"))
    left, right = keys.select("key", F.col("id").alias("a")), keys.select("key", F.col("id").alias("b"))
    fetched = scratch.keep(left.join(right, "key").where("a < b").select("a", "b").distinct())

    sigs = only.select("id", "sig")
    both = fetched.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    close = both.where(agree >= AGREE).select("a", "b")

    sets = only.select("id", "n", "shingles")
    full = close.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["xa"], b["xb"]):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common / (len(x) + len(y) - common) >= least)
            yield b.loc[keep, ["a", "b"]]

    exact = scratch.keep(full.mapInPandas(verify, "a string, b string"))
    # different contents, in blocks of one or two word sequences
    n_blocks = F.ceil(F.col("contents") / BLOCK).cast("int")
    heads = classes.where("id = head").select("head", "contents", n_blocks.alias("n"))
    ha, hb = (heads.select(F.col("head").alias(r), F.col("contents").alias(f"c{r}"), F.col("n").alias(f"n{r}")) for r in "ab")
    linked = exact.join(ha, "a").join(hb, "b")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    blocks = linked.select("a", "b", F.explode(upto("na")).alias("i"), "nb").select("a", "b", "i", F.explode(upto("nb")).alias("j"))
    own = heads.where("contents > 1").select(F.col("head").alias("a"), F.col("head").alias("b"), F.explode(upto("n")).alias("i"), "n")
    blocks = blocks.unionByName(own.select("a", "b", "i", F.explode(F.sequence(F.col("i"), F.col("n") - 1)).alias("j")))
    texts_of = classes.where("id = rep").select("head", "rep", "copies", F.pmod(F.xxhash64("rep"), n_blocks.cast("long")).cast("int").alias("block"))
    x = texts_of.select(F.col("head").alias("a"), F.col("block").alias("i"), F.col("rep").alias("p"), F.col("copies").alias("np"))
    y = texts_of.select(F.col("head").alias("b"), F.col("block").alias("j"), F.col("rep").alias("q"), F.col("copies").alias("nq"))
    different = blocks.join(x, ["a", "i"]).join(y, ["b", "j"]).where("a != b or i != j or p < q").select("p", "q", "np", "nq")
    # their copies, one by one while there are few
    few = F.col("np") * F.col("nq") <= EXPAND
    member = classes.select("rep", "id", "copies")
    mp, mq = (member.select(F.col("rep").alias(r), F.col("id").alias(f"i{r}")) for r in "pq")
    across = different.where(few).join(mp, "p").join(mq, "q").select(F.col("ip").alias("p"), F.col("iq").alias("q")).unionByName(different.where(~few).select("p", "q"))
    star = member.where("id != rep").select(F.col("rep").alias("p"), F.col("id").alias("q"), "copies")
    small = member.where(F.col("copies").between(2, int(EXPAND**0.5)))
    inside = small.select("rep", F.col("id").alias("p")).join(small.select("rep", F.col("id").alias("q")), "rep").where("p < q").select("p", "q")
    inside = inside.unionByName(star.where(F.col("copies") > int(EXPAND**0.5)).select("p", "q"))
    pairs = across.unionByName(inside).select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
    links = exact.unionByName(classes.where("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")))
    others = linked.select(F.explode(F.array(F.struct(F.col("a").alias("head"), F.col("cb").alias("m")), F.struct(F.col("b").alias("head"), F.col("ca").alias("m")))).alias("o")).groupBy("o.head").agg(F.sum("o.m").alias("m"))
    degrees = classes.where("id = rep").join(others, "head", "left").select("rep", (F.coalesce("m", F.lit(0)) + F.col("contents") - 1).alias("n_links"))
    return Similar(pairs, links, classes.select("id", "rep"), degrees)


def groups(found: Similar) -> DataFrame:
    """(id, class_id, group_id, n_links): one row per text; group_id is the smallest id reached over links.

    class_id is the smallest id of the same content; n_links counts the other contents a text's content is similar to.
    """
    label = components(found.links, "a", "b")
    out = found.classes.join(label.withColumnRenamed("component", "group_id"), "id", "left").join(found.degrees, "rep")
    return out.select("id", F.col("rep").alias("class_id"), F.coalesce("group_id", "id").alias("group_id"), "n_links")
