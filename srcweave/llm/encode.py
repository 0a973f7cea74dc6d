"""Encoding of whole texts with a public byte-level BPE tokenizer.

Texts of up to ``chunk`` characters are encoded as they are. A longer text is cut once into overlapping
chunk rows that are pre-tokenised in parallel. Scanning for pre-tokens has no memory: two scans
that share a boundary agree from there on. So each row scans its chunk and the overlap behind it
and, afresh from the next chunk's start, the overlap; the first boundary both have is where the next
piece begins. Where an overlap holds no common boundary, the pieces around it are joined
before encoding, which keeps the result exact for any text.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKENIZERS = next(iter((importlib.util.find_spec("public_tokenizers") or type("S", (), {"submodule_search_locations": ["/opt/tokenizers"]})).submodule_search_locations))
CHUNK, OVERLAP = 1_024, 128
#: The public pattern of the tokenizer, a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(folder: str, name: str = "byte_bpe_50k"):
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, start: int = 0) -> list[int]:
    """Starts of the pre-tokens of ``text`` scanned from ``start``."""
    return [m.start() for m in regex.finditer(PATTERN, text, pos=start)]


def resync(text: str, nxt: int, whole: bool) -> int | None:
    """The first boundary at or after ``nxt``, not behind a blank, that a scan from 0 and one from ``nxt`` share.

    Blanks at the end of a piece would merge otherwise, as their tokens look ahead.

    Boundaries near the end of a cut text may be wrong, as the last token may go on and trailing
    blanks look ahead; unless ``whole``, the last two of either scan don't count.
    """
    cut = slice(None) if whole else slice(None, -2)
    tail = set(boundaries(text, nxt)[cut])
    return next((b for b in boundaries(text)[cut] if b >= nxt and b in tail and b and not text[b - 1].isspace()), None)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids): the ids of every distinct (id, text) row, without special tokens.

    Null and empty texts give an empty list; strings that look like special tokens are plain text.
    Repeated rows count once; an id with different texts keeps one row per text. Ids may be null.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).distinct()
    id_type = rows.schema["doc_id"].dataType.simpleString()
    size = F.coalesce(F.char_length("text"), F.lit(0))

    def encode_short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [enc.encode_ordinary(t) if t else [] for t in b["text"]]})

    short = rows.where(size <= chunk).mapInPandas(encode_short, f"doc_id {id_type}, ids array<int>")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, h, t in zip(b["doc_id"], b["h"], b["text"]):
                starts = range(0, len(t), chunk)
                for k in range(0, len(starts), 1_000):  # frames of bounded size, whatever the text's length
                    some = starts[k : k + 1_000]
                    yield pd.DataFrame({"doc_id": [i] * len(some), "h": h, "no": [x // chunk for x in some], "part": [t[x : x + chunk + overlap] for x in some], "more": [len(t) > x + chunk for x in some], "whole": [len(t) <= x + chunk + overlap for x in some]})

    chunks = rows.where(size > chunk).select("doc_id", F.xxhash64("text").alias("h"), "text").mapInPandas(cut, f"doc_id {id_type}, h long, no int, part string, more boolean, whole boolean")

    def sync(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = [resync(t, chunk, w) if m else len(t) for t, m, w in zip(b["part"], b["more"], b["whole"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "h": b["h"], "no": b["no"], "part": b["part"], "cut": pd.array(ends, dtype="Int32")})

    synced = chunks.repartition(F.col("h"), F.col("no")).mapInPandas(sync, f"doc_id {id_type}, h long, no int, part string, cut int")
    by_text = Window.partitionBy("doc_id", "h").orderBy("no")
    before = F.lag(F.coalesce("cut", F.lit(-1)), 1).over(by_text)  # null: first chunk, -1: no common boundary
    own = synced.withColumn("prev", before).withColumn("begin", F.when(F.col("prev").isNull() | (F.col("prev") < 0), 0).otherwise(F.col("prev") - chunk))
    # a piece starts at the first chunk and wherever the boundary before was found
    own = own.withColumn("piece", F.sum(F.when(F.coalesce(F.col("prev"), F.lit(-1)) < 0, F.when(F.col("prev").isNull(), 1).otherwise(0)).otherwise(1)).over(by_text))
    text = F.when(F.col("cut").isNull(), F.substring("part", F.col("begin") + 1, F.lit(chunk) - F.col("begin"))).otherwise(F.substring("part", F.col("begin") + 1, F.col("cut") - F.col("begin")))
    pieces = own.select("doc_id", "h", "piece", "no", text.alias("t")).groupBy("doc_id", "h", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "t"))), lambda x: x["t"]), "").alias("text"))

    def encode_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "h": b["h"], "piece": b["piece"], "ids": [enc.encode_ordinary(t) for t in b["text"]]})

    encoded = pieces.mapInPandas(encode_pieces, f"doc_id {id_type}, h long, piece long, ids array<int>")
    long = encoded.groupBy("doc_id", "h").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(long.select("doc_id", "ids"))


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text): the tokens' raw bytes one after the other, read as UTF-8; null ids give null."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [None if i is None else enc.decode_bytes(list(i)).decode("utf-8", "replace") for i in b["ids"]]})

    return rows.mapInPandas(decode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
