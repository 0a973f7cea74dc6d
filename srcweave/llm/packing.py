"""Filling containers of fixed capacity by minimum bin slack over the histogram of sizes.

Only sizes matter to a fill, and there are at most ``capacity`` of them, so the driver works on the
histogram, whatever the number of items. A window holds the largest size left; a bitset
subset-sum over the remaining sizes (counts split in powers of two) gives the fullest multiset that
fits the rest, and backtracking gives its counts. The same fill is repeated as often as the counts
allow. Items then look up their container by their rank within their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2_048
#: Items of one size that are ranked in one task.
RANKED = 100_000


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """Counts by size with the largest total that is at most ``room``."""
    parts: list[tuple[int, int]] = []
    seen: list[int] = []
    bits, mask = 1, (1 << (room + 1)) - 1
    for s in sorted((s for s in left if s <= room), reverse=True):
        c, k = min(left[s], room // s), 1
        while c > 0:
            k = min(k, c)
            seen.append(bits)
            parts.append((s, k))
            bits |= (bits << (s * k)) & mask
            c -= k
            k *= 2
            if bits >> room & 1:
                break
        if bits >> room & 1:
            break
    at, used = bits.bit_length() - 1, {}
    for (s, k), before in zip(reversed(parts), reversed(seen)):
        if not before >> at & 1:
            used[s] = used.get(s, 0) + k
            at -= s * k
    return used


def fills(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, counts by size) of the containers that hold all items once."""
    left, out = {s: c for s, c in counts.items() if c > 0}, []
    while left:
        big = max(left)
        rest = dict(left)
        rest[big] -= 1
        if not rest[big]:
            del rest[big]
        use = fullest(rest, capacity - big)
        use[big] = use.get(big, 0) + 1
        times = min(left[s] // n for s, n in use.items())
        out.append((times, use))
        for s, n in use.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
    return out


def pack(items: DataFrame, id_col: str = "doc_id", size_col: str = "size", capacity: int = CAPACITY) -> DataFrame:
    """(id, part, size, container, position, start): each item's container and place in it.

    An item larger than ``capacity`` is split into full parts and a rest, numbered from 0; no other
    item is split. ``position`` counts the parts in a container from 0, ``start`` is the offset.
    Items of size 0, null or below 0 take no space: they come out with null container and position.
    Repeated (id, size) rows count once. ``capacity`` below 1 is an error.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    rows = items.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("all")).distinct()
    id_type = rows.schema["id"].dataType.simpleString()
    n_parts = F.greatest(F.ceil(F.coalesce("all", F.lit(0)) / F.lit(capacity)), F.lit(1)).cast("int")
    parts = rows.select("id", "all", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part")).select("id", "part", F.least(F.lit(capacity), F.greatest(F.coalesce("all", F.lit(0)) - F.col("part") * F.lit(capacity).cast("long"), F.lit(0))).cast("int").alias("size"))
    # at most capacity rows, whatever the number of items
    counts = {r["size"]: r["n"] for r in parts.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}
    plan = fills(counts, capacity)

    by_size: dict[int, list[tuple[int, int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for times, use in plan:
        slot = offset = 0
        for s in sorted(use, reverse=True):
            r = taken.get(s, 0)
            by_size.setdefault(s, []).append((r, use[s], base, slot, offset))
            taken[s] = r + use[s] * times
            slot += use[s]
            offset += use[s] * s
        base += times
    tables = {s: np.array(v, dtype=np.int64) for s, v in by_size.items()}
    shared = items.sparkSession.sparkContext.broadcast(tables)  # grows with the kinds of fills, at most a few per size

    # sizes with many items are ranked in salted shares, as many as their counts ask for
    hot = {s: -(-n // RANKED) for s, n in counts.items() if n > RANKED}
    n_salts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for sn in hot.items() for x in sn]), F.col("size")), F.lit(1)) if hot else F.lit(1)
    n_salts = F.when(F.col("size") == 0, F.lit(1_000)).otherwise(n_salts)  # their ranks are not used
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("id", "part"), n_salts.cast("long")).cast("int"))
    rank = F.row_number().over(Window.partitionBy("size", "salt").orderBy("id", "part")) - 1
    if hot:
        cells = salted.where(F.col("size").isin(*hot)).groupBy("size", "salt").agg(F.count("*").alias("n"))
        offsets = cells.select("size", "salt", (F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).alias("from"))
        ranked = salted.withColumn("r", rank).join(offsets, ["size", "salt"], "left").select("id", "part", "size", (F.coalesce("from", F.lit(0)) + F.col("r")).alias("rank"))
    else:
        ranked = salted.select("id", "part", "size", rank.alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = len(b)
            size, rank = b["size"].to_numpy(), b["rank"].fillna(-1).to_numpy(dtype=np.int64)
            box, pos, start = (np.full(n, -1, dtype=np.int64) for _ in range(3))
            for s in np.unique(size[size > 0]):
                at = np.flatnonzero(size == s)
                t = shared.value[int(s)]
                seg = t[np.searchsorted(t[:, 0], rank[at], side="right") - 1]
                k = rank[at] - seg[:, 0]
                box[at], pos[at], start[at] = seg[:, 2] + k // seg[:, 1], seg[:, 3] + k % seg[:, 1], seg[:, 4] + k % seg[:, 1] * int(s)
            out = pd.DataFrame({"id": b["id"], "part": b["part"], "size": size})
            for c, v in (("container", box), ("position", pos), ("start", start)):
                out[c] = pd.Series(v, index=out.index, dtype="Int64").mask(v < 0)
            yield out

    return ranked.mapInPandas(place, f"id {id_type}, part int, size int, container long, position long, start long")
