"""Filling fixed-capacity containers with items.

Items are spread over partitions of bounded size. Each is packed by best-fit decreasing, and a
lower bound from dual feasible functions certifies the number of containers it needs. Where the
number exceeds the bound, the badly filled containers are opened; a certified partition opens its
emptiest one at most. The items let go are exchanged between partitions and packed again, until
one partition is left or the rounds are over.

Defined results: an item longer than the capacity is cut into full containers and a rest, numbered
by ``piece_no``; a null size counts as 0; items of size 0 take no room and lie in their
partition's first container; repeated rows are packed each under their own ``item`` and piece;
an empty table gives no rows; ties go to the smaller item.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from derlem.session import cut

PER_PARTITION = 4_000
WASTE = 0.02


def lower_bound(sizes: np.ndarray, capacity: int, k_max: int = 24) -> int:
    """Containers that any packing of ``sizes`` (each at most ``capacity``) needs at least."""
    return histogram_bound(np.bincount(sizes[sizes > 0], minlength=capacity + 1), capacity, k_max)


def histogram_bound(counts: np.ndarray, capacity: int, k_max: int = 24) -> int:
    """The same from the number of items of each size from 0 to ``capacity``.

    The greatest of the bounds of two families of dual feasible functions: one counts items above
    capacity - a as full and those below a as nothing, for every useful a; the other rounds
    sizes to multiples of capacity / k.
    """
    h = counts.astype(np.int64)
    h[0] = 0
    if not h.any():
        return 0
    x = np.arange(capacity + 1, dtype=np.int64)
    mass = np.concatenate([[0], np.cumsum(h * x)])  # mass[i] = of sizes < i
    number = np.concatenate([[0], np.cumsum(h)])
    a = np.arange(capacity // 2 + 1)
    full = number[-1] - number[capacity - a + 1]
    between = mass[capacity - a + 1] - mass[a]
    best = int((full + -(-between // capacity)).max())
    for k in range(1, k_max + 1):
        whole = (x * (k + 1)) % capacity == 0
        scaled = np.where(whole, x * k, (x * (k + 1)) // capacity * capacity)  # times capacity * k
        best = max(best, int(-(-int((h * scaled).sum()) // (capacity * k))))
    return best


def best_fit_decreasing(sizes: np.ndarray, order: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Container of each item, and the room left in each; every size is at most ``capacity``."""
    into = np.zeros(len(sizes), dtype=np.int64)
    rooms: list[int] = []
    open_rooms: list[tuple[int, int]] = []  # (room, container), sorted; full ones are left out
    for i in order:
        s = int(sizes[i])
        if s == 0:
            if not rooms:
                rooms.append(capacity)
                insort(open_rooms, (capacity, 0))
            continue
        at = bisect_left(open_rooms, (s, -1))
        if at < len(open_rooms):
            room, b = open_rooms.pop(at)
        else:
            room, b = capacity, len(rooms)
            rooms.append(capacity)
        into[i] = b
        rooms[b] = room - s
        if rooms[b]:
            insort(open_rooms, (rooms[b], b))
    return into, rooms


_SCHEMA = "kap string, capacity int, item long, piece_no int, size int, bin_id string, open boolean, gap int, bound int"


def _pack(round_no: int, last: bool, waste: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        capacity = int(rows["capacity"].iloc[0])
        sizes = rows["size"].to_numpy(np.int64)
        order = np.lexsort((rows["piece_no"], rows["item"], -sizes))
        into, rooms = best_fit_decreasing(sizes, order, capacity)
        bound = lower_bound(sizes, capacity)
        gap = sum(r < capacity for r in rooms) - bound
        out = rows[["kap", "capacity", "item", "piece_no", "size"]].copy()
        out["bin_id"] = [f"{key[0]}-{round_no}-{key[1]}-{b}" for b in into]
        loose = np.array([r > waste * capacity for r in rooms])
        if gap <= 0:  # certified; still, rests of several partitions may share a container
            loose &= np.arange(len(rooms)) == int(np.argmax(rooms))
        out["open"] = False if last else loose[into]
        out["gap"], out["bound"] = gap, bound
        return out

    return run


def pack(items: DataFrame, capacities: DataFrame, *, rounds: int = 3, per_partition: int = PER_PARTITION, waste: float = WASTE) -> DataFrame:
    """(kap, capacity, item, piece_no, size, bin_id) for ``items`` (item, size) in every kind of ``capacities`` (kap, capacity).

    ``capacities`` is a table of container kinds, at most a few rows, and is broadcast.
    """
    s = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    pieces = F.greatest(F.lit(1), F.ceil(s / F.col("capacity"))).cast("int")
    rows = (
        items.join(F.broadcast(capacities.select("kap", F.col("capacity").cast("int").alias("capacity")).filter("capacity > 0").dropDuplicates(["kap"])))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .select("kap", "capacity", "item", "piece_no", F.least(F.col("capacity").cast("long"), F.greatest(F.lit(0).cast("long"), s - F.col("piece_no") * F.col("capacity").cast("long"))).cast("int").alias("size"))
    )
    # sizes are costly to make (tokens of whole texts): they are made once
    rows = cut(rows)
    full = rows.filter("size = capacity").withColumn("bin_id", F.concat_ws("-", "kap", F.lit("full"), "item", "piece_no"))
    columns = ["kap", "capacity", "item", "piece_no", "size", "bin_id"]
    loose = rows.filter("size < capacity")
    done = [full.select(columns)]
    for r in range(rounds):
        counts = dict(loose.groupBy("kap").count().collect())  # one row per kind
        if not counts:
            break
        groups = {k: max(1, -(-n // per_partition)) for k, n in counts.items()}
        # a single partition cannot exchange with another
        last = r == rounds - 1 or (r > 0 and max(groups.values()) == 1)
        parts = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
        keyed = loose.withColumn("_g", F.pmod(F.xxhash64("item", "piece_no", F.lit(r)), F.element_at(parts, F.col("kap"))).cast("int"))
        packed = cut(keyed.groupBy("kap", "_g").applyInPandas(_pack(r, last, waste), _SCHEMA))
        done.append(packed.filter("not open").select(columns))
        loose = packed.filter("open").drop("bin_id", "open", "gap", "bound")
        if last:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _bound_of(rows: pd.DataFrame) -> pd.DataFrame:
    capacity = int(rows["capacity"].iloc[0])
    counts = np.zeros(capacity + 1, np.int64)
    np.add.at(counts, rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))
    return pd.DataFrame({"kap": [rows["kap"].iloc[0]], "bound": [histogram_bound(counts, capacity)]})


def packing_report(packed: DataFrame) -> DataFrame:
    """Per kind: containers, pieces, tokens, the certified lower bound over all items, the gap to it, and the fill.

    The bound is that of the dual feasible functions over the whole table, from the number of pieces of each size: one row per
    kind and size, at most as many as the capacity.
    """
    sizes = packed.groupBy("kap", "capacity", "size").agg(F.count("*").alias("n"))
    bound = sizes.groupBy("kap").applyInPandas(_bound_of, "kap string, bound long")
    bins = packed.groupBy("kap", "capacity", "bin_id").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    got = bins.groupBy("kap", "capacity").agg(
        F.count("*").alias("n_bins"), F.sum("n").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"),
        F.ceil(F.sum("used") / F.first("capacity")).alias("volume_bound"), (F.sum("used") / (F.count("*") * F.first("capacity"))).alias("fill"),
    )
    return got.join(bound, "kap").withColumn("gap", F.col("n_bins") - F.col("bound"))
