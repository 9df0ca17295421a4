"""Filling containers of fixed capacity with items of varying size.

Items larger than the capacity are cut into full pieces and a rest; a piece that fills a container has it to itself
at once. The others are spread by hash over partitions of bounded size and each is packed by best-fit decreasing. Lower
bounds from dual feasible functions certify a partition whose container count can't be beaten. Partitions with a gap
exchange items: two of a kind meet, their containers that aren't full are emptied and packed again together, and the
new packing is kept if it needs fewer containers. A few rounds suffice; no task holds more than 2 ** rounds of the first
partitions, and no meeting more than ``MEETING_ITEMS`` pieces. What is left uncertified is marked, and
:func:`fill` holds the containers used against the bound over all items.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import stored

PARTITION_ITEMS = 20_000
ROUNDS = 3
MEETING_ITEMS = 16 * PARTITION_ITEMS  # pieces in a meeting; partitions of over half of it stay as they are
MOST_BITS = 1 << 16  # capacities up to this are tracked as bits of one number
_STATE = (
    "container_kind string, capacity int, part long, bin long, item long, doc_id long, piece int, start_token long, "
    "tokens int, gap boolean"
)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item: largest items first, each into the fullest container that takes it."""
    if capacity > MOST_BITS:
        return _best_fit_sorted(sizes, capacity)
    order = np.argsort(-sizes, kind="stable")
    place = np.empty(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0  # bit r of rooms: a container with r units of room exists
    for item in order.tolist():
        size = int(sizes[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, bin_, count = capacity, count, count + 1
        by_room[room - size].append(bin_)
        rooms |= 1 << (room - size)
        place[item] = bin_
    return place


def _best_fit_sorted(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The same for large capacities, with the containers in a list sorted by room."""
    place = np.empty(len(sizes), dtype=np.int64)
    open_: list[tuple[int, int]] = []
    count = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        k = bisect_left(open_, (size, -1))
        if k < len(open_):
            room, bin_ = open_.pop(k)
        else:
            room, bin_, count = capacity, count, count + 1
        insort(open_, (room - size, bin_))
        place[item] = bin_
    return place


def lower_bound(sizes: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """Containers needed at least, the best of two families of dual feasible functions; ``times`` counts distinct sizes."""
    if times is None:
        present, copies = np.unique(sizes[sizes > 0].astype(np.int64), return_counts=True)
    else:
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        present, copies = sizes[order].astype(np.int64), times[order].astype(np.int64)
    if not len(present):
        return 0
    best = math.ceil(int((present * copies).sum()) / capacity)
    number = np.concatenate([[0], np.cumsum(copies)])
    total = np.concatenate([[0], np.cumsum(copies * present)])
    # items over capacity - k count as whole, items under k as nothing; only at these k the sums change
    k = np.unique(np.concatenate([present, present + 1, capacity - present, capacity - present + 1]))
    k = k[(k >= 1) & (k <= capacity // 2)]
    if len(k):
        over = np.searchsorted(present, capacity - k, side="right")
        under = np.searchsorted(present, k, side="left")
        best = max(best, int((number[-1] - number[over] - ((total[under] - total[over]) // capacity)).max()))
    # rounded functions: size s counts floor((k + 1) s / capacity) / k, or s / capacity where (k + 1) s divides evenly
    for k in range(1, 21):
        scaled = (k + 1) * present
        worth = np.where(scaled % capacity == 0, k * present, (scaled // capacity) * capacity)  # in 1 / (k * capacity)
        best = max(best, -(-int((worth * copies).sum()) // (k * capacity)))
    return best


def pack_partition(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, bool]:
    """Container numbers of a partition, and whether its count may still be too high."""
    place = best_fit_decreasing(sizes, capacity)
    return place, bool(len(sizes)) and int(place.max()) + 1 > max(1, lower_bound(sizes, capacity))


def repack(old: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, bool]:
    """Packs the items of containers that aren't full again; the old containers stay if that saves none."""
    _, bin_of = np.unique(old, return_inverse=True)
    filled = np.bincount(bin_of, weights=sizes).astype(np.int64)
    loose = filled[bin_of] < capacity
    n_loose = len(np.unique(bin_of[loose])) if loose.any() else 0
    if loose.any():
        fresh = best_fit_decreasing(sizes[loose], capacity)
        if int(fresh.max()) + 1 < n_loose:
            bin_of = bin_of.copy()
            bin_of[loose] = fresh + int(bin_of.max()) + 1
            _, bin_of = np.unique(bin_of, return_inverse=True)
    gap = int(bin_of.max()) + 1 > max(1, lower_bound(sizes, capacity))
    return bin_of, gap


def meetings(sizes: list[tuple[str, int, int]], turn: int, most: int = MEETING_ITEMS) -> list[tuple[str, int, int]]:
    """(kind, part, meet) of the open partitions (kind, part, pieces) that meet, two of a kind at a time.

    Pairs change with the turn; of an odd number one is by itself and waits for the next turn. A partition of over half
    of ``most`` pieces, or the only one of its kind, is left out.
    """
    out: list[tuple[str, int, int]] = []
    for kind in sorted({k for k, _, _ in sizes}):
        own = sorted(part for k, part, n in sizes if k == kind and 2 * n <= most)
        random.Random(turn).shuffle(own)
        if len(own) > 1:
            out += [(kind, part, i // 2) for i, part in enumerate(own)]
    return out


def pieces(items: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """Every item once for each kind of container, cut where it exceeds the capacity; ``item`` tells rows apart."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(int(c)).alias("capacity")) for k, c in kinds])
    last = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")).cast("int"), F.lit(1)) - 1
    return (
        items.select(
            F.monotonically_increasing_id().alias("item"),
            "doc_id",
            F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"),
            F.explode(each).alias("k"),
        )
        .select("item", "doc_id", "tokens", F.col("k.kind").alias("container_kind"), F.col("k.capacity").alias("capacity"))
        .select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
        .withColumn("start_token", F.col("piece").cast("long") * F.col("capacity"))
        .withColumn("tokens", F.least(F.col("capacity"), F.col("tokens") - F.col("start_token")).cast("int"))
    )


def fill_containers(
    items: DataFrame, kinds: list[tuple[str, int]], partition_items: int = PARTITION_ITEMS, rounds: int = ROUNDS
) -> DataFrame:
    """(container_kind, capacity, container_id, doc_id, piece, start_token, tokens, certified) of every item, for every kind.

    ``items`` are (doc_id, tokens). An item of size 0 or null takes no room and goes to any container of its
    partition. A repeated item is packed each time. Kinds must have a positive capacity. ``certified`` tells that the
    containers of the item's last partition are as few as its lower bound.
    """
    kinds = [(k, c) for k, c in kinds if k is not None and c and c > 0]
    cut = stored(pieces(items, kinds)) if kinds else pieces(items, [("", 1)]).limit(0)
    loose = cut.where(F.col("tokens") < F.col("capacity"))
    counts = {r[0]: r[1] for r in loose.groupBy("container_kind").count().collect()}
    parts = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, max(1, math.ceil(n / partition_items)))]) if counts else None

    def first(batches: pd.DataFrame) -> pd.DataFrame:
        frame = batches.sort_values(["item", "piece"], kind="stable")
        frame["bin"], gap = pack_partition(frame["tokens"].to_numpy(), int(frame["capacity"].iloc[0]))
        return frame.assign(gap=gap)[_names()]

    def again(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "bin", "item", "piece"], kind="stable")
        old = frame["part"].to_numpy() * (1 << 32) + frame["bin"].to_numpy()
        place, gap = repack(old, frame["tokens"].to_numpy(), int(frame["capacity"].iloc[0]))
        return frame.assign(part=frame["meet"], bin=place, gap=gap)[_names()]

    # pieces that fill a container by themselves are settled; the part tells where they were cut, the bin which one it is
    full = cut.where(F.col("tokens") == F.col("capacity")).select(
        "container_kind", "capacity", F.lit(-1).cast("long").alias("part"), F.col("piece").cast("long").alias("bin"), "item",
        "doc_id", "piece", "start_token", "tokens", F.lit(False).alias("gap"), F.lit(-1).alias("turn"),
    )
    if parts is None:
        return _result(full)
    state = (
        loose.withColumn("part", F.pmod(F.xxhash64("item", "piece"), parts[F.col("container_kind")]))
        .withColumn("bin", F.lit(0).cast("long"))
        .groupBy("container_kind", "capacity", "part")
        .applyInPandas(first, _STATE)
    )
    state = stored(state)
    done = full
    for turn in range(rounds):
        sizes = state.where("gap").groupBy("container_kind", "part").count().collect()
        pairs = meetings([tuple(r) for r in sizes], turn)
        if not pairs:
            break
        kind, part, meet = zip(*pairs)
        met = state.sparkSession.createDataFrame(
            pa.table({"container_kind": pa.array(kind), "part": pa.array(part, pa.int64()), "meet": pa.array(meet, pa.int64())})
        ).withColumn("gap", F.lit(True))
        keys = ["container_kind", "part", "gap"]
        settled = state.join(met, keys, "left_anti").select(*_names()).withColumn("turn", F.lit(turn))
        done = done.unionByName(settled)
        state = stored(state.join(met, keys).groupBy("container_kind", "capacity", "meet").applyInPandas(again, _STATE))
    return _result(done.unionByName(state.withColumn("turn", F.lit(rounds))))


def _result(done: DataFrame) -> DataFrame:
    item = F.when(F.col("turn") < 0, F.col("item"))  # a full piece's container is the item's own
    return done.select(
        "container_kind", "capacity", F.concat_ws("-", "container_kind", "turn", "part", item, "bin").alias("container_id"),
        "doc_id", "piece", "start_token", "tokens", (~F.col("gap")).alias("certified"),
    )


def fill(packed: DataFrame) -> DataFrame:
    """(container_kind, capacity, containers, least_containers, certified, tokens, used) of each kind.

    ``least_containers`` is the lower bound over all items of the kind, from the numbers of items by size (at most as
    many rows as the capacity); ``certified`` counts containers of partitions at their own bound.
    """

    def bound(frame: pd.DataFrame) -> pd.DataFrame:
        least = lower_bound(frame["tokens"].to_numpy(), int(frame["capacity"].iloc[0]), frame["n"].to_numpy())
        return frame[["container_kind", "capacity"]].head(1).assign(least_containers=least)

    bounds = (
        packed.groupBy("container_kind", "capacity", "tokens")
        .agg(F.count("*").alias("n"))
        .groupBy("container_kind", "capacity")
        .applyInPandas(bound, "container_kind string, capacity int, least_containers long")
    )
    used = (
        packed.groupBy("container_kind", "capacity", "container_id")
        .agg(F.sum("tokens").alias("tokens"), F.first("certified").alias("certified"))
        .groupBy("container_kind", "capacity")
        .agg(
            F.count("*").alias("containers"),
            F.count_if("certified").alias("certified"),
            F.sum("tokens").alias("tokens"),
        )
    )
    return (
        used.join(bounds, ["container_kind", "capacity"])
        .withColumn("used", F.col("tokens") / (F.col("containers") * F.col("capacity")))
        .select("container_kind", "capacity", "containers", "least_containers", "certified", "tokens", "used")
    )


def _names() -> list[str]:
    return [c.split()[0] for c in _STATE.split(", ")]
