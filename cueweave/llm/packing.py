"""Items of varying length packed into containers of fixed capacity.

Bounded-space online packing: each shard keeps a fixed number of open windows
per capacity, puts an item into the fullest window it fits, and when none fits
closes the fullest and opens a new one. The windows left open are then merged
whole up a tree of shards. A group of a level hands on the emptiest of its
windows only, as many as a shard may hold open, and closes the others: a task
of the tree sees at most ``FAN_IN`` times as many, whatever the number of shards.

Defined cases: an item longer than a capacity is cut into full pieces, each a
container of its own, and a rest that is packed like an item; no other item is
split. Items of size zero (null and empty texts) get a place and take no space.
A null size counts as zero. Repeated rows are items of their own.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

OPEN_WINDOWS = 256
ROWS_PER_SHARD = 25_000
#: Full pieces of long items that a task holds before it gives them out.
FULL_ROWS = 50_000
#: Shards, and then groups of shards, whose open windows one task merges.
FAN_IN = 16


class BoundedBestFit:
    """Best fit over at most ``spaces`` open windows of one capacity."""

    def __init__(self, capacity: int, spaces: int):
        self.capacity, self.spaces = capacity, spaces
        self._fills: list[tuple[int, int]] = []  # of the open windows, in order
        self.opened = 0

    def place(self, size: int) -> tuple[int, int]:
        """Window of an item and the space used in it before."""
        at = bisect_right(self._fills, (self.capacity - size, self.opened)) - 1
        if at >= 0:
            fill, window = self._fills.pop(at)
        else:
            if len(self._fills) >= self.spaces:
                self._fills.pop()  # the fullest is emitted
            fill, window = 0, self.opened
            self.opened += 1
        if fill + size < self.capacity:
            insort(self._fills, (fill + size, window))
        return window, fill

    def open_windows(self) -> dict[int, int]:
        return {window: fill for fill, window in self._fills}


def _pack_shards(capacities: Sequence[int], spaces: int):
    """Places of the items of each shard, which come sorted by shard and item."""

    def framed(shard: int, rows: list[list], opened: list[dict[int, int]]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["budget", "window", "item", "piece", "start", "size", "used"])
        frame.insert(0, "shard", shard)
        frame["open"] = [w in opened[b] for b, w in zip(frame["budget"], frame["window"])]
        frame["fill"] = [opened[b].get(w, 0) for b, w in zip(frame["budget"], frame["window"])]
        return frame

    none_open: list[dict[int, int]] = [{} for _ in capacities]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, packers = None, []
        rows: list[list] = []  # placed in windows that may be open at the end: one a row and capacity
        full_rows: list[list] = []  # containers of their own, given out on the way
        for part in parts:
            for s, item, tokens in zip(part["shard"], part["item"], part["tokens"]):
                if s != shard:
                    if shard is not None:
                        if full_rows:
                            yield framed(shard, full_rows, none_open)
                        yield framed(shard, rows, [p.open_windows() for p in packers])
                    shard, packers, rows, full_rows = s, [BoundedBestFit(c, spaces) for c in capacities], [], []
                for b, packer in enumerate(packers):
                    full, rest = divmod(int(tokens), packer.capacity)
                    for piece in range(full):
                        full_rows.append([b, packer.opened, item, piece, piece * packer.capacity, packer.capacity, 0])
                        packer.opened += 1
                        if len(full_rows) >= FULL_ROWS:
                            yield framed(shard, full_rows, none_open)
                            full_rows = []
                    if rest or not full:
                        window, used = packer.place(rest)
                        rows.append([b, window, item, full, full * packer.capacity, rest, used])
        if shard is not None:
            if full_rows:
                yield framed(shard, full_rows, none_open)
            yield framed(shard, rows, [p.open_windows() for p in packers])

    return run


def _merge_group(capacities: Sequence[int], spaces: int):
    """Best fit of whole windows, largest first, in one group of one budget; the emptiest ``spaces`` stay open."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > FAN_IN * spaces:
            raise ValueError(f"{len(frame)} windows in one group")
        frame = frame.sort_values(["fill", "shard", "window"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        packer = BoundedBestFit(capacities[int(frame["budget"].iloc[0])], len(frame))
        fills, shards, windows = (frame[c].tolist() for c in ("fill", "shard", "window"))
        placed = [packer.place(fill) for fill in fills]
        first: dict[int, int] = {}
        total: dict[int, int] = {}
        for i, (window, used) in enumerate(placed):
            first.setdefault(window, i)
            total[window] = used + fills[i]
        emptiest = set(sorted(packer.open_windows(), key=lambda w: (total[w], w))[:spaces])
        frame["to_shard"] = [shards[first[w]] for w, _ in placed]
        frame["to_window"] = [windows[first[w]] for w, _ in placed]
        frame["base"] = [used for _, used in placed]
        frame["fill"] = [total[w] for w, _ in placed]
        frame["open"] = [w in emptiest for w, _ in placed]
        return frame[["budget", "shard", "window", "to_shard", "to_window", "base", "fill", "open"]]

    return run


_MOVES = "budget int, shard bigint, window bigint, to_shard bigint, to_window bigint, base bigint, fill bigint, open boolean"


def pack(items: DataFrame, item: str, tokens: str, capacities: Sequence[int], spaces: int = OPEN_WINDOWS, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Where each item or piece goes: budget, capacity, container_id, item, piece, start_in_item, start_in_container, size.

    ``budget`` is the place of the capacity in ``capacities``. The position of a
    piece in its container is its first token there, ``start_in_container``;
    ``piece`` counts the pieces of an item and ``start_in_item`` is the first
    token of a piece. Shards follow the number of rows, so a task holds a bounded
    number of items at every scale.
    """
    capacities = list(capacities)
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    kind = items.schema[item].dataType.simpleString()
    sized = stage(items.select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long").alias("tokens")), "sized-items")
    shards = max(1, -(-sized.count() // rows_per_shard))
    sharded = sized.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    sharded = sharded.repartition(shards, "shard").sortWithinPartitions("shard", "item", "tokens")
    places = f"shard bigint, budget int, window bigint, item {kind}, piece bigint, start bigint, size bigint, used bigint, open boolean, fill bigint"
    placed = stage(sharded.select("shard", "item", "tokens").mapInPandas(_pack_shards(capacities, spaces), places), "packed-shards")
    moves = placed.where("open").groupBy("budget", "shard", "window").agg(F.max("fill").alias("fill"))
    moves = moves.select("budget", "shard", "window", F.col("shard").alias("to_shard"), F.col("window").alias("to_window"), F.lit(0).cast("long").alias("base"), "fill", F.lit(True).alias("open"))
    span = 1
    while span < shards:
        span *= FAN_IN
        heads = moves.where("open and shard = to_shard and window = to_window").select("budget", "shard", "window", "fill")
        heads = heads.withColumn("part", F.floor(F.col("shard") / span))
        step = heads.groupBy("budget", "part").applyInPandas(_merge_group(capacities, spaces), _MOVES)
        step = step.select("budget", F.col("shard").alias("to_shard"), F.col("window").alias("to_window"), *[F.col(c).alias(f"_{c}") for c in ("to_shard", "to_window", "base", "fill", "open")])
        # A window that the level closed keeps its place; the others go on with the one they were put into.
        moves = moves.join(step, ["budget", "to_shard", "to_window"], "left").select(
            "budget",
            "shard",
            "window",
            F.coalesce("_to_shard", "to_shard").alias("to_shard"),
            F.coalesce("_to_window", "to_window").alias("to_window"),
            (F.col("base") + F.coalesce("_base", F.lit(0))).alias("base"),
            F.coalesce("_fill", "fill").alias("fill"),
            F.coalesce("_open", F.lit(False)).alias("open"),
        )
        moves = stage(moves, "merged-windows")
    moved = placed.join(moves.drop("fill", "open"), ["budget", "shard", "window"], "left")
    capacity = F.element_at(F.array(*[F.lit(c) for c in capacities]), F.col("budget") + 1)
    container = F.struct(F.coalesce("to_shard", "shard").alias("shard"), F.coalesce("to_window", "window").alias("window"))
    return moved.select(
        F.col("budget"),
        capacity.alias("capacity"),
        F.concat_ws("-", container["shard"].cast("string"), container["window"].cast("string")).alias("container_id"),
        F.col("item").alias(item),
        "piece",
        F.col("start").alias("start_in_item"),
        (F.coalesce("base", F.lit(0)) + F.col("used")).alias("start_in_container"),
        "size",
    )


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, the least that could hold their tokens, tokens and the share of space used, per capacity."""
    containers = packed.groupBy("budget", "capacity", "container_id").agg(F.sum("size").alias("used"))
    return containers.groupBy("budget", "capacity").agg(
        F.count("*").alias("containers"),
        F.ceil(F.sum("used") / F.first("capacity")).alias("least_containers"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        (F.sum("used") / (F.count("*") * F.first("capacity"))).alias("fill"),
    )
