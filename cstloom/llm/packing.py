"""Filling containers of fixed capacity by the sum-of-squares rule (problem 9).

Items are spread over shards of bounded size by a hash of their key.  A shard
places one item after another where the sum of the squared counts of open
containers per residual gap becomes smallest.  Containers that a shard leaves
with much room are emptied and their items packed again, together with those of
other shards, in groups of bounded size and in rounds: each round mixes the
containers that are still open anew, until they fit one group or a round saves
next to none.  So sharding costs next to nothing, and no task holds more than a
bounded number of items.

Defined results: items of null, zero or negative size are left out; an item
larger than the capacity fills whole containers and only its rest is packed;
capacities below one give no rows; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cstloom.session import reliable

#: Items a shard packs on average, and items that a group packs again on average.
SHARD_ITEMS, GROUP_ITEMS = 20_000, 20_000
#: Containers filled less than this are packed again; a further round has to save this share of them.
WELL_FILLED, SAVES = 0.97, 0.02
#: Rounds at most, which the numbers of containers have room for.
ROUNDS = 12


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of every item, numbered from 0, for sizes from 1 to capacity in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open containers by gap; a full one isn't open
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(sizes), np.int64)
    none = np.iinfo(np.int64).max
    used = 0
    for i, s in enumerate(sizes.tolist()):
        have = count[s:capacity]
        best, gap = none, -1
        if len(have):
            cost = np.where(have > 0, 2 * (1 + count[: capacity - s] - have), none)
            if have[0]:
                cost[0] = 1 - 2 * have[0]  # exactly full, so it leaves the open ones
            k = int(cost.argmin())
            best, gap = int(cost[k]), k + s
        new = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if best == none or new < best:
            box, rest = used, capacity - s
            used += 1
        else:
            box, rest = open_[gap].pop(), gap - s
            count[gap] -= 1
        if rest:
            open_[rest].append(box)
            count[rest] += 1
        where[i] = box
    return where


def _pieces(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Whole containers of oversized items, and what is left of every item to be packed."""
    n = pdf["size"].to_numpy()
    whole = n // capacity
    rest = n - whole * capacity
    big = np.repeat(np.arange(len(n)), whole)
    nth = np.arange(len(big)) - np.repeat(np.cumsum(whole) - whole, whole)
    full = pd.DataFrame({"key": pdf["key"].to_numpy()[big], "first_token": nth * capacity, "length": np.full(len(big), capacity)})
    left = rest > 0
    return full, pd.DataFrame({"key": pdf["key"].to_numpy()[left], "first_token": (whole * capacity)[left], "length": rest[left]})


_OUT = "window_name string, key {kind}, container bigint, first_token bigint, length bigint, fill double"


def pack(items: DataFrame, windows: list[tuple[str, int]], key: str = "doc_id", size: str = "n_tokens", n_items: int | None = None) -> DataFrame:
    """(window_name, key, container, first_token, length) for each of a few windows (name, capacity).

    n_items, if known, saves a count; it only sets the number of shards.
    """
    kind = items.schema[key].dataType.simpleString()
    shards = max(1, -(-(items.count() if n_items is None else n_items) // SHARD_ITEMS))
    windows = [(n, int(c)) for n, c in windows if c is not None and c >= 1]
    capacity_of = dict(windows)
    todo = items.filter(F.col(size) > 0).select(F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"), F.col(key).alias("key"), F.col(size).cast("bigint").alias("size"))

    def first(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        base, out = int(keys[0]) << 32, []
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        for name, capacity in windows:
            full, rest = _pieces(pdf, capacity)
            full["container"], full["fill"] = base + np.arange(len(full)), 1.0
            rest = rest.sort_values(["length", "key"], ascending=[False, True], kind="stable")
            box = sum_of_squares(rest["length"].to_numpy(), capacity)
            fill = np.bincount(box, rest["length"].to_numpy()) / capacity
            rest["container"], rest["fill"] = base + len(full) + box, fill[box] if len(box) else 0.0
            out += [x.assign(window_name=name) for x in (full, rest)]
        return pd.concat(out)[["window_name", "key", "container", "first_token", "length", "fill"]]

    def again(round_: int):
        def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            name, group = keys
            pdf = pdf.sort_values(["length", "key", "first_token"], ascending=[False, True, True], kind="stable")
            length = pdf["length"].to_numpy()
            box = sum_of_squares(length, capacity_of[name])
            fill = np.bincount(box, length) / capacity_of[name]
            return pdf.assign(container=(round_ << 58) + (int(group) << 32) + box, fill=fill[box])[["window_name", "key", "container", "first_token", "length", "fill"]]

        return run

    schema = _OUT.format(kind=kind)
    placed = todo.groupBy("shard").applyInPandas(first, schema)
    if shards > 1:
        placed = reliable(placed)  # read again below
        done, open_, before = placed.filter(F.col("fill") >= WELL_FILLED), placed.filter(F.col("fill") < WELL_FILLED), None
        for round_ in range(1, ROUNDS + 1):
            count = {r.window_name: r for r in open_.groupBy("window_name").agg(F.count("*").alias("items"), F.countDistinct("container").alias("containers")).collect()}  # one row a window
            groups = {name: -(-r["items"] // GROUP_ITEMS) for name, r in count.items()}
            containers = sum(r["containers"] for r in count.values())
            if not count or before is not None and containers > (1 - SAVES) * before:
                break
            cuts = F.lit(1)
            for name, n in groups.items():
                cuts = F.when(F.col("window_name") == name, n).otherwise(cuts)
            mixed = open_.withColumn("g", F.pmod(F.xxhash64("container", F.lit(round_)), cuts).cast("bigint"))
            packed = reliable(mixed.groupBy("window_name", "g").applyInPandas(again(round_), schema))
            if max(groups.values()) == 1:
                open_ = packed
                break
            done, open_, before = done.unionByName(packed.filter(F.col("fill") >= WELL_FILLED)), packed.filter(F.col("fill") < WELL_FILLED), containers
        placed = done.unionByName(open_)
    return placed.select("window_name", F.col("key").alias(key), "container", "first_token", "length")
