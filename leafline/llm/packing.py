"""Filling containers of fixed capacity by the sum-of-squares rule.

``SumOfSquares`` keeps, for every residual gap, the number N(gap) of open bins that have it, and
places an item where the sum of N(gap)**2 becomes smallest: in an open bin of a gap that holds it, or
in a new bin. Ties go to the smaller gap, and a new bin comes last.

The items are dealt to packing groups by a hash of their id; the number of groups follows the
number of items, so a group has about GROUP_ITEMS of them at any scale. A group takes its items
in the order of their ids' hashes, which is random as to size: the rule's waste per item falls as the
number of items grows when sizes come independently, and was larger in descending order.

An item above the capacity is cut into full containers and a rest; no other item is ever cut. Items
of size 0 and of null size share the last container without adding to it. Rows with the same id count once (the
largest size stands), a null id is an item like others. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP_ITEMS = 200_000


class SumOfSquares:
    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> int:
        """The number of the bin that takes an item of ``size``, from 1 to the capacity."""
        c, n = self.capacity, self.open
        gap, gain = c, (2 * n[c - size] + 1 if size < c else 0)
        counts = n[size:c]
        held = np.flatnonzero(counts)
        if len(held):
            change = 2 * (n[held] - counts[held]) + 2
            if held[0] == 0:
                change[0] = 1 - 2 * counts[0]
            best = int(change.argmin())
            if change[best] <= gain:
                gap = size + int(held[best])
        if gap == c:
            number, self.made = self.made, self.made + 1
        else:
            number = self.bins[gap].pop()
            n[gap] -= 1
        rest = gap - size
        if rest:
            self.bins[rest].append(number)
            if rest < c:
                n[rest] += 1
        return number


def pack_sizes(sizes: np.ndarray, capacity: int) -> pd.DataFrame:
    """(item, piece, n_pieces, start, size, bin) for items in the order given; see the module's text."""
    packer = SumOfSquares(capacity)
    rows = []
    big = np.flatnonzero(sizes > capacity)
    for i in big.tolist():
        full, rest = divmod(int(sizes[i]), capacity)
        n = full + (rest > 0)
        for p in range(full):
            rows.append((i, p, n, p * capacity, capacity, packer.made))
            packer.made += 1
        if rest:
            rows.append((i, full, n, full * capacity, rest, -1))
    whole = np.setdiff1d(np.arange(len(sizes)), big)
    rows += [(i, 0, 1, 0, int(sizes[i]), -1) for i in whole.tolist()]
    out = pd.DataFrame(rows, columns=["item", "piece", "n_pieces", "start", "size", "bin"])
    left = out[(out["bin"] < 0) & (out["size"] > 0)].sort_values("item", kind="stable")
    out.loc[left.index, "bin"] = [packer.place(s) for s in left["size"].tolist()]
    out.loc[out["size"] == 0, "bin"] = max(0, packer.made - 1)
    return out


def pack(df: DataFrame, item: str, size: str, capacity: int, n_items: int | None = None, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Where each piece of each item goes: (item, piece, n_pieces, start, size, bin_id).

    One shuffle of two narrow columns. ``start`` and ``size`` count from the item's beginning in the unit
    of ``size``. ``bin_id`` is 'group-number'; the same input gives the same bins. ``n_items`` saves counting
    the rows where sizes are costly to compute.
    """
    groups = max(1, -(-(df.count() if n_items is None else n_items) // group_items))
    narrow = df.select(F.col(item).alias("i"), F.col(size).cast("long").alias("s"), F.xxhash64(F.col(item)).alias("o"), F.pmod(F.xxhash64(F.col(item)), F.lit(groups)).cast("int").alias("g"))
    kind = df.schema[item].dataType
    schema = T.StructType([T.StructField("item", kind), *(T.StructField(k, T.LongType()) for k in ("piece", "n_pieces", "start", "size")), T.StructField("bin_id", T.StringType())])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(s=rows["s"].fillna(0)).sort_values(["o", "i", "s"], ascending=[True, True, False], kind="stable")
        rows = rows[~(rows["i"].duplicated() & rows["i"].notna())].reset_index(drop=True)
        out = pack_sizes(rows["s"].to_numpy(np.int64), capacity)
        out["bin_id"] = [f"{key[0]}-{b}" for b in out["bin"]]
        out["item"] = rows["i"].to_numpy(object)[out["item"].to_numpy(np.int64)] if len(out) else out["item"]
        return out[["item", "piece", "n_pieces", "start", "size", "bin_id"]]

    return narrow.groupBy("g").applyInPandas(run, schema).withColumnRenamed("item", item)
