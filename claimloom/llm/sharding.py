"""Shards of near-equal bytes by best-fit-decreasing packing of indivisible groups.

Documents of equal text form a group that stays together. Only sizes matter for the packing, so
it runs on the histogram of group sizes: D different sizes take at least D^2 / 2 bytes of text, so
it has at most the root of twice the corpus, whatever the number of groups. Groups of
one size are dealt to the bins of their size by rank.

Best-fit-decreasing: groups by falling size, each into the bin with the least remaining
capacity that still holds it, found in a balanced search tree (a treap on remaining capacity).
For a fixed capacity this gives the number of shards; for a fixed number of shards the
smallest capacity that needs no more is found by bisection, after each group above the even
part has got a shard of its own.

Slots count from 0 within a shard without a gap: rows are numbered within chunks of the
written table, and chunks get the sum of those before them, so no task holds a shard, and
repeated rows are spread like any others. The rows of a hot text stay where they are (``join_split``).

Defined results: a null text has size 8, checksum 0, and belongs to the group of empty texts;
repeated rows get slots of their own; a null ``doc_id`` is kept; extra columns take no
part; no rows give no rows; a group above the even part of what larger groups
leave, or above a fixed capacity, has a shard of its own, and the others share the other shards evenly.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import BROADCAST_BYTES, join_split, numbered, placed
from ..session import stored

#: Bisection stops at this part of the capacity.
EVEN = 1 << 16


class Treap:
    """A multiset of (remaining capacity, bin) with look-up of the least that is enough."""

    def __init__(self):
        self.root = None
        self.state = 0x2545F491

    def _priority(self) -> int:
        self.state = (self.state * 1103515245 + 12345) & 0x7FFFFFFF
        return self.state

    def _split(self, node, key):
        """Nodes below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = self._split(node[2], key)
            return node, right
        left, node[1] = self._split(node[1], key)
        return left, node

    def _merge(self, left, right):
        if left is None or right is None:
            return left or right
        if left[3] > right[3]:
            left[2] = self._merge(left[2], right)
            return left
        right[1] = self._merge(left, right[1])
        return right

    def add(self, remaining: int, bin_: int) -> None:
        left, right = self._split(self.root, (remaining, bin_))
        self.root = self._merge(self._merge(left, [(remaining, bin_), None, None, self._priority()]), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least (remaining, bin) with remaining >= size."""
        node, found = self.root, None
        while node is not None:
            if node[0][0] >= size:
                found, node = node[0], node[1]
            else:
                node = node[2]
        if found is not None:
            left, rest = self._split(self.root, found)
            _, right = self._split(rest, (found[0], found[1] + 1))
            self.root = self._merge(left, right)
        return found


Run = tuple[int, int, int]  # size, bin, and how many groups of that size in a row go there


def best_fit_decreasing(counts: dict[int, int], capacity: int, most: int | None = None) -> list[Run] | None:
    """The bins of counts[size] items of each size, in runs; None if ``most`` bins are not enough.

    Item by item the tightest bin that holds one item of a size stays the tightest until it is
    too full for another, so a run is placed at once with the same result. Items above the
    capacity get a bin each.
    """
    tree, out, used = Treap(), [], 0
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            found = tree.take_tightest(size)
            if found is None:
                if used == most:
                    return None
                found, used = (capacity, used), used + 1
            n = min(left, max(1, found[0] // size)) if size else left
            out.append((size, found[1], n))
            if found[0] > n * size or not size:
                tree.add(found[0] - n * size, found[1])
            left -= n
    return out


def least_capacity(counts: dict[int, int], shards: int) -> list[Run]:
    """Bins 0..shards - 1 at a capacity that is enough and, to 1 / EVEN of it, the least that bisection finds.

    An item above the even part of what is left has a bin of its own, largest first; the
    others share the rest of the bins at a capacity of their own.
    """
    counts = {s: n for s, n in counts.items() if n}
    total, alone, out = sum(s * n for s, n in counts.items()), 0, []
    for size in sorted(counts, reverse=True):
        while counts[size] and size * (shards - alone) > total:
            out.append((size, alone, 1))
            counts[size], total, alone = counts[size] - 1, total - size, alone + 1
        if counts[size]:
            break
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return out
    left = shards - alone
    low = max(max(counts), -(-total // left))
    step = max(1, low // EVEN)
    high, gap, best = low, step, best_fit_decreasing(counts, low, left)
    while best is None:
        low, high, gap = high, high + gap, 2 * gap
        best = best_fit_decreasing(counts, high, left)
    while high - low > step:
        mid = (low + high) // 2
        found = best_fit_decreasing(counts, mid, left)
        if found is None:
            low = mid
        else:
            best, high = found, mid
    return out + [(s, alone + b, n) for s, b, n in best]


def shard(docs: DataFrame, shards: int = 24, capacity: int | None = None, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; with ``capacity`` as few shards of it as needed."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("key"),
    )
    sized = stored(sized, "sized")
    groups = stored(sized.groupBy("key").agg(F.sum("size").alias("group_size"), F.count("*").alias("copies")), "groups")
    held = groups.groupBy("group_size").agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).toArrow()  # see above
    counts = dict(zip(held["group_size"].to_pylist(), held["n"].to_pylist(), strict=True))
    n_rows = sum(held["rows"].to_pylist())
    runs = least_capacity(counts, shards) if capacity is None else best_fit_decreasing(counts, capacity)
    upto: dict[int, tuple[list[int], list[int]]] = {}
    for size, bin_, n in runs:
        ends, bins = upto.setdefault(size, ([], []))
        ends.append((ends[-1] if ends else 0) + n)
        bins.append(bin_)
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    cols = [list(upto), [e for e, _ in upto.values()], [b for _, b in upto.values()]]
    places = spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["group_size", "ends", "bins"]))
    if 48 * len(upto) + 12 * len(runs) <= BROADCAST_BYTES:  # else a sort-merge join
        places = F.broadcast(places)
    ranked = numbered(placed(groups), "group_size", "rank").join(places, "group_size")
    nth = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    of_group = ranked.select("key", "copies", F.element_at("bins", nth + 1).alias("shard"))
    whole = join_split(placed(sized), stored(of_group, "placed"), "key", "copies", n_rows)
    return numbered(whole, "shard", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
