"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups of rows that must stay together are laid out in order, with the running sum of their sizes.
The smallest capacity for which a greedy pass needs no more than the wanted number of shards is found
by binary search, and the sequence is cut there.

The running sums stay distributed. The driver searches on a skeleton: the largest sum of each of a
bounded number of value ranges. It gives a lower and an upper bound of the capacity and, for every
cut, the window it must lie in; only those windows are refined, until they are so small that all sums
in them fit the skeleton. Then the search is exact.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burdenlens.llm.common import numbered, running_sum

#: Ranges of sums the driver holds at once; more for thousands of shards.
SKELETON = 20_000


def _greedy(capacity: int, total: int, limits: list[int], furthest) -> list[int]:
    """Cuts of a greedy pass, each at most its limit; the last is below ``total`` if it fails."""
    cuts, at = [], 0
    for limit in limits:
        at = max(at, min(limit, furthest(min(at + capacity, total))))
        cuts.append(at)
    return cuts


def _smallest(low: int, high: int, total: int, limits: list[int], furthest) -> int:
    """Binary search of the least capacity whose greedy pass reaches the end."""
    while low < high:
        middle = (low + high) // 2
        if _greedy(middle, total, limits, furthest)[-1] >= total:
            high = middle
        else:
            low = middle + 1
    return low


def _search(total: int, largest: int, shards: int, skeleton: int, ranges_of):
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    limits, windows = [total] * shards, [(0, total)]
    inside = None
    while True:
        span = sum(b - a for a, b in windows)
        width = 1 if inside is not None and inside <= skeleton else max(1, span // skeleton)
        ranges = sorted(ranges_of(windows, width))
        tops = [0, *(r[1] for r in ranges)]
        bottoms = [r[0] for r in ranges]

        def sure(x, tops=tops):
            """A sum not above x that exists."""
            return tops[bisect_right(tops, x) - 1]

        def hoped(x, ranges=ranges, bottoms=bottoms):
            """No sum up to x is above this."""
            k = bisect_right(bottoms, x) - 1
            return x if k < 0 or x < ranges[k][1] else ranges[k][1]

        high = _smallest(low, high, total, limits, sure)
        if all(n == 1 for _, _, n in ranges):
            return high, _greedy(high, total, limits, sure)
        low = _smallest(low, high, total, limits, hoped)
        least, at = [], 0
        for limit in limits:
            # the next group always fits, so a cut passes the first sum after the one before it
            after = bisect_right(bottoms, at)
            passed = bottoms[after] if after < len(bottoms) and sure(at) == at else at
            at = min(limit, max(at, passed, sure(min(at + low, total))))
            least.append(at)
        limits = _greedy(high, total, limits, hoped)
        windows = _joined([(max(0, a - 1), b) for a, b in zip(least, limits, strict=True)])
        inside = sum(
            n for bottom, top, n in ranges if any(bottom <= b and top > a for a, b in windows)
        )
        if sum(b - a for a, b in windows) > 0.7 * span:
            skeleton *= 4  # many shards or few, large groups: finer ranges tell the cuts apart


def minimax_cuts(sums: DataFrame, end: str, size: str, shards: int, skeleton: int = SKELETON):
    """(capacity, cuts): the least largest shard, and the running sum at which each shard ends."""
    total, largest = sums.agg(F.max(end), F.max(size)).first()
    if total is None:
        return 0, [0] * shards

    def ranges_of(windows, width):
        bucket = F.lit(None).cast("string")
        for k, (a, b) in enumerate(windows):
            place = F.concat(F.lit(f"{k}:"), F.expr(f"({end} - {a + 1}L) div {width}L"))
            bucket = F.when((F.col(end) > a) & (F.col(end) <= b), place).otherwise(bucket)
        return (
            sums.select(end, bucket.alias("bucket"))
            .where("bucket IS NOT NULL")
            .groupBy("bucket")
            .agg(F.min(end).alias("bottom"), F.max(end).alias("top"), F.count("*").alias("n"))
            .select("bottom", "top", "n")
            .collect()
        )

    return _search(total, largest, shards, skeleton, ranges_of)


def _joined(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


def shard(documents: DataFrame, shards: int = 24) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row; equal texts share a shard.

    A size is the bytes of the text plus 8. Groups are ordered by their smallest id (a group without
    any id first), then by the hash of the text. Slots count from 0 in each shard by id and hash.

    A null text counts as empty and shares the group of empty texts. A null id is kept. Repeated rows
    each get a slot. Other columns are left out, whatever their names. No rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_hash"),
    )
    groups = rows.groupBy("text_hash").agg(
        F.min("doc_id").alias("first"), F.sum("size").alias("bytes")
    )
    sums = running_sum(groups, "bytes", "end", "first", "text_hash")
    _, cuts = minimax_cuts(sums, "end", "bytes", shards)
    number = F.lit(0)
    for cut in cuts[:-1]:
        number = number + (F.col("end") > cut).cast("int")
    dealt = rows.join(sums.select("text_hash", number.alias("shard")), "text_hash")
    placed = numbered(dealt, "shard", "doc_id", "text_hash")
    firsts = placed.groupBy("shard").agg(F.min("_number").alias("first_number"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("shard").cast("int").alias("shard"),
        (F.col("_number") - F.col("first_number")).alias("slot"),
    )
