"""Shards of near equal bytes by a minimax contiguous partition.

Equal texts are one atomic group. Groups are ordered by the 64-bit hash of their text (texts that share a hash are
kept together) and cut into contiguous runs, the largest of which is as small as it can be: a binary search over the
capacity, each capacity checked by filling shards greedily.

The driver never holds all group sizes. It starts from sums over equal ranges of hashes (at most ``RANGES`` rows),
finds between which places each cut can lie, and asks for finer sums there alone, until every place in question is a
single group. The search is then exact. Cuts are placed at the boundaries nearest to equal sizes that the smallest
capacity allows.

Defined results: null texts count as empty ones and have 8 bytes; a repeated row is a row of its own with a slot of its
own; an empty table gives no rows; with fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

N_SHARDS = 24
#: Bytes that each row has besides its text.
ROW_BYTES = 8
#: Rows that one answer to the driver can have.
RANGES = 1 << 14
#: Rows of a shard that one task numbers.
SLOT_ROWS = 50_000


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity at which ``shards`` contiguous runs hold all sizes, in their order."""
    prefix = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
    low = max(int(max(sizes, default=0)), -(-int(prefix[-1]) // shards))
    high = int(prefix[-1])
    while low < high:
        mid = (low + high) // 2
        if _fits(prefix, shards, mid):
            high = mid
        else:
            low = mid + 1
    return low


def _fits(prefix: np.ndarray, shards: int, capacity: int) -> bool:
    at = 0
    for _ in range(shards):
        at = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        if at == len(prefix) - 1:
            return True
    return False


def even_cuts(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """Where shards 1, 2, ... begin: the boundaries nearest to equal sizes among those that keep to the capacity."""
    prefix = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).tolist()
    n, total = len(sizes), prefix[-1]
    earliest = [0] * (shards + 1)  # boundary from which the shards after it can still hold the rest
    earliest[shards] = n
    for j in range(shards - 1, 0, -1):
        earliest[j] = bisect_left(prefix, prefix[earliest[j + 1]] - capacity)
    cuts, at = [], 0
    for j in range(1, shards):
        latest = bisect_right(prefix, prefix[at] + capacity) - 1
        target = prefix[at] + (total - prefix[at]) / (shards - j + 1)
        near = bisect_left(prefix, target)
        if near > 0 and (near > n or target - prefix[near - 1] <= prefix[near] - target):
            near -= 1
        at = max(at, min(max(near, earliest[j]), latest))
        cuts.append(at)
    return cuts


def find_cuts(groups: DataFrame, shards: int, ranges: int = RANGES) -> list[int]:
    """Hashes at which shards 1, 2, ... begin. groups: h long (unique), bytes long."""
    step = max(1, (ranges - 1).bit_length())
    shift = 64 - step

    def sums(df: DataFrame, by: int) -> list[tuple[int, int, int, int, int]]:
        key = F.shiftright("h", by) if by else F.col("h")
        rows = df.groupBy(key.alias("k")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("m")).collect()
        return sorted((r.k << by, r.b, r.n, r.m, by) for r in rows)

    nodes = sums(groups, shift)  # first hash, bytes, groups, largest group, bits of the range
    if not nodes:
        return []
    largest = max(x[3] for x in nodes)
    while True:
        sizes = [x[1] for x in nodes]
        prefix = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
        total = int(prefix[-1])
        low, high = max(largest, -(-total // shards)), smallest_capacity(sizes, shards)
        wanted: set[int] = set()
        if low < high:
            first, last = 0, 0
            for _ in range(1, shards):
                first = max(first, int(np.searchsorted(prefix, prefix[first] + low, "right")) - 1)
                last = min(total, last + high)
                end = int(np.searchsorted(prefix, last, "left"))
                wanted |= {i for i in range(first, min(end, len(nodes))) if nodes[i][2] > 1}
        if not wanted:
            return [nodes[i][0] if i < len(nodes) else 2**63 for i in even_cuts(sizes, shards, high)]
        many = sum(nodes[i][2] for i in wanted)
        got = []
        for bits in sorted({nodes[i][4] for i in wanted}):
            own = [nodes[i][0] >> bits for i in wanted if nodes[i][4] == bits]
            finer = 0 if many <= ranges else max(0, bits - max(1, (ranges // len(wanted)).bit_length() - 1))
            asked = groups.sparkSession.createDataFrame([(k,) for k in own], "k long")  # at most as many rows as came back before
            got += sums(groups.join(F.broadcast(asked), F.shiftright("h", bits) == F.col("k"), "left_semi"), finer)
        nodes = sorted([x for i, x in enumerate(nodes) if i not in wanted] + got)


def assign(df: DataFrame, shards: int = N_SHARDS, doc_id: str = "doc_id", text: str = "text", slot_rows: int = SLOT_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    raw = body.cast("binary")
    rows = saved(df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw).cast("long") + ROW_BYTES).alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(body).alias("h")), "shard-rows")
    groups = rows.groupBy("h").agg(F.sum("size").alias("bytes"))
    groups = saved(groups, "shard-groups")
    cuts = find_cuts(groups, shards)
    shard = F.lit(0)
    for cut in cuts:
        if cut < 2**63:
            shard = shard + (F.col("h") >= cut).cast("int")
    placed = rows.withColumn("shard", shard.cast("int"))
    # rows are numbered within many small cells of each shard; a cell's first number is the count of the cells before
    cells = max(1, -(-rows.count() // (shards * slot_rows)))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("doc_id", "h"), F.lit(cells)).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "cell").orderBy("doc_id", "h")
    numbered = placed.withColumn("nth", F.row_number().over(own) - 1).join(firsts, ["shard", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
