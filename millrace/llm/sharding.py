"""Operator 5: contiguous shards of near-equal bytes in which equal texts stay together.

Minimax contiguous partition. Texts are grouped by SHA-256 and the groups put in a fixed order; the smallest shard
capacity for which the greedy cut fits is found by binary search, and the groups are cut there. The greedy check needs
only the places of group borders, and of those only the few near a cut. So the driver holds a bounded summary: borders
of coarse blocks of groups, with which a capacity is checked once pessimistically (cuts at known borders only) and once
optimistically (cuts anywhere in a block). Where the two disagree, the stretch between a cut's earliest and latest place
is summarised again at a finer grain, an interval per cut, until both give the same capacity and cuts: the exact ones.

The largest group bounds the capacity from below, and a capacity above an even share would leave shards empty. So while
the largest group left is above an even share of what is left, it is cut off as a shard of its own (fewer than there are
shards), and the search goes on over the other groups and shards: the largest shard stays the smallest possible, and so
do the next ones.

DataFrame functions only. Equal texts may be a third of all rows, with equal ids or none: rows are counted per (text, id,
part) before they meet, a text's counts are summed by a hash share of its ids (salt), and no window holds more than the
texts of one bucket, the salts of one text or the ids of one salt. Buckets and salts number about the square root of the
rows, whatever that is.

Null texts count as empty (size `overhead`, crc32 of no bytes) and are equal to empty ones; null ids sort first; repeated
rows are rows of their own; an empty table gives an empty result; other columns are ignored. Running it again gives the
same shards, as nothing depends on how the rows are dealt.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stash

#: Summary rows that one refinement brings to the driver at most.
SUMMARY = 1 << 15
#: Shares into which rows equal in id and text are counted.
PARTS = 256


class Blocks:
    """Contiguous blocks of groups: edges[i] to edges[i+1]; single[i] if no group border lies between."""

    def __init__(self, parts: list[tuple[int, int, int]]):
        parts = sorted(parts)
        self.parts, self.edges, self.single = parts, [p[0] for p in parts] + [parts[-1][1]], [p[2] == 1 for p in parts]

    def reach(self, x: int, hopeful: bool) -> int:
        """The last border at or before x: of those known, or (hopeful) of those that may be."""
        i = bisect_right(self.edges, x) - 1
        return self.edges[i] if not hopeful or i >= len(self.single) or self.single[i] else x

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        out = [self.edges[0]]
        for _ in range(shards):
            out.append(self.reach(min(out[-1] + capacity, self.edges[-1]), hopeful))
        return out[1:]

    def least(self, shards: int, hopeful: bool) -> int:
        """The smallest capacity whose greedy cuts get to the end."""
        low, high = 0, self.edges[-1] - self.edges[0]
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.cuts(mid, shards, hopeful)[-1] == self.edges[-1] else (mid + 1, high)
        return low


def _summary(groups: DataFrame, width: int) -> list[tuple[int, int, int]]:
    part = groups.groupBy(F.floor(F.col("at") / width).alias("b")).agg(F.min("at").alias("a"), F.max(F.col("at") + F.col("bytes")).alias("e"), F.count(F.lit(1)).alias("n"))
    return [(r.a, r.e, r.n) for r in part.select("a", "e", "n").collect()]


def minimax_cuts(groups: DataFrame, start: int, end: int, shards: int) -> tuple[int, list[int]]:
    """(capacity, the end of each shard) for groups with columns at (bytes before it) and bytes, which cover start to end.

    Runs a handful of aggregations over the groups, each with at most about 2 * SUMMARY rows of result. A round looks
    again at one interval per cut at most: from the cut that is possible at the earliest to the latest one.
    """
    if end == start:
        return 0, [end] * shards
    width = max(1, -(-(end - start) // SUMMARY))
    blocks = Blocks(_summary(groups.where((F.col("at") >= start) & (F.col("at") < end)), width))
    while True:
        low, high = blocks.least(shards, True), blocks.least(shards, False)
        near, far = blocks.cuts(low, shards, False), blocks.cuts(high, shards, True)
        if low == high and near == far:
            return low, near
        spans: list[list[int]] = []
        for n, f in sorted(zip(near, far, strict=True)):
            inside = [p for p in blocks.parts[max(0, bisect_right(blocks.edges, n) - 1) : bisect_right(blocks.edges, f)] if p[2] > 1 and p[0] < f and n < p[1]]
            if inside and spans and inside[0][0] <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], inside[-1][1])
            elif inside:
                spans.append([inside[0][0], inside[-1][1]])
        width = max(1, min(width // 2, -(-sum(e - a for a, e in spans) // SUMMARY)))
        finer = _summary(groups.where(reduce(lambda x, y: x | y, ((F.col("at") >= a) & (F.col("at") < e) for a, e in spans))), width)
        blocks = Blocks([p for p in blocks.parts if not any(a <= p[0] < e for a, e in spans)] + finer)


def shard_documents(docs: DataFrame, shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in its shard), grown_shard (null), shard_bytes.

    Shards are contiguous in the order (groups above an even share, then by the text's SHA-256), which spreads sources
    evenly. In a shard rows follow the same order, then a hash share of their ids, then the ids.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = stash(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(raw) + F.lit(overhead)).cast("long").alias("size"), F.crc32(raw).alias("crc"), F.unhex(F.sha2(raw, 256)).alias("g"),
            F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int").alias("part"),
        ),
        "shard-rows",
    )
    side = 1 << isqrt(rows.count()).bit_length()  # above the square root of the rows
    salt = F.pmod(F.xxhash64("id"), F.lit(side)).cast("int")
    units = stash(rows.groupBy("g", "id", "part").agg(F.first("size").alias("size"), F.first("crc").alias("crc"), F.count(F.lit(1)).alias("n")).withColumn("salt", salt), "shard-units")
    groups = stash(units.groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("bytes")), "shard-groups")
    top = groups.orderBy(F.desc("bytes"), "g").limit(max(1, shards - 1)).collect()
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    giants, left = [], total
    for r in top:
        if r.bytes * (shards - len(giants)) <= left or len(giants) == shards - 1:
            break
        giants.append(bytes(r.g))
        left -= r.bytes
    # the order's buckets are ranges of the digest's first four bytes
    bucket = F.shiftright(F.conv(F.hex(F.expr("substring(g, 1, 4)")), 16, 10).cast("long") * F.lit(side), 32).cast("int")
    for i, g in enumerate(giants):
        bucket = F.when(F.col("g") == F.lit(g), F.lit(i - len(giants))).otherwise(bucket)
    groups = groups.withColumn("bucket", bucket)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    base = groups.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select(
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0")
    )
    inside = Window.partitionBy("bucket").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    placed = stash(
        groups.join(base, "bucket").select(
            "g", "bytes", (F.col("n0") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("row"), (F.col("b0") + F.coalesce(F.sum("bytes").over(inside), F.lit(0))).alias("at")
        ),
        "shard-placed",
    )
    ends = []
    for r in top[: len(giants)]:
        ends.append((ends[-1] if ends else 0) + r.bytes)
    ends += minimax_cuts(placed.select("at", "bytes"), ends[-1] if ends else 0, total, shards - len(giants))[1]
    shard = sum((F.col("at") >= F.lit(c)).cast("int") for c in ends[:-1]) if shards > 1 else F.lit(0)
    sharded = placed.withColumn("shard", shard)
    first = {r.shard: (r.f, r.b) for r in sharded.groupBy("shard").agg(F.min("row").alias("f"), F.sum("bytes").alias("b")).collect()}
    number = lambda k: F.coalesce(F.create_map(*[F.lit(x) for s, v in first.items() for x in (s, v[k])])[F.col("shard")], F.lit(0)) if first else F.lit(0)
    sharded = sharded.select("g", "shard", (F.col("row") - number(0)).alias("slot"), number(1).alias("shard_bytes"))
    # a text's salts, then the ids of one salt
    salts = units.groupBy("g", "salt").agg(F.sum("n").alias("n")).select("g", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skip"))
    salts = salts.join(sharded, "g").select("g", "salt", "shard", (F.col("slot") + F.col("skip")).alias("slot"), "shard_bytes")
    upto = Window.partitionBy("g", "salt").orderBy("id", "part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = units.join(salts, ["g", "salt"]).withColumn("slot", F.col("slot") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
    # rows equal in id and text differ by their slot alone: dealt out first, then written out
    out = ranked.repartition("g", "id", "part").withColumn("again", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("slot") + F.col("again")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("shard_bytes").cast("long").alias("shard_bytes"),
    )
