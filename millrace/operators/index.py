"""Seek indexes as tables: building, thinning, as-of look-up, reduction, totals, JSON.

A stream may hold most entries, so none of these puts a stream into one window: work is done in ranges of offsets (buckets),
and a row per bucket, or a few entry points per bucket, carry what lies before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running

MOST_ENTRIES = 65535  # fixed value: entries that an index may hold
#: Spacings that a bucket of thinning is wide, and bytes that a bucket of looking up is wide.
CELLS, WIDTH = 256, 1 << 24


def build(entries: DataFrame, stream: str, compressed: str, uncompressed: str) -> DataFrame:
    """Entries as an index holds them: of those at one uncompressed offset the last chunk's place counts."""
    return entries.groupBy(stream, uncompressed).agg(F.max(compressed).alias(compressed))


def regressions(entries: DataFrame, stream: str, order: str, compressed: str, uncompressed: str) -> DataFrame:
    """The entries that an index refuses: an offset below one before it, or a new block at a place already used."""
    seen = running(entries, [stream], order, {"_u": (F.col(uncompressed), "max"), "_c": (F.col(compressed), "max")})
    fell = (F.col(uncompressed) < F.col("_u")) | (F.col(compressed) < F.col("_c"))
    return seen.where(fell | ((F.col(compressed) == F.col("_c")) & (F.col(uncompressed) > F.col("_u")))).drop("_u", "_c")


def _fold(at: np.ndarray, spacing: int, first: int) -> list[int]:
    """Places of the entries kept, from that at `first` on."""
    kept, i = [], first
    while i < len(at):
        kept.append(i)
        i = int(np.searchsorted(at, at[i] + spacing))
    return kept


def thin(entries: DataFrame, stream: str, at: str, spacing: int | Column, cells: int = CELLS) -> DataFrame:
    """The entries a writer keeps: the first, then each that lies `spacing` or more behind the last one kept.

    A fold, but in three jobs: an earlier bucket can only lead into a bucket at the entries of its first spacing, or the
    first one after these. For each such entry point its bucket tells how far the fold gets; the entry points in use follow
    from chaining these, a handful per bucket; then every bucket is folded from its own. Entries are (stream, at); repeated
    ones count once. The spacing may be a column that is constant in a stream.
    """
    kind, place = entries.schema[stream].dataType.simpleString(), entries.schema[at].dataType.simpleString()
    space = spacing if isinstance(spacing, Column) else F.lit(spacing)
    rows = entries.select(F.col(stream).alias("k"), F.col(at).cast("long").alias("at"), space.cast("long").alias("s")).distinct().withColumn("b", F.floor(F.col("at") / (F.col("s") * cells)))

    def points(table: pa.Table) -> pa.Table:
        a, s = np.sort(table.column("at").to_numpy()), table.column("s")[0].as_py()
        start = table.column("b")[0].as_py() * s * cells
        n = min(len(a), int(np.searchsorted(a, start + s)) + 1)
        last = np.arange(n)
        while True:  # every entry point's fold, side by side
            ahead = np.searchsorted(a, a[last] + s)
            if not (more := ahead < len(a)).any():
                break
            last = np.where(more, ahead, last)
        same = lambda c: pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type)
        return pa.table({"k": same("k"), "b": same("b"), "at": a[:n], "leaves": a[last] + s})

    def chain(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("at").to_numpy(), kind="stable")
        a, leaves = table.column("at").to_numpy()[order], table.column("leaves").to_numpy()[order]
        used, i = [], 0
        while i < len(a):
            used.append(int(order[i]))
            i = int(np.searchsorted(a, leaves[i]))
        return table.select(["k", "b", "at"]).take(pa.array(used, pa.int64()))

    def fold(table: pa.Table) -> pa.Table:
        a, entry = table.column("at").to_numpy(), table.column("entry").to_numpy(zero_copy_only=False)
        if not entry.any():
            return table.select(["k", "at"]).slice(0, 0)
        own, s = np.sort(a[~entry]), int(table.column("s").to_numpy().max())
        kept = own[_fold(own, s, int(np.searchsorted(own, a[entry][0])))]
        return pa.table({"k": pa.array([table.column("k")[0].as_py()] * len(kept), table.schema.field("k").type), "at": kept})

    entry_points = rows.groupBy("k", "b").applyInArrow(points, f"k {kind}, b long, at long, leaves long").groupBy("k").applyInArrow(chain, f"k {kind}, b long, at long")
    both = rows.select("k", "b", "at", "s", F.lit(False).alias("entry")).union(entry_points.select("k", "b", "at", F.lit(0).cast("long"), F.lit(True)))
    return both.groupBy("k", "b").applyInArrow(fold, f"k {kind}, at long").select(F.col("k").alias(stream), F.col("at").cast(place).alias(at))


def find(index: DataFrame, queries: DataFrame, stream: str, at: str, offset: str, width: int = WIDTH) -> DataFrame:
    """queries with `found`: the last entry at or before the offset of the query's stream; 0 before the first or without any."""
    tick = index.select(F.col(stream).alias("_k"), F.col(at).alias("_at"), F.lit(0).alias("_q"), *[F.lit(None).cast(f.dataType).alias(f"_{f.name}") for f in queries.schema.fields])
    ask = queries.select(F.col(stream).alias("_k"), F.col(offset).alias("_at"), F.lit(1).alias("_q"), *[F.col(c).alias(f"_{c}") for c in queries.columns])
    rows = tick.union(ask).withColumn("_bucket", F.floor(F.col("_at") / width))
    entry = F.when(F.col("_q") == 0, F.col("_at"))
    over = Window.partitionBy("_k").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("_k", "_bucket").agg(F.max(entry).alias("_m")).select(F.col("_k").alias("_ck"), F.col("_bucket").alias("_cb"), F.max("_m").over(over).alias("_carry"))
    upto = Window.partitionBy("_k", "_bucket").orderBy("_at", "_q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("_own", F.last(entry, ignorenulls=True).over(upto)).where("_q = 1")
    found = seen.join(carry, F.col("_k").eqNullSafe(F.col("_ck")) & F.col("_bucket").eqNullSafe(F.col("_cb")))
    return found.select(*[F.col(f"_{c}").alias(c) for c in queries.columns], F.coalesce("_own", "_carry", F.lit(0)).alias("found"))


def reduce_entries(index: DataFrame, stream: str, at: str, most: int = MOST_ENTRIES + 1, spacing: int | None = None) -> DataFrame:
    """Every (r + 1)-th entry of streams with `most` entries or more; r is the least that leaves fewer.

    With a spacing, r also grows until kept entries are 1 MiB apart or about 1000 are left, whichever comes first.
    """
    r = F.floor((F.col("_n") + 1) / most)
    if spacing:
        r = F.greatest(r, F.least(F.lit(max(0, -(-(1 << 20) // spacing) - 1)), F.floor(F.col("_n") / 1001)))
    count = index.groupBy(F.col(stream).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    rows = running(index, [stream], at, {"_p": (F.lit(1), "sum")}, WIDTH)
    rows = rows.join(count, F.col(stream).eqNullSafe(F.col("_k")))
    return rows.where((F.col("_n") < most) | (F.pmod(F.col("_p"), r + 1) == 0)).select(*index.columns)


def reduce_light(index: DataFrame, stream: str, at: str, spacing: int, most: int = MOST_ENTRIES) -> DataFrame:
    """(stream, at): streams with more than `most` entries thinned again at twice the spacing, others as they are."""
    count = index.groupBy(F.col(stream).alias("_k")).agg((F.count(F.lit(1)) > most).alias("_many"))
    rows = index.join(count, F.col(stream).eqNullSafe(F.col("_k"))).select(stream, at, F.when(F.col("_many"), 2 * spacing).otherwise(0).alias("_s"))
    return thin(rows.where("_s > 0"), stream, at, F.col("_s")).union(rows.where("_s = 0").select(stream, at))


def to_json(index: DataFrame, totals: DataFrame, stream: str, compressed: str, uncompressed: str, spacing: str) -> DataFrame:
    """stream, json: totals (unknown ones as -1), entries in order (null without any) and spacing.

    totals: stream, total_uncompressed, total_compressed and the spacing. An index is bounded by MOST_ENTRIES when reduced.
    """
    entry = F.struct(F.col(compressed).alias("compressed"), F.col(uncompressed).alias("uncompressed"))
    listed = index.groupBy(F.col(stream).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(F.col(uncompressed).alias("u"), entry.alias("e")))).alias("_l"))
    known = lambda c: F.coalesce(F.col(c), F.lit(-1)).cast("long").alias(c)
    shape = F.struct(known("total_uncompressed"), known("total_compressed"), F.transform("_l", lambda x: x["e"]).alias("offsets"), F.col(spacing).alias("est_block_uncompressed"))
    return totals.join(listed, F.col(stream).eqNullSafe(F.col("_k")), "left").select(stream, F.to_json(shape, {"ignoreNullFields": "false"}).alias("json"))
