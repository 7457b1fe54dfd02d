"""Byte statistics: histograms, entropies, prefix codes and benchmark reports."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BITS = 11  # fixed value: the longest code of the block format


def byte_histogram(df: DataFrame, key: str, data: str) -> DataFrame:
    """key, byte, n. Partial histograms per batch (at most 256 rows a key) are summed by Spark."""

    def count(batches):
        for batch in batches:
            keys, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sums: dict = {}
            for k, v in zip(keys, values, strict=True):
                if v:
                    h = np.bincount(np.frombuffer(v, np.uint8), minlength=256)
                    sums[k] = sums[k] + h if k in sums else h
            ks, bs, ns = [], [], []
            for k, h in sums.items():
                used = np.flatnonzero(h)
                ks += [k] * len(used)
                bs.append(used)
                ns.append(h[used])
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ks, batch.column(0).type), pa.array(join(bs).astype(np.int32)), pa.array(join(ns).astype(np.int64))], ["k", "byte", "n"])

    kind = df.schema[key].dataType.simpleString()
    parts = df.select(F.col(key), F.col(data).cast("binary")).mapInArrow(count, f"k {kind}, byte int, n long")
    return parts.groupBy("k", "byte").agg(F.sum("n").alias("n")).withColumnRenamed("k", key)


def entropy(histogram: DataFrame, key: str) -> DataFrame:
    """key, n, distinct, bits (n log n - sum f log f), bound (less 2.5 bits per 256 bytes, not below 0), cost (bits, or stored)."""
    total = F.sum("n")
    bits = total * F.log2(total) - F.sum(F.col("n") * F.log2("n"))
    stats = histogram.groupBy(key).agg(total.alias("total"), F.count(F.lit(1)).alias("distinct"), bits.alias("bits"))
    return stats.select(key, F.col("total").alias("n"), "distinct", "bits", F.greatest(F.col("bits") - 2.5 * F.col("total") / 256, F.lit(0.0)).alias("bound"), F.least(F.col("bits"), 8.0 * F.col("total")).alias("cost"))


def code_lengths(counts: list[int], most: int = MAX_BITS) -> list[int]:
    """Optimal prefix-code lengths of at most `most` bits (package-merge over the sorted counts)."""
    if len(counts) == 1:
        return [1]
    leaves = sorted((c, i) for i, c in enumerate(counts))
    packages: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(most):
        merged = list(heapq.merge(((c, (i,)) for c, i in leaves), packages, key=lambda x: x[0]))
        packages = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(merged[::2], merged[1::2])]
    lengths = [0] * len(counts)
    for _, members in packages[: len(counts) - 1]:
        for i in members:
            lengths[i] += 1
    return lengths


def prefix_codes(histogram: DataFrame, key: str) -> DataFrame:
    """key, byte, n, len: a length-limited prefix code for each key. A group is a histogram, so at most 256 rows."""

    def lengths(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "byte"])
        return group.assign(len=np.array(code_lengths(group.n.tolist()), np.int32))

    kind = histogram.schema[key].dataType.simpleString()
    return histogram.select(key, "byte", "n").groupBy(key).applyInPandas(lengths, f"{key} {kind}, byte int, n long, len int")


def code_report(codes: DataFrame, key: str) -> DataFrame:
    """key, symbols, kraft (2**11 for a complete code), longest, code_bits (sum of n * len)."""
    return codes.groupBy(key).agg(F.count(F.lit(1)).alias("symbols"), F.sum(F.pow(F.lit(2.0), F.lit(MAX_BITS) - F.col("len"))).cast("long").alias("kraft"), F.max("len").alias("longest"), F.sum(F.col("n") * F.col("len")).alias("code_bits"))


def ratio_report(df: DataFrame, key: str, size_in: str, size_out: str) -> DataFrame:
    """key, rows, ratio (total), geomean of the rows' ratios; rows without output are left out."""
    ratio = F.col(size_in) / F.col(size_out)
    return df.where(F.col(size_out) > 0).where(F.col(size_in) > 0).groupBy(key).agg(F.count(F.lit(1)).alias("rows"), (F.sum(size_in) / F.sum(size_out)).alias("ratio"), F.exp(F.avg(F.log(ratio))).alias("geomean"))


def best_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The best of each run's samples."""
    return df.groupBy(*keys).agg(F.max(value).alias("best"), F.count(F.lit(1)).alias("samples"))


def median_ratio(df: DataFrame, keys: list[str], side: str, a: str, b: str, value: str) -> DataFrame:
    """A/B comparison: the median over runs of best(a) / best(b); keys[:-1] name the comparison, keys[-1] the run."""
    pick = lambda v: F.max(F.when(F.col(side) == v, F.col(value)))
    runs = df.groupBy(*keys).agg(pick(a).alias("a"), pick(b).alias("b")).where(F.col("a").isNotNull() & (F.col("b") != 0))
    return runs.groupBy(*keys[:-1]).agg(F.median(F.col("a") / F.col("b")).alias("median_ratio"), F.count(F.lit(1)).alias("runs"))


def sampled_saving(df: DataFrame, key: str, data: str, block: int = 65535, runs: int = 16, run: int = 256) -> DataFrame:
    """key, bytes, saved: an estimate from `runs` samples of `run` bytes, evenly placed in every block, whole if short.

    What a block saves is its length less its share of the samples' entropy bound. Samples are cut where the rows are, a
    block's histogram is made from them at once.
    """

    def estimate(batches):
        for batch in batches:
            sizes, saved = [], []
            for value in batch.column(1).to_pylist():
                total = 0.0
                for at in range(0, len(value), block):
                    v = np.frombuffer(value, np.uint8, count=min(block, len(value) - at), offset=at)
                    s = v if len(v) <= runs * run else np.concatenate([v[a : a + run] for a in (np.arange(runs) * (len(v) - run) // (runs - 1)).tolist()])
                    c = np.bincount(s, minlength=256)
                    c = c[c > 0]
                    bits = max(0.0, len(s) * np.log2(len(s)) - float((c * np.log2(c)).sum()) - 2.5 * len(s) / 256)
                    total += len(v) - bits * len(v) / len(s) / 8
                sizes.append(len(value))
                saved.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(saved, pa.float64())], ["k", "bytes", "saved"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, data).mapInArrow(estimate, f"k {kind}, bytes long, saved double").withColumnRenamed("k", key)


def pivot_report(df: DataFrame, key: str, run: str, value: str, runs: list[str], digits: int = 6) -> DataFrame:
    """key, n, the best of each run as a column, and geomean of the positive values."""
    best = df.groupBy(key).pivot(run, runs).agg(F.max(value))
    rest = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n"), F.exp(F.avg(F.when(F.col(value) > 0, F.log(value)))).alias("geomean"))
    joined = best.join(rest, F.col(key).eqNullSafe(F.col("_k")))
    return joined.select(key, "n", *[F.round(r, digits).alias(r) for r in runs], F.round("geomean", digits).alias("geomean"))
