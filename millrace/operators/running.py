"""Running totals and maxima that no single task computes: per range bucket, over buckets, then inside each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[Column, str]], width: int = 4096) -> DataFrame:
    """df with a column for each of values (name: (value, 'sum' or 'max')) over the key's rows with a smaller `order`.

    `order` is a whole number; equal ones share no order. Without such rows a sum is 0 and a maximum null. A key that holds
    most rows is dealt out by order // width; only one row per bucket meets in the key's window.
    """
    rows = df.withColumn("_b", F.floor(F.col(order) / width)).withColumns({f"_v_{n}": v for n, (v, _) in values.items()})
    total = {"sum": F.sum, "max": F.max}
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*keys, "_b").agg(*[total[how](f"_v_{n}").alias(f"_v_{n}") for n, (_, how) in values.items()])
    base = base.select(*keys, "_b", *[total[how](f"_v_{n}").over(before).alias(f"_v_{n}") for n, (_, how) in values.items()], F.lit(0).alias("_own"))
    # what lies before a bucket is its first row, not joined to it: so rows, which may be wide, move once
    rows = rows.withColumns({f"_v_{n}": F.col(f"_v_{n}").cast(base.schema[f"_v_{n}"].dataType) for n in values} | {"_own": F.lit(1)})
    inside = Window.partitionBy(*keys, "_b").orderBy("_own", order).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.unionByName(base, allowMissingColumns=True).withColumns({f"_in_{n}": total[how](f"_v_{n}").over(inside) for n, (_, how) in values.items()}).where("_own = 1")
    out = {n: F.coalesce(f"_in_{n}", F.lit(0)) if how == "sum" else F.col(f"_in_{n}") for n, (_, how) in values.items()}
    return seen.withColumns(out).select(*[c for c in df.columns if c not in out], *out)


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = 4096) -> DataFrame:
    """df with `name`: the sum of value over the key's rows with a smaller `order`."""
    return running(df, keys, order, {name: (value, "sum")}, width)
