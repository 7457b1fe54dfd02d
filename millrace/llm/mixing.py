"""Operator 7: mix sources to target weights by Pareto order sampling.

Targets. The sources' sizes (in words) add up to the mix's budget; sources share it by weight, none beyond `cap` times
its size, and what that leaves over is shared out by weight again until none is above. The result of that loop has a
closed form: with sources sorted by size / weight, a source is capped exactly while the level that would be left for it
and all later ones exceeds its own cap, so a running sum finds the level.

Copies. A document's expected number of copies follows its weight (by default the logarithm of its words, so that fuller
documents are repeated more), none above `cap`: of each source, min(cap, level * weight) adds up to its target in words,
where the level again follows from a running sum, over the source's few classes of weight. The whole part is taken for
certain. The fraction is an inclusion probability p: every document draws u from a hash of its contents and ranks by the
odds ratio (u / (1 - u)) / (p / (1 - p)), and of each source those ranked first are taken, as many as bring its words
nearest to the target. So the size is fixed, the probabilities are unequal, and a run repeats exactly.

DataFrame functions only. No task holds a source: ranks fall into `buckets` per source whose sums give the one bucket in
which the cut lies, and only that bucket's documents are ordered. The cut is then a threshold per source.

Null texts have 0 words; a null source is a source and comes last; null ids draw as any other; rows that are equal in
every used column are taken or left together; weights are rounded to eighths of an octave, null ones count as 1, those of
0 or less are never taken (a target that needs them is missed); sources are listed in one task; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stash

WORD = "[^\\x20\\x09-\\x0D]+"


def fuller(size: Column) -> Column:
    """The default weight: the logarithm of a document's words."""
    return F.log2(size + 2)


def equal(size: Column) -> Column:
    """The same weight for every document."""
    return F.lit(1.0) + size * 0


def _keys(seed: int, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    text = F.col(text_col)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), text), 11).cast("double")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return {"_size": size, "_source": F.col(source_col), "_u": (draw + 0.5) / float(1 << 53), "_tie": F.xxhash64(F.lit(seed + 1), F.col(id_col), text)}


def _weight(weight) -> Column:
    """The class of a weight (a column's name, or a function of the size): eighths of octaves; null: never taken."""
    w = weight(F.col("_size")) if callable(weight) else F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    return F.when(w > 0, F.round(F.log2(w) * 8).cast("int"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, budget: float = 1.0) -> DataFrame:
    """sizes (_source, source_size) with target: one row per source, so the windows hold as many rows as there are sources."""
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    level = Window.orderBy("fill", F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("w", weight)
        .withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("fill", F.col("most") / F.col("w"))
        .withColumn("left", F.sum("source_size").over(everything) * F.lit(budget) - F.coalesce(F.sum("most").over(level), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(level), F.lit(0.0)))
        .withColumn("place", F.row_number().over(level.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("level", F.min(F.when(F.col("left") / F.col("left_w") <= F.col("fill"), F.struct("place", (F.col("left") / F.col("left_w")).alias("to")))).over(everything)["to"])
        .withColumn("target", F.least(F.col("most"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("w")))
        .select("_source", "source_size", "target")
    )


def expectations(classes: DataFrame, cap: float) -> DataFrame:
    """classes (_source, _class, words, target) with _e, the expected copies: one row per source and class of weight."""
    w = F.pow(F.lit(2.0), F.col("_class") / 8.0)
    source = Window.partitionBy("_source")
    first = source.orderBy(F.desc("_class")).rowsBetween(Window.unboundedPreceding, -1)  # the greatest weights meet the cap first
    level = F.col("left") / F.col("pull")
    return (
        classes.where("_class is not null").withColumn("w", w)
        .withColumn("left", F.col("target") - cap * F.coalesce(F.sum("words").over(first), F.lit(0)))
        .withColumn("pull", F.sum(F.col("words") * F.col("w")).over(source) - F.coalesce(F.sum(F.col("words") * F.col("w")).over(first), F.lit(0.0)))
        .withColumn("level", F.max(F.when((F.col("words") > 0) & (level * F.col("w") <= cap), F.struct("_class", level.alias("to")))).over(source)["to"])
        .select(F.col("_source").alias("_s"), F.col("_class").alias("_c"), F.least(F.coalesce("level", F.lit(float("inf"))) * F.col("w"), F.lit(cap)).alias("_e"))
    )


def _ranked(row: DataFrame) -> DataFrame:
    """Adds _whole (certain copies) and _z (the rank's odds ratio on a scale of 0 to 1; null: no fraction), from _e and _u."""
    p = F.col("_e") - F.floor("_e")
    odds = (F.col("_u") / (1 - F.col("_u"))) / (p / (1 - p))
    return row.withColumn("_whole", F.floor("_e").cast("long")).withColumn("_z", F.when(p > 0, odds / (1 + odds)))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 20260101, buckets: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight=fuller) -> DataFrame:
    """docs with _size, _source, _copies, source_size, target: every row once, with the number of copies the mix takes.

    weights: of the sources in order, repeating; weight: of documents, the name of a column or a function of the size.
    """
    keys = _keys(seed, id_col, text_col, source_col)
    given = [weight] if isinstance(weight, str) else []
    counted = lambda df: df.withColumn("_size", F.explode(F.array("_size")))  # noqa: E731  words are counted once, not in every use
    rows = stash(counted(docs.select(*given, *[c.alias(k) for k, c in keys.items()])).withColumn("_class", _weight(weight)).drop(*given), "mix-rows")
    same = lambda a, b, k="_source": a[k].eqNullSafe(b["_s"])
    classes = rows.groupBy("_source", "_class").agg(F.sum("_size").alias("words"))
    sizes = classes.groupBy("_source").agg(F.sum("words").alias("source_size"))
    sources = stash(targets(sizes, weights, cap).withColumnRenamed("_source", "_s"), "mix-targets")
    plan = stash(expectations(classes.join(sources, same(classes, sources)).drop("_s"), cap), "mix-plan")
    both = lambda a: same(a, plan) & (a["_class"] == plan["_c"])
    ranked = _ranked(rows.join(plan, both(rows)).drop("_s", "_c")).withColumn("_bucket", F.floor(F.col("_z") * buckets).cast("int"))
    sums = ranked.groupBy("_source", "_bucket").agg(F.sum("_size").alias("words"), F.sum(F.col("_whole") * F.col("_size")).alias("certain"))
    by_source = Window.partitionBy("_source")
    open_ = (
        sums.join(sources, same(sums, sources)).withColumn("rest", F.col("target") - F.sum("certain").over(by_source)).where("_bucket is not null")
        .withColumn("upto", F.sum("words").over(by_source.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("cut", F.min(F.when(F.col("upto") >= F.col("rest"), F.col("_bucket"))).over(by_source))
    )
    # a row per source with a fraction: the bucket of its cut (all: beyond the last) and the words before that bucket
    cuts = stash(
        open_.groupBy(F.col("_source").alias("_s")).agg(F.coalesce(F.first("cut"), F.lit(buckets)).alias("cut"), F.first("rest").alias("rest"), F.coalesce(F.max(F.when(F.col("_bucket") < F.coalesce(F.col("cut"), F.lit(buckets)), F.col("upto"))), F.lit(0)).alias("before")), "mix-cuts"
    )
    in_cut = ranked.join(cuts, same(ranked, cuts) & (F.col("_bucket") == F.col("cut"))).drop("_s")
    run = F.sum("_size").over(by_source.orderBy("_z", "_tie"))  # equal rows share a place
    last = in_cut.withColumn("upto", run).where(F.col("before") + F.col("upto") - F.col("_size") / 2 <= F.col("rest")).groupBy(F.col("_source").alias("_l")).agg(F.max(F.struct("_z", "_tie")).alias("last"))
    final = stash(sources.join(cuts.select(F.col("_s").alias("_k"), "cut"), F.col("_s").eqNullSafe(F.col("_k")), "left").join(last, F.col("_s").eqNullSafe(F.col("_l")), "left").drop("_k", "_l"), "mix-final")
    taken = counted(docs.withColumns(keys)).withColumn("_class", _weight(weight))
    taken = taken.join(final, same(taken, final)).drop("_s")
    taken = _ranked(taken.join(plan, both(taken), "left").drop("_s", "_c").withColumn("_e", F.coalesce("_e", F.lit(0.0))))
    bucket = F.floor(F.col("_z") * buckets)
    extra = (bucket < F.col("cut")) | ((bucket == F.col("cut")) & F.coalesce((F.col("_z") < F.col("last._z")) | ((F.col("_z") == F.col("last._z")) & (F.col("_tie") <= F.col("last._tie"))), F.lit(False)))
    copies = F.col("_whole") + F.coalesce(extra, F.lit(False)).cast("long")
    return taken.withColumn("_copies", copies).drop("_u", "_tie", "_class", "_e", "_whole", "_z", "cut", "last")


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """id, size, source_size, target, taken (words that the mix takes of the row, repeats counted), copies."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    mixed = mix(narrow, id_col="id", **kw)
    return mixed.select(F.col("id").alias(id_col), F.col("_size").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"))


def mix_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: docs' columns, each row as often as it is taken."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    roles = {r: names[kw.pop(r, d)] for r, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    mixed = mix(inner, **roles, **kw).where("_copies > 0")
    return mixed.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*[F.col(n).alias(c) for c, n in names.items()])
