"""Operator 8: near-duplicate vectors by a subspace pigeonhole join.

For unit vectors, cosine >= c means squared distance <= 2 - 2c. A fixed random rotation spreads the distance over the
coordinates; they are split into blocks, and a pair within the budget D must be within D * (block's share) in one block
at least. So each block is joined on its own under its share of the budget, and the union of the blocks' candidates is
checked on the whole vectors in double precision. No pair at the threshold is missed: rounding is covered by a margin.

Each block's join is a range join on its leading coordinate: cells as wide as the block's radius, every vector at home in
one cell and a visitor in the one below, so that close pairs meet in one cell. Cells fall into tiles of bounded size (a
cell that holds a third of all vectors becomes many tasks). First only the block's coordinates go to the tiles, in single
precision with a margin; a tile's distances are one matrix product, and it names the nodes that some other one may be
close to. The whole vectors of those nodes, and of no others, then go to the tile, where block distances and cosines are
computed in double precision. A pair that several blocks find counts in the first of them. A tile emits counts per vector
and a spanning forest, never its pairs.

Equal vectors are one node with a multiplicity, so copies are counted but not paired.

Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, as do rows with a null id;
vectors of different lengths link with nothing of another length. Repeated rows are rows: they are each other's links.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import ship, stash

BLOCK_DIMS = 16
TILE = 16384
STEP = 1024
_SLACK = 1e-9
#: Above what single precision can be off in half a squared distance of parts of unit vectors.
_SINGLE = 4e-6


def rotation(dims: int, seed: int = 8) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int) -> list[tuple[int, int]]:
    """Coordinates from, to of each block: about BLOCK_DIMS wide."""
    n = max(1, dims // BLOCK_DIMS)
    edges = [dims * i // n for i in range(n + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(budget: float):
    def cells(batches):
        """(dims, block, cell) of each vector, its home, and its coordinates there: one row for each block."""
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            node = batch.column(0).to_numpy()
            dims = np.array([len(v) for v in vectors], int)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                y = _unit(np.array([vectors[i] for i in at], float)) @ rotation(d)
                for b, (lo, hi) in enumerate(blocks(d)):
                    width = np.sqrt(budget * (hi - lo) / d) + _SLACK
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[at]), pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(np.floor(y[:, lo] / width).astype(np.int32)), pa.array([p.tobytes() for p in y[:, lo:hi].astype(np.float32)], pa.binary())],
                        ["node", "dims", "block", "cell", "part"],
                    )

    return cells


def _near(budget: float):
    def near(table: pa.Table) -> pa.Table:
        """The nodes of a tile pair that another of its nodes may be within the block's share of."""
        side, d, block = table.column("side").to_numpy(), table.column("dims")[0].as_py(), table.column("block")[0].as_py()
        lo, hi = blocks(d)[block]
        part = np.frombuffer(b"".join(table.column("part").to_pylist()), np.float32).reshape(len(side), hi - lo)
        half, one = (part * part).sum(axis=1, keepdims=True) / 2, np.ones((len(part), 1), np.float32)
        x, y = np.hstack([part, -half, -one]), np.hstack([part, one, half])  # x @ y.T: minus half the squared distance
        within = table.column("ti")[0].as_py() == table.column("tj")[0].as_py() and not table.column("visit")[0].as_py()
        left = np.flatnonzero(side == 0)
        right = left if within else np.flatnonzero(side == 1)
        least, open_ = np.float32(-(budget * (hi - lo) / d + _SLACK) / 2 - _SINGLE), np.zeros(len(side), bool)
        for i in range(0, len(left), STEP):
            l = left[i : i + STEP]
            for j in range(i if within else 0, len(right), STEP):
                r = right[j : j + STEP]
                close = x[l] @ y[r].T >= least
                if within and i == j:
                    np.fill_diagonal(close, False)
                open_[l] |= close.any(axis=1)
                open_[r] |= close.any(axis=0)
        return table.filter(pa.array(open_)).select(["dims", "block", "cell", "ti", "tj", "visit", "side", "node"])

    return near


def _join(threshold: float, budget: float):
    def join(table: pa.Table) -> pa.Table:
        """Links of one tile pair: per node the number of linked rows, and an edge to the tile's component root."""
        node, mult, side = table.column("node").to_numpy(), table.column("mult").to_numpy(), table.column("side").to_numpy()
        d, block = table.column("dims")[0].as_py(), table.column("block")[0].as_py()
        raw = np.array(table.column("v").to_pylist(), float)
        unit = _unit(raw)
        y = unit @ rotation(d)
        spans, within = blocks(d), table.column("ti")[0].as_py() == table.column("tj")[0].as_py() and not table.column("visit")[0].as_py()
        left = np.flatnonzero(side == 0)
        right = left if within else np.flatnonzero(side == 1)
        degree, root = np.zeros(len(node), np.int64), np.arange(len(node))
        shares = [budget * (hi - lo) / d + _SLACK for lo, hi in spans]
        lo, hi = spans[block]
        square = (y[:, lo:hi] ** 2).sum(axis=1)
        for i in range(0, len(left), STEP):
            for j in range(i if within else 0, len(right), STEP):
                l, r = left[i : i + STEP], right[j : j + STEP]
                far = square[l, None] + square[None, r] - 2 * (y[l, lo:hi] @ y[r, lo:hi].T)
                a, b = np.nonzero(far <= shares[block])
                a, b = l[a], r[b]
                if within:
                    a, b = a[a < b], b[a < b]
                for s in range(0, len(a), 1 << 17):
                    p, q = a[s : s + (1 << 17)], b[s : s + (1 << 17)]
                    for e in range(block):  # found by an earlier block: counted there
                        f, t = spans[e]
                        new = ((y[p, f:t] - y[q, f:t]) ** 2).sum(axis=1) > shares[e]
                        p, q = p[new], q[new]
                    good = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                    p, q = p[good], q[good]
                    degree += np.bincount(p, mult[q], len(node)).astype(np.int64) + np.bincount(q, mult[p], len(node)).astype(np.int64)
                    while len(p):  # each node to the least root around it
                        x, z = root[p], root[q]
                        differ = x != z
                        if not differ.any():
                            break
                        np.minimum.at(root, np.maximum(x, z)[differ], np.minimum(x, z)[differ])
                        while (root[root] != root).any():
                            root = root[root]
        keep = np.flatnonzero(degree)
        return pa.table({"node": node[keep], "links": degree[keep], "root": node[root[keep]]})

    return join


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links (other rows with cosine >= threshold), component_id (the smallest id reachable), kept (it is its own)."""
    ship(vectors.sparkSession)
    budget = 2 - 2 * threshold
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # no -0.0
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = stash(vectors.select(F.col(id_col).alias("id"), F.when(fine & F.col(id_col).isNotNull(), v).alias("v")), "vectors")
    nodes = stash(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("mult")).withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    cells = stash(nodes.select("node", "v").mapInArrow(_cells(budget), "node long, dims int, block int, cell int, part binary"), "cells")
    # a tile is a hash share of a cell's home rows; visitors come from the cell above, in that cell's tiles
    counts = cells.groupBy("dims", "block", "cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    homes = cells.join(counts, ["dims", "block", "cell"]).withColumn("t", F.pmod(F.xxhash64("node", "block"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    inner = homes.withColumn("o", other).select("dims", "block", "cell", F.least("t", "o").alias("ti"), F.greatest("t", "o").alias("tj"), F.lit(False).alias("visit"), (F.col("t") > F.col("o")).cast("int").alias("side"), "node", "part")
    above = counts.select("dims", "block", (F.col("cell") - 1).alias("cell"), F.col("tiles").alias("up"))
    as_home = homes.join(above, ["dims", "block", "cell"]).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("up") - 1))).select("dims", "block", "cell", F.col("t").alias("ti"), F.col("o").alias("tj"), F.lit(True).alias("visit"), F.lit(0).alias("side"), "node", "part")
    below = counts.select("dims", "block", (F.col("cell") + 1).alias("cell"), F.col("tiles").alias("down"))
    as_guest = homes.join(below, ["dims", "block", "cell"]).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("down") - 1))).select("dims", "block", (F.col("cell") - 1).alias("cell"), F.col("o").alias("ti"), F.col("t").alias("tj"), F.lit(True).alias("visit"), F.lit(1).alias("side"), "node", "part")
    tile = ["dims", "block", "cell", "ti", "tj", "visit"]
    open_ = stash(inner.union(as_home).union(as_guest).groupBy(*tile).applyInArrow(_near(budget), "dims int, block int, cell int, ti int, tj int, visit boolean, side int, node long"), "open-vectors")
    found = stash(open_.join(nodes.select("node", "v", "mult"), "node").groupBy(*tile).applyInArrow(_join(threshold, budget), "node long, links long, root long"), "vector-links")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(links, "node", "left").join(roots, "node", "left").select("v", "least", "mult", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    label = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(label, "root").select("v", (F.col("links") + F.col("mult") - 1).alias("links"), "component")
    component = F.when(F.col("v").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return rows.join(named, "v", "left").select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.cast(kind).alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
