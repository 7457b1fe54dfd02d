"""Operator 6: near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

Documents are linked when the Jaccard similarity of their sets of five-word shingles reaches a threshold (0.85). The
steps, none of which emits all pairs of a group:

1. Signatures (Arrow batches, numpy): the set's size, a 128-bit digest, MinHash values, the keys of 20 bands of 4 of
   them, and an odd sketch: a bitmap in which each of 128 MinHash values flips one bit. The exclusive-or of two
   sketches is the sketch of the values in which they differ, so its population count estimates the similarity, and
   the more sharply the higher it is.
2. Equal sets become one node (grouped minimum of row keys: id, null last, and digest of the text). From here only nodes
   are compared; a node's full set is made from the text of its row key, so that nodes of null ids have one too.
3. Each band bucket with several nodes has a centre, chosen by hash and so another one in every bucket. Of its up to 20
   centres, each node is compared with the one whose sketch is nearest; the link is confirmed on the full sets.
4. Components so far. Buckets that still hold several components are gone through tile by tile on sketches for pairs
   of different components that may be linked; the nodes of such pairs are compared on their full sets in the tile,
   which emits a spanning forest of the links found there, not the pairs.
5. Components of both kinds of links; one row per document.

At 0.85 a pair shares a bucket with odds 1 - (1 - 0.85**4)**20 = 1 - 4e-7, and passes the sketch test, which is set
five standard deviations below 0.85, with odds above 1 - 1e-6. No link below the threshold is ever made.

Words are runs of anything but 0x20 and 0x09-0x0D with A-Z lower-cased. With fewer than five words the whole sequence is
one shingle. Null, empty and blank texts have no shingles and are linked with nothing. Shingles are compared as 64-bit
hashes. A text's shingles are all used, however long it is. Rows with equal ids count as one node when their texts are
equal and share their component when not; a null id has a null component unless its text is linked to texts with ids.
Empty tables give an empty result; other columns are ignored. `survivors` keeps one row of each component, and all rows
without shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import ship, stash
from .words import distinct, hash_words, mix, rows

SHINGLE, HASHES, BANDS, ROWS, BITS = 5, 128, 20, 4, 512
PERCENT = 85
#: Nodes on one side of a tile, and partners of a centre that are compared in one task.
TILE, FAN = 1024, 512
#: Bytes of shingles on one side of a tile or of a centre's partners in one task; a single larger text is one of its own.
BYTES = 16 << 20

_A = mix(np.arange(HASHES, dtype=np.uint64), 11).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(HASHES, dtype=np.uint64), 12).astype(np.uint32)


def _limit(percent: int) -> int:
    """The largest population count of an exclusive-or of sketches that a pair at the threshold shows within five deviations."""
    j = percent / 100
    p = HASHES * (1 - j)
    differ = 2 * min(HASHES, p + 5 * np.sqrt(p * j))
    mean = BITS / 2 * (1 - (1 - 2 / BITS) ** differ)
    return int(mean + 5 * np.sqrt(mean / 2))


def shingle_sets(texts: pa.Array):
    """Each text's sorted distinct shingles, as 64-bit hashes."""
    words, at = hash_words(texts)
    full = np.zeros(0, np.uint64)
    if len(words) >= SHINGLE:
        n = len(words) - SHINGLE + 1
        full = np.zeros(n, np.uint64)
        for i in range(SHINGLE):
            full += mix(words[i : i + n], 20 + i)
        full = mix(full, 30)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield distinct(full[a : b - SHINGLE + 1])
        elif b > a:
            with np.errstate(over="ignore"):
                yield mix(np.array([sum(int(mix(words[i : i + 1], 40 + i - a)[0]) for i in range(a, b)) + b - a & (2**64 - 1)], np.uint64), 31)
        else:
            yield full[:0]


def signature(s: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Digest, band keys and odd sketch (eight 64-bit words) of a set."""
    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    low = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        least = np.minimum(least, (low[i : i + 2048, None] * _A + _B).min(axis=0))
    keyed = mix(least.astype(np.uint64) | (np.arange(HASHES, dtype=np.uint64) << np.uint64(32)), 13)
    bands = mix(keyed[: BANDS * ROWS].reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64), 14).view(np.int64)
    flips = np.bincount((keyed % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return digest, bands, np.packbits(flips.astype(np.uint8)).view(np.int64)


def _signatures(batches):
    for batch in batches:
        for part in rows(batch):
            ids, digests, sizes, bands, sketches = [], [], [], [], []
            for i, s in enumerate(shingle_sets(part.column(1))):
                sizes.append(len(s))
                d, b, k = signature(s) if len(s) else (None, None, None)
                digests.append(d)
                bands.append(b)
                sketches.append(k)
                ids.append(i)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], ["id", "t", "n", "g", "bands", "sketch"])


def _sets(batches):
    """Per text: digest and shingles."""
    for batch in batches:
        for part in rows(batch):
            found = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s.tobytes()) for s in shingle_sets(part.column(0)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["g", "shingles"])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _confirm(percent: int):
    def confirm(table: pa.Table) -> pa.Table:
        """A centre (the row whose node is the centre) and some of its partners."""
        nodes, centre = table.column("node").to_pylist(), table.column("centre")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        own = sets[nodes.index(centre)]
        good = sorted({n for n, s in zip(nodes, sets, strict=True) if n != centre and _linked(own, s, percent)})
        return pa.table({"a": pa.array([centre] * len(good), pa.binary()), "b": pa.array(good, pa.binary())})

    return confirm


def _maybe(percent: int):
    most = _limit(percent)

    def maybe(table: pa.Table) -> pa.Table:
        """Nodes of a pair of tiles that a link between different components may join, judged by size and sketch."""
        nodes, n = table.column("node").to_pylist(), table.column("n").to_numpy()
        _, comp = np.unique(np.array(table.column("comp").to_pylist(), dtype="S16"), return_inverse=True)
        sketch = np.array(table.column("sketch").to_pylist(), np.int64).view(np.uint64)
        side = table.column("side").to_numpy()
        same = table.column("ti")[0].as_py() == table.column("tj")[0].as_py()
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        open_ = np.zeros(len(nodes), bool)
        for i in range(0, len(left), 64):
            l = left[i : i + 64]
            pop = np.zeros((len(l), len(right)), np.int32)
            for w in range(sketch.shape[1]):
                pop += np.bitwise_count(sketch[l, None, w] ^ sketch[None, right, w])
            ok = (pop <= most) & (comp[l, None] != comp[None, right])
            ok &= 100 * np.minimum(n[l, None], n[None, right]) >= percent * np.maximum(n[l, None], n[None, right])
            open_[l] |= ok.any(axis=1)
            open_[right] |= ok.any(axis=0)
        keep = np.flatnonzero(open_)
        return table.take(pa.array(keep)).select(["bucket", "ti", "tj", "side", "node", "comp"])

    return maybe


def _forest(percent: int):
    def forest(table: pa.Table) -> pa.Table:
        """Links of a tile pair between different components: exact, a spanning forest of them."""
        nodes, comps, side = table.column("node").to_pylist(), table.column("comp").to_pylist(), table.column("side").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        root = {c: c for c in comps}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        same = table.column("ti")[0].as_py() == table.column("tj")[0].as_py()
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        out = []
        for i in range(0, len(left), 256):
            for j in range(i if same else 0, len(right), 256):
                l, r = left[i : i + 256], right[j : j + 256]
                for a, b in _pairs([sets[x] for x in l], [sets[x] for x in r], percent):
                    x, y = find(comps[l[a]]), find(comps[r[b]])
                    if x != y:
                        root[x] = y
                        out.append((nodes[l[a]], nodes[r[b]]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return forest


def _pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int):
    """Index pairs at the threshold, from the product of incidence matrices over the shingles that both sides have."""
    ls, rs = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(ls, rs)
    nl, nr = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    shared = np.zeros((len(left), len(right)), np.float32)
    il, ir = np.repeat(np.arange(len(left)), nl), np.repeat(np.arange(len(right)), nr)
    for c in range(0, len(common), 8192):
        part = common[c : c + 8192]
        ml, mr = np.zeros((len(left), len(part)), np.float32), np.zeros((len(right), len(part)), np.float32)
        for m, s, i in ((ml, ls, il), (mr, rs, ir)):
            at = np.minimum(np.searchsorted(part, s), len(part) - 1)
            hit = part[at] == s
            m[i[hit], at[hit]] = 1
        shared += ml @ mr.T
    return np.argwhere(100 * shared >= percent * (nl[:, None] + nr[None, :] - shared)).tolist()


def _key(id_col: str, text_col: str) -> list:
    """A row's key: its id and t, its text's digest. Rows with equal keys are repeats."""
    return [F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("t")]


def _labelled(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, t, n, component_id and least_t (id and t of the component's least row; a null id is the greatest) of every row."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    row_id, digest = _key(id_col, text_col)
    texts = docs.select(row_id, F.col(text_col).alias("text"), digest)
    signs = stash(texts.mapInArrow(_signatures, f"id {kind}, t binary, n long, g binary, bands array<long>, sketch array<long>"), "signatures")
    some = signs.where("n > 0")
    key = F.struct(F.col("id").isNull().alias("lost"), "id", "t")
    nodes = stash(some.groupBy("g").agg(F.min(key).alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    sketches = nodes.select("g", "n", "sketch")

    bands = stash(nodes.select(F.col("g").alias("node"), "n", F.explode("bands").alias("bucket")), "bands")
    centres = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min_by("node", F.xxhash64("node", "bucket")).alias("centre")).where("m > 1")
    filled = stash(bands.join(centres, "bucket"), "buckets")  # the buckets of several nodes
    near = filled.where("node != centre").select("centre", "node").distinct()
    near = near.join(sketches.toDF("node", "n1", "s1"), "node").join(sketches.toDF("centre", "n2", "s2"), "centre")
    differ = sum(F.bit_count(F.col("s1")[i].bitwiseXOR(F.col("s2")[i])) for i in range(BITS // 64))
    near = near.withColumn("differ", differ).where((F.col("differ") <= _limit(percent)) & (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")))
    best = stash(near.groupBy("node").agg(F.min_by("centre", F.struct("differ", "centre")).alias("centre"), F.first("n1").alias("n")), "best")

    # the full sets of nodes in such buckets, from one text of each
    wanted = filled.select(F.col("node").alias("g")).distinct().join(nodes.select("g", "key.id", "key.t"), "g").select("id", "t").alias("wanted")
    given = texts.alias("given").join(wanted, F.col("given.id").eqNullSafe(F.col("wanted.id")) & (F.col("given.t") == F.col("wanted.t")), "left_semi")
    distinct_sets = given.select("text").mapInArrow(_sets, "g binary, shingles binary").join(nodes.select(F.col("g")), "g", "left_semi")
    sets = stash(distinct_sets.groupBy("g").agg(F.first("shingles").alias("shingles")).withColumnRenamed("g", "node"), "sets")

    salt = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    shares = lambda most: F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("n") * 8 / BYTES)).cast("int")
    fans = best.groupBy("centre").agg(shares(FAN).alias("parts"))
    partners = best.join(fans, "centre").select("centre", "node", salt.alias("part"))
    own = fans.select("centre", F.col("centre").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    compare = partners.union(own).join(sets, "node")
    first = stash(compare.groupBy("centre", "part").applyInArrow(_confirm(percent), "a binary, b binary"), "links")

    roots = components(first)
    inside = filled.select("bucket", "node", "n").join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("comp"))
    mixed = inside.groupBy("bucket").agg(shares(TILE).alias("tiles"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("bucket", "tiles")
    members = inside.join(mixed, "bucket").join(sketches.select(F.col("g").alias("node"), "sketch"), "node").withColumn("t", F.pmod(F.xxhash64("node", "bucket"), F.col("tiles")).cast("int"))
    all_tiles = F.sequence(F.lit(0), F.col("tiles") - 1)
    placed = members.withColumn("other", F.explode(all_tiles)).select("bucket", F.least("t", "other").alias("ti"), F.greatest("t", "other").alias("tj"), (F.col("t") > F.col("other")).cast("int").alias("side"), "node", "comp", "n", "sketch")
    open_ = stash(placed.groupBy("bucket", "ti", "tj").applyInArrow(_maybe(percent), "bucket long, ti int, tj int, side int, node binary, comp binary"), "open")
    second = open_.join(sets, "node").groupBy("bucket", "ti", "tj").applyInArrow(_forest(percent), "a binary, b binary")

    roots = components(first.union(second))
    named = nodes.select("g", "key").join(roots, nodes["g"] == roots["node"], "left").select("g", "key", F.coalesce("root", "g").alias("root"))
    label = named.groupBy("root").agg(F.min("key").alias("least"))
    labels = named.join(label, "root").select("g", F.col("least.id").alias("component_id"), F.col("least.t").alias("least_t"))
    return signs.select("id", "t", "n", "g").join(labels, "g", "left")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links, its own included), kept (it is its own component's id)."""
    out = _labelled(docs, percent, id_col, text_col)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def survivors(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, its least by id (null last) and text digest, and all rows without shingles."""
    least = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("t") == F.col("least_t"))
    rows = _labelled(docs, percent, id_col, text_col).where("n > 0").groupBy("id", "t").agg(F.first(least).alias("least"), F.count(F.lit(1)).alias("m"))
    marked = stash(rows.where("not least or m > 1").select("id", "t", "least"), "near-copies").alias("marked")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_key(id_col, text_col)).alias("keyed")
    same = F.col("keyed.id").eqNullSafe(F.col("marked.id")) & (F.col("keyed.t") == F.col("marked.t"))
    kept = keyed.join(marked, same, "left_anti").select("row")
    repeated = marked.where("least").alias("marked")
    if repeated.limit(1).count():  # of repeats one stays, by a grouped minimum that begins in each task
        kept = kept.union(keyed.join(repeated, same, "left_semi").groupBy("id", "t").agg(F.min("row").alias("row")).select("row"))
    return kept.select("row.*")
