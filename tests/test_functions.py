"""Functions against plain Python, golden bytes, and damaged input."""

import math
import random
import struct
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import numbers
from millrace.functions.checksums import crc32c, crc32c_many, crc32c_shift, xxh3
from millrace.operators import blocks, index, statistics
from millrace.operators.running import running_total


def leb(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def test_crc_golden():
    assert crc32c_many([b"123456789", b"", b"\0" * 32]).tolist() == [0xE3069283, 0, 0x8A9136AA]
    whole = crc32c_many([b"hello world" * 1000])[0]
    first = crc32c_many([b"hello world" * 400])[0]
    assert crc32c_many([b"hello world" * 600], int(first))[0] == whole


def test_numbers(spark):
    values = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**40 + 7, 2**62]
    rows = spark.createDataFrame([(v,) for v in values], "n long").select("n", numbers.uvarint("n").alias("b"), numbers.uvarint_len("n").alias("l"), numbers.unzigzag(numbers.zigzag(-F.col("n"))).alias("z"), numbers.le_bytes("n", 3).alias("e")).collect()
    for r in rows:
        assert bytes(r.b) == leb(r.n) and r.l == len(leb(r.n)) and r.z == -r.n and bytes(r.e) == struct.pack("<q", r.n)[:3]
    masked = spark.createDataFrame([(0xE3069283,), (0,), (0xFFFFFFFF,)], "c long").select("c", numbers.mask_crc("c").alias("m"), numbers.unmask_crc(numbers.mask_crc("c")).alias("u")).collect()
    assert masked[0].m == 0xC78AB0E5 and all(r.u == r.c for r in masked)


def test_sizes(spark):
    sizes = [4096, 4097, 1 << 20, (1 << 20) + 1, 8 << 20]
    rows = spark.createDataFrame([(s,) for s in sizes], "s long").select("s", numbers.size_indicator("s").alias("i"), numbers.indicated_size(numbers.size_indicator("s")).alias("b"), numbers.index_spacing("s").alias("d")).collect()
    for r in rows:
        assert r.i == (r.s - 1).bit_length() - 10 and r.b == 1 << (r.s - 1).bit_length()
        d = r.s
        while d < 1 << 20:
            d *= 2
        assert r.d == d


def test_offset_symbols(spark):
    rows = spark.range(1, 5000).select(F.col("id").alias("o"), numbers.offset_symbol("id").alias("s")).select("o", "s", numbers.offset_base("s").alias("b"), numbers.offset_extra_bits("s").alias("x")).collect()
    assert all(r.b <= r.o < r.b + (1 << r.x) for r in rows)


def test_block_lengths(spark):
    cases = [(b"\0", 0), (b"\1ab", None), (b"\0\0ab", 2), (b"\0\0", -1), (b"\0\5ab", 5), (b"\0\2abc", -1), (b"\0" + leb(9 << 20) + b"x", -1), (b"\0\x80", -1), (b"\0" + leb(300) + b"xy", 300)]
    rows = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i int, b binary").select("i", numbers.block_len("b").alias("n")).collect()
    assert [r.n for r in sorted(rows)] == [n for _, n in cases]


def test_uvarint_values(spark):
    cases = [(leb(v), v) for v in (0, 1, 127, 128, 300, 2**31, 2**62)] + [(b"\x80", None), (b"", None), (leb(77) + b"\xff", 77)]
    rows = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i int, b binary").select("i", numbers.uvarint_value("b").alias("n")).collect()
    assert [r.n for r in sorted(rows)] == [n for _, n in cases]


def test_checksum_of_parts(spark):
    data = bytes(range(256)) * 9
    for cut in (0, 1, 700, len(data)):
        parts = spark.createDataFrame([(data[:cut], len(data) - cut), (data[cut:], 0)], "b binary, after long").select(crc32c_shift(crc32c("b"), F.col("after")).alias("c")).collect()
        assert parts[0].c ^ parts[1].c == crc32c_many([data])[0]


def test_xxh3_empty(spark):
    row = spark.createDataFrame([(b"",), (None,)], "b binary").select(xxh3("b").alias("x"), crc32c("b").alias("c")).collect()
    assert [(r.x, r.c) for r in row] == [("2d06800538d394c2", 0), (None, None)]


def test_code_lengths():
    rng = random.Random(3)
    for n in (2, 3, 17, 256):
        counts = [max(1, int(math.exp(rng.uniform(0, 12)))) for _ in range(n)]
        lengths = statistics.code_lengths(counts)
        assert max(lengths) <= 11 and sum(2 ** (11 - x) for x in lengths) == 2048
        bits = sum(c * x for c, x in zip(counts, lengths))
        total = sum(counts)
        assert -sum(c * math.log2(c / total) for c in counts) <= bits + 1e-6
    assert statistics.code_lengths([1, 1, 2, 4]) in ([3, 3, 2, 1],)


def test_running_total(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(100)) for i in range(3000)]
    got = running_total(spark.createDataFrame(rows, "k string, i long, v long"), ["k"], "i", F.col("v"), "t", width=64).collect()
    sums = {}
    want = {}
    for k, i, v in rows:
        want[i] = sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v
    assert {r.i: r.t for r in got} == want


def test_thin_and_find(spark):
    rng = random.Random(5)
    rows = sorted({(s, rng.randrange(100_000)) for s in ("x", "y") for _ in range(400)})
    entries = spark.createDataFrame(rows, "s string, place long")
    got = sorted((r.s, r.place) for r in index.thin(entries, "s", "place", 5000).collect())
    want = []
    for s in ("x", "y"):
        last = None
        for k, p in rows:
            if k == s and (last is None or p - last >= 5000):
                want.append((s, p))
                last = p
    assert got == sorted(want)
    asked = spark.createDataFrame([("x", -1), ("x", 50_000), ("x", 10**9), ("z", 5)], "s string, off long")
    found = {(r.s, r.off): r.found for r in index.find(entries, asked, "s", "place", "off").collect()}
    assert found == {(s, o): max([p for k, p in rows if k == s and p <= o], default=0) for s, o in ((r.s, r.off) for r in asked.collect())}


def test_thin_over_buckets(spark):
    """Dense, sparse and skewed streams, null ones too, with buckets of few spacings, against the fold in order."""
    rng = random.Random(6)
    rows = [("dense", i) for i in range(0, 3000, 1)] + [("sparse", rng.randrange(10**9)) for _ in range(200)] + [("hot", rng.randrange(10**6)) for _ in range(3000)] + [(None, rng.randrange(50_000)) for _ in range(300)]
    entries = spark.createDataFrame(rows, "s string, place long").repartition(5)
    for cells in (1, 3, 256):
        got = sorted((r.s or "", r.place) for r in index.thin(entries, "s", "place", 777, cells).collect())
        want = []
        for s in {s for s, _ in rows}:
            last = None
            for p in sorted({p for k, p in rows if k == s}):
                if last is None or p - last >= 777:
                    want.append((s or "", p))
                    last = p
        assert got == sorted(want)
    spaced = entries.withColumn("space", F.when(F.col("s") == "hot", 5000).otherwise(100))
    hot = sorted(r.place for r in index.thin(spaced, "s", "place", F.col("space")).where("s = 'hot'").collect())
    assert all(b - a >= 5000 for a, b in zip(hot, hot[1:])) and len(hot) > 100
    asked = spark.createDataFrame([(s, rng.randrange(-10, 10**6)) for s in ("dense", "hot", None, "none") for _ in range(100)], "s string, off long")
    for r in index.find(entries, asked, "s", "place", "off", width=1000).collect():
        assert r.found == max([p for k, p in rows if k == r.s and p <= r.off], default=0)
    kept = index.reduce_entries(entries.distinct(), "s", "place", most=100)
    by_stream = {}
    for s, p in sorted({r for r in rows}, key=lambda r: (r[0] or "", r[1])):
        by_stream.setdefault(s, []).append(p)
    assert sorted((r.s or "", r.place) for r in kept.collect()) == sorted((s or "", p) for s, v in by_stream.items() for i, p in enumerate(v) if len(v) < 100 or i % ((len(v) + 1) // 100 + 1) == 0)


def test_regressions(spark):
    rows = spark.createDataFrame([(1, 0, 0), (2, 5, 10), (3, 4, 20), (4, 9, 9), (5, 12, 30), (6, 5, 10)], "n long, c long, u long").withColumn("s", F.lit("x"))
    assert sorted(r.n for r in index.regressions(rows, "s", "n", "c", "u").collect()) == [3, 4, 6]
    assert index.regressions(rows.where("n in (1, 2, 5)"), "s", "n", "c", "u").count() == 0


def test_tail_and_ranges(spark):
    data = [b"", b"no feed", b"a\nbc\nd", b"\xff\n\n\x00end", b"x" * 50 + b"\n" + b"y" * 8]
    rows = blocks.tail(spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, data binary"), "data", 10).collect()
    for r in rows:
        last = data[r.i][-10:]
        assert bytes(r.piece) == (last.split(b"\n", 1)[1] if b"\n" in last else b"")
    first, end = blocks.ranges(F.lit(100), F.col("o"), F.col("n"))
    got = spark.createDataFrame([(None, None), (30, None), (None, 20), (30, 20), (300, 5), (None, 500)], "o int, n int").select(first.alias("a"), end.alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(0, 100), (30, 100), (80, 100), (30, 50), (100, 100), (0, 100)]


def test_checksums_hold_little_beside_their_batch():
    data = [bytes([i % 251]) * 4096 for i in range(4096)]
    tracemalloc.start()
    got = crc32c_many(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20 and got[251] == got[0] != got[1]
    # by Arrow arrays as they come, also parts of them, without a bytes object per row
    rows = pa.array([b"zero", None, b"123456789", b"", None, b"x" * 3000], pa.binary())
    assert crc32c.func(rows.slice(1)).to_pylist() == [None, 0xE3069283, 0, None, int(crc32c_many([b"x" * 3000])[0])]
    assert crc32c.func(rows.cast(pa.large_binary())).to_pylist()[2] == 0xE3069283 and crc32c.func(rows.slice(0, 0)).to_pylist() == []
