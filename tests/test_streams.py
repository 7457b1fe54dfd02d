"""Stream files: written from chunk rows, read as tables; damage; growing sources."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from millrace.functions.checksums import crc32c_many
from millrace.operators import blocks, index
from millrace.operators.running import running
from millrace.sources import chunks as source
from millrace.streaming import follow


def framed(kind, payload):
    return bytes([kind]) + len(payload).to_bytes(3, "little") + payload


def masked(data):
    c = int(crc32c_many([data])[0])
    return ((((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF).to_bytes(4, "little")


def leb(n):
    return bytes([n & 127 | 128, *leb(n >> 7)]) if n > 127 else bytes([n])


def stored(data):
    return framed(1, masked(data) + data)


HEAD = framed(0xFF, b"MinLz" + bytes([10]))


def test_written_streams_read_back(spark, tmp_path):
    texts = {"a": b"hello " * 3000, "b": b"", "c": bytes(range(256)) * 40}
    rows = spark.createDataFrame(list(texts.items()), "k string, data binary")
    made = {}
    for r in sorted(blocks.stored_chunks(rows, "k", "data", 4096, 512).collect(), key=lambda r: (r.k, r.chunk_no)):
        made[r.k] = made.get(r.k, b"") + bytes(r.chunk)
    assert made["b"][:5] == bytes.fromhex("2001000000") and all(len(v) % 512 == 0 for v in made.values())
    for k, v in made.items():
        (tmp_path / f"{k}.mz").write_bytes(v)
    chunks = source.read_chunks(spark, str(tmp_path / "*.mz")).cache()
    got = {}
    for r in sorted(source.decode_chunks(chunks).collect(), key=lambda r: (r.path, r.start)):
        assert r.error is None and r.end - r.start == len(r.data)
        got[r.path[-4]] = got.get(r.path[-4], b"") + bytes(r.data)
    assert got == {k: v for k, v in texts.items() if v}
    assert all(r.ok for r in source.stream_checks(chunks).collect())
    assert source.index_entries(chunks).where("uncompressed = 4096").count() == 2


def test_concatenated_and_user_chunks(spark, tmp_path):
    one, two = b"abcabcabc" * 100, b"second stream, second stream, second stream"
    (tmp_path / "x.mz").write_bytes(HEAD + stored(one) + framed(0x85, b"note") + framed(0x20, leb(len(one))) + framed(0x20, b"\0") + HEAD + stored(two) + framed(0xFE, b"\0\0") + framed(0x20, leb(len(two))))
    chunks = source.read_chunks(spark, str(tmp_path)).cache()
    assert [bytes(r.data) for r in source.decode_chunks(chunks).orderBy("start").collect()] == [one, two]
    assert [(r.id, bytes(r.payload)) for r in source.user_chunks(chunks).collect()] == [(0x85, b"note")]
    assert [(r.stream_no, r.blocks, r.ok) for r in source.stream_checks(chunks).orderBy("stream_no").collect()] == [(0, 1, True), (1, 0, True), (2, 1, True)]


@pytest.mark.parametrize(
    ("data", "error"),
    [
        (stored(b"x" * 100), "corrupt"), (HEAD[:7], "corrupt"), (HEAD + framed(0x3F, b""), "unsupported"), (framed(0xFF, b"Other!"), "corrupt"),
        (framed(0xFF, b"MinLz" + bytes([0x8A])), "unsupported"), (HEAD + stored(b"y" * 100), "corrupt"), (HEAD + framed(2, b"1234\xff"), "corrupt"), (HEAD + framed(1, b"123"), "corrupt"),
    ],
)
def test_malformed(spark, tmp_path, data, error):
    (tmp_path / "bad.mz").write_bytes(data)
    assert error in {r.error for r in source.read_chunks(spark, str(tmp_path)).select("error").collect()}


def test_damaged_block_fails_alone(spark, tmp_path):
    good, bad = b"good data " * 50, bytearray(framed(1, masked(b"was fine") + b"was fIne"))
    (tmp_path / "d.mz").write_bytes(HEAD + bytes(bad) + stored(good) + framed(0x20, leb(8 + len(good))))
    chunks = source.read_chunks(spark, str(tmp_path))
    rows = source.decode_chunks(chunks).orderBy("start").collect()
    assert [r.error for r in rows] == ["crc", None] and bytes(rows[1].data) == good
    # blocks outside a range are neither decoded nor verified
    assert [r.error for r in source.decode_chunks(chunks).where("start >= 8").collect()] == [None]
    assert [r.error for r in source.decode_chunks(chunks, verify=False).orderBy("start").collect()] == [None, None]


def test_coded_blocks_are_measured_not_decoded(spark, tmp_path):
    (tmp_path / "c.mz").write_bytes(HEAD + framed(2, b"1234" + leb(900) + b"body") + stored(b"after") + framed(0x20, leb(905)))
    chunks = source.read_chunks(spark, str(tmp_path)).cache()
    assert [(r.start, r.end, r.error) for r in source.decode_chunks(chunks).orderBy("start").collect()] == [(0, 900, "unsupported"), (900, 905, None)]
    assert [(r.bytes, r.total, r.ok) for r in source.stream_checks(chunks).collect()] == [(905, 905, True)]


def test_options(spark, tmp_path):
    for bad in (0, (8 << 20) + 1):
        with pytest.raises(ValueError):
            source.headers(spark.createDataFrame([], "path string, chunk_no long, chunk binary"), max_block=bad)
    empty = source.scan(spark.createDataFrame([], "path string, chunk_no long, chunk binary"))
    assert empty.count() == 0 and source.index_of(empty).count() == 0 and source.decode_chunks(empty).count() == 0


def test_padded_streams_have_no_compressed_total(spark):
    cut = blocks.packed_blocks(spark.createDataFrame([("a", 1, b"x" * 5000), ("a", 2, None), ("a", 3, b"y" * 100), ("b", 1, b"z")], "k string, n int, d binary"), "k", "n", "d", 4096)
    assert sorted((r.path, r.block_no, len(r.block)) for r in cut.collect()) == [("a", 0, 4096), ("a", 1, 1004), ("b", 0, 1)]
    padded, plain = (source.headers(blocks.stream_chunks(cut, 4096, pad)) for pad in (512, 1))
    assert all(r.total_compressed is None for r in source.index_totals(padded).collect())
    assert {r.path: (r.total_uncompressed, r.total_compressed) for r in source.index_totals(plain).collect()} == {"a": (5100, 10 + 8 + 8 + 5100 + 6), "b": (1, 10 + 8 + 1 + 5)}


def test_follow_and_thin(spark, tmp_path):
    src = tmp_path / "in"
    for part in range(3):
        spark.range(part * 100, part * 100 + 100).select(F.lit("s").alias("stream"), (F.col("id") * 7).alias("place")).coalesce(1).write.mode("append").parquet(str(src))
    kept = []
    stream = follow.follow(spark, str(src))
    follow.drain(follow.thin_stream(stream, "stream", "place", 100), "append", str(tmp_path / "cp"), lambda df, _: kept.extend(r.place for r in df.collect()))
    assert kept and all(b - a >= 100 for a, b in zip(sorted(kept), sorted(kept)[1:]))
    before = len(kept)
    spark.range(300, 400).select(F.lit("s").alias("stream"), (F.col("id") * 7).alias("place")).coalesce(1).write.mode("append").parquet(str(src))
    follow.drain(follow.thin_stream(follow.follow(spark, str(src)), "stream", "place", 100), "append", str(tmp_path / "cp"), lambda df, _: kept.extend(r.place for r in df.collect()))
    assert len(kept) > before and len(set(kept)) == len(kept)
    # an entry that lies before those kept in earlier batches is given as late
    late = []
    spark.createDataFrame([("s", 3), ("s", 10**6)], "stream string, place long").coalesce(1).write.mode("append").parquet(str(src))
    follow.drain(follow.thin_stream(follow.follow(spark, str(src)), "stream", "place", 100), "append", str(tmp_path / "cp"), lambda df, _: late.extend((r.place, r.late) for r in df.collect()))
    assert sorted(late) == [(3, True), (10**6, False)]


def test_writer_state_between_batches(spark, tmp_path):
    src, parts, found = tmp_path / "in", [b"ab" * 40, b"c" * 7, b"", b"d" * 200], []
    for n, data in enumerate(parts):
        spark.createDataFrame([("s", n, data)], "k string, n int, d binary").coalesce(1).write.mode("append").parquet(str(src))
        follow.drain(follow.pack_stream(follow.follow(spark, str(src)), "k", "n", "d", 64), "append", str(tmp_path / "cp"), lambda df, _: found.extend((r.block_no, bytes(r.block)) for r in df.collect()))
    whole = b"".join(parts)
    assert sorted(found) == [(i, whole[i * 64 : (i + 1) * 64]) for i in range(len(whole) // 64)]


def test_growing_file(spark, tmp_path):
    log = tmp_path / "log"
    log.write_bytes(b"one\n")
    first = follow.grown(spark, str(log)).collect()
    seen = spark.createDataFrame([(r.path, r.end) for r in first], "path string, end long")
    assert bytes(first[0].data) == b"one\n" and follow.grown(spark, str(log), seen).count() == 0
    log.write_bytes(b"one\ntwo\n")
    assert [(r.offset, bytes(r.data)) for r in follow.grown(spark, str(log), seen).collect()] == [(4, b"two\n")]
    log.write_bytes(b"x")
    assert [(r.offset, bytes(r.data)) for r in follow.grown(spark, str(log), seen).collect()] == [(0, b"x")]


def test_many_requests_of_one_stretch_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source, "BUNCH_ROWS", 16)
    monkeypatch.setattr(source, "PIECE_BYTES", 5000)
    whole = {"a": bytes(i * 7 % 251 for i in range(100000)), "b": b"tail " * 900}
    rows = blocks.packed_blocks(spark.createDataFrame([(k, 1, v) for k, v in whole.items()], "k string, n int, d binary"), "k", "n", "d", 4096)
    scanned = source.scan(blocks.stream_chunks(rows, 4096)).cache()
    wanted = [(i, "a", i * 37 % 3000, i * 37 % 3000 + i * 101 % 9000) for i in range(200)]
    wanted += [(200, "a", 0, 10**15), (201, "a", -50, 90), (202, "b", 4400, 9999), (203, "b", 4500, 9999), (204, "c", 0, 5), (205, None, 0, 5), (206, "a", None, 9), (207, "a", 5, 5), (208, "a", 100, 90000), (209, "b", 4096, 4097), (209, "a", 65535, 65537), (210, "a", 0, 2**63 - 1)]
    asked = spark.createDataFrame(wanted, "id int, path string, first long, last long").withColumn("payload", F.col("id") % 3)
    got = source.read_ranges(scanned, source.index_of(scanned), asked, "id", span=4096)
    assert got.columns == [*asked.columns, "piece"]
    want = sorted(((i, str(p), a, z, (whole.get(p, b"")[max(a, 0) : z] or None) if a is not None else None) for i, p, a, z in wanted), key=repr)
    assert sorted([(r["id"], str(r["path"]), r["first"], r["last"], None if r["piece"] is None else bytes(r["piece"])) for r in got.collect()], key=repr) == want


def test_pieces_are_not_shuffled(spark):
    rows = spark.range(4).select(F.lit("s").alias("k"), "id", F.lit(b"0123456789" * 1000).alias("d"))
    scanned = source.scan(blocks.stream_chunks(blocks.packed_blocks(rows, "k", "id", "d", 4096), 4096))
    asked = spark.range(9).select("id", F.lit("s").alias("path"), (F.col("id") * 1000).alias("first"), (F.col("id") * 1500).alias("last"))
    plan = source.read_ranges(scanned, source.index_of(scanned), asked, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert not any(node in line and "piece" in line for line in plan.splitlines() for node in ("Join", "Aggregate", "Repartition"))


def test_wide_rows_of_running_totals_meet_no_join(spark):
    rows = spark.createDataFrame([("a", 1, 5, "x"), ("a", 5000, 7, "y"), (None, 2, 1, "z"), ("a", 9000, None, "w"), ("a", 9001, 2, "v")], "k string, o long, n int, d string")
    got = running(rows, ["k"], "o", {"s": (F.col("n"), "sum"), "m": (F.col("n"), "max")})
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted([tuple(r) for r in got.select("d", "s", "m").collect()]) == [("v", 12, 7), ("w", 12, 7), ("x", 0, None), ("y", 5, 5), ("z", 0, None)]


def test_index_of_written_streams_as_json_uses_arrow_checksums(spark):
    rows = spark.createDataFrame([("s", 1, b"x" * 9000), ("s", 2, b"y" * 10)], "k string, n int, d binary")
    made = blocks.stream_chunks(blocks.packed_blocks(rows, "k", "n", "d", 4096), 4096)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert f"], {PythonEvalType.SQL_SCALAR_ARROW_UDF}" in plan and f"], {PythonEvalType.SQL_SCALAR_PANDAS_UDF}" not in plan
    found = source.headers(made)
    out = index.to_json(source.index_of(found), source.index_totals(found), "path", "compressed", "uncompressed", "spacing").collect()
    at = [{"compressed": 10 + 4104 * i, "uncompressed": 4096 * i} for i in range(3)]
    assert [(r.path, json.loads(r.json)) for r in out] == [("s", {"total_uncompressed": 9010, "total_compressed": 10 + 24 + 9010 + 6, "offsets": at, "est_block_uncompressed": 4096})]
