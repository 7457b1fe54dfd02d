"""Queries over chunk streams made of the given tables: written, scanned, checked, indexed and read back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import numbers
from millrace.functions.checksums import crc32c, crc32c_shift
from millrace.operators import blocks, index, statistics
from millrace.sources import chunks as source
from millrace.sources.store import store

from .catalog import block_offsets, query, table, texts

BLOCK = 4096
_BYTES = "octet_length(encode(coalesce(text, '')))"
_SIZE = f"(SELECT *, {_BYTES} AS n, hex(encode(coalesce(text, ''))) AS x FROM documents)"
#: A source's documents one behind the other, as hexadecimal digits.
_PACKED = f"p AS (SELECT source, string_agg(x, '' ORDER BY doc_id) AS x, CAST(sum(n) AS BIGINT) AS n FROM {_SIZE} GROUP BY source)"


def by_document(spark, sf_dir) -> DataFrame:
    """Every document as a stream of its own: path (its id), chunk_no, chunk."""
    return store(blocks.stored_chunks(texts(spark, sf_dir).select(F.col("doc_id").alias("path"), "data"), "path", "data", BLOCK, 256).select("path", "chunk_no", "chunk"))


def by_source(spark, sf_dir, flush: bool = False) -> DataFrame:
    """Every source as a stream that its documents are written to in order."""
    return store(blocks.stream_chunks(store(blocks.packed_blocks(texts(spark, sf_dir), "source", "doc_id", "data", BLOCK, flush)), BLOCK))


@query(f"SELECT doc_id AS path, (n + {BLOCK - 1}) // {BLOCK} AS blocks, n AS bytes, n AS total, CASE WHEN n > 0 THEN {BLOCK} END::BIGINT AS max_block, TRUE AS ok FROM {_SIZE}")
def stream_checks_documents(spark, sf_dir):
    checks = source.stream_checks(source.headers(by_document(spark, sf_dir)))
    return checks.select("path", "blocks", F.col("bytes").cast("long").alias("bytes"), "total", "max_block", "ok")


@query(f"SELECT doc_id AS path, i * {BLOCK} AS start, least(n, (i + 1) * {BLOCK}) AS \"end\", md5(substr(x, i * {2 * BLOCK} + 1, {2 * BLOCK})) AS digest FROM {_SIZE}, unnest(range(0, (n + {BLOCK - 1}) // {BLOCK})) u(i)")
def scan_blocks_documents(spark, sf_dir):
    return source.decode_chunks(source.scan(by_document(spark, sf_dir))).where("error is null").select("path", "start", "end", F.md5(F.hex("data").cast("binary")).alias("digest"))


def _round_trip(df: DataFrame, text: str) -> DataFrame:
    """The texts as streams, scanned, verified and joined again."""
    streams = blocks.stored_chunks(df.withColumn("data", F.coalesce(text, F.lit("")).cast("binary")).select("path", "data"), "path", "data", BLOCK)
    parts = source.decode_chunks(source.scan(store(streams.select("path", "chunk_no", "chunk"))))
    whole = parts.groupBy(F.col("path").alias("p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.hex("data").alias("x")))), lambda c: c["x"]), "").alias("x"))
    return df.join(whole, F.col("path") == F.col("p"), "left").withColumn("back", F.coalesce(F.unhex("x"), F.lit(b"")).cast("string"))


@query("SELECT doc_id, coalesce(text, '') AS back FROM documents")
def roundtrip_documents(spark, sf_dir):
    return _round_trip(table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id")), "text").select("doc_id", "back")


@query("SELECT page_id, coalesce(html, '') AS back FROM pages")
def roundtrip_pages(spark, sf_dir):
    return _round_trip(table(spark, sf_dir, "pages").withColumn("path", F.col("page_id")), "html").select("page_id", "back")


@query("SELECT conv_id, turn, coalesce(text, '') AS back FROM conversations")
def roundtrip_conversations(spark, sf_dir):
    return _round_trip(table(spark, sf_dir, "conversations").withColumn("path", F.concat_ws("-", "conv_id", "turn")), "text").select("conv_id", "turn", "back")


@query(f"SELECT source, count(*) AS streams, sum((n + {BLOCK - 1}) // {BLOCK})::BIGINT AS blocks, sum(n)::BIGINT AS bytes FROM {_SIZE} GROUP BY source")
def concatenated_streams_by_source(spark, sf_dir):
    """The documents' streams of a source back to back in one file."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "source")
    rows = by_document(spark, sf_dir).join(files, "path").select(F.col("source").alias("path"), (F.col("path") * (1 << 20) + F.col("chunk_no")).alias("chunk_no"), "chunk")
    checks = source.stream_checks(source.headers(rows))
    return checks.where("ok").groupBy(F.col("path").alias("source")).agg(F.count(F.lit(1)).alias("streams"), F.sum("blocks").alias("blocks"), F.sum("bytes").cast("long").alias("bytes"))


@query(f"SELECT doc_id AS path, (n + {BLOCK - 1}) // {BLOCK} - 1 AS blocks, n - {BLOCK} AS bytes FROM {_SIZE} WHERE n > {BLOCK}")
def headerless_scan_documents(spark, sf_dir):
    """Streams entered at their second block, without the identifier."""
    middle = source.headers(by_document(spark, sf_dir).where("chunk_no >= 2"), ignore_stream_id=True)
    data = middle.where((F.col("type") == source.STORED) & F.col("error").isNull())
    return data.groupBy("path").agg(F.count(F.lit(1)).alias("blocks"), F.sum("size").alias("bytes"))


@query(f"SELECT doc_id AS path, CASE WHEN n > 2048 THEN 'too large' END AS error, CASE WHEN n > 2048 THEN 2 WHEN n > 0 THEN 3 ELSE 1 END + CASE WHEN n > 2048 OR s % 256 = 0 THEN 0 ELSE 1 END AS chunks FROM (SELECT *, CASE WHEN n > 0 THEN 10 + n + 8 * ((n + {BLOCK - 1}) // {BLOCK}) ELSE 0 END + 4 + CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 ELSE 4 END AS s FROM {_SIZE})")
def capped_scan_documents(spark, sf_dir):
    """Streams read with a largest block of 2048 bytes: a larger block ends the scan of its stream."""
    rows = source.headers(by_document(spark, sf_dir), max_block=2048)
    return rows.groupBy("path").agg(F.max("error").alias("error"), F.count(F.lit(1)).cast("int").alias("chunks"))


@query(f"SELECT source, sum(b)::BIGINT AS n, sum(CASE WHEN doc_id % 3 = 0 THEN b ELSE 0 END)::BIGINT AS corrupt, 0::BIGINT AS unchecked FROM (SELECT *, (n + {BLOCK - 1}) // {BLOCK} AS b FROM {_SIZE} WHERE n > 0) GROUP BY source")
def verify_damaged_documents(spark, sf_dir):
    """Blocks of every third document with their last byte changed: a check finds each of them, a scan without checks none."""
    last = F.expr("substring(chunk, octet_length(chunk), 1)")
    turned = F.unhex(F.lpad(F.hex(F.conv(F.hex(last), 16, 10).cast("int").bitwiseXOR(F.lit(1))), 2, "0"))
    hit = (F.col("path") % 3 == 0) & (F.hex(F.expr("substring(chunk, 1, 1)")) == "01")
    rows = by_document(spark, sf_dir).withColumn("chunk", F.when(hit, F.concat(F.expr("substring(chunk, 1, octet_length(chunk) - 1)"), turned)).otherwise(F.col("chunk")))
    scanned = store(source.scan(store(rows)))
    checked = source.decode_chunks(scanned).select("path", F.lit(1).alias("n"), (F.col("error") == "crc").cast("int").alias("corrupt"), F.lit(0).alias("unchecked"))
    loose = source.decode_chunks(scanned, verify=False).select("path", F.lit(0), F.lit(0), F.col("error").isNotNull().cast("int"))
    sums = checked.union(loose).groupBy("path").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("n", "corrupt", "unchecked")])
    return sums.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "source"), "path").groupBy("source").agg(*[F.sum(c).alias(c) for c in ("n", "corrupt", "unchecked")])


@query("SELECT doc_id, quality, toxic FROM labels")
def user_chunks_labels(spark, sf_dir):
    """Labels written as user chunks among the blocks of sixteen streams, and read back from them."""
    labels = table(spark, sf_dir, "labels").withColumn("path", F.col("doc_id") % 16)
    own = labels.select("path", F.col("doc_id").alias("block_no"), F.lit(0x80).alias("id"), F.concat(numbers.le_bytes(F.col("doc_id"), 8), numbers.le_bytes(F.col("quality"), 1), numbers.le_bytes(F.col("toxic"), 1)).alias("payload"))
    data = labels.select("path", F.col("doc_id").alias("block_no"), F.col("doc_id").cast("string").cast("binary").alias("block"))
    found = source.user_chunks(source.scan(store(blocks.stream_chunks(data, BLOCK, user=own))), ids=(0x80,))
    number = lambda first, n: numbers.le_value(F.expr(f"substring(payload, {first}, {n})"), n)
    return found.select(number(1, 8).alias("doc_id"), number(9, 1).cast("int").alias("quality"), number(10, 1).cast("int").alias("toxic"))


@query(f"WITH {_PACKED} SELECT source AS path, i AS block_no, md5(substr(x, i * {2 * BLOCK} + 1, {2 * BLOCK})) AS digest FROM p, unnest(range(0, (n + {BLOCK - 1}) // {BLOCK})) u(i)")
def packed_blocks_by_source(spark, sf_dir):
    """Blocks cut across the documents that are written to a source's stream."""
    cut = blocks.packed_blocks(texts(spark, sf_dir), "source", "doc_id", "data", BLOCK)
    return cut.select("path", "block_no", F.md5(F.hex("block").cast("binary")).alias("digest"))


@query(f"""WITH RECURSIVE d AS (SELECT source, doc_id, n, (n + {BLOCK - 1}) // {BLOCK} AS b FROM {_SIZE} WHERE n > 0),
q AS (SELECT source, doc_id, n, b, coalesce(sum(n) OVER w, 0)::BIGINT AS u0, coalesce(sum(n + 8 * b) OVER w, 0)::BIGINT AS c0 FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT source, u0 + i * {BLOCK} AS u, 10 + c0 + i * {BLOCK + 8} AS c FROM q, unnest(range(0, b)) x(i)),
f AS (SELECT source, arg_min(least(n, {BLOCK}), doc_id) AS s FROM d GROUP BY source),
r(source, u) AS (SELECT source, min(u) FROM e GROUP BY source UNION ALL SELECT r.source, (SELECT min(e.u) FROM e WHERE e.source = r.source AND e.u >= r.u + (SELECT s FROM f WHERE f.source = r.source)) FROM r WHERE r.u IS NOT NULL)
SELECT source AS path, c AS compressed, u AS uncompressed FROM r JOIN e USING (source, u)""")
def index_of_streams_by_source(spark, sf_dir):
    """The index of each source's stream, from chunk headers: every document flushed, entries a first block's size apart."""
    return source.index_of(source.headers(by_source(spark, sf_dir, flush=True)))


_TOTALS = f"""t AS (SELECT source, sum(n)::BIGINT AS total_uncompressed, sum(n)::BIGINT AS n FROM {_SIZE} GROUP BY source HAVING sum(n) > 0),
s AS (SELECT source, total_uncompressed, (10 + n + 8 * ((n + {BLOCK - 1}) // {BLOCK}) + 4 + CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 WHEN n < 268435456 THEN 4 ELSE 5 END)::BIGINT AS total_compressed, least(n, {BLOCK})::BIGINT AS spacing FROM t)"""


@query(f"WITH {_TOTALS} SELECT source AS path, total_uncompressed, total_compressed, spacing FROM s")
def index_totals_by_source(spark, sf_dir):
    return source.index_totals(source.headers(by_source(spark, sf_dir)))


@query(f"""WITH {_TOTALS}, e AS (SELECT source, list({{'compressed': 10 + i * {BLOCK + 8}, 'uncompressed': i * {BLOCK}}} ORDER BY i) AS l FROM s, unnest(range(0, (total_uncompressed + {BLOCK - 1}) // {BLOCK})) u(i) GROUP BY source)
SELECT source AS path, CAST(to_json({{'total_uncompressed': total_uncompressed, 'total_compressed': total_compressed, 'offsets': l, 'est_block_uncompressed': spacing}}) AS VARCHAR) AS json FROM s JOIN e USING (source)""")
def index_json_by_source(spark, sf_dir):
    scanned = source.headers(by_source(spark, sf_dir))
    return index.to_json(source.index_of(scanned), source.index_totals(scanned), "path", "compressed", "uncompressed", "spacing")


@query(_LIGHT := f"""WITH RECURSIVE p AS (SELECT source, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM {_SIZE}), u AS (SELECT DISTINCT source, place FROM p),
c AS (SELECT source, count(*) AS n FROM u GROUP BY source), r(source, place) AS (SELECT source, min(place) FROM u JOIN c USING (source) WHERE n > 24 GROUP BY source UNION ALL SELECT r.source, (SELECT min(u.place) FROM u WHERE u.source = r.source AND u.place >= r.place + 8192) FROM r WHERE r.place IS NOT NULL)
SELECT source, place FROM r WHERE place IS NOT NULL UNION ALL SELECT source, place FROM u JOIN c USING (source) WHERE n <= 24""")
def index_reduce_light_documents(spark, sf_dir):
    """Indexes of more than 24 entries thinned at twice a spacing of 4096."""
    entries = store(block_offsets(spark, sf_dir).select("source", F.col("start").alias("place")).distinct())
    return index.reduce_light(entries, "source", "place", 4096, most=24)


@query("""SELECT event_id, user_id, c, u FROM (SELECT *, max(u) OVER w AS mu, max(c) OVER w AS mc FROM (SELECT event_id, user_id, event_id - event_id % 5 AS u, event_id - event_id % 7 AS c FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE u < mu OR c < mc OR (c = mc AND u > mu)""")
def index_regressions_events(spark, sf_dir):
    """Entries that an index refuses, of a stream per user."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") - F.col("event_id") % 7).alias("c"), (F.col("event_id") - F.col("event_id") % 5).alias("u"))
    return index.regressions(rows, "user_id", "event_id", "c", "u").select("event_id", "user_id", "c", "u")


_ASKED = "q AS (SELECT event_id, 'src' || (user_id % 24) AS path, (event_id * 7919) % 90000 AS first, (event_id * 7919) % 90000 + event_id % 6000 AS last FROM events)"


@query(f"WITH {_PACKED}, {_ASKED} SELECT event_id, path, CASE WHEN last > first AND substr(x, 2 * first + 1, 2 * (last - first)) <> '' THEN md5(substr(x, 2 * first + 1, 2 * (last - first))) END AS digest FROM q LEFT JOIN p ON p.source = q.path")
def read_at_events(spark, sf_dir):
    """Ranges of streams read through their indexes, verified; what lies past the end is not there."""
    rows = by_source(spark, sf_dir)
    found = source.headers(rows)
    first = (F.col("event_id") * 7919) % 90000
    asked = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("src"), (F.col("user_id") % 24).cast("string")).alias("path"), first.alias("first"), (first + F.col("event_id") % 6000).alias("last"))
    got = source.read_ranges(source.with_payloads(found, rows), source.index_of(found), asked, "event_id")
    return got.select("event_id", "path", F.md5(F.hex("piece").cast("binary")).alias("digest"))


@query(f"""WITH {_TOTALS}, q AS (SELECT event_id, 'src' || (user_id % 24) AS path, CASE event_id % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'current' ELSE 'end' END AS whence, (event_id * 7919) % 300000 - 100000 AS delta, event_id % 50000 AS here FROM events),
k AS (SELECT q.*, total_uncompressed AS t FROM q LEFT JOIN s ON s.source = q.path), z AS (SELECT *, CASE whence WHEN 'start' THEN delta WHEN 'current' THEN here + delta ELSE t + delta END AS target FROM k)
SELECT event_id, target, CASE WHEN whence = 'end' AND t IS NULL THEN 'unsupported' WHEN target < 0 THEN 'before start' WHEN target > t THEN 'past end' END AS error FROM z""")
def seek_events(spark, sf_dir):
    """Seeks from the start, the place and the end of streams, and why some are refused."""
    e, totals = F.col("event_id"), source.index_totals(source.headers(by_source(spark, sf_dir)))
    asked = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("src"), (F.col("user_id") % 24).cast("string")).alias("path"), F.when(e % 3 == 0, "start").when(e % 3 == 1, "current").otherwise("end").alias("whence"), ((e * 7919) % 300000 - 100000).alias("delta"), (e % 50000).alias("here")
    )
    return source.seek(asked, totals).select("event_id", "target", "error")


@query(f"WITH {_PACKED} SELECT source AS path, greatest(i * {BLOCK}, 10000) AS start, md5(substr(x, 2 * greatest(i * {BLOCK}, 10000) + 1, 2 * (least((i + 1) * {BLOCK}, n) - greatest(i * {BLOCK}, 10000)))) AS digest FROM p, unnest(range(0, (n + {BLOCK - 1}) // {BLOCK})) u(i) WHERE least((i + 1) * {BLOCK}, n) > 10000")
def skip_blocks_by_source(spark, sf_dir):
    """Streams from byte 10000 on: blocks before it are dropped by their headers and never checked."""
    rest = source.decode_chunks(source.scan(by_source(spark, sf_dir)).where("error is null")).where("end > 10000")
    skip = F.greatest(F.lit(10000) - F.col("start"), F.lit(0)).cast("int")
    rest = rest.withColumn("_skip", skip)
    return rest.select("path", (F.col("start") + F.col("_skip")).alias("start"), F.md5(F.hex(F.expr("substring(data, _skip + 1)")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, least(o, n)::BIGINT AS first, least(n, o + t)::BIGINT AS last, greatest(n - t, 0)::BIGINT AS tail, CASE WHEN o > n THEN 'past end' END AS error FROM (SELECT doc_id, n, (doc_id * 131) % 5000 AS o, doc_id % 700 AS t FROM {_SIZE})")
def clamp_ranges_documents(spark, sf_dir):
    """Offset and length against what there is: blocks clamp, streams refuse an offset past the end."""
    rows = texts(spark, sf_dir).select("doc_id", F.col("size").alias("n"), ((F.col("doc_id") * 131) % 5000).alias("o"), (F.col("doc_id") % 700).alias("t"))
    first, last = blocks.ranges(F.col("n"), F.col("o"), F.col("t"))
    tail, _ = blocks.ranges(F.col("n"), F.lit(None).cast("long"), F.col("t"))
    return rows.select("doc_id", first.alias("first"), last.alias("last"), tail.alias("tail"), F.when(F.col("o") > F.col("n"), "past end").alias("error"))


@query(f"SELECT source, count(*) AS \"rows\", round(sum(n)::DOUBLE / sum(s), 9) AS ratio, round(exp(avg(ln(n::DOUBLE / s))), 9) AS geomean FROM (SELECT source, n, 10 + n + 8 * ((n + {BLOCK - 1}) // {BLOCK}) + 4 + CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 ELSE 4 END AS s FROM {_SIZE} WHERE n > 0) GROUP BY source")
def compression_by_source(spark, sf_dir):
    """Bytes of documents for a byte of their stored streams."""
    streams = blocks.stored_chunks(texts(spark, sf_dir).select("doc_id", "data"), "doc_id", "data", BLOCK)
    made = streams.groupBy("doc_id").agg(F.sum(F.octet_length("chunk").cast("long")).alias("coded"))
    report = statistics.ratio_report(texts(spark, sf_dir).select("doc_id", "source", "size").join(made, "doc_id"), "source", "size", "coded")
    return report.select("source", "rows", F.round("ratio", 9).alias("ratio"), F.round("geomean", 9).alias("geomean"))


@query(f"SELECT doc_id, n AS size, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 AND n > 0 THEN -1 ELSE n END AS found FROM {_SIZE}")
def decoded_len_documents(spark, sf_dir):
    """Decoded lengths by the headers of literal blocks, some of which are no blocks and some too short."""
    data = F.col("data")
    block = F.when(F.col("size") == 0, F.lit(b"\0")).otherwise(F.concat(F.lit(b"\0\0"), data))
    short = F.concat(F.lit(b"\0"), numbers.uvarint(F.col("size")), data, F.lit(b"!"))  # a coded body longer than what it decodes to
    rows = texts(spark, sf_dir).withColumn("b", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(b"\1"), data)).when((F.col("doc_id") % 5 == 1) & (F.col("size") > 0), short).otherwise(block))
    return rows.select("doc_id", "size", numbers.block_len("b").alias("found"))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) + 1, 2), lambda i: CAST(('0x' || substr(x, i, 2)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda v, k: xor(v >> 1, (v & 1) * 2197175160))), 4294967295::BIGINT)"


@query(f"SELECT c_custkey, crc, (((crc >> 15) | ((crc & 32767) << 17)) + 2726488792) & 4294967295 AS masked FROM (SELECT c_custkey, {_CRC} AS crc FROM (SELECT c_custkey, hex(encode(c_name)) AS x FROM customer))")
def crc32c_customers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("crc", crc32c(F.col("c_name").cast("binary")))
    return rows.select("c_custkey", "crc", numbers.mask_crc("crc").alias("masked"))


@query(f"SELECT c_custkey, {_CRC} AS crc FROM (SELECT c_custkey, hex(encode(c_name)) AS x FROM customer)")
def running_crc_customers(spark, sf_dir):
    """Checksums of names from those of their blocks of five bytes, which may lie anywhere."""
    cut = blocks.split_blocks(table(spark, sf_dir, "customer").withColumn("data", F.col("c_name").cast("binary")), "data", 5)
    after = F.octet_length("data") - F.col("block_offset") - F.octet_length("block")
    return cut.groupBy("c_custkey").agg(F.bit_xor(crc32c_shift(crc32c("block"), after)).alias("crc"))


_LEB = " || ".join(f"CASE WHEN n >= {1 << 7 * i if i else 0} THEN format('{{:02x}}', (n >> {7 * i}) % 128 + CASE WHEN n >= {1 << 7 * (i + 1)} THEN 128 ELSE 0 END) ELSE '' END" for i in range(8))


@query(f"SELECT o_orderkey, {_LEB} AS code, n AS back FROM (SELECT o_orderkey, o_orderkey * 1000003 AS n FROM orders)")
def varint_values_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", numbers.uvarint(F.col("o_orderkey") * 1000003).alias("b"))
    return rows.select("o_orderkey", F.lower(F.hex("b")).alias("code"), numbers.uvarint_value("b").alias("back"))


@query("SELECT l_orderkey, l_linenumber, o, CASE WHEN o < 16 THEN o ELSE o // (1 << (h - 3)) * (1 << (h - 3)) END::BIGINT AS base, CASE WHEN o < 16 THEN 0 ELSE h - 3 END::INT AS bits FROM (SELECT *, CAST(floor(log2(o)) AS INT) AS h FROM (SELECT l_orderkey, l_linenumber, l_partkey * 37 + l_linenumber AS o FROM lineitem))")
def offset_ranges_lineitem(spark, sf_dir):
    """What an offset's symbol stands for: its first offset and its extra bits."""
    rows = table(spark, sf_dir, "lineitem").withColumn("o", F.col("l_partkey") * 37 + F.col("l_linenumber")).withColumn("s", numbers.offset_symbol("o"))
    return rows.select("l_orderkey", "l_linenumber", "o", numbers.offset_base("s").alias("base"), numbers.offset_extra_bits("s").alias("bits"))


@query("""SELECT l_orderkey, l_linenumber, least(CASE WHEN o <= 1024 AND n <= 18 THEN 2 WHEN o <= 1024 AND n <= 273 THEN 3 ELSE 99 END, CASE WHEN o BETWEEN 64 AND 65599 THEN 3 + m WHEN o BETWEEN 65536 AND 2162687 THEN 4 + m ELSE 99 END)::INT AS len
FROM (SELECT *, CASE WHEN n <= 64 THEN 0 WHEN n <= 319 THEN 1 WHEN n <= 65599 THEN 2 ELSE 3 END AS m FROM (SELECT l_orderkey, l_linenumber, (l_partkey * 37 + l_linenumber * l_linenumber) % 2000000 + 1 AS o, 4 + (l_orderkey * 13 + l_linenumber) % 500 AS n FROM lineitem))""")
def copy_code_lens_lineitem(spark, sf_dir):
    line = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_partkey") * 37 + line * line) % 2000000 + 1).alias("o"), (4 + (F.col("l_orderkey") * 13 + line) % 500).alias("n"))
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(numbers.copy_code_len("o", "n"), F.lit(99)).alias("len"))


@query("SELECT o_orderkey, b, b * CAST(pow(2, greatest(ceil(log2(1048576.0 / b)), 0)) AS BIGINT) AS spacing, ceil(log2(b))::INT - 10 AS indicator, CAST(pow(2, ceil(log2(b))) AS BIGINT) AS indicated FROM (SELECT o_orderkey, 4096 + (o_orderkey * 977) % 8000000 AS b FROM orders)")
def index_spacing_orders(spark, sf_dir):
    """Index spacing and size indicator of block sizes."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (4096 + (F.col("o_orderkey") * 977) % 8000000).alias("b"))
    return rows.select("o_orderkey", "b", numbers.index_spacing("b").alias("spacing"), numbers.size_indicator("b").alias("indicator"), numbers.indicated_size(numbers.size_indicator("b")).alias("indicated"))


@query("SELECT o_orderkey, CASE WHEN b < 4096 OR b > 8388608 THEN 'block size' WHEN p < 1 OR p > 4194304 THEN 'padding' END AS error FROM (SELECT o_orderkey, (o_orderkey * 977) % 9000000 AS b, (o_custkey * 3571) % 4500000 AS p FROM orders)")
def option_checks_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 977) % 9000000).alias("b"), ((F.col("o_custkey") * 3571) % 4500000).alias("p"))
    return rows.select("o_orderkey", numbers.option_errors("b", "p").alias("error"))


@query(f"""WITH d AS (SELECT doc_id, i, least(n - i * 65535, 65535) AS n, substr(x, i * 131070 + 1, 131070) AS x FROM {_SIZE}, unnest(range(0, (n + 65534) // 65535)) u(i)),
r AS (SELECT doc_id, i, n, CASE WHEN n <= 4096 THEN x ELSE list_reduce([substr(x, 2 * (k * (n - 256) // 15) + 1, 512) FOR k IN range(0, 16)], lambda a, b: a || b) END AS x FROM d),
h AS (SELECT doc_id, i, n, length(x) // 2 AS m, substr(x, j, 2) AS b, count(*) AS c FROM r, unnest(range(1, length(x) + 1, 2)) u(j) GROUP BY ALL),
s AS (SELECT doc_id, i, n, greatest(m * log2(m) - sum(c * log2(c)) - 2.5 * m / 256, 0) * n / m / 8 AS coded FROM h GROUP BY doc_id, i, n, m)
SELECT doc_id, sum(n)::BIGINT AS bytes, round(sum(n - coded), 3) AS saved FROM s GROUP BY doc_id""")
def sampled_saving_documents(spark, sf_dir):
    """Bytes that coding a text's blocks would save, from 16 samples of 256 bytes at fixed places of each."""
    return statistics.sampled_saving(texts(spark, sf_dir).where("size > 0").select("doc_id", "data"), "doc_id", "data").select("doc_id", "bytes", F.round("saved", 3).alias("saved"))


@query("SELECT event_type, count(*) AS n, " + ", ".join(f"round(max(CASE WHEN user_id % 4 = {k} THEN value END), 6) AS best_{k}" for k in range(4)) + ", round(exp(avg(ln(value)) FILTER (value > 0)), 6) AS geomean FROM events GROUP BY event_type")
def pivot_report_events(spark, sf_dir):
    """A report of kinds by run: best of each run side by side, and the geometric mean."""
    runs = table(spark, sf_dir, "events").withColumn("run", F.concat(F.lit("best_"), (F.col("user_id") % 4).cast("string")))
    return statistics.pivot_report(runs, "event_type", "run", "value", [f"best_{k}" for k in range(4)], digits=6)
