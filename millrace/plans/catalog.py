"""The engine's queries over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import numbers
from millrace.functions.checksums import crc32c, xxh3
from millrace.operators import blocks, index, statistics
from millrace.sources.store import store
from millrace.streaming.follow import event_totals, settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, sf_dir) -> DataFrame:
    """documents with data (the text's bytes) and size."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    return table(spark, sf_dir, "documents").withColumn("data", data).withColumn("size", F.octet_length(data).cast("long"))


_HIST = """WITH h AS (SELECT {key} AS k, hex(encode({text})) AS x FROM {table}),
b AS (SELECT k, CAST(('0x' || substr(x, i, 2)) AS INT) AS byte FROM h, unnest(range(1, length(x) + 1, 2)) u(i)),
g AS (SELECT k, byte, count(*) AS n FROM b GROUP BY ALL) """


@query(_HIST.format(key="lang", text="text", table="documents") + "SELECT k AS lang, byte, n FROM g")
def byte_histogram_by_lang(spark, sf_dir):
    return statistics.byte_histogram(table(spark, sf_dir, "documents"), "lang", "text")


@query(_HIST.format(key="role", text="text", table="conversations") + "SELECT k AS role, byte, n FROM g")
def byte_histogram_by_role(spark, sf_dir):
    return statistics.byte_histogram(table(spark, sf_dir, "conversations"), "role", "text")


@query(
    _HIST.format(key="lang", text="text", table="documents")
    + """SELECT lang, total AS n, d AS "distinct", round(bits, 3) AS bits, round(greatest(bits - 2.5 * total / 256, 0), 3) AS bound, round(least(bits, 8.0 * total), 3) AS cost
FROM (SELECT k AS lang, sum(n)::BIGINT AS total, count(*) AS d, sum(n) * log2(sum(n)) - sum(n * log2(n)) AS bits FROM g GROUP BY k)"""
)
def entropy_by_lang(spark, sf_dir):
    stats = statistics.entropy(byte_histogram_by_lang(spark, sf_dir), "lang")
    return stats.select("lang", "n", "distinct", *[F.round(c, 3).alias(c) for c in ("bits", "bound", "cost")])


@query()
def prefix_codes_by_lang(spark, sf_dir):
    return statistics.prefix_codes(byte_histogram_by_lang(spark, sf_dir), "lang")


@query(_HIST.format(key="lang", text="text", table="documents") + "SELECT k AS lang, count(*) AS symbols, CASE WHEN count(*) = 1 THEN 1024 ELSE 2048 END::BIGINT AS kraft FROM g GROUP BY k")
def kraft_by_lang(spark, sf_dir):
    return statistics.code_report(prefix_codes_by_lang(spark, sf_dir), "lang").select("lang", "symbols", "kraft")


@query()
def code_cost_by_lang(spark, sf_dir):
    """Bits of the texts under their own code against the entropy bound."""
    report = statistics.code_report(prefix_codes_by_lang(spark, sf_dir), "lang")
    return report.join(entropy_by_lang(spark, sf_dir).select("lang", "n", "bits"), "lang")


@query("SELECT source, count(*) AS \"rows\", round(sum(octet_length(encode(text)))::DOUBLE / sum(n_chars), 9) AS ratio, round(exp(avg(ln(octet_length(encode(text))::DOUBLE / n_chars))), 9) AS geomean FROM documents WHERE n_chars > 0 AND octet_length(encode(text)) > 0 GROUP BY source")
def bytes_per_char_geomean(spark, sf_dir):
    report = statistics.ratio_report(texts(spark, sf_dir), "source", "size", "n_chars")
    return report.select("source", "rows", F.round("ratio", 9).alias("ratio"), F.round("geomean", 9).alias("geomean"))


@query("SELECT event_type, user_id % 16 AS run, max(value) AS best, count(*) AS samples FROM events GROUP BY ALL")
def best_of_samples(spark, sf_dir):
    return statistics.best_of(table(spark, sf_dir, "events").withColumn("run", F.col("user_id") % 16), ["event_type", "run"], "value")


@query("""WITH r AS (SELECT event_type, user_id AS run, max(CASE WHEN event_id % 2 = 0 THEN value END) AS a, max(CASE WHEN event_id % 2 = 1 THEN value END) AS b FROM events GROUP BY ALL)
SELECT event_type, round(median(a / b), 9) AS median_ratio, count(*) AS runs FROM r WHERE a IS NOT NULL AND b <> 0 GROUP BY event_type""")
def median_speed_ratio(spark, sf_dir):
    sides = table(spark, sf_dir, "events").withColumn("side", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b"))
    return statistics.median_ratio(sides, ["event_type", "user_id"], "side", "a", "b", "value").withColumn("median_ratio", F.round("median_ratio", 9))


@query("SELECT page_id, CAST(i AS INT) AS block_no, i * 1024 AS block_offset, md5(substr(hex(encode(html)), i * 2048 + 1, 2048)) AS digest, CAST(least(octet_length(encode(html)) - i * 1024, 1024) AS INT) AS len FROM pages, unnest(range(0, (octet_length(encode(html)) + 1023) // 1024)) u(i)")
def block_split_pages(spark, sf_dir):
    cut = blocks.split_blocks(table(spark, sf_dir, "pages").withColumn("data", F.col("html").cast("binary")), "data", 1024)
    return cut.select("page_id", "block_no", "block_offset", F.md5(F.hex("block").cast("binary")).alias("digest"), F.octet_length("block").alias("len"))


@query("SELECT doc_id, source, coalesce(sum(n) OVER w, 0)::BIGINT AS start, (coalesce(sum(n) OVER w, 0) + n)::BIGINT AS \"end\" FROM (SELECT *, octet_length(encode(coalesce(text, ''))) AS n FROM documents) WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def block_offsets(spark, sf_dir):
    return blocks.offsets(texts(spark, sf_dir).select("doc_id", "source", "size"), "source", "doc_id", F.col("size")).select("doc_id", "source", "start", "end")


_PLACED = """WITH p AS (SELECT doc_id, source, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place, hex(encode(coalesce(text, ''))) AS x
FROM (SELECT *, octet_length(encode(coalesce(text, ''))) AS n FROM documents)) """


@query(_PLACED.replace("WITH p", "WITH RECURSIVE p") + """, u AS (SELECT DISTINCT source, place FROM p), r(source, place) AS (SELECT source, min(place) FROM u GROUP BY source UNION ALL SELECT r.source, (SELECT min(u.place) FROM u WHERE u.source = r.source AND u.place >= r.place + 65536) FROM r WHERE r.place IS NOT NULL)
SELECT source, place FROM r WHERE place IS NOT NULL""")
def index_thin_documents(spark, sf_dir):
    entries = store(block_offsets(spark, sf_dir).select("source", F.col("start").alias("place")))
    return index.thin(entries, "source", "place", 65536)


@query(_PLACED + """, q AS (SELECT event_id, 'src' || (user_id % 24) AS source, (event_id * 7919) % 900000 AS off FROM events), u AS (SELECT DISTINCT source, place FROM p)
SELECT event_id, source, off, coalesce((SELECT max(place) FROM u WHERE u.source = q.source AND u.place <= q.off), 0)::BIGINT AS found FROM q""")
def index_find_events(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("src"), (F.col("user_id") % 24).cast("string")).alias("source"), ((F.col("event_id") * 7919) % 900000).alias("off"))
    entries = block_offsets(spark, sf_dir).select("source", F.col("start").alias("place")).distinct()
    return index.find(entries, asked, "source", "place", "off")


@query(_PLACED + """, u AS (SELECT source, place, row_number() OVER (PARTITION BY source ORDER BY place) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT source, place FROM p))
SELECT source, place FROM u WHERE n < 16 OR k % ((n + 1) // 16 + 1) = 0""")
def index_reduce_documents(spark, sf_dir):
    entries = block_offsets(spark, sf_dir).select("source", F.col("start").alias("place")).distinct()
    return index.reduce_entries(entries, "source", "place", 16)


@query(_PLACED + """SELECT source, doc_id, substr(x, 2 * greatest(10000 - place, 0) + 1, 2 * (least(place + n, 60000) - place - greatest(10000 - place, 0))) AS piece FROM p WHERE place + n > 10000 AND place < 60000""")
def range_read_documents(spark, sf_dir):
    placed = blocks.offsets(texts(spark, sf_dir).select("source", "doc_id", "data", "size"), "source", "doc_id", F.col("size"))
    return blocks.read_range(placed, "data", 10000, 60000).select("source", "doc_id", F.hex("piece").alias("piece"))


@query("WITH t AS (SELECT doc_id, substr(x, greatest(length(x) - 1024, 0) + 1) AS x FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents)) SELECT doc_id, CASE WHEN regexp_extract(x, '^((?:..)*?0A)', 1) = '' THEN '' ELSE substr(x, length(regexp_extract(x, '^((?:..)*?0A)', 1)) + 1) END AS piece FROM t")
def tail_lines_documents(spark, sf_dir):
    return blocks.tail(texts(spark, sf_dir).select("doc_id", "data"), "data", 512).select("doc_id", F.hex("piece").alias("piece"))


@query("SELECT doc_id, octet_length(encode(text)) AS n, CASE WHEN octet_length(encode(text)) = 0 THEN 1 WHEN octet_length(encode(text)) <= 8388608 THEN octet_length(encode(text)) + 2 END::BIGINT AS most, octet_length(encode(text)) < 16 AS stored FROM documents")
def max_encoded_len_documents(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.col("size").alias("n"), numbers.max_encoded_len("size").alias("most"), numbers.must_store("size").alias("stored"))


_VAR = " ".join(f"WHEN n < {1 << 7 * k} THEN {k}" for k in range(1, 9))


@query(f"""SELECT o_orderkey, CASE {_VAR} ELSE 9 END AS len, lower(hex(v)) AS zz FROM (SELECT o_orderkey, o_orderkey * 1000003 AS n, CASE WHEN o_custkey % 2 = 0 THEN o_custkey * 2 ELSE o_custkey * 2 - 1 END AS v FROM orders)""")
def varints_orders(spark, sf_dir):
    signed = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).otherwise(-F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.uvarint_len(F.col("o_orderkey") * 1000003).alias("len"), F.lower(F.hex(numbers.zigzag(signed))).alias("zz"))


@query("SELECT l_orderkey, l_linenumber, o, CASE WHEN o < 16 THEN o ELSE CAST(floor(log2(o)) AS INT) * 8 - 16 + (CAST(o // (1 << (CAST(floor(log2(o)) AS INT) - 3)) AS INT) - 8) END::INT AS symbol, CASE WHEN l_quantity <= 29 THEN 1 ELSE 2 END AS lits FROM (SELECT *, (l_partkey * 37 + l_linenumber) AS o FROM lineitem)")
def offset_symbols_lineitem(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("o", F.col("l_partkey") * 37 + F.col("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", "o", numbers.offset_symbol("o").alias("symbol"), numbers.literal_code_len("l_quantity").alias("lits"))


@query("SELECT o_orderkey, t, CASE WHEN t % 512 = 0 THEN 0 WHEN 512 - t % 512 >= 4 THEN 512 - t % 512 ELSE 1024 - t % 512 END::BIGINT AS pad FROM (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS t FROM orders)")
def padding_plan_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("t"))
    return rows.select("o_orderkey", "t", numbers.padding("t", 512).alias("pad"))


@query()
def checksums_documents(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", crc32c("data").alias("crc"), xxh3("data").alias("xxh3"))


@query("""SELECT doc_id, CASE WHEN n = 0 THEN 1 ELSE 2 + (n + 4095) // 4096 END + (p > 0)::INT AS chunks, s + p AS stream_bytes
FROM (SELECT *, CASE WHEN s % 256 = 0 THEN 0 WHEN 256 - s % 256 >= 4 THEN 256 - s % 256 ELSE 512 - s % 256 END AS p
FROM (SELECT doc_id, n, (CASE WHEN n > 0 THEN 10 + n + 8 * ((n + 4095) // 4096) ELSE 0 END) + 4 + CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 ELSE 4 END AS s FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)))""")
def stored_streams_documents(spark, sf_dir):
    """Every document framed as a stored stream padded to 256 bytes: chunks made, then added up."""
    chunks = blocks.stored_chunks(texts(spark, sf_dir).select("doc_id", "data"), "doc_id", "data", 4096, 256)
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("chunk")).alias("stream_bytes"))


@query("SELECT event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents, max(event_id) AS last_event FROM events GROUP BY event_type")
def events_follow_append(spark, sf_dir):
    """The events read as a stream to its present end."""
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return settled(event_totals(rows), "complete")
