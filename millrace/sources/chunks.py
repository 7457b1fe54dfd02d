"""Chunk streams as tables: a row per chunk, then headers, streams, blocks, checks and index entries as DataFrame work.

A table of chunks has path (the file or stream of streams), chunk_no and chunk (the chunk's bytes, its four-byte header
included). Files become such a table by a walk over their headers; tables of chunks written by Spark already are.
Payloads of blocks are stored bytes; a coded block's length is read from its header, its bytes are not decoded
(`unsupported`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.checksums import crc32c, crc32c_many
from millrace.functions.numbers import MAX_BLOCK, indicated_size, le_value, mask_crc, uvarint_value
from millrace.operators import index
from millrace.operators.blocks import IDENTIFIER, MAGIC
from millrace.operators.running import running

from .store import store

# fixed values: chunk types of the stream format
STORED, CODED, CODED_HASHED_BODY, VECTOR, END, INDEX, PADDING = 0x01, 0x02, 0x03, 0x10, 0x20, 0x40, 0xFE
BLOCKS = (STORED, CODED, CODED_HASHED_BODY)
#: Requests, and bytes that they ask for, that a bunch of reading ranges has; bytes of pieces in a batch of results.
BUNCH_ROWS, BUNCH_BYTES, PIECE_BYTES = 1 << 14, 1 << 25, 1 << 22
_HEAD, _MARK, _BLOCK, _ASKED = range(4)


def chunks_of(files: DataFrame) -> DataFrame:
    """path, chunk_no, chunk of files(path, content). A file is walked in one task; streams are files of bounded size."""

    def walk(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, n, rows = 0, 0, []
                while at < len(content):
                    end = at + 4 + int.from_bytes(content[at + 1 : at + 4], "little")
                    rows.append((path, n, content[at:end]))
                    at, n = end, n + 1
                    if len(rows) == 64 or at >= len(content):
                        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], schema=_CHUNKS)
                        rows = []

    return files.select("path", "content").mapInArrow(walk, "path string, chunk_no long, chunk binary")


_CHUNKS = pa.schema([("path", pa.string()), ("chunk_no", pa.int64()), ("chunk", pa.binary())])


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of stream files."""
    return scan(chunks_of(spark.read.format("binaryFile").load(path)))


def headers(chunks: DataFrame, ignore_stream_id: bool = False, max_block: int = MAX_BLOCK) -> DataFrame:
    """path, stream_no, chunk_no, offset, type, length, size (decoded), start, indicator, error: up to a path's first error.

    From headers only; the payloads are neither kept nor moved. offset is the chunk's place, start that of its decoded bytes.
    stream_no counts streams that follow each other; an end without an identifier is an empty stream.
    ignore_stream_id: chunks from the middle of a stream, whose identifier is not there; they make up stream 0.
    Errors: corrupt, unsupported (reserved chunks, later versions), too large (blocks above max_block).
    """
    if not 0 < max_block <= MAX_BLOCK:
        raise ValueError(f"max_block: {max_block}")
    byte = lambda i: F.conv(F.hex(F.expr(f"substring(chunk, {i}, 1)")), 16, 10).cast("int")
    kind, length = byte(1), le_value(F.expr("substring(chunk, 2, 3)"), 3)
    size = F.when(kind == STORED, length - 4).when(kind.isin(CODED, CODED_HASHED_BODY), uvarint_value(F.expr("substring(chunk, 9, 10)"))).when((kind == END) & (length > 0), uvarint_value(F.expr("substring(chunk, 5)")))
    rows = store(
        chunks.select(
            "path", F.col("chunk_no").cast("long").alias("chunk_no"), kind.alias("type"), length.cast("int").alias("length"), size.cast("long").alias("size"), F.octet_length("chunk").cast("long").alias("whole"),
            F.when(kind == IDENTIFIER, F.hex(F.expr("substring(chunk, 5, 5)")) == MAGIC).alias("named"), F.when(kind == IDENTIFIER, byte(10)).alias("indicator"),
        )
    )
    block = F.col("type").isin(*BLOCKS)
    mark = F.when(F.col("type") == IDENTIFIER, F.col("chunk_no") * 2 + 1).when(F.col("type") == END, F.col("chunk_no") * 2)
    state = running(rows, ["path"], "chunk_no", {"offset": (F.col("whole"), "sum"), "start": (F.when(block, F.col("size")).otherwise(0), "sum"), "_mark": (mark, "max")})
    known = F.lit(ignore_stream_id) | F.coalesce(F.col("_mark") % 2 == 1, F.lit(False))
    begins = (F.col("type") == IDENTIFIER) | ((F.col("type") == END) & ~known)
    state = store(state.withColumn("fault", _fault(known, max_block)).withColumn("begins", begins.cast("long")).drop("_mark", "named", "whole"))
    # a path that ends inside a stream, and the first error of each path
    ends = rows.groupBy("path").agg(F.max("chunk_no").alias("at"), F.max(mark).alias("last")).where(F.lit(not ignore_stream_id) & (F.col("last") % 2 == 1)).select("path", "at")
    faults = ends.union(state.where("fault is not null").select("path", "chunk_no")).groupBy(F.col("path").alias("_p")).agg(F.min("at").alias("_first"))
    rows = running(state, ["path"], "chunk_no", {"_streams": (F.col("begins"), "sum")}).join(faults, F.col("path").eqNullSafe(F.col("_p")), "left").where(F.col("_first").isNull() | (F.col("chunk_no") <= F.col("_first")))
    error = F.coalesce("fault", F.when(F.col("chunk_no") == F.col("_first"), "corrupt"))
    return store(rows.select("path", F.greatest(F.col("_streams") + F.col("begins") - 1, F.lit(0)).cast("int").alias("stream_no"), "chunk_no", "offset", "type", "length", "size", "start", "indicator", error.alias("error")))


def scan(chunks: DataFrame, ignore_stream_id: bool = False, max_block: int = MAX_BLOCK) -> DataFrame:
    """headers with the payload."""
    return with_payloads(headers(chunks, ignore_stream_id, max_block), chunks)


def with_payloads(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """headers found before, with the payload."""
    payloads = chunks.select(F.col("path").alias("_p"), F.col("chunk_no").cast("long").alias("_n"), F.expr("substring(chunk, 5)").alias("payload"))
    return found.join(payloads, F.col("path").eqNullSafe(F.col("_p")) & (F.col("chunk_no") == F.col("_n"))).drop("_p", "_n")


def _fault(known: Column, max_block: int) -> Column:
    kind, length, size, indicator = (F.col(c) for c in ("type", "length", "size", "indicator"))
    identifier = F.when((length < 6) | ~F.col("named"), "corrupt").when((length > 6) | (indicator >= 128), "unsupported").when(indicator % 16 + 10 > 23, "corrupt")
    block = F.when(size.isNull() | (length < 4), "corrupt").when(size > max_block, "too large")
    return (
        F.when((F.col("whole") < 4) | (F.col("whole") < length + 4), "corrupt")
        .when(kind == IDENTIFIER, identifier).when(kind == END, F.when((length > 0) & size.isNull(), "corrupt"))
        .when((kind < 0x40) & ~known, "corrupt").when(kind.isin(*BLOCKS), block).when(kind < 0x40, "unsupported")
    )


def decode_chunks(chunks: DataFrame, verify: bool = True) -> DataFrame:
    """Blocks: path, stream_no, chunk_no, start, end (in the path's decoded bytes), data, error. Checks are per block.

    start and end come from the headers alone, so filters on them drop blocks before any is verified.
    """
    blocks = chunks.where(F.col("type").isin(*BLOCKS)).withColumn("end", F.col("start") + F.coalesce("size", F.lit(0)))
    out = blocks.withColumn("data", F.when(F.col("type") == STORED, F.expr("substring(payload, 5)"))).withColumn("failure", F.when(F.col("type") != STORED, "unsupported"))
    if verify:
        wrong = mask_crc(crc32c(F.coalesce("data", F.lit(b"")))) != le_value(F.expr("substring(payload, 1, 4)"), 4)
        out = out.withColumn("failure", F.coalesce("failure", F.when(wrong, "crc")))
    return out.select("path", "stream_no", "chunk_no", "start", "end", F.when(F.col("failure").isNull(), F.col("data")).alias("data"), F.coalesce("error", "failure").alias("error"))


def user_chunks(chunks: DataFrame, ids: tuple[int, ...] | None = None) -> DataFrame:
    """path, stream_no, chunk_no, id, payload of application chunks, of some ids or of all."""
    found = chunks.where(F.col("type").between(0x80, 0xFD)).select("path", "stream_no", "chunk_no", F.col("type").alias("id"), "payload")
    return found.where(F.col("id").isin(*ids)) if ids is not None else found


def stream_checks(chunks: DataFrame) -> DataFrame:
    """path, stream_no, blocks, bytes, total (as the stream's end says), max_block, ok."""
    block = F.col("type").isin(*BLOCKS)
    sums = chunks.groupBy("path", "stream_no").agg(
        F.sum(block.cast("long")).alias("blocks"), F.sum(F.when(block, F.col("size")).otherwise(0)).alias("bytes"), F.max(F.when(F.col("type") == END, F.col("size"))).alias("total"),
        F.max("indicator").alias("indicator"), F.max("error").alias("error"),
    )
    return sums.select("path", "stream_no", "blocks", "bytes", "total", indicated_size(F.col("indicator")).alias("max_block"), (F.col("error").isNull() & (F.coalesce("total", "bytes") == F.col("bytes"))).alias("ok"))


def index_entries(chunks: DataFrame) -> DataFrame:
    """path, compressed (the chunk's place), uncompressed (where its block starts) of every block that is not empty."""
    blocks = chunks.where(F.col("type").isin(*BLOCKS) & (F.col("size") > 0))
    return blocks.select("path", F.col("offset").alias("compressed"), F.col("start").alias("uncompressed"))


def index_totals(chunks: DataFrame) -> DataFrame:
    """path, total_uncompressed, total_compressed (null for padded streams), spacing (the first block's size)."""
    block = F.col("type").isin(*BLOCKS) & (F.col("size") > 0)
    padded = F.max((F.col("type") == PADDING).cast("int")) == 1
    return chunks.groupBy("path").agg(
        F.coalesce(F.sum(F.when(block, F.col("size"))), F.lit(0)).alias("total_uncompressed"), F.when(~padded, F.sum(F.col("length").cast("long") + 4)).alias("total_compressed"), F.min_by(F.when(block, F.col("size")), F.when(block, F.col("chunk_no"))).alias("spacing")
    )


def index_of(chunks: DataFrame) -> DataFrame:
    """path, compressed, uncompressed: the index of each path, entries at least the first block's size apart."""
    entries = store(index.build(index_entries(chunks), "path", "compressed", "uncompressed"))
    spaced = entries.join(index_totals(chunks).select(F.col("path").alias("_p"), "spacing"), F.col("path").eqNullSafe(F.col("_p"))).select("path", "compressed", "uncompressed", "spacing")
    kept = index.thin(spaced, "path", "uncompressed", F.col("spacing")).select(F.col("path").alias("_k"), F.col("uncompressed").alias("_u"))
    return entries.join(kept, F.col("path").eqNullSafe(F.col("_k")) & (F.col("uncompressed") == F.col("_u"))).select("path", "compressed", "uncompressed")


def seek(asked: DataFrame, totals: DataFrame) -> DataFrame:
    """asked (path, whence: start, current or end, delta, here) with target and error, by the rules of a seekable stream.

    end needs a known total; before the start and past a known total are errors.
    """
    known = totals.select(F.col("path").alias("_p"), F.col("total_uncompressed").alias("_t"))
    rows = asked.join(known, F.col("path").eqNullSafe(F.col("_p")), "left").drop("_p")
    target = F.when(F.col("whence") == "start", F.col("delta")).when(F.col("whence") == "current", F.col("here") + F.col("delta")).otherwise(F.col("_t") + F.col("delta"))
    error = F.when((F.col("whence") == "end") & F.col("_t").isNull(), "unsupported").when(F.col("target") < 0, "before start").when(F.col("target") > F.col("_t"), "past end")
    return rows.withColumn("target", target).withColumn("error", error).drop("_t")


def read_ranges(chunks: DataFrame, entries: DataFrame, asked: DataFrame, key: str, span: int = 1 << 16, verify: bool = True) -> DataFrame:
    """asked (key, path, first, last) with piece: bytes first to last (exclusive) of a path's decoded bytes, null if none.

    The index names the chunk to begin at. Requests and blocks meet in cells of a path, `span` bytes wide or, for longer
    requests, that doubled until a request fits: it lies in its cell and the next one. A cell's requests are dealt out in
    bunches by their key, and each bunch gets the blocks and index entries of the two cells, few beside what it reads. Pieces
    are cut there, a batch of requests at a time, and not moved again; only blocks that a bunch needs are checked.
    """
    length = F.col("last") - F.col("first")
    wide = F.when(length > 0, F.lit(span) * F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.least(length, F.lit(1 << 60)) / span)), F.lit(0))).cast("long"))
    rows = asked.select(F.col("path").alias("p"), F.col("first").cast("long").alias("a"), F.col("last").cast("long").alias("z"), wide.alias("w"), F.struct(*asked.columns).alias("row"))
    rows = rows.withColumn("c", F.floor(F.col("a") / F.col("w"))).withColumns({x: F.when(F.col("w").isNotNull(), F.col(x)) for x in ("a", "z")})
    count = F.ceil(F.greatest(F.count(F.lit(1)) / BUNCH_ROWS, F.sum((F.col("z") - F.col("a")).cast("double")) / F.greatest(F.lit(BUNCH_BYTES), 2 * F.col("w"))))
    cells = store(rows.where("w is not null").groupBy("p", "w", "c").agg(count.cast("int").alias("n")))
    # cells of several bunches are at most one to so many requests or bytes, so that sending them to all tasks is little
    hot = F.broadcast(cells.where("n > 1").select(*[F.col(x).alias(f"_{x}") for x in ("p", "w", "c", "n")]))
    rows = rows.join(hot, F.col("p").eqNullSafe(F.col("_p")) & (F.col("w") == F.col("_w")) & (F.col("c") == F.col("_c")), "left")
    rows = rows.withColumn("s", F.pmod(F.xxhash64(F.col("row")[key], "a", "z"), F.when(F.col("w").isNull(), 1024).otherwise(F.coalesce("_n", F.lit(1)))).cast("int"))

    begin = index.find(entries, cells.select(F.col("p").alias("path"), "w", "c", "n", (F.col("w") * F.col("c")).alias("a")), "path", "uncompressed", "a")
    bunches = store(begin.select(F.col("path").alias("p"), "w", "c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"), F.col("found").cast("long").alias("found"), F.floor(F.col("a") / span).alias("t")))
    stretch = lambda x: F.floor(x / span)
    stored = chunks.where(F.col("type").isin(*BLOCKS) & (F.col("size") > 0)).withColumn("end", F.col("start") + F.col("size"))
    ends = stored.groupBy(F.col("path").alias("_p")).agg(stretch(F.max("end") - 1).alias("_last"))  # requests may go on far behind it
    upto = F.least(F.col("t") + stretch(2 * F.col("w")) - 1, F.col("_last"))
    needs = bunches.join(ends, F.col("p").eqNullSafe(F.col("_p"))).where(upto >= F.greatest("t", F.lit(0))).withColumn("u", F.explode(F.sequence(F.greatest("t", F.lit(0)), upto))).drop("_p", "_last")
    marks = entries.select(F.col("path").alias("_p"), F.col("uncompressed").cast("long").alias("at"), stretch(F.col("uncompressed")).alias("_u"))
    blocks = stored.select(F.col("path").alias("_p"), F.col("chunk_no").alias("_n"), F.col("start").alias("at"), F.col("end").alias("z"))
    blocks = blocks.withColumn("_u", F.explode(F.sequence(stretch(F.col("at")), stretch(F.col("z") - 1))))
    met = F.col("p").eqNullSafe(F.col("_p")) & (F.col("u") == F.col("_u"))
    blocks = blocks.join(needs, met & (F.col("u") == F.greatest("t", stretch(F.col("at")))))  # a block and a bunch share several stretches
    # payloads come by chunk, as they lie, once it is known which are needed
    blocks = stored.select("path", "chunk_no", "payload").join(blocks.drop("u", "_u"), F.col("path").eqNullSafe(F.col("_p")) & (F.col("chunk_no") == F.col("_n")))
    spot, none = ["p", "w", "c", "s"], F.lit(None)
    want = le_value(F.expr("substring(payload, 1, 4)"), 4) if verify else none

    def part(df: DataFrame, kind: int, at: str, z: Column = none, want: Column = none, data: Column = none, row: Column = none) -> DataFrame:
        return df.select(*spot, F.lit(kind).alias("kind"), F.col(at).alias("at"), z.cast("long").alias("z"), want.cast("long").alias("want"), data.cast("binary").alias("data"), row.cast(rows.schema["row"].dataType).alias("row"))

    parts = part(bunches, _HEAD, "found").union(part(marks.join(needs, met), _MARK, "at")).union(part(blocks, _BLOCK, "at", F.col("z"), want, F.expr("substring(payload, 5)"))).union(part(rows, _ASKED, "a", F.col("z"), row=F.col("row")))
    dealt = parts.repartition(*spot).sortWithinPartitions(*spot, "kind", "at").drop(*spot)
    shape = T.StructType([T.StructField("row", asked.schema), T.StructField("piece", T.BinaryType())])
    return dealt.mapInArrow(_cut, shape).select("row.*", "piece")


def _cut(batches):
    """row, piece of the requests among rows that come bunch by bunch: its head, index entries, blocks, requests."""
    marks, blocks, held = [], [], None
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        at, z = (batch.column(c).fill_null(0).to_numpy() for c in ("at", "z"))
        edges = [0, *(np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _HEAD)) + 1).tolist(), len(kind)]
        found = []
        for i, j in zip(edges, edges[1:]):
            if i == j:
                continue
            if kind[i] == _HEAD:
                marks, blocks, held = [at[i : i + 1]], [], None
            elif kind[i] == _MARK:
                marks.append(at[i:j])
            elif kind[i] == _BLOCK:
                blocks += zip(at[i:j].tolist(), z[i:j].tolist(), batch.column("want").slice(i, j - i).to_pylist(), batch.column("data").slice(i, j - i).to_pylist(), strict=True)
            else:
                held = held or _held(marks, blocks)
                found += _pieces(held, at[i:j], z[i:j])
        rows = batch.column("row").filter(pa.array(kind == _ASKED))
        size = np.cumsum([last - first for _, first, last in found]) // PIECE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(found)]
        for i, j in zip(cuts, cuts[1:]):
            if i < j:
                pieces = pa.array([None if data is None else data[first:last] for data, first, last in found[i:j]], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.slice(i, j - i), pieces], ["row", "piece"])


def _held(marks: list[np.ndarray], blocks: list[tuple]) -> tuple:
    """Of a bunch: index entries, starts, ends, lengths and places of the blocks that pass their check, their bytes."""
    if any(want is not None for _, _, want, _ in blocks):
        crc = crc32c_many([data for *_, data in blocks]).astype(np.uint64)
        masked = (((crc >> np.uint64(15)) | (crc << np.uint64(17))) + np.uint64(0xA282EAD8)) & np.uint64(0xFFFFFFFF)
        blocks = [b for b, got in zip(blocks, masked.tolist(), strict=True) if b[2] == got]
    parts = [data[: end - start] for start, end, _, data in blocks]
    size = np.array([len(x) for x in parts], np.int64)
    start, end = (np.array([b[k] for b in blocks], np.int64) for k in (0, 1))
    return np.concatenate(marks or [np.zeros(1, np.int64)]), start, end, size, np.cumsum(size) - size, b"".join(parts)


def _pieces(held: tuple, first: np.ndarray, last: np.ndarray) -> list[tuple]:
    """(bytes, first, last) of what each request reads of the blocks held; (None, 0, 0) without any."""
    marks, start, end, size, place, data = held
    named = marks[np.maximum(np.searchsorted(marks, first, "right") - 1, 0)]
    lo = np.maximum(np.searchsorted(end, first, "right"), np.searchsorted(start, named))
    hi = np.searchsorted(start, last)
    some = np.flatnonzero((lo < hi) & (first < last))
    lo, hi, out = lo[some], hi[some] - 1, [(None, 0, 0)] * len(first)
    begin = place[lo] + np.clip(first[some] - start[lo], 0, size[lo])
    stop = place[hi] + np.minimum(last[some] - start[hi], size[hi])
    for k, i, j in zip(some.tolist(), begin.tolist(), stop.tolist(), strict=True):
        out[k] = (data, i, max(i, j))
    return out
