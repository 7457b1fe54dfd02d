"""Cutting byte columns into blocks, framing them as chunks, and reading ranges of them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.checksums import crc32c
from millrace.functions.numbers import chunk_header, le_bytes, mask_crc, padding, size_indicator, uvarint, uvarint_len

from .running import running_total

STORED, END, PADDING, IDENTIFIER = 0x01, 0x20, 0xFE, 0xFF  # fixed values: chunk types
MAGIC = "4D696E4C7A"  # fixed value: the identifier's letters


def split_blocks(df: DataFrame, data: str, block_size: int) -> DataFrame:
    """A row per block: block_no, block_offset, block. Empty data has no blocks; the last block may be short."""
    n = F.octet_length(data)
    numbers = F.when(n > 0, F.sequence(F.lit(0), F.ceil(n / block_size).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    rows = df.withColumn("block_no", F.explode(numbers)).withColumn("block_offset", F.col("block_no").cast("long") * block_size)
    return rows.withColumn("block", F.expr(f"substring({data}, cast(block_offset as int) + 1, {block_size})"))


def stored_chunks(df: DataFrame, key: str, data: str, block_size: int, pad: int = 1) -> DataFrame:
    """Streams of stored chunks: key, chunk_no, type, length, chunk (the bytes). Concatenated in order they are a stream.

    identifier, a chunk per block (masked CRC-32C and the bytes), the end with the total, and padding to a multiple.
    Empty data is the end alone. Rows are per block, so a large stream is many rows.
    """
    size = F.octet_length(data).cast("long")
    blocks = split_blocks(df.select(key, data), data, block_size)
    body = blocks.select(key, (F.col("block_no") + 1).alias("chunk_no"), F.lit(STORED).alias("type"), (F.octet_length("block") + 4).alias("length"), F.concat(le_bytes(mask_crc(crc32c(F.col("block"))), 4), F.col("block")).alias("payload"))
    head = df.where(size > 0).select(key, F.lit(0).alias("chunk_no"), F.lit(IDENTIFIER).alias("type"), F.lit(6).alias("length"), F.unhex(F.concat(F.lit(MAGIC), F.lpad(F.hex(size_indicator(F.lit(block_size))), 2, "0"))).alias("payload"))
    count = F.ceil(size / block_size).cast("int")
    end = df.where(size.isNotNull()).select(key, (count + 1).alias("chunk_no"), F.lit(END).alias("type"), uvarint_len(size).alias("length"), uvarint(size).alias("payload"))
    fill = padding(stream_size(size, block_size), pad)
    tail = df.where(fill > 0).select(key, (count + 2).alias("chunk_no"), F.lit(PADDING).alias("type"), (fill - 4).cast("int").alias("length"), F.unhex(F.repeat(F.lit("00"), (fill - 4).cast("int"))).alias("payload"))
    rows = head.union(body).union(end).union(tail)
    kinds = F.when(F.col("type") == STORED, chunk_header(STORED, F.col("length"))).when(F.col("type") == END, chunk_header(END, F.col("length"))).when(F.col("type") == PADDING, chunk_header(PADDING, F.col("length"))).otherwise(chunk_header(IDENTIFIER, F.col("length")))
    return rows.select(key, "chunk_no", "type", "length", F.concat(kinds, F.col("payload")).alias("chunk"))


def packed_blocks(writes: DataFrame, stream: str, order: str, data: str, block_size: int, flush: bool = False) -> DataFrame:
    """path, block_no, block: the blocks of streams that many rows are written to in order.

    Blocks are full but for the last, across rows; with flush every row begins a block of its own. A stream's rows need not
    meet: their places are running totals, and only the pieces of one block are joined.
    """
    rows = writes.select(F.col(stream).alias("path"), F.col(order).alias("_o"), F.coalesce(F.col(data), F.lit(b"")).alias("_d")).withColumn("_n", F.octet_length("_d").cast("long")).where("_n > 0")
    if flush:
        placed = running_total(rows, ["path"], "_o", F.ceil(F.col("_n") / block_size), "_first")
        return split_blocks(placed, "_d", block_size).select("path", (F.col("_first") + F.col("block_no")).alias("block_no"), "block")
    placed = running_total(rows, ["path"], "_o", F.col("_n"), "_at")
    spread = placed.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("_at") / block_size), F.floor((F.col("_at") + F.col("_n") - 1) / block_size))))
    skip = F.greatest(F.col("block_no") * block_size - F.col("_at"), F.lit(0))
    keep = F.least((F.col("block_no") + 1) * block_size, F.col("_at") + F.col("_n")) - F.col("_at") - skip
    spread = spread.withColumn("_skip", skip.cast("int")).withColumn("_keep", keep.cast("int"))
    part = F.struct("_at", F.expr("substring(_d, _skip + 1, _keep)").alias("x"))  # bytes move, not their digits
    return spread.groupBy("path", "block_no").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: F.hex(p["x"])), "")).alias("block"))


def framed(kind: int, payload: Column) -> Column:
    """A chunk's bytes."""
    return F.concat(chunk_header(kind, F.octet_length(payload)), payload)


def stream_chunks(blocks: DataFrame, block_size: int, pad: int = 1, user: DataFrame | None = None) -> DataFrame:
    """path, chunk_no, chunk of streams of stored blocks (path, block_no, block), with user chunks among them.

    user: path, block_no (the block that it comes before), id (128 to 253), payload; one per place. Numbers leave gaps.
    """
    body = blocks.select("path", (F.col("block_no") * 2 + 2).cast("long").alias("chunk_no"), framed(STORED, F.concat(le_bytes(mask_crc(crc32c(F.col("block"))), 4), F.col("block"))).alias("chunk"))
    totals = blocks.groupBy("path").agg(F.sum(F.octet_length("block").cast("long")).alias("total"), F.count(F.lit(1)).alias("n"), F.max("block_no").alias("last"))
    head = totals.select("path", F.lit(0).cast("long").alias("chunk_no"), framed(IDENTIFIER, F.unhex(F.concat(F.lit(MAGIC), F.lpad(F.hex(size_indicator(F.lit(block_size))), 2, "0")))).alias("chunk"))
    end = totals.select("path", (F.col("last") * 2 + 4).alias("chunk_no"), framed(END, uvarint(F.col("total"))).alias("chunk"))
    rows = head.union(body).union(end)
    if user is not None:
        extra = F.concat(F.unhex(F.hex(F.col("id"))), le_bytes(F.octet_length("payload"), 3), F.col("payload"))
        rows = rows.union(user.where(F.col("id").between(0x80, 0xFD)).select("path", (F.col("block_no") * 2 + 1).cast("long"), extra))
    if pad > 1:
        size = rows.groupBy("path").agg(F.sum(F.octet_length("chunk").cast("long")).alias("size"), F.max("chunk_no").alias("last"))
        fill = padding(F.col("size"), pad)
        rows = rows.union(size.where(fill > 0).select("path", F.col("last") + 1, framed(PADDING, F.unhex(F.repeat(F.lit("00"), (fill - 4).cast("int"))))))
    return rows


def stream_size(size: Column, block_size: int) -> Column:
    """Bytes of a stored stream before padding."""
    return (F.when(size > 0, 10 + size + 8 * F.ceil(size / block_size)).otherwise(0) + 4 + uvarint_len(size)).cast("long")


def offsets(df: DataFrame, stream: str, order: str, size: Column) -> DataFrame:
    """df with start and end: where each row's bytes lie when a stream's rows are concatenated in order."""
    return running_total(df, [stream], order, size, "start").withColumn("end", F.col("start") + size)


def read_range(df: DataFrame, data: str, first: int, last: int) -> DataFrame:
    """From rows with start and end, the pieces of bytes first to last (exclusive) of every stream: piece.

    Rows outside are dropped before their bytes are read; only the two at the edges are cut.
    """
    inside = df.where((F.col("end") > first) & (F.col("start") < last))
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    keep = F.least(F.col("end"), F.lit(last)) - F.col("start") - skip
    return inside.withColumn("_skip", skip.cast("int")).withColumn("_keep", keep.cast("int")).withColumn("piece", F.expr(f"substring({data}, _skip + 1, _keep)")).drop("_skip", "_keep")


def tail(df: DataFrame, data: str, n: int, align: bool = True) -> DataFrame:
    """The last n bytes of each row (`piece`); aligned: from behind the first line feed in them, or nothing without one.

    Data that is no longer than n is taken whole and, as it starts at its beginning, aligned like any other.
    """
    cut = df.withColumn("_n", F.octet_length(data)).withColumn("_tail", F.expr(f"substring({data}, greatest(_n - {n}, 0) + 1, {n})"))
    if not align:
        return cut.withColumnRenamed("_tail", "piece").drop("_n")
    # places of line feeds, by hex digits: bytes need not be text
    head = F.octet_length(F.regexp_extract(F.hex("_tail"), "^((?:..)*?0A)", 1)) / 2
    return cut.withColumn("_h", head.cast("int")).withColumn("piece", F.expr("case when _h = 0 then substring(_tail, 1, 0) else substring(_tail, _h + 1) end")).drop("_n", "_tail", "_h")


def ranges(total: Column, offset: Column, length: Column) -> tuple[Column, Column]:
    """(first, last) of offset and tail length, either of which may be null: clamped to what there is."""
    first = F.when(offset.isNotNull(), F.least(offset, total)).when(length.isNotNull(), F.greatest(total - length, F.lit(0))).otherwise(F.lit(0))
    return first, F.when(offset.isNotNull() & length.isNotNull(), F.least(total, offset + length)).otherwise(total)
