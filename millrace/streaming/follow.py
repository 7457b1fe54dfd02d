"""Growing sources: rows are taken as they arrive, and totals, histograms and index entries are kept up to date."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.sources.store import shared_dir


def follow(spark: SparkSession, path: str, files_per_batch: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """A stream of a growing folder's rows: every file once, as the checkpoint remembers."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(path)


def grown(spark: SparkSession, path: str, seen: DataFrame | None = None) -> DataFrame:
    """path, offset, data, end: what files hold beyond the bytes already read (seen: path, end), as a follower resumes.

    A file that is shorter than before is read from its beginning. Save (path, end) and pass it the next time.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    if seen is None:
        return files.select("path", F.lit(0).cast("long").alias("offset"), F.col("content").alias("data"), F.col("length").alias("end"))
    known = files.join(seen.select("path", F.col("end").alias("_e")), "path", "left")
    known = known.withColumn("offset", F.when(F.col("_e") <= F.col("length"), F.col("_e")).otherwise(0).cast("long")).where("length > offset")
    return known.select("path", "offset", F.expr("substring(content, cast(offset as int) + 1)").alias("data"), F.col("length").alias("end"))


def thin_stream(entries: DataFrame, stream: str, at: str, spacing: int) -> DataFrame:
    """Index thinning as rows arrive: the state of a stream is the last entry kept.

    An entry that lies before one kept in an earlier batch is given too, as `late`: an index refuses it.
    """

    def keep(key, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        kept, late = [], []
        for x in sorted(int(x) for b in batches for x in b[at]):
            if state.exists and x < state.get[0]:
                late.append(x)
            elif last is None or x - last >= spacing:
                kept.append(x)
                last = x
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({stream: [key[0]] * (len(kept) + len(late)), at: kept + late, "late": [False] * len(kept) + [True] * len(late)})

    kind = entries.schema[stream].dataType.simpleString()
    return entries.select(stream, at).groupBy(stream).applyInPandasWithState(keep, f"{stream} {kind}, {at} long, late boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def pack_stream(writes: DataFrame, stream: str, order: str, data: str, block_size: int) -> DataFrame:
    """path, block_no, block: full blocks of streams as rows are written to them, batch by batch.

    The state of a stream is what a writer buffers between writes: blocks so far and the bytes that fill no block yet. Rows of
    a batch are taken by `order`. The last, partial block stays in the state.
    """

    def pack(key, batches, state: GroupState):
        n, rest = state.get if state.exists else (0, b"")
        rows = pd.concat(list(batches)).sort_values(order)
        held = bytes(rest) + b"".join(bytes(x) for x in rows[data] if x is not None)
        full = len(held) // block_size
        cut = [held[i * block_size : (i + 1) * block_size] for i in range(full)]
        state.update((n + full, held[full * block_size :]))
        yield pd.DataFrame({"path": [key[0]] * full, "block_no": range(n, n + full), "block": cut})

    kind = writes.schema[stream].dataType.simpleString()
    return writes.select(stream, order, data).groupBy(stream).applyInPandasWithState(pack, f"path {kind}, block_no long, block binary", "blocks long, rest binary", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what there is by now and hand each batch to the sink."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()


def settled(stream: DataFrame, mode: str) -> DataFrame:
    """A stream's result once it has read what there is by now, written to a shared folder: the last batch of a complete one."""
    at = shared_dir(stream.sparkSession)
    drain(stream, mode, f"{at}/state", lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/rows"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


def event_totals(events: DataFrame) -> DataFrame:
    """Running totals by type, for complete or update mode."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.max("event_id").alias("last_event"))
