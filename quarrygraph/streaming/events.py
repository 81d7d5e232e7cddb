"""The file-event stream: last operation per path in a batch, snapshot upserts, late references, counters.

A batch job builds the first snapshot; the stream then starts from it, which replaces a barrier between
the two. Rate limits and batch sizes are the source's options, and durability is the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import relational as R
from ..schema import FILE_EVENTS
from ..sources import store

FILES_PER_BATCH = 128
DEBOUNCE = "150 milliseconds"


def file_events(spark: SparkSession, folder: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The stream of events (seq, op, path, text) that arrive as JSON files."""
    return spark.readStream.schema(FILE_EVENTS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def last_operations(batch: DataFrame) -> DataFrame:
    """The last event of each path: a later touch cancels a removal and the other way round."""
    return R.keep_last(batch, ["path"], ["seq"])


def maintain(events: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the snapshots under `folder` current: each batch with events writes the generation after its predecessor's.

    A generation holds what the batch changed, so a batch costs what it touches. A batch that is replayed
    writes its own generation again from the one before, so nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = last_operations(batch).select(F.xxhash64("path").alias("fid"), "path", "op", F.coalesce("text", F.lit("")).alias("text")).persist()
        try:
            store.write_delta(store.build(last.where("op = 'touched'").select("fid", "path", "text")), last.select("fid"), folder, number + 1)
        finally:
            last.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": DEBOUNCE})).start()


def late_references(stream: DataFrame, ttl: str | None = "7 days") -> DataFrame:
    """(name, fid, start, resolved): references of a stream of `def` and `ref` records, resolved when the name is defined.

    References to a name that is not defined yet wait in its state, for `ttl` after its last record at
    most; a name stays known as long. Without a ttl state stays for good, which a run over
    what is available now needs, as timeouts would keep it going.
    """
    millis = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else 0

    def resolve(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, fids, starts = state.get if state.exists else (False, [], [])
        fids, starts = list(fids), list(starts)
        for f in frames:
            known = bool(known or (f["record"] == "def").any())
            refs = f[f["record"] == "ref"]
            fids += refs["fid"].tolist()
            starts += refs["start"].tolist()
        out = pd.DataFrame({"name": [key[0]] * len(fids), "fid": fids, "start": starts})
        state.update((known, [] if known else fids, [] if known else starts))
        if millis:
            state.setTimeoutDuration(millis)
        if known and len(out):
            yield out

    return stream.groupBy("name").applyInPandasWithState(
        resolve, "name STRING, fid BIGINT, start INT", "known BOOLEAN, fids ARRAY<BIGINT>, starts ARRAY<INT>", "append", GroupStateTimeout.ProcessingTimeTimeout if millis else GroupStateTimeout.NoTimeout)


def rolling_counters(calls: DataFrame) -> DataFrame:
    """Streaming calls of each method, for complete or update mode."""
    return calls.groupBy("method").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def rolling_histogram(calls: DataFrame) -> DataFrame:
    """Streaming log2 histogram of each method."""
    from ..functions.stats import log2_bucket

    return calls.groupBy("method", log2_bucket(F.col("micros")).alias("bucket")).agg(F.count("*").alias("n"))


def reconcile(tables: dict[str, DataFrame], disk: DataFrame) -> dict[str, DataFrame]:
    """The snapshot after a comparison with the files on disk (fid, path, text), for when events were lost."""
    d = R.reconcile(tables["files"].select("path", "content_hash"), disk.select("path", F.sha2("text", 256).alias("content_hash")))
    gone = tables["files"].join(d.where("op = 'removed'"), "path", "left_semi").select("fid")
    return store.upsert(tables, disk.join(d.where("op = 'touched'"), "path", "left_semi").select("fid", "path", "text"), gone)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Extension: event-time sessions with a watermark."""
    return events.withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


