"""Structured Streaming twins of the telemetry and ingestion operators.

A stream is read from files as they land; each function takes a streaming
DataFrame, so any other source fits as well.  State is bounded by watermarks, and
what a run has done is in its checkpoint, so a restart goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfold.runtime import scratch


def files(spark: SparkSession, path: str, schema=None, fmt: str = "parquet", per_trigger: int | None = None, done: str | None = None) -> DataFrame:
    """A stream of the files landing in a folder (or of one file); with ``done`` finished ones are moved there."""
    schema = schema or spark.read.format(fmt).load(path).schema
    r = spark.readStream.format(fmt).schema(schema)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(where) and fs.getFileStatus(where).isFile():  # the source takes folders only
        r, path = r.option("pathGlobFilter", where.getName()), where.getParent().toString()
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    if done:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", done)
    return r.load(path)


def run_once(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, target: str | None = None) -> DataFrame:
    """Run a query over all that is there, into files of the shared folder, and read them.

    Every micro-batch is written under its own number, so that a batch done again
    replaces itself; in complete mode the last one counts.
    """
    spark = stream.sparkSession
    base = scratch(spark, "stream")
    target, checkpoint = target or f"{base}/out", checkpoint or f"{base}/state"

    def write(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(target if mode == "complete" else f"{target}/batch={no}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(target)
    return out.select(*stream.columns)


def bucket_counts(events: DataFrame, ts: str, window: str, late: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts per event-time window; closed windows come out once the watermark passes."""
    w = F.window("_ts", window, slide) if slide else F.window("_ts", window)
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return e.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), *by, "n")


def arrived_once(events: DataFrame, key: str, received: str, within: str) -> DataFrame:
    """Repeated deliveries within a time are dropped."""
    e = events.withColumn("_at", F.col(received).cast("timestamp")).withWatermark("_at", within)
    return e.dropDuplicatesWithinWatermark([key]).drop("_at")


def session_counts(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of events with no longer gap between them."""
    e = events.where(F.col(key).isNotNull()).withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return e.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), "n")


def limited(events: DataFrame, key: str, ts: str, most: int, seconds: int, late: str = "10 days") -> DataFrame:
    """Requests allowed per key: a window starts at its first request and lasts ``seconds``.

    Rows of a key are taken in order within a micro-batch, which ``maxFilesPerTrigger``
    bounds; only their times and ids are held.  The state of a key is the start of its
    window and the count in it; it expires when the watermark, ``late`` behind the
    newest event, passes the end of the window.  Rows without key or time are left out.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (-1, 0)
        rows = pd.concat([b[["t", "id"]] for b in batches]).sort_values(["t", "id"])
        allowed = []
        for t in rows["t"]:
            if start < 0 or t - start >= seconds * 1_000_000:
                start, n = int(t), 0
            n += 1
            allowed.append(n <= most)
        state.update((start, n))
        state.setTimeoutTimestamp(max(start // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"k": [k[0]] * len(rows), "id": rows["id"].to_numpy(), "allowed": allowed})

    e = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    e = e.select(F.col(key).cast("string").alias("k"), "_ts", F.unix_micros("_ts").alias("t"), F.col("trace_id").alias("id"))
    out = e.groupBy("k").applyInPandasWithState(step, "k string, id string, allowed boolean", "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnRenamed("k", key)


def session_memory(messages: DataFrame, key: str, ts: str, text: str, tie: str, keep: int = 20, idle_seconds: int = 3600, late: str = "10 days") -> DataFrame:
    """The last messages of each session, kept as state and given out with every batch.

    Messages are taken in the order of ``ts`` and ``tie``; those without text don't
    count.  The memory expires once the watermark is ``idle_seconds`` past the last
    message.  Of a batch no more than the last ``keep`` messages of a session are held.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        for b in batches:
            b = b[b["x"].notna()].sort_values(["t", "i"]).tail(keep)
            held = sorted([*held, *zip(b["t"].tolist(), b["i"].tolist(), b["x"].tolist())], key=lambda m: m[:2])[-keep:]
        if not held:
            yield pd.DataFrame({"k": [k[0]], "held": [[]]})
            return
        state.update(tuple(map(list, zip(*held))))
        state.setTimeoutTimestamp(max(held[-1][0] // 1000 + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"k": [k[0]], "held": [[x for _, _, x in held]]})

    e = messages.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    e = e.select(F.col(key).cast("string").alias("k"), "_ts", F.unix_micros("_ts").alias("t"), F.coalesce(F.col(tie).cast("string"), F.lit("")).alias("i"), F.col(text).alias("x"))
    out = e.groupBy("k").applyInPandasWithState(step, "k string, held array<string>", "t array<long>, i array<string>, x array<string>", "update", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnRenamed("k", key)


def upsert_into(target: str, key: str, order: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the latest row per key, by ``order``, replaces what the table has.

    The table is kept in buckets of the key's hash; a batch writes new versions of the
    buckets it touches, beside the old ones, and leaves the others alone.  A batch that
    is done again gives the same table.  A later batch wins only with a later row.
    """

    def write(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        at = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_b")
        new = batch.select("*", at)
        touched = [r[0] for r in new.select("_b").distinct().collect()]  # at most one for each bucket
        old = [p for b, p in versions(spark, target, before=no).items() if b in touched]
        both = new
        if old:
            both = spark.read.schema(batch.schema).parquet(*old).select("*", at).unionByName(new)
        rest = [c for c in batch.columns if c != key]
        last = both.groupBy("_b", key).agg(F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest))).alias("r")).select("_b", key, "r.*")
        last.repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(f"{target}/v={no}")

    return write


def versions(spark: SparkSession, target: str, before: int | None = None) -> dict[int, str]:
    """The folder of the newest version of every bucket of a table written by ``upsert_into``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda folder, mark: [n for n in (x.getPath().getName() for x in fs.listStatus(path(folder))) if n.startswith(mark)]
    found: dict[int, str] = {}
    for v in sorted(int(n[2:]) for n in names(target, "v=")) if fs.exists(path(target)) else ():
        if (before is None or v < before) and fs.exists(path(f"{target}/v={v}/_SUCCESS")):
            found |= {int(n[3:]): f"{target}/v={v}/{n}" for n in names(f"{target}/v={v}", "_b=")}
    return found


def upserted(spark: SparkSession, target: str, schema) -> DataFrame:
    """The table written by ``upsert_into``; of no batches an empty one."""
    folders = list(versions(spark, target).values())
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
