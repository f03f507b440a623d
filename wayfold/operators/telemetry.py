"""Operators on events in time: series, percentiles, rates, rankings, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arrived_once(events: DataFrame, key: str = "trace_id", received: str = "received_at") -> DataFrame:
    """Of repeated deliveries the first; pre-aggregated, so hot keys are no burden."""
    rest = [c for c in events.columns if c != key]
    first = events.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(received, F.xxhash64(*rest))).alias("r"))
    return first.select(key, "r.*")


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket of a timestamp."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds)


def series(events: DataFrame, ts: str, value: Column, seconds: int, how: str = "avg", by: list[str] | None = None) -> DataFrame:
    """Tumbling buckets; empty ones are left out."""
    agg = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[how]
    return events.groupBy(*(by or []), bucket(F.col(ts), seconds).alias("bucket")).agg(agg(value).alias("value"))


def ranked(events: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """Values at index floor(n * p / 100), at most the last, of the sorted values of each group.

    A value and its count make a row before anything is ordered.  Counts of bins, on a
    scale on which a group has some ten thousand at most, tell the bin of each wanted
    index; only the values of these bins are ordered, so that a large group, or all rows
    together, isn't one task.  Null keys form a group; an empty table has none.
    """
    keys, x = [f"_k{i}" for i in range(len(by))], F.col("_x")
    rows = events.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("_x"))
    scale = F.signum(x) * F.floor(F.log2(1 + F.abs(x)) * 256)
    counts = rows.groupBy(*keys, "_x").agg(F.count("*").alias("_c")).withColumn("_bin", scale.cast("int"))
    w = Window.partitionBy(*keys)
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_c"))
    bins = bins.withColumns({"_upto": F.sum("_c").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("_c").over(w)})
    bins = bins.withColumn("_before", F.col("_upto") - F.col("_c"))
    goals = F.array(*[F.struct(F.lit(p).alias("p"), F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1).alias("k")) for p in percents])
    goals = F.filter(goals, lambda g: (g["k"] < F.col("_upto")) & (g["k"] >= F.col("_before")))
    goals = bins.withColumn("_goals", goals).where("size(_goals) > 0").select(*[F.col(k).alias(f"g{k}") for k in keys], F.col("_bin").alias("_at"), "n", "_before", "_goals")
    same = F.col("_bin") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"g{k}"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    inside = counts.join(goals, same).select(*keys, "n", "_x", upto.alias("_upto"), "_goals")
    inside = inside.select(*keys, "n", "_x", "_upto", F.explode("_goals").alias("_g")).where("_upto > _g.k")
    at = [F.min(F.when(F.col("_g.p") == p, F.col("_x"))).alias(f"p{p}") for p in percents]
    return inside.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, by)]).agg(F.max("n").alias("n"), *at)


def latest_per(events: DataFrame, by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The last row of each group."""
    last = events.groupBy(*by).agg(F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("r"))
    return last.select(*by, *[F.col(f"r.{c}").alias(c) for c in keep])


def top_per(events: DataFrame, by: list[str], item: str, k: int) -> DataFrame:
    """The k most frequent items of each group; equal counts by name."""
    counts = events.groupBy(*by, item).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), F.col(item))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fixed_windows(events: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """Requests per key and window of a fixed length, with those beyond the limit."""
    n = events.groupBy(key, bucket(F.col(ts), seconds).alias("bucket")).agg(F.count("*").alias("requests"))
    return n.withColumn("rejected", F.greatest(F.col("requests") - most, F.lit(0)))


def fan_out(events: DataFrame) -> DataFrame:
    """Each query event as samples (metric, ts, value): volume, latency, hit or miss, error, one per agent."""
    one = F.lit(1.0)
    metrics = F.array(
        F.struct(F.lit("query_volume").alias("metric"), one.alias("value")),
        F.when(F.col("latency_ms") >= 0, F.struct(F.lit("latency").alias("metric"), F.col("latency_ms").cast("double").alias("value"))),
        F.when(F.col("cache_hit").isNotNull(), F.struct(F.when(F.col("cache_hit"), "cache_hit").otherwise("cache_miss").alias("metric"), one.alias("value"))),
        F.when(F.col("error").isNotNull(), F.struct(F.lit("error").alias("metric"), one.alias("value"))),
    )
    agents = F.transform(F.coalesce("agent_chain", F.array()), lambda a: F.struct(F.concat(F.lit("agent:"), a).alias("metric"), one.alias("value")))
    samples = F.filter(F.concat(metrics, agents), lambda x: x.isNotNull())
    return events.select("ts", F.explode(samples).alias("s")).select("s.metric", "ts", "s.value")


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int, part_seconds: int = 6 * 3600) -> DataFrame:
    """Sessions: an event at least the gap after the one before starts a new one.

    A key's events are worked on in parts of time, so that a key with many events
    isn't one task; what a part has to know of the ones before it, the time of their
    last event and their number of sessions, comes from one row a part.  Rows
    without key or time are left out.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    e = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key), t.alias("_t"), F.col(ts).alias("_ts"))
    e = e.withColumn("_part", F.floor(F.col("_t") / (part_seconds * 1_000_000)))
    parts = Window.partitionBy(key).orderBy("_part")
    last = e.groupBy(key, "_part").agg(F.max("_t").alias("_last")).withColumn("_before", F.lag("_last").over(parts)).drop("_last")
    local = Window.partitionBy(key, "_part").orderBy("_t")
    e = e.join(last, [key, "_part"])
    gap = F.col("_t") - F.coalesce(F.lag("_t").over(local), F.col("_before")) >= gap_seconds * 1_000_000
    e = e.withColumn("_fresh", F.coalesce(gap.cast("int"), F.lit(1)))
    e = e.withColumn("_no", F.sum("_fresh").over(local.rangeBetween(Window.unboundedPreceding, 0)))
    runs = e.groupBy(key, "_part", "_no").agg(F.count("*").alias("n"), F.min("_ts").alias("a"), F.max("_ts").alias("z"), F.sum("_fresh").alias("f"))
    sums = runs.groupBy(key, "_part").agg(F.sum("f").alias("f"))
    sums = sums.select(key, "_part", (F.sum("f").over(parts) - F.col("f")).alias("_so_far"))
    runs = runs.join(sums, [key, "_part"]).withColumn("session_no", F.col("_so_far") + F.col("_no"))
    return runs.groupBy(key, "session_no").agg(F.sum("n").alias("events"), F.min("a").alias("started"), F.max("z").alias("ended"))
