"""Queries on telemetry, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.operators import telemetry as M
from wayfold.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query on one table."""

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(table(spark, d, name))

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


def text(ts: str):
    return F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias(ts)


_B = "strftime(to_timestamp(floor(epoch(ts) / {0}) * {0}) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as bucket"


@query("query_events", f"select {_B.format(3600)}, round(avg(latency_ms), 6)::double as value from query_events where latency_ms >= 0 group by 1")
def ts_bucket_avg(e):
    return M.series(e.where("latency_ms >= 0"), "ts", F.col("latency_ms"), 3600).select(text("bucket"), F.round("value", 6).alias("value"))


@query("query_events", f"select {_B.format(300)}, count(*)::bigint as volume, max(latency_ms) as slowest, min(latency_ms) as fastest, sum(latency_ms)::bigint as total from query_events where latency_ms >= 0 group by 1")
def ts_bucket_many(e):
    e = e.where("latency_ms >= 0").groupBy(M.bucket(F.col("ts"), 300).alias("bucket"))
    n = e.agg(F.count("*").alias("volume"), F.max("latency_ms").alias("slowest"), F.min("latency_ms").alias("fastest"), F.sum("latency_ms").alias("total"))
    return n.select(text("bucket"), "volume", "slowest", "fastest", "total")


@query(
    "query_events",
    """select count(*)::bigint as n, round(avg(latency_ms) filter (latency_ms >= 0), 4)::double as avg_latency,
(select v from (select latency_ms v, row_number() over (order by latency_ms) - 1 r, count(*) over () c from query_events where latency_ms >= 0) where r = least(floor(c * 0.5), c - 1)) as p50,
(select v from (select latency_ms v, row_number() over (order by latency_ms) - 1 r, count(*) over () c from query_events where latency_ms >= 0) where r = least((c * 95) // 100, c - 1)) as p95,
(select v from (select latency_ms v, row_number() over (order by latency_ms) - 1 r, count(*) over () c from query_events where latency_ms >= 0) where r = least((c * 99) // 100, c - 1)) as p99,
round(100.0 * count(*) filter (cache_hit) / count(cache_hit), 4)::double as hit_rate_percent, count(error)::bigint as errors from query_events""",
)
def query_stats_percentiles(e):
    p = M.ranked(e.where("latency_ms >= 0"), [], "latency_ms", [50, 95, 99])
    s = e.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))), 4).alias("avg_latency"),
        F.round(100 * F.count_if("cache_hit") / F.count("cache_hit"), 4).alias("hit_rate_percent"),
        F.count("error").alias("errors"),
    )
    return s.select("*", *[p.select(c).scalar().alias(c) for c in ("p50", "p95", "p99")])


@query(
    "query_events",
    """select strftime(ts, '%Y-%m-%d') as day, n::bigint as n, max(v) filter (r = least(n * 50 // 100, n - 1)) as p50, max(v) filter (r = least(n * 95 // 100, n - 1)) as p95
from (select ts::date as ts, latency_ms v, row_number() over (partition by ts::date order by latency_ms) - 1 r, count(*) over (partition by ts::date) n from query_events where latency_ms is not null) group by 1, 2""",
)
def percentiles_per_day(e):
    return M.ranked(e.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day"], "latency_ms", [50, 95])


@query("query_events", "select agent, count(*)::bigint as n, round(avg(latency_ms), 4)::double as avg_latency, min(latency_ms) as fastest, max(latency_ms) as slowest from (select unnest(agent_chain) agent, latency_ms from query_events where latency_ms >= 0) group by 1")
def agent_stats(e):
    a = e.where("latency_ms >= 0").select(F.explode("agent_chain").alias("agent"), "latency_ms")
    return a.groupBy("agent").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"), F.min("latency_ms").alias("fastest"), F.max("latency_ms").alias("slowest"))


@query("query_events", "select strftime(ts, '%Y-%m-%d') as day, round(count(*) filter (cache_hit)::double / nullif(count(cache_hit), 0), 6) as hit_rate from query_events group by 1")
def hit_rate(e):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return e.groupBy(day).agg(F.round(F.count_if("cache_hit") / F.nullif(F.count("cache_hit"), F.lit(0)), 6).alias("hit_rate"))


@query("query_events", "select strftime(ts, '%Y-%m-%d') as day, round(count(*) filter (latency_ms < 3000)::double / count(*), 6) as within from query_events where latency_ms >= 0 group by 1")
def sla_compliance(e):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return e.where("latency_ms >= 0").groupBy(day).agg(F.round(F.count_if(F.col("latency_ms") < 3000) / F.count("*"), 6).alias("within"))


@query(
    "query_events",
    "select day, query, n::bigint as n, r::int as rank from (select *, row_number() over (partition by day order by n desc, query) r from (select strftime(ts, '%Y-%m-%d') as day, lower(trim(query_text)) as query, count(*) n from query_events where query_text is not null group by 1, 2)) where r <= 5",
)
def trending_daily(e):
    e = e.where("query_text is not null").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lower(F.trim("query_text")).alias("query"))
    return M.top_per(e, ["day"], "query", 5)


@query("query_events", "select strftime(ts, '%Y-%m-%d') as day, count(distinct session_id)::bigint as sessions from query_events group by 1")
def unique_sessions(e):
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_distinct("session_id").alias("sessions"))


@query("query_events")
def unique_sessions_sketch(e):
    """HyperLogLog sketches per day, merged to one estimate for all days beside the exact number."""
    s = e.where("session_id is not null").groupBy(F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("session_id").alias("s"))
    exact = e.agg(F.count_distinct("session_id"))
    return s.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("estimate"), F.count("*").alias("days")).withColumn("exact", exact.scalar())


@query("query_events", "select lower(trim(query_text)) as query, count(*)::bigint as n from query_events where query_text is not null group by 1")
def query_frequency(e):
    return e.where("query_text is not null").groupBy(F.lower(F.trim("query_text")).alias("query")).agg(F.count("*").alias("n"))


@query("query_events")
def query_frequency_sketch(e):
    """Top queries by a bounded heavy-hitter sketch."""
    q = e.where("query_text is not null").select(F.lower(F.trim("query_text")).alias("q"))
    q.createOrReplaceTempView("_queries_seen")
    top = e.sparkSession.sql("select explode(approx_top_k(q, 10, 5000)) as t from _queries_seen")
    return top.select(F.col("t.item").alias("query"), F.col("t.count").alias("n"))


@query("query_events", f"select session_id, {_B.format(60)}, count(*)::bigint as requests, greatest(count(*) - 5, 0)::bigint as rejected from query_events where session_id is not null group by 1, 2")
def rate_limit_window(e):
    return M.fixed_windows(e.where("session_id is not null"), "session_id", "ts", 60, 5).select("session_id", text("bucket"), "requests", "rejected")


@query("query_events", "select session_id, trace_id, query_text from (select *, row_number() over (partition by session_id order by ts desc, trace_id desc) r from query_events where session_id is not null) where r = 1")
def latest_per_session(e):
    last = M.latest_per(e.where("session_id is not null"), ["session_id"], ["ts", "trace_id"], ["ts", "trace_id", "query_text"])
    return last.select("session_id", "trace_id", "query_text")


@query("query_events", "select count(*)::bigint as events, count(distinct session_id)::bigint as sessions from (select *, row_number() over (partition by trace_id order by received_at) r from query_events) where r = 1")
def dedupe_arrivals(e):
    return M.arrived_once(e).agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"))


@query(
    "query_events",
    """select metric, count(*)::bigint as samples, sum(value)::double as total from (
select 'query_volume' as metric, 1.0 as value from query_events union all
select 'latency', latency_ms from query_events where latency_ms >= 0 union all
select case when cache_hit then 'cache_hit' else 'cache_miss' end, 1.0 from query_events where cache_hit is not null union all
select 'error', 1.0 from query_events where error is not null union all
select 'agent:' || a, 1.0 from (select unnest(agent_chain) a from query_events)) group by 1""",
)
def metric_fan_out(e):
    return M.fan_out(e).groupBy("metric").agg(F.count("*").alias("samples"), F.sum("value").alias("total"))


@query(
    "query_events",
    """select session_id, no::bigint as session_no, count(*)::bigint as events from (select session_id, sum(f) over (partition by session_id order by ts range between unbounded preceding and current row) no from
(select session_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by session_id order by ts) < 1800000000 then 0 else 1 end f from query_events where session_id is not null)) group by 1, 2""",
)
def session_windows(e):
    return M.sessions(e, "session_id", "ts", 1800).select("session_id", "session_no", "events")


@query("query_events", "select session_id, count(*)::bigint as queries, round(avg(cache_hit::int), 6)::double as hit_rate, sum(latency_ms) filter (latency_ms >= 0)::bigint as latency, count(distinct agent_chain[1])::bigint as entry_agents from query_events where session_id is not null group by 1")
def session_analytics(e):
    return (
        e.where("session_id is not null")
        .groupBy("session_id")
        .agg(
            F.count("*").alias("queries"),
            F.round(F.avg(F.col("cache_hit").cast("int")), 6).alias("hit_rate"),
            F.sum(F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))).alias("latency"),
            F.count_distinct(F.try_element_at("agent_chain", F.lit(1))).alias("entry_agents"),
        )
    )


@query("query_events", "select trace_id, query_text, error from (select * from (select * from query_events order by ts desc, trace_id desc, received_at desc limit 2000) where error is not null) order by ts desc, trace_id desc, received_at desc limit 100")
def recent_errors(e):
    """Bounded look-back: the newest rows first, the filter after, then the limit."""
    order = [F.desc("ts"), F.desc("trace_id"), F.desc("received_at")]
    return e.orderBy(*order).limit(2000).where("error is not null").orderBy(*order).limit(100).select("trace_id", "query_text", "error")


@query("query_events", "select trace_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, query_text from query_events where ts between timestamp '2025-04-01' and timestamp '2025-04-03' order by query_events.ts, trace_id, received_at limit 50")
def read_range(e):
    e = e.where("ts between timestamp_ntz'2025-04-01' and timestamp_ntz'2025-04-03'").orderBy("ts", "trace_id", "received_at").limit(50)
    return e.select("trace_id", text("ts"), "query_text")


@query("query_events", "select trace_id from (select trace_id, row_number() over (order by ts desc, trace_id desc, received_at desc) r from query_events) where r <= 1000")
def trim_stream(e):
    """The newest thousand: a top-k, not a global window."""
    return e.orderBy(F.desc("ts"), F.desc("trace_id"), F.desc("received_at")).limit(1000).select("trace_id")


@query("query_events", "select words, count(*)::bigint as n, round(avg(success::int), 6)::double as success_rate from (select array_to_string(string_split_regex(lower(trim(query_text)), '\\s+')[1:3], ' ') as words, success from query_events where query_text is not null) group by 1 having count(*) >= 3 and avg(success::int) < 0.995")
def problem_patterns(e):
    w = F.array_join(F.slice(F.split(F.lower(F.trim("query_text")), r"\s+"), 1, 3), " ").alias("words")
    n = e.where("query_text is not null").groupBy(w).agg(F.count("*").alias("n"), F.avg(F.col("success").cast("int")).alias("rate"))
    return n.where("n >= 3 and rate < 0.995").select("words", "n", F.round("rate", 6).alias("success_rate"))


@query("query_events", "select session_id, lower(trim(query_text)) as query, count(*)::bigint as failures from query_events where not success and session_id is not null group by 1, 2")
def failures_per_query(e):
    return e.where("not success and session_id is not null").groupBy("session_id", F.lower(F.trim("query_text")).alias("query")).agg(F.count("*").alias("failures"))


@query("validation_audit", "select result_status, count(*)::bigint as n, round(avg(confidence), 4)::double as avg_confidence, sum(corrections_count)::bigint as corrections, round(avg(is_valid::int), 6)::double as valid_rate from validation_audit group by 1")
def audit_summary(a):
    return a.groupBy("result_status").agg(
        F.count("*").alias("n"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.sum("corrections_count").alias("corrections"),
        F.round(F.avg(F.col("is_valid").cast("int")), 6).alias("valid_rate"),
    )


@query("validation_audit", "select coalesce(lower(trim(source)), 'unknown') as source, count(*) filter (result_status = 'verified')::bigint as verified, count(*) filter (result_status = 'corrected')::bigint as corrected, count(*) filter (result_status = 'unverified')::bigint as unverified from validation_audit group by 1")
def audit_pivot(a):
    src = F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("source")
    return a.groupBy(src).pivot("result_status", ["verified", "corrected", "unverified"]).agg(F.count(F.lit(1))).fillna(0)


@query("validation_audit", "select strftime(ts, '%Y-%m-%d') as day, count(*)::bigint as n, sum(count(*)) over (order by strftime(ts, '%Y-%m-%d'))::bigint as so_far, round(avg(count(*)) over (order by strftime(ts, '%Y-%m-%d') rows 6 preceding), 4)::double as week_avg from validation_audit group by 1")
def audit_running(a):
    n = a.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day")  # one row a day
    return n.withColumns({"so_far": F.sum("n").over(w), "week_avg": F.round(F.avg("n").over(w.rowsBetween(-6, 0)), 4)})


@query("validation_audit", "select strftime(ts, '%Y-%m-%d') as day, result_status, count(*)::bigint as n from validation_audit where received_at - ts > interval 1 day group by 1, 2")
def late_arrivals(a):
    late = F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > 86_400_000_000
    return a.where(late).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "result_status").agg(F.count("*").alias("n"))


@query("events", f"select {_B.format(3600)}, event_type, count(*)::bigint as n, round(sum(value), 4)::double as value from events group by 1, 2")
def events_hourly(e):
    return e.groupBy(M.bucket(F.col("ts"), 3600).alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(text("bucket"), "event_type", "n", "value")


@query("events", "select json_extract_string(props, '$.k')::int as k, count(*)::bigint as n from events group by 1")
def json_path_ops(e):
    return e.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("events", "select user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r from events) where r = 1")
def dedupe_last(e):
    return M.latest_per(e, ["user_id", "event_type"], ["ts", "event_id"], ["ts", "event_id", "value"]).select("user_id", "event_type", "value")


@query("events", "select a.user_id, count(*)::bigint as n from (select distinct user_id from events where event_type = 'signup') a join events b on a.user_id = b.user_id and b.event_type = 'purchase' group by 1")
def signup_purchases(e):
    """Semi join before the aggregation."""
    return e.where("event_type = 'purchase'").join(e.where("event_type = 'signup'").select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))
