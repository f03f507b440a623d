"""Streaming queries run over all data there is; each has the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.runtime import scratch
from wayfold.streaming import streams as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return S.files(spark, f"{d}/query_events.parquet")


_HOUR = "strftime(to_timestamp(floor(epoch(ts) / 3600) * 3600) at time zone 'UTC', '%Y-%m-%d %H:%M:%S')"


@query(f"select {_HOUR} as bucket, cache_hit, count(*)::bigint as n from query_events group by 1, 2")
def stream_hourly(spark, d):
    """Event-time windows in complete mode: late rows are all counted."""
    out = S.run_once(S.bucket_counts(_events(spark, d), "ts", "1 hour", "10 minutes", ["cache_hit"]), "complete")
    return out.select(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "cache_hit", "n")


@query("select count(*)::bigint as events, count(distinct trace_id)::bigint as traces from (select distinct trace_id from query_events)")
def stream_dedupe(spark, d):
    out = S.run_once(S.arrived_once(_events(spark, d).select("trace_id", "received_at"), "trace_id", "received_at", "30 days"))
    return out.agg(F.count("*").alias("events"), F.count_distinct("trace_id").alias("traces"))


@query(
    """with recursive e as (select session_id, epoch_us(ts) as t from query_events where session_id is not null and ts is not null),
n as (select session_id, t, count(*) as c, sum(count(*)) over (partition by session_id order by t) as upto from e group by 1, 2),
nxt as (select a.session_id, a.t, b.t as nt, coalesce(b.upto - b.c, max(a.upto) over (partition by a.session_id)) - (a.upto - a.c) as requests
  from n a asof left join n b on a.session_id = b.session_id and a.t + 60000000 <= b.t),
w as (select session_id, min(t) as t from n group by 1 union all select w.session_id, x.nt from w join nxt x on x.session_id = w.session_id and x.t = w.t where x.nt is not null)
select w.session_id, sum(requests)::bigint as requests, sum(least(requests, 5))::bigint as allowed from w join nxt x on x.session_id = w.session_id and x.t = w.t group by 1"""
)
def stream_rate_limit(spark, d):
    """Each request allowed or not by keyed state: five in a minute from the first one."""
    out = S.run_once(S.limited(_events(spark, d), "session_id", "ts", 5, 60))
    return out.groupBy("session_id").agg(F.count("*").alias("requests"), F.count_if("allowed").alias("allowed"))


@query(
    """select session_id, coalesce(string_agg(query_text, ' | ' order by ts, trace_id) filter (r <= 20), '') as held from (
select *, row_number() over (partition by session_id, query_text is null order by ts desc, trace_id desc) + case when query_text is null then 99 else 0 end as r from query_events where session_id is not null and ts is not null) group by 1"""
)
def stream_session_memory(spark, d):
    """The last twenty messages of every session."""
    out = S.run_once(S.session_memory(_events(spark, d), "session_id", "ts", "query_text", "trace_id"), "update")
    return out.select("session_id", F.array_join("held", " | ").alias("held"))


@query(
    """select session_id, count(*)::bigint as sessions, sum(n)::bigint as events from (select session_id, no, count(*) n from (select session_id, sum(f) over (partition by session_id order by ts range between unbounded preceding and current row) no from
(select session_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by session_id order by ts) < 1800000000 then 0 else 1 end f from query_events where session_id is not null)) group by 1, 2) group by 1"""
)
def stream_sessions(spark, d):
    """Session windows in complete mode."""
    out = S.run_once(S.session_counts(_events(spark, d), "session_id", "ts", "30 minutes", "10 minutes"), "complete")
    return out.groupBy("session_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("select input_address, result_status, audit_id from (select *, row_number() over (partition by input_address order by received_at desc, audit_id desc, result_status desc nulls last) r from validation_audit where received_at is not null and input_address is not null) where r = 1")
def stream_upsert(spark, d):
    """Micro-batches upserted into a table: of the entries of an address the last received stays."""
    base = scratch(spark, "upsert")
    stream = S.files(spark, f"{d}/validation_audit.parquet").where("received_at is not null and input_address is not null")
    stream = stream.select("input_address", "received_at", "audit_id", "result_status")
    sink = S.upsert_into(f"{base}/table", "input_address", ["received_at", "audit_id", "result_status"])
    stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return S.upserted(spark, f"{base}/table", stream.schema).select("input_address", "result_status", "audit_id")
