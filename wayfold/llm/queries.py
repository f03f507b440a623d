"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.bpe import encode_ids
from wayfold.llm.mixing import copies, mix
from wayfold.llm.percentiles import combine, percentiles, summaries
from wayfold.llm.places import map_places
from wayfold.llm.quality import statistics, text_types
from wayfold.llm.same_address import all_records, locations, same_address_pairs
from wayfold.llm.splitting import split_documents
from wayfold.runtime import table


def _addresses(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("test_addresses_validation", "test_addresses_fuzzy", "city_ref")]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return same_address_pairs(*_addresses(spark, d))


def p5_locations(spark: SparkSession, d: str) -> DataFrame:
    """Each record with its location; the compact form of the same result."""
    v, f, r = _addresses(spark, d)
    return locations(all_records(v, f), r)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_ids(table(spark, d, "documents"))


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix itself: every document as often as it is used."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return copies(docs.where("text <> ''"), p7_uses(spark, d)).select("doc_id", "source", F.length("text").alias("chars"))


def _latency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_events").select(F.to_date("ts").alias("day"), "cache_hit", "latency_ms")


def _processing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "validation_audit").select(F.to_date("ts").alias("day"), "source", "processing_time_ms")


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """All groupings of both tables; exact, so the error in rank is 0."""
    latency = percentiles(
        _latency(spark, d),
        {"latency_by_day": ["day"], "latency_by_cache_hit": ["cache_hit"], "latency_overall": []},
        "latency_ms",
        F.col("latency_ms") >= 0,
    )
    time = percentiles(
        _processing(spark, d),
        {"processing_by_source": ["source"], "processing_by_day_and_source": ["day", "source"]},
        "processing_time_ms",
        F.col("processing_time_ms") >= 0,
    )
    columns = ["grouping", "day", "cache_hit", "source", "n", "p50", "p90", "p95", "p99"]
    return latency.unionByName(time, allowMissingColumns=True).select(*columns)


def p1_kept_per_day(spark: SparkSession, d: str) -> DataFrame:
    """Summaries per day and source to keep."""
    return summaries(_processing(spark, d), ["day", "source"], "processing_time_ms", keep=F.col("processing_time_ms") >= 0)


def p1_latency_kept(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of the latency per day and hit flag to keep."""
    return summaries(_latency(spark, d), ["day", "cache_hit"], "latency_ms", keep=F.col("latency_ms") >= 0)


def p1_month_from_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per month and source combined from what is kept per day."""
    return combine(p1_kept_per_day(spark, d).withColumn("month", F.substring("day", 1, 7)), ["month", "source"])


def p2_places(spark: SparkSession, d: str) -> DataFrame:
    return map_places(table(spark, d, "test_addresses_validation"), table(spark, d, "city_ref"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per case; of repeated deliveries that differ the greater entry id counts."""
    return p2_places(spark, d).where("not fits").groupBy("id").agg(F.max("city_ref_id").alias("city_ref_id"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(table(spark, d, "documents"), table(spark, d, "split_limits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).where("piece_no = 0").select("doc_id", "boundary")


def p8_quality(spark: SparkSession, d: str) -> DataFrame:
    return text_types(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_quality(spark, d).where("kind <> 'prose'").select("doc_id", "kind")


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = statistics(table(spark, d, "documents"), table(spark, d, "common_words")).drop("votes")
    return s.withColumns({c: F.round(c, 6) for c in ("mean_word_length", "symbol_ratio", "line_end_share", "common_share")})


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_kept_per_day, p1_latency_kept, p1_month_from_days, p2_found, p2_places, p3_found, p3_pieces, p5_found, p5_locations, p6_ids, p7_uses, p7_shares, p7_mix, p8_found, p8_quality, p8_statistics)}
_P1 = """
select '{name}' as grouping, {day} as day, {hit} as cache_hit, {source} as source, n::bigint as n,
  max(case when r = (n * 50 + 99) // 100 then v end)::double as p50,
  max(case when r = (n * 90 + 99) // 100 then v end)::double as p90,
  max(case when r = (n * 95 + 99) // 100 then v end)::double as p95,
  max(case when r = (n * 99 + 99) // 100 then v end)::double as p99
from (select *, row_number() over (partition by {by} order by v) r, count(*) over (partition by {by}) n from {of})
group by {by}, n"""


def _p1(name: str, of: str, **cols: str) -> str:
    keys = ", ".join(cols.values()) or "one"
    shown = {c: f"{cols[c]}::varchar" if c in cols else "null::varchar" for c in ("day", "hit", "source")}
    return _P1.format(name=name, of=of, by=keys, **shown)


_KEPT = """
select {keys}, n::bigint as n, list(r order by r) as ranks, list(v::double order by r) as points from (
  select *, row_number() over (partition by {by} order by v) r, count(*) over (partition by {by}) n from {of}) where r = 1 or r = n or r * 200 // n > (r - 1) * 200 // n group by {by}, n"""


SQL: dict[str, str] = {
    "p1_kept_per_day": _KEPT.format(keys="day::varchar as day, source", by="day, source", of="(select ts::date as day, source, processing_time_ms v from validation_audit where processing_time_ms >= 0)"),
    "p1_latency_kept": _KEPT.format(keys="day::varchar as day, cache_hit::varchar as cache_hit", by="day, cache_hit", of="(select ts::date as day, cache_hit, latency_ms v from query_events where latency_ms >= 0)"),
    "p1_percentiles": """
with l as (select ts::date as day, cache_hit, latency_ms v from query_events where latency_ms >= 0),
t as (select ts::date as day, source, processing_time_ms v from validation_audit where processing_time_ms >= 0)
"""
    + " union all ".join(
        [
            _p1("latency_by_day", "l", day="day"),
            _p1("latency_by_cache_hit", "l", hit="cache_hit"),
            _p1("latency_overall", "(select *, 0 as one from l)"),
            _p1("processing_by_source", "t", source="source"),
            _p1("processing_by_day_and_source", "t", day="day", source="source"),
        ]
    ),
    "p3_found": r"""
with d as (
  select doc_id, text, coalesce(l.max_chars, f.max_chars) m
  from documents left join split_limits l using (content_type)
  left join split_limits f on f.content_type = 'default'
), o as (select * from d where length(text) > m),
x as (
  select doc_id, m, [
    regexp_split_to_array(text, '(\r\n|\n)([ \t]*(\r\n|\n))+[ \t]*'),
    regexp_split_to_array(text, '[\r\n]+'),
    regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(10), 'g'), '[\r\n]+'),
    regexp_split_to_array(text, '[ \t\r\n]+')] as cuts from o
), y as (
  select doc_id, m, list_transform(cuts, lambda c: list_max(list_transform(c, lambda p: length(trim(p, ' ' || chr(9) || chr(10) || chr(13)))))) as sizes from x
)
select doc_id, case when sizes[1] <= m then 'paragraph' when sizes[2] <= m then 'line'
  when sizes[3] <= m then 'sentence' when sizes[4] <= m then 'word' else 'none' end as boundary from y
""",
    "p8_statistics": r"""
with w as (
  select doc_id, text, regexp_extract_all(text, '[^ \t\n\r\f\x0b]+') ws,
    list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_matches(x, '[^ \t\f\x0b]')) ls
  from documents
), c as (select list(lower(word)) cw from common_words)
select doc_id, len(ws)::bigint as n_words,
  case when text is null then null when len(ws) = 0 then 0.0 else round(list_sum(list_transform(ws, lambda x: length(x)))::double / len(ws), 6) end as mean_word_length,
  case when text is null then null when len(ws) = 0 then 0.0 else round(length(regexp_replace(text, '[\p{L}\p{N} \t\n\r\f\x0b]', '', 'g'))::double / length(text), 6) end as symbol_ratio,
  case when text is null then null when len(ws) = 0 then 0.0 else round(len(list_filter(ls, lambda x: regexp_matches(x, '[.!?…:;][ \t\f\x0b]*$')))::double / len(ls), 6) end as line_end_share,
  case when text is null then null when len(ws) = 0 then 0.0 else round(len(list_filter(ws, lambda x: list_contains(cw, trim(lower(x), '.,;:!?"''()[]{}*_#>«»¿¡…“”‘’-'))))::double / len(ws), 6) end as common_share
from w, c
""",
}
