"""Queries on plain-language texts, JSON, arrays and ingestion, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.names import AMBIGUOUS, STATES
from wayfold.operators import addresses as A
from wayfold.operators import language as L
from wayfold.operators import records as R
from wayfold.plans.addresses import TYPED, parsed_sql, typed
from wayfold.plans.customers import SNAPSHOT_CUSTOMERS, customers
from wayfold.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _when(rules, t: str, otherwise: str = "null") -> str:
    return "case " + " ".join(f"when regexp_matches({t}, '{p}') then '{v}'" for v, p in rules) + f" else {otherwise} end"


_NAMES = sorted(STATES, key=lambda n: (-len(n), n))
_SURE = "|".join(sorted(set(STATES.values()) - set(AMBIGUOUS)))
_Q = "trim(regexp_replace(query_text, '\\s+', ' ', 'g'))"
for _k, _v in sorted(L.MISSPELLED.items()):
    _Q = f"regexp_replace({_Q}, '(?i)\\b{_k}\\b', '{_v}', 'g')"
_Q = f"regexp_replace({_Q}, '(?i){L.PEOPLE}', 'customers', 'g')"
_NL = f"""with q as (select distinct query_text from query_events where query_text is not null), r as (select query_text, {_Q} as q from q), t as (select *, lower(q) as t from r),
p as (select query_text, q, {_when([(STATES[n], rf"\b{n}\b") for n in _NAMES], "t")} as named, nullif(regexp_extract(q, '\\b({_SURE})\\b', 1), '') as code,
  nullif(regexp_extract(q, '(?:\\bin\\s+|,\\s*)({"|".join(sorted(AMBIGUOUS))})\\b', 1), '') as risky, t from t)"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_events").where("query_text is not null").select("query_text").distinct()


@query(
    _NL
    + f"""select query_text, coalesce(named, code, risky) as state, {_when(L.STATUS, "t")} as status, {_when(L.KINDS, "t")} as customer_type,
coalesce(case when regexp_matches(t, 'high\\s+movers?') then 5 when regexp_matches(t, 'frequent\\s+movers?') then 3 when regexp_matches(t, 'multiple\\s+moves?') then 2 end,
  try_cast(coalesce(nullif(regexp_extract(t, 'moved\\s+(?:at\\s+least\\s+)?(\\d+)', 1), ''), nullif(regexp_extract(t, '(\\d+)\\+?\\s+moves?', 1), '')) as int)) as min_moves,
nullif(regexp_extract(t, '\\b(\\d{{5}})\\b', 1), '') as zip,
'CRID-' || case when length(nullif(regexp_extract(t, '\\bcrid[-:\\s]*(\\d+)', 1), '')) < 6 then lpad(regexp_extract(t, '\\bcrid[-:\\s]*(\\d+)', 1), 6, '0') else nullif(regexp_extract(t, '\\bcrid[-:\\s]*(\\d+)', 1), '') end as crid from p"""
)
def nl_filters(spark, d):
    return L.parsed(_questions(spark, d), "query_text").select("query_text", "state", "status", "customer_type", "min_moves", "zip", "crid")


@query(
    _NL
    + f""", i as (select query_text, t, {_when(L.INTENTS, "t", "'other'")} as intent from p)
select query_text, intent, case when regexp_matches(t, '{L.COMPLEX}') or intent in ('analysis', 'comparison', 'recommendation') then 'complex' when regexp_matches(t, '{L.MEDIUM}') then 'medium' else 'simple' end as complexity from i"""
)
def nl_intent(spark, d):
    return L.parsed(_questions(spark, d), "query_text").select("query_text", "intent", "complexity")


@query(_NL + " select query_text, q as rewritten from p")
def nl_rewrite(spark, d):
    return _questions(spark, d).withColumn("rewritten", L.rewritten(F.col("query_text")))


@query(
    _NL
    + f""", i as (select query_text, t, {_when(L.INTENTS, "t", "'other'")} as intent from p),
c as (select case when regexp_matches(t, '{L.COMPLEX}') or intent in ('analysis', 'comparison', 'recommendation') then 'large' when regexp_matches(t, '{L.MEDIUM}') then 'medium' else 'small' end as tier from i)
select tier, count(*)::bigint as queries from c group by 1"""
)
def model_tier(spark, d):
    return L.parsed(_questions(spark, d), "query_text").groupBy("tier").agg(F.count("*").alias("queries"))


@query(f"with {SNAPSHOT_CUSTOMERS} select state as value, count(*)::bigint as n from customers where upper(status) = 'ACTIVE' and state = 'NJ' group by 1")
def nl_answer(spark, d):
    """A plain-language query answered from the customer table."""
    return L.answer(customers(spark, d), "how many active people in New Jersey")


@query(
    """select event_id, json_extract_string(props, '$.k')::int + 1 as k_plus, length(props) as chars, json_keys(props::json)[1] as first_key, event_type || '!' as marked from events"""
)
def json_updates(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    keys = F.json_object_keys("props")
    return table(spark, d, "events").select("event_id", (k + 1).alias("k_plus"), F.length("props").cast("long").alias("chars"), F.get(keys, F.lit(0)).alias("first_key"), F.concat("event_type", F.lit("!")).alias("marked"))


@query(
    """select trace_id, received, array_to_string(list_append(a, 'end'), '>') as appended, array_to_string(list_concat(['start'], a), '>') as inserted, a[len(a)] as popped, array_to_string(a[2:3], '>') as trimmed, len(a)::int as n
from (select trace_id, epoch_us(received_at)::bigint as received, agent_chain a from query_events where agent_chain is not null and len(agent_chain) > 0)"""
)
def array_ops(spark, d):
    a = F.col("agent_chain")
    e = table(spark, d, "query_events").where("size(agent_chain) > 0")
    return e.select(
        "trace_id",
        F.unix_micros(F.col("received_at").cast("timestamp")).alias("received"),
        F.array_join(F.array_append(a, "end"), ">").alias("appended"),
        F.array_join(F.array_insert(a, 1, "start"), ">").alias("inserted"),
        F.element_at(a, -1).alias("popped"),
        F.array_join(F.slice(a, 2, 2), ">").alias("trimmed"),
        F.size(a).alias("n"),
    )


@query(f"with {SNAPSHOT_CUSTOMERS} select crid, move_history[1].city as first_city, len(move_history)::int as moves, list_aggregate(list_transform(move_history, lambda m: m.state), 'string_agg', ',') as states from customers where len(move_history) > 0")
def nested_paths(spark, d):
    m = F.col("move_history")
    c = customers(spark, d).where("size(move_history) > 0")
    return c.select("crid", F.get(m, F.lit(0))["city"].alias("first_city"), F.size(m).alias("moves"), F.array_join(F.transform(m, lambda x: x["state"]), ",").alias("states"))


@query(f"with {SNAPSHOT_CUSTOMERS} select crid as id, name as profile_name, city as profile_home_city, state as profile_home_state from customers")
def flatten_nested(spark, d):
    c = customers(spark, d).select(F.col("crid").alias("id"), F.struct("name", F.struct("city", "state").alias("home")).alias("profile"))
    return R.flattened(c)


@query(f"with {SNAPSHOT_CUSTOMERS} select upper(address) as street, city, state, case when length(zip) < 5 then lpad(zip, 5, '0') else zip end as zip from customers")
def schema_map_apply(spark, d):
    """Columns found by their spelling, mapped and transformed."""
    c = customers(spark, d).select(F.col("address").alias("Address Line 1"), F.col("city").alias("Town"), F.col("state").alias("Province"), F.col("zip").alias("Postal-Code"))
    mapping = R.detect_mapping(c.columns)
    return R.apply_mapping(c, {k: mapping[k] for k in ("street", "city", "state", "zip")}, {"street": "upper", "zip": "zfill5"})


@query(
    "select id, nullif(trim(address), '') as address, case when lower(trim(city)) in ('', 'null', 'none', 'n/a', 'na') then null else trim(city) end as city, case when lower(trim(zip)) in ('', 'null', 'none', 'n/a', 'na') then null else trim(zip) end as zip_code from "
    + TYPED
)
def clean_records(spark, d):
    t = typed(spark, d).select("id", F.col("address").alias(" Address "), "city", F.col("zip").alias("ZIP Code"))
    return R.cleaned(t)


_GATES = "with " + parsed_sql(TYPED, "id").strip() + """,
k as (select *, concat_ws('|', coalesce(number, ''), coalesce(name, ''), coalesce(place, ''), coalesce(code, ''), coalesce(zip5, '')) as k from p),
g as (select *, ((number is not null)::int * 0.15 + (name is not null)::int * 0.25 + (place is not null)::int * 0.15 + (code is not null)::int * 0.15 + (zip5 is not null)::int * 0.2)::double / 0.9 as score, id = min(id) over (partition by k) as fresh from k),
h as (select id, name is not null as g1, score >= 0.6 as g2, code is not null as g3, zip5 is not null as g4, not is_pr or urbanization is not null as g5, fresh as g6, round(score, 6) as score from g)"""


@query(_GATES + " select id, score, g1 and g2 and g3 and g4 and g5 and g6 as approved, (g1::int + g2::int + g3::int + g4::int + g5::int + g6::int)::int as passed from h")
def ingest_gates(spark, d):
    g = R.gates(A.parse(typed(spark, d)), "id")
    score = F.get("gates", F.lit(1))["score"]
    return g.select("id", score.alias("score"), "approved", F.size(F.filter("gates", lambda x: x["passed"])).alias("passed"))


@query(
    _GATES
    + """ select gate, count(*)::bigint as n, count(*) filter (ok)::bigint as passed from (select unnest([{'gate': 'has_street', 'ok': g1}, {'gate': 'completeness', 'ok': g2}, {'gate': 'known_state', 'ok': g3}, {'gate': 'zip_format', 'ok': g4}, {'gate': 'pr_urbanization', 'ok': g5}, {'gate': 'not_duplicate', 'ok': g6}], recursive := true) from h) group by gate"""
)
def ingest_summary(spark, d):
    g = R.gates(A.parse(typed(spark, d)), "id").select(F.explode("gates").alias("g"))
    return g.groupBy("g.gate").agg(F.count("*").alias("n"), F.count_if("g.passed").alias("passed"))


@query(
    """with o as (select input_address, confidence, row_number() over (partition by input_address order by audit_id, ts, received_at) r, count(*) over (partition by input_address) n from (select distinct input_address, audit_id, ts, received_at, confidence from validation_audit where input_address is not null and confidence is not null)),
a as (select input_address, list(confidence::double order by r) l from o group by 1)
select input_address, len(l)::int as n, round(list_reduce(l, lambda acc, x: least(1.0::double, acc * 0.6 + x * 0.5)), 6) as confidence from a"""
)
def fold_confidence(spark, d):
    a = table(spark, d, "validation_audit").where("input_address is not null and confidence is not null")
    a = a.select("input_address", "audit_id", "ts", "received_at", "confidence").distinct()
    return R.folded_confidence(a, "input_address", "audit_id", ["ts", "received_at"], "confidence")


@query(
    "select lower(trim(query_text)) as query, arg_max_null(response_preview, (ts, trace_id)) is not null as has_answer, count(*)::bigint as n from (select * from query_events where ts > timestamp '2025-05-30 12:00:00' and query_text is not null) group by 1"
)
def cache_ttl(spark, d):
    """Entries of the last twelve hours before a moment, one per key."""
    e = table(spark, d, "query_events").where("query_text is not null").select("query_text", F.col("ts").cast("timestamp").alias("ts"), "trace_id", "response_preview")
    now = F.lit("2025-05-31 00:00:00").cast("timestamp")
    live = e.where(F.col("ts") > now - F.expr("interval 12 hours"))
    return live.groupBy(F.lower(F.trim("query_text")).alias("query")).agg(F.max_by("response_preview", F.struct("ts", "trace_id")).isNotNull().alias("has_answer"), F.count("*").alias("n"))


@query("select row_number() over (order by ts, trace_id, received_at)::bigint as row_no, trace_id from query_events")
def row_numbers(spark, d):
    return R.indexed(table(spark, d, "query_events").select("ts", "trace_id", "received_at"), ["ts", "trace_id", "received_at"]).select(F.col("row_no").cast("long").alias("row_no"), "trace_id")


@query(
    """with k as (select doc_id as id, 'documents' as source, 1.2 * len(list_intersect(string_split(lower(text), ' '), ['clerk', 'zip', 'street', 'town']))::double / 4 as score from documents where text is not null),
e as (select trace_id, min(response_preview) as t from query_events where response_preview is not null group by 1),
q as (select trace_id as id, 'answers' as source, 1.0 * len(list_intersect(string_split(lower(t), ' '), ['clerk', 'zip', 'street', 'town']))::double / 4 as score from e)
select id, source, round(score, 6) as score from (select id::varchar as id, source, score from k where score > 0 union all select id, source, score from q where score > 0) order by 3 desc, 2, 1 limit 20"""
)
def federated_search(spark, d):
    """Two indexes searched, weighted, and the best of both kept."""
    want = F.array(*[F.lit(w) for w in ("clerk", "zip", "street", "town")])

    def hits(df: DataFrame, key: str, text: str, name: str, weight: float) -> DataFrame:
        s = F.lit(weight) * F.size(F.array_intersect(F.split(F.lower(text), " "), want)) / 4
        return df.select(F.col(key).cast("string").alias("id"), F.lit(name).alias("source"), F.round(s, 6).alias("score")).where("score > 0")

    k = hits(table(spark, d, "documents").where("text is not null"), "doc_id", "text", "documents", 1.2)
    e = table(spark, d, "query_events").where("response_preview is not null").groupBy("trace_id").agg(F.min("response_preview").alias("t"))
    return k.unionByName(hits(e, "trace_id", "t", "answers", 1.0)).orderBy(F.desc("score"), "source", "id").limit(20)
