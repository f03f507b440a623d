"""Queries on histories of changing attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.postal import CITY_WORDS, LINE_WORDS, MARKED, PLAIN
from wayfold.operators.history import address_history, attribute_history
from wayfold.runtime import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return address_history(table(spark, d, "customer_snapshots")).select("crid", "valid_from", "valid_to")


def p4_versions(spark: SparkSession, d: str) -> DataFrame:
    return address_history(table(spark, d, "customer_snapshots"))


def p4_status_history(spark: SparkSession, d: str) -> DataFrame:
    """The general operator on another attribute: status and customer type."""
    h = attribute_history(table(spark, d, "customer_snapshots"), "crid", ["status", "customer_type"], "snapshot_date", "loaded_at")
    return h.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("valid_from", "valid_to")})


def _map(words: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in words.items()) + "}"


def _form(text: str, words: dict[str, str], keep: str) -> str:
    plain = f"translate(lower({text}), '{MARKED}', '{PLAIN}')"
    if "#" in keep:
        plain = f"replace({plain}, '#', ' # ')"
    spaced = f"trim(regexp_replace({plain}, '[^a-z0-9{keep}]+', ' ', 'g'))"
    return f"list_aggregate(list_transform(string_split({spaced}, ' '), lambda t: coalesce({_map(words)}[t], t)), 'string_agg', ' ')"


_SNAPS = """
s as (select * from (select *, row_number() over (partition by crid, snapshot_date order by loaded_at desc) _r from customer_snapshots
  where crid is not null and snapshot_date is not null) where _r = 1)"""

_EVENTS = f"""
with {_SNAPS},
raw as (
  select crid, snapshot_date as at_, 2 as kind, address as line, city, state, null::varchar as origin, coalesce(last_move, snapshot_date) as since, created_date from s where trim(address) <> ''
  union all
  select crid, m.move_date, 1, m.to_address, m.city, m.state, m.from_address, m.move_date, created_date
  from (select crid, created_date, unnest(move_history) m from s) where m.move_date is not null and trim(m.to_address) <> ''
),
formed as (
  select crid, at_, kind, {_form("line", LINE_WORDS, "#/-")} as line, {_form("coalesce(city, '')", CITY_WORDS, "")} as city,
    upper(trim(coalesce(state, ''))) as state, nullif({_form("origin", LINE_WORDS, "#/-")}, '') as origin, since, created_date from raw
),
once as (select crid, at_, kind, line, city, state, max(origin) as origin, min(since) as since, min(created_date) as created_date from formed group by 1, 2, 3, 4, 5, 6),
numbered as (select *, row_number() over (partition by crid order by at_, kind, line, city, state) k from once),
e as (
  select * from numbered union all
  select crid, at_, 0, origin, '', '', null, created_date, created_date, 0 from numbered where k = 1 and kind = 1 and origin is not null
),
f as (select *, coalesce(lag(line || '|' || city || '|' || state) over (partition by crid order by k) <> line || '|' || city || '|' || state, true) as fresh,
  min(created_date) over (partition by crid) as created from e),
g as (select *, sum(fresh::int) over (partition by crid order by k) as version from f),
v as (
  select crid, version, any_value(line) as line, any_value(city) as city, any_value(state) as state, count(*) filter (kind = 2) as seen,
    coalesce(min(since) filter (kind = 1), case when version = 1 then any_value(created) end, arg_min(since, k) filter (kind = 2)) as since
  from g group by crid, version
),
w as (select crid, line, city, state, strftime(since, '%Y-%m-%d') as valid_from,
  coalesce(strftime(lead(since) over (partition by crid order by version), '%Y-%m-%d'), '9999-12-31') as valid_to, seen from v)
"""

QUERIES = {f.__name__: f for f in (p4_found, p4_versions, p4_status_history)}
SQL = {
    "p4_found": _EVENTS + "select crid, valid_from, valid_to from w",
    "p4_versions": _EVENTS + "select * from w",
    "p4_status_history": f"""
with {_SNAPS},
f as (select *, coalesce(struct_pack(a := status, b := customer_type) <> lag(struct_pack(a := status, b := customer_type)) over (partition by crid order by snapshot_date), true) fresh from s),
g as (select *, sum(fresh::int) over (partition by crid order by snapshot_date) as version from f),
v as (select crid, version, any_value(status) status, any_value(customer_type) customer_type, min(snapshot_date) as a from g group by 1, 2)
select crid, status, customer_type, strftime(a, '%Y-%m-%d') as valid_from,
  strftime(lead(a) over (partition by crid order by version), '%Y-%m-%d') as valid_to from v""",
}
