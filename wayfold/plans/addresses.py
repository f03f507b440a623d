"""Queries on addresses, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.names import STATES
from wayfold.functions.postal import DIRECTIONS, MARKED, PLAIN, SLIPS, STREET_TYPES
from wayfold.functions.text import levenshtein_similarity
from wayfold.operators import addresses as A
from wayfold.operators import customers as C
from wayfold.plans.customers import SNAPSHOT_CUSTOMERS
from wayfold.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
PARTS = ["number", "direction", "name", "type", "unit", "urbanization", "place", "code", "zip5", "is_pr"]


def _map(words: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in words.items()) + "}"


def _state_sql(c: str) -> str:
    t = f"trim(regexp_replace(lower({c}), '[^a-z]+', ' ', 'g'))"
    return f"coalesce({_map(STATES)}[{t}], {_map({v.lower(): v for v in STATES.values()})}[replace({t}, ' ', '')])"


def _zip_sql(c: str) -> str:
    return f"nullif(regexp_extract(trim({c}), '^(\\d{{5}})(?:-?\\d{{4}})?$', 1), '')"


def parsed_sql(source: str, key: str, x: str = "") -> str:
    """SQL of the parsed parts (table {x}p) of a table with address, city, state and zip."""
    pattern = rf"^(\d+)? ?(?:({A.POINTS}) )?(.*?)(?: ({A.TYPES}))?(?: ({A.POINTS}))?$"
    part = lambda i: f"nullif(regexp_extract(s, '{pattern}', {i}), '')"
    unit = A.UNIT
    d = f"coalesce({part(2)}, {part(5)})"
    return f"""
{x}a as (select {key}, address, city, state, zip, trim(regexp_replace(lower(address), '[\\s,.]+', ' ', 'g')) as t0,
  nullif(trim(regexp_extract(lower(address), '\\burb(?:anizacion)?\\.? ([^,0-9]+)', 1)), '') as urbanization from {source}),
{x}b as (select *, trim(regexp_replace(t0, '\\burb(?:anizacion)? [^0-9]+', ' ', 'g')) as t from {x}a),
{x}c as (select *, upper(regexp_extract(t, '{unit}', 1) || regexp_extract(t, '{unit}', 2)) as u, trim(regexp_replace(regexp_replace(t, '{unit}', ' ', 'g'), '\\s+', ' ', 'g')) as s from {x}b),
{x}p0 as (select {key}, {part(1)} as number, upper(coalesce({_map(DIRECTIONS)}[{d}], {d})) as direction, {part(3)} as name, upper({_map(STREET_TYPES)}[{part(4)}]) as type,
  nullif(u, '') as unit, urbanization, nullif(trim(lower(city)), '') as place, {_state_sql("state")} as code, {_zip_sql("zip")} as zip5 from {x}c),
{x}p as (select *, coalesce(substr(zip5, 1, 3) in ('006', '007', '008', '009'), false) or coalesce(code = 'PR', false) as is_pr from {x}p0)"""


TYPED = "(select * from (select *, row_number() over (partition by id order by address nulls first, city nulls first, state nulls first, zip nulls first) _r from test_addresses_validation) where _r = 1)"
_PARSED = "with" + parsed_sql(TYPED, "id")
_MISSING = "((number is null or name is null)::int + (place is null)::int + (code is null)::int + (zip5 is null)::int)"


def typed(spark: SparkSession, d: str) -> DataFrame:
    """The typed component addresses, one row per id."""
    rest = ["address", "city", "state", "zip", "error_type"]
    t = table(spark, d, "test_addresses_validation").groupBy("id").agg(F.min(F.struct(*rest)).alias("r"))
    return t.select("id", "r.*")


def query(sql: str | None = None):
    """Registers a query on the parsed typed addresses."""

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(A.parse(typed(spark, d)), spark, d)

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


@query(_PARSED + f" select id, {', '.join(PARTS)} from p")
def addr_parse(p, spark, d):
    return p.select("id", *PARTS)


@query(
    _PARSED
    + f""", q as (select *, {_MISSING} as missing, zip5 is not null or (place is not null and code is not null) or name is not null as anchor,
  name is not null and type is null as typeless, is_pr and urbanization is null as no_urb from p)
select id, missing::int as missing, case when missing = 0 and typeless then 'ambiguous' when missing = 0 and no_urb then 'partial' when missing = 0 then 'complete' when missing <= 2 or (missing = 3 and anchor) then 'partial' else 'invalid' end as quality,
  round((case when missing = 0 then 0.95 when missing = 1 then 0.8 when missing = 2 then 0.6 when missing = 3 and anchor then 0.4 else 0.15 end::double)
  * (case when missing = 0 and typeless then 0.9 else 1 end::double) * (case when no_urb then 0.8 else 1 end::double), 6) as confidence from q"""
)
def addr_classify(p, spark, d):
    return A.classify(p).select("id", "missing", "quality", "confidence")


@query(
    _PARSED
    + """ select id, concat_ws(', ', case when is_pr and urbanization is not null then 'URB ' || upper(urbanization) end, nullif(concat_ws(' ', number, direction, upper(name), type), ''),
case when unit is not null then 'UNIT ' || unit end, case when place is not null and nullif(concat_ws(' ', code, zip5), '') is not null then upper(place) || ', ' || concat_ws(' ', code, zip5) else coalesce(upper(place), nullif(concat_ws(' ', code, zip5), '')) end) as line from p"""
)
def addr_standardize(p, spark, d):
    return p.select("id", A.standard_line(p).alias("line"))


@query(_PARSED + " select code, count(*)::bigint as n, count(distinct zip5)::bigint as zips, count(unit)::bigint as units from p group by code")
def addr_by_state(p, spark, d):
    return p.groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("zip5").alias("zips"), F.count("unit").alias("units"))


_DIM = """z0 as (select nullif(regexp_extract(trim(zip), '^(\\d{5})(?:-?\\d{4})?$', 1), '') as zip, array_to_string(list_transform(string_split(lower(trim(city)), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') as city, upper(trim(state)) as state from customer_snapshots),
z1 as (select zip, city, state, count(*) n from z0 where zip is not null and city <> '' group by 1, 2, 3),
z2 as (select zip, city, sum(n) as n, arg_max(state, (n, -ascii(state), -ascii(substr(state, 2)))) as state from z1 group by 1, 2),
z3 as (select *, row_number() over (partition by zip order by n desc, city) r from z2),
dim as (select zip, arg_min(city, r) as city, arg_min(state, r) as state, coalesce(string_agg(city, ',' order by r) filter (r between 2 and 5), '') as others, sum(n)::bigint as total, substr(zip, 1, 3) in ('006', '007', '008', '009') as is_pr from z3 group by zip)"""


def _dimension(spark: SparkSession, d: str) -> DataFrame:
    return A.zip_dimension(table(spark, d, "customer_snapshots"))


@query(f"with {_DIM} select * from dim")
def zip_dimension(p, spark, d):
    return _dimension(spark, d)


@query(f"""with {_DIM}, t as (select *, {_zip_sql("zip")} as z from {TYPED})
select id, case when d.zip is null then true else coalesce(upper(trim(t.state)) = d.state, false) end as state_fits,
case when d.zip is null then true else coalesce(lower(trim(t.city)) = lower(d.city), false) or coalesce(list_contains(string_split(lower(d.others), ','), lower(trim(t.city))), false) end as city_fits
from t left join dim d on t.z = d.zip""")
def zip_validate(p, spark, d):
    return A.check_place(typed(spark, d), _dimension(spark, d)).select("id", "state_fits", "city_fits")


@query(
    _PARSED
    + """, r as (select id, place, code, p.zip5, c.city, c.state from p left join city_ref c on p.zip5 between c.zip_low and c.zip_high)
select id, coalesce(place, lower(city)) as place, coalesce(code, state) as code, zip5, place is null and city is not null as city_inferred, code is null and state is not null as state_inferred from r"""
)
def addr_infer(p, spark, d):
    """City and state from the ZIP where they are missing: a range join on ZIP prefixes.

    Each range is put under the three-digit prefixes it covers, a ZIP looks up its
    own, so that the join is on equal keys.
    """
    ref = table(spark, d, "city_ref").where("zip_low is not null and zip_high is not null")
    ref = ref.select("city", "state", "zip_low", "zip_high", F.explode(F.sequence(F.substring("zip_low", 1, 3).cast("int"), F.substring("zip_high", 1, 3).cast("int"))).alias("k"))
    left = p.select("id", "place", "code", "zip5", F.substring("zip5", 1, 3).cast("int").alias("k"))
    j = left.join(ref, (left["k"] == ref["k"]) & F.col("zip5").between(F.col("zip_low"), F.col("zip_high")), "left")
    return j.select(
        "id",
        F.coalesce("place", F.lower("city")).alias("place"),
        F.coalesce("code", "state").alias("code"),
        "zip5",
        (F.col("place").isNull() & F.col("city").isNotNull()).alias("city_inferred"),
        (F.col("code").isNull() & F.col("state").isNotNull()).alias("state_inferred"),
    )


@query(
    """with m as (select lower(city) as city, count(*) as k, min(state) as expected, list_sort(list(state)) as allowed from city_ref group by 1)
select id, t.city, t.state, m.expected, case when m.k = 1 then 0.85 else 0.6 end::double as confidence from """
    + TYPED
    + f""" t join m on lower(trim(t.city)) = m.city where {_state_sql("t.state")} is not null and not list_contains(m.allowed, {_state_sql("t.state")})"""
)
def city_state_mismatch(p, spark, d):
    """Typed states that no place of the typed name has."""
    m = table(spark, d, "city_ref").groupBy(F.lower("city").alias("c")).agg(F.count("*").alias("k"), F.min("state").alias("expected"), F.collect_set("state").alias("allowed"))
    t = typed(spark, d).withColumn("c", F.lower(F.trim("city"))).withColumn("code", A.normal_state(F.col("state")))
    j = t.join(m, "c").where(F.col("code").isNotNull() & ~F.array_contains("allowed", F.col("code")))
    return j.select("id", "city", "state", "expected", F.when(F.col("k") == 1, 0.85).otherwise(0.6).alias("confidence"))


_KEY = f"concat_ws('|', coalesce(number, ''), coalesce(trim(regexp_replace(name, '^(?:the|{A.POINTS}) ', '')), ''), coalesce(zip5, ''), case when is_pr then coalesce(urbanization, '') end)"


@query(
    f"with {SNAPSHOT_CUSTOMERS}, " + parsed_sql("customer_snapshots", "crid, snapshot_date", "seen_").strip() + ", " + parsed_sql("customers", "crid").strip()
    + f"""
select distinct a.crid as probe, b.crid as match from (select crid, {_KEY} as k from seen_p) a join (select crid, {_KEY} as k from p) b on a.k = b.k where a.k not like '|%'"""
)
def addr_exact_match(p, spark, d):
    """Every address a customer was ever seen at, looked up among the current ones."""
    snaps = table(spark, d, "customer_snapshots")
    probe = A.parse(snaps.select("crid", "address", "city", "state", "zip")).select(F.col("crid").alias("probe"), A.exact_key(snaps).alias("k"))
    index = A.parse(C.latest(snaps).select("crid", "address", "city", "state", "zip")).select(F.col("crid").alias("match"), A.exact_key(snaps).alias("k"))
    return probe.where("k not like '|%'").distinct().join(index, "k").select("probe", "match").distinct()


@query()
def addr_fuzzy_match(p, spark, d):
    """The best other typed addresses for each, with the gap to the next."""
    m = A.fuzzy_matches(p, p, "id", "id", 0.6, 5, same_number=False, itself=False)
    return m.select("p_id", "i_id", "match_type", "score", "rank", "gap")


@query()
def addr_verify(p, spark, d):
    """A ladder over the best match: verified, corrected, suggested or unverified."""
    m = A.fuzzy_matches(p, p, "id", "id", 0.5, 1, same_number=False, itself=False).groupBy("p_id").agg(F.max("score").alias("score"))
    s = F.coalesce("score", F.lit(0.0))
    status = F.when(s >= 0.95, "verified").when(s >= 0.85, "corrected").when(s >= 0.75, "suggested").otherwise("unverified")
    return p.select("id").join(m, F.col("id") == F.col("p_id"), "left").select("id", s.alias("score"), status.alias("status"))


@query("with " + parsed_sql(TYPED, "id").strip() + " select name, count(*)::bigint as n from p where zip5 like '404%' and starts_with(name, 'pine') group by 1 order by 2 desc, 1 limit 5")
def street_suggestions(p, spark, d):
    return p.where("zip5 like '404%'").where(F.startswith("name", F.lit("pine"))).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(5)


@query(
    "select coalesce(error_type, 'none') as error_type, count(*)::bigint as n, count(*) filter (regexp_matches(trim(zip), '^\\d{5}$'))::bigint as with_zip, round(100.0 * count(*) / sum(count(*)) over (), 4)::double as percent from test_addresses_validation group by 1"
)
def batch_report_by_error(p, spark, d):
    t = table(spark, d, "test_addresses_validation")
    n = t.groupBy(F.coalesce("error_type", F.lit("none")).alias("error_type")).agg(F.count("*").alias("n"), F.count_if(F.trim("zip").rlike(r"^\d{5}$")).alias("with_zip"))
    return n.withColumn("percent", F.round(100 * F.col("n") / n.agg(F.sum("n")).scalar(), 4))


@query(
    f"select id, {_state_sql('state')} as code, {_zip_sql('zip')} as zip5, regexp_matches(coalesce(zip, ''), '^\\d{{5}}$') as valid from " + TYPED
)
def state_zip_normalize(p, spark, d):
    return typed(spark, d).select("id", A.normal_state(F.col("state")).alias("code"), A.zip5(F.col("zip")).alias("zip5"), F.coalesce("zip", F.lit("")).rlike(r"^\d{5}$").alias("valid"))


def _fix_sql(c: str) -> str:
    for wrong, right in sorted(SLIPS.items()):
        c = f"regexp_replace({c}, '(?i)\\b{wrong}\\b', '{right}', 'g')"
    return c


@query("select id, " + _fix_sql("address") + " as fixed from " + TYPED + " where address is not null")
def typo_fixes(p, spark, d):
    fixed, _ = A.slips_fixed(F.col("address"))
    return typed(spark, d).where("address is not null").select("id", fixed.alias("fixed"))


_SCORED = (
    _PARSED
    + """, r as (select p.*, lower(c.city) as ref_city, c.state as ref_state from p left join city_ref c on p.zip5 between c.zip_low and c.zip_high),
s as (select *, (number is not null)::int::double as s1, (name is not null)::int::double as s2, case when type is not null then 1.0 else 0.3 end::double as s3,
  case when place is null then case when ref_city is not null then 0.85 else 0.0 end when ref_city is null or place = ref_city then 1.0 else 1 - levenshtein(translate(place, 'áàâäãéèêëíìîïóòôöõúùûüñç', 'aaaaaeeeeiiiiooooouuuunc'), translate(ref_city, 'áàâäãéèêëíìîïóòôöõúùûüñç', 'aaaaaeeeeiiiiooooouuuunc'))::double / greatest(length(place), length(ref_city)) end::double as s4,
  case when code is null then case when ref_state is not null then 0.9 else 0.0 end when ref_state is null or code = ref_state then 1.0 else 0.0 end::double as s5, (zip5 is not null)::int::double as s6 from r),
t as (select *, (s1 * 0.2 + s2 * 0.25 + s3 * 0.05 + s4 * 0.15 + s5 * 0.15 + s6 * 0.15) / 0.95 as m from s),
u as (select *, round(case when number is not null and name is not null and place is not null and code is not null and zip5 is not null then least(1.0, m * 1.05) else m end * case when is_pr and urbanization is null then 0.85 else 1.0 end, 6)::double as confidence from t)"""
)


def _with_reference(p: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    ref = table(spark, d, "city_ref").where("zip_low is not null and zip_high is not null")
    ref = ref.select(F.lower("city").alias("ref_city"), F.col("state").alias("ref_state"), "zip_low", "zip_high", F.explode(F.sequence(F.substring("zip_low", 1, 3).cast("int"), F.substring("zip_high", 1, 3).cast("int"))).alias("k"))
    left = p.withColumn("_k", F.substring("zip5", 1, 3).cast("int"))
    return left.join(ref, (F.col("_k") == F.col("k")) & F.col("zip5").between(F.col("zip_low"), F.col("zip_high")), "left").drop("_k", "k", "zip_low", "zip_high")


@query(_SCORED + " select id, round(s4, 6) as s_city, s5 as s_state, confidence from u")
def addr_component_scores(p, spark, d):
    s = A.component_scores(_with_reference(p, spark, d))
    return s.select("id", F.round("s_city", 6).alias("s_city"), "s_state", "confidence")


@query(
    _SCORED
    + """ select case when confidence >= 0.95 then 'verified' when s4 < 1 and s4 > 0 and not (s4 = 0.85 or s5 = 0.9) and confidence >= 0.7 then 'corrected'
when (s4 = 0.85 or s5 = 0.9) and confidence >= 0.7 then 'completed' when confidence >= 0.5 then 'suggested' else 'unverified' end as status, count(*)::bigint as n, round(avg(confidence), 6)::double as confidence from u group by 1"""
)
def addr_status_report(p, spark, d):
    s = A.component_scores(_with_reference(p, spark, d))
    return s.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(
    f"""select id, zip, correct_zip, len(list_filter(range(1, length(zip)), lambda i: substr(zip, 1, (i - 1)::int) || substr(zip, (i + 1)::int, 1) || substr(zip, i::int, 1) || substr(zip, (i + 2)::int) = correct_zip)) > 0 and zip <> correct_zip as swapped
from (select distinct id, zip, correct_zip from test_addresses_validation where correct_zip is not null and zip is not null)"""
)
def transposition_check(p, spark, d):
    t = table(spark, d, "test_addresses_validation").where("correct_zip is not null and zip is not null").select("id", "zip", "correct_zip").distinct()
    return t.withColumn("swapped", A.swapped(F.col("zip"), F.col("correct_zip")))


@query(_PARSED + " select urbanization, count(*)::bigint as n, count(distinct zip5)::bigint as zips from p where is_pr and urbanization is not null group by 1")
def by_urbanization(p, spark, d):
    return p.where("is_pr and urbanization is not null").groupBy("urbanization").agg(F.count("*").alias("n"), F.count_distinct("zip5").alias("zips"))


@query(
    _PARSED
    + """, s as (select distinct zip5, name from p where zip5 is not null and name is not null),
m as (select p.id, s.name as street, round(1 - levenshtein(p.name, s.name)::double / greatest(length(p.name), length(s.name)), 6) as similarity from p join s on p.zip5 = s.zip5 and p.name <> s.name where p.id % 20 = 0)
select id, street, similarity, r::int as rank from (select *, row_number() over (partition by id order by similarity desc, street) r from m where similarity >= 0.6) where r <= 5"""
)
def street_in_zip(p, spark, d):
    """The streets of a ZIP most like the typed one, whatever the house number, for every twentieth record."""
    streets = p.where("zip5 is not null and name is not null").select("zip5", F.col("name").alias("street")).distinct()
    return A.streets_like(p.where("id % 20 = 0").select("id", "zip5", "name"), streets, 0.6, 5)


@query(
    f"""with t as (select id, regexp_replace(translate(lower(trim(city)), '{MARKED}', '{PLAIN}'), '[^ -~]', '?', 'g') as c, """
    + _state_sql("state")
    + """ as code from """
    + TYPED
    + f"""), r as (select city_ref_id, state, translate(lower(city), '{MARKED}', '{PLAIN}') as r from city_ref)
select id, city_ref_id from t join r on t.code = r.state where damerau_levenshtein(t.c, r.r) = 1"""
)
def swaps_and_slips(p, spark, d):
    """Typed towns at one edit or swap from a town of their state; where it is one, both definitions of the distance agree."""
    plain = F.regexp_replace(F.translate(F.lower(F.trim("city")), MARKED, PLAIN), "[^ -~]", "?")
    t = typed(spark, d).select("id", plain.alias("c"), A.normal_state(F.col("state")).alias("code")).where("code is not null")
    r = table(spark, d, "city_ref").select("city_ref_id", F.col("state").alias("code"), F.translate(F.lower("city"), MARKED, PLAIN).alias("r"))
    near = F.levenshtein("c", "r") <= 2  # what built-in functions can tell goes first
    return t.join(r, "code").where(near).where(A.osa("c", "r") == 1).select("id", "city_ref_id")


@query(
    f"""with s as (select distinct state as code, state_name from city_ref), t as (select distinct lower(trim(state)) as typed from {TYPED} where {_state_sql("state")} is null and length(trim(state)) >= 3),
m as (select typed, code, round(1 - levenshtein(typed, lower(state_name))::double / greatest(length(typed), length(state_name)), 6) as similarity from t, s)
select typed, code, similarity, r::int as rank from (select *, row_number() over (partition by typed order by similarity desc, code) r from m where similarity >= 0.6) where r <= 3"""
)
def similar_states(p, spark, d):
    """What was typed for a state and is none, with the states most like it; some fifty states are compared with each."""
    states = table(spark, d, "city_ref").select(F.col("state").alias("code"), F.lower("state_name").alias("full")).distinct()
    t = typed(spark, d).where(A.normal_state(F.col("state")).isNull() & (F.length(F.trim("state")) >= 3)).select(F.lower(F.trim("state")).alias("typed")).distinct()
    return A.similar_states(t, states)


@query(f"""with f as (select substr(zip_low, 1, 1) as digit, state from city_ref union select substr(zip_high, 1, 1), state from city_ref), a as (select digit, list(distinct state) as states from f group by 1)
select id, code, z, coalesce(list_contains(a.states, code), false) as fits from (select id, {_state_sql("state")} as code, {_zip_sql("zip")} as z from {TYPED}) t left join a on substr(z, 1, 1) = a.digit where code is not null and z is not null""")
def zip_digit_fits_state(p, spark, d):
    """Whether the first digit of the ZIP is one of the state's, by the ranges of the canonical places."""
    r = table(spark, d, "city_ref")
    digits = r.select(F.explode(F.array(F.substring("zip_low", 1, 1), F.substring("zip_high", 1, 1))).alias("digit"), "state").groupBy("digit").agg(F.collect_set("state").alias("states"))
    t = p.where("code is not null and zip5 is not null").select("id", "code", F.col("zip5").alias("z"), F.substring("zip5", 1, 1).alias("digit"))
    return t.join(digits, "digit", "left").select("id", "code", "z", F.coalesce(F.array_contains("states", F.col("code")), F.lit(False)).alias("fits"))


@query(f"""with z0 as (select {_zip_sql("zip")} as zip, upper(trim(state)) as state, lower(trim(city)) as city from customer_snapshots), g as (select zip, state, count(distinct city) as cities, min(city) as city from z0 where zip is not null and state <> '' and city <> '' group by 1, 2)
select zip, state, city, cities::bigint as cities from (select *, row_number() over (partition by zip order by cities desc, state) r from g) where r = 1""")
def zip_dimension_by_cities(p, spark, d):
    """Per ZIP the state with most distinct cities."""
    z = table(spark, d, "customer_snapshots").select(A.zip5(F.col("zip")).alias("zip"), F.upper(F.trim("state")).alias("state"), F.lower(F.trim("city")).alias("city"))
    g = z.where("zip is not null and state <> '' and city <> ''").groupBy("zip", "state").agg(F.count_distinct("city").alias("cities"), F.min("city").alias("city"))
    best = g.groupBy("zip").agg(F.min(F.struct((-F.col("cities")).alias("k"), "state", "city", "cities")).alias("b"))
    return best.select("zip", "b.state", "b.city", "b.cities")


@query()
def addr_match_cascade(p, spark, d):
    """Exact matches first; records without one go to streets alike and their scores by part."""
    return A.match_cascade(p, p, "id", "id")


@query(
    "with "
    + f"{SNAPSHOT_CUSTOMERS}, h as (select distinct crid, a from (select crid, address as a from customers union all select crid, unnest(list_transform(move_history, lambda m: m.to_address)) from customers union all select crid, unnest(list_transform(move_history, lambda m: m.from_address)) from customers)), "
    + "n as (select crid, a, nullif(regexp_extract(trim(a), '^(\\d+)', 1), '') as number from h where trim(a) <> '') select number, count(distinct crid)::bigint as customers, count(*)::bigint as addresses from n where number is not null group by 1"
)
def addresses_ever_by_number(p, spark, d):
    """Every address a customer has or had, from the record and both ends of each move, by house number."""
    e = C.every_address(C.latest(table(spark, d, "customer_snapshots")))
    e = e.withColumn("number", F.nullif(F.regexp_extract(F.trim("address"), r"^(\d+)", 1), F.lit(""))).where("number is not null")
    return e.groupBy("number").agg(F.count_distinct("crid").alias("customers"), F.count("*").alias("addresses"))
