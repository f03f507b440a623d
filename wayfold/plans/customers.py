"""Queries on customers, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.operators import customers as C
from wayfold.runtime import table

SNAPSHOT_CUSTOMERS = "customers as (select * from (select *, row_number() over (partition by crid order by snapshot_date desc, loaded_at desc) _r from customer_snapshots where crid is not null) where _r = 1)"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def customers(spark: SparkSession, d: str) -> DataFrame:
    return C.latest(table(spark, d, "customer_snapshots"))


def query(sql: str | None = None):
    """Registers a query on the current customers; its SQL may use the table customers."""

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(customers(spark, d))

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = f"with {SNAPSHOT_CUSTOMERS} {sql}"
        return run

    return add


SHOWN = "crid, name, city, state, status, move_count"
COLUMNS = SHOWN.split(", ")


@query("select state, count(*)::bigint as customers, sum(move_count)::bigint as moves from customers where upper(status) = 'ACTIVE' and move_count >= 2 group by state")
def active_movers_by_state(c):
    return c.where(C.criteria(status="ACTIVE", min_moves=2)).groupBy("state").agg(F.count("*").alias("customers"), F.sum("move_count").alias("moves"))


@query("select crid, name, address, city, state, zip from customers where crid = 'CRID-000017'")
def lookup_crid(c):
    return C.lookup(c, "crid-17").select("crid", "name", "address", "city", "state", "zip")


@query("select t.crid, c.crid is not null as found from (values ('CRID-000001'), ('CRID-000005'), ('CRID-999999')) t(crid) left join customers c on c.crid = t.crid")
def crid_resolution(c):
    asked = c.sparkSession.createDataFrame([("CRID-000001",), ("CRID-000005",), ("CRID-999999",)], "crid string")
    there = asked.join(c.select("crid"), "crid", "left_semi").withColumn("found", F.lit(True))
    return there.unionByName(asked.join(c.select("crid"), "crid", "left_anti").withColumn("found", F.lit(False)))


@query(f"select {SHOWN} from customers where state = 'NJ' and upper(status) = 'ACTIVE' and move_count >= 1")
def search_filtered(c):
    return C.search(c, state="nj", status="active", min_moves=1).select(*COLUMNS)


@query(f"select {SHOWN}, (select count(*) from customers where contains(lower(city), 'gate'))::bigint as total from customers where contains(lower(city), 'gate') order by crid limit 20")
def search_city_contains(c):
    return C.search(c, limit=20, city="Gate").select(*COLUMNS, "total")


@query("select crid, address, customer_type from customers where (contains(lower(address), 'apt') or contains(lower(address), 'unit')) and customer_type = 'RESIDENTIAL'")
def search_apartment(c):
    return C.search(c, has_apartment=True, customer_type="residential").select("crid", "address", "customer_type")


@query(f"select {SHOWN} from customers where len(list_filter(move_history, lambda m: upper(m.state) = 'NJ')) > 0")
def moved_through_state(c):
    return C.search(c, from_state="NJ").select(*COLUMNS)


@query("""select m.state as origin, count(distinct crid)::bigint as customers from
(select crid, status, unnest(move_history) m from customers) where upper(status) = 'ACTIVE' and m.state is not null group by 1""")
def moved_from_count(c):
    m = c.where(C.criteria(status="active")).select("crid", F.explode("move_history").alias("m"))
    return m.where("m.state is not null").groupBy(F.col("m.state").alias("origin")).agg(F.count_distinct("crid").alias("customers"))


@query("""select crid, row_number() over (partition by crid order by m.move_date, m.to_address, m.city)::int as step,
m.from_address, m.to_address, m.city, m.state, m.zip, strftime(m.move_date, '%Y-%m-%d') as move_date
from (select distinct crid, m from (select crid, unnest(move_history) m from customers))""")
def move_timeline(c):
    return C.move_timeline(c).withColumn("move_date", F.date_format("move_date", "yyyy-MM-dd"))


@query("""select from_state, to_state, count(*)::bigint as moves, count(distinct crid)::bigint as customers from
(select crid, lag(m.state) over (partition by crid order by m.move_date, m.to_address, m.city) as from_state, m.state as to_state
from (select distinct crid, m from (select crid, unnest(move_history) m from customers))) where from_state is not null group by 1, 2""")
def origin_destination(c):
    return C.origin_destination(c)


@query(f"select {SHOWN} from customers where move_count between 2 and 4")
def range_move_count(c):
    return C.range_search(c, "move_count", 2, 4).select(*COLUMNS)


@query("select crid, strftime(last_move, '%Y-%m-%d') as last_move from customers where last_move between date '2022-01-01' and date '2023-06-30' and upper(status) = 'ACTIVE'")
def range_last_move(c):
    r = C.range_search(c, "last_move", dt.date(2022, 1, 1), dt.date(2023, 6, 30), status="ACTIVE")
    return r.select("crid", F.date_format("last_move", "yyyy-MM-dd").alias("last_move"))


@query(f"select {SHOWN} from customers where upper(status) <> 'INACTIVE' and move_count > 1 and state in ('NJ', 'VT', 'LA') and contains(upper(city), 'E')")
def multi_search_and(c):
    return C.multi_search(
        c,
        [
            {"field": "status", "operator": "not_equals", "value": "inactive"},
            {"field": "move_count", "operator": "greater_than", "value": 1},
            {"field": "state", "operator": "in", "value": ["nj", "vt", "la"]},
            {"field": "city", "operator": "contains", "value": "e"},
        ],
    ).select(*COLUMNS)


@query(f"select {SHOWN} from customers where coalesce(move_count > 4, false) or coalesce(upper(relationship_type) = 'SPOUSE', false) or coalesce(branch_count < 3, false)")
def multi_search_or(c):
    return C.multi_search(
        c,
        [
            {"field": "move_count", "operator": "greater_than", "value": 4},
            {"field": "relationship_type", "operator": "equals", "value": "spouse"},
            {"field": "branch_count", "operator": "less_than", "value": 3},
            {"field": "name", "operator": "sounds_like", "value": "x"},
        ],
        "OR",
    ).select(*COLUMNS)


@query("select crid, address from customers where regexp_matches(address, '(?i)^[0-9]{3,4} .*(ridge|hollow)') and upper(status) = 'ACTIVE'")
def regex_search(c):
    return C.regex_search(c, "address", "^[0-9]{3,4} .*(ridge|hollow)", status="ACTIVE").select("crid", "address")


@query("select state, count(*)::bigint as n from customers group by rollup (state)")
def stats_by_state(c):
    """Counts per state, and the grand total in the row without a state."""
    return c.rollup("state").agg(F.count("*").alias("n"))


@query("select coalesce(move_count::varchar, 'UNKNOWN') as value, count(*)::bigint as n from customers where upper(customer_type) = 'RESIDENTIAL' group by 1")
def group_by_field(c):
    return C.group_by(c, "move_count", customer_type="residential")


@query("select count(*)::bigint as n from customers where upper(status) = 'ACTIVE' and move_count >= 1 and contains(lower(city), 'more') and len(list_filter(move_history, lambda m: upper(m.state) = 'VT')) > 0")
def count_by_criteria(c):
    return c.where(C.criteria(status="active", min_moves=1, city="more", from_state="VT")).agg(F.count("*").alias("n"))


@query("""select case when grouping(state) = 0 then 'state' when grouping(city) = 0 then 'city' when grouping(customer_type) = 0 then 'type' else 'status' end as facet,
coalesce(state, city, customer_type, status) as value, count(*)::bigint as n from customers group by grouping sets ((state), (city), (customer_type), (status))""")
def facets_grouping_sets(c):
    """Four facets in one pass."""
    c.createOrReplaceTempView("_facet_rows")
    return c.sparkSession.sql(
        """select case when grouping(state) = 0 then 'state' when grouping(city) = 0 then 'city' when grouping(customer_type) = 0 then 'type' else 'status' end as facet,
        coalesce(state, city, customer_type, status) as value, count(*) as n
        from _facet_rows group by grouping sets ((state), (city), (customer_type), (status))"""
    )


@query("select state, customer_type, count(*)::bigint as n, sum(move_count)::bigint as moves from customers group by cube (state, customer_type)")
def cube_state_type(c):
    return c.cube("state", "customer_type").agg(F.count("*").alias("n"), F.sum("move_count").alias("moves"))


_SHARES = ("state", "customer_type", "status", "move_count", "relationship_type")


@query(" union all ".join(f"select '{f}' as field, {f}::varchar as value, count(*)::bigint as n, round(100.0 * count(*) / sum(count(*)) over (), 4)::double as percent from customers group by {f}" for f in _SHARES))
def distributions(c):
    """Counts and shares by five fields in one pass."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in _SHARES])
    n = c.select(F.explode(fields).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / c.agg(F.count("*")).scalar(), 4))


@query("select status, count(*)::bigint as n, round(100.0 * count(*) / sum(count(*)) over (), 4)::double as percent from customers group by status")
def distribution_report(c):
    n = c.groupBy("status").agg(F.count("*").alias("n"))
    return n.select("status", "n", F.round(100 * F.col("n") / n.agg(F.sum("n")).scalar(), 4).alias("percent"))


@query("select crid, name as value from customers where starts_with(lower(name), 'al') order by lower(name), crid limit 10")
def autocomplete_prefix(c):
    return C.autocomplete(c, "name", "Al")


@query("select min(city) as value, count(*)::bigint as n from customers where starts_with(lower(city), 'b') group by lower(city) order by lower(city) limit 15")
def autocomplete_city(c):
    return C.autocomplete(c, "city", "b", 15)


@query("""select crid, value, round(score, 2) as score from (select arg_min(crid, crid) as crid, arg_min(name, crid) as value, arg_min(s, crid) as score from
(select crid, name, case when starts_with(lower(name), 'or') then 1 + 2.0::double / length(name) when contains(lower(name), 'or') then 0.8::double end as s from customers)
where s > 0.65 group by lower(value := name)) order by 3 desc, 1 limit 10""".replace("lower(value := name)", "lower(name)"))
def autocomplete_fuzzy(c):
    return C.autocomplete_fuzzy(c, "name", "Or")


_SIMILAR = """
, f as (select crid, name, string_split(lower(trim(name)), ' ')[1] as f from customers),
s as (select crid, name, case when f = 'talisa' then 1.0 when starts_with(f, 'talisa') then 0.95 when starts_with('talisa', f) then 0.9 else
  least(1 - levenshtein(f, 'talisa')::double / greatest(length(f), 6) + list_sum(list_transform(range(1, 7), lambda k: starts_with(f, substr('talisa', 1, k))::int))::double / greatest(length(f), 6) * 0.2, 0.89) end as s from f)
select crid, name, round(s, 3)::double as score, case when s >= 0.95 then 'exact' else 'similar' end as match_type
from (select arg_min(crid, crid) as crid, arg_min(name, crid) as name, arg_min(s, crid) as s from (select crid, name, round(s, 6) as s from s) where s >= 0.5 group by lower(name))
order by 3 desc, 1 limit 10"""


@query(_SIMILAR)
def similar_names(c):
    return C.similar_names(c, "Talisa")


@query(f"select {SHOWN}, (select count(*) from customers)::bigint as total, (select count(*) from customers) > 45 as has_more from customers order by crid limit 15 offset 30")
def paginate(c):
    return C.page(c.select(*COLUMNS), ["crid"], 30, 15)


@query(f"select {SHOWN} from (select *, row_number() over (partition by state order by move_count desc, crid) r from customers) where r <= 3")
def topk_per_group(c):
    r = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("move_count"), "crid"))
    return c.withColumn("r", r).where("r <= 3").select(*COLUMNS)


@query(f"select {SHOWN} from customers where move_count >= 4 order by move_count desc, crid limit 100")
def high_movers(c):
    return c.where("move_count >= 4").orderBy(F.desc("move_count"), "crid").limit(100).select(*COLUMNS)


@query("select c.crid, c.name, r.crid as related_crid, r.name as related_name, c.relationship_type, c.state = r.state as same_state from customers c join customers r on c.related_crid = r.crid")
def related_customers(c):
    """The household reference followed by a self-join."""
    r = c.select(F.col("crid").alias("related_crid"), F.col("name").alias("related_name"), F.col("state").alias("related_state"))
    return c.join(r, "related_crid").select("crid", "name", "related_crid", "related_name", "relationship_type", (F.col("state") == F.col("related_state")).alias("same_state"))


@query("select count(*)::bigint as customers, count(distinct state)::bigint as states, count(distinct city)::bigint as cities, count(distinct zip)::bigint as zips from customers")
def distinct_counts(c):
    return c.agg(F.count("*").alias("customers"), *[F.count_distinct(k).alias(a) for k, a in (("state", "states"), ("city", "cities"), ("zip", "zips"))])


SQL["manifest_diff"] = """select coalesce(a.crid, b.crid) as crid, case when b.crid is null then 'removed' when a.crid is null then 'new' when a.h <> b.h then 'changed' else 'same' end as change
from (select crid, concat_ws('|', address, city, state, zip, status) h from (select *, row_number() over (partition by crid order by loaded_at desc) r from customer_snapshots where snapshot_date = date '2023-12-31') where r = 1) a
full outer join (select crid, concat_ws('|', address, city, state, zip, status) h from (select *, row_number() over (partition by crid order by loaded_at desc) r from customer_snapshots where snapshot_date = date '2024-06-30') where r = 1) b on a.crid = b.crid"""


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots compared: new, removed, changed and same, by one full outer join."""
    snaps = table(spark, d, "customer_snapshots")

    def at(day: dt.date, name: str) -> DataFrame:
        one = C.latest(snaps.where(F.col("snapshot_date") == F.lit(day)))
        return one.select("crid", F.concat_ws("|", "address", "city", "state", "zip", "status").alias(name))

    both = at(dt.date(2023, 12, 31), "a").join(at(dt.date(2024, 6, 30), "b"), "crid", "full")
    change = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "new").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return both.select("crid", change.alias("change"))


QUERIES["manifest_diff"] = _manifest


SQL["addr_delta_anti"] = "select crid, case when day = 1 then 'remove' else 'add' end as action from (select crid, count(*) filter (snapshot_date = date '2024-06-30') as b, count(*) filter (snapshot_date = date '2023-12-31') as a, case when count(*) filter (snapshot_date = date '2023-12-31') > 0 then 1 else 2 end as day from customer_snapshots where snapshot_date in (date '2023-12-31', date '2024-06-30') group by crid) where (a = 0) <> (b = 0)"


def _delta(spark: SparkSession, d: str) -> DataFrame:
    snaps = table(spark, d, "customer_snapshots").where("crid is not null")
    source, index = (snaps.where(F.col("snapshot_date") == F.lit(x)).select("crid").distinct() for x in (dt.date(2024, 6, 30), dt.date(2023, 12, 31)))
    return C.delta(source, index, "crid")


QUERIES["addr_delta_anti"] = _delta


@query("""select crid, address, status from customers where state <> 'NJ' union all
select crid, upper(address), 'REVIEW' from customers where state = 'NJ'""")
def upsert_by_key(c):
    rows = c.select("crid", "address", "status", "state")
    changes = rows.where("state = 'NJ'").select("crid", F.upper("address").alias("address"), F.lit("REVIEW").alias("status"))
    keep = rows.where("state is not null").select("crid", "address", "status")
    return C.upsert(keep, changes, "crid")


@query(
    """select crid, name, city, (contains(lower(name), 'alenka') or contains(lower(address), 'alenka') or contains(lower(city), 'alenka'))::int
+ (contains(lower(name), 'jasper') or contains(lower(address), 'jasper') or contains(lower(city), 'jasper'))::int
+ (contains(lower(name), 'gate') or contains(lower(address), 'gate') or contains(lower(city), 'gate'))::int as terms from customers where terms > 0"""
)
def fuzzy_union(c):
    """Rows with any of the first three longer terms, each once."""
    return C.any_term(c, "Alenka of Jasper gate street").select("crid", "name", "city", "terms")


@query(
    """select crid, name, round((2 * contains(lower(name), 'ilvan')::int + 3 * contains(lower(address), 'ilvan')::int + 2 * contains(lower(city), 'ilvan')::int
+ 2 * contains(lower(name), 'knoll')::int + 3 * contains(lower(address), 'knoll')::int + 2 * contains(lower(city), 'knoll')::int)::double / 14, 6) as score from customers where score > 0 order by 3 desc, 1 limit 20"""
)
def weighted_search(c):
    """Weighted text search over name, address and city."""
    return C.weighted_search(c, "Ilvan Knoll", 20).select("crid", "name", "score")


@query("""select key, arg_max(crid, crid) as crid, count(distinct crid)::bigint as shared from (select crid, unnest(list_distinct([lower(address || ', ' || city || ', ' || state || ' ' || coalesce(zip, '')), lower(address || ', ' || city || ', ' || state), lower(address || ', ' || city), lower(address || ' ' || coalesce(zip, '')), lower(address)])) as key from customers where address is not null and city is not null and state is not null) group by 1""")
def cache_warmup(c):
    """Five keys a customer for completion; of customers with one key the last counts."""
    return C.completion_keys(c)


@query("select state, lower(city) as city, count(distinct zip)::bigint as zips, string_agg(distinct zip, ',' order by zip) as listed from customers where zip is not null group by 1, 2")
def zips_of_places(c):
    z = c.where("zip is not null").groupBy("state", F.lower("city").alias("city")).agg(F.array_sort(F.collect_set("zip")).alias("z"))
    return z.select("state", "city", F.size("z").cast("long").alias("zips"), F.array_join("z", ",").alias("listed"))


def _known_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids asked for in queries, by whether there is such a customer."""
    q = table(spark, d, "query_events").select(F.regexp_extract(F.upper("query_text"), r"(CRID-\d+)", 1).alias("crid"), "trace_id").where("crid <> ''")
    there = customers(spark, d).select("crid")
    counts = q.groupBy("crid").agg(F.count_distinct("trace_id").alias("asked"))
    known = counts.join(there, "crid", "left_semi").withColumn("known", F.lit(True))
    return known.unionByName(counts.join(there, "crid", "left_anti").withColumn("known", F.lit(False)))


QUERIES["ids_asked_for"] = _known_ids
SQL["ids_asked_for"] = f"""with {SNAPSHOT_CUSTOMERS}, q as (select regexp_extract(upper(query_text), '(CRID-\\d+)', 1) as crid, trace_id from query_events)
select crid, count(distinct trace_id)::bigint as asked, crid in (select crid from customers) as known from q where crid <> '' group by 1"""


@query("select 'city' as way, crid, city from customers where contains(lower(city), 'gate')")
def strategy_cascade(c):
    """The first way of searching that finds anything: by id, by city, by any term."""
    ways = (("id", lambda: C.lookup(c, "CRID-999999")), ("city", lambda: C.search(c, city="gate")), ("terms", lambda: C.any_term(c, "gate")))
    name, found = C.first_found(ways)
    return found.select(F.lit(name).alias("way"), "crid", "city")
