"""Queries on sketches and on several indexes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import sketches as K
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


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_events").where("query_text is not null").select(F.lower(F.trim("query_text")).alias("query"), "ts")


def _cells(item: str, hashes: int, width: int) -> str:
    return "[" + ", ".join(f"(('0x' || substr(md5({item}), {1 + 8 * i}, 8))::bigint % {width})::int" for i in range(hashes)) + "]"


_Q = "q as (select lower(trim(query_text)) as query, ts from query_events where query_text is not null)"


@query(
    f"""with {_Q}, c as (select query, unnest(list_transform({_cells("query", 4, 4096)}, lambda c, i: {{'r': i, 'c': c}})) as x from q), s as (select x.r as r, x.c as c, count(*) n from c group by 1, 2)
select query, min(n)::bigint as estimate from (select distinct query, x.r as r, x.c as c from c) a join s using (r, c) group by 1"""
)
def query_counts_sketch(spark, d):
    """Counts of all queries by a count-min sketch of fixed size."""
    q = _asked(spark, d)
    return K.estimates(q, "query", K.count_min(q, "query"))


@query(
    f"""with {_Q}, b as (select distinct unnest({_cells("query", 4, 65536)}) as cell from q where ts < timestamp '2025-05-01'), a as (select distinct query from q),
c as (select query, unnest(list_distinct({_cells("query", 4, 65536)})) as cell from a) select query, bool_and(cell in (select cell from b)) as seen from c group by 1"""
)
def query_seen(spark, d):
    """Whether a query may have been asked before a day, by a Bloom filter."""
    q = _asked(spark, d)
    return K.may_be_in(q, "query", K.bloom(q.where("ts < timestamp_ntz'2025-05-01'"), "query"))


@query(
    f"""with i as (select doc_id::varchar as item, category from documents), c as (select category is not distinct from 'general' as gone, unnest(list_distinct({_cells("item", 4, 65536)})) as cell from i),
n as (select cell, sum(case when gone then 0 else 1 end)::bigint as n from c group by 1) select cell, n from n where n > 0"""
)
def documents_filter_with_deletion(spark, d):
    """A filter of document ids from which those of one category were deleted again."""
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("item"), "category")
    return K.counting_filter(t, t.where("category = 'general'"), "item")


@query(f"with {_Q} select query, round(sum(pow(0.5, (epoch(timestamp '2025-06-01') - floor(epoch(ts))) / 604800)), 6)::double as weight from q where ts is not null group by 1")
def query_heat(spark, d):
    """Queries by occurrences that lose half of their worth in a week."""
    w = K.decayed(_asked(spark, d), "query", "ts", F.lit("2025-06-01").cast("timestamp"), 604_800)
    return w.select("query", F.round("weight", 6).alias("weight"))


@query(
    f"""with {SNAPSHOT_CUSTOMERS}, gone as (select crid from customers where upper(status) = 'INACTIVE'), i as (select 'customers' as source, crid from customers union all select 'snapshots', crid from customer_snapshots where crid is not null),
k as (select * from i where crid not in (select crid from gone)) select source, count(*)::bigint as n, count(distinct crid)::bigint as ids from k group by 1"""
)
def deleted_everywhere(spark, d):
    """Ids deleted from several indexes at once by an anti join."""
    c = customers(spark, d)
    gone = c.where("upper(status) = 'INACTIVE'").select("crid")
    both = c.select(F.lit("customers").alias("source"), "crid").unionByName(table(spark, d, "customer_snapshots").where("crid is not null").select(F.lit("snapshots").alias("source"), "crid"))
    return both.join(gone, "crid", "left_anti").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("crid").alias("ids"))


_STOP = ("the", "a", "an", "of", "in", "for", "to", "and", "me", "show", "is", "are", "on", "with")


@query(
    f"""with w as (select query_text, list_sort(list_filter(regexp_split_to_array(lower(trim(query_text)), '[^a-z0-9]+'), lambda x: x <> '' and x not in {_STOP})) as w, success from query_events where query_text is not null)
select substr(sha256(array_to_string(w, ' ')), 1, 16) as key, count(*)::bigint as n, count(distinct query_text)::bigint as spellings, count(*) filter (not success)::bigint as failures from w group by 1"""
)
def failures_by_word_key(spark, d):
    """Failures under a key that doesn't depend on the order of the words."""
    words = F.array_sort(F.filter(F.split(F.lower(F.trim("query_text")), "[^a-z0-9]+"), lambda x: (x != "") & ~x.isin(*_STOP)))
    e = table(spark, d, "query_events").where("query_text is not null").withColumn("key", F.substring(F.sha2(F.array_join(words, " "), 256), 1, 16))
    return e.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("query_text").alias("spellings"), F.count_if(~F.col("success")).alias("failures"))


@query(
    r"""with q as (select distinct query_text, lower(query_text) as t from query_events where query_text is not null)
select query_text, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\b\d{5}\b'))), ',') as zips, array_to_string(list_sort(list_distinct(regexp_extract_all(t, 'crid[-\s]?\d+'))), ',') as crids,
  nullif(regexp_extract(t, '\b(?:since|after|from) (20\d\d)\b', 1), '') as from_year, nullif(regexp_extract(t, '\b(?:until|before|to) (20\d\d)\b', 1), '') as to_year,
  try_cast(nullif(regexp_extract(t, '\b(?:last|past) (\d+) (?:day|week|month|year)s?\b', 1), '') as int) as amount, nullif(regexp_extract(t, '\b(?:last|past) (?:\d+ )?(day|week|month|year)s?\b', 1), '') as unit from q"""
)
def nl_entities(spark, d):
    """All ZIPs and ids of a plain-language query, and the range of time it names."""
    t = F.lower("query_text")
    q = table(spark, d, "query_events").where("query_text is not null").select("query_text").distinct()
    every = lambda p: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(p), F.lit(0)))), ",")
    one = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return q.select(
        "query_text",
        every(r"\b\d{5}\b").alias("zips"),
        every(r"crid[-\s]?\d+").alias("crids"),
        one(r"\b(?:since|after|from) (20\d\d)\b").alias("from_year"),
        one(r"\b(?:until|before|to) (20\d\d)\b").alias("to_year"),
        one(r"\b(?:last|past) (\d+) (?:day|week|month|year)s?\b").cast("int").alias("amount"),
        one(r"\b(?:last|past) (?:\d+ )?(day|week|month|year)s?\b").alias("unit"),
    )


@query("select vec_id, case when len(e) >= 96 then e[1:96] else list_concat(e, list_transform(range(96 - len(e)), lambda x: 0.0::float)) end as fitted, len(e)::int as had from (select vec_id, embedding::float[] as e from embeddings where embedding is not null)")
def embed_fit(spark, d):
    """Vectors cut or padded with zeros to one length."""
    e = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<float>").alias("e"))
    pad = F.concat("e", F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.lit(96) - F.size("e"))))
    return e.select("vec_id", F.slice(pad, 1, 96).alias("fitted"), F.size("e").alias("had"))
