"""Queries on documents and on texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import text as X
from wayfold.operators import documents as D
from wayfold.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(table(spark, d, name))

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


_NORM = r"trim(regexp_replace(lower(text), '[ \t\r\n\f\x0b]+', ' ', 'g'))"
_BARE = "regexp_replace(" + _NORM + r""", '[.,;:!?''"()\[\]{}]', '', 'g')"""
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))"


@query("documents", f"select doc_id, round(len(list_intersect({_WORDS}, ['address', 'clerk', 'zip', 'street']))::double / 4, 6) as score from documents where len(list_intersect({_WORDS}, ['address', 'clerk', 'zip', 'street'])) > 0 order by 2 desc, 1 limit 20")
def kb_keyword_search(t):
    return D.keyword_search(t, "clerk street address ZIP", 20).select("doc_id", "score")


@query("documents", f"select doc_id, round(len(list_intersect({_WORDS}, ['letter', 'unit']))::double / 2, 6) as score from documents where len(list_intersect({_WORDS}, ['letter', 'unit'])) > 0 and list_has_any(tags, ['po-box', 'unit']) and category = 'general' order by 2 desc, 1 limit 10")
def kb_tags_any(t):
    return D.keyword_search(t, "unit letter", 10, tags=["po-box", "unit"], category="general").select("doc_id", "score")


@query("documents", "select doc_id from documents where list_has_all(tags, ['latency', 'zip'])")
def kb_tags_all(t):
    return t.where(F.size(F.array_except(F.array(F.lit("latency"), F.lit("zip")), "tags")) == 0).select("doc_id")


@query("documents", "select filename, count(*)::bigint as chunks, arg_min(doc_id, doc_id) as first_id, min(category) as category from documents group by filename")
def kb_list_documents(t):
    return t.groupBy("filename").agg(F.count("*").alias("chunks"), F.min("doc_id").alias("first_id"), F.min("category").alias("category"))


@query("documents", "select tag, count(*)::bigint as n from (select unnest(tags) tag from documents) group by 1")
def kb_tag_facets(t):
    return t.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("documents", "select coalesce(category, 'none') as category, coalesce(audience, 'none') as audience, count(*)::bigint as n, count(distinct filename)::bigint as files, sum(n_chars)::bigint as chars from documents group by 1, 2")
def kb_stats(t):
    return t.groupBy(*[F.coalesce(c, F.lit("none")).alias(c) for c in ("category", "audience")]).agg(F.count("*").alias("n"), F.count_distinct("filename").alias("files"), F.sum("n_chars").alias("chars"))


@query("documents", f"select doc_id, substr(sha256({_NORM}), 1, 16) as hash from documents where text is not null")
def content_hashes(t):
    return t.where("text is not null").select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@query(
    "documents",
    f"""with h as (select doc_id, source, substr(sha256({_BARE}), 1, 16) as hash, n_chars::double as score from documents where text is not null),
b as (select *, row_number() over (partition by hash order by score desc, doc_id) r, count(*) over (partition by hash) copies from h),
s as (select hash, list_sort(list(distinct source) filter (source is not null)) sources from h group by hash)
select b.hash, b.doc_id, b.source, coalesce(array_to_string(list_filter(s.sources, lambda x: b.source is null or x <> b.source), ','), '') as alternates, copies::bigint as copies from b join s on b.hash = s.hash where r = 1""",
)
def content_hash_dedupe(t):
    return D.best_of_copies(t, F.col("n_chars").cast("double"))


@query("documents", f"""with h as (select doc_id, tags, substr(sha256({_NORM}), 1, 16) as hash, coalesce(len(tags), 0) + (category is not null)::int as rich from documents where text is not null),
b as (select *, row_number() over (partition by hash order by rich desc, doc_id) r, count(*) over (partition by hash) c from h),
u as (select hash, array_to_string(list_sort(list_distinct(flatten(list(coalesce(tags, []))))), ',') as tags from h group by hash)
select b.doc_id, u.tags, c::bigint as merged_from from b join u on b.hash = u.hash where r = 1""")
def merge_chunks(t):
    return D.merge_copies(t)


@query(
    "documents",
    r"""with w as (select doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\r\n\f\x0b]+'), lambda x: x <> ''))) ws from documents where text is not null),
c as (select ws, min(doc_id) as class_id from w where len(ws) > 0 group by ws),
l as (select a.class_id a, b.class_id b, len(list_intersect(a.ws, b.ws)) s, len(a.ws) + len(b.ws) n from c a join c b on a.class_id < b.class_id and len(a.ws) >= 0.95 * len(b.ws) and len(b.ws) >= 0.95 * len(a.ws)),
k as (select unnest([a, b]) as class_id from l where s::double / (n - s) >= 0.95)
select w.doc_id, c.class_id, coalesce(n.n, 0)::bigint as links from w join c on w.ws = c.ws left join (select class_id, count(*) n from k group by 1) n on n.class_id = c.class_id""",
)
def near_copies(t):
    return D.near_copies(t)


@query("documents", "select source, count(*)::bigint as n, sum(copies - 1)::bigint as spare from (select source, count(*) copies from documents where text is not null and text <> '' group by source, text) group by source")
def copies_per_source(t):
    g = t.where("text is not null and text <> ''").groupBy("source", F.sha2("text", 256).alias("h")).agg(F.count("*").alias("c"))
    return g.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("c") - 1).alias("spare"))


@query("documents", "select doc_id, category from (select *, row_number() over (partition by category order by doc_id) r from documents) where (r - 1) % greatest(1, (select count(*) from documents) // 100) = 0")
def stratified_sample(t):
    return D.stratified(t, "category", "doc_id", 100).select("doc_id", "category")


@query("documents")
def chunk_words(t):
    return D.chunk_words(t)


@query("documents")
def chunk_context(t):
    """Chunks with previews of their neighbours."""
    return D.neighbours(D.chunk_words(t, 64), "doc_id", "chunk_index", "chunk")


@query("documents")
def html_text(t):
    html = F.concat(F.lit("<html><head><title>x</title></head><body><p>"), F.coalesce("text", F.lit("")), F.lit("</p><script>var a</script></body></html>"))
    return D.plain_html(t.select("doc_id", html.alias("html")), "doc_id", "html")


@query("documents", r"select doc_id, len(regexp_extract_all(text, '\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b'))::int as ssn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b', '[REDACTED-SSN]', 'g'), '\b(?:\d{4}[-\s]?){3}\d{4}\b', '[REDACTED-CREDIT_CARD]', 'g'), '\b\d{8,17}\b', '[REDACTED-BANK_ACCOUNT]', 'g'), '\b(?:\+1[-\s]?)?\(?\d{3}\)?[-\s]?\d{3}[-\s]?\d{4}\b', '[REDACTED-PHONE]', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[REDACTED-EMAIL]', 'g') as clean from documents where text is not null")
def pii_redact(t):
    clean, counts = X.redact(F.col("text"))
    return t.where("text is not null").select("doc_id", counts["ssn"].cast("int").alias("ssn"), clean.alias("clean"))


@query("query_events", r"""select coalesce(rule, 'none') as rule, count(*)::bigint as n from (select case when regexp_matches(query_text, '(?i)\b(ssn|social\s*security(\s+number)?)\b') then 'pii' when regexp_matches(query_text, '(?i)\b(credit\s*card|bank\s*account|routing\s*number)\b') then 'financial'
when regexp_matches(query_text, '(?i)\b(password|api[_\s]?key|auth[_\s]?token|secret[_\s]?key)\b') then 'credentials' when regexp_matches(query_text, '(?i)^(what(''?s| is) the weather|write (me )?a (poem|story|joke)|tell (me )?a joke)\b') then 'offtopic' end as rule from query_events) group by 1""")
def guardrail_flags(t):
    return t.groupBy(F.coalesce(X.refusal(F.col("query_text")), F.lit("none")).alias("rule")).agg(F.count("*").alias("n"))


@query("documents", r"select doc_id, regexp_replace(text, '(?i)\b(clerk|register)\b', '<mark>\1</mark>', 'g') as marked from documents where regexp_matches(text, '(?i)\b(clerk|register)\b')")
def highlight_terms(t):
    return t.where(F.col("text").rlike(r"(?i)\b(clerk|register)\b")).select("doc_id", X.highlight(F.col("text"), ["clerk", "register"]).alias("marked"))


@query("test_addresses_fuzzy", r"select id, trim(regexp_replace(regexp_replace(substr(input, 1, 500), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t\r\n]+', ' ', 'g')) as clean from test_addresses_fuzzy where input is not null")
def sanitize_text(t):
    """Address inputs cut to the 500 characters an address may have, and cleaned."""
    return t.where("input is not null").select("id", X.sanitize(F.col("input")).alias("clean"))


_SDX = "regexp_replace(upper({0}), '[^A-Z]', '', 'g')"


def _soundex_sql(c: str) -> str:
    s = _SDX.format(c)
    codes = "'BFPVCGJKQSXZDTLMNR', '111122222222334556'"
    rest = f"translate(regexp_replace({s}, '[AEIOUHWY]', '', 'g'), {codes})"
    first = f"substr({s}, 1, 1)"
    vowel = f"regexp_matches({first}, '[AEIOUHWY]')"
    tail = f"case when {vowel} then {rest} else substr({rest}, 2) end"
    for k in "123456":
        tail = f"regexp_replace({tail}, '{k}+', '{k}', 'g')"
    own = f"translate({first}, {codes})"
    tail = f"case when not {vowel} and starts_with({tail}, {own}) then substr({tail}, 2) else {tail} end"
    return f"case when {s} = '' then '0000' else substr({first} || {tail} || '000', 1, 4) end"


@query("city_ref", f"select city_ref_id, {_soundex_sql('city')} as code from city_ref")
def soundex_ref(t):
    return t.select("city_ref_id", X.soundex_code(F.col("city")).alias("code"))


@query("city_ref")
def sound_codes(t):
    return t.select("city_ref_id", "city", X.sound_code(F.col("city")).alias("code"))


@query("city_ref", "select a.city_ref_id as a, b.city_ref_id as b, round(1 - levenshtein(a.city, b.city)::double / greatest(length(a.city), length(b.city)), 6) as similarity from city_ref a join city_ref b on a.state = b.state and a.city_ref_id < b.city_ref_id where 1 - levenshtein(a.city, b.city)::double / greatest(length(a.city), length(b.city)) >= 0.5")
def levenshtein_sim(t):
    """Similar names within a state: blocked, then compared."""
    a = t.select(F.col("city_ref_id").alias("a"), "state", F.col("city").alias("ca"))
    b = t.select(F.col("city_ref_id").alias("b"), "state", F.col("city").alias("cb"))
    s = F.round(X.levenshtein_similarity(F.col("ca"), F.col("cb")), 6)
    return a.join(b, "state").where("a < b").select("a", "b", s.alias("similarity")).where("similarity >= 0.5")


@query("test_addresses_validation", """with v as (select w, count(*) n from (select unnest(list_distinct(list_filter(regexp_split_to_array(lower(address), '[^a-z]+'), lambda w: length(w) >= 4))) w from test_addresses_validation) group by 1)
select a.w as word, arg_max(b.w, (b.n, b.w)) as suggestion from v a join v b on b.n > a.n * 3 and abs(length(a.w) - length(b.w)) <= 1 and levenshtein(a.w, b.w) = 1 group by 1""")
def spell_check(t):
    """Rare words with a frequent one at one edit; candidates share a word with one letter left out."""
    w = t.select(F.explode(F.array_distinct(F.filter(F.split(F.lower("address"), "[^a-z]+"), lambda x: F.length(x) >= 4))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    cuts = F.expr("array_distinct(concat(array(w), transform(sequence(1, length(w)), i -> concat(substring(w, 1, i - 1), substring(w, i + 1)))))")
    k = w.select("w", "n", F.explode(cuts).alias("k"))
    a, b = k.toDF("word", "na", "k"), k.toDF("other", "nb", "k")
    near = a.join(b, "k").where("nb > na * 3 and levenshtein(word, other) = 1").select("word", "other", "nb").distinct()
    return near.groupBy("word").agg(F.max_by("other", F.struct("nb", "other")).alias("suggestion"))


@query("documents", "select doc_id, lag(doc_id) over (partition by filename order by doc_id) as before, lead(doc_id) over (partition by filename order by doc_id) as after from documents where filename is not null")
def chunk_context_lag(t):
    """The ids before and after in each file; a large file is worked on in ranges of ids."""
    return D.adjacent(t.where("filename is not null"), "filename", "doc_id").select("doc_id", "before", "after")


@query("documents", "select doc_id, category, n_chars, (select count(*) from documents where category = 'general' and n_chars between 200 and 900)::bigint as total from documents where category = 'general' and n_chars between 200 and 900 order by n_chars desc, doc_id limit 50 offset 20")
def admin_list(t):
    """One page of documents of a category and a range of lengths."""
    hits = t.where("category = 'general' and n_chars between 200 and 900")
    return hits.orderBy(F.desc("n_chars"), "doc_id").offset(20).limit(50).select("doc_id", "category", "n_chars", hits.agg(F.count("*")).scalar().alias("total"))


@query("documents", f"select hash, string_agg(distinct source, ',' order by source) as sources, count(*)::bigint as occurrences from (select source, substr(sha256({_NORM}), 1, 16) as hash from documents where text is not null and source is not null) group by hash having count(distinct source) > 1")
def cross_index_content(t):
    """Texts that stand in more than one source."""
    h = t.where("text is not null and source is not null").select("source", X.content_hash(F.col("text")).alias("hash"))
    g = h.groupBy("hash").agg(F.array_sort(F.collect_set("source")).alias("s"), F.count("*").alias("occurrences")).where("size(s) > 1")
    return g.select("hash", F.array_join("s", ",").alias("sources"), "occurrences")


@query("documents", r"select kind, value, count(distinct doc_id)::bigint as documents from (select doc_id, 'crid' as kind, unnest(regexp_extract_all(text, 'CRID-\d{6}')) as value from documents union all select doc_id, 'date', unnest(regexp_extract_all(text, '\b20\d\d-\d\d-\d\d\b')) from documents) group by 1, 2")
def extract_entities(t):
    """Customer ids and dates mentioned, by how many documents."""

    def of(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(of("crid", r"CRID-\d{6}"), of("date", r"\b20\d\d-\d\d-\d\d\b"))
    e = t.select("doc_id", F.explode(found).alias("e")).select("doc_id", "e.*")
    return e.groupBy("kind", "value").agg(F.count_distinct("doc_id").alias("documents"))


@query(
    "documents",
    f"""with h as (select count(*) as n, count(*) - count(distinct substr(sha256({_NORM}), 1, 16)) as dup, count(*) filter (indexed_at < timestamp '2025-01-01') as stale, count(distinct category) filter (category is null) as gaps from documents where text is not null)
select n::bigint as total, dup::bigint as duplicates, round(greatest(0, 1 - least(0.3, 3.0 * dup / n) - least(0.2, 2.0 * stale / n) - least(0.2, 0.04 * gaps)), 6)::double as health from h""",
)
def index_health(t):
    t = t.where("text is not null")
    h = t.agg(
        F.count("*").alias("total"),
        (F.count("*") - F.count_distinct(X.content_hash(F.col("text")))).alias("duplicates"),
        F.count_if(F.col("indexed_at") < F.lit("2025-01-01").cast("timestamp_ntz")).alias("stale"),
    )
    health = 1 - F.least(F.lit(0.3), 3.0 * F.col("duplicates") / F.col("total")) - F.least(F.lit(0.2), 2.0 * F.col("stale") / F.col("total"))
    return h.select("total", "duplicates", F.round(F.greatest(F.lit(0.0), health), 6).alias("health"))


def _related(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one category that share most tags with a document; the best three for every twentieth id.

    Every row whose id is divisible by 20 is asked for, against all rows of its category.
    """
    t = table(spark, d, "documents").where("size(tags) > 0 and category is not null").select("doc_id", "category", "tags")
    return D.related_by_tags(t, F.col("doc_id") % 20 == 0, 3)


QUERIES["related_documents"] = _related
SQL["related_documents"] = """with t as (select doc_id, category, tags from documents where len(tags) > 0 and category is not null),
p as (select q.doc_id as query_id, t.doc_id, len(list_intersect(q.tags, t.tags)) s, len(q.tags) + len(t.tags) n from t q join t on q.category = t.category and q.doc_id % 20 = 0 and q.doc_id <> t.doc_id),
r as (select query_id, doc_id, round(s::double / (n - s), 6) as score from p where s > 0)
select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from r) where rank <= 3"""
