"""Queries on embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.operators import vectors as V
from wayfold.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(table(spark, d, "embeddings"))

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


_Q = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_QSQL = "[" + ", ".join(map(str, _Q)) + "]::double[]"
_COS = "round(list_cosine_similarity(embedding::double[], {0}), 6)"


@query(f"select vec_id, label, {_COS.format(_QSQL)} as score from embeddings order by 3 desc, 1 limit 10")
def knn_cosine(v):
    return V.nearest(v, _Q).select("vec_id", "label", "score")


@query(f"select vec_id, label, {_COS.format(_QSQL)} as score from embeddings where label in (1, 3, 5) and {_COS.format(_QSQL)} >= 0.05 order by 3 desc, 1 limit 10")
def knn_filtered(v):
    """The filter comes before the ranking."""
    return V.nearest(v, _Q, where=F.col("label").isin(1, 3, 5), least=0.05).select("vec_id", "label", "score")


@query(f"select vec_id, label, score from (select vec_id, label, {_COS.format(_QSQL)} as score, row_number() over (partition by label order by {_COS.format(_QSQL)} desc, vec_id) r from embeddings) where r <= 3")
def knn_per_label(v):
    s = v.select("vec_id", "label", F.round(V.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in _Q])), 6).alias("score"))
    r = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))
    return s.withColumn("r", r).where("r <= 3").drop("r")


_MANY = """n as (select q.vec_id as query_id, v.vec_id, v.label, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score
from embeddings q, embeddings v where q.vec_id % 20 = 0 and v.vec_id <> q.vec_id),
k as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from n)"""


@query(f"with {_MANY} select query_id, vec_id, score, rank::int as rank from k where rank <= 5")
def knn_many(v):
    """Every vector whose id is divisible by 20 against all others."""
    return V.nearest_of_many(v, v.where("vec_id % 20 = 0"), 5).select("query_id", "vec_id", "score", "rank")


@query(f"with {_MANY}, m as (select query_id, label, count(*) votes, min(rank) first from k where rank <= 3 group by 1, 2) select query_id, arg_max(label, (votes, -first)) as route, max(votes)::bigint as votes from m group by 1")
def route_vote(v):
    return V.vote(V.nearest_of_many(v, v.where("vec_id % 20 = 0"), 3))


@query(f"with t as (select label, {_COS.format(_QSQL)} as score from embeddings order by 2 desc, vec_id limit 50) select label, count(*)::bigint as hits, round(avg(score), 6)::double as score from t group by 1")
def route_avg(v):
    return V.nearest(v, _Q, 50).groupBy("label").agg(F.count("*").alias("hits"), F.round(F.avg("score"), 6).alias("score"))


@query("select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 5) as norm, round(embedding[1]::double / sqrt(list_dot_product(embedding::double[], embedding::double[])), 5) + 0.0::double as first, len(embedding)::int as dim from embeddings")
def embed_normalize(v):
    e = F.col("embedding")
    return v.select("vec_id", F.round(V.norm(e), 5).alias("norm"), (F.round(F.get(V.unit(e), F.lit(0)), 5) + F.lit(0.0)).alias("first"), F.size(e).alias("dim"))


@query("select vec_id, round(list_avg(embedding[1:4]::double[]), 5) + 0.0::double as first from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: isnan(x))) = 0")
def embed_pool(v):
    v = v.where(V.valid(F.col("embedding"), 64))
    p = F.aggregate(F.slice("embedding", 1, 4), F.lit(0.0), lambda s, x: s + x.cast("double")) / 4
    return v.select("vec_id", (F.round(p, 5) + F.lit(0.0)).alias("first"))  # no negative zero


@query("select label, count(*)::bigint as n, round(avg(embedding[1]::double), 6)::double as c1, round(avg(embedding[64]::double), 6)::double as c64 from embeddings group by 1")
def label_centroids(v):
    return v.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.get("embedding", F.lit(0)).cast("double")), 6).alias("c1"), F.round(F.avg(F.get("embedding", F.lit(63)).cast("double")), 6).alias("c64"))


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Documents by words and by hashed embeddings together."""
    return V.hybrid(table(spark, d, "documents"), "letter came back without a unit", 16, 20).select("doc_id", "score")


_H = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
_V = "list_transform(range(0, 16), lambda i: len(list_filter(list_transform(" + _H + ", lambda w: ('0x' || substr(md5(w), 1, 8))::bigint % 16), lambda b: b = i))::double)"
QUERIES["hybrid_search"] = _hybrid
SQL["hybrid_search"] = f"""with q as (select {_V.format("'letter came back without a unit'")} as q),
d as (select doc_id, len(list_intersect(list_distinct({_H.format("text")}), ['letter', 'came', 'back', 'without', 'a', 'unit']))::double / 6 as words, {_V.format("text")} as v from documents where text is not null)
select doc_id, round(0.5 * words + 0.5 * coalesce(case when list_sum(v) > 0 then list_cosine_similarity(v, q) end, 0), 6) as score from d, q order by 2 desc, 1 limit 20"""
