"""Operators on embeddings: exact nearest neighbours, votes, normalisation."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.text import overlap
from wayfold.runtime import cut

#: Most query vectors a block has; they are sent to every task.
MOST_QUERIES = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def pooled(a: Column, size: int, dim: int) -> Column:
    """Averages over ``size`` equal stretches of a vector of ``dim`` values, at length one."""
    step = dim // size
    return unit(F.array(*[F.aggregate(F.slice(a, i * step + 1, step), F.lit(0.0), lambda s, x: s + x) / step for i in range(size)]))


def valid(a: Column, dim: int) -> Column:
    """Whether a vector has the dimension and only finite values."""
    return F.coalesce((F.size(a) == dim) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def nearest(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None, least: float = -1.0) -> DataFrame:
    """The k most similar vectors after the filter, by cosine; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    hits = vectors if where is None else vectors.where(where)
    hits = hits.withColumn("score", F.round(cosine(F.col("embedding"), q), 6)).where(F.col("score") >= least)
    return hits.orderBy(F.desc("score"), "vec_id").limit(k)


def nearest_of_many(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest others of every query row, exact; (query_id, vec_id, label, score, rank).

    A block of at most MOST_QUERIES queries goes to every task and each task keeps its
    own k best per query before anything is shuffled, so that a query costs k rows a
    task.  More queries are worked on block by block, the driver holding two blocks at
    most.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(asked: list) -> DataFrame:
        return _nearest_of_block(vectors, asked, k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    stated = queries.select("vec_id", "embedding").where("embedding is not null")
    asked = stated.limit(MOST_QUERIES + 1).collect()
    if not asked:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, label int, score double, rank int")
    if len(asked) <= MOST_QUERIES:
        return best(asked)
    # Of about half the size, so that chance makes none larger; repeated ids are cut in slices.
    blocks = -(-2 * stated.count() // MOST_QUERIES)
    found = []
    for b in range(blocks):
        asked = stated.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        found += [cut(best(asked[i : i + MOST_QUERIES])) for i in range(0, len(asked), MOST_QUERIES)]
    whole = reduce(DataFrame.unionByName, found).drop("rank")
    return whole.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest_of_block(vectors: DataFrame, asked: list, k: int) -> DataFrame:
    """(query_id, vec_id, label, score): each task's k best of every query."""
    schema = "query_id bigint, vec_id bigint, label int, score double"
    ids = np.array([r["vec_id"] for r in asked])
    q = np.array([r["embedding"] for r in asked], float)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def run(batches):
        best: pd.DataFrame | None = None
        for b in batches:
            b = b[b["embedding"].notna()]
            if not len(b):
                continue
            m = np.array(b["embedding"].tolist(), float)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            s = np.round(q @ m.T, 6)
            own = b["vec_id"].to_numpy()
            s[ids[:, None] == own[None, :]] = -2.0
            parts = [] if best is None else [best]
            # Equal scores at the edge are kept, so that ties go by id in the end.
            edge = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
            tied = np.argwhere((s >= edge[:, None]) & (s > -2.0))
            parts.append(pd.DataFrame({"query_id": ids[tied[:, 0]], "vec_id": own[tied[:, 1]], "label": b["label"].to_numpy()[tied[:, 1]], "score": s[tied[:, 0], tied[:, 1]]}))
            best = pd.concat(parts).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if best is not None:
            yield best

    return vectors.select("vec_id", "embedding", "label").mapInPandas(run, schema)


def vote(neighbours: DataFrame, by: str = "query_id", label: str = "label") -> DataFrame:
    """The majority label of the neighbours; equal votes go to the better best rank."""
    n = neighbours.groupBy(by, label).agg(F.count("*").alias("votes"), F.min("rank").alias("first"))
    return n.groupBy(by).agg(F.max_by(label, F.struct("votes", (-F.col("first")).alias("f"))).alias("route"), F.max("votes").alias("votes"))


def hashed_vector(text: str, dim: int) -> list[float]:
    """Words counted in ``dim`` buckets by their MD5."""
    out = [0.0] * dim
    for w in re.findall("[a-z0-9]+", text.lower()):
        out[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1.0
    return out


def hashed(text: str, dim: int) -> Column:
    """A fixed embedding by the hashing trick, in Arrow batches; a stand-in for a model. Null texts have none."""

    @F.pandas_udf("array<double>")
    def embed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else hashed_vector(t, dim))

    return embed(F.col(text))


def hybrid(docs: DataFrame, query: str, dim: int = 16, limit: int = 10) -> DataFrame:
    """Half the share of query words a text holds, half the cosine of hashed embeddings; a top-k, ties by id."""
    near = cosine(F.col("_v"), F.array(*[F.lit(x) for x in hashed_vector(query, dim)]))
    score = 0.5 * overlap(F.col("text"), query) + 0.5 * F.coalesce(near, F.lit(0.0))
    return docs.where("text is not null").withColumn("_v", hashed("text", dim)).withColumn("score", F.round(score, 6)).drop("_v").orderBy(F.desc("score"), "doc_id").limit(limit)
