"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.bpe import DEFAULT_RANKS, count_tokens
from wayfold.runtime import bounded_rows, cut

#: Most rows the table of targets may have; it is a parameter, not data.
MOST_TARGETS = 10_000


def repetition_rates(targets: list[tuple[str, float, int, int]]) -> dict[str, float]:
    """Rates from (source, target share, max repeats, tokens there are).

    The mix is to be as large as all listed sources together.  A source gets
    ``share * size / tokens`` but at most its max repeats; what capped or empty
    sources leave is given to the others in proportion to their shares, until no
    further one reaches its cap.
    """
    size = sum(t for _, _, _, t in targets)
    rates = {s: 0.0 for s, _, _, _ in targets}
    open_ = [(s, w, m, t) for s, w, m, t in targets if t > 0 and w > 0 and m > 0]
    left = float(size)
    while open_:
        weight = sum(w for _, w, _, _ in open_)
        over = [x for x in open_ if x[1] / weight * left > x[2] * x[3]]
        if not over:
            for s, w, _, t in open_:
                rates[s] = w / weight * left / t
            break
        for s, _, m, t in over:
            rates[s] = float(m)
            left -= m * t
        open_ = [x for x in open_ if x not in over]
    return rates


def uniform(key: str, seed: int):
    """A number in [0, 1) from a hash of the key; the same on every run and engine."""
    text = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def mix(
    documents: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 0,
    ranks_path: str = DEFAULT_RANKS,
) -> tuple[DataFrame, DataFrame]:
    """(uses, shares): how often each document is used, and what each source gives.

    A document of a listed source is used floor(rate) times and once more with the
    probability of the rate's fraction, by a hash of its key and ``seed``.

    uses: ``key``, ``source``, ``tokens``, ``uses`` for every document with a text
    (not null, not empty) whose source is listed; 0 where it isn't taken.
    shares: per listed source documents and tokens there are, the rate, documents
    used, copies, tokens of the mix, target and actual share.  A listed source
    without documents has zeros; its share goes to the others.  Null and unlisted
    sources are not part of the mix.  Repeated rows with one key are used equally
    often.  Targets listed twice, without a share or with one below zero raise an
    error; a null max_repeats means 0.  Empty documents give empty uses and shares
    of 0.  Other columns, whatever their names, are not read.
    """
    goal = [
        (r[0], r[1], r[2] or 0)
        for r in bounded_rows(targets.select("source", "target_share", "max_repeats"), MOST_TARGETS, "mixing targets")
    ]
    names = [s for s, _, _ in goal]
    if len(set(names)) < len(names) or None in names or any(w is None or w < 0 for _, w, _ in goal):
        raise ValueError("each target needs a source of its own and a share of 0 or more")
    docs = documents.select(documents[key], documents[source], documents[text])
    docs = docs.toDF("k", "s", "t").where(F.col("s").isin(names) & (F.length("t") > 0))
    sizes = cut(count_tokens(docs, ["k", "s"], "t", "n", ranks_path))
    there = {r["s"]: r for r in sizes.groupBy("s").agg(F.count("*").alias("d"), F.sum("n").alias("n")).collect()}
    rates = repetition_rates([(s, w, m, there[s]["n"] if s in there else 0) for s, w, m in goal])
    rate = F.coalesce(*[F.when(F.col("s") == s, F.lit(r)) for s, r in rates.items()], F.lit(0.0)) if rates else F.lit(0.0)
    whole = F.floor(rate)
    uses = sizes.withColumn("u", (whole + (uniform("k", seed) < rate - whole).cast("long")).cast("int"))
    spark = documents.sparkSession
    fixed = spark.createDataFrame(
        [(s, float(w), int(m), rates[s]) for s, w, m in goal],
        "source string, target_share double, max_repeats int, rate double",
    )
    per = uses.groupBy(F.col("s").alias("source")).agg(
        F.count("*").alias("documents"),
        F.sum("n").alias("tokens"),
        F.count_if(F.col("u") > 0).alias("documents_used"),
        F.sum("u").alias("copies"),
        F.max("u").alias("most_repeats"),
        F.sum(F.col("u") * F.col("n")).alias("mix_tokens"),
    )
    counts = ["documents", "tokens", "documents_used", "copies", "most_repeats", "mix_tokens"]
    shares = fixed.join(per, "source", "left").fillna(0, counts)
    shares = shares.withColumn("all_tokens", shares.agg(F.sum("mix_tokens")).scalar()).select(
        "source",
        *[F.col(c).cast("long").alias(c) for c in counts],
        "max_repeats",
        "rate",
        "target_share",
        F.when(F.col("all_tokens") > 0, F.col("mix_tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"),
    )
    return uses.select(F.col("k").alias(key), F.col("s").alias(source), F.col("n").alias("tokens"), F.col("u").alias("uses")), shares


def copies(documents: DataFrame, uses: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix itself: every document as often as ``uses`` says, with a copy number from 1."""
    many = uses.where("uses > 0").select(key, "uses").dropDuplicates([key])
    return documents.join(many, key).withColumn("copy_no", F.explode(F.sequence(F.lit(1), "uses"))).drop("uses")
