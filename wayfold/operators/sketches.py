"""Sketches whose size doesn't grow with the data: counts, membership, decay.

Hashes are taken from MD5, so that any engine gives the same cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(item: Column, hashes: int, width: int) -> list[Column]:
    """One cell number, 0 to width - 1, for each of up to four hashes: eight hex digits of the MD5 each."""
    digest = F.md5(item.cast("binary"))
    return [F.pmod(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint"), F.lit(width)).cast("int") for i in range(hashes)]


def count_min(items: DataFrame, item: str, hashes: int = 4, width: int = 4096) -> DataFrame:
    """(row, cell, n): the counts of a count-min sketch, at most hashes * width rows; sketches add up cell by cell.

    Nulls don't count.  Items are counted once each before the cells are.
    """
    counts = items.where(F.col(item).isNotNull()).groupBy(item).agg(F.count("*").alias("_n"))
    at = F.array(*[F.struct(F.lit(i).alias("row"), c.alias("cell")) for i, c in enumerate(cells(F.col(item), hashes, width))])
    return counts.select("_n", F.explode(at).alias("_x")).groupBy("_x.row", "_x.cell").agg(F.sum("_n").alias("n"))


def estimates(asked: DataFrame, item: str, sketch: DataFrame, hashes: int = 4, width: int = 4096) -> DataFrame:
    """(item, estimate) of distinct items: the least of their cells, never below the true count."""
    a = asked.where(F.col(item).isNotNull()).select(item).distinct()
    at = F.array(*[F.struct(F.lit(i).alias("row"), c.alias("cell")) for i, c in enumerate(cells(F.col(item), hashes, width))])
    a = a.select(item, F.explode(at).alias("_x")).select(item, "_x.row", "_x.cell")
    return a.join(sketch, ["row", "cell"], "left").groupBy(item).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def bloom(items: DataFrame, item: str, hashes: int = 4, width: int = 65_536) -> DataFrame:
    """(cell): the bits that are set in a Bloom filter of the items; at most width rows.  Filters are united by a union."""
    return items.where(F.col(item).isNotNull()).select(F.explode(F.array(*cells(F.col(item), hashes, width))).alias("cell")).distinct()


def may_be_in(asked: DataFrame, item: str, bits: DataFrame, hashes: int = 4, width: int = 65_536) -> DataFrame:
    """(item, seen) of distinct items: whether all of their bits are set; false is certain."""
    a = asked.where(F.col(item).isNotNull()).select(item).distinct()
    a = a.select(item, F.explode(F.array_distinct(F.array(*cells(F.col(item), hashes, width)))).alias("cell"))
    return a.join(bits.withColumn("_set", F.lit(1)), "cell", "left").groupBy(item).agg((F.count("*") == F.count("_set")).alias("seen"))


def counting_filter(added: DataFrame, removed: DataFrame, item: str, hashes: int = 4, width: int = 65_536) -> DataFrame:
    """(cell, n) of a filter with deletion: how many added items less removed ones set a bit; zeros are left out."""
    bits = lambda df, sign: df.where(F.col(item).isNotNull()).select(F.explode(F.array_distinct(F.array(*cells(F.col(item), hashes, width)))).alias("cell"), F.lit(sign).alias("s"))
    return bits(added, 1).unionByName(bits(removed, -1)).groupBy("cell").agg(F.sum("s").alias("n")).where("n > 0")


def decayed(events: DataFrame, item: str, ts: str, now: Column, half_life_seconds: int) -> DataFrame:
    """(item, weight): occurrences, each worth half as much for every half-life it is older than ``now``."""
    age = F.unix_seconds(now) - F.unix_seconds(F.col(ts).cast("timestamp"))
    return events.where(F.col(item).isNotNull() & F.col(ts).isNotNull()).groupBy(item).agg(F.sum(F.pow(F.lit(0.5), age / half_life_seconds)).alias("weight"))
