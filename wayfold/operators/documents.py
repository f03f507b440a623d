"""Operators on documents and chunks: search, duplicates, facets, chunking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.text import content_hash, overlap
from wayfold.operators.records import indexed
from wayfold.runtime import cut


def keyword_search(docs: DataFrame, query: str, limit: int = 5, tags: list[str] | None = None, category: str | None = None, match_all: bool = False) -> DataFrame:
    """Documents by the share of query words they hold; a top-k, ties by id."""
    p = F.lit(True)
    if tags:
        want = F.array(*[F.lit(t) for t in tags])
        p = p & (F.size(F.array_except(want, "tags")) == 0 if match_all else F.arrays_overlap("tags", want))
    if category:
        p = p & (F.col("category") == category)
    hits = docs.where(p).withColumn("score", F.round(overlap(F.col("text"), query), 6)).where("score > 0")
    return hits.orderBy(F.desc("score"), "doc_id").limit(limit)


def best_of_copies(docs: DataFrame, score: Column) -> DataFrame:
    """Of documents with one content hash the best; the other sources as alternates."""
    h = docs.where("text is not null").select("doc_id", "source", content_hash(F.col("text"), True).alias("hash"), score.alias("score"))
    best = h.groupBy("hash").agg(
        F.max_by(F.struct("doc_id", "source"), F.struct("score", (-F.col("doc_id")).alias("k"))).alias("b"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.count("*").alias("copies"),
    )
    alternates = F.array_except("sources", F.array("b.source"))
    return best.select("hash", "b.doc_id", "b.source", F.array_join(alternates, ",").alias("alternates"), "copies")


_WORD_BREAK = r"[ \t\r\n\f\x0b]+"


def _parts(n: int, least: float) -> list[int]:
    """In how many parts sets of ``n`` words are cut, to meet all sets they may be similar to.

    Two sets with a Jaccard similarity of ``least`` differ in at most (1 - least) / (1 + least)
    of their words, counted together; cut in more parts than that, they agree in one.  The
    larger set has the say, so a set is cut as its own size and any larger partner's ask for,
    in numbers of parts that rise by a fifth, which keeps them few.
    """
    most = lambda m: int(2 * m * (1 - least) / (1 + least) + 1e-6) + 1
    grid = [1]
    while grid[-1] < most(int(n / least + 1e-6)):
        grid.append(grid[-1] + max(1, grid[-1] // 5))
    return [g for g in grid if g > 1 and g >= most(n)]


def _word_sets(least: float):
    """An Arrow function: id and lower-case text to id, ``set`` (a fingerprint of the words), ``n`` words, ``sketch``, ``parts``.

    ``sketch`` has one bit for the parity of the words of each of 64 kinds: two sets differ in
    at least as many words as their sketches in bits.  ``parts`` are hashes of the parts of the
    set (see _parts); equal parts have equal hashes.
    """
    cuts: dict[int, list[int]] = {}

    def piece(ids: pa.Array, text: pa.Array) -> pa.RecordBatch:
        split = pc.ascii_split_whitespace(text)
        row, word = pc.list_parent_indices(split).to_numpy(zero_copy_only=False), split.flatten().dictionary_encode()
        names = word.dictionary.cast(pa.binary()).to_pylist()
        hashes = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in names), "<u8").reshape(-1, 2)
        order = np.lexsort((hashes[:, 1], hashes[:, 0]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code = word.indices.to_numpy(zero_copy_only=False)
        real = np.array([w != b"" for w in names], bool)[code]
        key = np.unique(row[real].astype(np.int64) * max(1, len(names)) + place[code[real]])
        row, hashes = key // max(1, len(names)), hashes[order][key % max(1, len(names))]  # in each row distinct, by hash
        h, g = np.ascontiguousarray(hashes[:, 0]), np.ascontiguousarray(hashes[:, 1])
        rows, at, n = np.unique(row, return_index=True, return_counts=True)
        ends, raw = at + n, memoryview(np.ascontiguousarray(hashes)).cast("B")
        sets = [hashlib.blake2b(raw[16 * i : 16 * j], digest_size=32).digest() for i, j in zip(at.tolist(), ends.tolist())]
        sketch = np.bitwise_xor.reduceat(np.uint64(1) << (g >> np.uint64(58)), at) if len(at) else np.empty(0, np.uint64)
        by: dict[int, list[int]] = {}
        for i, m in enumerate(n.tolist()):
            if m not in cuts:
                cuts[m] = _parts(m, least)
            for k in cuts[m]:
                by.setdefault(k, []).append(i)
        owner, made = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for k, own in by.items():
            own = np.array(own)
            size = n[own]
            first = np.repeat(at[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            sums = np.zeros(len(own) * k, np.uint64)
            np.add.at(sums, np.repeat(np.arange(len(own)) * k, size) + (h[first] % np.uint64(k)).astype(np.int64), g[first])
            slot = np.tile(np.arange(k, dtype=np.uint64), len(own)) + np.uint64(k << 32)
            owner.append(np.repeat(own, k))
            made.append((sums ^ (slot * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93))
        who, made = np.concatenate(owner), np.concatenate(made)
        sort = np.argsort(who, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(rows)))]).astype(np.int32)
        parts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made[sort].view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows)), pa.array(sets, pa.binary()), pa.array(n, pa.int32()), pa.array(sketch.view(np.int64)), parts], ["doc_id", "set", "n", "sketch", "parts"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, text = b.column(0), b.column(1)
            total = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
            i = 0
            while i < len(ids):  # by 1 MB of text, which bounds the memory
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + 1_000_000, "right")))
                yield piece(ids.slice(i, j - i), text.slice(i, j - i))
                i = j

    return run


def near_copies(docs: DataFrame, least: float = 0.95) -> DataFrame:
    """Classes of equal word sets, and links between classes with a Jaccard similarity of ``least`` or more.

    Every document has the class of its word set (``class_id``, the least id with that
    set); links join classes, not copies.  Classes that agree in a part of their words
    and whose sketches allow it (see _word_sets) are compared word by word, no similar
    ones are missed.  Only hashes are moved, but for the words of classes compared.
    Made for a high ``least``: with a low one the parts have few words and many agree.
    ``doc_id`` is unique, but a row may come again.
    Result: doc_id, class_id, links (other classes linked to its class).
    """
    if not 0 < least <= 1:
        raise ValueError("least: a similarity above 0, of 1 at most")
    text = docs.where("text is not null").select("doc_id", F.lower("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    w = cut(text.mapInArrow(_word_sets(least), f"doc_id {kind}, set binary, n int, sketch bigint, parts array<bigint>"))
    classes = w.groupBy("set").agg(F.min("doc_id").alias("class_id"))
    member = w.where("size(parts) > 0").groupBy("set").agg(F.min("doc_id").alias("id"), *[F.any_value(c).alias(c) for c in ("n", "sketch", "parts")])
    parts = member.select("id", "n", "sketch", F.explode("parts").alias("part"))
    a, b = parts.toDF("a", "na", "sa", "part"), parts.toDF("b", "nb", "sb", "part")
    sizes = (F.col("na") >= F.col("nb") * least) & (F.col("nb") >= F.col("na") * least)
    apart = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= (F.col("na") + F.col("nb")) * ((1 - least) / (1 + least)) + 1e-6
    near = cut(a.join(b, "part").where((F.col("a") < F.col("b")) & sizes & apart).select("a", "b").distinct())
    met = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ws = F.array_distinct(F.filter(F.split("text", _WORD_BREAK), lambda x: x != ""))
    words = text.join(met, "doc_id", "left_semi").select("doc_id", ws.alias("ws")).groupBy("doc_id").agg(F.any_value("ws").alias("ws"))
    shared = F.size(F.array_intersect("wa", "wb"))
    both = near.join(words.toDF("a", "wa"), "a").join(words.toDF("b", "wb"), "b")
    links = both.where(shared / (F.size("wa") + F.size("wb") - shared) >= least)
    count = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    named = classes.join(count, "class_id", "left")
    return w.select("doc_id", "set").distinct().join(named, "set").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def merge_copies(docs: DataFrame) -> DataFrame:
    """Copies merged: the one with most tags (a category counts as one) stays, with all tags."""
    richness = F.size(F.coalesce("tags", F.array())) + F.col("category").isNotNull().cast("int")
    h = docs.where("text is not null").select("doc_id", "tags", content_hash(F.col("text")).alias("hash"), richness.alias("rich"))
    g = h.groupBy("hash").agg(
        F.max_by("doc_id", F.struct("rich", (-F.col("doc_id")).alias("k"))).alias("doc_id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("tags", F.array()))))).alias("tags"),
        F.count("*").alias("merged_from"),
    )
    return g.select("doc_id", F.array_join("tags", ",").alias("tags"), "merged_from")


def stratified(docs: DataFrame, by: str, key: str, size: int) -> DataFrame:
    """A systematic sample in proportion to the strata (a feature, not a shortcut).

    Rows of a stratum are numbered in the order of the key, and every step-th is taken.
    Numbers are counted within ranges of stratum and key, then offset, so that a large
    stratum isn't one task.  A null stratum is one; an empty table gives an empty sample.
    """
    numbered = indexed(docs, [key], by=[by])
    n = numbered.agg(F.count("*")).scalar()
    step = F.greatest(F.lit(1), F.floor(n / max(1, size)))
    return numbered.where((F.col("row_no") - 1) % step == 0).drop("row_no")


def adjacent(rows: DataFrame, by: str, order: str, width: int = 100_000) -> DataFrame:
    """``by``, ``order`` and the values of ``order`` ``before`` and ``after`` in each group.

    ``order`` is an integer, unique in a group.  A group is worked on in ranges of
    ``width``, so that a large one isn't one task; what a range has to know of its
    neighbours, their edges, comes from one row a range.
    """
    rows = rows.select(by, order, F.floor(F.col(order) / width).alias("_part"))
    parts = Window.partitionBy(by).orderBy("_part")
    edges = rows.groupBy(by, "_part").agg(F.min(order).alias("a"), F.max(order).alias("z"))
    edges = edges.select(by, "_part", F.lag("z").over(parts).alias("_before"), F.lead("a").over(parts).alias("_after"))
    w = Window.partitionBy(by, "_part").orderBy(order)
    near = rows.withColumns({"before": F.lag(order).over(w), "after": F.lead(order).over(w)})
    return near.join(edges, [by, "_part"]).select(by, order, F.coalesce("before", "_before").alias("before"), F.coalesce("after", "_after").alias("after"))


def related_by_tags(docs: DataFrame, asked: Column, limit: int) -> DataFrame:
    """The ``limit`` documents of its category that share most tags (Jaccard) with each document asked for.

    ``docs`` has doc_id, category and tags, none null.  Documents with equal tags are one
    class; classes are compared, not documents, and of a class only its least ids can be
    among the best, one more than ``limit``, as a document isn't related to itself.
    """
    t = docs.select("doc_id", "category", F.array_sort(F.array_distinct("tags")).alias("tags"), asked.alias("asked"))
    ids = F.expr(f"slice(array_sort(collect_list(doc_id)), 1, {limit + 1})")
    rank = F.row_number().over(Window.partitionBy("category", "tags").orderBy("doc_id"))
    classes = t.withColumn("r", rank).where(F.col("r") <= limit + 1).groupBy("category", "tags").agg(ids.alias("ids"))
    asking = t.where("asked").select("category", "tags").distinct()
    a = asking.select("category", F.col("tags").alias("asked_tags"), F.explode("tags").alias("tag"))
    b = classes.select("category", F.col("tags").alias("other_tags"), "ids", F.explode("tags").alias("tag"))
    met = a.join(b, ["category", "tag"]).groupBy("category", "asked_tags", "other_tags").agg(F.count("*").alias("s"), F.any_value("ids").alias("ids"))
    score = F.round(F.col("s") / (F.size("asked_tags") + F.size("other_tags") - F.col("s")), 6)
    met = met.select("category", F.col("asked_tags").alias("tags"), score.alias("score"), F.explode("ids").alias("doc_id"))
    w = Window.partitionBy("category", "tags").orderBy(F.desc("score"), "doc_id")
    best = met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit + 1)
    found = t.where("asked").select(F.col("doc_id").alias("query_id"), "category", "tags").join(best, ["category", "tags"]).where("query_id <> doc_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "doc_id", "score", "rank")


def neighbours(chunks: DataFrame, doc: str, order: str, text: str, most: int = 100) -> DataFrame:
    """Previews of the chunks before and after."""
    w = Window.partitionBy(doc).orderBy(order)
    return chunks.select(doc, order, F.substring(F.lag(text).over(w), 1, most).alias("before"), F.substring(F.lead(text).over(w), 1, most).alias("after"))


def chunk_words(docs: DataFrame, size: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of up to ``size`` words, whole paragraphs where they fit; null texts give none.

    The last paragraph of a chunk begins the next one too, unless it alone fills half.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"]):
                if t is None:
                    continue
                paragraphs = [p.split() for p in t.replace("\r\n", "\n").split("\n\n")]
                units = [p[i : i + size] for p in paragraphs for i in range(0, len(p), size)]
                now: list[str] = []
                last: list[str] = []
                no = 0
                for u in units:
                    if now and len(now) + len(u) > size:
                        out.append((k, no, " ".join(now), len(now)))
                        no += 1
                        now = list(last) if 2 * len(last) < size and len(last) + len(u) <= size else []
                    now += u
                    last = u
                if now:
                    out.append((k, no, " ".join(now), len(now)))
            yield pd.DataFrame(out, columns=["k", "chunk_index", "chunk", "words"])

    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, chunk_index int, chunk string, words int")
    return made.withColumnRenamed("k", key)


def plain_html(docs: DataFrame, key: str, html: str) -> DataFrame:
    """Text of HTML without script, style and head."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.off, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "head")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "head")

        def handle_data(self, data):
            if self.off <= 0 and data.strip():
                self.out.append(data.strip())

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            r = Reader()
            r.feed(x)
            return "\n".join(r.out)

        return s.map(one)

    return docs.select(key, read(html).alias("text"))
