"""Splitting long texts at natural boundaries with overlap.

A text is a row of words and the separators between them, each of a kind: section,
paragraph, line, sentence or word.  Too long a range is split at the coarsest kind
it has, ranges that are still too long at the next, words that are too long between
characters.  The resulting units are packed greedily; a piece starts again before
the end of the last one by the wanted overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.runtime import bounded_rows

LEVELS = ("section", "paragraph", "line", "sentence", "word", "character")
#: Most rows the table of limits may have; it is a parameter, not data.
MOST_LIMITS = 10_000
SPACE = " \t\r\n"
BLANK = re.compile(r"[ \t\r\n]+")
PARAGRAPH = re.compile(r"(?:\r\n|\n)(?:[ \t]*(?:\r\n|\n))+")
HEADING = re.compile(r"#{1,6}[ \t]|[=-]{3,}[ \t]*(?:[\r\n]|$)")


class Layout:
    """Words of a text (start, end) and the level of the separator after each."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.level = text, [], [], []
        at = 0
        for m in BLANK.finditer(text):
            s, e = m.span()
            if s > at:
                self.starts.append(at)
                self.ends.append(s)
                if e - s == 1 and text[s] in " \t":
                    level = 3 if text[s - 1] in ".!?" else 4
                else:
                    blank = m.group()
                    if "\n" in blank or "\r" in blank:
                        level = 2
                        if PARAGRAPH.search(blank):
                            level = 0 if HEADING.match(text, e) else 1
                    else:
                        level = 3 if text[s - 1] in ".!?" else 4
                self.level.append(level)
            at = e
        if at < len(text):
            self.starts.append(at)
            self.ends.append(len(text))
            self.level.append(0)
        elif self.level:
            self.level[-1] = 0

    def deepest(self, most: int) -> int:
        """The deepest level recursion needs until no unit exceeds ``most``."""
        n = len(self.starts)
        todo, worst = [(0, n, -1)], 0
        marks = [[i for i, x in enumerate(self.level) if x <= k] for k in range(5)]
        while todo:
            lo, hi, level = todo.pop()
            if hi <= lo or self.ends[hi - 1] - self.starts[lo] <= most:
                continue
            level += 1
            worst = max(worst, level)
            if level == 5:
                continue
            cuts = marks[level]
            a, b, first = bisect_left(cuts, lo), bisect_left(cuts, hi - 1), lo
            for c in cuts[a:b]:
                todo.append((first, c + 1, level))
                first = c + 1
            todo.append((first, hi, level))
        return worst

    def break_words(self, most: int, overlap: int) -> None:
        """Cut words longer than ``most`` between characters, so that overlaps fit."""
        if not self.starts or max(e - s for s, e in zip(self.starts, self.ends)) <= most:
            return
        step = overlap if 0 < overlap <= most // 2 else max(1, most // 2)
        starts, ends, level = [], [], []
        for s, e, k in zip(self.starts, self.ends, self.level):
            if e - s > most:
                inner = list(range(s, e, step))
                starts += inner
                ends += [*inner[1:], e]
                level += [5] * (len(inner) - 1) + [k]
            else:
                starts.append(s)
                ends.append(e)
                level.append(k)
        self.starts, self.ends, self.level = starts, ends, level


def split_text(text: str, most: int, overlap: int) -> tuple[list[tuple[int, int, str]], str]:
    """Pieces (start, end, kind of cut at the end) of a text, and its boundary.

    No piece exceeds ``most`` characters; together they hold everything but white
    space at cuts.  A cut is the last one of the coarsest level that fills half of
    the piece, else the last one there is.  The next piece starts at the word start
    nearest to ``overlap`` characters before the end that leaves room for more.
    """
    most = max(1, most)
    overlap = max(0, min(overlap, most - 1))
    plan = Layout(text)
    if not plan.starts:
        return [], "paragraph"
    deepest = plan.deepest(most)
    boundary = "none" if deepest == 5 else LEVELS[max(1, deepest)]
    plan.break_words(most, overlap)
    ws, we, kind = plan.starts, plan.ends, plan.level
    marks = [[i for i, x in enumerate(kind) if x <= k] for k in range(6)]
    pieces, i, last, n = [], 0, -1, len(ws)
    while True:
        far = bisect_right(we, ws[i] + most) - 1
        if far >= n - 1:
            pieces.append((ws[i], we[n - 1], "end"))
            return pieces, boundary
        cut = far
        for cuts in marks:
            p = bisect_right(cuts, far) - 1
            if p >= 0 and cuts[p] > last and we[cuts[p]] - ws[i] >= most / 2:
                cut = cuts[p]
                break
        pieces.append((ws[i], we[cut], LEVELS[kind[cut]]))
        last = cut
        goal = we[cut] - overlap
        j = bisect_left(ws, goal)
        if j > i + 1 and (j > cut + 1 or j >= n or goal - ws[j - 1] < ws[j] - goal):
            j -= 1
        j = min(max(j, i + 1), cut + 1)
        while we[cut + 1] - ws[j] > most:
            j += 1
        i = j


def split_documents(
    documents: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", content_type: str = "content_type"
) -> DataFrame:
    """The pieces of every text longer than the limit of its content type.

    ``limits`` has content_type, max_chars and overlap_chars; its row 'default'
    holds for null and unlisted types.  Result, one row per piece: ``key``,
    ``piece_no`` from 0, ``piece_start`` and ``piece_end`` (code points from 0, end
    exclusive), ``cut`` (kind of the cut at its end; 'end' for the last), the text
    ``piece`` and, the same for all pieces of a text, ``boundary``, the coarsest kind
    that suffices ('none' if words are too long).  Short, null and empty texts give
    no row; an over-long blank one gives one row without a piece and 'paragraph'.  Rows
    repeated in ``documents`` are split repeatedly.  Without any limit for a text it
    isn't split.  Other columns, whatever their names, are not read.
    """
    docs = documents.select(documents[key], documents[text], documents[content_type]).toDF("k", "t", "c").where("t is not null and t <> ''")
    known: dict[str, tuple[int, int]] = {}
    for c, m, o in bounded_rows(limits.select("content_type", "max_chars", "overlap_chars").where("content_type is not null and max_chars is not null"), MOST_LIMITS, "split limits"):
        new = (m, o or 0)  # of a type listed twice the least limit counts, so that no text is split twice
        known[c] = min(new, known.get(c, new))
    small = documents.sparkSession.createDataFrame([(c, m, o) for c, (m, o) in known.items()], "c2 string, m int, o int")
    named = F.when(F.col("c").isin([c for c in known]), F.col("c")).otherwise(F.lit("default"))
    listed = docs.withColumn("c", named).join(F.broadcast(small), F.col("c") == F.col("c2"))  # at most MOST_LIMITS rows
    long_ = listed.where("length(t) > m").select("k", "t", "m", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, rows = [], []
            for r, (t, m, o) in enumerate(zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))):
                pieces, boundary = split_text(t, m, o)
                for no, (s, e, cut) in enumerate(pieces):
                    rows.append((no, s, e, cut, t[s:e], boundary))
                    src.append(r)
                if not pieces:
                    rows.append((0, 0, 0, "end", None, boundary))
                    src.append(r)
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(src, pa.int32())), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["k", "piece_no", "piece_start", "piece_end", "cut", "piece", "boundary"],
            )

    schema = T.StructType(
        [
            T.StructField("k", documents.schema[key].dataType),
            *(T.StructField(c, T.IntegerType()) for c in ("piece_no", "piece_start", "piece_end")),
            *(T.StructField(c, T.StringType()) for c in ("cut", "piece", "boundary")),
        ]
    )
    return long_.mapInArrow(run, schema).withColumnRenamed("k", key)
