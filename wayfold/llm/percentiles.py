"""Exact percentiles of huge numeric columns by distributed multi-select.

Every partition keeps the values of each cell (the finest combination of the
grouping columns) once, sorted, with counts; nothing is shuffled.  Then, in rounds,
for every group and range of values that still holds a wanted rank the partitions
propose the median of their values in that range, the median of the proposals
weighted by their counts becomes the pivot, values below, at and above it are
counted, and ranges that hold no wanted rank are discarded.  A round is one pass of
binary searches over the sorted arrays; a cell takes part in all its groups at once.
Ranges of few values are read out at the end.

The results are exact.  For keeping, a group is summarised by the exact values at
evenly spaced ranks; summaries of parts combine into one of the whole with a known
bound on the error in rank.
"""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A range of at most so many values is read out instead of being split further.
READ_OUT = 1024
#: Ranges held by the driver at a time; more groups are worked on in turn.
MOST_RANGES = 400_000
#: Values a partition sorts at a time; larger partitions give several arrays a cell.
HELD = 4_000_000
PERCENTS = (50, 90, 95, 99)


def rank_of(percent: float, n: int) -> int:
    """The rank, from 1, of a percentile: the least r with r >= n * percent / 100."""
    scaled = round(percent * 1000)
    return max(1, -(-n * scaled // 100_000))


def even_ranks(n: int, parts: int) -> list[int]:
    """Ranks 1, about n/parts, 2n/parts, ... n; all ranks where n is small."""
    return sorted({1, n, *(-(-n * i // parts) for i in range(1, parts))}) if n else []


def _chunks(values: DataFrame) -> DataFrame:
    """(cell, v, c, n): per partition and cell its distinct values, sorted, and running counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        codes, nums, held = [], [], 0
        for b in batches:
            enc = b.column(0).dictionary_encode()
            own = np.array([names.setdefault(x, len(names)) for x in enc.dictionary.to_pylist()], np.int64)
            if not len(own):
                continue
            codes.append(own[enc.indices.to_numpy(zero_copy_only=False)])
            nums.append(b.column(1).to_numpy(zero_copy_only=False))
            held += len(nums[-1])
            if held >= HELD:
                yield from flush(list(names), codes, nums)
                codes, nums, held = [], [], 0
        if codes:
            yield from flush(list(names), codes, nums)

    def flush(label: list[str], codes: list, nums: list) -> Iterator[pa.RecordBatch]:
        code, num = np.concatenate(codes), np.concatenate(nums)
        order = np.lexsort((num, code))
        code, num = code[order], num[order]
        new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (num[1:] != num[:-1])])
        count = np.diff(np.r_[new, len(code)])
        code, num = code[new], num[new]
        edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        ends = np.r_[edge[1:], len(code)]
        running = [np.cumsum(count[a:b]).astype(np.int64) for a, b in zip(edge, ends)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([label[code[a]] for a in edge]),
                pa.array([num[a:b].tobytes() for a, b in zip(edge, ends)], pa.binary()),
                pa.array([r.tobytes() for r in running], pa.binary()),
                pa.array([int(r[-1]) for r in running], pa.int64()),
            ],
            names=["cell", "v", "c", "n"],
        )

    return values.mapInArrow(run, "cell string, v binary, c binary, n bigint")


class _Range:
    """Open interval (low, high) of values of a group: ``base`` values are at or below low, ``n`` inside."""

    __slots__ = ("group", "low", "high", "base", "n", "ranks", "pivot")

    def __init__(self, group, low, high, base, n, ranks, pivot):
        self.group, self.low, self.high, self.base, self.n, self.ranks, self.pivot = group, low, high, base, n, ranks, pivot


def _round(chunks: DataFrame, groups_of: dict[str, list[int]], by_group: dict[int, tuple]) -> list:
    """Counts below and at each pivot, and pivots for both sides, of all open ranges."""
    sc = chunks.sparkSession.sparkContext
    shared = sc.broadcast((groups_of, by_group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups_of, by_group = shared.value
        for b in batches:
            cols: list[list[np.ndarray]] = []
            for cell, v, c, _ in zip(*(b.column(i).to_pylist() for i in range(4))):
                v, c = np.frombuffer(v), np.r_[0, np.frombuffer(c, np.int64)]
                for g in groups_of.get(cell, ()):
                    if g not in by_group:
                        continue
                    ids, low, high, pivot = by_group[g]
                    lo, hi = np.searchsorted(v, low, "right"), np.searchsorted(v, high, "left")
                    a, z = np.searchsorted(v, pivot, "left"), np.searchsorted(v, pivot, "right")
                    a, z = np.clip(a, lo, hi), np.clip(z, lo, hi)
                    below, at, above = c[a] - c[lo], c[z] - c[a], c[hi] - c[z]
                    some = (below + at + above) > 0
                    if not some.any():
                        continue
                    left = np.minimum(np.searchsorted(c, c[lo] + (below + 1) // 2, "left") - 1, len(v) - 1)
                    right = np.minimum(np.searchsorted(c, c[z] + (above + 1) // 2, "left") - 1, len(v) - 1)
                    cols.append([ids[some], below[some], at[some], above[some], v[np.maximum(left, 0)][some], v[np.maximum(right, 0)][some]])
            if cols:
                out = [np.concatenate(x) for x in zip(*cols)]
                ids, below, at, above, left, right = out
                # within the batch: sums, and the weighted median of the proposals
                order = np.argsort(ids, kind="stable")
                edge = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
                sums = [np.add.reduceat(x[order], edge) for x in (below, at, above)]
                props = [_medians(ids, left, below), _medians(ids, right, above)]
                u = ids[order][edge]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u), *map(pa.array, sums), *(pa.array([p.get(int(i)) for i in u], pa.float64()) for p in props)],
                    names=["id", "below", "at", "above", "left", "right"],
                )

    part = chunks.mapInArrow(run, "id bigint, below bigint, at bigint, above bigint, left double, right double")
    rows = (
        part.groupBy("id")
        .agg(
            F.sum("below").alias("below"),
            F.sum("at").alias("at"),
            F.sum("above").alias("above"),
            F.expr("percentile(left, 0.5, below)").alias("left"),
            F.expr("percentile(right, 0.5, above)").alias("right"),
        )
        .collect()
    )
    shared.unpersist()
    return rows


def _medians(ids: np.ndarray, value: np.ndarray, weight: np.ndarray) -> dict[int, float]:
    """The weighted median of the values of each id; ids without weight are left out."""
    ok = weight > 0
    ids, value, weight = ids[ok], value[ok], weight[ok]
    if not len(ids):
        return {}
    order = np.lexsort((value, ids))
    ids, value, weight = ids[order], value[order], weight[order]
    edge = np.flatnonzero(np.r_[True, np.diff(ids) != 0])
    last = np.r_[edge[1:], len(ids)]
    run = np.cumsum(weight)
    before = np.r_[0, run][edge]
    half = before + (run[last - 1] - before + 1) // 2
    at = np.minimum(np.searchsorted(run, half, "left"), last - 1)
    return dict(zip(ids[edge].tolist(), value[at].tolist()))


def multi_select(values: DataFrame, groups: dict[str, Sequence[str]], value: str, ranks, keep: Column | None = None) -> dict[tuple[str, tuple], tuple[int, dict[int, float]]]:
    """Exact order statistics of ``value`` in the groups of several groupings at once.

    ``groups`` names the columns of each grouping; ``ranks(n)`` gives the wanted
    ranks, from 1, for a group of n values.  Result: (grouping, key values) -> (n,
    {rank: value}).  Null keys form groups of their own; null and NaN values don't
    count, nor rows for which ``keep`` isn't true.  Keys come back as JSON types
    (dates as strings).  Values are compared as doubles, exact for integers below
    2^53.  An empty table has no groups.
    """
    columns = list(dict.fromkeys(c for cols in groups.values() for c in cols))
    num = F.col(value).cast("double")
    rows = values.where(num.isNotNull() & ~F.isnan(num) & (keep if keep is not None else F.lit(True)))
    keys = F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    cell = F.to_json(keys, {"ignoreNullFields": "false"}) if columns else F.lit("{}")
    chunks = _chunks(rows.select(cell.alias("cell"), (num + F.lit(0.0)).alias("x"))).persist()
    try:
        return _select(chunks, groups, columns, ranks)
    finally:
        chunks.unpersist()


def _select(chunks: DataFrame, groups: dict[str, Sequence[str]], columns: list[str], ranks) -> dict:
    # One row per cell, not per value: what the driver holds are names of groups.
    cells = chunks.groupBy("cell").agg(F.sum("n").alias("n")).collect()
    names: dict[tuple[str, tuple], int] = {}
    size: list[int] = []
    groups_of: dict[str, list[int]] = {}
    for r in cells:
        got = json.loads(r["cell"])
        vals = dict(zip(columns, (got.get(f"c{i}") for i in range(len(columns)))))
        for name, cols in groups.items():
            g = names.setdefault((name, tuple(vals[c] for c in cols)), len(names))
            if g == len(size):
                size.append(0)
            size[g] += r["n"]
            groups_of.setdefault(r["cell"], []).append(g)
    found: list[dict[int, float]] = [{} for _ in size]
    wanted = [sorted({r for r in ranks(n) if 1 <= r <= n}) for n in size]
    turn: list[int] = []
    held = 0
    for g, w in enumerate(wanted):
        if turn and held + len(w) > MOST_RANGES:
            _settle(chunks, groups_of, turn, size, wanted, found)
            turn, held = [], 0
        turn.append(g)
        held += len(w)
    if turn:
        _settle(chunks, groups_of, turn, size, wanted, found)
    return {key: (size[g], found[g]) for key, g in names.items()}


def _settle(chunks: DataFrame, groups_of: dict, turn: list[int], size: list[int], wanted: list, found: list) -> None:
    inf = math.inf
    ranges = [_Range(g, -inf, inf, 0, size[g], wanted[g], None) for g in turn if wanted[g]]
    small: list[_Range] = [r for r in ranges if r.n <= READ_OUT]
    ranges = [r for r in ranges if r.n > READ_OUT]
    first = True
    while ranges:
        # The first pivots: all values lie above a pivot of -inf, so the right proposals are medians of all.
        by_group: dict[int, list] = {}
        for i, r in enumerate(ranges):
            by_group.setdefault(r.group, []).append((i, r.low, r.high, -inf if first else r.pivot))
        packed = {g: tuple(np.array(x) for x in zip(*rs)) for g, rs in by_group.items()}
        rows = {r["id"]: r for r in _round(chunks, groups_of, packed)}
        nxt: list[_Range] = []
        for i, r in enumerate(ranges):
            got = rows[i]
            if first:
                below0 = got["at"] + got["below"]  # values of -inf themselves
                for k in [k for k in r.ranks if k <= below0]:
                    found[r.group][k] = -inf
                r.ranks, r.base, r.n, r.pivot = [k for k in r.ranks if k > below0], below0, got["above"], got["right"]
                if r.ranks:
                    (small if r.n <= READ_OUT else nxt).append(r)
                continue
            b, a = r.base + got["below"], r.base + got["below"] + got["at"]
            x, y = bisect.bisect_right(r.ranks, b), bisect.bisect_right(r.ranks, a)
            for k in r.ranks[x:y]:
                found[r.group][k] = r.pivot
            for part in (
                _Range(r.group, r.low, r.pivot, r.base, got["below"], r.ranks[:x], got["left"]),
                _Range(r.group, r.pivot, r.high, a, got["above"], r.ranks[y:], got["right"]),
            ):
                if part.ranks:
                    (small if part.n <= READ_OUT else nxt).append(part)
        ranges, first = nxt, False
    if small:
        _read_out(chunks, groups_of, small, found)


def _read_out(chunks: DataFrame, groups_of: dict, small: list[_Range], found: list) -> None:
    """Wanted ranks of ranges of at most READ_OUT values; each is put together by one task."""
    by_group: dict[int, list] = {}
    for i, r in enumerate(small):
        by_group.setdefault(r.group, []).append((i, r.low, r.high))
    packed = {g: tuple(np.array(x) for x in zip(*rs)) for g, rs in by_group.items()}
    sc = chunks.sparkSession.sparkContext
    shared = sc.broadcast((groups_of, packed, [(r.base, r.ranks) for r in small]))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups_of, packed, _ = shared.value
        for b in batches:
            ids, xs, ns = [], [], []
            for cell, v, c, _n in zip(*(b.column(i).to_pylist() for i in range(4))):
                v, c = np.frombuffer(v), np.diff(np.r_[0, np.frombuffer(c, np.int64)])
                for g in groups_of.get(cell, ()):
                    if g not in packed:
                        continue
                    own, low, high = packed[g]
                    lo, hi = np.searchsorted(v, low, "right"), np.searchsorted(v, high, "left")
                    lo = np.where(np.isneginf(low), 0, lo)
                    hi = np.where(np.isposinf(high), len(v), hi)
                    for i, s, e in zip(own[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                        ids.append(i)
                        xs.append(v[s:e].tobytes())
                        ns.append(c[s:e].tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(xs, pa.binary()), pa.array(ns, pa.binary())], names=["id", "x", "c"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        goals = shared.value[2]
        for b in batches:
            ids, ks, vs = [], [], []
            for i, xs, cs in zip(*(b.column(j).to_pylist() for j in range(3))):
                x, c = np.frombuffer(b"".join(xs)), np.frombuffer(b"".join(cs), np.int64)
                order = np.argsort(x, kind="stable")
                run = np.cumsum(c[order])
                base, ranks = goals[i]
                at = np.searchsorted(run, np.array(ranks) - base, "left")
                ids += [i] * len(ranks)
                ks += ranks
                vs += x[order][at].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.int64()), pa.array(vs, pa.float64())], names=["id", "k", "v"])

    parts = chunks.mapInArrow(take, "id bigint, x binary, c binary")
    whole = parts.groupBy("id").agg(F.collect_list("x").alias("x"), F.collect_list("c").alias("c"))  # at most READ_OUT values
    for r in whole.mapInArrow(choose, "id bigint, k bigint, v double").collect():
        found[small[r["id"]].group][r["k"]] = r["v"]
    shared.unpersist()


def percentiles(values: DataFrame, groups: dict[str, Sequence[str]], value: str, keep: Column | None = None, percents: Sequence[float] = PERCENTS) -> DataFrame:
    """One row per group: ``grouping``, the key columns of all groupings as strings
    (null where one isn't part of the grouping, or is null itself), ``n`` and the
    exact percentiles ``p50`` ...; the value at rank ceil(n * p / 100).

    The error in rank is 0.  Groups without a counted value have no row.  See
    :func:`multi_select` for nulls, ties and empty tables.
    """
    columns = list(dict.fromkeys(c for cols in groups.values() for c in cols))
    got = multi_select(values, groups, value, lambda n: [rank_of(p, n) for p in percents], keep)
    rows = []
    for (name, key), (n, at) in got.items():
        named = dict(zip(groups[name], key))
        rows.append((name, *(named.get(c) for c in columns), n, *(at[rank_of(p, n)] for p in percents)))
    schema = T.StructType(
        [
            T.StructField("grouping", T.StringType()),
            *(T.StructField(c, T.StringType()) for c in columns),
            T.StructField("n", T.LongType()),
            *(T.StructField(f"p{p:g}", T.DoubleType()) for p in percents),
        ]
    )
    return values.sparkSession.createDataFrame(rows, schema)


def summaries(values: DataFrame, grouping: Sequence[str], value: str, parts: int = 200, keep: Column | None = None) -> DataFrame:
    """The form to keep: per group ``n``, ``ranks`` and ``points``, the exact values there.

    There are about ``parts`` + 1 evenly spaced ranks, the first and last included,
    or all of them in a small group.  Between two neighbours lie fewer than
    ceil(n / parts) values.
    """
    got = multi_select(values, {"": tuple(grouping)}, value, lambda n: even_ranks(n, parts), keep)
    rows = [(*key, n, sorted(at), [at[r] for r in sorted(at)]) for (_, key), (n, at) in got.items()]
    schema = T.StructType(
        [
            *(T.StructField(c, T.StringType()) for c in grouping),
            T.StructField("n", T.LongType()),
            T.StructField("ranks", T.ArrayType(T.LongType())),
            T.StructField("points", T.ArrayType(T.DoubleType())),
        ]
    )
    return values.sparkSession.createDataFrame(rows, schema)


def combine(kept: DataFrame, by: Sequence[str] = (), percents: Sequence[float] = PERCENTS) -> DataFrame:
    """Percentiles of longer periods from kept summaries, with the bound of their error.

    In a summary the values at or below v number at least the last rank whose point
    is at or below v, and fewer than the next rank.  Added up over the summaries this
    gives every percentile within ``rank_error`` ranks: the sum over the summaries of
    (largest gap between ranks - 1), at most about n / parts.  Columns: ``by``,
    ``n``, ``summaries``, ``rank_error``, ``p50`` ... .  Null keys form a group.
    A period holds some 200 points a summary, whatever the data; equal points are
    added up first.  No summaries give no rows.
    """
    step = "ranks[i - 1] - if(i > 1, ranks[i - 2], 0L)"
    gap = f"array_max(transform(sequence(1, size(ranks)), i -> {step})) - 1"
    point = F.explode(F.expr(f"transform(sequence(1, size(ranks)), i -> struct(points[i - 1] as x, {step} as w, if(i = 1, {gap}, 0L) as e, if(i = 1, 1L, 0L) as s))"))
    points = kept.select(*by, point.alias("p")).groupBy(*by, F.col("p.x").alias("x")).agg(*(F.sum(f"p.{c}").alias(c) for c in "wes"))
    w = Window.partitionBy(*by)
    upto = F.sum("w").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    points = points.withColumns({"upto": upto, "n": F.sum("w").over(w)})
    least = [F.min(F.when(F.col("upto") * 100_000 >= F.col("n") * round(p * 1000), F.col("x"))).alias(f"p{p:g}") for p in percents]
    out = points.groupBy(*by).agg(F.max("n").alias("n"), F.sum("s").alias("summaries"), F.sum("e").alias("rank_error"), *least)
    return out if by else out.where("n is not null")
