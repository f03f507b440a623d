"""Byte-pair encoding of a corpus with a public rank file, on padded matrices.

Texts are cut by the vocabulary's pattern; every distinct part of a batch that is
not yet known is encoded once.  Parts are put into buckets of similar length and
padded to a matrix of token ids.  In a round every row merges its leftmost pair of
minimum rank; pair ranks come from an open-addressing hash table, merged rows are
compacted to the left, so that the matrix loses a column each round, and finished
rows leave it.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The pattern that cuts text before merges (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for texts of ASCII only, where it is quicker to match.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = np.int32(2**31 - 1)
#: A part of more bytes is merged with a heap; the result is the same.
MATRIX_BYTES = 4096
#: Parts remembered by a worker before it starts afresh; no influence on results.
REMEMBERED = 400_000


class PairTable:
    """Hash table from a pair of token ids to the rank (= id) of the merged token."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, 2 * len(keys))))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at[left]] == -1
            first = left[free]
            self.keys[at[first]] = keys[first]  # of several for one slot the last stays
            won = self.keys[at[left]] == keys[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, pair: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Ranks of pairs of any shape; NONE where there is no merge or a padding."""
        a, b = pair
        keys = np.where((a < 0) | (b < 0), np.int64(-2), (a.astype(np.int64) << 20) | b)
        flat = keys.ravel()
        out = np.full(flat.shape, NONE, np.int32)
        todo = np.flatnonzero(flat >= 0)
        at = self._slot(flat[todo])
        while len(todo):
            there = self.keys[at]
            hit = there == flat[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (there != -1)
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)
        return out.reshape(keys.shape)


class Encoder:
    """Encodes texts by one rank file; kept by each Python worker."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in f if x.strip())}
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append((a << 20) | b)
                    values.append(rank)
        self.table = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.ranks = ranks
        self.pattern = regex.compile(PATTERN)
        self.ascii_pattern = re.compile(ASCII_PATTERN)
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers

    def learn(self, parts: Iterable[str]) -> None:
        """Put the ids of unknown parts into ``known``."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for part in parts:
            raw = part.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:  # merging ends with the token of the whole part
                self.known[part] = np.int32(whole).tobytes()
            elif len(raw) > MATRIX_BYTES:
                self.known[part] = np.array(self._heap(raw), np.int32).tobytes()
            else:
                n = len(raw)  # lengths up to 16 have their own bucket, longer ones share powers of 1.25
                buckets.setdefault(n if n <= 16 else 16 + int(np.log(n / 16) / np.log(1.25)) + 1, []).append((part, raw))
        for bucket in buckets.values():
            wide = max(len(r) for _, r in bucket)
            step = max(1, 4_000_000 // wide)
            for i in range(0, len(bucket), step):
                some = bucket[i : i + step]
                for (part, _), ids in zip(some, self._matrix([r for _, r in some])):
                    self.known[part] = ids

    def _matrix(self, raws: list[bytes]) -> list[bytes]:
        size = np.array([len(r) for r in raws])
        ids = np.full((len(raws), int(size.max())), -1, np.int32)
        ids[np.arange(ids.shape[1]) < size[:, None]] = self.byte_id[np.frombuffer(b"".join(raws), np.uint8)]
        rank = self.table[ids[:, :-1], ids[:, 1:]]
        rows = np.arange(len(raws))
        out = [b""] * len(raws)
        while len(rows):
            if ids.shape[1] < 2:
                best = np.full(len(rows), NONE, np.int32)
                at = np.zeros(len(rows), np.int64)
            else:
                at = rank.argmin(axis=1)  # the leftmost of equal ranks
                best = rank[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                ended = ids[done]
                for i, line, n in zip(rows[done].tolist(), ended, (ended >= 0).sum(axis=1).tolist()):
                    out[i] = line[:n].tobytes()
                on = ~done
                rows, ids, rank, at, best = rows[on], ids[on], rank[on], at[on], best[on]
                if not len(rows):
                    break
            n, wide = ids.shape
            each = np.arange(n)
            ids[each, at] = best
            keep = np.ones((n, wide), bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(n, wide - 1)
            if wide > 2:
                keep = keep[:, 1:]
                keep[:] = True
                keep[each, at] = False
                rank = rank[keep].reshape(n, wide - 2)
                for shift in (-1, 0):
                    col = at + shift
                    ok = (col >= 0) & (col < wide - 2)
                    r, c = each[ok], col[ok]
                    rank[r, c] = self.table[ids[r, c], ids[r, c + 1]]
        return out

    def _heap(self, raw: bytes) -> list[int]:
        """The same merges for one very long part, by a linked list and a heap."""
        ids = self.byte_id[np.frombuffer(raw, np.uint8)]
        first = self.table[ids[:-1], ids[1:]].tolist()
        ids = ids.tolist()
        n = len(ids)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        now = dict(enumerate(first))
        while heap:
            r, i = heapq.heappop(heap)
            if not live[i] or now.get(i) != r:
                continue
            j = after[i]
            ids[i], live[j] = r, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            now.pop(j, None)
            for k in (before[i], i):
                if k < 0 or after[k] >= n:
                    now.pop(k, None)
                    continue
                x = self.ranks_of(ids[k], ids[after[k]])
                now[k] = x
                if x != NONE:
                    heapq.heappush(heap, (x, k))
        return [x for x, on in zip(ids, live) if on]

    def ranks_of(self, a: int, b: int) -> int:
        return int(self.table[np.array([a]), np.array([b])][0])

    def parts(self, texts: list[str | None]) -> list[list[str]]:
        find, quick = self.pattern.findall, self.ascii_pattern.findall
        cut = [(quick(t) if t.isascii() else find(t)) if t else [] for t in texts]
        unknown = set().union(*cut).difference(self.known) if cut else set()
        if len(self.known) + len(unknown) > REMEMBERED:
            self.known.clear()
            unknown = set().union(*cut)
        if unknown:
            self.learn(unknown)
        return cut

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as packed 32-bit integers."""
        cut = self.parts(texts)
        known = self.known.__getitem__
        return [b"".join(map(known, parts)) for parts in cut]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.packed(texts)]

    def count(self, texts: list[str | None]) -> list[int]:
        cut = self.parts(texts)
        known = self.known.__getitem__
        return [sum(map(len, map(known, parts))) // 4 for parts in cut]


_ENCODERS: dict[str, Encoder] = {}


def encoder(ranks_path: str) -> Encoder:
    if ranks_path not in _ENCODERS:
        _ENCODERS[ranks_path] = Encoder(ranks_path)
    return _ENCODERS[ranks_path]


def encode_ids(df: DataFrame, key: str = "doc_id", text: str = "text", ids: str = "ids", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """``key`` and the token ids of ``text`` for every row of ``df``.

    Nothing is normalised or trimmed; strings that look like special tokens are
    ordinary text.  Null and empty texts both give an empty list; a null key stays
    null; repeated rows stay repeated; an empty table gives an empty one.  Other
    columns of ``df``, whatever their names, are not read.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for b in batches:
            lists = enc.packed(b.column(1).to_pylist())
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in lists], out=ends[1:])
            flat = np.frombuffer(b"".join(lists), np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["k", "v"])

    schema = T.StructType([T.StructField("k", kind), T.StructField("v", T.ArrayType(T.IntegerType(), False))])
    return df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, schema).toDF(key, ids)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", tokens: str = "tokens", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text`` (0 for null)."""
    fields = [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for b in batches:
            n = pa.array(enc.count(b.column(b.num_columns - 1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[f"c{i}" for i in range(b.num_columns)])

    schema = T.StructType([*fields, T.StructField("n", T.LongType())])
    cols = [df[c].alias(f"k{i}") for i, c in enumerate(keep)]
    return df.select(*cols, df[text].alias("t")).mapInArrow(run, schema).toDF(*keep, tokens)
