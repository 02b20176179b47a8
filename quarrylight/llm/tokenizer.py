"""Encoding of texts with a public byte-level BPE vocabulary.

Method: two tiers.  A minimal perfect hash over the vocabulary's byte strings
resolves every pre-token that is a vocabulary entry at once, for all distinct
pre-tokens of a batch together.  What it misses is merged with a heap of
candidate merges over a linked list of bytes.

Defined results
* null and empty text: an empty list; blank text: the ids of its blanks;
* any text decodes to itself, as every byte is in the vocabulary;
* very long texts: pre-tokens are looked up piece by piece, a pre-token of n bytes costs n log n;
* repeated rows: each row gets its ids; empty tables: no row;
* the key columns and ``ids`` are returned, so clashing names do not matter.

The vocabulary has a fixed size (50,256 entries, under 3 MB as arrays), whatever the corpus; it is broadcast once.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-token pattern of the vocabulary.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def hash_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice data[start : start + length], all slices at once (lengths above 0)."""
    at = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        words = _mix(data.astype(_U) + (at.astype(_U) << _U(8)) + _U(0x9E3779B97F4A7C15))
        return _mix(np.add.reduceat(words, starts) ^ lengths.astype(_U))


def _slices(items: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(items) else np.zeros(0, np.int64)
    return np.frombuffer(b"".join(items), np.uint8), starts, lengths


class PerfectHash:
    """A minimal perfect hash by displacement: n keys take n slots, each looked up with two reads."""

    def __init__(self, keys: Sequence[bytes], values: Sequence[int]) -> None:
        n = len(keys)
        h = hash_bytes(*_slices(keys))
        if len(np.unique(h)) != n:
            raise ValueError("two keys have one hash")
        self.n, self.buckets = n, max(1, n // 4)
        self.shift = np.zeros(self.buckets, np.uint32)
        bucket = (h >> _U(40)) % _U(self.buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        taken = np.zeros(n, bool)
        for b in np.argsort(-(cuts[1:] - cuts[:-1]), kind="stable"):
            own = h[order[cuts[b] : cuts[b + 1]]]
            if not len(own):
                break
            base = 0
            while True:
                tries = np.arange(base, base + 256, dtype=np.uint64)
                slots = self._slot(own[None, :], tries[:, None])
                free = ~taken[slots].any(axis=1)
                if len(own) > 1:
                    free &= (np.diff(np.sort(slots, axis=1), axis=1) != 0).all(axis=1)
                if free.any():
                    k = int(np.argmax(free))
                    self.shift[b] = base + k
                    taken[slots[k]] = True
                    break
                base += 256
        self.check, self.value = np.zeros(n, np.uint64), np.zeros(n, np.int32)
        slot = self._slot(h, self.shift[bucket.astype(np.int64)].astype(np.uint64))
        self.check[slot], self.value[slot] = h, np.asarray(values, np.int32)

    def _slot(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mix(h ^ (shift * _U(0x9E3779B97F4A7C15))) % _U(self.n)).astype(np.int64)

    def find(self, items: Sequence[bytes]) -> np.ndarray:
        """The value of each item, -1 for what is no key."""
        if not items:
            return np.zeros(0, np.int32)
        h = hash_bytes(*_slices(items))
        slot = self._slot(h, self.shift[((h >> _U(40)) % _U(self.buckets)).astype(np.int64)].astype(np.uint64))
        return np.where(self.check[slot] == h, self.value[slot], -1)


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the pair of lowest rank is merged first, the leftmost of equals."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            k = after[i]
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[k]))
        if before[i] >= 0:
            k = before[i]
            if (r := ranks.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Encoder:
    """Texts to ids; remembers pre-tokens it has resolved, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], whole: PerfectHash | None = None, pattern: str = PRETOKEN, remembered: int = 400_000) -> None:
        self.ranks, self.whole = ranks, whole or PerfectHash(list(ranks), list(ranks.values()))
        self.find, self.remembered = regex.compile(pattern).findall, remembered
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, tokens: set[str]) -> None:
        if len(self.known) + len(tokens) > self.remembered:
            self.known.clear()
        new = [t for t in tokens if t not in self.known]
        raw = [t.encode("utf-8", "surrogatepass") for t in new]
        for t, b, v in zip(new, raw, self.whole.find(raw).tolist()):
            self.known[t] = (v,) if v >= 0 else tuple(merge(b, self.ranks))

    def encode_batch(self, texts: Sequence[str | None]) -> list[list[int]]:
        pieces = [self.find(t) if t else [] for t in texts]
        out: list[list[int]] = []
        for at in range(0, len(pieces), 64):
            block = pieces[at : at + 64]
            tokens = set().union(*block)
            if not tokens <= self.known.keys():
                self._learn(tokens)
            known = self.known.__getitem__
            out += [list(chain.from_iterable(map(known, p))) for p in block]
        return out


def encode(df: DataFrame, keys: Sequence[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(keys, ids) of each row.  No shuffle; the vocabulary is read once, on the driver, and broadcast."""
    sc: SparkContext = df.sparkSession.sparkContext
    ranks = load_ranks(vocabulary)
    shared = sc.broadcast((ranks, PerfectHash(list(ranks), list(ranks.values()))))
    names = [f"_k{i}" for i in range(len(keys))]
    schema = T.StructType([T.StructField(n, df.schema[k].dataType) for n, k in zip(names, keys)] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                ids = encoder.encode_batch(part.column(part.num_columns - 1).to_pylist())
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*names, "ids"])

    got = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("_text")).mapInArrow(run, schema)
    return got.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "ids")
