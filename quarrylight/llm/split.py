"""Splitting of oversized items at natural boundaries.

Method: pointer doubling.  Boundaries of an item are its sentence ends and line ends; inside a stretch between two of
them that is longer than the limit, every n-th token end is a (forced) boundary, n being half the overlap.  Each boundary is joined to its successor:
the farthest boundary that a piece may reach which starts up to ``overlap`` tokens before it.  The successor table is
squared again and again, so that after k rounds all of the first 2^k cuts of every item are known, however long it is.

Defined results
* only items above ``limit`` tokens come out; an item of exactly ``limit`` tokens is left whole;
* null, empty and blank contents, and rows with a null key: no piece;
* a key that occurs several times is one item; of differing contents the least is taken;
* a natural boundary is preferred to any forced one; of several the farthest wins, so there are no ties;
* the overlap starts at a boundary; it is as long as fits with the next natural boundary inside the limit, and empty if
  nothing fits; inside forced stretches it has ``overlap`` tokens (one less if that is odd);
* very long items: a text is cut into boundaries in one piece, in memory in proportion to it; its successor table is
  spread over the cluster;
* empty tables: no row.  Only the named columns are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.sentences import sentence_spans
from quarrylight.operators.doubling import reach
from quarrylight.session import cut

LIMIT, OVERLAP = 512, 50
#: a token for the JVM and for Python: longest runs of letters, digits and underscores, any other character but white space
TOKEN_JVM = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{1c}-\x{1f}\x{85}]"
_TOKEN = re.compile(r"\w+|[^\w\s]")
_LINE = re.compile(r"[\n\r\x0b\x0c\x85  ]")


def token_count(col: Column) -> Column:
    return F.size(F.regexp_extract_all(col, F.lit(TOKEN_JVM), F.lit(0)))


def boundaries_of(text: str, limit: int, every: int = OVERLAP // 2) -> list[tuple[int, int, bool]]:
    """(position, tokens before it, natural) of each boundary of one text, from its start to its end."""
    ends = [m.end() for m in _TOKEN.finditer(text)]
    if not ends:
        return []
    natural = sorted({e for _, e in sentence_spans(text)} | {m.start() for m in _LINE.finditer(text)} | {len(text)})
    out: list[tuple[int, int, bool]] = [(0, 0, True)]
    k = 0
    for at in natural:
        first = k
        while k < len(ends) and ends[k] <= at:
            k += 1
        if k == first:
            continue
        if k - first > limit:
            out += [(ends[i], i + 1, False) for i in range(first + every - 1, k - 1, every)]
        out.append((at, k, True))
    if k < len(ends):
        out.append((len(text), len(ends), True))
    return out


def successors_of(bounds: Sequence[tuple[int, int, bool]], limit: int, overlap: int) -> list[np.ndarray]:
    """(i, j, start_token, start_pos, end_pos, natural) of the piece that follows each cut: it ends at j tokens.

    Each boundary but the last meets, by binary search over the boundaries in order, the place where its piece starts and
    the farthest one that the piece may reach.
    """
    pos, cum, natural = (np.array(x) for x in zip(*bounds))
    n = len(bounds) - 1
    cut, marks = cum[:n], np.flatnonzero(natural)
    # the next natural boundary, if a piece that starts at the cut itself can reach it
    after = np.searchsorted(cum[marks], cut, side="right")
    following = np.where(after < len(marks), cum[marks[np.minimum(after, len(marks) - 1)]], np.iinfo(np.int64).max)
    least = np.where(following <= cut + limit, np.maximum(cut - overlap, following - limit), cut - overlap)
    start = np.searchsorted(cum, np.maximum(least, 0))
    start[0] = 0
    most = np.minimum(cum[start] + limit, cut + limit)
    far = np.searchsorted(cum, most, side="right") - 1
    mark = marks[np.searchsorted(cum[marks], most, side="right") - 1]
    end = np.where(cum[mark] > cut, mark, far)
    return [cut, cum[end], cum[start], pos[start], pos[end], natural[end]]


def successors(items: DataFrame, keys: Sequence[str], content: str, limit: int, overlap: int) -> DataFrame:
    """(keys, i, j, start_token, start_pos, end_pos, natural): one row per boundary of each item but the last."""
    names, every = list(keys), max(1, overlap // 2)
    fields = [("i", T.IntegerType()), ("j", T.IntegerType()), ("start_token", T.IntegerType()), ("start_pos", T.IntegerType()), ("end_pos", T.IntegerType()), ("natural", T.BooleanType())]
    schema = T.StructType([items.schema[k] for k in keys] + [T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found, size = [], 0
            for at, t in enumerate(pdf["_content"]):
                bounds = boundaries_of(t, limit, every)
                if len(bounds) > 1:
                    found.append((at, successors_of(bounds, limit, overlap)))
                    size += len(bounds)
                if found and (size > 200_000 or at == len(pdf) - 1):
                    out = pdf[names].iloc[np.repeat([k for k, _ in found], [len(x[0]) for _, x in found])].reset_index(drop=True)
                    for c, (name, _) in enumerate(fields):
                        out[name] = np.concatenate([x[c] for _, x in found])
                    yield out
                    found, size = [], 0

    return items.select(*keys, F.col(content).alias("_content")).mapInPandas(run, schema)


def oversized(df: DataFrame, keys: Sequence[str], content: str, limit: int = LIMIT) -> DataFrame:
    """(keys, content) of items above the limit, each key once."""
    c = F.col(content)
    # no text has more tokens than code points, so that most rows are passed over without a regular expression
    big = df.select(*keys, c.alias(content)).dropna(subset=list(keys)).where((F.length(c) > limit) & (token_count(c) > limit))
    return big.groupBy(*keys).agg(F.min(content).alias(content))


def split_oversized(df: DataFrame, keys: Sequence[str], content: str = "content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(keys, piece_no, start_pos, end_pos, tokens, shared, natural) of the pieces of all items above the limit.

    Positions are in code points of the stored content, the end exclusive; ``shared`` is the number of tokens that a
    piece has in common with the one before it.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap has to be below the limit")
    succ = cut(successors(oversized(df, keys, content, limit), keys, content, limit, overlap))
    cuts = reach(succ, keys)
    return cuts.join(succ, [*keys, "i"]).select(*keys, "piece_no", "start_pos", "end_pos", (F.col("j") - F.col("start_token")).alias("tokens"), (F.col("i") - F.col("start_token")).alias("shared"), "natural")


def with_text(pieces: DataFrame, df: DataFrame, keys: Sequence[str], content: str = "content", limit: int = LIMIT) -> DataFrame:
    """Pieces with their text, cut from the stored content."""
    return pieces.join(oversized(df, keys, content, limit), list(keys)).withColumn("piece", F.expr(f"substring({content}, start_pos + 1, end_pos - start_pos)")).drop(content)
