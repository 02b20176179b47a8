"""Reading level of documents.

Method: interpolated n-gram models, one per grade, are trained on graded documents; a document's surprisal is computed
under each for every one of its words; the mean of how much less it surprises the model of the hardest grade than that
of the plainest is mapped to the grade by isotonic regression, fitted on documents that the models did not see.

Defined results
* null, empty and blank texts, and texts without words: score 0 words, grade null;
* words no graded document has surprise all models alike and move no document;
* repeated grades of one document: each counts; null grades and grades of unknown documents do not;
* equal scores get equal grades; a score between two fitted ones gets the linear mean of their grades;
* very long texts are read whole; empty tables: no row;
* fewer than two grades to learn from: ``fit_reading`` raises ValueError; without a model every grade is null.

The graded documents are a bounded sample: at most ``GRADED`` of them, none longer than ``GRADED_CHARS``,
come to the driver, chosen by a hash of the id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.langid import LanguageModel
from quarrylight.llm.sentences import sentence_spans

GRADED, GRADED_CHARS = 3000, 100_000
#: weights of the interpolated orders from trigram to uniform
LAMBDA = (0.3, 0.35, 0.3, 0.05)
# Languages in Latin script.
LATIN = frozenset("en de fr es pt it nl sv da no fi pl cs ro hu ca tr id vi".split())
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d[\d.,]*|[^\w\s]")


def words(text: str) -> list[str]:
    return ["0" if w[0].isdigit() else w for w in _WORD.findall(text.lower())]


def _behind(ids: np.ndarray, k: int) -> np.ndarray:
    """The words k places before each."""
    return np.concatenate((np.zeros(min(k, len(ids)), np.int64), ids[:-k]))


class NGrams:
    """Numbers of the pairs and triples of words that occur in graded documents; 0 for all others.  Nothing is hashed."""

    def __init__(self, docs: Sequence[np.ndarray], size: int) -> None:
        self.base = size + 1
        codes = [self._pairs(d) for d in docs]
        self.pairs = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        triples = [self._triples(d, self._find(self.pairs, c)) for d, c in zip(docs, codes)]
        self.triples = np.unique(np.concatenate(triples)) if triples else np.zeros(0, np.int64)

    def _pairs(self, ids: np.ndarray) -> np.ndarray:
        return _behind(ids, 1) * self.base + ids

    def _triples(self, ids: np.ndarray, pair: np.ndarray) -> np.ndarray:
        return _behind(ids, 2) * (len(self.pairs) + 1) + pair

    @staticmethod
    def _find(known: np.ndarray, codes: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[at] == codes, at + 1, 0)

    def numbers(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pair and the triple that end at each word; a triple whose pair is unknown is unknown."""
        pair = self._find(self.pairs, self._pairs(ids))
        triple, seen = np.zeros(len(ids), np.int64), np.flatnonzero(pair)
        triple[seen] = self._find(self.triples, self._triples(ids, pair)[seen])
        return pair, triple


class NGramModel:
    """Interpolated trigram model over word ids; 0 is the word that was not seen."""

    def __init__(self, docs: Sequence[np.ndarray], grams: NGrams) -> None:
        self.size = grams.base - 1
        self.one, self.two, self.three = (np.zeros(n + 1, np.float32) for n in (self.size, len(grams.pairs), len(grams.triples)))
        for d in docs:
            a, b = grams.numbers(d)
            np.add.at(self.one, d, 1)
            np.add.at(self.two, a, 1)
            np.add.at(self.three, b, 1)
        self.two[0] = self.three[0] = 0
        self.total = max(1.0, float(self.one.sum()))

    def surprisal(self, ids: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Bits of each word after the two before it; ``keys`` are the numbers of its pair and triple."""
        a, b = keys
        before, pair = _behind(ids, 1), _behind(a, 1)
        p = LAMBDA[3] / (self.size + 1) + LAMBDA[2] * (self.one[ids] + 0.02) / (self.total + 0.02 * (self.size + 1))
        p += LAMBDA[1] * self.two[a] / np.maximum(self.one[before], self.two[a] + 1)
        p += LAMBDA[0] * self.three[b] / np.maximum(self.two[pair], self.three[b] + 1)
        return -np.log2(p)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising function nearest to y in squares, by pooling adjacent violators; equal x are one point."""
    xs, first, n = np.unique(x, return_index=True, return_counts=True)
    del first
    order = np.argsort(x, kind="stable")
    means = np.add.reduceat(y[order], np.concatenate(([0], np.cumsum(n)[:-1]))) / n
    level: list[list[float]] = []
    for m, w in zip(means, n):
        level.append([float(m), float(w), 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            b, a = level.pop(), level.pop()
            level.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return xs, np.repeat([v[0] for v in level], [int(v[2]) for v in level])


@dataclass
class ReadingModel:
    vocabulary: dict[str, int]
    grams: NGrams
    models: list[NGramModel]
    grades: list[int]
    knots: np.ndarray
    levels: np.ndarray

    def ids(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words(text)], np.int64)

    def profiles(self, texts: Sequence[str]) -> list[tuple[int, list[float], float]]:
        """(words, mean surprisal under each grade's model, score) of each text, all texts in one pass."""
        each = [self.ids(t) for t in texts]
        n = np.array([len(x) for x in each], np.int64)
        if not n.sum():
            return [(0, [float("nan")] * len(self.models), 0.0)] * len(each)
        # two unseen words before each text, so that none begins in another
        gap = np.zeros(2, np.int64)
        ids = np.concatenate([p for x in each for p in (gap, x)])
        keys = self.grams.numbers(ids)
        owner = np.repeat(np.arange(len(each)), n + 2)
        inside = np.ones(len(ids), bool)
        inside[np.cumsum(n + 2) - n - 2] = inside[np.cumsum(n + 2) - n - 1] = False
        bits = [m.surprisal(ids, keys) for m in self.models]
        known = inside & (ids > 0)
        # how much harder than plain: each word's bits under the plainest model less those under the hardest, kept
        # within bounds so that no single word decides
        lean = np.bincount(owner[known], np.clip(bits[0] - bits[-1], -6, 6)[known], len(each)) / np.maximum(np.bincount(owner[known], minlength=len(each)), 1)
        means = np.stack([np.bincount(owner[inside], b[inside], len(each)) / np.maximum(n, 1) for b in bits], axis=1)
        return [(int(k), m.tolist() if k else [float("nan")] * len(self.models), float(x)) for k, m, x in zip(n, means, lean)]

    def profile(self, text: str) -> tuple[int, list[float], float]:
        return self.profiles([text])[0]

    def level(self, score: float) -> float:
        return float(np.interp(score, self.knots, self.levels))

    def grade(self, score: float) -> int:
        return int(min(self.grades, key=lambda g: (abs(g - self.level(score)), g)))


def fit_reading(texts: Sequence[str], grades: Sequence[int], folds: int = 4, seed: int = 5) -> ReadingModel:
    """Fits the models and the map on (text, grade) pairs; a text with several grades is given once for each."""
    kinds = sorted(set(grades))
    if len(kinds) < 2:
        raise ValueError("texts of two grades at least are needed")
    tokens = [words(t) for t in texts]
    vocabulary: dict[str, int] = {}
    for t in tokens:
        for w in t:
            vocabulary.setdefault(w, len(vocabulary) + 1)
    ids = [np.array([vocabulary[w] for w in t], np.int64) for t in tokens]
    grams = NGrams(ids, len(vocabulary))
    y = np.array(grades)
    names = {t: i for i, t in enumerate(sorted(set(texts)))}
    part = np.random.default_rng(seed).integers(0, folds, len(names))[[names[t] for t in texts]]
    score = np.zeros(len(texts))

    def models(rows: np.ndarray) -> list[NGramModel]:
        return [NGramModel([ids[i] for i in np.flatnonzero(rows & (y == k))], grams) for k in kinds]

    for f in range(folds):
        unseen = ReadingModel(vocabulary, grams, models(part != f), kinds, np.zeros(1), np.zeros(1))
        rows = np.flatnonzero(part == f)
        score[rows] = [x[2] for x in unseen.profiles([texts[i] for i in rows])]
    knots, levels = isotonic(score, y.astype(float))
    return ReadingModel(vocabulary, grams, models(np.ones(len(y), bool)), kinds, knots, levels)


def graded_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, grade: str, most: int = GRADED) -> list[tuple[str, int]]:
    """(text, grade) of at most ``most`` graded rows.  The ids of the sample are joined to the documents by their size."""
    chosen = labels.select(doc_id, F.col(grade).cast("int").alias("_g")).dropna().orderBy(F.xxhash64(doc_id), "_g").limit(most)
    rows = docs.select(doc_id, F.col(text).alias("_t")).join(F.broadcast(chosen), doc_id).where(F.length("_t").between(1, GRADED_CHARS)).collect()
    return [(r["_t"], r["_g"]) for r in sorted(rows, key=lambda r: (r[doc_id], r["_g"]))]


def body(text: str) -> str:
    """A text without lines that are no prose: numbered headings, document numbers and table rows."""
    return _NO_PROSE.sub("", text)


_NO_PROSE = re.compile(r"(?m)^[^\S\n]*(?:\|.*|Document ID:.*|\d{1,3}(?:\.\d+)*\.?[^\S\n]+[^\W\d_][^\n.;:!?]{0,60})[^\S\n]*$")


def all_in_language(model: LanguageModel, texts: Sequence[str], lang: str, sure: float = 0.9, least_letters: int = 12) -> list[bool]:
    """Whether all sentences of a text are in one language; one says otherwise if it is long enough to tell and sure."""
    k = model.languages.index(lang) if lang in model.languages else -1
    # where other letters than Latin ones prevail, the sentences cannot all be in a language of Latin script
    latin = lang in LATIN
    spans = [[t[s:e] for s, e in sentence_spans(t)] if not latin or 2 * len(t.encode("latin-1", "ignore")) >= len(t) else [] for t in texts]
    ok = np.array([bool(own) and k >= 0 for own in spans])
    # most texts in other languages show it in their first sentences; only what passes them is looked at further
    for part in (slice(0, 6), slice(6, None)):
        rows = [i for i in np.flatnonzero(ok) if spans[i][part]]
        p = model.probabilities([x for i in rows for x in spans[i][part]])
        best, top, at = p.argmax(axis=1), p.max(axis=1), 0
        for i in rows:
            own = spans[i][part]
            said = [x for j, x in enumerate(own, at) if best[j] != k and top[j] >= sure]
            # a run of one letter is no language
            ok[i] = not any(sum(c.isalpha() for c in x) >= least_letters and len(set(x)) > 4 for x in said)
            at += len(own)
    return ok.tolist()


def reading_levels(docs: DataFrame, doc_id: str, text: str, model: ReadingModel | None, languages: LanguageModel | None = None, lang: str = "en") -> DataFrame:
    """(doc_id, n_words, surprisal per grade's model, score, level, band) of each document; all its prose in ``lang`` if
    ``languages`` is given.  No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model, languages))
    schema = f"_d {docs.schema[doc_id].dataType.simpleString()}, n_words int, surprisal array<double>, score double, level double, band int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, spoken = shared.value
        for whole in batches:
            for at in range(0, len(whole), 1000):
                pdf = whole.iloc[at : at + 1000]
                texts = [body(t) if t else "" for t in pdf["_t"]]
                ok = all_in_language(spoken, texts, lang) if spoken else [True] * len(texts)
                rows = []
                kept = [i for i, good in enumerate(ok) if good]
                if reader is None:
                    rows = [(pdf["_d"].iloc[i], None, None, None, None, None) for i in kept]
                for i, (n, bits, score) in zip(kept, [] if reader is None else reader.profiles([texts[i] for i in kept])):
                    rows.append((pdf["_d"].iloc[i], n, bits, score, reader.level(score) if n else None, reader.grade(score) if n else None))
                out = pd.DataFrame(rows, columns=["_d", "n_words", "surprisal", "score", "level", "band"])
                out = out.astype({"n_words": "Int32", "band": "Int32", "score": "float64", "level": "float64"})
                yield out

    return docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).mapInPandas(run, schema).withColumnRenamed("_d", doc_id)
