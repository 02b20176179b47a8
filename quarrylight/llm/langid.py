"""Language of texts and of their sentences.

Method: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy, with
calibrated rejection.  The classifier is fitted on a bounded sample of labelled rows of the corpus itself; labels that
the first fit contradicts are left out of the second, as labels are partly wrong.  On held-out rows a temperature is
fitted and the least confidence that is accepted is set.

Defined results
* null, empty and blank contents, and contents without letters: no language, no row;
* a sentence whose confidence is too low takes the language that most of its text's sure sentences have, and says
  nothing of the text by itself; if none is sure, the most probable language of the whole text counts;
* ties between languages: the code that comes first in the alphabet;
* a label is read whatever its way of writing (``canonical_label``); what is no known label names no language;
* repeated rows: one result per key and content; very long texts: classified whole, sentence by sentence;
* an empty table, or one without labels in two languages: ``fit`` gives a model that calls every text ``und`` and is
  sure of none; ``fit_languages`` raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.sentences import sentence_spans

# Two-letter codes, three-letter codes and English names of languages.
LANGUAGES = """ar ara arabic;bg bul bulgarian;bn ben bengali;ca cat catalan;cs ces cze czech;da dan danish;de deu ger german;el ell gre greek;en eng english;es spa spanish;
fa fas per persian farsi;fi fin finnish;fr fra fre french;he heb hebrew;hi hin hindi;hu hun hungarian;id ind indonesian;it ita italian;ja jpn japanese;ko kor korean;lo lao laothian;
nl nld dut dutch;no nor norwegian;pl pol polish;pt por portuguese;ro ron rum romanian;ru rus russian;sv swe swedish;th tha thai;tr tur turkish;uk ukr ukrainian;ur urd urdu;vi vie vietnamese;zh zho chi chinese"""
_CODES = {w: x.split()[0] for x in LANGUAGES.replace("\n", "").split(";") for w in x.split()}
#: rows taken for the fit, in proportion to the root of their label's share, least number taken per label, and least share
#: of the labelled rows that a label needs to be a class.  All alike, rare labels set wrongly would outweigh common ones;
#: in full proportion, common labels set wrongly would outweigh rare ones
SAMPLE_ROWS, ROWS_PER_LABEL, LEAST_SHARE = 4000, 150, 0.003
#: longest content taken into the sample, so that it is bounded in bytes as well
SAMPLE_CHARS = 50_000
#: sentences of the sample that are fitted
FIT_SENTENCES = 9000
BUCKETS, DIM, ORDERS = 1 << 16, 16, (1, 2, 3)


def canonical_label(label: Column) -> Column:
    """Two-letter code of a label in any writing, '' for none (null, blank, unknown), '?' for what names no language."""
    bare = F.lower(F.trim(F.regexp_replace(label, r"[\s\p{Z}]+", " ")))
    head = F.regexp_extract(bare, r"^([\p{L}]+)", 1)
    names = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    return F.when(label.isNull() | bare.isin("", "unknown", "und", "none", "n/a", "null"), "").otherwise(F.coalesce(names[head], F.lit("?")))


_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x30000) if (ch := chr(c)).isalpha() or (0x300 <= c < 0x370) or (0x0E30 <= c < 0x0E4F) or (0x64B <= c < 0x660)]] = True
        _LETTER = table
    return _LETTER


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, one space between them and for what is no letter; start of each text."""
    joined = " " + " ".join(texts) + " "
    lower = joined.lower()
    if len(lower) != len(joined):
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in joined)
    codes = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(32))
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if len(texts) else np.zeros(0, np.int64)
    return codes, starts.astype(np.int64)


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """Bucket of each subword of each order, by the place where it begins; -1 where there is none."""
    x = codes.astype(np.uint64)
    space = codes == 32
    out = []
    for n in ORDERS:
        h = np.full(len(x), n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        bad = np.zeros(len(x), bool)
        with np.errstate(over="ignore"):
            for k in range(n):
                part = np.empty_like(x)
                part[: len(x) - k] = x[k:]
                part[len(x) - k :] = 32
                h = (h ^ part) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
                if 0 < k < n - 1 or n <= 2:
                    inner = np.ones(len(x), bool)
                    inner[: len(x) - k] = space[k:]
                    bad |= inner
        out.append(np.where(bad, -1, (h % np.uint64(BUCKETS)).astype(np.int64)))
    return out


@dataclass
class LanguageModel:
    """weights: for each bucket the logits of each language, embedding and softmax multiplied out."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.5

    def probabilities(self, texts: Sequence[str], block: int = 150_000) -> np.ndarray:
        """One row of probabilities per text, texts in any number; a text without subwords has only equal ones."""
        out = np.zeros((len(texts), len(self.languages)), np.float32)
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) < block):
                size += len(texts[b]) + 1
                b += 1
            codes, starts = _codes(texts[a:b])
            sums, counts = np.zeros((b - a, len(self.languages)), np.float32), 0.0
            for g in _grams(codes):
                ok = np.flatnonzero(g >= 0)
                cut = np.searchsorted(ok, np.append(starts, len(codes)))
                # each text's sum by itself, so that what stands before it in its block does not tell
                some = cut[1:] > cut[:-1]
                if some.any():
                    sums[some] += np.add.reduceat(self.weights.take(g[ok], axis=0), cut[:-1][some], axis=0)
                counts = counts + (cut[1:] - cut[:-1])
            z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
            z[counts == 0] = 0
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[a:b] = z / z.sum(axis=1, keepdims=True)
            a = b
        return out


def _train(rows: list[np.ndarray], labels: np.ndarray, n: int, epochs: int, rate: float, seed: int, batch_size: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent, each parameter's steps scaled by what its gradients were so far."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.3, (DIM, n)).astype(np.float32), np.zeros(n, np.float32)
    past_emb, past_soft, past_bias = np.full((BUCKETS, 1), 1e-8, np.float32), np.full_like(soft, 1e-6), np.full_like(bias, 1e-6)
    # the distinct subwords of a row and their shares in it
    packed = [np.unique(r, return_counts=True) for r in rows]
    packed = [(u, (c / c.sum()).astype(np.float32)) for u, c in packed]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch_size):
            batch = order[at : at + batch_size]
            flat = np.concatenate([packed[i][0] for i in batch])
            share = np.concatenate([packed[i][1] for i in batch])[:, None]
            lengths = np.array([len(packed[i][0]) for i in batch])
            cuts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            mean = np.add.reduceat(emb[flat] * share, cuts, axis=0)
            z = mean @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            p /= len(batch)
            back = np.repeat(p @ soft.T, lengths, axis=0) * share
            sorted_ = np.argsort(flat, kind="stable")
            firsts = np.flatnonzero(np.diff(flat[sorted_], prepend=-1))
            used, grad = flat[sorted_][firsts], np.add.reduceat(back[sorted_], firsts, axis=0)
            past_emb[used] += (grad**2).mean(axis=1, keepdims=True)
            emb[used] -= rate * grad / np.sqrt(past_emb[used])
            grad = mean.T @ p
            past_soft += grad**2
            soft -= rate * grad / np.sqrt(past_soft)
            grad = p.sum(axis=0)
            past_bias += grad**2
            bias -= 0.3 * rate * grad / np.sqrt(past_bias)
    return emb @ soft, bias


def fit_languages(texts: Sequence[str], labels: Sequence[str], groups: Sequence[int] | None = None, epochs: int = 4, rate: float = 0.25, seed: int = 7) -> LanguageModel:
    """Fits the classifier on sentences and their (partly wrong) labels; the same input gives the same model.

    Labels are checked by models that saw neither them nor others of their group (the text a sentence is from).
    """
    keep = [i for i, t in enumerate(texts) if any(c.isalpha() for c in t)]
    group = np.array([groups[i] if groups is not None else i for i in keep])
    texts, labels = [texts[i] for i in keep], [labels[i] for i in keep]
    languages = sorted(set(labels))
    if len(languages) < 2:
        raise ValueError("labelled texts in two languages at least are needed")
    y = np.array([languages.index(x) for x in labels])
    rows = []
    for t in texts:
        codes, _ = _codes([t])
        g = np.concatenate(_grams(codes))
        rows.append(g[g >= 0] if (g >= 0).any() else np.zeros(1, np.int64))
    chance = np.random.default_rng(seed)
    held = chance.random(int(group.max()) + 1)[group] < 0.15
    half = chance.random(int(group.max()) + 1)[group] < 0.5
    right = np.zeros(len(rows), bool)
    for side in (half, ~half):
        own = np.flatnonzero(side)
        if len(own) and len(own) < len(rows):
            w, b = _train([rows[i] for i in own], y[own], len(languages), max(3, epochs - 1), rate, seed)
            other = np.flatnonzero(~side)
            right[other] = LanguageModel(languages, w, b).probabilities([texts[i] for i in other]).argmax(axis=1) == y[other]
    fit = np.flatnonzero(~held)
    if right[fit].sum() >= 0.3 * len(fit):
        fit = fit[right[fit]]
    w, b = _train([rows[i] for i in fit], y[fit], len(languages), epochs, rate, seed + 1)
    model = LanguageModel(languages, w, b)
    # calibration on held-out rows whose label the rough model shares: temperature, then the least accepted confidence
    check = np.flatnonzero(held & right)
    if len(check) >= 20:
        sample = [texts[i] for i in check]
        losses = []
        for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0):
            model.temperature = t
            p = model.probabilities(sample)
            losses.append((float(-np.log(np.maximum(p[np.arange(len(check)), y[check]], 1e-9)).mean()), t))
        model.temperature = min(losses)[1]
        p = model.probabilities(sample)
        top, ok = p.max(axis=1), p.argmax(axis=1) == y[check]
        for t in np.arange(0.4, 0.96, 0.02):
            if (~ok[top >= t]).mean() <= 0.001 if (top >= t).any() else True:
                break
        model.accept = float(t)
    return model


def labelled_sample(df: DataFrame, row_id: str, content: str, label: str, rows: int = SAMPLE_ROWS, per_label: int = ROWS_PER_LABEL, least_share: float = LEAST_SHARE) -> list[tuple[str, str]]:
    """(content, code) of about ``rows`` rows with labels that have the least share; chosen by a hash of the id.

    Two narrow passes: labels are counted, then rows are taken whose hash lies below what yields twice the number
    wanted.  What comes to the driver is bounded by twice ``rows`` and, for each label of the table above, ``per_label``.
    """
    code = canonical_label(F.col(label))
    sizes = {r["code"]: r["n"] for r in df.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n")).collect() if r["code"] not in ("", "?")}
    total = sum(sizes.values())
    classes = {c: n for c, n in sizes.items() if n >= least_share * total}
    if len(classes) < 2:
        raise ValueError("labelled rows in two languages at least are needed")
    draw = F.pmod(F.xxhash64(row_id), F.lit(1 << 30)) / float(1 << 30)
    roots = sum(n**0.5 for n in classes.values())
    wanted = {c: max(per_label, round(rows * n**0.5 / roots)) for c, n in classes.items()}
    share = F.create_map(*[x for c, n in classes.items() for x in (F.lit(c), F.lit(min(1.0, 2.0 * wanted[c] / n)))])
    drawn = df.select(code.alias("code"), draw.alias("draw"), F.col(content).alias("content")).where(F.col("draw") < share[F.col("code")]).where(F.length("content").between(31, SAMPLE_CHARS))
    out: list[tuple[str, str]] = []
    have = dict.fromkeys(classes, 0)
    for r in sorted(drawn.collect(), key=lambda r: (r["draw"], r["content"])):
        if have[r["code"]] < wanted[r["code"]]:
            have[r["code"]] += 1
            out.append((r["content"], r["code"]))
    return out


def fit(df: DataFrame, row_id: str, content: str, label: str, rows: int = SAMPLE_ROWS, sentences: int = FIT_SENTENCES, skip: int = 0) -> LanguageModel:
    try:
        sample = labelled_sample(df, row_id, content, label, rows)
    except ValueError:
        return LanguageModel(["und"], np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), accept=2.0)
    pairs = [(t[s : min(e, s + 160)], c, i) for i, (t, c) in enumerate(sample) for s, e in sentence_spans(t)[skip : skip + 12]]
    order = np.random.default_rng(1).permutation(len(pairs))[:sentences]
    return fit_languages([pairs[i][0] for i in order], [pairs[i][1] for i in order], [pairs[i][2] for i in order])


def judge(model: LanguageModel, texts: Sequence[str | None], skip: Sequence[int]) -> list[list[tuple[int, int, str, float, bool]]]:
    """For each text its sentences (start, end, language, confidence, sure), those before ``skip`` left out."""
    spans = [[(s, e) for s, e in sentence_spans(t) if s >= k] if t else [] for t, k in zip(texts, skip)]
    flat = [t[s:e] for t, own in zip(texts, spans) for s, e in own]
    p = model.probabilities(flat)
    best, top = p.argmax(axis=1), p.max(axis=1)
    at, out = 0, []
    for own in spans:
        n = len(own)
        mine, sure = best[at : at + n], top[at : at + n] >= model.accept
        if n:
            weight = np.array([e - s for s, e in own], float)
            votes = np.bincount(mine[sure], weight[sure], len(model.languages)) if sure.any() else (p[at : at + n] * weight[:, None]).sum(axis=0)
            main = int(votes.argmax())
            out.append([(s, e, model.languages[m if ok else main], float(p[at + i, m if ok else main]), bool(ok)) for i, ((s, e), m, ok) in enumerate(zip(own, mine.tolist(), sure.tolist()))])
        else:
            out.append([])
        at += n
    return out


_SEGMENTS = "start int, end int, lang string, confidence double, sure boolean"


def language_segments(df: DataFrame, keys: Sequence[str], content: str, model: LanguageModel, skip: str | None = None, per_sentence: bool = True) -> DataFrame:
    """(keys, start, end, lang, confidence, sure) of each sentence; or, not per_sentence, of each language of each text.

    Then start and end are those of the first and last sentence in the language, and the confidence is the mean over its
    characters.  ``skip`` names a column with the position before which nothing counts.  No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [f"_k{i}" for i in range(len(keys))]
    schema = ", ".join(f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, keys)) + ", " + _SEGMENTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for a in range(0, len(whole), 2000):
                pdf = whole.iloc[a : a + 2000]
                rows = []
                for i, own in enumerate(judge(shared.value, pdf["_text"].tolist(), pdf["_skip"].tolist())):
                    if per_sentence:
                        rows += [(i, *x) for x in own]
                        continue
                    for lang in sorted({x[2] for x in own}):
                        mine = [x for x in own if x[2] == lang]
                        size = sum(x[1] - x[0] for x in mine)
                        rows.append((i, mine[0][0], mine[-1][1], lang, sum(x[3] * (x[1] - x[0]) for x in mine) / size, any(x[4] for x in mine)))
                out = pdf[names].iloc[[r[0] for r in rows]].reset_index(drop=True)
                for c, name in enumerate(("start", "end", "lang", "confidence", "sure"), 1):
                    out[name] = [r[c] for r in rows]
                yield out

    chosen = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(content).alias("_text"), (F.col(skip) if skip else F.lit(0)).cast("int").alias("_skip"))
    got = chosen.where(F.col("_text").rlike(r"\p{L}")).mapInPandas(run, schema)
    return got.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "start", "end", "lang", "confidence", "sure")


def context_line(content: Column) -> Column:
    """Length of a bracketed context line with the empty line behind it, 0 if there is none."""
    return F.length(F.regexp_extract(content, r"^(\[[^\n]*\]\s*\n\s*\n)", 1))
