"""Evaluation passages inside training documents.

Method: training suffix arrays.  Each shard of documents gets a suffix array over its words; every suffix of every test
passage is binary-searched in it, which gives all places of its first words; runs of such places along one line are the
longest verbatim matches.  A document and a passage that share enough places are aligned as a whole, place by place, so
that a passage is found although single words were changed, left out, moved or put in.

Words are compared after normalising what copying, scanning and layout leave: letter case, marks, look-alike letters,
soft and line-end hyphens, invisible characters; a word a slip away from a test word counts as that word.  Function
words, which rewording changes first, are left out of both sides; spans are counted in all words of the passage.  In
scripts without spaces each character (Thai: each stretch up to a leading vowel) is a word, six tenths of one long.

What an item alone has is told over the whole test set: items with equal words are one class, and so are items whose
sets of five-word shingles have a similarity of 0.8 or more; a word is a class's own if no other class has it.

A stretch of an alignment counts if it spans ``min_span`` words and one of these holds
* it is matched to ``min_density`` and half of the item's own words in it stand in the document's stretch;
* the item has no own word in it, it is two words longer and matched to ``plain_density``, half of it verbatim;
* ``long_matched`` of its words are matched and it is matched to ``long_density``, whatever words it lacks.

Defined results
* null, empty or blank documents and passages: no match; a null document id or item id: no row;
* one row per document and item, however often and in however many of its passages it was found;
* filed-again copies: a row for each; repeated test rows: one row; items with equal texts: a row for each;
* remarks of any length put into a passage are bridged if what stands on either side outweighs them (a tenth of a word
  for each word put in);
* very long documents: aligned only where places lie; empty tables: no row;
* a stretch with fewer than ``MIN_SEEDS`` intact word triples is not aligned, nor one with fewer than
  ``MIN_SEEDS_PLAIN`` in a document with no word of the item's own.

No shuffle of documents.  The test set goes to the workers in blocks of ``block_words`` words, a bound on what the
driver holds and broadcasts at once; a larger test set means more passes, not more memory.  Only slips depend on the
blocks: a misspelt word that is a slip away from two test words counts as neither if both are in its block.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from quarrylight.operators.components import connected_components
from quarrylight.operators.sets import similar_sets
from quarrylight.session import cut

#: words of a place that is looked up; places that a document and a passage need to be aligned; places that are needed
#: where the document has none of the words that the item alone has
SEED, MIN_SEEDS, MIN_SEEDS_PLAIN = 3, 3, 8
#: cost of a passage word without a counterpart and of a word put in; a stretch worth less than the last is not looked at
MISS, PUT_IN, LEAST = 0.8, 0.1, 6.0
# Function words and what takes their place in rewording.
FUNCTION_WORDS = frozenset("a an the that this these those one of from for in on at by to as with and plus or but is are was were be been being it its which who".split())
# Letters that look like Latin ones (in lower case), and digits that scanning takes for letters.
_LOOKS = str.maketrans("аеорсухіјѕԁһтмкнвαβεζηικμνορτυχ", "aeopcyxijsdhtmkhbabezhikmvoptyx")
_SCANNED = str.maketrans("01|5€", "olls" + "e")
_INVISIBLE = re.compile("[%s]" % "".join(re.escape(chr(c)) for c in range(0x10000) if unicodedata.category(chr(c)) in ("Cf", "Mn")))
_LINE_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*[\n\r]\s*(?=[^\W\d_])")
_WORD = re.compile(r"\d+|[^\W_]+")
_IN_NUMBER = re.compile(r"(\d)[.,](?=\d)")
#: scripts without spaces: one character is a word; in Thai and Lao a word begins at a leading vowel or behind a final one
_SINGLE = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffffက-႟ក-៿]")
_THAI_START = re.compile("(?=[เ-ไເ-ໄ])|(?<=[ะาำະາຳ])")
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
#: length of such a word
UNSPACED_WORD = 0.6


def words_of(text: str | None, unspaced: bool = True, looks: bool = True) -> list[str]:
    """Normalised words of a text; without ``unspaced``, runs of scripts without spaces are left as they are, without
    ``looks`` letters that look like Latin ones."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
        if unspaced and _UNSPACED.search(text):
            text = _THAI_START.sub(" ", _SINGLE.sub(r" \g<0> ", text))
        if looks:
            text = text.lower().translate(_LOOKS)
    if "-" in text or "‐" in text or "‑" in text:
        text = _LINE_HYPHEN.sub("", text)
    return _WORD.findall(_IN_NUMBER.sub(r"\1", text).lower())


def content_words(texts: Sequence[str | None]) -> list[str]:
    """The words of an item's texts, one behind the other, without function words."""
    return [w for t in texts for w in words_of(t) if w not in FUNCTION_WORDS]


class Passages:
    """Test passages as word ids, with what is needed to recognise their words.

    ``own``: the words that each item alone has; where it is not given, each item is its own class.
    """

    def __init__(self, items: Sequence[tuple[str, Sequence[str | None]]], own: Sequence[Sequence[str]] | None = None) -> None:
        self.ids: dict[str, int] = {}
        self.seq: list[np.ndarray] = []
        #: where each word of a sequence begins and ends, counted in all words of its passage
        self.start: list[np.ndarray] = []
        self.end: list[np.ndarray] = []
        self.item: list[str] = []
        given: list[set[str]] = []
        for at, (name, texts) in enumerate(items):
            every = [x for t in texts for x in words_of(t)]
            kept = [i for i, x in enumerate(every) if x not in FUNCTION_WORDS]
            if len(kept) >= SEED:
                size = np.cumsum([UNSPACED_WORD if _UNSPACED.match(x) else 1.0 for x in every])
                self.end.append(size[kept])
                self.start.append(np.concatenate(([0.0], size))[kept])
                self.seq.append(np.array([self.ids.setdefault(every[i], len(self.ids) + 1) for i in kept], np.int64))
                self.item.append(name)
                given.append(set(own[at]) if own is not None else {every[i] for i in kept})
        if own is None:
            seen: dict[str, int] = {}
            for words in given:
                for w in words:
                    seen[w] = seen.get(w, 0) + 1
            given = [{w for w in words if seen[w] == 1} for words in given]
        self.own_of = [{self.ids[w] for w in words if w in self.ids} for words in given]
        self.unspaced = any(_UNSPACED.match(w) for w in self.ids)
        self.near: dict[str, int] = {}
        for w, i in self.ids.items():
            if len(w) >= 5 and w.isalpha():
                for k in range(len(w)):
                    self.near[w[:k] + w[k + 1 :]] = -1 if (s := w[:k] + w[k + 1 :]) in self.near and self.near[s] != i else i
                self.near[w] = i
        self.base = len(self.ids) + 1
        grams = [self._grams(s) for s in self.seq]
        self.seeds = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        #: every suffix by its first words: the passage, the place in it, and the words
        self.which = np.repeat(np.arange(len(self.seq)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        self.offset = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        self.heads = np.concatenate([np.stack((s[:-2], s[1:-1], s[2:]), axis=1) for s in self.seq]) if grams else np.zeros((0, SEED), np.int64)
        #: what is known of words: the id of a test word, 0 for others, -1 for function words
        self.known: dict[str, int] = self._start()

    def _start(self) -> dict[str, int]:
        return {**dict.fromkeys(FUNCTION_WORDS, -1), **self.ids}

    def _grams(self, s: np.ndarray) -> np.ndarray:
        return (s[:-2] * self.base + s[1:-1]) * self.base + s[2:]

    def _recognise(self, word: str) -> int:
        seen, word, found = word, word.translate(_LOOKS), 0
        if word != seen:
            found = self.known.get(word, 0)
        if not found and any(c.isdigit() for c in word) and not word.replace(",", "").replace(".", "").isdigit():
            found = self.ids.get(word.translate(_SCANNED), 0)
        if not found and len(word) >= 5 and word.isalpha():
            found = max(0, self.near.get(word, 0)) or next((i for k in range(len(word)) if (i := self.near.get(word[:k] + word[k + 1 :], 0)) > 0), 0)
        if len(self.known) > 1_000_000:
            self.known = self._start()
        self.known[seen] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        known, miss = self.known.get, self._recognise
        got = np.array([i if (i := known(w)) is not None else miss(w) for w in words_of(text, self.unspaced, False)], np.int64)
        return got[got >= 0]

    def promising(self, s: np.ndarray) -> bool:
        """Whether a document has as many of the test set's word triples as an alignment needs."""
        if len(s) < SEED:
            return False
        g = self._grams(s)[(s[:-2] > 0) & (s[1:-1] > 0) & (s[2:] > 0)]
        if len(g) < MIN_SEEDS:
            return False
        at = np.searchsorted(self.seeds, g)
        return int((self.seeds[np.minimum(at, len(self.seeds) - 1)] == g).sum()) >= MIN_SEEDS


class SuffixArray:
    """The suffixes of a shard's word ids in order, by prefix doubling until all are told apart."""

    def __init__(self, text: np.ndarray) -> None:
        self.text = np.concatenate((text, np.full(SEED, -1, np.int64)))
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
        h = 1
        while h < len(text) and rank.max(initial=0) < len(text):
            behind = np.concatenate((rank[h:], np.zeros(min(h, len(rank)), np.int64)))[: len(rank)]
            rank = np.unique(rank * (len(text) + 2) + behind, return_inverse=True)[1].astype(np.int64) + 1
            h *= 2
        self.order = np.argsort(rank, kind="stable")

    def bounds(self, queries: np.ndarray, right: bool) -> np.ndarray:
        """For each row of at most ``SEED`` words, the first place in order whose suffix is not below it (right: above all that begin with it)."""
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.order), np.int64)
        reach = np.arange(queries.shape[1])
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = self.order[np.minimum(mid, len(self.order) - 1)]
            diff = self.text[at[:, None] + reach] - queries
            first = (diff != 0).argmax(axis=1)
            sign = diff[np.arange(len(diff)), first]
            go = (sign <= 0) if right else (sign < 0)
            lo = np.where(open_ & go, mid + 1, lo)
            hi = np.where(open_ & ~go, mid, hi)
        return lo


def longest_run(offset: np.ndarray, place: np.ndarray) -> tuple[int, int]:
    """(words, place) of the longest run of places along one line: the longest verbatim match, of any length."""
    order = np.lexsort((offset, place - offset))
    line, at = (place - offset)[order], offset[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(line) != 0) | (np.diff(at) > 1))))
    length = at[np.append(new[1:], len(at)) - 1] - at[new] + SEED
    k = int(length.argmax())
    return int(length[k]), int(place[order][new[k]])


def best_stretches(pairs: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], least: float, cells: int = 200_000) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """(rows, columns) of the matched words of the best stretch of each (passage, places, words at these places), None
    where it is not worth ``least``; many pairs at a time.

    Local alignment by rows: a match is worth one word, a passage word left out costs ``MISS``, a word put in ``PUT_IN``.
    """
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(pairs)
    order = sorted((i for i in range(len(pairs)) if len(pairs[i][1])), key=lambda i: len(pairs[i][1]))
    put_in, miss = np.float32(PUT_IN), np.float32(MISS)
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop - at + 1) * len(pairs[order[stop]][1]) <= cells:
            stop += 1
        part, at = order[at:stop], stop
        n, m = max(len(pairs[i][1]) for i in part), max(len(pairs[i][0]) for i in part)
        word, seq = np.full((len(part), n), -1, np.int32), np.full((m, len(part)), -2, np.int32)
        ramp = np.zeros((len(part), n), np.float32)
        for k, i in enumerate(part):
            passage, place, words = pairs[i]
            seq[: len(passage), k], word[k, : len(words)] = passage, words
            ramp[k, : len(place)] = put_in * (place - place[0])
            ramp[k, len(place) :] = ramp[k, len(place) - 1]
        gap = np.zeros_like(ramp)
        np.maximum(ramp[:, 1:] - ramp[:, :-1] - put_in, 0, out=gap[:, 1:])
        score, before, best = np.zeros((len(part), n), np.float32), np.zeros((len(part), n), np.float32), np.zeros(len(part), np.float32)
        row, column, moves = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), []
        for i in range(m):
            np.maximum(score[:, :-1] - gap[:, 1:], 0, out=before[:, 1:])
            cell = np.maximum(score - miss, 0)
            hit = (word == seq[i][:, None]) & (before + 1 > cell)
            run = cell + ramp
            np.copyto(run, before + 1 + ramp, where=hit)
            score = np.maximum.accumulate(run, axis=1)
            # 1 a match, 3 a word put in, 2 a passage word left out or, at no worth, the stretch's beginning
            move = np.where(score > run + np.float32(1e-4), np.int8(3), np.where(hit, np.int8(1), np.int8(2)))
            score -= ramp
            moves.append(move)
            top = score.max(axis=1)
            better = top > best + np.float32(1e-4)
            best, row = np.where(better, top, best), np.where(better, i, row)
            if better.any():
                column[better] = score[better].argmax(axis=1)
        for k in np.flatnonzero(best >= least):
            i, j, worth, got = int(row[k]), int(column[k]), float(best[k]), []
            # from its best end back to where the worth is used up
            while i >= 0 and j >= 0 and worth > 1e-3:
                go = moves[i][k, j]
                if go == 1:
                    got.append((i, j))
                    worth -= 1.0
                    if worth > 1e-3:
                        worth += float(gap[k, j])
                    i, j = i - 1, j - 1
                elif go == 2:
                    i, worth = i - 1, worth + MISS
                else:
                    worth += float(ramp[k, j] - ramp[k, j - 1])
                    j -= 1
            out[part[k]] = tuple(np.array(got[::-1], np.int64).T)
    return out


def aligned_stretches(pairs: Sequence[tuple[np.ndarray, np.ndarray]], least: float = LEAST) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each (passage, text) the (places in the passage, places in the text) of the matched words of its stretches.

    Words of the best stretch are taken out of the text before the next one is sought, until none is worth ``least``.
    Words that the passage lacks are words put in, which only their number tells apart.
    """
    out: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in pairs]
    places = [np.flatnonzero(np.isin(t, p)) for p, t in pairs]
    left = list(range(len(pairs)))
    while left:
        found = best_stretches([(pairs[i][0], places[i], pairs[i][1][places[i]]) for i in left], least)
        again = []
        for i, got in zip(left, found):
            if got is not None:
                out[i].append((got[0], places[i][got[1]]))
                places[i] = np.delete(places[i], got[1])
                again.append(i)
        left = again
    return out


def search_shard(passages: Passages, doc_ids: Sequence, texts: Sequence[str | None]) -> list[tuple]:
    """(doc id, item, passage number, longest verbatim match, its first word in the document, all words spanned, words of the
    sequence spanned, of them matched, own words spanned, of them met) of each stretch of the pairs of a shard."""
    kept = [(d, s) for d, t in zip(doc_ids, texts) if passages.promising(s := passages.encode(t))]
    if not kept:
        return []
    lengths = np.array([len(s) + 1 for _, s in kept])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    # words outside the test set and document ends match nothing: each is a number of its own
    text = np.concatenate([np.append(s, 0) for _, s in kept])
    text = np.where(text == 0, -3 - np.arange(len(text)), text)
    array = SuffixArray(text)
    owner = np.repeat(np.arange(len(kept)), lengths)
    lo, hi = array.bounds(passages.heads, False), array.bounds(passages.heads, True)
    count = hi - lo
    if not (total := int(count.sum())):
        return []
    rows = np.repeat(np.arange(len(count)), count)
    place = array.order[lo[rows] + np.arange(total) - np.repeat(np.cumsum(count) - count, count)]
    at = passages.offset[rows]
    key = owner[place] * len(passages.seq) + passages.which[rows]
    order = np.lexsort((place, at, key))
    key, place, at = key[order], place[order], at[order]
    new = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0)))
    # different places of the passage, not how often each occurs
    fresh = np.concatenate(([True], (np.diff(key) != 0) | (np.diff(at) != 0)))
    seeds = np.add.reduceat(fresh.astype(np.int64), new)
    ends = np.append(new[1:], len(key))
    present: dict[int, set[int]] = {}
    sought: list[tuple[int, int, int, int]] = []
    for k in np.flatnonzero(seeds >= MIN_SEEDS):
        d, p = divmod(int(key[new[k]]), len(passages.seq))
        if seeds[k] < MIN_SEEDS_PLAIN:
            if d not in present:
                present[d] = set(kept[d][1].tolist())
            if passages.own_of[p].isdisjoint(present[d]):
                continue
        there, m = np.sort(place[new[k] : ends[k]]), len(passages.seq[p])
        # further apart than a whole passage can outweigh, places are never on one stretch
        cuts = np.flatnonzero(np.diff(there) > m / PUT_IN)
        for a, b in zip(np.concatenate(([0], cuts + 1)), np.append(cuts, len(there) - 1)):
            sought.append((int(k), p, max(int(starts[d]), int(there[a]) - m), min(int(starts[d] + lengths[d]), int(there[b]) + SEED + m)))
    out: list[tuple] = []
    for (k, p, x, y), stretches in zip(sought, aligned_stretches([(passages.seq[p], text[x:y]) for _, p, x, y in sought])):
        if not stretches:
            continue
        d = int(key[new[k]]) // len(passages.seq)
        longest, first = longest_run(at[new[k] : ends[k]], place[new[k] : ends[k]])
        own = passages.own_of[p]
        for mine, its in stretches:
            special = own.intersection(passages.seq[p][mine[0] : mine[-1] + 1].tolist())
            met = special.intersection(text[x + its[0] : x + its[-1] + 1].tolist())
            span = float(passages.end[p][mine[-1]] - passages.start[p][mine[0]])
            out.append((kept[d][0], passages.item[p], p, longest, int(first - starts[d]), int(span + 0.5), int(mine[-1] - mine[0] + 1), len(mine), len(special), len(met)))
    return out


def own_words(items: DataFrame, item_id: str, passages: Sequence[str], similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The items' distinct rows with ``own``, the words that no item of another class has, over the whole test set."""
    names = [f"_t{i}" for i in range(len(passages))]
    rows = items.select(F.col(item_id).cast("string").alias("_item"), *[F.col(c).cast("string").alias(n) for c, n in zip(passages, names)]).where("_item is not null").distinct()
    schema = StructType(list(rows.schema.fields)).add("_words", ArrayType(StringType())).add("_grams", ArrayType(StringType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [content_words(row) for row in pdf[names].itertuples(index=False)]
            yield pdf.assign(_words=[list(dict.fromkeys(w)) for w in words], _grams=[list(dict.fromkeys(" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1)))) for w in words])

    keyed = cut(rows.mapInPandas(run, schema).withColumn("_class", F.sha2(F.array_join("_grams", "\n"), 256)))
    one = keyed.groupBy("_class").agg(F.first("_words").alias("_words"), F.first("_grams").alias("_grams"))
    near = cut(similar_sets(one, "_class", "_grams", similarity).select("a", "b"))
    classes = one.select("_class", "_words")
    if not near.isEmpty():
        classes = classes.join(connected_components(near).withColumnRenamed("node", "_class"), "_class", "left")
    else:
        classes = classes.withColumn("component", F.lit(None).cast("string"))
    words = classes.select(F.coalesce("component", "_class").alias("_group"), "_class", F.explode("_words").alias("_word"))
    alone = words.groupBy("_word").agg(F.min("_group").alias("_group"), F.max("_group").alias("_other")).where("_group = _other").drop("_other")
    own = words.join(alone, ["_word", "_group"]).groupBy("_class").agg(F.collect_set("_word").alias("own"))
    return keyed.join(own, "_class", "left").select("_item", *names, F.coalesce("own", F.array().cast("array<string>")).alias("own"))


_RAW = "item string, passage int, longest int, longest_at int, span int, words int, matched int, own int, own_matched int"
#: the last block of tests that this Python worker has built, by the broadcast it is from
_BUILT: dict[int, Passages] = {}


def _search(docs: DataFrame, shared, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        if id(block) not in _BUILT:
            _BUILT.clear()
            _BUILT[id(block)] = Passages([(name, texts) for name, texts, _ in block], [own for _, _, own in block])
        tests = _BUILT[id(block)]
        for pdf in batches:
            rows = search_shard(tests, pdf["doc"].tolist(), pdf["text"].tolist()) if tests.seq else []
            yield pd.DataFrame(rows, columns=["doc", *[c.split()[0] for c in _RAW.split(", ")]])

    return docs.mapInPandas(run, schema)


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, passages: Sequence[str],
    min_span: int = 20, min_density: float = 0.6, plain_density: float = 0.93, long_matched: int = 24, long_density: float = 0.8, block_words: int = 2_000_000, raw: bool = False,
) -> DataFrame:
    """(doc_id, item_id) of each document that holds a passage of an item; with ``raw`` all aligned stretches and their sizes."""
    sc = docs.sparkSession.sparkContext
    schema = f"doc {docs.schema[doc_id].dataType.simpleString()}, {_RAW}"
    given = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).dropna()
    parts: list[DataFrame] = []
    block: list[tuple[str, list[str | None], list[str]]] = []
    size = 0
    # the test set is read row by row, one block in the driver's memory at a time: all but the last are searched at once
    for row in own_words(items, item_id, passages).toLocalIterator():
        if size > block_words:
            shared = sc.broadcast(block)
            parts.append(cut(_search(given, shared, schema)))
            shared.destroy()
            block, size = [], 0
        block.append((row[0], list(row[1:-1]), row[-1]))
        size += sum(len(t) // 5 + 1 for t in row[1:-1] if t)
    parts.append(_search(given, sc.broadcast(block), schema))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    if raw:
        return found
    # what is merely phrased alike lacks the words that the item alone has
    own = (F.col("own") > 0) & (F.col("own_matched") >= F.col("own") * 0.5) & (F.col("matched") >= F.col("words") * min_density) & (F.col("span") >= min_span)
    plain = (F.col("own") == 0) & (F.col("matched") >= F.col("words") * plain_density) & (F.col("span") >= min_span + 2) & (F.col("longest") >= F.col("words") * 0.5)
    long = (F.col("matched") >= long_matched) & (F.col("matched") >= F.col("words") * long_density) & (F.col("span") >= min_span)
    return found.where(own | plain | long).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).distinct()


def without_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str) -> DataFrame:
    """The documents that hold no test passage."""
    return docs.join(leaks.select(doc_id).distinct(), doc_id, "left_anti")
