"""Sentence units for text in many languages and scripts.

Method: ordered break / no-break rules.  A rule is a pair of regular
expressions, one that must match what stands before a position and one that
must match what follows.  Rules are kept in tables (general, per language, per
script); a cascade is an ordered list of tables, and the first rule that
matches a position decides it.  Positions that are tried are those behind a
terminal mark, at a line end and, in Thai text, at a space.

Where no language is named, each sentence has the cascade of its own: the short
forms of a Latin language count only where the function words around the
position are that language's as much as any other's.  So a text may mix
languages, and nothing but the text is asked.

Defined results
* null, empty and blank text: no unit.
* a text without any mark: one unit, without surrounding white space.
* repeated rows: every row gets its units again; nothing is deduplicated.
* very long text: handled whole; memory is proportional to one text.
* clashing column names: the operator keeps only the key columns it is given
  and adds ``sent_no``, ``sent_start``, ``sent_end``, ``sentence``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BREAK, JOIN = True, False


class Rule(NamedTuple):
    breaks: bool
    before: re.Pattern[str] | None
    after: re.Pattern[str] | None
    #: the language in whose sentences alone the rule holds
    only: str | None = None


def _rule(breaks: bool, before: str = "", after: str = "", only: str | None = None) -> Rule:
    return Rule(breaks, re.compile(rf"(?:{before})\Z") if before else None, re.compile(after) if after else None, only)


def _words(text: str) -> str:
    return "|".join(re.escape(w) for w in text.split())


# Words that open sentences and are no part of names.
STARTERS = _words(
    "The A An This That These Those It We You They He She I If When Where While Whereas Unless Until Since "
    "Because After Before During Under Over From In On At By For To Of With Without No Not Any Each Every All "
    "Do Does Did Has Have Had Is Are Was Were Can Could Should Would Will Must May Who What Which Why How "
    "Please Then There Here Otherwise However Therefore Cf See Only Copies Requests Losses Questions Staff "
    "Der Die Das Ein Eine Jeder Jede Jedes Ohne Wenn Falls Nach Vor Gemäß Wurde Wird Bei Im Für Es Er Sie Wir "
    "Le La Les Un Une Ce Cette Ces Aucun Aucune Chaque Selon Si Pour Dans Il Elle Nous Vous "
    "El Los Las Una Cada Según No Se O Os As Um Uma Segundo Não Nenhum Em Quando Se "
    "В На По Если Был Была Было Каждый Каждая Без Согласно Для При Он Она Мы Вы Это"
)
# Words of company names; after one of their short forms they continue the name.
COMPANY = _words(
    "Bank Bk Trust Tr Holding Holdings Hldg Finance Fin Group Grp Insurance Ins Company Co Corp Corporation Inc Ltd Limited "
    "Credit Cred Registry Reg Leasing Leas Audit Aud Partners Ptnrs Agency Agcy National Natl International Intl "
    "Clearing House Association Assoc Institute Inst Services Svcs Service Settlement Council Coun Union Fund "
    "Capital Management Mgmt Department Dept Brothers Bros Sons University Univ Foundation Fdn LLC PLC GmbH AG SA"
)
COMPANY_SHORT = _words(
    "Bk Tr Hldg Hldgs Fin Grp Ins Co Corp Inc Ltd Cred Reg Leas Aud Ptnrs Agcy Natl Intl Assoc Inst Svcs Coun Mgmt "
    "Dept Bros Univ Fdn Exch Sec Cap Mut"
)
LOWER = "a-zß-öø-ÿа-яёœ"
_UP = "A-ZÀ-ÖØ-ÞА-ЯЁŒ"
_UNCASED = "֐-ۿݐ-ݿऀ-෿฀-໿぀-ヿ㐀-鿿가-힯"
_OPEN = "\"“”„«»‘’'(\\[¿¡「『（《"
_W = rf"(?<![\w.])"  # a word begins here

#: general rules, tried first
GENERAL = [
    _rule(JOIN, r"[\d]\.", r"\d"),
    _rule(JOIN, "", rf"\s*[,;:，、；：)\]）—–·]"),
    _rule(JOIN, r"(?:\A|\n)[ \t]*(?:\d{1,3}|[A-Za-z])[.)]", r"[ \t]"),
    _rule(BREAK, r"[.!?…][\"”“’»)\]]*", rf"\s+[a-z][A-Z]\w"),
    _rule(JOIN, r"[.!?…][\"”“’»)\]]*", rf"[ \t]*\n?[ \t]*[\"“«(]?[{LOWER}]"),
]
#: per language: what never ends a sentence, and what ends one only before certain words
LANGUAGE = {
    "en": [
        _rule(JOIN, _W + r"(?:Mr|Mrs|Ms|Messrs|Dr|Prof|Rev|Hon|Gen|Col|Capt|St|Mt|Ft|vs|cf|Cf|viz|approx|incl|excl|bldg|esp|ibid)\.", r"\s"),
        _rule(JOIN, r"(?<![\w.])(?:i\.\s?e|e\.\s?g)\.", ""),
        _rule(JOIN, _W + r"(?:[Nn]o|[Nn]os|[Aa]rt|[Aa]rts|[Ss]ec|[Ff]ig|[Ff]igs|[Aa]pp|[Ee]q|[Pp]ara|[Cc]h|[Vv]ol|[Ee]d|pp?|[Rr]ef|[Cc]l|[Ss]ect)\.", r"\s*[\d§]"),
        _rule(JOIN, _W + rf"(?:{COMPANY_SHORT})\.", rf"\s+(?:{COMPANY}|&|and)\b"),
    ],
    "de": [
        _rule(JOIN, _W + r"(?:Hr|Fr|Frl|Nr|Abs|Bd|Ziff|Kap|bzw|ca|evtl|ggf|inkl|exkl|sog|usf|vgl|Vgl|Str|Dipl|Ing|geb|Anm)\.", r"\s", "de"),
        _rule(JOIN, r"(?<![\w.])(?:[zduoi]\.\s?(?:B|h|a|ä|U|R|E|V)|u\.\s?s\.\s?w)\.", ""),
        _rule(JOIN, r"(?<![\w.])[zduoi]\.", r"\s?(?:B|h|a|ä|U|R|E|V|s)\."),
        _rule(JOIN, r"(?<!\d)\d{1,2}\.", r"\s(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)"),
    ],
    "fr": [
        _rule(JOIN, _W + r"(?:M|MM|Mme|Mlle|Mgr|Me|éd|env|max|min|vol|chap)\.", r"\s", "fr"),
        _rule(JOIN, r"(?<!\w)(?:p\.\s?ex|c\.-à-d|[Aa]rt|n)\.", r"\s", "fr"),
        _rule(JOIN, r"(?<!\w)p\.", r"\s?(?:ex\.|\d)"),
    ],
    "es": [
        _rule(JOIN, _W + r"(?:Sr|Sra|Sres|Sras|Srta|D|Dña|Lic|Ud|Uds|núm|Núm|pág|págs|art|arts|aprox|p|ej|EE|UU|Excmo)\.", r"\s", "es"),
    ],
    "pt": [
        _rule(JOIN, _W + r"(?:Sr|Sra|Srs|Exmo|Eng|Dra|pág|n|núm|art|aprox|ex)\.", r"[\sºª]", "pt"),
    ],
    "ru": [
        _rule(JOIN, r"(?<!\w)(?:т\.\s?[епдкн]|и\.\s?о|т|ст|гл|г|гг|руб|коп|см|им|проф|акад|пп|стр|рис|табл|тыс|млн|млрд|др|п)\.", r"\s*[\dа-яё«(№А-ЯЁ]"),
    ],
    "ar": [
        _rule(JOIN, r"(?<!\w)(?:د|أ|م|ص|ج|هـ|أ\.د|رقم)\.", r"\s"),
    ],
}
#: short forms that end a sentence only if a new one plainly begins; initials
LATIN = [
    _rule(BREAK, _W + rf"(?:{COMPANY_SHORT})\.", rf"\s+[{_OPEN}]*[{_UP}]"),
    _rule(BREAK, r"(?<![\w])(?:[ap]\.\s?m|etc|usw|et al|al)\.", rf"\s+[{_OPEN}]*[{_UP}]"),
    _rule(BREAK, rf"(?<![\w])[{_UP}]\.", rf"\s+(?:{STARTERS})\b"),
    _rule(JOIN, rf"\b(?:{COMPANY}), (?:[{_UP}]\.)+", ""),
    _rule(BREAK, rf"\w, (?:[{_UP}]\.)+", rf"\s+[{_OPEN}]*[{_UP}][{LOWER} ]"),
    _rule(JOIN, rf"(?<![\w])[{_UP}]\.", rf"\s*[{_UP}]|\s+[{_UNCASED}]"),
    _rule(JOIN, rf"(?<![\w])[{_UP}]\.", r"\S"),
    _rule(BREAK, rf"[{LOWER}\d%)\]”»][.!?]", rf"[{_UP}][{LOWER} '’]|[¿¡«„“][{_UP}]"),
]
#: at line ends
LINES = [
    _rule(BREAK, "", r"\s*\n\s*(?:[•*‣◦▪–—-]\s|\d{1,3}[.)]\s|\(?[A-Za-z]\)\s)"),
    _rule(BREAK, r":", r"\s*\n"),
    _rule(BREAK, "", r"[^\S\n]*\n[^\S\n]*\n"),
    # a mark before the line end was a position of its own
    _rule(JOIN, r"[.!?…؟。！？][\"”“’»」』)\]）]*", ""),
    _rule(BREAK, "", r"\s*\n\s*[a-z][A-Z]\w"),
    _rule(JOIN, "", rf"\s*\n\s*[{_OPEN}]*[{LOWER}\d]"),
    _rule(JOIN, r"[,،、，;–—-]|(?<!\w)(?:the|of|a|an|and|or|by|to|for|from|with|in|on|at|der|die|das|dem|den|des|und|von|le|la|les|de|du|des|et|par|el|los|las|del|y|por|o|os|as|do|da|e|и|в|на|с|по)", r"\s*\n"),
    _rule(BREAK, "", rf"\s*\n\s*[{_OPEN}]*[{_UP}]"),
    _rule(BREAK, "", rf"\s*\n\s*[{_OPEN}]*[{_UNCASED}]"),
    _rule(BREAK, r"[" + _UNCASED + "]", r"\s*\n"),
]
#: scripts without spaces or without terminal marks
CJK = [_rule(BREAK, r"[。！？][”’」』）\"]*", "")]
_THAI = "฀-๿"
THAI = [
    _rule(JOIN, "", rf"\s+(?:ให้|จึง|และ|หรือ|แต่|ซึ่ง|ที่|เพื่อ|โดย|ก็|เป็น|คือ|ว่า|จะ|ได้|แล้ว|ฯลฯ|ๆ)"),
    _rule(JOIN, r"(?<![" + _THAI + r"])(?:พ\.ศ|ค\.ศ|น|ดร|นาย|นาง|นางสาว|คุณ|ฯ)\.?", r"\s"),
    _rule(BREAK, rf"[{_THAI}]", rf"\s+[{_OPEN}]*(?=[{_THAI}])[^ๆฯ]"),
    _rule(BREAK, rf"[{_THAI}]", rf"\s+[{_OPEN}]*(?:(?:{STARTERS})\b|[{_UP}][^{_THAI}\n]{{24,}})"),
    _rule(BREAK, rf"[{_THAI}]", rf"\s+[{_OPEN}]*(?:[֐-ۿ぀-鿿Ѐ-ӿ])"),
]
#: what remains
REST = [
    _rule(BREAK, r"[.!?…؟۔।][\"”“’»」』)\]）]*", r"\s*\Z"),
    _rule(BREAK, r"[.!?…؟۔।][\"”“’»」』)\]）]*", rf"\s+[{_OPEN}]*\s?[{_UP}\d{_UNCASED}•*-]"),
    _rule(BREAK, r"[؟۔।]", ""),
    _rule(BREAK, rf"[{_UNCASED}\d٪%][.!?][\"”“’»]*", rf"[{_UNCASED}]"),
]
_TABLES = {"general": GENERAL, "latin": LATIN, "cjk": CJK, "thai": THAI, "lines": LINES, "rest": REST, **LANGUAGE}
#: cascades: the tables of a language in the order in which they are tried; "mul" where the language is told by the text
CASCADES = {
    **{lang: ("general", lang, "en", "latin", "cjk", "rest") for lang in ("de", "fr", "es", "pt", "ru", "ar")},
    "en": ("general", "en", "latin", "cjk", "rest"),
    "mul": ("general", "en", "de", "fr", "es", "pt", "ru", "ar", "latin", "cjk", "rest"),
    "cjk": ("cjk", "general", "en", "latin", "rest"),
}


def _span(opening: str, other: str, closing: str, short: int) -> str:
    """Up to the closing mark: over any length within a paragraph, over blank lines up to ``short`` characters."""
    return rf"{opening}(?:[^{other}]{{1,{short}}}?|(?:[^{other}\n]|\n(?!\s*\n))++){closing}"


# each kind excludes its own opening mark, so that no stretch is read twice for want of a closing one
_SPANS = re.compile(
    "|".join(
        [_span(x[0], x, f"[{x[1:]}]" if x[0] == "„" else x[1], 600) for x in ("„“”", "“”„", "«»", "「」", "『』", "《》")]
        + [r"(?<!\w)\"[^\"\n]+\"(?!\w)", r"\([^()\n]+\)", r"（[^（）\n]+）"]
    )
)
_HAS_SPAN = re.compile(r"[„“«「『《\"(（]")
_MARK = r"[.!?…؟۔।。！？\n][\"”“’»」』)\]）.!?…؟。！？]*"
_CANDIDATE = re.compile(_MARK)
_CANDIDATE_THAI = re.compile(_MARK + rf"|(?<=[{_THAI}])[ \t\xa0]+(?=[^\s\d])")
_HAS_THAI = re.compile(rf"[{_THAI}]")
_STRIP = re.compile(r"\S")
#: code points before a mark that the first expression of a rule may look at; longer than any short form
_LOOK = 14
# Function words by which the language of a Latin sentence is told, where a short form may be of several.
FUNCTION_WORDS = {
    "en": "the of and to in is are was were that this it he she they we you for with on at by from as not be has have had his her its their which who then if or but we our when all no",
    "de": "der die das den dem des und ist sind war wird werden ein eine einer einem einen nicht mit von zu im in auf für bei nach aus als auch an er sie es wir wenn oder sich durch über vor gemäß laut",
    "fr": "le la les de du des et est sont un une dans pour par sur avec au aux ce cette ces qui que ne pas il elle nous vous ou se son sa ses leur en si être selon",
    "es": "el la los las de del y es son un una en para por con no que se su sus al lo como más o si este esta estos ha han fue debe cada sin sobre según",
    "pt": "o a os as de do da dos das e é são um uma em no na nos nas para por com não que se seu sua ao à ou como mais este esta foi deve cada sem sobre pelo pela segundo",
}
_LANGUAGES_OF: dict[str, tuple[str, ...]] = {}
for _lang, _listed in FUNCTION_WORDS.items():
    for _w in set(_listed.split()):
        _LANGUAGES_OF[_w] = (*_LANGUAGES_OF.get(_w, ()), _lang)
_LATIN_WORD = re.compile(r"[a-zß-öø-ÿœ]+")
#: code points on either side of a position in which function words are counted
_NEAR, _AROUND = 60, 160


def spoken_around(text: str, start: int, at: int) -> frozenset[str]:
    """The languages whose function words are most frequent in the sentence up to a position, or behind it where it has none
    yet; all of them where there is none at all."""
    # the nearest first, as a unit that lacks its final mark may run on into another language
    for part in (text[max(start, at - _NEAR) : at], text[max(start, at - _AROUND) : at], text[at : at + _AROUND]):
        counts = dict.fromkeys(FUNCTION_WORDS, 0)
        for w in _LATIN_WORD.findall(part.lower()):
            for lang in _LANGUAGES_OF.get(w, ()):
                counts[lang] += 1
        if most := max(counts.values()):
            return frozenset(lang for lang, n in counts.items() if n == most)
    return frozenset(FUNCTION_WORDS)


_MEMO_SIZE = 200_000


#: no rule tells one digit from another, so that numbers need not be told apart in the memory
_SAME_DIGIT = {ord("0") + i: "0" for i in range(1, 10)}


class _Cascade:
    """Rules in order.  What the first expressions say of a stretch of text is remembered, as stretches recur."""

    def __init__(self, rules: list[Rule], mixed: bool = False) -> None:
        self.rules, self.memo, self.mixed = rules, {}, mixed

    def decide(self, before: str, text: str, at: int, start: int = 0) -> bool:
        before = before.translate(_SAME_DIGIT)
        left = self.memo.get(before)
        if left is None:
            left = tuple((r.breaks, r.after and r.after.match, r.only) for r in self.rules if r.before is None or r.before.search(before))
            if len(self.memo) >= _MEMO_SIZE:
                self.memo.clear()
            self.memo[before] = left
        spoken = None
        for breaks, after, only in left:
            if after is None or after(text, at):
                if only and self.mixed:
                    spoken = spoken_around(text, start, at) if spoken is None else spoken
                    if only not in spoken:
                        continue
                return breaks
        return JOIN


_BY_LANG = {name: _Cascade([r for t in tables for r in _TABLES[t]], name == "mul") for name, tables in CASCADES.items()}
_AT_LINE, _AT_THAI = _Cascade(LINES), _Cascade(THAI)
_UNCASED_CHAR = re.compile(rf"[{_UNCASED}]")


def sentence_spans(text: str | None, lang: str = "mul") -> list[tuple[int, int]]:
    """(start, end) of each unit of one text in code points, without surrounding white space."""
    if not text or not (first := _STRIP.search(text)):
        return []
    rules = _BY_LANG.get(lang, _BY_LANG["mul"])
    spans = [m.span() for m in _SPANS.finditer(text)] if _HAS_SPAN.search(text) else []
    out: list[tuple[int, int]] = []
    start, k, n_spans = first.start(), 0, len(spans)
    for m in (_CANDIDATE_THAI if _HAS_THAI.search(text) else _CANDIDATE).finditer(text):
        c = text[m.start()]
        kind = "line" if c == "\n" else "thai" if c in " \t\xa0" else "mark"
        at = m.end() if kind == "mark" else m.start()
        if at <= start:
            continue
        while k < n_spans and spans[k][1] < at:
            k += 1
        if k < n_spans and spans[k][0] < at < spans[k][1]:
            continue
        if kind == "line":
            said = at
            while said > start and text[said - 1].isspace():
                said -= 1
            ends = _AT_LINE.decide(text[max(start, said - _LOOK) : said], text, at)
        elif kind == "thai":
            ends = _AT_THAI.decide(text[max(start, at - _LOOK) : at], text, at)
        else:
            # a quotation that began inside the sentence belongs to it, where what follows has no capitals to tell
            if k < n_spans and spans[k][1] == at:
                nxt = _STRIP.search(text, at)
                if nxt and spans[k][0] > start and "\n" not in text[at : nxt.start()] and _UNCASED_CHAR.match(nxt.group()):
                    continue
                if text[at : at + 1] == "と":
                    continue
            # all closing marks, however many, and what stands before the first
            ends = rules.decide(text[max(0, m.start() + 1 - _LOOK) : at], text, at, start)
        if ends:
            end = at
            while end > start and text[end - 1].isspace():
                end -= 1
            if end > start:
                out.append((start, end))
            nxt = _STRIP.search(text, at)
            if not nxt:
                return out
            start = nxt.start()
    end = len(text)
    while end > start and text[end - 1].isspace():
        end -= 1
    if end > start:
        out.append((start, end))
    return out


def sentence_positions(df: DataFrame, keys: Sequence[str], text: str = "content", lang: str = "mul") -> DataFrame:
    """(key columns, sent_start, sent_end) of each sentence, repeated rows counted once.

    Only keys and positions, one row per text, are compared for repeats; texts are not moved.
    """
    keys = list(keys)
    names = [f"_k{i}" for i in range(len(keys))]
    places = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField(n, df.schema[k].dataType) for n, k in zip(names, keys)] + [T.StructField("_starts", places), T.StructField("_ends", places)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [sentence_spans(t, lang) for t in pdf["_text"]]
            yield pdf[names].assign(_starts=[[s for s, _ in x] for x in spans], _ends=[[e for _, e in x] for x in spans])

    chosen = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("_text")).where(F.col("_text").rlike(r"[^\s]"))
    each = chosen.mapInPandas(run, schema).distinct().select(*names, F.explode(F.arrays_zip("_starts", "_ends")).alias("_s"))
    return each.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("_s._starts").alias("sent_start"), F.col("_s._ends").alias("sent_end"))


def split_sentences(df: DataFrame, keys: Sequence[str], text: str = "content", lang: str = "mul") -> DataFrame:
    """One row per sentence: the key columns, sent_no, sent_start, sent_end, sentence.

    No shuffle: a text never leaves its partition.  See the module's docstring for nulls and ties.
    """
    keys = list(keys)
    fields = [df.schema[k] for k in keys]
    names = [f"_k{i}" for i in range(len(keys))]
    schema = T.StructType(
        [T.StructField(n, f.dataType) for n, f in zip(names, fields)]
        + [T.StructField("sent_no", T.IntegerType()), T.StructField("sent_start", T.IntegerType()), T.StructField("sent_end", T.IntegerType()), T.StructField("sentence", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple[int, int, int, int, str]] = []
            for i, t in enumerate(pdf["_text"]):
                rows += [(i, j, s, e, t[s:e]) for j, (s, e) in enumerate(sentence_spans(t, lang))]
            at = [r[0] for r in rows]
            out = pdf[names].iloc[at].reset_index(drop=True)
            for c, name in enumerate(("sent_no", "sent_start", "sent_end", "sentence"), 1):
                out[name] = [r[c] for r in rows]
            yield out

    got = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("_text")).where(F.col("_text").rlike(r"[^\s]")).mapInPandas(run, schema)
    return got.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "sent_no", "sent_start", "sent_end", "sentence")
