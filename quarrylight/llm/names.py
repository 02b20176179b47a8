"""Variant spellings of the names of persons and organisations.

Method: every string is rewritten, by rules, into canonical forms: case and
marks, titles, token order, nicknames, initials, legal forms, short forms of
company words, acronyms, transliterations, and one typing slip.  Forms are
exploded and equi-joined.  A form links all that have it, however many they
are; a string that is less than a whole name (initial, ambiguous nickname,
acronym) is linked only if one identity alone fits.

Defined results
* null, empty and blank strings, and strings without letters: no link;
* a string equal to another after rewriting: linked; a string is never paired
  with itself, and repeated rows change nothing but the vote on the kind;
* an initial that fits two relatives, an acronym that fits two sisters: no link
  to either (strings of the same incomplete form are linked to each other);
* names that differ in a number (Fund 11, Fund 12): never taken for a slip;
* very long strings: no slip is sought beyond 80 letters, all else holds;
* empty tables: no pair.  Other columns are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.components import connected_components
from quarrylight.session import cut

# Given names and the short or foreign forms used for them.
NICKNAMES = """
alexander: alex xander sasha alec
andrew: andy drew
anthony: tony
benjamin: ben
charles: charlie chuck
christopher: chris
daniel: dan danny
david: dave
dorothea: dora thea dorothy
edward: ed eddie ned ted
elizabeth: liz lisa beth betty eliza
fatima: fatou batta fatma
francisco: paco pancho cisco
gabriela: gabi gaby
hannelore: hanne lore
ibrahim: ibra bibo
james: jim jimmy
john: jack johnny
joseph: joe sepp joey
katherine: kate kathy kit katie catherine
ludmila: lyuda mila luda
margaret: maggie peg peggy meg greta
michael: mike mick
mohamed: mo hamada mohammed muhammad
nicholas: nick klaus nico
oksana: ksenia xana
patricia: pat trish patty tricia
peter: pete
reinhard: reini
richard: dick rick
robert: bob rob bobby
samantha: sam sammy
samuel: sam sammy
stephen: steve
theodore: ted theo teddy
thomas: tom
victoria: vicky tori vicki
william: bill will billy
youssef: joe sefo yusuf
zachary: zack zak zach
"""
# Titles, legal forms, and short forms of words in company names.
TITLES = frozenset("dr mr mrs ms miss prof professor eng ing sir rev hon herr frau mme mlle sr sra don dona".split())
LEGAL = frozenset("ltd limited co company comp cie plc inc incorporated corp llc llp gmbh ag sa sae sarl spa bv nv kg lp ooo pjsc saog".split())
COMPANY_SHORT = dict(
    x.split(":")
    for x in "hldg:holding hldgs:holdings fin:finance tr:trust bk:bank cred:credit reg:registry leas:leasing ins:insurance grp:group aud:audit ptnrs:partners "
    "settlmt:settlement sttlmt:settlement svcs:services svc:service natl:national intl:international assoc:association assn:association coun:council agcy:agency "
    "inst:institute dept:department mgmt:management fdn:foundation univ:university clrg:clearing fd:fund hse:house mon:monetary ovst:oversight trng:training pmt:payment intgty:integrity".split()
)
COMPANY_WORDS = frozenset(COMPANY_SHORT.values()) | frozenset("shield deposit interbank capital union society bros brothers sons".split())
_SMALL = frozenset("and of for the & de la und y et".split())
# Transliterations and sounds that are written in several ways.
_SOUNDS = (("ph", "f"), ("q", "k"), ("ks", "x"), ("ee", "i"), ("ou", "u"), ("ch", "sh"), ("y", "j"))
_FULL: dict[str, tuple[str, ...]] = {}
for _line in NICKNAMES.split("\n"):
    if _line:
        _name, _, _shorts = _line.partition(":")
        for _s in (_name, *_shorts.split()):
            _FULL[_s] = (*_FULL.get(_s, ()), _name)
_GIVEN = frozenset(n for options in _FULL.values() for n in options)
_MAX_SLIP = 80


def fold(s: str) -> str:
    """Lower case without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c))


def sound(word: str) -> str:
    """One spelling for what is written in several ways by ear."""
    for a, b in _SOUNDS:
        word = word.replace(a, b)
    word = re.sub(r"(.)\1+", r"\1", word)
    return word[:-1] if len(word) > 5 and word[-1] == "e" else word


def slips(*spellings: str) -> list[str]:
    """The spellings without each one of their letters: two words a slip apart have one in common."""
    return sorted({x for word in spellings if 4 <= len(word) <= _MAX_SLIP for x in (word, *(word[:i] + word[i + 1 :] for i in range(len(word))))})


_NEAR: dict[str, set[str]] = {}
for _g in _GIVEN:
    for _s in slips(_g):
        _NEAR.setdefault(_s, set()).add(_g)


_NEAR_COMPANY: dict[str, set[str]] = {}
for _g in COMPANY_WORDS | {"company", "limited"}:
    if len(_g) >= 4:
        for _s in slips(_g):
            _NEAR_COMPANY.setdefault(_s, set()).add(_g)


def _company_word(token: str) -> str:
    """A word of company names for its short form, or for itself typed with one slip."""
    if token in COMPANY_SHORT or token in COMPANY_WORDS or len(token) < 4:
        return COMPANY_SHORT.get(token, token)
    near = {g for s in slips(token) for g in _NEAR_COMPANY.get(s, ()) if abs(len(g) - len(token)) <= 1}
    return near.pop() if len(near) == 1 else token


def _given(token: str) -> tuple[str, ...]:
    """Full given names that a token may stand for; a name of the list typed with one slip counts."""
    if token in _FULL:
        return _FULL[token]
    if len(token) >= 5:
        near = {g for s in slips(token) for g in _NEAR.get(s, ()) if abs(len(g) - len(token)) <= 1}
        if len(near) == 1:
            return tuple(near)
    return ()


def _tokens(s: str) -> list[str]:
    return re.findall(r"[^\W_]+", s)


def _numbers(tokens: list[str]) -> str:
    """The numbers among the tokens, which a form of a slip keeps whole: another number is another name."""
    return "".join(f"#{t}" for t in tokens if t.isdigit())


def rewritings(raw: str | None) -> list[tuple[str, str, int, str]]:
    """(use, form, whole, identity) of a string.

    use: 'link' forms say that two strings are one; 'fit' forms offer a whole name to incomplete ones; 'seek' forms are
    how an incomplete string looks for it.  identity: the string's first canonical form.
    """
    if not raw:
        return []
    text = fold(raw).replace("’", "'")
    text = re.sub(r"\(?\bs\.\s?a\.\s?e\.?\)?", " sae ", text)
    head, comma, tail = text.partition(",")
    tail_tokens = [t for t in _tokens(tail) if t not in LEGAL]
    swapped = bool(comma and tail_tokens)
    if swapped:
        text = tail + " " + head
    spaced = re.sub(r"[-'`]", "", text)
    tokens = [t for t in _tokens(spaced)]
    words = [_company_word(t) for t in _tokens(re.sub(r"[-]", " ", text).replace("'", ""))]
    bare = [w for w in words if w not in LEGAL and w not in _SMALL]
    acronym = re.search(r"(?:^|\s)([A-Z]{2,5})\s*$", raw) if raw != raw.upper() else None
    company = len(bare) >= 2 and (len(bare) < len([w for w in words if w not in _SMALL]) or any(w in COMPANY_WORDS for w in bare[0 if swapped else 1 :]) or len(bare) >= 4) or any(w in COMPANY_WORDS for w in bare) or bool(acronym) or (len(bare) == 1 and any(w in LEGAL for w in words))
    if not any(c.isalpha() for c in text):
        return []
    if len(bare) == 1 and len(words) == 1 and 3 <= len(raw.strip()) <= 5 and raw.strip().isalpha() and raw.strip().isupper():
        company = True
    if company and bare:
        numbers = _numbers(bare)
        joined, ordered = re.sub(r"(?:company|limited)$", "", "".join(bare)), "".join(sorted(bare))
        identity = "o:" + ordered
        capitals = [t for t in re.findall(r"[^\W\d_]+", raw) if 3 <= len(t) <= 5 and t.isupper()] if raw != raw.upper() or len(bare) == 1 else []
        short = [("link", "uc:" + "".join(sorted(t.lower())), 0, identity) for t in capitals] + [("seek", "c:" + "".join(sorted(t.lower())), 0, identity) for t in capitals]
        if acronym and len(bare) == 2:
            key = f"a:{sound(bare[0])}:{bare[1]}"
            return [("link", "u" + key, 0, identity), ("seek", key, 0, identity)] + [("seek", f"a~:{s}:{bare[1]}", 0, identity) for s in slips(bare[0], sound(bare[0]))]
        if len(bare) == 1:
            run_on = [("link", "j:" + joined, 1, identity), ("link", "s:" + sound(joined), 1, identity)] + [("link", "t:" + s, 1, identity) for s in slips(joined, sound(joined))]
            return [("link", identity, 0, identity), *short, *(run_on if len(joined) > 5 else [])]
        if short and len(bare) == 2:
            return [("link", identity, 0, identity), *short]
        out = [("link", identity, 1, identity), ("link", "j:" + joined, 1, identity), ("link", "s:" + sound(joined), 1, identity), ("link", "s:" + sound(ordered), 1, identity)]
        out += [("link", "t:" + s + numbers, 1, identity) for s in slips(joined, sound(joined))]
        significant = [w for w in words if w not in _SMALL and (w not in LEGAL or w in ("co", "company"))]
        first, rest = bare[0], "".join(w[0] for w in significant if w != bare[0])
        if len(significant) >= 3:
            out.append(("fit", "c:" + "".join(sorted(w[0] for w in significant)), 1, identity))
        out += [("fit", f"a:{sound(first)}:{rest}", 1, identity)] + [("fit", f"a~:{s}:{rest}", 1, identity) for s in slips(first, sound(first))]
        return out
    tokens = [t for t in tokens if t not in TITLES] or tokens
    full = [t for t in tokens if len(t) > 1]
    initials = [t for t in tokens if len(t) == 1]
    if len(full) == 1:
        surname, options, start = full[0], (), initials[0] if initials else ""
        if not start:
            return [("link", "w:" + sound(surname), 0, "w:" + surname)]
    elif not full or len(full) > 4:
        return [("link", "x:" + "".join(sorted(tokens)), 1, "x:" + "".join(sorted(tokens)))]
    else:
        # which token is the given name: as the comma says, else the one that is known as one, else the first
        at = 0 if swapped or _given(full[0]) or not _given(full[-1]) else len(full) - 1
        if not swapped and full[0] not in _FULL and full[-1] in _FULL:
            at = len(full) - 1
        options, start = _given(full[at]) or (full[at],), ""
        surname = "".join(t for i, t in enumerate(full) if i != at)
    ear = sound(surname)
    if start:
        identity = f"i:{start}:{ear}"
        return [("link", "u" + identity, 0, identity), ("seek", identity, 0, identity)] + [("seek", f"i~:{start}:{s}", 0, identity) for s in slips(surname, ear)]
    if len(options) > 1:
        identity = "n:" + "/".join(sorted(options)) + ":" + ear
        return [("link", "u" + identity, 0, identity)] + [("seek", f"p:{g}:{ear}", 0, identity) for g in options] + [("seek", f"p~:{g}:{s}", 0, identity) for g in options for s in slips(surname, ear)]
    g, numbers = options[0], _numbers(full)
    identity = f"p:{g}:{ear}"
    pair = ":".join(sorted((g, ear)))
    out = [("link", identity, 1, identity), ("link", "q:" + pair, 1, identity), ("link", "j:" + "".join(full), 1, identity), ("link", "j:" + "".join(full[::-1]), 1, identity)]
    out += [("link", f"t:{g}:{s}{numbers}", 1, identity) for s in slips(surname, ear)]
    if g not in _GIVEN:
        out += [("link", f"t:{s}:{ear}{numbers}", 1, identity) for s in slips(g)]
    out += [("fit", identity, 1, identity), ("fit", f"i:{g[0]}:{ear}", 1, identity)] + [("fit", f"i~:{g[0]}:{s}", 1, identity) for s in slips(surname, ear)] + [("fit", f"p~:{g}:{s}", 1, identity) for s in slips(surname, ear)]
    return out


_FORMS = "sid string, use string, form string"


def name_forms(strings: DataFrame) -> DataFrame:
    """(sid) -> (sid, use, form), one row per rewriting."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, use, form) for s in pdf["sid"] for use, form, *_ in rewritings(s)]
            yield pd.DataFrame(rows, columns=["sid", "use", "form"])

    return strings.select("sid").mapInPandas(run, _FORMS)


def link_names(strings: DataFrame, sid: str = "sid") -> DataFrame:
    """(sid, entity) of every distinct string that shares its entity with another.

    The number of strings and of identities per form is not limited; strings are linked to the least of them, never to
    each other.
    """
    forms = name_forms(strings.select(F.col(sid).alias("sid")).where(F.col("sid").isNotNull()).distinct())
    forms = cut(forms)
    link = forms.where("use = 'link'")
    hubs = link.groupBy("form").agg(F.min("sid").alias("hub"), F.max("sid").alias("last")).where("hub < last").select("form", "hub")
    edges = link.join(hubs, "form").select(F.col("sid").alias("a"), F.col("hub").alias("b")).distinct()
    whole = connected_components(edges)
    everything = forms.select("sid").distinct().join(whole.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("component", "sid").alias("entity"))
    everything = cut(everything)
    # incomplete strings: the score of a rewriting is one over the entities that it fits; one alone has to be left
    offered = forms.where("use = 'fit'").select("sid", "form").join(everything, "sid").select("form", "entity").distinct()
    sought = forms.where("use = 'seek'").select("sid", "form").join(everything, "sid").select(F.col("entity").alias("seeker"), "form", F.when(F.col("form").rlike("^[a-z]~"), 2).otherwise(1).alias("cost")).distinct()
    fits = sought.join(offered, "form").groupBy("seeker", "cost").agg(F.min("entity").alias("entity"), F.count_distinct("entity").alias("n"))
    best = fits.groupBy("seeker").agg(F.min(F.struct("cost", "n", "entity")).alias("best")).where("best.n = 1").select("seeker", F.col("best.entity").alias("target"))
    joined = everything.join(best.withColumnRenamed("seeker", "entity"), "entity", "left").select("sid", F.coalesce("target", "entity").alias("entity"))
    return joined


def linked_pairs(members: DataFrame) -> DataFrame:
    """(name_a, name_b) of all strings of one entity, name_a < name_b by code points.

    The pairs of one entity are few, as they are of its different spellings and not of its mentions.
    """
    a = members.select("entity", F.col("sid").alias("name_a"))
    b = members.select("entity", F.col("sid").alias("name_b"))
    # strings compare by their UTF-8 bytes, which is the order of code points
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
