"""Operators on training data: brute force, round trips, held-out accuracy, and odd input."""

from __future__ import annotations

import random
import re
from pathlib import Path
from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.llm import queries as Q
from quarrylight.llm.contamination import Passages, SuffixArray, leaked_items, search_shard, without_leaks, words_of
from quarrylight.llm.langid import canonical_label, context_line, fit, fit_languages, judge, language_segments
from quarrylight.llm.names import link_names, linked_pairs, rewritings, slips, sound
from quarrylight.llm.ranking import joint_ranking
from quarrylight.llm.reading import all_in_language, body, fit_reading, isotonic, reading_levels
from quarrylight.llm.sentences import sentence_positions, sentence_spans, split_sentences
from quarrylight.llm.split import boundaries_of, split_oversized, with_text
from quarrylight.llm.tokenizer import VOCABULARY, Encoder, PerfectHash, encode, load_ranks, merge

TOKEN = re.compile(r"\w+|[^\w\s]")


def said(text):
    return [text[s:e] for s, e in sentence_spans(text)]


# sentences


@pytest.mark.parametrize(
    "text,units",
    [
        ("One. Two?  Three!", ["One.", "Two?", "Three!"]),
        ("See Dr. H. Orlamond at 9 a.m. if you can. Then go.", ["See Dr. H. Orlamond at 9 a.m. if you can.", "Then go."]),
        ("It rose by 3.5 to 4.5%. Up vs. last year, e.g. in May.", ["It rose by 3.5 to 4.5%.", "Up vs. last year, e.g. in May."]),
        ('He wrote: "Is it so? If not, stop!" and left. End.', ['He wrote: "Is it so? If not, stop!" and left.', "End."]),
        ("Der Satz, d. h. der Zins, z. B. 3 %, stieg. Am 3. Mai fiel er.", ["Der Satz, d. h. der Zins, z. B. 3 %, stieg.", "Am 3. Mai fiel er."]),
        ("« Arrêtez. Appelez », dit la note. Selon l'art. 5, M. Delvigne signe.", ["« Arrêtez. Appelez », dit la note.", "Selon l'art. 5, M. Delvigne signe."]),
        ("公告上的“停止。致电。”提醒他。第二句！", ["公告上的“停止。致电。”提醒他。", "第二句！"]),
        ("「止めて。電話して。」と書く。次。", ["「止めて。電話して。」と書く。", "次。"]),
        ("ห้ามอนุมัติ หากเกิน 5 บาท ให้เสนอ", ["ห้ามอนุมัติ", "หากเกิน 5 บาท ให้เสนอ"]),
        ("قال: «أوقفوا. اتصلوا.» ثم أغلق. يقرر د. صابر ذلك؟ نعم", ["قال: «أوقفوا. اتصلوا.» ثم أغلق.", "يقرر د. صابر ذلك؟", "نعم"]),
        ("Согласно ст. 5, т. е. так. Конец", ["Согласно ст. 5, т. е. так.", "Конец"]),
        ("Do this:\n1. Open it\n2. Shut it.\nThen a line\nthat runs on.", ["Do this:", "1. Open it", "2. Shut it.", "Then a line\nthat runs on."]),
        ("", []),
        (None, []),
        (" \n\t", []),
        ("no mark", ["no mark"]),
    ],
)
def test_sentences(text, units):
    assert (said(text) if text else sentence_spans(text)) == units


@pytest.mark.parametrize(
    "text,n",
    [
        ("He paid in max. Then he left.", 2), ("It is vol. Then more of it is there.", 2), ("We met on the art. She left.", 2), ("They saw Smith et al. Then they left.", 2),
        ("Il paie au max. 5 euros par mois. Fin.", 2), ("Voir la page de M. Durand. Il est parti.", 2), ("Los pagos de D. Juan no son para él.", 1), ("Er zahlt ca. Hundert in der Woche.", 1),
        ("The team met. Die Abteilung zahlt bzw. Herr Maier zahlt nicht. The end is near.", 3),
        ('He said "stop' + '"' * 20 + ". Then he left.", 2), ("He stopped." + '"' * 20 + " Then he left.", 2), ("It ends here." + " " * 40 + "\nIt goes on here.", 2),
    ],
)
def test_each_sentence_has_the_rules_of_its_language(text, n):
    assert len(said(text)) == n


def test_positions_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (1, "A b. C d."), (2, None), (3, " "), (None, "E f.")], "id int, content string")
    assert sorted(map(tuple, sentence_positions(df, ["id"]).collect()), key=str) == sorted([(1, 0, 4), (1, 5, 9), (None, 0, 4)], key=str)
    assert sentence_positions(df.limit(0), ["id"]).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB1 .!?\n\"“”„«»()「」。？ก ข؟د—…:;,-")), max_size=80))
def test_sentences_cover_all_text(text):
    spans = sentence_spans(text)
    at = 0
    for s, e in spans:
        assert at <= s < e and not text[at:s].strip() and text[s:e] == text[s:e].strip()
        at = e
    assert not text[at:].strip()


def test_split_sentences_keeps_keys(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "x"), (2, None, "x"), (3, " ", "x"), (1, "A b. C d.", "x")], "sent_no int, content string, sentence string")
    got = split_sentences(df.withColumnRenamed("sent_no", "id"), ["id"]).collect()
    assert sorted((r.id, r.sent_no, r.sentence) for r in got) == [(1, 0, "A b."), (1, 0, "A b."), (1, 1, "C d."), (1, 1, "C d.")]
    assert split_sentences(df.limit(0).withColumnRenamed("sent_no", "id"), ["id"]).count() == 0


# splitting


def brute_pieces(text, limit, overlap):
    b = boundaries_of(text, limit, max(1, overlap // 2))
    cum, nat, pos = [x[1] for x in b], [x[2] for x in b], [x[0] for x in b]
    out, i = [], 0
    while i < len(b) - 1:
        ahead = [k for k in range(i + 1, len(b)) if cum[k] <= cum[i] + limit]
        following = next((cum[k] for k in ahead if nat[k]), None)
        least = max(cum[i] - overlap, (following - limit) if following is not None else cum[i] - overlap, 0)
        s = 0 if i == 0 else next(k for k in range(i + 1) if cum[k] >= least)
        reach = [k for k in ahead if cum[k] <= cum[s] + limit]
        j = max(reach, key=lambda k: (nat[k], cum[k]))
        out.append((pos[s], pos[j], nat[j]))
        i = j
    return out


def test_pointer_doubling_is_the_greedy_split(spark):
    rnd = random.Random(3)
    texts = []
    for _ in range(12):
        parts = ["w " * rnd.choice([3, 9, 20, 150]) + "end." for _ in range(rnd.randint(1, 30))]
        texts.append(" ".join(p[0].upper() + p[1:] for p in parts))
    df = spark.createDataFrame([(f"i{k}", t, 0) for k, t in enumerate(texts)] + [("none", None, 0), ("blank", " " * 900, 0), (None, "w " * 900, 0), ("i0", texts[0], 0)], "id string, content string, pos int")
    pieces = split_oversized(df, ["id"], limit=64, overlap=10)
    got: dict = {}
    for r in with_text(pieces, df, ["id"], limit=64).orderBy("id", "piece_no").collect():
        got.setdefault(r.id, []).append((r.start_pos, r.end_pos, r.natural))
        assert r.tokens <= 64 and r.shared <= 10 and r.piece == texts[int(r.id[1:])][r.start_pos : r.end_pos]
    want = {f"i{k}": brute_pieces(t, 64, 10) for k, t in enumerate(texts) if len(TOKEN.findall(t)) > 64}
    assert got == want
    assert split_oversized(df.limit(0), ["id"]).count() == 0


# names


def test_rewritings():
    forms = lambda s: {f for u, f, *_ in rewritings(s) if u == "link"}
    assert forms("Orlamond, Bob") & forms("Robert  ORLAMOND") and forms("Dr. Róbert Orlamond") & forms("robert orlamond")
    assert forms("Zuku Trust Bank Ltd.") & forms("The ZUKU Tr. Bk.") and not forms("Zuku Trust Bank") & forms("Zuku Leasing Company")
    assert rewritings(None) == [] and rewritings("") == [] and rewritings("--") == []
    assert sound("lopephiros") == sound("lopefiros") and set(slips("abcde")) & set(slips("abde")) and slips("x" * 200) == []


def test_names_are_linked(spark):
    names = ["Robert Orlamond", "Orlamond, Robert", "BOB ORLAMOND", "R. Orlamond", "Robert Orlamnod", "Victoria Tamsin", "Victor Tamsin", "V. Tamsin", "Zuku Trust Bank", "Zuku TB", "Zuku Leasing Company", "ZukuTrust Bank", "other", None, "", "Robert Orlamond"]
    df = spark.createDataFrame([(n, 1) for n in names], "sid string, entity int")
    pairs = {(r.name_a, r.name_b) for r in linked_pairs(link_names(df)).collect()}
    groups = [["Robert Orlamond", "Orlamond, Robert", "BOB ORLAMOND", "R. Orlamond", "Robert Orlamnod"], ["Zuku Trust Bank", "Zuku TB", "ZukuTrust Bank"]]
    assert pairs == {tuple(sorted((a, b))) for g in groups for a in g for b in g if a != b}
    assert link_names(df.limit(0)).count() == 0


def test_names_of_many_spellings(spark):
    one = ["Robert Ozrlamond", "Robert Orblamond", "Robert Orlvamond", "Robert Orlawmond", "Robert Orlampond", "Robert Orlamotnd", "Robert Orlamonkd", "Robert Orlamondg"]
    ear = ["Zukurin Trust Bank", "Zuukurin Trust Bank", "Zukuurin Trust Bank", "Zoukurin Trust Bank", "Zuqurin Trust Bank", "Zukureen Trust Bank", "Zukourin Trust Bank", "Zukurinn Trust Bank"]
    numbered = [f"Tamsin Fund {n}" for n in range(11, 20)] + [f"Lopez Circular {n}" for n in range(11, 14)]
    # what the spellings of each have in common is one form alone
    common = lambda names: [f for f in set.intersection(*({f for u, f, *_ in rewritings(s) if u == "link"} for s in names)) if f[0] not in "ou"]
    assert common(one) == ["t:robert:orlamond"] and len({r[3] for s in ear for r in rewritings(s)}) > 6
    df = spark.createDataFrame([(n,) for n in one + ear + numbered], "sid string")
    pairs = {(r.name_a, r.name_b) for r in linked_pairs(link_names(df)).collect()}
    assert pairs == {(a, b) for g in (one, ear) for a in g for b in g if a < b}


def test_names_of_the_tables(spark, data):
    found = {(r.name_a, r.name_b) for r in Q.p2_found(spark, data).collect()}
    rows = spark.read.parquet(f"{data}/entities.parquet").where("entity_type in ('person', 'organization') and size(mentions) > 1").select("name", "mentions").distinct().collect()
    known = {tuple(sorted((r.name, m))) for r in rows for m in r.mentions if m != r.name}
    assert len(known & found) >= 0.9 * len(known)


# languages


@pytest.fixture(scope="module")
def spoken(spark, data):
    return Q._language_model(spark, data.replace("sf0.001", "sf0.01") if Path(data.replace("sf0.001", "sf0.01")).exists() else data)


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("en", "EN-GB", "eng", "English", " de_AT", "Ara", "unknown", "", " ", None, "martian")], "l string")
    assert [r[0] for r in df.select(canonical_label(F.col("l"))).collect()] == ["en", "en", "en", "en", "de", "ar", "", "", "", "", "?"]


def test_languages_held_out(spoken):
    texts = {
        "en": ["The committee will look at your request next week.", "Please keep this letter in a safe place."], "de": ["Die Abteilung prüft jeden Antrag innerhalb von drei Tagen.", "Ohne Zustimmung darf kein Vertrag freigegeben werden."],
        "fr": ["Le service doit examiner chaque dossier avant la clôture."], "es": ["Las copias se guardan durante diez años en el archivo."], "pt": ["As cópias são guardadas durante dez anos no arquivo."],
        "ru": ["Каждый договор проверяется отделом в течение недели."], "ar": ["تحفظ نسخة من الملف في الأرشيف المركزي."], "zh": ["每一份合同都必须由主管部门完成审核。"], "ja": ["すべての書類は担当部署が確認しなければならない。"], "th": ["ห้ามอนุมัติเอกสารโดยไม่มีความเห็นเป็นลายลักษณ์อักษร"],
    }
    flat = [(t, lang) for lang, own in texts.items() for t in own]
    p = spoken.probabilities([t for t, _ in flat])
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    assert [spoken.languages[i] for i in p.argmax(axis=1)] == [lang for _, lang in flat]


def test_mixed_and_empty_texts(spark, spoken):
    mixed = "The committee decides on each request. Ohne schriftliche Stellungnahme darf kein Antrag freigegeben werden."
    assert [x[2] for x in judge(spoken, [mixed], [0])[0]] == ["en", "de"]
    assert judge(spoken, [None, "", " "], [0, 0, 0]) == [[], [], []]
    df = spark.createDataFrame([(1, mixed, "x"), (2, None, "x"), (3, "12 34", "x"), (4, "[doc | Ordnung und Prüfung]\n\nThe committee decides.", "x")], "id int, content string, lang string").withColumn("skip", context_line(F.col("content")))
    got = {(r.id, r.lang) for r in language_segments(df, ["id"], "content", spoken, "skip", per_sentence=False).collect()}
    assert got == {(1, "en"), (1, "de"), (4, "en")}
    with pytest.raises(ValueError):
        fit_languages(["one", "two"], ["en", "en"])


# ranking


def test_ranking_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(f"q{q}", f"c{i}", rnd.choice([None, rnd.random(), 0.5]), rnd.random() * 1000, 7.0) for q in range(6) for i in range(25)]
    df = spark.createDataFrame(rows + rows[:5], "q string, c string, a double, b double, k double")
    norm = NormalDist().inv_cdf
    for hot in (5, 10**6):
        got = {(r.q, r.c): (r.joint_score, r.n_scores, r.joint_rank) for r in joint_ranking(df, "q", "c", {"a": 1.0, "b": 2.0, "k": 1.0}, hot_rows=hot).collect()}
        assert len(got) == len(rows)
        for q in range(6):
            own = [r for r in rows if r[0] == f"q{q}"]

            def z(col):
                have = sorted(r[col] for r in own if r[col] is not None)
                rank = lambda v: have.index(v) + 1 + (have.count(v) - 1) / 2
                return {r[1]: norm(rank(r[col]) / (len(have) + 1)) for r in own if r[col] is not None}

            a, b = z(2), z(3)
            for r in own:
                want = (a[r[1]] + 2 * b[r[1]]) / 3 if r[1] in a else b[r[1]]
                assert got[r[0], r[1]][0] == pytest.approx(want, abs=1e-6) and got[r[0], r[1]][1] == 1 + (r[1] in a)


def test_ranking_of_odd_rows(spark):
    df = spark.createDataFrame([("q", "a", None, 1.0), ("q", "b", None, 1.0), ("q", "c", float("nan"), 1.0), (None, "x", 1.0, 1.0), ("q", None, 1.0, 1.0)], "q string, c string, s double, t double")
    got = joint_ranking(df, "q", "c", {"s": 1.0, "t": 1.0}).orderBy("joint_rank").collect()
    assert [(r.c, r.joint_score, r.n_scores) for r in got] == [("a", None, 0), ("b", None, 0), ("c", None, 0)]
    assert joint_ranking(df.limit(0), "q", "c", {"s": 1.0}).count() == 0


# tokenizer

needs_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary here")


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = PerfectHash(keys, range(3000))
    assert h.find(keys).tolist() == list(range(3000)) and set(h.find([b"nope", b"k3000"]).tolist()) == {-1}


def test_merge_takes_lowest_rank_first():
    ranks = {bytes([c]): c for c in range(256)} | {b"ab": 300, b"bc": 299, b"abc": 301}
    # "bc" comes first, then "a" and "bc" make a third entry; taken from the left, "ab" and "c" would not
    assert merge(b"abc", ranks) == [301] and merge(b"abcd", {**ranks, b"cd": 298}) == [300, 298] and merge(b"abab", ranks) == [300, 300]


@needs_vocabulary
def test_encoding_equals_the_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    rnd = random.Random(5)
    pool = list("ab 'sdmt \n\t　\xa0é漢字กำ١²½\U0001f600́<|endoftext|>_-.…")
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(500)] + ["x" * 5000, " ", "\n\n"]
    assert Encoder(load_ranks()).encode_batch(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@needs_vocabulary
def test_encoding_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x")], "id int, text string, ids string")
    assert {r.id: r.ids for r in encode(df, ["id"]).collect()} == {1: [], 2: [], 3: [220]}
    assert encode(df.limit(0), ["id"]).count() == 0


@pytest.mark.parametrize("marks", ["“”", "„“", "«»", "「」", "『』", "《》", '""', "()", "（）"])
def test_long_quotations_and_brackets_stay_in_their_sentence(marks):
    inside = "The vault was sealed. Nobody came. " * 40
    first = f"The clerk noted {marks[0]}{inside.strip()}{marks[1]} in the register."
    assert said(first + " Then it rained.") == [first, "Then it rained."]
    # a mark that is never closed in its paragraph joins nothing
    assert len(said(f"The clerk noted {marks[0]}{inside}\n\n{inside}{marks[1]} in the register.")) > 40


# contamination


def test_suffix_array_against_brute_force():
    rnd = random.Random(6)
    text = np.array([rnd.randint(1, 5) for _ in range(300)], np.int64)
    sa = SuffixArray(text)
    q = np.array([[rnd.randint(1, 5) for _ in range(4)] for _ in range(50)], np.int64)
    places = lambda row: {i for i in range(297) if text[i : i + 4].tolist() == row.tolist()}
    lo, hi = sa.bounds(q, False), sa.bounds(q, True)
    assert all({int(x) for x in sa.order[a:b]} == places(row) for row, a, b in zip(q, lo, hi))


PASSAGE = "The canal authority clerk of Voyovastead insured twice a drought rider worth 534,178 talents against the advice of both arbiters, and the salt pan guild disclosed belatedly the ferry mortgage once the second seal was broken."


def test_altered_passages_are_found(spark):
    scanned = PASSAGE.replace("clerk", "c1erk").replace("advice", "ad-\nvice").replace("mortgage", "mortgagc").upper().replace("GUILD", "GU\xadILD")
    put_in = PASSAGE.replace("talents", "talents, it is said by some of them,").replace("worth", "valued at")
    docs = [(1, "Before. " + PASSAGE + " After."), (2, scanned), (3, put_in), (4, PASSAGE[:60] + " and no more of it."), (5, "Nothing of the kind here at all."), (6, None), (7, ""), (8, PASSAGE)]
    d = spark.createDataFrame([(*x, "q") for x in docs], "doc_id bigint, text string, query_id string")
    items = spark.createDataFrame([("q1", PASSAGE, None), ("q1", PASSAGE, None), ("q2", "A wholly different passage about harbours and bonds that nobody has ever copied into any document that is kept here.", None), (None, "x", None), ("q3", None, "")], "query_id string, question string, answer string")
    leaks = leaked_items(d, items, "doc_id", "text", "query_id", ["question", "answer"])
    assert {(r.doc_id, r.query_id) for r in leaks.collect()} == {(1, "q1"), (2, "q1"), (3, "q1"), (8, "q1")} and leaks.count() == 4
    assert {r.doc_id for r in without_leaks(d, leaks, "doc_id").collect()} == {4, 5, 6, 7}
    assert leaked_items(d, items.limit(0), "doc_id", "text", "query_id", ["question"]).count() == 0
    assert leaked_items(d.limit(0), items, "doc_id", "text", "query_id", ["question"]).count() == 0


def test_denser_lines_hide_no_altered_passage(spark):
    shared = "The council of monetary accounts ordered every lender under its charter file quarterly returns before autumn closing dates without further notice"
    items = spark.createDataFrame([("q1", shared, PASSAGE), ("q2", shared, None)], "query_id string, question string, answer string")
    altered = "The canal authority clerk of Voyovastead insured yearly a drought levy worth 534,178 talents against the counsel of both arbiters, and the salt pan union disclosed late the ferry mortgage once the third seal was broken."
    docs = [(1, " ".join(shared + ". " + "filler word " * 60 for _ in range(k)) + altered) for k in (0, 1, 5)]
    d = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(docs)], "doc_id bigint, text string")
    leaks = leaked_items(d, items, "doc_id", "text", "query_id", ["question", "answer"])
    assert {r.doc_id for r in leaks.where("query_id = 'q1'").collect()} == {0, 1, 2}


def _leaks(spark, docs, items, **more):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    i = spark.createDataFrame(items, "query_id string, question string")
    return {(r.doc_id, r.query_id) for r in leaked_items(d, i, "doc_id", "text", "query_id", ["question"], **more).collect()}


def test_equal_items_and_remarks_and_other_scripts(spark):
    words = PASSAGE.split()
    altered = " ".join("other" if i % 7 == 3 else w for i, w in enumerate(words))
    # a text under two ids hides nothing from either, nor does one that is nearly the same
    longer = PASSAGE + " It was so."
    assert _leaks(spark, [altered], [("q1", PASSAGE), ("q2", PASSAGE), ("q3", longer)]) == {(0, "q1"), (0, "q2"), (0, "q3")}
    remarks = [" ".join(words[:14] + ["remark", *[f"inner{k}" for k in range(n)]] + words[14:28]) for n in (8, 12, 15, 24, 40)]
    assert _leaks(spark, remarks, [("q1", PASSAGE)]) == {(k, "q1") for k in range(5)}
    # what is further away than its two sides can outweigh is no remark
    assert _leaks(spark, [" ".join(words[:14] + [f"inner{k}" for k in range(300)] + words[14:28])], [("q1", PASSAGE)]) == set()
    zh = "港务局的账房在洪水过后两次为一张旱灾凭证投保，凭证价值五十三万四千一百七十八塔兰特，两位仲裁人都曾反对。"
    th = "เจ้าหน้าที่ท่าเรือทำประกันใบสำคัญภัยแล้งสองครั้งหลังน้ำท่วมโดยไม่ฟังคำแนะนำของอนุญาโตตุลาการทั้งสองคนและสมาคมเกลือเปิดเผยการจำนองเรือข้ามฟากช้าเกินไปเมื่อตราประทับที่สองถูกทำลาย"
    assert _leaks(spark, ["前言。" + zh + "后记。", "前言。" + zh[:9] + "后记。", "คำนำ " + th + " จบ"], [("q1", zh), ("q2", th)]) == {(0, "q1"), (2, "q2")}


def test_longest_match_has_no_cap_and_blocks_change_nothing(spark):
    rnd = random.Random(9)
    made = lambda k: " ".join("".join(rnd.choice("bcdfghklmnprst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(k))
    long, shared = made(300), made(12)
    items = [("q1", long), ("q2", made(20) + " " + shared), ("q3", shared + " " + made(20)), ("q4", made(30))]
    docs = [made(20) + " " + long + " " + made(5), items[1][1], items[2][1] + " " + items[3][1], shared, made(40)]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    i = spark.createDataFrame(items, "query_id string, question string")
    raw = leaked_items(d, i, "doc_id", "text", "query_id", ["question"], raw=True)
    assert [(r.longest, r.longest_at) for r in raw.where("doc = 0 and item = 'q1'").collect()] == [(300, 20)]
    assert _leaks(spark, docs, items) == _leaks(spark, docs, items, block_words=50) == _leaks(spark, docs, items, block_words=1) == {(0, "q1"), (1, "q2"), (2, "q3"), (2, "q4")}


def brute_worth(passage, text):
    from quarrylight.llm.contamination import MISS, PUT_IN

    h = [[0.0] * (len(text) + 1) for _ in range(len(passage) + 1)]
    for i in range(1, len(passage) + 1):
        for j in range(1, len(text) + 1):
            h[i][j] = max(0.0, h[i - 1][j - 1] + 1 if passage[i - 1] == text[j - 1] else 0.0, h[i - 1][j] - MISS, h[i][j - 1] - PUT_IN)
    return max(map(max, h))


def test_alignment_against_brute_force():
    from quarrylight.llm.contamination import MISS, PUT_IN, aligned_stretches

    rnd = np.random.default_rng(8)
    pairs = [(rnd.integers(1, 9, rnd.integers(3, 15)), rnd.integers(1, 20, rnd.integers(1, 60))) for _ in range(120)]
    for (p, t), got in zip(pairs, aligned_stretches(pairs, 0.99)):
        used = set()
        for k, (a, b) in enumerate(got):
            assert (p[a] == t[b]).all() and (np.diff(a) > 0).all() and (np.diff(b) > 0).all() and not used & set(b.tolist())
            used |= set(b.tolist())
            worth = len(a) - MISS * (a[-1] - a[0] + 1 - len(a)) - PUT_IN * (b[-1] - b[0] + 1 - len(b))
            if k == 0:
                assert worth == pytest.approx(brute_worth(p, t), abs=1e-3)
        assert got or brute_worth(p, t) < 0.99


def test_words_are_normalised():
    assert words_of("Tаlеnts — sign-\natories 35,230 ﬁn\xadal") == ["talents", "signatories", "35230", "final"]
    assert search_shard(Passages([("q", [PASSAGE])]), [1, 2], [None, ""]) == []


# reading level


def test_isotonic():
    x, y = isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([1.0, 3, 2, 4, 2]))
    assert x.tolist() == [1, 2, 3, 4] and y.tolist() == [1, 2.5, 2.5, 3]


def test_reading_levels_held_out(spark, data):
    labels = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/reading_labels.parquet")
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = docs.join(labels, "doc_id").where("band is not null and length(text) > 0").select("doc_id", "text", "band").orderBy("doc_id", "band").collect()
    cut = len(rows) * 2 // 3
    m = fit_reading([body(r.text) for r in rows[:cut]], [r.band for r in rows[:cut]])
    assert np.mean([m.grade(m.profile(body(r.text))[2]) == r.band for r in rows[cut:]]) >= 0.6
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "1234 5678", 0)], "id int, text string, band int")
    got = {r.id: (r.n_words, r.band) for r in reading_levels(df, "id", "text", m).collect()}
    assert got[1] == (0, None) and got[2] == (0, None) and got[3][0] == 2
    with pytest.raises(ValueError):
        fit_reading(["a"], [1])


def test_all_in_language(spoken):
    en, de = "The committee decides on each request before the end of the week.", "Ohne schriftliche Stellungnahme darf kein Antrag freigegeben werden."
    assert all_in_language(spoken, [en, en + " " + de, "", "The term “bonne foi” is used by the team for all requests."], "en") == [True, False, False, True]


# queries


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows(name, same_as_sql):
    same_as_sql(Q.QUERIES[name], Q.SQL[name])


@pytest.fixture(scope="module")
def nothing(spark, data, tmp_path_factory):
    """A folder with the tables, all of them empty."""
    out = tmp_path_factory.mktemp("nothing")
    for f in Path(data).glob("*.parquet"):
        spark.read.parquet(str(f)).limit(0).write.parquet(f"{out}/{f.name}")
    return str(out)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables(name, spark, nothing):
    if name == "p7_ids" and not Path(VOCABULARY).exists():
        pytest.skip("no vocabulary here")
    assert Q.QUERIES[name](spark, nothing).count() == 0


def test_documents_without_grades_or_labels(spark):
    df = spark.createDataFrame([(1, "One sentence. Another one.", "x"), (2, None, None)], "id int, text string, lang string")
    assert [(r.id, r.n_words, r.band) for r in reading_levels(df.where("id = 1"), "id", "text", None).collect()] == [(1, None, None)]
    model = fit(df, "id", "text", "lang")
    assert [(r.lang, r.sure) for r in language_segments(df.drop("lang"), ["id"], "text", model).collect()] == [("und", False)] * 2


COLUMNS = {
    "p1_found": ["item_table", "item_id", "cut"], "p2_found": ["name_a", "name_b"], "p3_found": ["item_table", "item_id", "lang"], "p4_found": ["element_id", "sent_start", "sent_end"],
    "p6_found": ["query_id", "chunk_id"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "query_id"], "p9_found": ["doc_id", "band"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(name, spark, data):
    if name == "p7_ids" and not Path(VOCABULARY).exists():
        pytest.skip("no vocabulary here")
    df = Q.QUERIES[name](spark, data)
    assert df.columns == COLUMNS[name]
    assert df.count() == df.distinct().count()
