"""Retrieval from questions to chunks, prompts, merging of names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import graph as G
from quarrylight.operators import prompts as P
from quarrylight.operators import search as S


def test_merging_follows_the_next_most_similar_name(spark):
    rnd = random.Random(11)
    words = "alpha beta gamma delta epsilon zeta theta iota kappa lambda".split()
    names = list(dict.fromkeys(" ".join(rnd.sample(words, rnd.choice([2, 6, 7, 8]))) for _ in range(60))) + ["a"]
    rows = [(n, f"id{i}", i) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "norm string, canonical_id string, seen int")
    got = {r.norm: r.merged_id for r in G.merged_names(df).collect()}
    stems = {n: set(r.s) for n, r in zip(names, df.orderBy("seen").select(T.name_stems(F.col("norm")).alias("s")).collect())}
    # one after the other, each name is merged into the best that is left, and what was merged into it goes along
    canon, left = {n: n for n in names}, dict.fromkeys(names)
    for n in names:
        best, most = None, 0.0
        for o in left:
            if o != n and stems[n] and stems[o] and (sim := len(stems[n] & stems[o]) / len(stems[n] | stems[o])) >= 0.85 and sim > most:
                best, most = o, sim
        if best:
            for k, v in canon.items():
                if v == n:
                    canon[k] = best
            del left[n]
    ids = {n: f"id{i}" for i, n in enumerate(names)}
    assert got == {n: ids[canon[n]] for n in names}
    assert G.merged_names(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def small(spark):
    chunks = [
        ("c1", "d1", "text", "the loan limit of the zuku bank", "t1", None), ("c2", "d1", "text", "nothing of the kind", "t1", None), ("c3", "d2", "table", "a capital buffer rule", "t1", None),
        ("c4", "d3", "text", "the loan limit of the zuku bank", "t1", None), ("c5", "d1", "text", "gone loan limit", "t1", "t2"), ("c6", "d1", "text", "  ", "t1", None), ("c1", "d1", "text", "the loan limit of the zuku bank", "t1", None),
    ]
    c = spark.createDataFrame([(*r[:4], None, *r[4:]) for r in chunks], "chunk_id string, doc_name string, element_type string, content string, section_path array<string>, indexed_at string, deleted_at string")
    ents = [(1, "e1", "Zuku Bank", "organization", "c1"), (2, "e1b", "zuku  bank", "organization", "c3"), (3, "e2", "Capital Buffer", "limit", "c3"), (4, "e3", "Nobody", None, "c9")]
    e = spark.createDataFrame([(*r, "d", None, r[0], None) for r in ents], "mention_id bigint, entity_id string, name string, entity_type string, source_chunk_id string, source_doc string, mentions array<string>, extracted_at int, value string")
    r = spark.createDataFrame([(1, "e1", "e2", "governs", 1)], "rel_id bigint, source_id string, target_id string, relation_type string, extracted_at int")
    access = spark.createDataFrame([("d1", 1), ("d2", 2), ("d2", 2), ("d3", 3)], "doc_name string, level int")
    q = spark.createDataFrame([("q1", "What is the loan limit of the Zuku bank?"), ("q2", None), ("q3", "")], "query_id string, question string")
    return q, c, e, r, access


def test_retrieval_on_a_small_fixture(spark, small):
    q, c, e, r, access = small
    found = {x.chunk_id: x for x in S.candidates(q, c, e, r, access, 2).collect()}
    # c4 is above the user's level, c5 deleted, c6 blank; no question but the first reaches anything
    assert set(found) == {"c1", "c2", "c3"} and all(x.query_id == "q1" for x in found.values())
    assert found["c1"].graph_score == pytest.approx(0.3 * 2 / 5 + 0.5 + 0.2) and found["c2"].graph_score == 0.0
    top = S.best(S.candidates(q, c, e, r, access, 2), 1).collect()
    assert [(x.chunk_id, x.rank) for x in top] == [("c1", 1)]
    only = S.candidates(q, c, e, r, access, None, use_graph=False)
    assert {x.chunk_id for x in only.collect()} == {"c1", "c2", "c3", "c4"} and {x.retrieval_mode for x in only.collect()} == {"vector_only"}
    assert S.candidates(q.limit(0), c, e, r, access, 2).count() == 0
    assert S.candidates(q, c.limit(0), e.limit(0), r.limit(0), access.limit(0), 2).count() == 0


def test_names_are_found_in_part(spark, small):
    q, _, e, _, _ = small
    assert {x.entity for x in G.match_entities(q, e).collect()} == {"entity::e1"}
    asked = spark.createDataFrame([("a", "which bank?"), ("b", "a buffer"), ("c", "the of and")], "query_id string, question string")
    # half of two words is one; stop words are none
    assert {(x.query_id, x.entity) for x in G.match_entities(asked, e).collect()} == {("b", "entity::e2")}
    asked = spark.createDataFrame([("a", "which bank")], "query_id string, question string")
    assert {x.entity for x in G.match_entities(asked, e).collect()} == {"entity::e1"}


def test_hubs_do_not_change_bounded_expansion(spark):
    rnd = random.Random(5)
    edges = list({("hub", f"n{i:03d}") for i in range(200)} | {(f"n{rnd.randrange(200):03d}", f"n{rnd.randrange(200):03d}") for _ in range(150)})
    df = spark.createDataFrame([(*x, "mentions_entity") for x in edges], "src string, dst string, relation_type string")
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    got = {(r.node, r.hop) for r in G.expand(spark.createDataFrame([("q", "n005")], "query_id string, node string"), df, 2, cap=30).collect()}
    seen = {"n005": 0}
    for hop in (1, 2):
        new = {y for x, h in seen.items() if h == hop - 1 for y in near.get(x, ())} - set(seen)
        seen = dict(sorted({**seen, **dict.fromkeys(new, hop)}.items(), key=lambda kv: (kv[1], kv[0]))[:30])
    assert got == set(seen.items())


def test_judges_without_a_model(spark):
    rows = [("a", "the limit is 5 percent [1]", "limit 5 percent of capital", "limit 5 percent"), ("b", "wholly invented words", "limit", None), ("c", None, None, "x")]
    got = {r.query_id: r for r in P.judge_proxies(spark.createDataFrame(rows, "query_id string, answer string, judged string, expected_answer string")).collect()}
    assert (got["a"].correctness, got["a"].citation_accuracy, got["a"].hallucination) == (1.0, got["a"].faithfulness, round(1 - got["a"].faithfulness, 4)) and got["a"].faithfulness == 0.75
    assert (got["b"].faithfulness, got["b"].correctness, got["b"].citation_accuracy, got["b"].hallucination) == (0.0, None, 0.0, 1.0) and got["c"].correctness == 0.0
