"""Extraction from answers, stores, settings."""

from __future__ import annotations

import warnings

import pytest
from pyspark.sql import functions as F

from quarrylight.config import Settings, settings
from quarrylight.functions import text as T
from quarrylight.operators import extraction as E
from quarrylight.operators import stores as S

ANSWERS = [
    ("c1", '{"entities":[{"name":" A ","type":"role","value":1},{"name":"A","type":"limit","value":0},{"name":"","type":"x"},{"name":"B","type":null}],"relations":[{"source":"A","target":"B"},{"source":"A","target":"Z"},null]}'),
    ("c2", 'Sure:\n```json\n{"entities":[{"name":"C"}]}\n```'), ("c3", 'so {"entities":[{"name":"D"}],"relations":[{"source":"D","target":"D","type":"governs"}]} it is'), ("c4", "no json"), ("c5", None), ("c6", ""), ("c7", "{broken"), ("c8", "[1, 2]"),
]


def test_answers_become_entities_and_relations(spark):
    df = spark.createDataFrame([(c, "d", r, "clash") for c, r in ANSWERS], "chunk_id string, doc_name string, response string, entities string")
    a = E.parsed(df)
    assert {r.chunk_id for r in E.failed(a).collect()} == {"c4", "c5", "c6", "c7", "c8"}
    e = {(r.chunk_id, r.n): r for r in E.entities_of(a).collect()}
    assert {k: (r.name, r.entity_type, r.value) for k, r in e.items()} == {("c1", 0): ("A", "role", "1"), ("c1", 1): ("A", "limit", None), ("c1", 3): ("B", "unknown", None), ("c2", 0): ("C", "unknown", None), ("c3", 0): ("D", "unknown", None)}
    rel = {(r.chunk_id, r.source_id, r.target_id, r.relation_type) for r in E.relations_of(a).collect()}
    # of two entities with one name the last counts; an end that is no entity of the answer drops the relation
    assert rel == {("c1", e["c1", 1].entity_id, e["c1", 3].entity_id, "related_to"), ("c3", e["c3", 0].entity_id, e["c3", 0].entity_id, "governs")}
    assert E.entities_of(E.parsed(df.limit(0))).count() == 0


def test_a_provider_is_asked_again(spark):
    def provider(p):
        if p == "bad":
            raise RuntimeError("no")
        return p.upper()

    df = spark.createDataFrame([("c1", "d", "x"), ("c2", "d", "bad")], "chunk_id string, doc_name string, p string")
    got = {r.chunk_id: (r.response, r.error) for r in E.ask(df, "p", provider, attempts=2, wait=0.0).collect()}
    assert got == {"c1": ("X", None), "c2": (None, "RuntimeError: no")}


def test_merging_and_repeats(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    got = S.merged_rows(a, spark.createDataFrame([(2, "n"), (3, "n"), (3, "n")], "id int, v string"), ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "n"), (3, "n")] and S.repeated_keys(got, ["id"]).count() == 0
    assert [tuple(r) for r in S.repeated_keys(a.unionAll(a.where("id = 1")), ["id"]).collect()] == [(1, 2)]


def test_export_keeps_edges_between_kept_nodes(spark):
    nodes = spark.createDataFrame([("a", "entity", "n" * 50, None), ("b", "document", "Doc", "Doc"), ("c", "chunk", None, "d" * 30)], "id string, node_type string, name string, doc_name string")
    edges = spark.createDataFrame([("a", "b", "governs"), ("b", "a", "belongs_to_document"), ("a", "c", "x")], "src string, dst string, relation_type string")
    n, e = S.graph_export(nodes, edges, ("entity", "document"))
    assert {r.id: r.label for r in n.collect()} == {"a": "n" * 40, "b": "Doc"}
    assert {(r.src, r.dst): (r.label, r.width) for r in e.collect()} == {("a", "b"): ("governs", 2), ("b", "a"): ("", 1)}


def test_settings(tmp_path):
    (tmp_path / "e").write_text('# note\nQUARRYLIGHT_MAX_HOPS="3"\nQUARRYLIGHT_ALPHA=x\nOTHER=1\n\nQUARRYLIGHT_TOP_RESULTS=7\n')
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        got = settings({"QUARRYLIGHT_TOP_RESULTS": "9", "QUARRYLIGHT_USE_GRAPH": "off"}, str(tmp_path / "e"))
    assert (got.max_hops, got.alpha, got.top_results, got.use_graph) == (3, Settings().alpha, 9, False) and len(said) == 1
    assert settings({}) == Settings() and settings({}, str(tmp_path / "none")) == Settings()


@pytest.mark.parametrize("answer,score", [("1.5", 1.0), ("8", 0.8), ("10", 1.0), ("8/10", 0.8), ("85", 0.0), ("8/100", 0.8), ("0.5 of 1", 0.5), ("3/1", 1.0), ("", 0.0), (None, None)])
def test_grades(spark, answer, score):
    got = spark.createDataFrame([(answer,)], "a string").select(T.parse_score(F.col("a"))).first()[0]
    assert got == (0.0 if score is None else score)
