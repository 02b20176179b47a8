from __future__ import annotations

import json
import zipfile

from quarrylight.sources import readers
from quarrylight.streaming.incremental import index_stream, stream_documents

XML = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Limits</w:t></w:r></w:p><w:p><w:r><w:t> </w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text.</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""


def test_word_files(spark, tmp_path):
    for name in ("a.docx", "~$a.docx"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("word/document.xml", XML)
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    (tmp_path / "other.txt").write_text("x")
    elements, errors = readers.parse_documents(readers.scan_documents(spark, str(tmp_path)))
    rows = elements.orderBy("pos").collect()
    assert [(r.element_type, r.content.split("\n")[0], r.metadata) for r in rows] == [("heading", "Limits", {"level": "2"}), ("paragraph", "Some text.", {}), ("table", "A: 1 and has b 2.", {})]
    assert rows[2].table_data.rows == [["1", "2"]] and rows[2].table_data.shape == [1, 2] and [r.section_path for r in rows] == [["Limits"]] * 3
    assert [r.path.split("/")[-1] for r in errors.collect()] == ["bad.docx"]


def test_text_and_eval_items(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("one\ntwo")
    (tmp_path / "t/b.txt").write_text(" \n")
    assert [r.content for r in readers.text_elements(spark, str(tmp_path / "t")).collect()] == ["one\ntwo"]
    (tmp_path / "q.json").write_text(json.dumps([{"query_id": "q1", "source_doc": "d", "other": 1}, {"query_id": "q2", "expected_docs": ["x"]}]))
    assert {r.query_id: r.expected_docs for r in readers.read_eval_queries(spark, str(tmp_path / "q.json")).collect()} == {"q1": ["d"], "q2": ["x"]}


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "chunk", {"k": "v"}), ("a", "chunk", {"k": "v"})], "id string, node_type string, more map<string,string>")
    edges = spark.createDataFrame([("a", "b", "x")], "src string, dst string, relation_type string")
    readers.write_graph(nodes, edges, str(tmp_path))
    n, e = readers.read_graph(spark, str(tmp_path))
    assert n.count() == 1 and n.first().more == '{"k":"v"}' and e.count() == 1


def test_stream(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    (tmp_path / "in").mkdir()
    docs.write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_documents(spark, str(tmp_path / "in"), docs.schema)
    index_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == readers.line_elements(docs).count()


def test_content_controls_styles_and_levels(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Teil", "Ueber1") + "<w:sdt><w:sdtContent>" + p("in a control") + "</w:sdtContent></w:sdt>" + p("Kapitel", "Ueber3") + p("text") + p("Anhang", "Ueber1") + "<w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    styles = f'<w:styles {w}><w:style w:styleId="Ueber1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Ueber3"><w:pPr><w:outlineLvl w:val="2"/></w:pPr></w:style></w:styles>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)
    elements, errors = readers.parse_documents(readers.scan_documents(spark, str(tmp_path)))
    got = [(r.element_type, r.content, r.section_path) for r in elements.orderBy("pos").collect()]
    assert got == [("heading", "Teil", ["Teil"]), ("paragraph", "in a control", ["Teil"]), ("heading", "Kapitel", ["Teil", "Kapitel"]), ("paragraph", "text", ["Teil", "Kapitel"]), ("heading", "Anhang", ["Anhang"]), ("table", "|  |\n| --- |", ["Anhang"])]
    assert errors.count() == 0


def test_json_round_trip_and_report(spark, tmp_path):
    c = spark.createDataFrame([("c1", ["a"], 5), ("c2", None, None)], "chunk_id string, section_path array<string>, token_estimate int")
    readers.write_json(c, str(tmp_path / "c"))
    assert sorted(map(tuple, readers.read_json(spark, str(tmp_path / "c"), "chunk_id string, token_estimate int, more string").collect())) == [("c1", 5, None), ("c2", None, None)]
    readers.write_json_each(c, "chunk_id", str(tmp_path / "e"))
    assert sorted(x.name for x in (tmp_path / "e").iterdir() if x.is_dir()) == ["chunk_id=c1", "chunk_id=c2"]
    readers.write_report({"modes": c.limit(1)}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/modes")).count() == 1
