"""Readers and writers of documents, elements, chunks, graphs and evaluation sets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_ELEMENT = "element_type string, content string, level int, pos bigint, table_data struct<headers:array<string>,rows:array<array<string>>,shape:array<int>>"
EVAL_SCHEMA = (
    "query_id string, question string, reasoning_type string, language string, expected_answer string, source_doc string, source_section string, "
    "expected_entities array<string>, expected_docs array<string>, reasoning_chain string, hops_required int"
)


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the .docx and .doc files below a folder, without editors' lock files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,doc}").load(folder)
    return files.select("path", "content").where(~F.element_at(F.split("path", "/"), -1).startswith("~$"))


def _blocks(parent: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Paragraphs and tables below an element in their order, those in content controls as well; what a table holds is its own."""
    for e in parent:
        if e.tag in (f"{_W}p", f"{_W}tbl"):
            yield e
        elif e.tag in (f"{_W}sdt", f"{_W}sdtContent", f"{_W}customXml", f"{_W}smartTag"):
            yield from _blocks(e)


def _heading_levels(styles: bytes | None) -> dict[str, int]:
    """Level of each style that is a heading: by its outline level or its name, whatever language its id is in; a title is level 1."""
    out: dict[str, int] = {}
    for s in ElementTree.fromstring(styles).iter(f"{_W}style") if styles else ():
        name = next((n.get(f"{_W}val", "") for n in s.iter(f"{_W}name")), "").lower()
        outline = next((int(o.get(f"{_W}val", "9")) for o in s.iter(f"{_W}outlineLvl")), 9)
        m = re.fullmatch(r"heading (\d+)", name)
        if m or outline < 9 or name == "title":
            out[s.get(f"{_W}styleId", "")] = int(m.group(1)) if m else outline + 1 if outline < 9 else 1
    return out


def _docx(data: bytes) -> Iterator[tuple]:
    """(type, content, level, pos, table data, section path) of one word-processor file in its order; blank text is left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        levels = _heading_levels(z.read("word/styles.xml") if "word/styles.xml" in z.namelist() else None)
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    pos, path = 0, []
    for e in _blocks(body) if body is not None else ():
        if e.tag == f"{_W}tbl":
            grid = [[said(c).strip() for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            if grid:
                md = "\n".join("| " + " | ".join(r) + " |" for r in [grid[0], ["---"] * len(grid[0]), *grid[1:]])
                yield "table", md, None, pos, {"headers": grid[0], "rows": grid[1:], "shape": [len(grid) - 1, len(grid[0])]}, list(path)
                pos += 1
        elif said(e).strip():
            style = next((s.get(f"{_W}val", "") for s in e.iter(f"{_W}pStyle")), "")
            m = re.fullmatch(r"Heading\s*(\d+)|(Title)", style)
            level = levels.get(style, int(m.group(1) or 1) if m else 0)
            if level:
                path = path[: max(level, 1) - 1] + [said(e).strip()]
            yield ("heading" if level else "paragraph"), said(e).strip(), level or None, pos, None, list(path)
            pos += 1


def parse_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements of files, and (path, error) of files that cannot be read; a bad file stops nothing.

    A table's content is its rows as sentences, or its lines where no row makes one; its id is of the lines.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, None, *e) for e in list(_docx(data))]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, f"{type(e).__name__}: {e}", None, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "error", "element_type", "content", "level", "pos", "table_data", "section_path"]).astype({"level": "Int32", "pos": "Int64"})

    got = files.select("path", "content").mapInPandas(run, f"path string, error string, {_ELEMENT}, section_path array<string>")
    ok = got.where("error is null")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.docx?$", "")
    id_ = T.hash_id(16, name, F.col("element_type"), F.col("pos"), F.substring("content", 1, 100))
    content = F.when(F.col("table_data").isNotNull(), F.coalesce(F.nullif(T.table_sentences(F.col("table_data")), F.lit("")), F.col("content"))).otherwise(F.col("content"))
    elements = ok.select(
        id_.alias("element_id"), name.alias("doc_name"), F.col("path").alias("doc_path"), "element_type", content.alias("content"), "section_path",
        F.when(F.col("level").isNotNull(), F.create_map(F.lit("level"), F.col("level").cast("string"))).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),
        T.detect_script_language(content).alias("language"), F.lit(None).cast("int").alias("page_number"), "table_data", "pos",
    )
    return elements, got.where("error is not null").select("path", "error")


def text_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Each text file as one element; empty files are left out."""
    files = spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("doc_path")).where(F.length(T.strip(F.col("value"))) > 0)
    name = F.regexp_replace(F.element_at(F.split("doc_path", "/"), -1), r"\.[^.]*$", "")
    return files.select(T.hash_id(16, name, F.lit("text"), F.lit(0), F.substring("value", 1, 100)).alias("element_id"), name.alias("doc_name"), "doc_path", F.lit("text").alias("element_type"), F.col("value").alias("content"), F.array(F.lit("Content")).alias("section_path"), T.detect_script_language(F.col("value")).alias("language"), F.lit(0).cast("bigint").alias("pos"))


def line_elements(documents: DataFrame, doc: str = "doc_name", text: str = "text") -> DataFrame:
    """Each line of stored texts that is not blank as a paragraph."""
    lines = documents.select(F.col(doc).alias("doc_name"), F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("pos", "content")).where(F.length(T.strip(F.col("content"))) > 0)
    return lines.select(T.hash_id(16, F.col("doc_name"), F.lit("paragraph"), F.col("pos"), F.substring("content", 1, 100)).alias("element_id"), "doc_name", F.lit("paragraph").alias("element_type"), "content", F.col("pos").cast("bigint").alias("pos"))


def read_eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items from JSON, one list per file; unknown fields are ignored, expected documents default to the source."""
    q = spark.read.schema(EVAL_SCHEMA).json(path, multiLine=True)
    return q.withColumn("expected_docs", F.when(F.size("expected_docs") > 0, F.col("expected_docs")).when(F.col("source_doc").isNotNull(), F.array("source_doc")).otherwise(F.array().cast("array<string>")))


def scalar_properties(df: DataFrame) -> DataFrame:
    """Columns as a property store takes them: plain values as they are, lists of plain values as they are, the rest as JSON."""
    plain = ("string", "int", "bigint", "double", "float", "boolean", "smallint", "tinyint", "date", "timestamp")
    keep = lambda t: t in plain or (t.startswith("array<") and t[6:-1] in plain)
    return df.select(*[F.col(c) if keep(t) else F.to_json(c).alias(c) for c, t in df.dtypes])


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Replaces a stored graph; nodes are unique by id, edges by their two ends and type."""
    scalar_properties(nodes).dropDuplicates(["id"]).write.mode("overwrite").partitionBy("node_type").parquet(f"{folder}/nodes")
    scalar_properties(edges).dropDuplicates(["src", "dst", "relation_type"]).write.mode("overwrite").parquet(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_json_each(df: DataFrame, key: str, folder: str) -> None:
    """One folder of JSON per key, for stores that take rows one by one."""
    df.write.mode("overwrite").partitionBy(key).json(folder)


def read_json(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows that ``write_json`` wrote; fields outside the schema are left out, missing ones null."""
    return spark.read.schema(schema).json(folder)


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table of a report as one JSON folder of its name; reports are small, one row per mode and group."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")
