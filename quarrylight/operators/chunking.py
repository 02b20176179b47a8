"""Section paths, runs of elements, and packing of sentences into chunks under a token budget.

Texts stay where they are: order, runs and packing are worked out over narrow rows (ids, positions, token counts), and
only chunks that are put together fetch their sentences, once.

Defined results
* an element that was stored several times counts once, as it was parsed first (of equal times the least content hash);
* null and blank contents: no sentence, no chunk, and they end no run; null paths are empty ones;
* tables are chunks of their own, without a context line, and end the run of text before them;
* very long documents: running values are computed in blocks, chunks by pointer doubling; empty tables: no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators.doubling import reach
from quarrylight.operators.scan import offsets, scan
from quarrylight.session import cut

MAX_TOKENS, OVERLAP, FLOOR, CEILING = 512, 50, 50, 7500


def first_rows(rows: DataFrame, key: str, at: str | None, content: str, narrow: dict[str, Column]) -> DataFrame:
    """(key, narrow columns, _hash), one row per key: that of the earliest time, of equal times of the least hash of the content."""
    hash_ = F.xxhash64(content)
    by = F.struct((F.col(at) if at else F.lit(0)).isNull(), F.col(at) if at else F.lit(0), hash_)
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*[c.alias(n) for n, c in narrow.items()], hash_.alias("_hash")), by).alias("_r"))
    return one.select(key, "_r.*")


def _stored(elements: DataFrame) -> str | None:
    return "parsed_at" if "parsed_at" in elements.columns else None


def section_paths(elements: DataFrame, doc: str = "doc_name", pos: str = "pos") -> DataFrame:
    """(element_id, doc, pos, path): the headings above each element (a heading's path ends with itself).

    A heading of level L stands behind the first L - 1 entries of the path before it; a level that jumps does not pad.
    So the length after heading number i is the least of L_j + i - j over j <= i, and i: a running minimum; the entry
    at depth d is the last heading whose length was d.  Depths are as many as the headings reach.
    """
    heading = F.col("element_type") == "heading"
    level = F.greatest(F.coalesce(F.col("metadata")["level"].try_cast("int"), F.lit(1)), F.lit(1))
    e = first_rows(elements, "element_id", _stored(elements), "content", {doc: F.col(doc), pos: F.col(pos), "_level": F.when(heading, level), "_said": F.when(heading, F.col("content"))})
    e = cut(scan(e, [doc], pos, {"_h": ("sum", F.col("_level").isNotNull().cast("int"))}))
    h = scan(e.where("_level is not null").select(doc, pos, "_h", "_level", "_said"), [doc], pos, {"_m": ("min", F.col("_level") - F.col("_h"))})
    h = cut(h.withColumn("_len", (F.col("_h") + F.least(F.lit(0), F.col("_m"))).cast("int")).select(doc, pos, "_h", "_len", "_said"))
    depth = h.agg(F.max("_len")).first()[0] or 0
    names = [f"_p{d}" for d in range(1, depth + 1)]
    if names:
        h = scan(h, [doc], pos, {n: ("last", F.when(F.col("_len") == d, F.col("_said"))) for d, n in enumerate(names, 1)})
    path = F.slice(F.array(*[F.col(n) for n in names]).cast("array<string>"), F.lit(1), F.col("_len")) if names else F.array().cast("array<string>")
    joined = e.select("element_id", doc, pos, "_h").join(h.select(doc, "_h", path.alias("path")), [doc, "_h"], "left")
    return joined.select("element_id", doc, pos, F.coalesce("path", F.array().cast("array<string>")).alias("path"))


def _runs(e: DataFrame, doc: str, pos: str) -> DataFrame:
    """Adds to narrow rows with _here, _table, language: ``run``, ``_rid``, a number that no other run has, and ``_first``,
    the language of the first element of the section."""
    e = scan(e.withColumn("_uid", F.monotonically_increasing_id()), [doc], pos, {"_before": ("before", F.struct("_here", "_table"))})
    fresh = F.col("_before").isNull() | (F.col("_before._here") != F.col("_here"))
    new = fresh | F.col("_table") | F.col("_before._table")
    e = e.withColumns({"_new": new.cast("int"), "_start": F.when(fresh, F.struct(F.col("language").alias("l")))})
    return scan(e, [doc], pos, {"run": ("sum", F.col("_new")), "_rid": ("last", F.when(F.col("_new") == 1, F.col("_uid"))), "_first": ("last", F.col("_start"))}).drop("_before", "_new", "_start", "_uid")


def _narrow(elements: DataFrame, doc: str, pos: str, path: str, more: dict[str, Column]) -> DataFrame:
    """One narrow row per element that is not blank."""
    language = F.col("language") if "language" in elements.columns else F.lit(None).cast("string")
    columns = {doc: F.col(doc), pos: F.col(pos), "element_type": F.col("element_type"), "language": language, "_blank": ~F.coalesce(F.col("content").rlike(r"\S"), F.lit(False))}
    columns |= {"_here": F.xxhash64(F.coalesce(F.col(path), F.array().cast("array<string>"))), "_table": F.coalesce(F.col("element_type") == "table", F.lit(False)), **more}
    return first_rows(elements, "element_id", _stored(elements), "content", columns).where("not _blank").drop("_blank")


def element_runs(elements: DataFrame, doc: str = "doc_name", pos: str = "pos", path: str = "section_path") -> DataFrame:
    """(element_id, doc, pos, element_type, run) of elements that are not blank: a new run where the section changes, and around each table."""
    return _runs(_narrow(elements, doc, pos, path, {}), doc, pos).select("element_id", doc, pos, "element_type", "run")


def windows(c: Column, budget: Column) -> Column:
    """A sentence as it is, or cut into windows of budget tokens if it has more."""
    b = budget.cast("int")
    cut_up = F.flatten(F.transform(F.array(T.tokens(c)), lambda t: F.transform(F.sequence(F.lit(1), F.size(t), b), lambda i: F.array_join(F.slice(t, i, b), " "))))
    # no text has more tokens than characters
    return F.when((F.length(c) <= b) | (T.token_count(c) <= b), F.array(c)).otherwise(cut_up)


def _pieces(content: Column, budget: Column) -> Column:
    """The sentences of a text, those above the budget cut into windows."""
    return F.flatten(F.transform(T.sentences(content), lambda s: windows(s, budget)))


def _piece_tokens(content: Column, budget: Column) -> Column:
    """The token counts of the pieces."""
    b = budget.cast("int")
    part = lambda n: F.concat(F.array_repeat(b, F.floor(n / b).cast("int")), F.when(n % b == 0, F.array().cast("array<int>")).otherwise(F.array(n % b)))
    return F.flatten(F.transform(F.transform(T.sentences(content), T.token_count), lambda n: F.when(n <= b, F.array(n)).otherwise(part(n))))


def numbered_sentences(sentences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``b``, the number of each sentence in its group from 1, and ``c``, the tokens up to its end."""
    return scan(sentences, keys, "pos", {"c": ("sum", F.col("tok").cast("bigint")), "b": ("sum", F.lit(1).cast("bigint"))}, ties=["sent_no"])


def pack(numbered: DataFrame, keys: Sequence[str], overlap: int = OVERLAP, most: int = MAX_TOKENS) -> DataFrame:
    """(keys, chunk_no, first, last): sentence numbers of each chunk of each group, overlap included.

    A chunk is filled until the next sentence would pass the budget; it hands on its longest tail of at most ``overlap``
    tokens, behind which one sentence is set without a check.  Needs b and c of ``numbered_sentences``, and budget;
    neither a budget nor a sentence has more than ``most`` tokens, and a sentence has one at least.

    Where a tail begins and how far a chunk reaches is found by merging probes with the boundaries in blocks of tokens:
    the boundary that stands last before a probe, in its block or, as sentences are bounded, among the last of the block
    before.
    """
    size = 16 * max(most, 1)
    s = numbered.select(*keys, "budget", "b", "c")
    bounds = s.where("b = 1").select(*keys, "budget", F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("c")).unionByName(s)
    c, probe = F.col("c"), lambda v, kind, block=None: F.struct(v.alias("v"), F.lit(kind).alias("kind"), F.floor((v if block is None else block) / size).alias("block"))
    # kinds in the order in which they stand at equal values: where a tail begins, a boundary, how far a chunk reaches
    each = F.array(probe(c - overlap, 0), probe(c, 1), probe(c + F.col("budget"), 2), F.when(c % size >= size - most, probe(c, 1, c + size)))
    merged = bounds.select(*keys, "b", F.explode(F.array_compact(each)).alias("p")).select(*keys, "b", "p.*")
    last = F.last(F.when(F.col("kind") == 1, F.col("b")), ignorenulls=True).over(Window.partitionBy(*keys, "block").orderBy("v", "kind", "b").rowsBetween(Window.unboundedPreceding, 0))
    merged = cut(merged.withColumn("at", last).where("kind <> 1").select(*keys, "b", "kind", "at"))
    # the first boundary that is not before the probe, for the tail; the last one that is not behind it, for the reach
    start = merged.where("kind = 0").select(*keys, F.col("b").alias("i"), F.coalesce(F.col("at") + 1, F.lit(0)).alias("s"))
    far = merged.where("kind = 2").select(*keys, F.col("b").alias("s"), F.col("at").alias("j"))
    succ = start.join(far, [*keys, "s"]).select(*keys, "i", F.greatest(F.col("i") + 1, F.col("j")).alias("j"), (F.col("s") + 1).alias("first"))
    succ = cut(succ.join(s.select(*keys, (F.col("b") - 1).alias("i")), [*keys, "i"], "left_semi"))
    return reach(succ, keys).join(succ, [*keys, "i"]).select(*keys, F.col("piece_no").alias("chunk_no"), "first", F.col("j").alias("last"))


def chunks(elements: DataFrame, doc: str = "doc_name", max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, ceiling: int = CEILING) -> DataFrame:
    """(doc, run, chunk_no, element_type, content, section_path, source_element_ids, language, token_estimate, chunk_index, chunk_id).

    Text chunks and tables, in the order of their documents; ``chunk_index`` counts them over all documents in the order
    of names.  A content above ``ceiling`` tokens is cut there.  The language is that of the first element of a section.
    """
    path = F.coalesce("section_path", F.array().cast("array<string>"))
    budget = F.greatest(F.lit(max_tokens) - T.token_count(T.context_prefix(F.col(doc), path)), F.lit(FLOOR))
    text = ~F.coalesce(F.col("element_type").isin("heading", "table"), F.lit(False))
    more = {"_budget": budget, "_toks": F.when(text, _piece_tokens(F.col("content"), budget))}
    e = cut(_runs(_narrow(elements, doc, "pos", "section_path", more), doc, "pos").drop("_here"))
    s = e.where("_toks is not null").select("_rid", "pos", "element_id", "_hash", F.col("_budget").alias("budget"), F.posexplode("_toks").alias("sent_no", "tok"))
    numbers = cut(numbered_sentences(s, ["_rid"]).drop("tok"))
    packed = pack(numbers, ["_rid"], overlap, max(max_tokens, FLOOR))
    # which sentences of which element each chunk takes; a chunk has few, as its tokens are bounded
    members = packed.withColumn("b", F.explode(F.sequence("first", "last"))).select("_rid", "chunk_no", "b").join(numbers, ["_rid", "b"])
    takes = members.groupBy("_rid", "chunk_no", "element_id", "_hash", "pos", "budget").agg(F.min("sent_no").alias("_from"), F.max("sent_no").alias("_to"))
    none = F.lit(None).cast("int")
    takes = cut(takes.unionAll(e.where("_table").select("_rid", F.lit(0).alias("chunk_no"), "element_id", "_hash", "pos", "_budget", none, none)))
    # numbers over all documents: those before the document, those before the run, the chunk's own
    runs = e.groupBy("_rid").agg(F.min(doc).alias(doc), F.min("run").alias("run"), F.first("_first").alias("_first"))
    counts = takes.groupBy("_rid").agg((F.max("chunk_no") + 1).alias("n")).join(runs, "_rid")
    before = scan(counts, [doc], "run", {"_upto": ("sum", F.col("n"))})
    placed = before.join(offsets(counts.groupBy(doc).agg(F.sum("n").alias("n")), doc, "n"), doc).select("_rid", doc, "run", "_first", (F.col("_upto") - F.col("n") + F.col("offset")).alias("_base"))
    stored = elements.select("element_id", F.xxhash64("content").alias("_hash"), "content", path.alias("section_path"))
    # repeated rows of an element give equal pieces, of which a set keeps one
    piece = F.when(F.col("_from").isNull(), F.col("content")).otherwise(F.array_join(F.slice(_pieces(F.col("content"), F.col("budget")), F.col("_from") + 1, F.col("_to") - F.col("_from") + 1), " "))
    got = takes.join(stored, ["element_id", "_hash"]).select("_rid", "chunk_no", F.col("_from").isNull().alias("_t"), "section_path", F.struct("pos", piece.alias("said"), "element_id").alias("m"))
    rows = got.groupBy("_rid", "chunk_no").agg(F.first("_t").alias("_t"), F.first("section_path").alias("section_path"), F.sort_array(F.collect_set("m")).alias("m")).join(placed, "_rid")
    body = F.array_join(F.transform("m", lambda x: x["said"]), " ")
    content = F.when(F.col("_t"), body).otherwise(F.concat(T.context_prefix(F.col(doc), F.col("section_path")), F.lit("\n\n"), body))
    short = F.when(F.length("_whole") <= ceiling, F.col("_whole")).otherwise(T.truncate_tokens(F.col("_whole"), ceiling))
    rows = rows.withColumn("element_type", F.when(F.col("_t"), "table").otherwise("text")).withColumn("_whole", content).withColumn("content", short)
    index = F.col("_base") + F.col("chunk_no")
    return rows.select(
        doc, "run", "chunk_no", "element_type", "content", "section_path", F.array_distinct(F.transform("m", lambda x: x["element_id"])).alias("source_element_ids"), F.col("_first.l").alias("language"),
        T.token_count(F.col("content")).alias("token_estimate"), index.alias("chunk_index"), T.hash_id(16, F.col(doc), F.col("element_type"), index, F.substring("content", 1, 100)).alias("chunk_id"),
    )


def split_table_rows(markdown: Column, budget: int) -> Column:
    """A table in lines as pieces under the budget, each with the head and the rule line; greedy over its rows."""
    lines = F.split(markdown, "\n")
    head = F.array_join(F.slice(lines, 1, 2), "\n")
    room = F.when(F.lit(budget) - T.token_count(head) < 10, F.greatest(F.lit(1), F.lit(budget))).otherwise(F.lit(budget) - T.token_count(head))
    empty = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def step(a: Column, row: Column) -> Column:
        k = T.token_count(row)
        full = (a["n"] + k > room) & (F.size(a["open"]) > 0)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(row)).otherwise(F.concat(a["open"], F.array(row))).alias("open"),
            F.when(full, k).otherwise(a["n"] + k).alias("n"),
        )

    body = F.aggregate(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), empty, step, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))
    return F.when(F.size(lines) < 3, F.array(markdown)).otherwise(F.transform(body, lambda rows: F.concat(head, F.lit("\n"), F.array_join(rows, "\n"))))
