"""Entities, property graph, indexes and traversal as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators.sets import similar_sets
from quarrylight.session import cut

# Relations that hold the documents together and carry no meaning of their own.
STRUCTURAL = ("belongs_to_document", "belongs_to_section", "child_of_section", "table_belongs_to_clause")

# Types of entities that part of a name is enough to find.
NAMED_KINDS = ("organization", "role", "regulation", "product")


def live_chunks(chunks: DataFrame) -> DataFrame:
    """Rows of chunks that no row says are deleted."""
    gone = chunks.where(F.col("deleted_at").isNotNull()).select("chunk_id").distinct()
    return chunks.join(gone, "chunk_id", "left_anti")


def canonical_names(mentions: DataFrame) -> DataFrame:
    """(norm, canonical_id): of all entities whose names are equal but for case and white space, the first one seen.

    One row per name comes out of a partial aggregation, so frequent names are no hot groups.
    """
    m = mentions.where(F.col("name").isNotNull() & F.col("entity_id").isNotNull()).withColumn("norm", T.normal_name(F.col("name"))).where("norm <> ''")
    return m.groupBy("norm").agg(F.min_by("entity_id", F.struct("extracted_at", "mention_id")).alias("canonical_id"), F.min(F.struct("extracted_at", "mention_id")).alias("seen"))


def merged_by_stems(names: DataFrame) -> DataFrame:
    """(norm, canonical_id, merged_id): names with equal sets of stems go to the one among them that was seen last."""
    n = names.withColumn("stems", T.name_stems(F.col("norm")))
    sets = n.where(F.size("stems") > 0).groupBy("stems").agg(F.max_by("canonical_id", F.col("seen")).alias("survivor"))
    return n.join(sets, "stems", "left").select("norm", "canonical_id", F.coalesce("survivor", "canonical_id").alias("merged_id"))


def similar_names(names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(norm_a, norm_b, score): pairs of names with different stem sets whose Jaccard score reaches the threshold.

    One of the names with the same set stands for all of them.
    """
    n = names.select("norm", T.name_stems(F.col("norm")).alias("stems")).where(F.size("stems") > 0)
    # one name per distinct set: equal sets are merged elsewhere
    n = n.groupBy("stems").agg(F.min("norm").alias("norm"))
    return similar_sets(n, "norm", "stems", threshold).toDF("norm_a", "norm_b", "score")


def merged_names(names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(norm, canonical_id, merged_id): each name goes to the name seen after it that is most like it, if any reaches the
    threshold (of equally like ones the first), and on from there.

    Names of one stem set are all alike and lead to the last of them; so sets are followed, not names: each to the most
    similar set with a later name.  Sets on the way grow later and later, so the way ends; steps are doubled each round.
    """
    n = cut(names.select("norm", "canonical_id", "seen", T.name_stems(F.col("norm")).alias("stems")).withColumn("sid", F.when(F.size("stems") > 0, F.md5(F.array_join("stems", " ")))))
    sets = n.where("sid is not null").groupBy("sid").agg(F.max("seen").alias("last"), F.max_by("canonical_id", "seen").alias("survivor"), F.first("stems").alias("stems"))
    near = similar_sets(sets.select("sid", "stems"), "sid", "stems", threshold)
    both = near.unionAll(near.select("b", "a", "score")).toDF("sid", "to", "score")
    ends = sets.select("sid", "last")
    ahead = both.join(ends, "sid").join(ends.toDF("to", "to_last"), "to").where("to_last > last")
    # of equally like sets the one whose next name comes first
    reached = ahead.join(n.select(F.col("sid").alias("to"), F.col("seen").alias("next")), "to").where("next > last").groupBy("sid", "to", "score").agg(F.min("next").alias("next"))
    up = cut(reached.groupBy("sid").agg(F.min_by("to", F.struct(-F.col("score"), F.col("next"))).alias("to")))
    while True:
        longer = up.alias("u").join(up.select(F.col("sid").alias("to"), F.col("to").alias("on")), "to", "left")
        longer = cut(longer.select("sid", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("more")))
        up = longer.select("sid", "to")
        if longer.where("more").isEmpty():
            break
    root = sets.select("sid").join(up, "sid", "left").select("sid", F.coalesce("to", "sid").alias("root")).join(sets.select(F.col("sid").alias("root"), "survivor"), "root").select("sid", "survivor")
    return n.join(root, "sid", "left").select("norm", "canonical_id", F.coalesce("survivor", "canonical_id").alias("merged_id"))


def entity_nodes(mentions: DataFrame) -> DataFrame:
    """(entity, name, entity_type, value, source_doc, mentions): the first mention names it, the others add their spellings."""
    ids = canonical_names(mentions).select("norm", "canonical_id")
    m = mentions.where("name is not null").select("name", "entity_type", "value", "source_doc", F.struct("extracted_at", "mention_id").alias("seen"), T.normal_name(F.col("name")).alias("norm")).join(ids, "norm")
    entity = F.concat(F.lit("entity::"), "canonical_id").alias("entity")
    # spellings of one name are few: they differ in case and white space only
    spelled = m.groupBy(entity, "name").agg(F.min("seen").alias("seen"), F.min_by(F.struct("entity_type", "value", "source_doc"), "seen").alias("x"))
    one = spelled.groupBy("entity").agg(F.min_by("x", "seen").alias("x"), F.array_sort(F.collect_list(F.struct("seen", "name"))).alias("s"))
    return one.select("entity", F.element_at("s", 1)["name"].alias("name"), "x.entity_type", "x.value", "x.source_doc", F.transform("s", lambda v: v["name"]).alias("mentions"))


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "doc_name", "element_type", "section_path").dropDuplicates(["chunk_id"]).where("chunk_id is not null")


def section_ids(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_name, element_type, depth, id, parent) of every section above each chunk; the deepest has the greatest depth."""
    path = F.col("section_path")
    name = lambda i: F.concat(F.lit("section::"), F.col("doc_name"), F.lit("::"), F.array_join(F.slice(path, F.lit(1), i), " > "))
    each = chunk_nodes(chunks).where(F.size(path) > 0).withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(path))))
    return each.select("chunk_id", "doc_name", "element_type", "depth", F.size(path).alias("deepest"), name(F.col("depth")).alias("id"), F.when(F.col("depth") > 1, name(F.col("depth") - 1)).alias("parent"))


def nodes(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, node_type, layer, name, doc_name, depth) of chunks, documents, sections and canonical entities."""
    c = chunk_nodes(chunks)
    none = F.lit(None).cast("string")
    chunk = c.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("node_type"), F.when(F.col("element_type") == "text", "text").otherwise("cross_modal").alias("layer"), none.alias("name"), "doc_name", F.lit(None).cast("int").alias("depth"))
    doc = c.select("doc_name").distinct().select(F.concat(F.lit("doc::"), "doc_name"), F.lit("document"), F.lit("text"), "doc_name", "doc_name", F.lit(None).cast("int"))
    section = section_ids(chunks).select("id", F.lit("section"), F.lit("text"), none, "doc_name", "depth").distinct()
    named = canonical_names(mentions).groupBy("canonical_id").agg(F.min_by("norm", "seen").alias("norm"))
    entity = named.select(F.concat(F.lit("entity::"), "canonical_id"), F.lit("entity"), F.lit("text"), "norm", none, F.lit(None).cast("int"))
    return chunk.unionAll(doc).unionAll(section).unionAll(entity)


def mention_links(mentions: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, chunk) pairs of mentions whose chunk exists, and the mentions (mention_id) whose chunk does not."""
    names = canonical_names(mentions).select("norm", "canonical_id")
    m = mentions.where(F.col("name").isNotNull()).select("mention_id", T.normal_name(F.col("name")).alias("norm"), F.col("source_chunk_id").alias("chunk_id")).distinct().join(names, "norm")
    c = chunk_nodes(chunks).select("chunk_id")
    pairs = m.select(F.concat(F.lit("entity::"), "canonical_id").alias("entity"), "chunk_id").distinct().join(c, "chunk_id", "left_semi")
    orphans = m.join(c, "chunk_id", "left_anti").select("mention_id")
    return pairs, orphans


def edges(chunks: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(src, dst, relation_type), one row per pair of nodes; of several relations between two nodes the latest counts."""
    c, s = chunk_nodes(chunks), section_ids(chunks)
    doc = lambda d: F.concat(F.lit("doc::"), d)
    to_doc = c.select(F.col("chunk_id").alias("src"), doc(F.col("doc_name")).alias("dst"), F.lit("belongs_to_document").alias("relation_type"))
    sec_doc = s.select("id", doc(F.col("doc_name")), F.lit("belongs_to_document")).distinct()
    child = s.where("parent is not null").select("id", "parent", F.lit("child_of_section")).distinct()
    to_sec = s.where("depth = deepest").select("chunk_id", "id", F.when(F.col("element_type") == "table", "table_belongs_to_clause").otherwise("belongs_to_section"))
    pairs, _ = mention_links(mentions, chunks)
    both = pairs.select("entity", "chunk_id", F.lit("mentioned_in")).unionAll(pairs.select("chunk_id", "entity", F.lit("mentions_entity")))
    return to_doc.unionAll(sec_doc).unionAll(child).unionAll(to_sec).unionAll(both).unionAll(relation_edges(mentions, relations))


def relation_edges(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(src, dst, relation_type) between canonical entities; relations without both ends are dropped."""
    ids = mentions.where("name is not null").select("entity_id", T.normal_name(F.col("name")).alias("norm")).join(canonical_names(mentions).select("norm", "canonical_id"), "norm").groupBy("entity_id").agg(F.min("canonical_id").alias("canonical_id"))
    r = relations.select("rel_id", "source_id", "target_id", "relation_type", "extracted_at").distinct()
    r = r.join(ids.toDF("source_id", "a"), "source_id").join(ids.toDF("target_id", "b"), "target_id")
    return r.groupBy(F.concat(F.lit("entity::"), "a").alias("src"), F.concat(F.lit("entity::"), "b").alias("dst")).agg(F.max_by(F.coalesce("relation_type", F.lit("related_to")), F.struct("extracted_at", "rel_id")).alias("relation_type"))


def cross_document(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entity, n_docs) of entities that chunks of more than one document mention."""
    pairs, _ = mention_links(mentions, chunks)
    docs = chunk_nodes(chunks).select("chunk_id", "doc_name")
    return pairs.join(docs, "chunk_id").select("entity", "doc_name").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs > 1")


def name_index(mentions: DataFrame) -> DataFrame:
    """(name, entity): names and further mentions of at least two characters, in lower case."""
    ids = canonical_names(mentions).select("norm", "canonical_id")
    m = mentions.where("name is not null").select("name", "mentions", T.normal_name(F.col("name")).alias("norm")).distinct().join(ids, "norm")
    every = F.explode(F.array_compact(F.concat(F.array("name"), F.coalesce("mentions", F.array().cast("array<string>")))))
    return m.select(F.concat(F.lit("entity::"), "canonical_id").alias("entity"), every.alias("n")).select("entity", T.strip(F.lower("n")).alias("name")).where(F.length("name") >= 2).distinct()


def token_index(mentions: DataFrame) -> DataFrame:
    """(stem, entity) of the words of more than one character of indexed names."""
    return name_index(mentions).select("entity", F.explode(F.split("name", r"\s+")).alias("w")).where(F.length("w") > 1).select(T.stem_index(F.col("w")).alias("stem"), "entity").distinct()


def match_questions(questions: DataFrame, index: DataFrame, min_length: int = 3) -> DataFrame:
    """(query_id, entity) where an indexed name stands in the question.

    Every piece of a question that has the length of some name that begins with the same characters is joined to the names
    as a whole, an equi-join instead of comparing each question with each name.
    """
    head = lambda c, at: F.substring(c, at, F.lit(min_length))
    names = index.where(F.length("name") >= min_length)
    # lengths of names per beginning: no more than the longest name has characters
    lengths = names.groupBy(head(F.col("name"), F.lit(1)).alias("head")).agg(F.collect_set(F.length("name")).alias("lengths"))
    q = questions.select("query_id", F.lower("question").alias("q")).distinct()
    starts = q.select("query_id", "q", F.explode(F.sequence(F.lit(1), F.length("q"))).alias("at")).withColumn("head", head(F.col("q"), F.col("at")))
    pieces = starts.join(lengths, "head").select("query_id", F.explode(F.transform("lengths", lambda n: F.substring(F.col("q"), F.col("at"), n))).alias("name"))
    return pieces.distinct().join(names, "name").select("query_id", "entity").distinct()


def match_by_words(questions: DataFrame, named: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, entity) of entities that share a stem with a question and
    * whose name stands in it, or
    * half of whose name's words, stop words aside, are words of the question, as such or by their stems, or
    * that are of a kind of ``NAMED_KINDS`` and have one word of more than three letters in the question, even inside another
      word, or by its stem.

    ``named``: entity, name, entity_type; ``tokens``: the token index.
    """
    stop = F.array(*[F.lit(w) for w in T.STOP_WORDS])
    q = questions.select("query_id", F.lower("question").alias("q"), T.query_words(F.col("question")).alias("kw")).withColumn("ks", F.array_distinct(F.transform("kw", T.stem_query)))
    hits = q.select("query_id", F.explode(F.array_union("kw", "ks")).alias("stem")).join(tokens, "stem").select("query_id", "entity").distinct()
    name = T.strip(F.lower("name"))
    words = F.array_except(F.filter(F.split(name, r"\s+"), lambda w: F.length(w) > 0), stop)
    n = named.select("entity", name.alias("name"), "entity_type", words.alias("w")).where(F.length("name") >= 2).withColumn("ws", F.array_distinct(F.transform("w", T.stem_query)))
    j = hits.join(n, "entity").join(q, "query_id")
    whole = (F.length("name") > 2) & F.contains("q", "name")
    shared = F.greatest(F.size(F.array_intersect("w", "kw")), F.size(F.array_intersect("ws", "ks")))
    half = (F.size("w") > 0) & (shared >= F.greatest(F.lit(1.0), F.size("w") * 0.5))
    part = F.coalesce(F.col("entity_type").isin(*NAMED_KINDS), F.lit(False)) & F.exists("w", lambda w: (F.length(w) > 3) & (F.contains(F.col("q"), w) | F.array_contains(F.col("ks"), T.stem_query(w))))
    return j.where(whole | half | part).select("query_id", "entity")


def match_entities(questions: DataFrame, mentions: DataFrame) -> DataFrame:
    """(query_id, entity) of all entities that a question names, wholly or in part."""
    q = questions.where("question is not null")
    return match_questions(q, name_index(mentions)).unionAll(match_by_words(q, entity_nodes(mentions), token_index(mentions))).distinct()


def expand(seeds: DataFrame, edge_table: DataFrame, hops: int = 2, cap: int | None = None, key: str = "query_id", skip: Sequence[str] = STRUCTURAL) -> DataFrame:
    """(key, node, hop) of what is reached from each key's seeds over edges taken in both directions.

    A loop of equi-joins; nodes reached are written to the checkpoint folder each hop.  With ``cap``, a key keeps its
    first nodes by hop and id, so that the same ones stay each time; then twice as many neighbours of a node, the first
    by id, are all that can be among them, and hubs have no more.
    """
    e = edge_table.where(~F.col("relation_type").isin(*skip)) if skip else edge_table
    both = e.select("src", "dst").unionAll(e.select("dst", "src")).where("src <> dst").distinct()
    if cap is not None:
        both = both.withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("_n") <= 2 * cap).drop("_n")
    both = cut(both)
    seen = cut(seeds.select(key, F.col("node")).distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, hops + 1):
        front = seen.where(F.col("hop") == hop - 1)
        new = front.join(both.withColumnRenamed("src", "node"), "node").select(key, F.col("dst").alias("node")).distinct().join(seen, [key, "node"], "left_anti").withColumn("hop", F.lit(hop))
        both_ = seen.unionAll(new)
        if cap is not None:
            both_ = both_.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("hop", "node"))).where(F.col("_n") <= cap).drop("_n")
        seen = cut(both_)
    return seen


def shortest_path(pairs: DataFrame, edge_table: DataFrame, hops: int = 4) -> DataFrame:
    """(src, dst, path) along directed edges, of equally short ones the first by node ids; no row where none is found."""
    ends = pairs.select("src", "dst")
    return trails(ends.withColumnRenamed("dst", "key"), ends.select(F.col("dst").alias("key"), "dst"), edge_table, "key", hops)


def trails(sources: DataFrame, targets: DataFrame, edge_table: DataFrame, key: str = "query_id", hops: int = 4) -> DataFrame:
    """(src, dst, path) of the shortest path of at most ``hops`` edges from each source (key, src) to each target (key, dst)
    of the same key; of equally short ones the first by node ids, no row where none is found.

    Distances are searched backwards from the targets, 64 of them at once as the bits of a number, so that a hop has no more
    rows than nodes and blocks of targets, however many pairs there are.  Paths then go from the source to the first by id of
    the nearest neighbours; from there on they are found once for all sources.  Each hop is written to the checkpoint folder.
    """
    e = edge_table.select(F.col("src").alias("at"), F.col("dst").alias("to")).where("at <> to")
    targets = targets.select(F.col(key).alias("key"), "dst").where("dst is not null")
    # numbers are dense within a partition; they hold as they are written
    numbered = cut(targets.select("dst").distinct().withColumn("n", F.monotonically_increasing_id()))
    numbered = _small(numbered.select("dst", F.shiftright("n", 6).alias("block"), F.col("n").bitwiseAND(F.lit(63)).cast("int").alias("bit")))
    bits = F.bit_or(F.expr("shiftleft(1L, bit)"))
    by_key = targets.join(numbered, "dst").groupBy("key", "block").agg(bits.alias("bits"))
    reach = numbered.groupBy(F.col("dst").alias("at"), "block").agg(bits.alias("b0"))

    asked = sources.select(F.col(key).alias("key"), F.col("src").alias("at")).join(by_key, "key").groupBy("at", "block").agg(F.bit_or("bits").alias("asked"))
    own = F.col("asked").bitwiseAND(F.coalesce("b0", F.lit(0).cast("bigint")))
    asked = cut(asked.join(_small(reach), ["at", "block"], "left").select("at", "block", F.col("asked").bitwiseXOR(own).alias("asked"), own.alias("own")))
    itself = asked.where("own <> 0").select("at", "block", _bits_of("own").alias("bit")).join(numbered, ["block", "bit"]).select(F.col("at").alias("src"), "dst", F.array("at").alias("path"))
    asked = asked.where("asked <> 0").drop("own")

    for hop in range(1, hops):
        before = [F.col(f"b{k}") for k in range(hop)]
        front = _small(reach.where(before[-1] != 0).select(F.col("at").alias("to"), "block", before[-1].alias("new")))
        new = e.join(front, "to").select("at", "block", *[F.lit(0).cast("bigint").alias(f"b{k}") for k in range(hop)], "new")
        both = reach.withColumn("new", F.lit(0).cast("bigint")).unionByName(new).groupBy("at", "block").agg(*[F.bit_or(c).alias(c) for c in (*reach.columns[2:], "new")])
        seen = before[0]
        for c in before[1:]:
            seen = seen.bitwiseOR(c)
        reach = cut(both.select("at", "block", *before, F.col("new").bitwiseAND(F.bitwise_not(seen)).alias(f"b{hop}")).where(seen.bitwiseOR(F.col("new")) != 0))

    # what is more than an edge from the target goes on; the way on from there, from the last hop to the first
    layers, further = [], None
    if hops > 2:
        far = F.col("b2")
        for k in range(3, hops):
            far = far.bitwiseOR(F.col(f"b{k}"))
        ahead = asked.join(e, "at").groupBy(F.col("to").alias("at"), "block").agg(F.bit_or("asked").alias("asked"))
        ahead = ahead.join(reach, ["at", "block"]).select("at", "block", F.col("asked").bitwiseAND(far).alias("asked")).where("asked <> 0")
        for hop in range(2, hops):
            layers.append(cut(_nearest(ahead, e, reach)))
            ahead = layers[-1].where("d > 1").groupBy(F.col("to").alias("at"), "block").agg(bits.alias("asked"))
    for layer in reversed(layers):
        further = _with_rest(layer, further).select("at", "block", "bit", "way")
    found = _with_rest(_nearest(asked, e, reach), further).join(numbered, ["block", "bit"])
    return found.select(F.col("at").alias("src"), "dst", F.concat(F.array("at"), "way", F.array("dst")).alias("path")).unionAll(itself)


def _small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """The rows with a hint to broadcast them where they are few; cheap for what was written by cut."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _bits_of(c: str) -> Column:
    """The numbers of the bits of a bigint that are set, a row for each."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col(c), i) == 1))


def _nearest(asked: DataFrame, e: DataFrame, reach: DataFrame) -> DataFrame:
    """(at, block, bit, d, to): for each target that is asked (at, block, asked) the first by id of the neighbours that are nearest to it, and how far it is from there."""
    levels = [c for c in reach.columns if c not in ("at", "block")]
    j = asked.join(e, "at").join(reach.withColumnRenamed("at", "to"), ["to", "block"])
    j = j.select("at", "block", "to", *[F.col("asked").bitwiseAND(F.col(c)).alias(c) for c in levels])
    j = j.where(" or ".join(f"{c} <> 0" for c in levels))
    w = Window.partitionBy("at", "block")
    best = j.select("*", *[F.bit_or(c).over(w).alias(f"any_{c}") for c in levels])
    # a target counts at the least distance that any neighbour has
    nearer, hits, d = F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(None).cast("int")
    for k, c in enumerate(levels):
        hits = hits.bitwiseOR(F.col(c).bitwiseAND(F.bitwise_not(nearer)))
        nearer = nearer.bitwiseOR(F.col(f"any_{c}"))
        d = F.coalesce(d, F.when(F.getbit(F.col(c), F.col("bit")) == 1, k))
    each = best.select("at", "block", "to", *levels, hits.alias("hits")).where("hits <> 0").select("at", "block", "to", *levels, _bits_of("hits").alias("bit"))
    return each.groupBy("at", "block", "bit", d.alias("d")).agg(F.min("to").alias("to"))


def _with_rest(step: DataFrame, further: DataFrame | None) -> DataFrame:
    """The steps with ``way``, the nodes between ``at`` and the target; ``further`` has them from the next node on, where there are any."""
    way = F.when(F.col("d") > 0, F.array("to")).otherwise(F.array().cast("array<string>"))
    if further is None:
        return step.withColumn("way", way)
    rest = further.select(F.col("at").alias("to"), "block", "bit", F.col("way").alias("rest"))
    return step.join(rest, ["to", "block", "bit"], "left").withColumn("way", F.concat(way, F.coalesce("rest", F.array().cast("array<string>"))))


def graph_scores(candidates: DataFrame, links: DataFrame, wanted: DataFrame, across: DataFrame) -> DataFrame:
    """(query_id, chunk_id, graph_score): how many entities a chunk names, whether one is wanted, whether one joins documents; 0 for a chunk that names none."""
    c = candidates.select("query_id", "chunk_id").distinct()
    e = c.join(links, "chunk_id").join(wanted.select("query_id", "entity").distinct().withColumn("_w", F.lit(1)), ["query_id", "entity"], "left").join(across.select("entity").withColumn("_x", F.lit(1)), "entity", "left")
    # an entity is a neighbour twice, by the edge to the chunk and by the one from it
    s = e.groupBy("query_id", "chunk_id").agg((F.count(F.lit(1)) * 2).alias("n"), F.coalesce(F.max("_w"), F.lit(0)).alias("w"), F.coalesce(F.max("_x"), F.lit(0)).alias("x"))
    score = F.least(0.3 * F.least(F.col("n") / 5.0, F.lit(1.0)) + 0.5 * F.col("w") + 0.2 * F.col("x"), F.lit(1.0))
    return c.join(s, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", F.when(F.col("n").isNull(), 0.0).otherwise(F.round(score, 4)).alias("graph_score"))
