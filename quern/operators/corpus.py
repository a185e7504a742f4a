"""The gold corpus: nodes located and sliced from pages, cleaned, packed into chunks of three kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut, strip
from .chunking import PAGES_PER_BLOCK, pack
from .hierarchy import resolve_hierarchy


#: Parts into which the descendants of a node are divided where they fetch its title.
TITLE_SALTS = 8
# How nodes are extracted, and what is said of the chunks made from them.
AUTO_MODES, MANUAL_MODES = ("auto_text", "hybrid"), ("manual_table", "hybrid")
EXTRACTED, VERIFIED = "auto_extracted_structure_validated", "human_verified"
SECTION_METHOD, QUESTION_METHOD, TABLE_METHOD = "hierarchy_bounded_section_v3", "question_recommendation_v3", "manual_table_import_v1"
LEAST_ROOM, LEAST_TEXT = 220, 4


def require_pass(*reports: DataFrame, column: str = "status") -> None:
    """All upstream validation reports must be all pass."""
    for r in reports:
        if not r.where(F.coalesce(F.col(column), F.lit("")) != "pass").isEmpty():
            raise ValueError("an upstream report has rows that do not pass")


def title_paths(nodes: DataFrame, strict: bool = True) -> DataFrame:
    """Nodes with title_path, the display titles from the root down; a cycle or missing parent is an error if strict, else a null path."""
    links = nodes.select(F.col("node_id").alias("node"), F.when(strip(F.col("parent_id")) != "", F.col("parent_id")).alias("parent"))
    if strict and not links.where("parent IS NOT NULL").join(links.select(F.col("node").alias("parent")), "parent", "left_anti").isEmpty():
        raise ValueError("a parent is missing")
    known = links.select(F.col("node").alias("parent"), F.lit(True).alias("k"))
    r = resolve_hierarchy(links.join(known, "parent", "left").select("node", F.when(F.col("k"), F.col("parent")).alias("parent")))
    if strict and not r.where("depth = 0").isEmpty():
        raise ValueError("the nodes have a cycle")
    steps = r.where("depth > 0").select("node", F.posexplode("path").alias("at", "step"))
    # A root is a step of all its descendants, so steps meet their titles by (step, salt).
    some = lambda c: F.when(strip(F.col(c)) != "", F.col(c))
    own = F.coalesce(*[some(c) for c in ("display_title", "marker_text") if c in nodes.columns], "node_id")
    steps = steps.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(TITLE_SALTS)).cast("int"))
    titles = nodes.select(F.col("node_id").alias("step"), own.alias("title"), F.explode(F.sequence(F.lit(0), F.lit(TITLE_SALTS - 1))).alias("salt"))
    paths = steps.join(titles, ["step", "salt"]).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "title"))), lambda s: s["title"]).alias("title_path"))
    return nodes.join(paths.withColumnRenamed("node", "node_id"), "node_id", "left")


def locate_nodes(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes with the 0-based position of their marker on their page, -1 where it is not found."""
    p = pages.select("source_id", "pdf_page_number", F.col("text").alias("_page_text"))
    n = nodes.withColumn("pdf_page_number", F.col("pdf_page"))
    x = n.join(p, ["source_id", "pdf_page_number"], "left")
    return x.withColumn("start_pos", F.coalesce(X.nth_position("_page_text", "marker_text", F.coalesce("marker_occurrence", F.lit(1))), F.lit(-1))).drop("_page_text", "pdf_page_number")


def document_ends(boundaries: DataFrame) -> DataFrame:
    """(source_id, end_page, end_pos): the earliest of a document's stops; ``boundaries`` has one row per stop, page and position."""
    return boundaries.groupBy("source_id").agg(F.min(F.struct("page", "pos")).alias("m")).select("source_id", F.col("m.page").alias("end_page"), F.col("m.pos").alias("end_pos"))


def slice_nodes(located: DataFrame, pages: DataFrame, ends: DataFrame) -> DataFrame:
    """(source_id, node_id, segment_text, pdf_page_start, pdf_page_end): each node's text up to the next one's start or the document's end.

    The next start is a lead in node order (equal orders by id); the pages between
    the two are met by a range join within the source and cut at both ends; blank
    parts do not count.  A node without text has an empty one on its own page.
    """
    w = Window.partitionBy("source_id").orderBy("node_order", "node_id")
    n = located.where("start_pos >= 0").select("source_id", "node_id", "node_order", F.col("pdf_page").alias("page_a"), F.col("start_pos").alias("pos_a"))
    n = n.withColumn("_n", F.lead(F.struct("page_a", "pos_a")).over(w)).join(ends, "source_id", "left")
    n = n.select("source_id", "node_id", "page_a", "pos_a", F.coalesce(F.col("_n.page_a"), "end_page", F.lit(2**31 - 1)).alias("page_b"), F.coalesce(F.col("_n.pos_a"), "end_pos", F.lit(2**31 - 1)).alias("pos_b"))
    # Nodes and pages meet by blocks of pages, so that a source with many of both is no single key.
    of = lambda c: F.floor(F.col(c) / PAGES_PER_BLOCK)
    p = pages.select("source_id", F.col("pdf_page_number").alias("page"), "text", of("pdf_page_number").alias("_block"))
    last = p.groupBy("source_id").agg(F.max("page").alias("_max"))
    spread = n.join(last, "source_id").withColumn("_to", F.least("page_b", "_max")).where("_to >= page_a").select(*n.columns, F.explode(F.sequence(of("page_a"), of("_to"))).alias("_block"))
    x = spread.join(p, ["source_id", "_block"]).where("page BETWEEN page_a AND page_b")
    left = F.when(F.col("page") == F.col("page_a"), F.col("pos_a")).otherwise(0)
    right = F.when(F.col("page") == F.col("page_b"), F.col("pos_b")).otherwise(F.length("text"))
    x = x.withColumn("_s", F.substr("text", left + 1, F.greatest(right - left, F.lit(0)))).where(F.length(strip(F.col("_s"))) > 0)
    parts = F.array_sort(F.collect_list(F.struct("page", "_s")))
    found = x.groupBy("source_id", "node_id").agg(F.array_join(F.transform(parts, lambda s: s["_s"]), "\n").alias("segment_text"), F.min("page").alias("pdf_page_start"), F.max("page").alias("pdf_page_end"))
    return n.select("source_id", "node_id", "page_a").join(found, ["source_id", "node_id"], "left").select(
        "source_id", "node_id", F.coalesce("segment_text", F.lit("")).alias("segment_text"), F.coalesce("pdf_page_start", "page_a").alias("pdf_page_start"), F.coalesce("pdf_page_end", "page_a").alias("pdf_page_end"))


CHUNK_COLUMNS = [
    "chunk_id", "source_id", "source_order", "node_id", "content_type", "display_title", "title_path", "pdf_page_start", "pdf_page_end", "cross_page", "extraction_mode", "review_status", "build_method",
    "question_node_id", "recommendation_node_ids", "table_id", "context_repeated", "text", "retrieval_text", "char_count", "text_sha256", "corpus_version",
]


def make_chunks(parts: DataFrame, content_type: str, build_method: str, review_status: str, corpus_version: str) -> DataFrame:
    """The 22 columns of a chunk from its parts; text is normalised to one line and hashed so that white space does not count."""
    have = set(parts.columns)
    opt = lambda c, t: F.col(c).cast(t) if c in have else F.lit(None).cast(t)
    x = parts.withColumn("text", X.one_line("text"))
    return x.select(
        "chunk_id", "source_id", F.col("node_order").alias("source_order"), "node_id", F.lit(content_type).alias("content_type"), "display_title", "title_path",
        "pdf_page_start", "pdf_page_end", (F.col("pdf_page_end") != F.col("pdf_page_start")).alias("cross_page"), "extraction_mode", F.lit(review_status).alias("review_status"),
        F.lit(build_method).alias("build_method"), F.coalesce(opt("question_node_id", "string"), F.lit("")).alias("question_node_id"), F.coalesce(opt("recommendation_node_ids", "array<string>"), F.array().cast("array<string>")).alias("recommendation_node_ids"),
        F.coalesce(opt("table_id", "string"), F.lit("")).alias("table_id"), F.coalesce(opt("context_repeated", "boolean"), F.lit(False)).alias("context_repeated"), "text", X.retrieval_text("display_title", "title_path", "text").alias("retrieval_text"),
        F.length("text").alias("char_count"), X.text_hash("text").alias("text_sha256"), F.lit(corpus_version).alias("corpus_version"),
    )


def clean_bodies(bodies: DataFrame, column: str, cleanup: DataFrame | None) -> DataFrame:
    """``bodies`` with the column cleaned by its node's rules, in order, as one compact line; ``cleanup`` has node_id and rules."""
    if cleanup is not None:
        bodies = bodies.join(cleanup.select("node_id", "rules"), "node_id", "left")
        bodies = bodies.withColumn(column, X.clean_node(column, "rules")["text"]).drop("rules")
    return bodies.withColumn(column, X.compact_cjk(X.one_line(column)))


def section_chunks(nodes: DataFrame, segments: DataFrame, version: str, target=1000, limit=1800, least=120, overflow=250, by_question: Column | None = None, cleanup: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, diagnostics) of the included text nodes; empty and citation-only ones are skipped and reported.

    ``by_question`` says of a node whether its source is chunked by question; the
    question and recommendation nodes of such a source are left to question_chunks.
    ``cleanup`` has a node's rules, applied to its text without its own heading.
    """
    asked = F.coalesce(by_question, F.lit(False)) if by_question is not None else F.lit(False)
    n = nodes.where((F.col("include_status") == "included") & F.col("extraction_mode").isin(*AUTO_MODES) & ~(asked & F.col("node_type").isin("question", "recommendation")))
    x = n.join(segments, ["source_id", "node_id"], "left")
    x = x.withColumn("_body", X.strip_own_heading(F.coalesce("segment_text", F.lit("")), "marker_text", "display_title", "content_anchor" if "content_anchor" in nodes.columns else None))
    x = clean_bodies(x, "_body", cleanup)
    x = cut(x.withColumn("_skip", (F.col("_body") == "") | X.citation_only("_body")))  # chunks and diagnostics
    sizes = [F.lit(v) for v in (target, limit, least, overflow)]
    parts = x.where("NOT _skip").select("*", F.posexplode(pack("_body", *sizes)).alias("part_no", "text"))
    parts = parts.withColumn("chunk_id", F.format_string("%s-SEC-%03d-C%02d", "source_id", "node_order", F.col("part_no") + 1)).withColumn("context_repeated", F.col("part_no") > 0)
    notes = x.where("_skip").select("source_id", "node_id", F.lit("structural_only").alias("category"), F.length("_body").alias("value"))
    return make_chunks(parts, "section_text", SECTION_METHOD, EXTRACTED, version), notes


def question_chunks(nodes: DataFrame, segments: DataFrame, version: str, target=1000, limit=1800, least=120, overflow=250, context_limit: int = 420, by_question: Column | None = None, cleanup: DataFrame | None = None, overrides: DataFrame | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunks, diagnostics): the question and a recommendation below it; continuations repeat question and context.

    A chunk has the question's node, title and path, and the pages of both.  A
    question without recommendation, a text of fewer than four characters, and one
    that leaves no room for the recommendation are errors, or with ``strict`` off
    reported and left out.  ``overrides`` has node_id and context.
    """
    asked = by_question if by_question is not None else F.lit(True)
    n = nodes.where((F.col("include_status") == "included") & F.col("extraction_mode").isin(*AUTO_MODES) & asked).join(segments, ["source_id", "node_id"], "left")
    texts = clean_bodies(n.where(F.col("node_type").isin("question", "recommendation")).withColumn("_body", X.one_line(F.coalesce("segment_text", F.lit("")))), "_body", cleanup)
    texts = cut(texts)  # met twice
    q = texts.where("node_type = 'question'").select("source_id", F.col("node_id").alias("question_node_id"), F.col("node_order").alias("_qo"), F.col("_body").alias("_q"), "display_title", "title_path", F.col("pdf_page_start").alias("_qa"), F.col("pdf_page_end").alias("_qb"))
    r = texts.where("node_type = 'recommendation'").select("source_id", F.col("parent_id").alias("question_node_id"), F.col("node_id").alias("_r"), "node_order", "_body", F.col("pdf_page_start").alias("_ra"), F.col("pdf_page_end").alias("_rb"))
    if overrides is not None:
        r = r.join(overrides.select(F.col("node_id").alias("_r"), F.col("context").alias("_given")), "_r", "left")
    x = q.join(r, ["source_id", "question_node_id"], "left")
    x = x.withColumn("_ctx", X.recommendation_context("_body", context_limit, "_given" if overrides is not None else None))
    room = F.lit(limit) - F.length("_q") - F.length("_ctx") - 2
    wrong = F.when(F.col("_r").isNull(), "question_without_recommendation").when(F.length("_q") < LEAST_TEXT, "question_too_short").when(F.length("_body") < LEAST_TEXT, "recommendation_too_short").when(room < LEAST_ROOM, "no_room_beside_question")
    x = cut(x.withColumn("_room", room).withColumn("_wrong", wrong))
    notes = x.where("_wrong IS NOT NULL").select("source_id", F.coalesce("_r", "question_node_id").alias("node_id"), F.col("_wrong").alias("category"), F.coalesce(F.length("_body"), F.lit(0)).alias("value"))
    if strict:
        bad = notes.limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0].category}: {bad[0].node_id}")
    aim = F.least("_room", F.greatest(F.lit(300), F.lit(target) - F.length("_q") - F.length("_ctx")))
    small = F.least(F.lit(least), F.greatest(F.lit(100), F.floor(F.col("_room") / 3).cast("int")))
    x = x.where("_wrong IS NULL").select("*", F.posexplode(pack("_body", aim, "_room", small, F.lit(overflow))).alias("part_no", "_t"))
    x = x.withColumn("text", F.when(F.col("part_no") == 0, F.concat_ws("\n", "_q", "_t")).otherwise(F.concat_ws("\n", "_q", "_ctx", "_t")))
    x = x.withColumn("chunk_id", F.format_string("%s-QR-%03d-%03d-C%02d", "source_id", "_qo", "node_order", F.col("part_no") + 1)).withColumn("context_repeated", F.col("part_no") > 0)
    x = x.withColumn("node_id", F.col("question_node_id")).withColumn("recommendation_node_ids", F.array("_r")).withColumn("extraction_mode", F.lit("auto_text"))
    x = x.withColumn("pdf_page_start", F.least("_qa", "_ra")).withColumn("pdf_page_end", F.greatest("_qb", "_rb"))
    return make_chunks(x, "question_recommendation", QUESTION_METHOD, EXTRACTED, version), notes


def table_chunks(evidence: DataFrame, nodes: DataFrame, version: str, strict: bool = True) -> DataFrame:
    """Verified manual table records as chunks; a record that is not verified, or whose node is not manual or hybrid, is an error, or with ``strict`` off left out."""
    n = nodes.select("source_id", "node_id", "node_order", "title_path", F.col("extraction_mode").alias("_mode"))
    x = evidence.where("include_status = 'included'").join(n, ["source_id", "node_id"], "left")
    sound = (F.coalesce("review_status", F.lit("")) == VERIFIED) & F.coalesce(F.col("_mode").isin(*MANUAL_MODES), F.lit(False))
    if strict and not x.where(~sound).isEmpty():
        raise ValueError("a manual table record is not verified, or its node is not manual")
    x = x.where(sound).withColumn("chunk_id", F.col("record_id")).withColumn("extraction_mode", F.lit("manual_table")).withColumn("pdf_page_start", F.col("pdf_page")).withColumn("pdf_page_end", F.col("pdf_page"))
    return make_chunks(x, "manual_table_chunk", TABLE_METHOD, VERIFIED, version)


def build_corpus(nodes: DataFrame, pages: DataFrame, ends: DataFrame, evidence: DataFrame, version: str, target=1000, limit=1800, least=120, overflow=250, context_limit: int = 420, by_question: Column | None = None, cleanup: DataFrame | None = None, overrides: DataFrame | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunks, diagnostics): sections, questions with their recommendations and verified tables, as one corpus.

    ``nodes`` are located and have their title paths.  With ``strict`` an included
    manual node without evidence is an error too.  Chunks have no order of rows;
    ``corpus_order`` is that of the written corpus.
    """
    segments = cut(slice_nodes(nodes, pages, ends))
    sizes = {"target": target, "limit": limit, "least": least, "overflow": overflow, "by_question": by_question, "cleanup": cleanup}
    sections, skipped = section_chunks(nodes, segments, version, **sizes)
    asked = by_question if by_question is not None else F.lit(False)
    questions, wrong = question_chunks(nodes, segments, version, **{**sizes, "by_question": asked}, context_limit=context_limit, overrides=overrides, strict=strict)
    tables = table_chunks(evidence, nodes, version, strict)
    open_ = uncovered_manual_nodes(nodes, evidence).select("source_id", "node_id", F.when(F.col("severity") == "error", "missing_manual_evidence").otherwise("hybrid_without_manual_evidence").alias("category"), F.lit(0).alias("value"))
    if strict and not open_.where("category = 'missing_manual_evidence'").isEmpty():
        raise ValueError("an included manual node has no evidence")
    return sections.unionByName(questions).unionByName(tables), skipped.unionByName(wrong).unionByName(open_)


def uncovered_manual_nodes(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Included manual nodes without evidence, as errors, and hybrid ones, as notes."""
    need = nodes.where("include_status = 'included'").where(F.col("extraction_mode").isin("manual_table", "hybrid"))
    return need.join(evidence.where("include_status = 'included'").select("node_id").distinct(), "node_id", "left_anti").select("source_id", "node_id", F.when(F.col("extraction_mode") == "manual_table", "error").otherwise("note").alias("severity"))


def corpus_order(chunks: DataFrame) -> DataFrame:
    """The order in which a corpus is written."""
    return chunks.orderBy("source_id", "source_order", "content_type", "chunk_id")


def corpus_summary(chunks: DataFrame) -> DataFrame:
    """Statistics by source and content type, and of all in one row ALL, ALL; one pass by grouping sets."""
    g = chunks.groupingSets([["source_id", "content_type"], []], "source_id", "content_type").agg(
        F.count("*").alias("chunks"), F.min("char_count").alias("min_chars"), F.bround(F.median("char_count"), 1).alias("median_chars"), F.bround(F.avg("char_count"), 1).alias("mean_chars"), F.max("char_count").alias("max_chars"),
        F.count_if("cross_page").alias("cross_page"), F.grouping_id().alias("_g"))
    name = lambda c: F.when(F.col("_g") > 0, F.lit("ALL")).otherwise(F.col(c)).alias(c)
    return g.select(name("source_id"), name("content_type"), "chunks", "min_chars", "median_chars", "mean_chars", "max_chars", "cross_page")
