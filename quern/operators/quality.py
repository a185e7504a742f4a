"""Declarative validation: rules as columns, one row per record with issues and status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import blank, strip


@dataclass(frozen=True)
class Rule:
    """A condition that makes an issue; a warning only asks for review.  Null conditions do not hold."""

    name: str
    when: Column
    warning: bool = False


def validate(df: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """(keep..., issues, status): names of the rules that hold, issues before warnings; error, review or pass."""
    pick = lambda w: F.filter(F.array(*[F.when(r.when, F.lit(r.name)) for r in rules if r.warning == w] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    x = df.select(*keep, pick(False).alias("_e"), pick(True).alias("_w"))
    return x.select(*keep, F.array_join(F.concat("_e", "_w"), "; ").alias("issues"), F.when(F.size("_e") > 0, "error").when(F.size("_w") > 0, "review").otherwise("pass").alias("status"))


def mark_repeated(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """``df`` with a boolean column: whether other rows have the same keys, nulls being equal.

    Counted with map-side combining and joined back, so that a key with a large
    share of the rows is never gathered in one task; AQE may split it in the join.
    """
    many = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n").withColumn(name, F.lit(True))
    same = [df[k].eqNullSafe(many[f"_k{i}"]) for i, k in enumerate(keys)]
    out = df.join(many, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def status_counts(report: DataFrame, *keys: str) -> DataFrame:
    return report.groupBy(*keys, "status").agg(F.count("*").alias("records"))


def duplicates(df: DataFrame, key: Column, id_col: str, name: str = "key") -> DataFrame:
    """(key, copies, first_id): keys held by several ids."""
    g = df.select(key.alias(name), F.col(id_col).alias("_i")).where(F.col(name).isNotNull()).distinct()
    return g.groupBy(name).agg(F.count("*").alias("copies"), F.min("_i").alias("first_id")).where("copies > 1")


def extractability_audit(pages: DataFrame, least: int = 20) -> DataFrame:
    """Per source: pages, those with at least ``least`` characters of text without white space at the ends, all characters, their mean a page, and whether its text can be extracted; null texts are empty."""
    p = pages.select("source_id", F.length(strip(F.coalesce("text", F.lit("")))).alias("n"))
    g = p.groupBy("source_id").agg(F.count("*").alias("pages"), F.count_if(F.col("n") >= least).alias("nonempty_pages"), F.sum("n").alias("chars"), F.bround(F.avg("n"), 1).alias("mean_chars"))
    return g.withColumn("status", X.extractability("pages", "nonempty_pages", "chars"))


def validate_boundaries(boundaries: DataFrame, pages: DataFrame) -> DataFrame:
    """Body and reference boundaries against the pages they name."""
    n = pages.groupBy("source_id").agg(F.max("pdf_page_number").alias("_n"))
    at = lambda page, name: pages.select("source_id", F.col("pdf_page_number").alias(page), F.col("text").alias(name))
    x = boundaries.join(n, "source_id", "left").join(at("body_start_page", "_start"), ["source_id", "body_start_page"], "left").join(at("reference_start_page", "_tail"), ["source_id", "reference_start_page"], "left")
    start, tail = X.marker_status(F.coalesce("_start", F.lit("")), "body_start_marker"), X.marker_status(F.coalesce("_tail", F.lit("")), "reference_start_marker")
    out = lambda c: ~F.col(c).between(1, F.col("_n"))
    rules = [
        Rule("source_missing", F.col("_n").isNull()), Rule("start_page_out_of_range", out("body_start_page")), Rule("end_page_out_of_range", out("body_end_page")), Rule("tail_page_out_of_range", out("reference_start_page")),
        Rule("start_after_end", F.col("body_start_page") > F.col("body_end_page")), Rule("tail_before_start", F.col("reference_start_page") < F.col("body_start_page")),
        Rule("start_marker_not_found", start == "not_found"), Rule("tail_marker_not_found", tail == "not_found"),
        Rule("tail_page_before_end_page", F.col("reference_start_page") < F.col("body_end_page"), True), Rule("start_marker_multiple", start == "multiple", True), Rule("tail_marker_multiple", tail == "multiple", True),
    ]
    return validate(x, rules, "source_id")


def validate_structure(nodes: DataFrame, pages: DataFrame | None = None, boundaries: DataFrame | None = None) -> DataFrame:
    """(node_id, source_id, issues, status) of structure nodes, each row by itself and against its parent, page and document body."""
    trim = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    n = nodes.withColumn("node_id", trim("node_id")).withColumn("_p", trim("parent_id")).withColumn("source_id", trim("source_id"))
    parents = n.groupBy("node_id").agg(F.max(F.struct("source_id", "level", "node_order", "node_type", "include_status")).alias("p")).select(F.col("node_id").alias("_p"), F.col("p.source_id").alias("p_source"), F.col("p.level").alias("p_level"), F.col("p.node_order").alias("p_order"), F.col("p.node_type").alias("p_type"), F.col("p.include_status").alias("p_status"))
    x = mark_repeated(mark_repeated(n, "_dup", "node_id"), "_dup_order", "source_id", "node_order").join(parents, "_p", "left")
    has = F.col("_p") != ""
    known = F.col("p_source").isNotNull()
    types, modes = ("section", "subsection", "question", "recommendation"), ("auto_text", "manual_table", "hybrid", "exclude")
    rules = [
        Rule("invalid_marker_occurrence", ~(F.coalesce("marker_occurrence", F.lit(0)) >= 1)), Rule("empty_source_id", F.col("source_id") == ""), Rule("empty_node_id", F.col("node_id") == ""), Rule("empty_marker_text", blank(F.col("marker_text"))),
        Rule("duplicate_node_id", F.col("_dup")), Rule("duplicate_order_within_source", F.col("_dup_order")), Rule("invalid_node_type", ~F.coalesce(F.col("node_type").isin(*types), F.lit(False))),
        Rule("invalid_include_status", ~F.coalesce(F.col("include_status").isin("included", "excluded"), F.lit(False))), Rule("invalid_extraction_mode", ~F.coalesce(F.col("extraction_mode").isin(*modes), F.lit(False))),
        Rule("included_node_cannot_use_extraction_mode_exclude", (F.col("include_status") == "included") & (F.col("extraction_mode") == "exclude")),
        Rule("parent_not_found", has & ~known), Rule("parent_from_different_source", has & (F.col("p_source") != F.col("source_id"))), Rule("parent_level_mismatch", has & known & ~(F.coalesce(F.col("level") == F.col("p_level") + 1, F.lit(False)))),
        Rule("parent_not_before_child", has & (F.col("p_order") >= F.col("node_order"))), Rule("recommendation_parent_is_not_question", (F.col("node_type") == "recommendation") & known & (F.col("p_type") != "question")),
        Rule("non_root_node_missing_parent", ~has & (F.col("level") > 1)), Rule("invalid_recommendation_level", (F.col("node_type") == "recommendation") & (F.col("level") < 2)),
    ]
    warnings = [
        Rule("excluded_node_should_use_extraction_mode_exclude", (F.col("include_status") == "excluded") & (F.col("extraction_mode") != "exclude"), True),
        Rule("included_child_under_excluded_parent", (F.col("include_status") == "included") & (F.col("p_status") == "excluded"), True),
        Rule("section_expected_at_level_1", (F.col("node_type") == "section") & (F.col("level") != 1), True),
    ]
    if pages is not None:
        x = x.join(pages.select("source_id", F.col("pdf_page_number").alias("pdf_page"), F.coalesce("text", F.lit("")).alias("_t")), ["source_id", "pdf_page"], "left")
        k = X.occurrences("_t", "marker_text")
        rules += [Rule("pdf_page_not_found", F.col("_t").isNull()), Rule("marker_not_found", k == 0), Rule("marker_occurrence_out_of_range", (k > 0) & (F.col("marker_occurrence") > k)), Rule("marker_occurrence_position_not_found", (k > 0) & (F.col("marker_occurrence") <= k) & (X.nth_position("_t", "marker_text", "marker_occurrence") < 0))]
        warnings.append(Rule("marker_found_multiple_without_occurrence", (k > 1) & F.col("marker_occurrence").isNull(), True))
    if boundaries is not None:
        x = x.join(boundaries.select("source_id", "body_start_page", "body_end_page"), "source_id", "left")
        outside = ~F.col("pdf_page").between(F.col("body_start_page"), F.col("body_end_page"))
        rules += [Rule("included_node_outside_document_body", (F.col("include_status") == "included") & outside), Rule("document_boundary_not_found", F.col("body_start_page").isNull())]
        warnings.append(Rule("excluded_node_outside_document_body", (F.col("include_status") == "excluded") & outside, True))
    return validate(x, rules + warnings, "node_id", "source_id")


def marker_order(located: DataFrame) -> DataFrame:
    """Nodes whose marker stands before that of the node before them on the same page."""
    w = Window.partitionBy("source_id", "pdf_page").orderBy("node_order", "node_id")
    return located.where("start_pos >= 0").withColumn("previous_pos", F.lag("start_pos").over(w)).where("previous_pos > start_pos").select("source_id", "node_id", "pdf_page", "start_pos", "previous_pos")


def validate_tables(evidence: DataFrame, nodes: DataFrame, boundaries: DataFrame, required_terms: DataFrame | None = None, sources: list[str] | None = None) -> DataFrame:
    """Manual table records against structure, document body and the terms they must contain."""
    n = nodes.select("node_id", F.col("source_id").alias("n_source"), F.col("include_status").alias("n_status"), F.col("extraction_mode").alias("n_mode"), F.col("pdf_page").alias("n_page"))
    x = evidence.withColumn("_page", F.col("pdf_page").cast("string").try_cast("int")).withColumn("_h", X.text_hash("text"))
    x = mark_repeated(mark_repeated(x, "_dup", "record_id"), "_dup_text", "_h").join(n, "node_id", "left").join(boundaries.select("source_id", "body_start_page", "body_end_page"), "source_id", "left")
    if required_terms is not None:
        x = x.join(required_terms.select("record_id", "terms"), "record_id", "left")
    rules = [
        Rule("invalid_pdf_page", ~F.coalesce(F.col("_page") >= 1, F.lit(False))), Rule("empty_record_id", blank(F.col("record_id"))), Rule("duplicate_record_id", F.col("_dup")), Rule("empty_node_id", blank(F.col("node_id"))),
        Rule("structure_node_not_found", F.col("n_source").isNull()), Rule("structure_source_mismatch", F.col("n_source") != F.col("source_id")), Rule("structure_node_not_included", F.col("n_status") != "included"), Rule("structure_node_not_manual_or_hybrid", ~F.col("n_mode").isin("manual_table", "hybrid")),
        Rule("invalid_structure_pdf_page", F.col("n_source").isNotNull() & ~F.coalesce(F.col("n_page") >= 1, F.lit(False))), Rule("document_boundary_not_found", F.col("body_start_page").isNull()), Rule("evidence_outside_document_body", ~F.col("_page").between(F.col("body_start_page"), F.col("body_end_page"))),
        Rule("evidence_not_included", F.coalesce("include_status", F.lit("")) != "included"), Rule("invalid_evidence_extraction_mode", ~F.coalesce(F.col("extraction_mode").isin("manual_table", "hybrid"), F.lit(False))), Rule("evidence_not_human_verified", F.coalesce("review_status", F.lit("")) != "human_verified"),
        Rule("invalid_record_type", blank(F.col("record_type"))), *[Rule(f"empty_{c}", blank(F.col(c))) for c in ("table_id", "table_title", "display_title", "scope", "text")], Rule("duplicate_evidence_text", F.col("_dup_text") & ~blank(F.col("text"))),
        Rule("evidence_page_differs_from_structure_start_page", F.col("_page") != F.col("n_page"), True), Rule("text_unusually_short", F.length("text") < 40, True),
    ]
    if sources:
        rules.insert(3, Rule("unexpected_source", ~F.col("source_id").isin(*sources)))
    if required_terms is not None:
        rules.insert(0, Rule("missing_required_content", ~F.forall("terms", lambda t: F.contains(F.col("text"), t))))
        rules.append(Rule("record_not_in_expectation", F.col("terms").isNull(), True))
    return validate(x, rules, "record_id", "source_id", "node_id")


def _referenced(benchmark: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per question: which referenced chunks exist, and the sources of the gold ones."""
    known = corpus.select(F.col("chunk_id").alias("_c"), F.col("source_id").alias("_s")).distinct()
    ids = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    g = benchmark.select("_row", F.explode(F.array_distinct(F.concat(ids("gold_chunk_ids"), ids("supporting_chunk_ids")))).alias("_c"), ids("gold_chunk_ids").alias("_g"))
    g = g.join(known, "_c", "left")
    return g.groupBy("_row").agg(F.count_if(F.col("_s").isNull()).alias("unknown"), F.sort_array(F.collect_set(F.when(F.array_contains("_g", F.col("_c")), F.col("_s")))).alias("gold_sources"))


def validate_benchmark(benchmark: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, issues, status) of benchmark questions; identical rows count once."""
    b = benchmark.distinct()
    b = mark_repeated(b.withColumn("_row", F.sha2(F.to_json(F.struct(*b.columns)), 256)), "_dup", "query_id")
    x = b.join(_referenced(b, corpus), "_row", "left")
    ids = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    gold, support, answerable = ids("gold_chunk_ids"), ids("supporting_chunk_ids"), F.col("answerability") == "answerable"
    domain = {"phase": ("pilot", "expansion"), "split": ("dev", "test"), "difficulty": ("easy", "medium", "hard"), "answerability": ("answerable", "unanswerable"), "evidence_scope": ("single_chunk", "multi_chunk", "no_gold")}
    expected = F.sort_array(F.array_distinct(ids("expected_source_ids")))
    sources = F.coalesce("gold_sources", F.array().cast("array<string>"))
    rules = [
        *[Rule(f"invalid_{c}", ~F.coalesce(F.col(c).isin(*v), F.lit(False))) for c, v in domain.items()], Rule("duplicate_query_id", F.col("_dup")), Rule("row_not_verified", F.coalesce("review_status", F.lit("")) != "verified"),
        *[Rule(f"empty_{c}", blank(F.col(c))) for c in ("query", "topic", "query_type")], Rule("unknown_chunk_ids", F.col("unknown") > 0), Rule("duplicate_gold_chunk_id", F.size(F.array_distinct(gold)) < F.size(gold)),
        Rule("gold_supporting_overlap", F.arrays_overlap(gold, support)), Rule("answerable_without_gold", answerable & (F.size(gold) == 0)), Rule("answerable_with_no_gold_scope", answerable & (F.col("evidence_scope") == "no_gold")),
        Rule("unanswerable_has_gold", ~answerable & (F.size(gold) > 0)), Rule("unanswerable_scope_not_no_gold", ~answerable & (F.col("evidence_scope") != "no_gold")),
        Rule("single_chunk_requires_one_gold", (F.col("evidence_scope") == "single_chunk") & (F.size(gold) != 1)), Rule("multi_chunk_requires_multiple_gold", (F.col("evidence_scope") == "multi_chunk") & (F.size(gold) < 2)),
        Rule("expected_source_mismatch", ((F.size(expected) > 0) | (F.size(sources) > 0)) & (expected != sources)), Rule("query_unusually_short", F.length(strip(F.col("query"))) < 6, True),
    ]
    return validate(x, rules, "query_id")


def benchmark_composition(benchmark: DataFrame, phase: str | None = None) -> DataFrame:
    """One row of counts that a benchmark must have minimums of before it is frozen."""
    b = (benchmark.where(F.col("phase") == phase) if phase else benchmark).distinct()
    return b.agg(
        F.count("*").alias("questions"), F.countDistinct("query_id").alias("query_ids"), F.count_if(F.col("evidence_scope") == "multi_chunk").alias("multi_chunk"), F.count_if(F.col("evidence_scope") == "no_gold").alias("no_gold"),
        F.count_if(F.size(F.array_distinct("expected_source_ids")) > 1).alias("cross_source"), F.count_if(F.col("review_status") == "verified").alias("verified"),
    )


def freeze_gate(benchmark: DataFrame, corpus: DataFrame, minimums: dict[str, int]) -> None:
    """Raises where a frozen benchmark would have an error or fall short of a minimum."""
    bad = validate_benchmark(benchmark, corpus).where("status = 'error'").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].query_id}: {bad[0].issues}")
    have = benchmark_composition(benchmark).first().asDict()
    if short := {k: (have[k], v) for k, v in minimums.items() if have[k] < v}:
        raise ValueError(f"composition below its minimums: {short}")


# What a chunk must not contain.
FORBIDDEN = {
    "reference_section": "参考文献", "workgroup_roster": "共识工作组成员名单|首席临床专家：|秘书组：", "known_layout_address": r"Kunming City,\s*Yunnan Province",
    "table_header_pollution": "表[1-7]骨关节炎(?:临床分期|口服药物治疗推荐|外用药物治疗推荐|物理治疗推荐|常见骨关节炎的临床表现)",
}


def validate_corpus(chunks: DataFrame, sources: list[str] | None = None, least: int = 30, most: int = 1800, forbidden: dict[str, str] | None = None) -> DataFrame:
    """(chunk_id, issues, status) of corpus chunks; identical rows count once."""
    c = chunks.distinct() if not any(t.startswith("map") for _, t in chunks.dtypes) else chunks
    c = mark_repeated(mark_repeated(c.withColumn("_h", X.text_hash("text")), "_dup", "chunk_id"), "_dup_text", "_h")
    c = c.withColumn("_dup_text", F.col("_dup_text") & ~blank(F.col("text")))
    rules = [
        Rule("empty_chunk_id", blank(F.col("chunk_id"))), Rule("duplicate_chunk_id", F.col("_dup")), Rule("duplicate_text", F.col("_dup_text")), Rule("missing_source", blank(F.col("source_id"))), Rule("empty_text", blank(F.col("text"))),
        Rule("citation_only", ~blank(F.col("text")) & X.citation_only("text")), *[Rule(f"forbidden_{k}", F.col("text").rlike(p)) for k, p in (FORBIDDEN if forbidden is None else forbidden).items()],
        Rule("missing_question_node", (F.col("content_type") == "question_recommendation") & blank(F.col("question_node_id"))), Rule("missing_recommendation_nodes", (F.col("content_type") == "question_recommendation") & (F.coalesce(F.size("recommendation_node_ids"), F.lit(0)) <= 0)),
        Rule("unverified_manual_table", (F.col("content_type") == "manual_table_chunk") & (F.coalesce("review_status", F.lit("")) != "human_verified")),
        Rule("short_chunk", F.length("text") < least, True), Rule("long_chunk", F.length("text") > most, True),
    ]
    if sources:
        rules.insert(4, Rule("unexpected_source", ~F.col("source_id").isin(*sources)))
    return validate(c, rules, "chunk_id")


def detection_totals(detections: DataFrame, *methods: str) -> DataFrame:
    """Per source the tables each method found, and the pages on which it found any; one row per source and page goes in."""
    aggs = [a for m in methods for a in (F.sum(F.coalesce(m, F.lit(0))).alias(f"{m}_tables"), F.sort_array(F.collect_list(F.when(F.col(m) > 0, F.col("page")))).alias(f"{m}_pages"))]
    agree = F.count_if(~F.coalesce(F.greatest(*methods) == F.least(*methods), F.lit(False))) if len(methods) > 1 else F.lit(0)
    return detections.groupBy("source_id").agg(*aggs, agree.alias("differing_pages"))
