"""Row filters and predicates of the corpus build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import strip

# Patterns on which the results depend.
LIST_ITEM = r"^(?:\d+[.、）)]|[（(][一二三四五六七八九十\d]+[）)]|[①②③④⑤⑥⑦⑧⑨⑩]|[-•])"
HEADING_ZH = r"^(?:[一二三四五六七八九十]+、\S.{0,60}|[（(][一二三四五六七八九十]+[）)]\S.{0,60}|(?:推荐意见|推荐建议|临床问题|问题)\s*\d+\S*.{0,60})$"
HEADING_EN = r"(?i)^(?:RECOMMENDATION|QUESTION)\s+\d+\S*.{0,60}$"
SECTION_START = r"^[一二三四五六七八九十]+、|^\d+(?:\.\d+)*[.、]\s*\S+|^(?:推荐意见|推荐建议|临床问题|问题)\s*\d+|^(?i:recommendation|question)\s*\d+"
SECTION_CAPITALS = r"^[A-Z][A-Z0-9 /,&():\-]+$"
SECTION_LABEL = r"^((?:推荐意见|推荐建议|临床问题|问题)\s*\d+|(?i:recommendation|question)\s*\d+)"


def included(df: DataFrame, column: str = "include_status") -> DataFrame:
    return df.where(F.lower(strip(F.col(column))) == "included")


def resolve_policy(pages: DataFrame, policy: DataFrame, exclude_pending: bool = True) -> DataFrame:
    """Pages with their chunk policy: include by default; review is exclude_pending if asked; another value is an error."""
    p = policy.select("source_id", "pdf_page_number", "chunk_policy")
    raw = F.lower(strip(F.coalesce("chunk_policy", F.lit("include"))))
    known = F.when(raw.isin("include", "exclude"), raw).when(raw == "review", "exclude_pending" if exclude_pending else "include")
    out = pages.join(p, ["source_id", "pdf_page_number"], "left")
    return out.withColumn("chunk_policy", F.coalesce(known, F.raise_error(F.concat(F.lit("unknown chunk policy: "), raw)).cast("string")))


def verified_questions(benchmark: DataFrame, scope: str = "all") -> DataFrame:
    keep = F.col("review_status") == "verified"
    return benchmark.where(keep if scope == "all" else keep & (F.col("phase") == scope))


def body_pages(pages: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Pages of each document's body, cut at its start marker and before its reference marker."""
    b = boundaries.select("source_id", "body_start_page", "body_start_marker", "reference_start_page", "reference_start_marker", "body_end_page")
    x = pages.join(b, "source_id").where("pdf_page_number >= body_start_page AND pdf_page_number <= least(coalesce(reference_start_page, body_end_page), body_end_page)")
    first, last = F.col("pdf_page_number") == F.col("body_start_page"), F.col("pdf_page_number") == F.col("reference_start_page")
    text = F.when(first & (F.length("body_start_marker") > 0), X.trim_before("text", "body_start_marker", strict=True)).otherwise(F.col("text"))
    x = x.withColumn("text", text)
    text = F.when(last & (F.length("reference_start_marker") > 0), X.trim_from("text", "reference_start_marker", strict=True)).otherwise(F.col("text"))
    return x.withColumn("text", text).drop(*[c for c in b.columns if c != "source_id"])


def is_list_item(c) -> Column:
    return strip(X.col(c)).rlike(LIST_ITEM)


def ends_sentence(c, colon: bool = False) -> Column:
    """Whether a unit ends with a closing mark; an empty one does."""
    text = F.regexp_replace(X.col(c), r"(?U)\s+$", "")
    return (text == "") | text.rlike("[。！？；.!?;：:]$" if colon else "[。！？；.!?;]$")


def is_heading(c, language) -> Column:
    """Section headings that are certain: Chinese enumerations, or English lines of up to 12 words almost all in capitals."""
    t = strip(X.col(c))
    size = F.length(t)
    zh = t.rlike(HEADING_ZH)
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    caps = (letters > 0) & (F.regexp_count(t, F.lit(r"\p{Lu}")) / F.when(letters > 0, letters) >= 0.85) & (F.size(F.split(t, r"(?U)\s+")) <= 12)
    named = t.rlike(HEADING_EN)
    possible = (size > 0) & (size <= 90) & ~t.rlike("[。；.;，,]$")
    return possible & F.when(F.lower(X.col(language)).startswith("zh"), zh).otherwise(named | F.coalesce(caps, F.lit(False)))


def starts_section(c) -> Column:
    t = strip(X.col(c))
    return t.rlike(SECTION_START) | ((F.length(t) <= 80) & t.rlike(SECTION_CAPITALS))


def section_heading(c) -> Column:
    """A short label of the section a unit starts."""
    t = strip(X.col(c))
    label = F.regexp_extract(t, SECTION_LABEL, 1)
    return F.when(label != "", label).when(F.length(t) <= 100, t).otherwise("")


def is_reference_heading(c, headings: list[str]) -> Column:
    return X.normalize_heading(c).isin([X.heading_key(h) for h in headings])


def page_number_block(c) -> Column:
    """Whether a block is nothing but a number."""
    return strip(X.col(c)).rlike(r"(?U)^\d+$")


def stop_at_references(pages: DataFrame, headings: list[str]) -> DataFrame:
    """Pages with ``status``: included, policy_excluded, or after_references for those behind a source's first page with such a heading.

    The heading is a paragraph of its own; it counts on included pages only, and being behind it comes before the policy.
    """
    is_ref = F.exists(X.paragraphs("text"), lambda p: is_reference_heading(p, headings))
    x = pages.withColumn("_ref", (F.col("chunk_policy") == "include") & F.coalesce(is_ref, F.lit(False)))
    first = x.where("_ref").groupBy("source_id").agg(F.min("pdf_page_number").alias("_first"))
    after = F.coalesce(F.col("pdf_page_number") > F.col("_first"), F.lit(False))
    x = x.join(first, "source_id", "left")
    return x.withColumn("status", F.when(after, "after_references").when(F.col("chunk_policy") != "include", "policy_excluded").otherwise("included")).drop("_ref", "_first")


def limit_rows(df: DataFrame, key: str, only: str | None = None, limit: int | None = None) -> DataFrame:
    """One key's rows, or the first ``limit`` by key."""
    df = df.where(F.col(key) == only) if only is not None else df
    return df.orderBy(key).limit(limit) if limit is not None else df
