"""Chunkers: pages prepared and cut into units, units joined and packed into chunks.

What follows the order of a document is worked out in blocks of pages: within a block
by a window, between blocks by a window over one row per block, so that no task has
to walk through a whole source.  Tables that are met by a part of themselves are
written first, else every such step would double the work before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import cut
from .filters import ends_sentence, is_heading, is_list_item, is_reference_heading, resolve_policy, section_heading, starts_section, stop_at_references

#: Pages of a source that one task walks through.
PAGES_PER_BLOCK = 64

# Patterns, marks and shares on which the chunks depend.
_ANY = re.compile(r"(?<=[。！？；.!?;])\s*")
_SPACED = re.compile(r"(?<=[。！？；])|(?<=[.!?;])\s+")
_STRONG = re.compile(r"(?s).+?(?:[。！？；!?;]+|$)")
_STRONG_MARKS = "。！？；!?;"
_CLAUSE_MARKS = "，,、：:"
_NUMBERED = re.compile(r"(?<![\d.])(?:[1-9]|1\d)\.\s*")
STRONG_FROM, CLAUSE_FROM = 0.45, 0.85
SEPARATOR = "\n\n"


def pack_with_overlap(lengths: list[int], limit: int, overlap: int, lead: Callable[[int], int] = lambda at: 0, fixed: int = 0, least_one: bool = False) -> list[tuple[int, int]]:
    """[from, to) of the units in each chunk: greedy, the trailing units of a chunk opening the next.

    Units are joined by a blank line, which counts, and ``lead`` gives what stands
    before a chunk that begins with a unit.  The last unit is taken over, and more
    while they stay within the overlap; units are given up from the front where the
    next one would not fit.  The first ``fixed`` units are never taken over; without
    an overlap none is, unless ``least_one``.  Only a unit that is too long by itself
    makes a chunk too long.
    """
    total = [0]
    for n in lengths:
        total.append(total[-1] + n + len(SEPARATOR))
    size = lambda a, b: total[b] - total[a] - len(SEPARATOR)
    out, start = [], 0
    for n in range(len(lengths)):
        if start < n and lead(start) + size(start, n + 1) > limit:
            out.append((start, n))
            back = n
            if (overlap > 0 or least_one) and n > max(start, fixed):
                back = n - 1
                while back > max(start, fixed) and size(back, n) < overlap and size(back - 1, n) <= overlap:
                    back -= 1
            while back < n and lead(back) + size(back, n + 1) > limit:
                back += 1
            start = back
    if lengths:
        out.append((start, len(lengths)))
    return out


# --- pages and their units


def prepare_pages(pages: DataFrame, registry: DataFrame, policy: DataFrame | None = None, stop_headings: tuple[str, ...] = (), exclude_pending: bool = True) -> DataFrame:
    """Pages that are chunked, with ``language`` as the registry has it.

    A page of a source that is not registered is an error; pages that the policy
    excludes and pages behind a source's first page with a stop heading are left out.
    """
    known = registry.groupBy("source_id").agg(F.max("language").alias("_language")).withColumn("_known", F.lit(True))
    x = pages.drop("language").join(known, "source_id", "left")
    x = x.where(F.coalesce("_known", F.raise_error(F.concat(F.lit("not in the registry: "), F.coalesce("source_id", F.lit("null")))).cast("boolean")))
    x = x.withColumn("language", F.coalesce("_language", F.lit(""))).drop("_language", "_known")
    empty = pages.sparkSession.createDataFrame([], "source_id string, pdf_page_number int, chunk_policy string")
    x = resolve_policy(x, empty if policy is None else policy, exclude_pending)
    return stop_at_references(x, list(stop_headings)).where("status = 'included'").drop("status", "chunk_policy")


def apply_page_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Page texts after the trim rules of their page, in order.

    ``rules`` has source_id, pdf_page_number, rule_order, action and marker;
    trim_before keeps what follows from the first marker on, trim_after what stands
    before it; a marker that is absent changes nothing, another action is an error.
    """
    action = F.lower(X.strip(F.col("action")))
    checked = F.when(action.isin("trim_before", "trim_after"), action).otherwise(F.raise_error(F.concat(F.lit("unknown cleanup action: "), action)).cast("string"))
    by_page = rules.groupBy("source_id", "pdf_page_number").agg(F.array_sort(F.collect_list(F.struct("rule_order", checked.alias("action"), X.strip(F.col("marker")).alias("marker")))).alias("_rules"))

    def step(text: Column, rule: Column) -> Column:
        at = F.instr(text, rule["marker"])
        return F.when((at == 0) | (rule["marker"] == ""), text).when(rule["action"] == "trim_before", F.substr(text, at)).otherwise(F.substr(text, F.lit(1), at - 1))

    x = pages.join(by_page, ["source_id", "pdf_page_number"], "left")
    return x.withColumn("text", F.when(F.col("_rules").isNull(), F.col("text")).otherwise(X.strip(F.aggregate("_rules", F.col("text"), step)))).drop("_rules")


def page_units(pages: DataFrame, stop_headings: tuple[str, ...] = (), clean: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(source_id, language, page, seq, text, follows): paragraphs of pages in reading order, up to a stop heading.

    ``follows`` says that the page before is there too, be it empty; ``clean`` maps a
    paragraph and its source to what is left of it.
    """
    found = X.paragraphs("text")
    if stop_headings:
        stop = lambda p: F.array_position(F.transform(p, lambda t: F.coalesce(is_reference_heading(t, list(stop_headings)), F.lit(False))), True).cast("int")
        # As an element of an array the paragraphs have a name, so they are found once and not once for every use.
        found = F.transform(F.array(found), lambda p: F.transform(F.array(stop(p)), lambda k: F.when(k > 0, F.slice(p, F.lit(1), k - 1)).otherwise(p))[0])[0]
    x = pages.select("source_id", "language", F.col("pdf_page_number").alias("page"), "text")
    there = x.select("source_id", (F.col("page") + 1).alias("page")).distinct().withColumn("follows", F.lit(True))
    x = x.join(there, ["source_id", "page"], "left").select("source_id", "language", "page", F.coalesce("follows", F.lit(False)).alias("follows"), found.alias("p"))
    x = x.select("source_id", "language", "page", "follows", F.posexplode("p").alias("seq", "text")).withColumn("text", X.normalize_paragraph("text"))
    x = x.withColumn("text", clean(F.col("text"), F.col("source_id"))) if clean else x
    return x.where("text <> ''").select("source_id", "language", "page", "seq", "text", "follows")


# --- running through a document in blocks


def _blocks(df: DataFrame, page: str) -> DataFrame:
    return df.withColumn("block", F.floor(F.col(page) / PAGES_PER_BLOCK).cast("int"))


def with_previous(df: DataFrame, page: str, order: list[str], columns: list[str]) -> DataFrame:
    """``df`` with ``prev``, a struct of the columns of the row before in its source, null for the first."""
    x = _blocks(df, page)
    row = F.struct(*columns)
    x = x.withColumn("_own", F.lag(row).over(Window.partitionBy("source_id", "block").orderBy(*order)))
    last = x.groupBy("source_id", "block").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    # One row per block: what the next block's first row has before it.
    carry = last.select("source_id", F.lead("block").over(Window.partitionBy("source_id").orderBy("block")).alias("block"), "_last").where("block IS NOT NULL")
    return x.join(carry, ["source_id", "block"], "left").withColumn("prev", F.coalesce("_own", "_last")).drop("_own", "_last", "block")


def with_running_sum(df: DataFrame, page: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` from its source's first row to each row."""
    x = _blocks(df.withColumn("_v", value.cast("long")), page)
    x = x.withColumn("_here", F.sum("_v").over(Window.partitionBy("source_id", "block").orderBy(*order)))
    per = x.groupBy("source_id", "block").agg(F.sum("_v").alias("_sum"))
    before = per.select("source_id", "block", F.sum("_sum").over(Window.partitionBy("source_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    return x.join(before, ["source_id", "block"], "left").withColumn(name, F.col("_here") + F.coalesce("_before", F.lit(0))).drop("_v", "_here", "_before", "block")


def merge_islands(units: DataFrame, join: Column, hyphens: bool) -> DataFrame:
    """Units joined into islands: ``join`` says of a unit, which has ``prev``, that it goes on from the one before.

    A running count of the breaks numbers the islands.  Chinese texts are joined
    without anything, others by a blank, or, with ``hyphens``, by dropping a hyphen
    that the first one ends with.
    """
    x = with_running_sum(units.withColumn("_j", F.coalesce(join, F.lit(False))), "page", ["page", "seq"], ~F.col("_j"), "island")
    parts = F.array_sort(F.collect_list(F.struct("page", "seq", "text")))
    keep = [c for c in ("is_heading",) if c in units.columns]
    g = x.groupBy("source_id", "island").agg(
        F.transform(parts, lambda u: u["text"]).alias("p"), F.max("language").alias("language"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), *[F.max(c).alias(c) for c in keep])
    chinese = F.lower("language").startswith("zh")

    def piece(t: Column, after: Column) -> Column:
        divided = t.endswith("-") if hyphens else F.lit(False)
        return F.when(after.isNull() | chinese, t).when(divided, F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(F.concat(t, F.lit(" ")))

    text = F.array_join(F.zip_with("p", F.slice("p", 2, F.size("p")), piece), "")
    return g.select("source_id", "language", "island", "page_start", "page_end", *keep, (X.normalize_paragraph(text) if hyphens else text).alias("text"))


def cross_page_merge(units: DataFrame) -> DataFrame:
    """The first unit of a page joined to the last one before, where the page before is there, that unit is unfinished and this one starts no section."""
    x = with_previous(cut(units), "page", ["page", "seq"], ["page", "text"])
    first = F.col("prev.page") < F.col("page")
    return merge_islands(x, first & F.col("follows") & ~ends_sentence("prev.text", colon=True) & ~starts_section("text"), hyphens=False)


def fragment_merge(units: DataFrame) -> DataFrame:
    """Any unit joined to the one before on the same page, or on an earlier one if the page before is there, unless either is a heading, that one is finished or this one is a list item."""
    x = with_previous(cut(units.withColumn("is_heading", is_heading("text", "language"))), "page", ["page", "seq"], ["page", "text", "is_heading"])
    near = F.col("follows") | (F.col("prev.page") == F.col("page"))
    return merge_islands(x, near & ~F.col("is_heading") & ~F.col("prev.is_heading") & ~ends_sentence("prev.text") & ~is_list_item("text"), hyphens=True)


def carry_sections(units: DataFrame) -> DataFrame:
    """Islands with their section's number, from 1, and its heading; a unit that starts a section, or a source, begins one."""
    begins = (F.col("island") == 1) | starts_section("text")
    x = cut(with_running_sum(cut(units.withColumn("begins", begins)), "page_start", ["page_start", "island"], F.col("begins"), "section_no"))
    heads = x.where("begins").select("source_id", "section_no", F.when(starts_section("text"), section_heading("text")).otherwise("").alias("heading"))
    return x.drop("begins").join(heads, ["source_id", "section_no"])


# --- folds


def _fold(df: DataFrame, keys: list[str], fold, schema: str) -> DataFrame:
    """Applies a fold to the ordered units of each group as one array, so that no group is shuffled twice."""
    flag = F.col("is_heading") if "is_heading" in df.columns else F.lit(False)
    units = F.array_sort(F.collect_list(F.struct("island", "text", "page_start", "page_end", "heading", flag.alias("is_heading"))))
    udf = F.pandas_udf(lambda s: s.map(lambda us: fold(list(us))), schema)
    return df.groupBy(*keys).agg(units.alias("u")).select(*keys, F.posexplode(udf("u")).alias("i", "c")).select(*keys, "i", "c.*")


_CHUNK = "array<struct<text string, page_start int, page_end int, heading string>>"


def _atoms(units: list[dict]) -> Iterator[tuple[str, dict]]:
    """Sentences of units with their unit; a heading is one."""
    for u in units:
        for s in [u["text"]] if u["is_heading"] else _SPACED.split(u["text"]):
            if s and s.strip():
                yield s.strip(), u


def _chunk(atoms: list[tuple[str, dict]], heading: str, lead: str = "") -> dict:
    return {"text": lead + SEPARATOR.join(t for t, _ in atoms), "page_start": min(u["page_start"] for _, u in atoms), "page_end": max(u["page_end"] for _, u in atoms), "heading": heading}


def section_fold(units: list[dict], limit: int, overlap: int) -> list[dict]:
    """Chunks of one section: sentences packed with overlap, the heading, which counts, repeated where the text does not start with it."""
    atoms = list(_atoms(units))
    head = units[0]["heading"] if units else ""
    bare = [not head or t.startswith(head) for t, _ in atoms]
    lead = lambda at: 0 if bare[at] else len(head) + len(SEPARATOR)
    return [_chunk(atoms[a:b], head, "" if bare[a] else head + SEPARATOR) for a, b in pack_with_overlap([len(t) for t, _ in atoms], limit, overlap, lead, least_one=True)]


def section_chunks(pages: DataFrame, limit: int = 1200, overlap: int = 120, stop_headings: tuple[str, ...] = ()) -> DataFrame:
    """Section-aware chunks of prepared pages; numbers run over the whole source."""
    units = carry_sections(cross_page_merge(page_units(pages, stop_headings)))
    x = cut(_fold(units, ["source_id", "section_no"], lambda us: section_fold(us, limit, overlap), _CHUNK))
    per = x.groupBy("source_id", "section_no").agg(F.count("*").alias("n"))
    before = per.select("source_id", "section_no", F.coalesce(F.sum("n").over(Window.partitionBy("source_id").orderBy("section_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    x = x.join(before, ["source_id", "section_no"])
    chunk_id = F.format_string("%s-S%03d-C%03d", "source_id", "section_no", F.col("before") + F.col("i") + 1)
    return x.select("source_id", "section_no", chunk_id.alias("chunk_id"), "heading", "page_start", "page_end", "text", F.length("text").alias("char_count"))


def boundary_fold(units: list[dict], limit: int, least: int, overlap: int) -> list[dict]:
    """Chunks of units under one heading: a heading starts a chunk, overlap never reaches over one, a short chunk joins the one before where both fit."""
    runs: list[list[tuple[str, dict]]] = [[]]
    for t, u in _atoms(units):
        if u["is_heading"] and runs[-1]:
            runs.append([])
        runs[-1].append((t, u))
    out: list[dict] = []
    for run in filter(None, runs):
        headed = run[0][1]["is_heading"]
        for a, b in pack_with_overlap([len(t) for t, _ in run], limit, overlap, fixed=int(headed)):
            c = _chunk(run[a:b], run[0][1]["heading"])
            joined = out[-1]["text"] + SEPARATOR + c["text"] if out and len(c["text"]) < least else ""
            if joined and len(joined) <= limit:
                out[-1] |= {"text": joined, "page_end": max(out[-1]["page_end"], c["page_end"])}
            else:
                out.append(c)
    return out


def boundary_chunks(pages: DataFrame, limit: int = 1000, least: int = 250, overlap: int = 100, numbered_sources: tuple[str, ...] = ()) -> DataFrame:
    """Boundary-aware chunks of prepared pages: one fold per run of units under equal headings, numbered over the whole source."""
    units = page_units(pages, clean=lambda text, source: X.strip_residual_numbers(text, source, list(numbered_sources)))
    order = ["page_start", "island"]
    merged = cut(with_running_sum(cut(fragment_merge(units)), "page_start", order, F.col("is_heading"), "run"))
    # Runs whose headings are equal and adjacent are one group, as short chunks may join across them.
    heads = merged.where("is_heading").select("source_id", "run", F.col("text").alias("heading"))
    w = Window.partitionBy("source_id").orderBy("run")
    heads = heads.withColumn("part", F.sum((F.coalesce(F.lag("heading").over(w), F.lit("")) != F.col("heading")).cast("long")).over(w))
    merged = merged.join(heads, ["source_id", "run"], "left").withColumn("part", F.coalesce("part", F.lit(0))).withColumn("heading", F.coalesce("heading", F.lit("")))
    x = cut(_fold(merged, ["source_id", "part"], lambda us: boundary_fold(us, limit, least, overlap), _CHUNK))
    per = x.groupBy("source_id", "part").agg(F.count("*").alias("n"))
    before = per.select("source_id", "part", F.coalesce(F.sum("n").over(Window.partitionBy("source_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    x = x.join(before, ["source_id", "part"])
    return x.select("source_id", F.format_string("%s-B%03d", "source_id", F.col("before") + F.col("i") + 1).alias("chunk_id"), "heading", "page_start", "page_end", "text", F.length("text").alias("char_count"))


def baseline_units(text: str, limit: int, stop_headings: frozenset[str] = frozenset()) -> list[str]:
    """Paragraphs of a page up to a stop heading; those above the limit as sentences, those as slices."""
    out: list[str] = []
    for p in re.split(r"\n\s*\n", text.replace("\u00a0", " ").replace("\u3000", " ")):
        p = re.sub(r"[ \t]+", " ", p).strip()
        if p and X.heading_key(p) in stop_headings:
            break
        pieces = [p] if len(p) <= limit else [s.strip() for s in _ANY.split(p)]
        out += [x for s in pieces for i in range(0, len(s), limit) if (x := s[i : i + limit].strip())]
    return out


def baseline_chunks(pages: DataFrame, limit: int = 900, overlap: int = 150, stop_headings: tuple[str, ...] = ()) -> DataFrame:
    """(source_id, page, chunk_id, chunk_no, text, char_count): page-local chunks; null and blank pages have none."""
    if overlap >= limit:
        raise ValueError("the overlap must be below the limit")
    stops = frozenset(map(X.heading_key, stop_headings))

    @F.pandas_udf("array<string>")
    def chunks(text: pd.Series) -> pd.Series:
        def one(t):
            units = baseline_units(t or "", limit, stops)
            return [SEPARATOR.join(units[a:b]) for a, b in pack_with_overlap([len(u) for u in units], limit, overlap)]

        return text.map(one)

    x = pages.select("source_id", F.col("pdf_page_number").alias("page"), F.posexplode(chunks("text")).alias("i", "text"))
    chunk_id = F.format_string("%s-P%03d-C%02d", "source_id", "page", F.col("i") + 1)
    return x.select("source_id", "page", chunk_id.alias("chunk_id"), (F.col("i") + 1).alias("chunk_no"), "text", F.length("text").alias("char_count"))


# --- sentences packed without overlap


def _cuts(text: str, limit: int, overflow: int) -> Iterator[int]:
    """Where a text above the limit may be cut, the best place first; the last one is always there."""
    window = text[: limit + 1]
    strong = max(map(window.rfind, _STRONG_MARKS))
    if strong >= int(STRONG_FROM * limit):
        yield strong + 1
    beyond = [p for m in _STRONG_MARKS if (p := text.find(m, limit, limit + overflow + 1)) >= 0]
    if beyond:
        yield min(beyond) + 1
    yield from [m.start() for m in _NUMBERED.finditer(window) if m.start() >= int(STRONG_FROM * limit)][-1:]
    clause = max(map(window.rfind, _CLAUSE_MARKS))
    if clause >= int(CLAUSE_FROM * limit):
        yield clause + 1
    yield limit


def cut_long(text: str, limit: int, overflow: int) -> list[str]:
    """Pieces of a sentence above the limit: at the last strong mark from 45 %, the next within the overflow, a list number, the last clause mark from 85 %, or the limit."""
    out, text = [], text.strip()
    while len(text) > limit:
        at = next(_cuts(text, limit, overflow))
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [x for x in [*out, text] if x]


def pack_sentences(text: str, target: int, limit: int, least: int, overflow: int) -> list[str]:
    """Sentences packed without separator: flushed at a strong mark from the target on, and where limit plus overflow would be passed; a short tail joins its predecessor."""
    if len(text) <= limit:
        return [text] if text else []
    units = [p for s in map(str.strip, _STRONG.findall(text)) if s for p in (cut_long(s, limit, overflow) if len(s) > limit else [s])]
    out, current = [], ""
    for u in units:
        if current and len(current) + len(u) > limit + overflow:
            out.append(current)
            current = ""
        current += u
        if len(current) >= target and current[-1] in _STRONG_MARKS:
            out.append(current)
            current = ""
    if current:
        out.append(current)
    if len(out) > 1 and len(out[-1]) < least and len(out[-2]) + len(out[-1]) <= limit + overflow:
        out[-2:] = [out[-2] + out[-1]]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def pack(text: pd.Series, target: pd.Series, limit: pd.Series, least: pd.Series, overflow: pd.Series) -> pd.Series:
    """pack_sentences over columns."""
    return pd.Series([pack_sentences(t or "", *map(int, sizes)) for t, *sizes in zip(text, target, limit, least, overflow)])


def chunk_statistics(chunks: DataFrame, *keys: str, chars: str = "char_count", least: int = 120) -> DataFrame:
    """Per group: number, shortest, exact median, mean and longest, those across pages and those below the least length."""
    across = F.count_if(F.col("page_end") > F.col("page_start")) if {"page_start", "page_end"} <= set(chunks.columns) else F.lit(0)
    return chunks.groupBy(*keys).agg(
        F.count("*").alias("chunks"), F.min(chars).alias("min_chars"), F.bround(F.median(chars), 1).alias("median_chars"), F.bround(F.avg(chars), 1).alias("mean_chars"), F.max(chars).alias("max_chars"),
        across.alias("cross_page"), F.count_if(F.col(chars) < least).alias("below_minimum"),
    )
