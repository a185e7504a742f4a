"""Splitting oversized sections at natural boundaries (problem 3).

A separator hierarchy of unit, paragraph, sentence, line, word and character: a
stretch above the limit is divided at its highest separators, and what is still
above it at the next ones, until every atom fits.  Atoms are packed greedily; each
piece after the first begins with the end of its predecessor, of about the wished
length and itself beginning at the highest boundary near that length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table
from . import canon
from .sentences import sentence_ends

#: The overlap may fall short of or exceed what is wished by this share, to begin at a boundary.
OVERLAP_SLACK = 0.4
_LINE = re.compile(r"\n")
_PARAGRAPH = re.compile(r"\n\s*\n")
_WORD_START = re.compile(r"(?<=\s)(?=\S)|(?<=[，。；：、！？,;])(?=\S)")


def _cuts(text: str, units: list[int], level: int, a: int, b: int) -> list[int]:
    """Positions inside (a, b) at which the separators of a level cut."""
    if level == 0:
        return [u for u in units if a < u < b]
    if level == 1:
        return [m.end() for m in _PARAGRAPH.finditer(text, a, b) if a < m.end() < b]
    if level == 2:
        return [a + e for e in sentence_ends(text[a:b])][:-1]
    if level == 3:
        return [m.end() for m in _LINE.finditer(text, a, b) if m.end() < b]
    return [m.start() for m in _WORD_START.finditer(text, a, b) if a < m.start() < b]


def _atoms(text: str, units: list[int], limit: int, a: int, b: int, level: int = 0) -> list[tuple[int, int]]:
    if b - a <= limit:
        return [(a, b)]
    if level == 5:
        return [(i, min(i + limit, b)) for i in range(a, b, limit)]
    edges = [a, *_cuts(text, units, level, a, b), b]
    return [x for p, q in zip(edges, edges[1:]) for x in _atoms(text, units, limit, p, q, level + 1)]


def _overlap_start(text: str, units: list[int], start: int, end: int, wish: int, most: int) -> int:
    """Where a piece that follows [start, end) begins: a boundary near ``wish`` characters before the end."""
    if wish <= 0 or most <= 0:
        return end
    lo, hi = max(start + 1, end - min(most, int(wish * (1 + OVERLAP_SLACK)))), max(start + 1, end - int(wish * (1 - OVERLAP_SLACK)))
    if lo > hi:
        return max(start + 1, end - min(wish, most))
    aim = end - wish
    for level in range(5):
        inside = [c for c in _cuts(text, units, level, max(start, lo - 400), end) if lo <= c <= hi]
        if inside:
            return min(inside, key=lambda c: (abs(c - aim), c))
    return max(lo, min(aim, hi))


def split_text(text: str, units: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of the pieces of a text above the limit; ``units`` are positions at which units begin.

    Every piece is at most ``limit`` long, pieces cover the text in order, and each
    begins inside its predecessor unless the overlap is 0.
    """
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit // 2))
    room = limit - int(overlap * (1 + OVERLAP_SLACK)) if overlap else limit
    room = max(1, room, limit // 4)
    atoms = _atoms(text, units, room, 0, len(text))
    out, start, end = [], 0, 0
    for a, b in atoms:
        if b - start > limit and end > start:
            out.append((start, end))
            start = _overlap_start(text, units, start, end, overlap, limit - (b - a))
        end = b
    out.append((start, end))
    return out


def split_sections(sections: DataFrame, config: DataFrame) -> DataFrame:
    """(section_id, size, max_chars, unit_sizes, pieces) of each section above its limit.

    ``sections`` has section_id, corpus_version and units (array of structs with
    text); ``config`` has corpus_version, max_chars and overlap_chars.  A section's
    text is its unit texts joined by one line feed, a null text as an empty one;
    ``pieces`` are structs of start, end and text.  Null or empty unit lists have
    size 0; a section without a config row, or with a null limit, has no limit and
    no row; a limit below 1 counts as 1; repeated rows count once; other columns
    are ignored; an empty table gives no rows.  Sizes are found JVM-side, and only
    sections above their limit are handed to Python, one row each.
    """
    limits = config.select("corpus_version", F.col("max_chars").alias("limit"), F.coalesce("overlap_chars", F.lit(0)).alias("overlap")).distinct()
    rows = sections.select("section_id", "corpus_version", F.expr("transform(units, u -> coalesce(u.text, ''))").alias("texts"))
    rows = rows.join(limits, "corpus_version").where("limit IS NOT NULL")
    rows = rows.withColumn("unit_sizes", F.expr("transform(texts, t -> length(t))"))
    rows = rows.withColumn("size", F.expr("aggregate(unit_sizes, 0L, (a, x) -> a + x) + greatest(size(unit_sizes) - 1, 0)"))
    big = rows.where(F.col("size") > F.greatest(F.col("limit"), F.lit(1))).select("section_id", "size", "limit", "overlap", "unit_sizes", "texts")
    setup = canon.tables()
    piece = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon.install(setup)
        for b in batches:
            out = []
            for texts, limit, overlap in zip(b.column("texts").to_pylist(), b.column("limit").to_pylist(), b.column("overlap").to_pylist()):
                text, units, at = "\n".join(texts), [], 0
                for t in texts:
                    units.append(at)
                    at += len(t) + 1
                out.append([{"start": s, "end": e, "text": text[s:e]} for s, e in split_text(text, units, limit, overlap)])
            yield pa.RecordBatch.from_arrays([b.column("section_id"), b.column("size"), b.column("limit"), b.column("unit_sizes"), pa.array(out, piece)], names=["section_id", "size", "max_chars", "unit_sizes", "pieces"])

    schema = "size bigint, max_chars int, unit_sizes array<int>, pieces array<struct<start int, end int, text string>>"
    return big.mapInArrow(run, T.StructType([big.schema["section_id"], *T._parse_datatype_string(schema).fields]))


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sections(table(spark, sf_dir, "section_drafts"), table(spark, sf_dir, "chunk_config"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that had to be cut (unit_no -1), and units that had to be cut.

    A section that was cut is above its limit.  A unit above the limit lies in no
    piece as a whole, and one within the limit may still have been cut to leave room
    for the overlap, so units that are in no piece are measured against the limit.
    """
    starts = F.expr("transform(unit_sizes, (n, i) -> aggregate(slice(unit_sizes, 1, i), i, (a, x) -> a + x))")
    broken = F.expr("transform(filter(transform(unit_sizes, (n, i) -> struct(n, i, starts[i] as at)), u -> u.n > max_chars and not exists(pieces, p -> p.start <= u.at and u.at + u.n <= p.end)), u -> u.i)")
    cut = _oversized(spark, sf_dir).where(F.size("pieces") > 1).withColumn("starts", starts)
    return cut.select("section_id", F.explode(F.concat(F.array(F.lit(-1)), broken)).alias("unit_no")).distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section_id, piece_no, start, end, text) of the pieces of every section above its limit."""
    cut = _oversized(spark, sf_dir).select("section_id", F.posexplode("pieces").alias("piece_no", "p"))
    return cut.select("section_id", "piece_no", F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.col("p.text").alias("text")).distinct()


P3_FOUND_SQL = """
WITH s AS (SELECT DISTINCT d.section_id, c.max_chars, d.units FROM section_drafts d JOIN chunk_config c ON d.corpus_version = c.corpus_version WHERE c.max_chars IS NOT NULL),
sizes AS (SELECT section_id, max_chars, list_transform(units, lambda u: length(coalesce(u.text, ''))) AS n FROM s),
whole AS (SELECT section_id, -1 AS unit_no FROM sizes WHERE list_sum(n) + len(n) - 1 > max_chars),
parts AS (SELECT section_id, max_chars, unnest(n) AS n, generate_subscripts(n, 1) - 1 AS i FROM sizes)
SELECT DISTINCT section_id, CAST(unit_no AS INTEGER) AS unit_no FROM (SELECT * FROM whole UNION ALL SELECT section_id, i FROM parts WHERE n > max_chars)
"""
