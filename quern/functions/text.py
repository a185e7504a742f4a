"""Scalar text functions as Column expressions; a vectorised UDF only where the JVM has no operator.

White space and digits are Unicode's everywhere, lengths are code points, and null
gives null unless a function says otherwise.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import strip

CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
#: The same with the hexagrams between them, as the compacting and citation rules have it.
CJK_BLOCKS = r"\x{3400}-\x{9fff}"
#: Line separators as str.splitlines knows them.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines(c) -> Column:
    return F.split(col(c), LINE_BREAK)


def squeeze(c) -> Column:
    """All white space runs to one blank, ends stripped."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def margin_signature(c) -> Column:
    """What a repeated margin line has in common: squeezed, lower case, each number as #."""
    return F.regexp_replace(F.lower(squeeze(c)), r"(?U)\d+", "#")


def strip_line_numbers(c) -> Column:
    """Non-blank lines without white space at their ends; numbers of up to three digits off the line starts, if at least half of the lines have one."""
    numbered = r"(?U)^\s*\d{1,3}\s+(?=\S)"
    full = F.filter(F.transform(lines(c), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), lambda x: x != "")
    hits = F.size(F.filter(full, lambda x: x.rlike(numbered)))
    cleaned = F.filter(F.transform(full, lambda x: strip(F.regexp_replace(x, numbered, ""))), lambda x: x != "")
    return F.array_join(F.when(hits * 2 >= F.size(full), cleaned).otherwise(full), "\n")


def join_wrapped_lines(c, language) -> Column:
    """Lines of a paragraph as one: in Chinese nothing around ideographs and inside marks, otherwise one blank except before closing marks; English words divided by a hyphen rejoined.

    What comes between two lines depends on these two only, so each is met by its
    successor once and nothing is folded.
    """
    parts = F.filter(F.transform(lines(c), squeeze), lambda x: x != "")
    chinese, english = (F.lower(col(language)).startswith(x) for x in ("zh", "en"))

    def piece(x: Column, after: Column) -> Column:
        rejoin = english & x.endswith("-") & after.rlike(r"^\p{L}")
        tight = F.when(chinese, x.rlike(f"[{CJK}（《【]$") | after.rlike(f"^[{CJK}，。；：！？、）》】]")).otherwise(after.rlike(r"^[,.;:!?)\]}]"))
        return F.when(after.isNull(), x).when(rejoin, F.substr(x, F.lit(1), F.length(x) - 1)).when(tight, x).otherwise(F.concat(x, F.lit(" ")))

    return squeeze(F.array_join(F.zip_with(parts, F.slice(parts, 2, F.size(parts)), piece), ""))


def paragraphs(c) -> Column:
    """Paragraphs between blank lines; no-break and ideographic blanks are blanks, runs of them one."""
    text = F.regexp_replace(F.regexp_replace(col(c), r"[\x{a0}\x{3000}]", " "), r"[ \t]+", " ")
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda x: x != "")


def normalize_paragraph(c) -> Column:
    return squeeze(F.translate(col(c), " 　", "  "))


def one_line(c) -> Column:
    """CR LF to LF, no-break blanks to blanks, each line squeezed, non-empty lines joined by a blank."""
    text = F.translate(F.regexp_replace(col(c), "\r\n?", "\n"), " 　", "  ")
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), squeeze), lambda x: x != ""), " ")


def compact_cjk(c) -> Column:
    """No blanks between ideographs, before closing or after opening marks of Chinese text; all other white space one blank."""
    text = F.regexp_replace(col(c), rf"(?U)(?<=[{CJK_BLOCKS}])\s+(?=[{CJK_BLOCKS}])", "")
    text = F.regexp_replace(text, r"(?U)\s+(?=[，。；：、！？、）】])", "")
    return squeeze(F.regexp_replace(text, r"(?U)(?<=[（【])\s+", ""))


def normalize_heading(c) -> Column:
    """Headings for exact comparison: no white space, lower case, no leading enumerator, no colon around."""
    text = F.lower(F.regexp_replace(col(c), r"(?U)\s+", ""))
    text = F.regexp_replace(text, r"^(?:[一二三四五六七八九十.、（）()]|\p{Nd})+", "")
    return F.regexp_replace(text, "^[：:]+|[：:]+$", "")


def heading_key(text: str) -> str:
    """normalize_heading of a text on the driver."""
    return re.sub(r"^[一二三四五六七八九十\d.、（）()]+", "", re.sub(r"\s+", "", text).lower()).strip("：:")


def strip_preprint_numbers(c, source, numbered_sources: list[str]) -> Column:
    """Of the sources that are printed with line numbers: lines that are only a number, and numbers before Latin text at line starts."""
    text = F.regexp_replace(col(c), r"(?Umd)^\s*\d{1,4}\s*$", "")
    text = F.regexp_replace(text, r"(?Umd)^\s*\d{1,4}\s+(?=[A-Za-z])", "")
    return F.when(col(source).isin(numbered_sources), text).otherwise(col(c))


def strip_residual_numbers(c, source, numbered_sources: list[str]) -> Column:
    """A paragraph that is only a number becomes empty; of the numbered sources also a number before Latin text or behind a heading in capitals goes."""
    text = strip(col(c))
    bare = F.regexp_replace(text, r"(?U)^\d{1,4}\s+(?=[A-Za-z])", "")
    heading = F.regexp_extract(bare, r"(?U)^([A-Z][A-Z0-9 /,&()\-]{2,70})\s+\d{1,4}$", 1)
    numbered = F.when(heading != "", strip(heading)).otherwise(bare)
    return F.when(text.rlike(r"(?U)^\d{1,4}$"), "").when(col(source).isin(numbered_sources), numbered).otherwise(text)


def trim_before(c, marker, strict: bool = False) -> Column:
    """From the first marker on; the text as it is, or an error if strict, where the marker is absent."""
    at = F.instr(col(c), col(marker))
    missing = F.raise_error(F.concat(F.lit("marker not found: "), col(marker))).cast("string") if strict else col(c)
    return F.when(at > 0, F.substr(col(c), at)).otherwise(missing)


def trim_from(c, marker, strict: bool = False) -> Column:
    """What stands before the first marker."""
    at = F.instr(col(c), col(marker))
    missing = F.raise_error(F.concat(F.lit("marker not found: "), col(marker))).cast("string") if strict else col(c)
    return F.when(at > 0, F.substr(col(c), F.lit(1), at - 1)).otherwise(missing)


def trim_after(c, marker, keep_marker: bool = True) -> Column:
    at = F.instr(col(c), col(marker))
    return F.when(at > 0, F.substr(col(c), F.lit(1), at - 1 + (F.length(col(marker)) if keep_marker else 0))).otherwise(col(c))


def sentences_any(c) -> Column:
    """Cut behind every closing mark, white space after it dropped."""
    return F.filter(F.transform(F.split(col(c), r"(?<=[。！？；.!?;])\s*"), strip), lambda x: x != "")


def sentences_spaced(c) -> Column:
    """Cut behind full-width marks, and behind ASCII marks that white space follows."""
    return F.filter(F.transform(F.split(col(c), r"(?<=[。！？；])|(?<=[.!?;])\s+"), strip), lambda x: x != "")


def sentences_strong(c) -> Column:
    """Stretches up to strong marks; the ASCII full stop is none."""
    return F.filter(F.transform(F.regexp_extract_all(col(c), F.lit(r"(?s).+?(?:[。！？；!?;]+|$)"), F.lit(0)), strip), lambda x: x != "")


def hard_slices(c, size: int) -> Column:
    """Slices of ``size`` characters."""
    n = F.ceil(F.length(col(c)) / size).cast("int")
    return F.when(F.length(col(c)) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(col(c), i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def citation_only(c) -> Column:
    """Whether fewer than four letters, digits or ideographs are left without bracketed citations."""
    text = F.regexp_replace(col(c), r"［[^］]{1,30}］|\[[^\]]{1,30}\]", "")
    return F.length(F.regexp_replace(text, rf"[^A-Za-z0-9{CJK_BLOCKS}]+", "")) < 4


# Fixed value: what a search token is.
TOKEN = r"[\x{4e00}-\x{9fff}]+|[a-z0-9]+(?:[._/-][a-z0-9]+)*"


def raw_hash(c) -> Column:
    return F.sha2(col(c), 256)


def text_hash(c) -> Column:
    """Hash that white space does not change."""
    return F.sha2(squeeze(c), 256)


def markdown_separators(c) -> Column:
    """Lines that separate a Markdown table's head from its rows."""
    return F.size(F.filter(lines(c), lambda x: x.rlike(r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$")))


def extractability(pages, nonempty, chars) -> Column:
    """Whether a document's text can be extracted, from its pages, those with text, and all characters."""
    n = F.when(col(pages) > 0, col(pages))
    bad = (col(chars) < 500) | (col(nonempty) / n < 0.30)
    weak = (col(chars) / n < 200) | (col(nonempty) / n < 0.70)
    return F.when(n.isNull(), "invalid").when(bad, "ocr_required").when(weak, "partial").otherwise("ok")


def dense_text(retrieval_text, title_path, display_title, text) -> Column:
    """The text to embed: retrieval_text unless blank, else the non-empty other fields, one a line."""
    some = lambda c: F.when(strip(col(c)) != "", strip(col(c)))
    path = F.array_join(col(title_path), " > ")
    return F.coalesce(some(retrieval_text), F.concat_ws("\n", some(path), some(display_title), some(text)))


def retrieval_text(topic, title_path, text) -> Column:
    some = lambda c: F.when(strip(col(c)) != "", col(c))
    path = F.array_join(col(title_path), " > ")
    return F.concat_ws("\n", F.concat(F.lit("主题："), some(topic)), F.concat(F.lit("章节："), some(path)), some(text))


# Answers that say the evidence does not suffice.
INSUFFICIENT = ["证据不足", "证据中未", "现有证据.*不足", "无法.*回答", "无法明确", "不能.*回答", "未明确", "未提及"]


def says_insufficient(c) -> Column:
    return F.coalesce(col(c).rlike("|".join(INSUFFICIENT)), F.lit(False))


def occurrences(c, marker) -> Column:
    """Non-overlapping occurrences of a marker; an empty marker has none."""
    m = col(marker)
    n = F.length(m)
    return F.when(n > 0, ((F.length(col(c)) - F.length(F.replace(col(c), m, F.lit("")))) / n).cast("int")).otherwise(F.lit(0))


def nth_position(c, marker, n) -> Column:
    """0-based position of the n-th (from 1) non-overlapping occurrence, -1 if there is none."""
    before = F.call_function("substring_index", col(c), col(marker), col(n).cast("int"))
    return F.when((col(n) >= 1) & (occurrences(c, marker) >= col(n)), F.length(before)).otherwise(F.lit(-1))


def marker_status(c, marker) -> Column:
    k = occurrences(c, marker)
    return F.when(F.coalesce(F.length(col(marker)), F.lit(0)) == 0, "empty").when(k == 0, "not_found").when(k == 1, "unique").otherwise("multiple")


def snippet(c, marker, reach: int = 100) -> Column:
    """Up to ``reach`` characters either side of the first marker."""
    at = F.instr(col(c), col(marker))
    start = F.greatest(F.lit(1), at - reach)
    return F.when(at > 0, F.substr(col(c), start, at - start + F.length(col(marker)) + reach)).otherwise("")


def flexible_prefix(c, prefix) -> Column:
    """How many characters of a text a prefix covers if white space inside either does not count; 0 if it is none."""
    want = F.regexp_replace(F.coalesce(col(prefix), F.lit("")), r"(?U)\s+", "")
    # Each character quoted, white space allowed between any two.
    body = F.regexp_replace(want, r"(?s)(.)", r"\\Q$1\\E\\s*")
    pattern = F.concat(F.lit(r"(?U)^\s*"), F.substr(body, F.lit(1), F.length(body) - 3))
    return F.when(want == "", 0).otherwise(F.coalesce(F.length(F.regexp_substr(col(c), pattern)), F.lit(0)))


def marker_is_heading(marker, title) -> Column:
    """Whether of marker and title, without white space, one begins with the other."""
    a, b = (F.regexp_replace(col(x), r"(?U)\s+", "") for x in (marker, title))
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.startswith(a, b) | F.startswith(b, a))


def strip_own_heading(c, marker, title, anchor=None) -> Column:
    """The text as one line without its own heading at the start, nor marks and blanks behind that, unless the node anchors content.

    The heading is the longer of title and marker that the text begins with.
    """
    text, keep = one_line(c), F.coalesce(col(anchor), F.lit(False)) if anchor is not None else F.lit(False)
    m, t = (strip(F.coalesce(col(x), F.lit(""))) for x in (marker, title))
    longer, shorter = F.when(F.length(t) >= F.length(m), t).otherwise(m), F.when(F.length(t) >= F.length(m), m).otherwise(t)
    first = flexible_prefix(text, longer)
    cut = F.when(first > 0, first).otherwise(flexible_prefix(text, shorter))
    rest = F.regexp_replace(F.substr(text, cut + 1), r"(?U)^[\s:：、，,；;。]+", "")
    return F.when(marker_is_heading(marker, title) & ~keep, rest).otherwise(text)


# The marks that may close a context, the first found counting first.
CONTEXT_MARKS = ("。", "！", "？", "；", "!", "?", ";")


def recommendation_context(c, limit: int, override=None, least: int = 60, slack: int = 180) -> Column:
    """A recommendation's opening as context, as one compact line.

    An override; the whole if it is short enough; up to the first place of a mark in
    [least, limit), the marks tried in order; up to a mark's first place in [limit,
    limit + slack); or a cut there.
    """
    text = one_line(c)
    upto = lambda n: F.substr(text, F.lit(1), n)
    stop = F.least(F.length(text), F.lit(limit + slack))
    near = [F.when((F.instr(text, F.lit(d)) > least) & (F.instr(text, F.lit(d)) <= limit), upto(F.instr(text, F.lit(d)))) for d in CONTEXT_MARKS]
    places = [F.locate(d, text, limit + 1) for d in CONTEXT_MARKS]
    far = [F.when((p > limit) & (p <= stop), upto(p)) for p in places]
    given = F.when(strip(col(override)) != "", strip(col(override))) if override is not None else F.lit(None).cast("string")
    return compact_cjk(F.coalesce(given, F.when(F.length(text) <= limit, text), *near, *far, upto(stop)))


RULE = "array<struct<operation:string,start:string,end:string,replacement:string,count:int,keep_start:boolean,keep_end:boolean,include_marker:boolean,required:boolean,rule_id:string>>"
_NOTE = T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("removed", T.IntegerType())])
CLEANED = T.StructType([T.StructField("text", T.StringType()), T.StructField("diagnostics", T.ArrayType(_NOTE))])


def apply_rule(text: str, rule: dict) -> tuple[str, bool]:
    """One cleanup rule on one text: (new text, whether it applied)."""
    op, start = rule["operation"], rule.get("start") or ""
    if op == "remove_between":
        a = text.find(start) if start else -1
        b = text.find(rule.get("end") or "", a + len(start)) if a >= 0 else -1
        if a < 0 or b < 0:
            return text, False
        left = a + (len(start) if rule.get("keep_start") else 0)
        right = b + (0 if rule.get("keep_end") else len(rule.get("end") or ""))
        return text[:left] + text[right:], True
    if op == "trim_after":
        a = text.find(start) if start else -1
        return (text, False) if a < 0 else (text[: a + (len(start) if rule.get("include_marker") else 0)], True)
    count = rule.get("count")
    count = int(count) if count and count == count else 0  # a missing number comes as NaN
    if op == "replace":
        return (text.replace(start, rule.get("replacement") or "", count or -1), True) if start and start in text else (text, False)
    if op == "regex_replace":
        new, n = re.subn(start, rule.get("replacement") or "", text, count=count)
        return new, n > 0
    raise ValueError(f"unknown operation: {op}")


@F.pandas_udf(CLEANED)
def clean_node(text: pd.Series, rules: pd.Series) -> pd.DataFrame:
    """A node's text after its cleanup rules in order, as one line before and after each, and what each did; a required rule that does not apply is an error."""
    line = lambda t: " ".join((t or "").split())
    out = []
    for t, rs in zip(text, rules):
        notes, t = [], line(t)
        for r in rs if rs is not None else ():
            new, hit = apply_rule(t, r)
            if not hit and r.get("required") is not False:
                raise ValueError(f"required rule did not apply: {r.get('rule_id')}")
            new = line(new)
            notes.append({"rule_id": r.get("rule_id"), "status": "applied" if hit else "not_applied", "removed": max(0, len(t) - len(new))})
            t = new
        out.append((t, notes))
    return pd.DataFrame(out, columns=["text", "diagnostics"])
