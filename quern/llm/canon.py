"""One consistent form for texts that look the same (problem 7).

A character is stable if the consistent form leaves it alone whatever stands beside
it (the quick-check idea of Unicode normalisation, extended to invisible characters,
blanks, hyphens and look-alike letters).  Only the unstable stretches of a text are
rewritten, each with the stable character before it, to which a combining mark may
attach; the results are spliced into the unchanged rest.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, table

# Letters of other scripts that cannot be told from a Latin letter, by that letter.
LOOK_ALIKE = {
    "A": "ΑА", "B": "ΒВ", "C": "СϹ", "E": "ΕЕ", "H": "ΗН", "I": "ΙІ", "J": "ЈͿ", "K": "ΚК", "M": "ΜМ", "N": "Ν", "O": "ΟО", "P": "ΡР",
    "S": "Ѕ", "T": "ΤТ", "X": "ΧХ", "Y": "ΥҮ", "Z": "Ζ", "a": "а", "c": "сϲ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "o": "οо", "p": "ρр",
    "q": "ԛ", "s": "ѕ", "v": "ν", "w": "ԝ", "x": "х", "y": "у", "d": "ԁ", "G": "Ԍ", "Q": "Ԛ", "W": "Ԝ", "V": "Ѵ", "l": "ӏ",
}
# The same of scripts that are rarely written beside Latin letters, by script: their letters, and the Latin ones they look like, in order.
LOOK_ALIKE_RARE = [
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZVSLCPKB"),  # Cherokee
    ("օոսհցՕՍ", "onuhgOU"),  # Armenian
    ("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "HIKMNOPCTYXopc"),  # Coptic
]
# Katakana that cannot be told from a Han character, by that character.
LOOK_ALIKE_HAN = {"口": "ロ", "工": "エ", "力": "カ", "二": "ニ", "夕": "タ", "卜": "ト", "八": "ハ", "才": "オ", "千": "チ", "一": "ー"}
# The hyphens, dashes of a hyphen's width and the minus sign.
HYPHENS = "‐‑‒–−﹣－⁃˗"


@functools.cache
def _fold() -> dict[int, str]:
    """Single-character mapping before composition; look-alike Kana are left to their context."""
    if _SENT:
        return _SENT[0][0]
    out = {ord(x): latin for latin, group in LOOK_ALIKE.items() for x in group}
    out |= {ord(x): latin for letters, like in LOOK_ALIKE_RARE for x, latin in zip(letters, like, strict=True)}
    out |= {ord(x): "-" for x in HYPHENS}
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat == "Cf" or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D):
            out[c] = ""
        elif ch.isspace() or cat in ("Zs", "Zl", "Zp"):
            out[c] = " "
    return out


def _rewrite(stretch: str) -> str:
    """The consistent form of a stretch: invisible characters out, decomposed, folded, composed."""
    fold = _fold()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKD", stretch.translate(fold)).translate(fold)).translate(fold)


def tables() -> tuple[dict[int, str], str, str]:
    """What the rules over all of Unicode give, worked out once on the driver and sent with the task."""
    return _fold(), _unstable_class(False), _unstable_class(True)


def install(given: tuple[dict[int, str], str, str]) -> None:
    """In a worker: use the driver's tables."""
    if not _SENT:
        _SENT.append(given)


_SENT: list[tuple[dict[int, str], str, str]] = []


@functools.cache
def _unstable(astral: bool) -> re.Pattern:
    return re.compile(f"[{_SENT[0][1 + astral] if _SENT else _unstable_class(astral)}]+")


@functools.cache
def _unstable_class(astral: bool) -> str:
    """Stretches that may change; by rule over all of Unicode, or over its first plane, which is tested faster."""
    fold, bad = _fold(), []
    jamo = range(0x1160, 0x1200)
    for c in range(0x80, sys.maxunicode + 1):
        ch = chr(c)
        if 0xD800 <= c <= 0xDFFF or unicodedata.category(ch) in ("Cn", "Co"):
            continue
        if c in fold or c in jamo or unicodedata.combining(ch) or unicodedata.normalize("NFKC", ch) != ch or _rewrite(ch) != ch or unicodedata.category(ch) in ("Mn", "Mc"):
            bad.append(c)
    bad += [c for c in fold if c < 0x80 and c != 0x20 and fold[c] != chr(c)]
    if not astral:
        bad = [c for c in bad if c < 0x10000]
    runs, start, prev = [], None, None
    for c in sorted(bad):
        if start is None or c != prev + 1:
            if start is not None:
                runs.append((start, prev))
            start = c
        prev = c
    runs.append((start, prev))
    cls = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    return cls


_KANA = {ord(x): han for han, x in LOOK_ALIKE_HAN.items()}
_KANA_RUN = re.compile("[" + "".join(LOOK_ALIKE_HAN.values()) + "]+")


def _kana(m: re.Match) -> str:
    """Look-alike Kana are Han characters unless other Kana stand beside them."""
    s, a, b = m.string, m.start(), m.end()
    beside = (s[a - 1] if a else "") + (s[b] if b < len(s) else "")
    if any("ぁ" <= x <= "ヿ" for x in beside) or b - a > 1:
        return m.group()
    return m.group().translate(_KANA)


@functools.lru_cache(200_000)
def _memo(stretch: str) -> str:
    return _rewrite(stretch)


def canonical(text: str) -> str:
    """The consistent form; it is its own consistent form."""
    if not text.isascii() or not text.isprintable():
        out, done = [], 0
        for m in _unstable(max(text) > "\uffff").finditer(text):
            a, b = m.span()
            a = max(done, a - 1)  # the character before, to which a mark may attach
            out += (text[done:a], _memo(text[a:b]))
            done = b
        text = "".join(out) + text[done:] if out else text
        if _KANA_RUN.search(text):
            text = _KANA_RUN.sub(_kana, text)
    return text


def canonical_texts(df: DataFrame, text_col: str, out_col: str = "canonical") -> DataFrame:
    """``df`` with one more column: the consistent form of ``text_col``, null for null.

    An existing column named ``out_col`` is replaced.  Texts are handled whole.
    """
    keep = [c for c in df.columns if c != out_col]
    at = keep.index(text_col)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out_col, T.StringType())])
    setup = tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        install(setup)
        for b in batches:
            new = pa.array([None if t is None else canonical(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, new], names=[*keep, out_col])

    return df.select(*keep).mapInArrow(run, schema)


#: Rows of one look that are met at a time.
LOOK_PART = 64


def same_look(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, look, form, parts) of the ids whose non-blank text looks like another's that is stored differently.

    The look and the stored form are given by SHA-256, which travels instead of texts.
    Null ids and blank texts take no part; repeated rows count once; an id with
    several texts has a row for each; other columns are ignored; an empty table gives
    no rows.  A look with a single stored form is dropped before anything is paired.
    """
    rows = canonical_texts(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "look")
    rows = rows.where(F.col("id").isNotNull() & (F.trim(F.col("look")) != ""))
    digest = lambda c: F.unhex(F.sha2(c, 256))
    rows = rows.select("id", digest("text").alias("form"), digest("look").alias("look")).distinct()
    looks = rows.groupBy("look").agg(F.min("form").alias("f"), F.max("form").alias("t"), F.count("*").alias("n")).where("f <> t")
    return rows.join(looks.select("look", F.ceil(F.col("n") / LOOK_PART).cast("int").alias("parts")), "look")


def same_look_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b): ids whose texts look the same but are not equal, the smaller id first.

    A look's rows are met by (look, part): one side is divided into as many parts as
    its rows need, the other repeated, so that one look may hold any share of the
    rows.  All pairs of a look are given; same_look_classes says the same in as many
    rows as there are ids.
    """
    rows = cut(same_look(df, id_col, text_col))
    a = rows.select("look", F.col("id").alias("id_a"), F.col("form").alias("form_a"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    b = rows.select("look", F.col("id").alias("id_b"), F.col("form").alias("form_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["look", "part"]).where("form_a <> form_b AND id_a < id_b").select("id_a", "id_b").distinct()


def same_look_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, form_id, links): membership instead of pairs.

    ``class_id`` is the smallest id of the look, ``form_id`` the smallest with the
    same stored text, ``links`` the number of ids of the class stored differently.
    Two ids look the same if their classes are equal, and are stored differently if
    their forms are not.  Counted with map-side combining, so a look may hold any
    share of the rows.
    """
    rows = cut(same_look(df, id_col, text_col))
    looks = rows.groupBy("look").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    forms = rows.groupBy("look", "form").agg(F.min("id").alias("form_id"), F.count("*").alias("own"))
    both = forms.join(looks, "look").select("look", "form", "class_id", "form_id", (F.col("n") - F.col("own")).alias("links"))
    return rows.join(both, ["look", "form"]).select("id", "class_id", "form_id", "links")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks, and pairs of questions, that a reader cannot tell apart."""
    chunks = same_look_pairs(table(spark, sf_dir, "gold_corpus"), "chunk_id", "text")
    return chunks.unionByName(same_look_pairs(table(spark, sf_dir, "retrieval_eval"), "query_id", "query")).distinct()


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of every look that is stored in several ways, with its representatives."""
    chunks = same_look_classes(table(spark, sf_dir, "gold_corpus"), "chunk_id", "text")
    return chunks.unionByName(same_look_classes(table(spark, sf_dir, "retrieval_eval"), "query_id", "query"))


def p7_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-null text of both tables in its consistent form."""
    chunks = table(spark, sf_dir, "gold_corpus").select(F.col("chunk_id").alias("id"), "text")
    both = chunks.unionByName(table(spark, sf_dir, "retrieval_eval").select(F.col("query_id").alias("id"), F.col("query").alias("text")))
    return canonical_texts(both.where("text IS NOT NULL").distinct(), "text").select("id", "canonical")
