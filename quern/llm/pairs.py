"""Broken prompt and response pairs (problem 1).

Shortened answers are found against the corpus itself: the closing sentence or list
item of every answer is sorted, together with all sentences and items that are
known to be whole, by range partitions; in sorted order a text that any other
continues is continued by its immediate successor, so one comparison of neighbours'
common prefix suffices.  Where a sentence begins like no other, its last clause is
sorted among all clauses in the same way.  Lengths at which unfinished answers pile
up give away a length limit.  What is then left unfinished breaks off without other
evidence; ``rule`` says of every defect what gave it away.  Copies, refusals and
foreign answers are told by rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, shuffle_width, table
from . import canon
from .language import language
from .sentences import BEFORE_NUMBER, NEVER, sentence_ends

#: A length is a spike if so many unfinished answers have it, and so many times more than lengths within SPIKE_REACH on average.
SPIKE_LEAST, SPIKE_TIMES, SPIKE_REACH = 8, 4.0, 5
#: Share of an answer that may stand outside refusing and polite clauses and still leave it a refusal.
REFUSAL_REST = 0.2
#: An unfinished answer of at most so many characters that nothing continues is a short answer, not a truncated one.
SHORT_ANSWER = 6

# Placeholders for an answer.
_PLACEHOLDER = {"n/a", "na", "none", "null", "nil", "nan", "tbd", "todo", "undefined", "no answer", "empty", "blank", "placeholder", "无", "暂无", "没有", "空", "略", "待补充", "待定", "无答案", "未填写", "不详"}
_LABEL = re.compile(r"^(?:答复?|回答|答案|解答|回复|问题?|提问|结论|要点|建议如下|answer|response|reply|a|q|question|output|result|key points|the passages suggest|final answer)\s*[:：]\s*", re.I)
_MARKUP = re.compile(r"```[\w-]*|`+|</?[a-zA-Z][^<>]{0,80}>|\*{1,3}|_{2,}|^\s*#{1,6}(?=\s|$)|^\s*>+|\|", re.M)
_CITATION = re.compile(r"(?:\s*(?:\[[^\[\]]{0,40}\]|【[^【】]{0,40}】|[(（](?:evidence|证据|source|来源|ref\.?|参考|文献|引用)[^()（）]{0,30}[)）]|\^\d+))+\s*$", re.I)
_BULLET = re.compile(r"^\s*(?:[-–—•*·▪◦‣]|\(?\d{1,3}[.)、）．]|[（(]\d{1,3}[）)]|[①-⑳])\s*")
_QUOTED = re.compile(r"“[^“”]*”|「[^「」]*」|『[^『』]*』|«[^«»]*»|\"[^\"\n]*\"|《[^《》]*》")
_ONLY_QUOTED = re.compile(r"^[^“”「」『』«»\"]{0,30}[“「『«\"](.+)[”」』»\"]\s*[。.!！?？]*$", re.S)
_FINAL = "。！？!?।॥｡.…"
_SHUT = "”’」』»\"')）]】"
_LEAD = re.compile(r"^[^：:，,。？?]{0,16}[A-Za-z]{0,6}[-\s]?[\w-]{0,14}[：:，,]\s*")

# Clauses that decline, by language.
_DECLINE = re.compile(
    r"无法|不能(?!控制|排除)|不便|恕|不(?:作|做|予|会|宜|想)[^，。；]{0,4}(?:答复|回答|作答|评论|置评|回应|解答|判断)|没有权限|难以(?:回答|作答|判断|给出)|不足以|证据不足|信息(?:缺失|不足)|资料(?:缺失|不足)|没有(?:找到|检索到|相关|提供|涉及|足够)|未(?:找到|检索到|涉及|提及|提供|包含|说明)|看不到|尚不|暂不|暂无|暂时无法|超出.{0,10}范围|不予(?:回答|回应)|拒绝|"
    r"\b(?:can ?not|can't|unable|not able|not possible|no (?:\w+ )?(?:answer|information|evidence|statement|basis|passage|conclusion|data|details?|guidance|recommendation)|(?:is|are|was|were) not (?:covered|mentioned|addressed|available|enough|sufficient|provided|found|stated|described|included)|"
    r"insufficient|(?:will|would|can|could|shall|may|must|do|does|rather|prefer to|choose to) not (?:to )?(?:answer|comment|advise|respond|reply|discuss|judge)|(?:won't|wouldn't|can't|don't) (?:answer|comment|advise|respond|reply|discuss|judge)|no comment|(?:outside|beyond) what (?:i|we)|do(?:es)? not (?:contain|cover|mention|address|provide|allow|say|include|give|permit|discuss)|don't (?:have|contain|cover|know)|could not be|couldn't|decline to|refuse|outside (?:the|my) scope|beyond (?:the|my) scope|not permitted|not allowed|not authori[sz]ed|cannot be|won't be able)\b",
    re.I,
)
_POLITE = re.compile(
    r"^(?:请|(?:这|此|该|您的|你的)(?:类|个|些|一|种)?问题[^，。；]{0,8}(?:需|应|宜|须|由|只能|必须|建议)|建议(?:您|你)?(?:咨询|就医|联系|向|尽快|到|前往)|如有|如需|祝|希望|谢谢|感谢|抱歉|对不起|很遗憾|非常抱歉|十分抱歉|不好意思|作为|根据(?:现有|目前|所给|已有|检索|上述|提供)|就(?:目前|现有|所给)|基于|从(?:目前|现有|所给|提供)|在(?:目前|现有|所给|提供)|检索到|现有(?:证据|资料|材料)|目前提供|所提供|"
    r"(?:and |so |but |or |therefore |thus )*(?:please|kindly|sorry|i'?m (?:sorry|afraid)|i am (?:sorry|afraid)|i apologi[sz]e|apologies|unfortunately|regrettably|as an? |based on|from the|from what|according to|given the|in the (?:passages|material|text|evidence)|with the (?:material|evidence)|(?:this|that|it|such a question|this question) (?:is|should be|must be|has to be|needs to be|is best) (?:best )?(?:left|judged|decided|discussed|assessed|answered|settled)|you (?:may|should|could) (?:ask|contact|consult|speak|see)|an? (?:doctor|clinician|physician|specialist|nurse|pharmacist)\b.{0,20}(?:consulted|asked)|ask an? |consult|contact|speak (?:to|with)|see (?:a|your)|thank|i hope|we hope|best wishes|get well|take care))",
    re.I,
)
_CLAUSE = re.compile(r"[，,；;。.！!？?：:\n]+|(?<=[a-z]) (?=so |and an? (?:doctor|clinician)|and please)")


def reduce(text: str, canonical: bool = True) -> str:
    """Letters and digits of the consistent form, without case."""
    return "".join(c for c in (canon.canonical(text) if canonical else text).casefold() if c.isalnum())


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    text = _MARKUP.sub(" ", canon.canonical(answer)).strip()
    for _ in range(3):
        text = _LABEL.sub("", _BULLET.sub("", text)).strip()
    bare = text.strip("[](){}<>【】（）《》“”\"'-—_.…。·*~/\\ ").casefold()
    return bare in _PLACEHOLDER or not any(c.isalnum() for c in bare) or bool(re.fullmatch(r"(?:answer|response|text|回答|答案)(?: here| goes here)?", bare))


def is_copy(query: str | None, answer: str) -> bool:
    """Whether an answer is the question, once or more, whole or broken off, bare, labelled or quoted, and nothing else."""
    if not query:
        return False
    text = _MARKUP.sub(" ", answer).strip()
    lines = " ".join(_LABEL.sub("", line + "\n") for line in text.split("\n"))
    bodies = {text, lines, _LABEL.sub("", text), re.sub(r"^[^：:]{0,20}[：:]", "", text, count=1)}
    quoted = _ONLY_QUOTED.match(text)
    if quoted:
        bodies.add(quoted[1])
    # Once in consistent form, and once as stored, as look-alike letters of one case may differ in the other.
    for canonical in (True, False):
        heads = {reduce(query, canonical), reduce(_LEAD.sub("", canon.canonical(query) if canonical else query, count=1), canonical)}
        for body in bodies:
            a = reduce(body, canonical)
            for h in heads:
                if len(h) >= 4 and a and (a == h * (len(a) // len(h)) or (len(a) >= 0.8 * len(h) and len(a) < len(h) and h.startswith(a))):
                    return True
    return False


def is_refusal(answer: str) -> bool:
    text = _CITATION.sub("", canon.canonical(_MARKUP.sub(" ", answer)))
    declined, rest, whole = False, 0, 0
    for clause in _CLAUSE.split(text):
        clause = clause.strip().strip("“”\"' ")
        if not clause:
            continue
        whole += len(clause)
        if _DECLINE.search(clause):
            declined = True
        elif not _POLITE.search(clause):
            rest += len(clause)
    return declined and rest <= REFUSAL_REST * whole


def is_foreign(query: str | None, answer: str) -> bool:
    asked = language(canon.canonical(query or ""))
    told = canon.canonical(_QUOTED.sub(" ", answer))
    text = _CITATION.sub("", told)
    given = language(text)
    if not asked or not given or asked == given:
        return False
    if given in ("en", "de", "es", "fr", "it", "pt"):
        words = re.findall(r"[^\W\d_]+", text)
        # Terms alone are no language: names and abbreviations of up to three words.
        if len(words) <= 3 and not any(w.lower() in ("yes", "no", "not", "the", "is", "of") for w in words):
            return False
    return True


def masked(segment: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", canon.canonical(segment))).strip()


def segments(answer: str) -> tuple[list[str], str, bool, bool, bool]:
    """(whole segments, closing one, it is finished by a mark, it may be no end at all, it is a list item); all masked.

    Segments are the items of a list and the sentences of other lines.  All but the
    last of an answer are whole.  A closing citation or closed quotation finishes one.
    """
    text = answer.rstrip()
    cited = _CITATION.search(text)
    if cited and cited.start():
        text = text[: cited.start()].rstrip()
    parts: list[tuple[str, bool]] = []
    for line in text.split("\n"):
        m = _BULLET.match(line)
        body = line[m.end() :] if m else line
        at = 0
        for end in sentence_ends(body):
            parts.append((body[at:end].strip(), bool(m)))
            at = end
        if m and not body.strip():
            parts.append(("", True))
    if not parts:
        return [], "", True, False, False
    last, item = parts[-1]
    core = last.rstrip(_SHUT + " ")
    finished = bool(cited and cited.start() and cited.end() == len(answer)) or (bool(core) and core[-1] in _FINAL) or (last != core and bool(_QUOTED.search(last)) and last[-1] in "”」』»\"")
    if last.count("“") > last.count("”") or last.count("「") > last.count("」") or last.count("（") > last.count("）") or last.count("(") > last.count(")"):
        finished = False
    doubtful = False
    if finished and core.endswith((".", "．")) and not cited:
        token = re.search(r"[\w.]*$", canon.canonical(core)[:-1]).group()
        low = token.lower()
        doubtful = low in NEVER or low in BEFORE_NUMBER or token[-1:].isdigit() or len(token) == 1
    return [masked(p) for p, _ in parts[:-1]], masked(last), finished, doubtful, item


_VERDICT = "run_id string, query_id string, defect string, whole array<string>, closing string, finished boolean, doubtful boolean, item boolean, n int"


def judge(pairs: DataFrame) -> DataFrame:
    """Each pair with its defect by rule, if any, and its segments."""
    setup = canon.tables()
    rows = pairs.select("run_id", "query_id", "query", "answerability", "answer").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon.install(setup)
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for query, answerable, answer in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                defect, found = None, ([], "", True, False, False)
                if is_empty(answer):
                    defect = "empty"
                elif is_copy(query, answer):
                    defect = "copies_question"
                elif is_refusal(answer):
                    # Declining is right where nothing can be answered, but not in another language.
                    defect = "refusal" if answerable == "answerable" else "other_language" if is_foreign(query, answer) else "declined"
                elif is_foreign(query, answer):
                    defect = "other_language"
                if defect in (None, "declined"):
                    found = segments(answer)
                for c, v in zip(cols, (defect, *found, len(answer or ""))):
                    c.append(v)
            types = [pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, types))], names=[x.split()[0] for x in _VERDICT.split(", ")])

    return rows.mapInArrow(run, _VERDICT)


def continued(texts: DataFrame, column: str) -> DataFrame:
    """Distinct rows of ``texts`` with ``continued``: whether another text starts with this one and goes on.

    Texts are sorted by range; a partition's last text is compared with the first
    text of the next partition that has one.
    """
    spark = texts.sparkSession
    ranged = cut(texts.repartitionByRange(shuffle_width(spark), column).sortWithinPartitions(column).withColumn("part", F.spark_partition_id()))
    # One row per partition: bounded by the number of partitions.
    firsts = ranged.groupBy("part").agg(F.min(column).alias("first"))
    firsts = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("after"))
    neighbour = F.coalesce(F.lead(column).over(Window.partitionBy("part").orderBy(column)), F.col("after"))
    out = ranged.join(firsts, "part").withColumn("next", neighbour)
    return out.withColumn("continued", F.coalesce(F.startswith("next", F.col(column)) & (F.col("next") != F.col(column)), F.lit(False))).drop("next", "after", "part")


def last_clause(c) -> F.Column:
    """What stands behind the last comma or the like of a masked segment."""
    return F.trim(F.regexp_extract(c, r"([^,;:、，；：]*)$", 1))


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """(run_id, query_id, defect_type, rule): one row per defective pair.

    Of several defects the first of empty, copies_question, refusal, other_language,
    truncated counts.  A null answer is empty; a null question can be neither copied
    nor in another language; null ids are kept; repeated rows count once; an id pair
    with several answers has a row per defect; other columns are ignored; an empty
    table gives no rows.  ``rule`` is the defect's own name or, of truncated ones,
    the first that holds: prefix (a longer text goes on from it), length_limit,
    clause_prefix (a longer clause goes on from its last one), open_end (its last
    word or sign needs more), no_end_mark.
    """
    judged = cut(judge(pairs))
    whole = judged.select(F.explode("whole").alias("segment"), F.lit(True).alias("whole"))
    ended = judged.where("finished AND NOT doubtful").select(F.col("closing").alias("segment"), F.lit(True).alias("whole"))
    tails = judged.where("defect IS NULL OR defect = 'declined'").where("NOT finished OR doubtful").select("run_id", "query_id", F.col("closing").alias("segment"), "finished", "doubtful", "item", "n")
    tails = tails.withColumn("clause", last_clause("segment"))
    known = whole.unionByName(ended).unionByName(tails.select("segment", F.lit(False).alias("whole"))).where("segment <> ''")
    known = cut(known.groupBy("segment").agg(F.max("whole").alias("whole")))
    # Whole segments by their clauses, and the last clauses of unfinished ones.
    clauses = known.where("whole").select(F.explode(F.split("segment", "[,;:、，；：]")).alias("clause"), F.lit(True).alias("seen")).unionByName(tails.select("clause", F.lit(False).alias("seen")))
    clauses = clauses.withColumn("clause", F.trim("clause")).where("clause <> ''").groupBy("clause").agg(F.max("seen").alias("clause_seen"))
    clauses = continued(clauses, "clause").withColumnRenamed("continued", "clause_continued")
    known = continued(known, "segment")
    # Lengths at which unfinished answers pile up, against the lengths around them.
    lengths = tails.where("NOT finished").groupBy("n").agg(F.count("*").alias("here"))
    around = lengths.select(F.explode(F.sequence(F.col("n") - SPIKE_REACH, F.col("n") + SPIKE_REACH)).alias("n"), "here").groupBy("n").agg(F.sum("here").alias("all"))
    spikes = lengths.join(around, "n").where((F.col("here") >= SPIKE_LEAST) & (F.col("here") > SPIKE_TIMES * (F.col("all") - F.col("here")) / (2 * SPIKE_REACH))).select("n", F.lit(True).alias("spike"))
    x = tails.join(known, "segment", "left").join(clauses, "clause", "left").join(spikes, "n", "left")
    open_end = F.col("segment").rlike(r"[,，、;；:：(（\[【“「/]$|(?i)\b(?:the|of|and|or|to|in|with|for|a|an|by|when|than|as|at|is|be)$") | (F.col("segment") == "")
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    rule = (
        F.when(F.col("doubtful") & F.col("finished"), F.when(~true("whole") & true("continued"), "prefix"))
        .when(F.col("item") & open_end, "open_end")
        .when(true("whole"), None)
        .when(true("continued"), "prefix")
        .when(true("spike"), "length_limit")
        .when(~F.col("item") & true("clause_continued") & ~true("clause_seen"), "clause_prefix")
        .when(~F.col("item") & open_end, "open_end")
        .when(~F.col("item") & (F.length("segment") > SHORT_ANSWER), "no_end_mark")
    )
    by_rule = judged.where("defect IS NOT NULL AND defect <> 'declined'").select("run_id", "query_id", F.col("defect").alias("defect_type"), F.col("defect").alias("rule"))
    broken = x.withColumn("rule", rule).where("rule IS NOT NULL").select("run_id", "query_id", F.lit("truncated").alias("defect_type"), "rule")
    return by_rule.unionByName(broken).distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(table(spark, sf_dir, "generation_run")).select("run_id", "query_id", "defect_type").distinct()


def p1_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs each rule gave away."""
    return broken_pairs(table(spark, sf_dir, "generation_run")).groupBy("defect_type", "rule").agg(F.count("*").alias("pairs"))
