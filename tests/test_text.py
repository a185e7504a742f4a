from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators.retrieval import token_counts


def one(spark, value, *columns, schema="t string"):
    return spark.createDataFrame([value if isinstance(value, tuple) else (value,)], schema).select(*columns).first()


def test_space_and_signature(spark):
    r = one(spark, "　 Page 12 \n １２ ", X.squeeze("t"), X.margin_signature("t"))
    assert tuple(r) == ("Page 12 １２", "page # #")


def test_line_numbers_at_half(spark):
    assert one(spark, "1 a\n2 b\nc\nd", X.strip_line_numbers("t"))[0] == "a\nb\nc\nd"
    assert one(spark, "1 a \n\nb\nc", X.strip_line_numbers("t"))[0] == "1 a\nb\nc"
    assert one(spark, " \n", X.strip_line_numbers("t"))[0] == ""


def test_wrapped_lines(spark):
    both = "t string, l string"
    assert one(spark, ("膝骨\n关节炎\n", "zh"), X.join_wrapped_lines("t", "l"), schema=both)[0] == "膝骨关节炎"
    assert one(spark, ("exer-\ncise is\ngood\n, yes", "en"), X.join_wrapped_lines("t", "l"), schema=both)[0] == "exercise is good, yes"
    assert one(spark, ("Know-\nHow, (\na )", "de"), X.join_wrapped_lines("t", "l"), schema=both)[0] == "Know- How, ( a )"
    assert one(spark, ("see（\nKnee\n）\nx. ok\nNext", "zh"), X.join_wrapped_lines("t", "l"), schema=both)[0] == "see（Knee） x. ok Next"


def test_sentence_splits(spark):
    r = one(spark, "一。二！ Three. four;five", X.sentences_any("t"), X.sentences_spaced("t"), X.sentences_strong("t"))
    assert r[0] == ["一。", "二！", "Three.", "four;", "five"]
    assert r[1] == ["一。", "二！", "Three.", "four;five"]
    assert r[2] == ["一。", "二！", "Three. four;", "five"]


def test_tokens():
    assert token_counts("膝关节 K-L/2.0_x Ａ１ Schöpf 痛痛") == Counter({"痛": 2, **dict.fromkeys(["膝", "关", "节", "膝关", "关节", "痛痛", "k-l/2.0_x", "a1", "sch", "pf"], 1)})
    assert token_counts("Ａ１", normalize=False) == Counter() == token_counts("")


def test_positions(spark):
    r = one(spark, ("a|b|c", "|"), X.occurrences("t", "m"), X.nth_position("t", "m", F.lit(2)), X.nth_position("t", "m", F.lit(3)), X.marker_status("t", "m"), X.snippet("t", "m", 1), schema="t string, m string")
    assert tuple(r) == (2, 3, -1, "multiple", "a|b")


def test_trimming(spark):
    s = "t string, m string"
    assert tuple(one(spark, ("head MARK tail", "MARK"), X.trim_before("t", "m"), X.trim_from("t", "m"), X.trim_after("t", "m"), schema=s)) == ("MARK tail", "head ", "head MARK")
    assert one(spark, ("text", "none"), X.trim_before("t", "m"), schema=s)[0] == "text"
    with pytest.raises(Exception, match="marker not found"):
        one(spark, ("text", "none"), X.trim_before("t", "m", strict=True), schema=s)


def test_headings_and_context(spark):
    assert one(spark, " 一、 References： ", X.normalize_heading("t"))[0] == "references"
    assert one(spark, ("概 述 正文", "概述", "概述"), X.strip_own_heading("t", "m", "h"), schema="t string, m string, h string")[0] == "正文"
    assert one(spark, "x" * 70 + "。" + "y" * 80, X.recommendation_context("t", 100))[0] == "x" * 70 + "。"
    assert len(one(spark, "x" * 500, X.recommendation_context("t", 100))[0]) == 280
    assert one(spark, "x" * 120 + "；" + "y" * 20 + "。" + "z" * 200, X.recommendation_context("t", 100))[0] == "x" * 120 + "；" + "y" * 20 + "。"
    assert one(spark, "x" * 99 + "。" + "y" * 80, X.recommendation_context("t", 100))[0] == "x" * 99 + "。"  # the last place within the limit
    assert one(spark, ("x" * 300, " 甲 乙 "), X.recommendation_context("t", 100, "o"), schema="t string, o string")[0] == "甲乙"
    assert one(spark, ("概 述：。 正文", "概", "概述"), X.strip_own_heading("t", "m", "h"), schema="t string, m string, h string")[0] == "正文"
    assert tuple(one(spark, ("a.b*(c", "a .b*", "zz"), X.flexible_prefix("t", "m"), X.flexible_prefix("t", "h"), schema="t string, m string, h string")) == (4, 0)


def test_cleanup_rules(spark):
    rules = [("remove_between", "A", "B", None, None, True, True, False, True, "r1"), ("replace", "x", None, "y", 1, False, False, False, False, "r2"), ("regex_replace", r"\d+", None, "#", 0, False, False, False, False, "r3"), ("trim_after", "END", None, None, None, False, False, False, False, "r4")]
    df = spark.createDataFrame([("A..B xx 12 END z", rules)], "t string, r " + X.RULE)
    r = df.select(X.clean_node("t", "r").alias("c")).first().c
    assert r.text == "AB yx #" and [d.status for d in r.diagnostics] == ["applied"] * 4


def test_citations_and_fields(spark):
    assert one(spark, "[1,2] a", X.citation_only("t"))[0] is True
    assert one(spark, "［见文献三至七］[Smith et al.] 痛", X.citation_only("t"))[0] is True
    assert one(spark, (" ", ["a", "b"], "", "t"), X.dense_text("r", "p", "d", "t"), schema="r string, p array<string>, d string, t string")[0] == "a > b\nt"
    assert one(spark, "现有的证据不足", X.says_insufficient("t"))[0] is True
    assert one(spark, "| a | b |\n|---|:---:|\n| 1 | 2 |", X.markdown_separators("t"))[0] == 1


def test_more_normalisers(spark):
    assert one(spark, "a  b\r\n\n c\td ", X.one_line("t"))[0] == "a b c d"
    assert one(spark, "膝 关节 ， 痛 （ 轻 ） knee pain", X.compact_cjk("t"))[0] == "膝关节， 痛 （轻） knee pain"
    assert one(spark, "12 text\nno", X.strip_preprint_numbers("t", F.lit("s"), ["s"]))[0] == "text\nno"
    assert one(spark, "a\n 34 \nb\n5 甲", X.strip_preprint_numbers("t", F.lit("s"), ["s"]))[0] == "a\n\nb\n5 甲"
    assert one(spark, "12 text", X.strip_preprint_numbers("t", F.lit("other"), ["s"]))[0] == "12 text"
    residual = lambda t, s: one(spark, t, X.strip_residual_numbers("t", F.lit(s), ["s"]))[0]
    assert [residual(t, "s") for t in (" 34 ", "METHODS 12", "12 body", "12 甲")] == ["", "METHODS", "body", "12 甲"]
    assert [residual(t, "x") for t in ("34", "METHODS 12", "12 body")] == ["", "METHODS 12", "12 body"]
    assert one(spark, "abcdefg", X.hard_slices("t", 3))[0] == ["abc", "def", "g"] and one(spark, "", X.hard_slices("t", 3))[0] == []
    assert one(spark, "一\n \n　二  三", X.paragraphs("t"))[0] == ["一", "二 三"]
    assert one(spark, (10, 9, 6000), X.extractability("a", "b", "c"), schema="a int, b int, c int")[0] == "ok"
    assert one(spark, (10, 2, 6000), X.extractability("a", "b", "c"), schema="a int, b int, c int")[0] == "ocr_required"
    assert one(spark, ("v", ["a", "b"], "t"), X.retrieval_text("v", "p", "t"), schema="v string, p array<string>, t string")[0] == "主题：v\n章节：a > b\nt"


def test_nulls_stay_null(spark):
    row = one(spark, (None,), *[f("t") for f in (X.squeeze, X.margin_signature, X.strip_line_numbers, X.one_line, X.compact_cjk, X.normalize_heading, X.sentences_any, X.text_hash)])
    assert all(v is None for v in row)
    assert one(spark, (None,), X.says_insufficient("t"))[0] is False
