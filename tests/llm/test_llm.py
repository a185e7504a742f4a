import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, canon, pack, pairs, reading, scan, sentences, split, topn
from quern.llm.language import language

VOCABULARY = bpe.default_tokenizer_path("byte_bpe_50k.tiktoken")


# --- tokens


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(VOCABULARY, bpe.pattern_source())


def test_tokens_equal_the_library(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(7)
    alphabet = "aeiou tns'rd  lh\n\t.,;0159膝痛关节。，！“”éß😀ँक์​\xa0　_-<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(1500)]
    texts += ["<|endoftext|>", "a" * 3000, "的" * 2000, " \n \n  x", "x  y   z", "。”，a", "don't they'LL", "、。，。，", "end. Next\n\nNext，。_x"]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert [i for ids in encoder.encode(text) for i in ids] == want.ids, repr(text)


def test_tokens_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "knee", "y"), (3, "knee", "y"), (None, "a b", None)], "doc_id long, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in bpe.encode_texts(df, "doc_id", "text").collect()]
    assert (1, []) in got and (2, []) in got and got.count(got[2]) == 2 and len(got) == 5
    assert bpe.encode_texts(df.where("false"), "doc_id", "text").count() == 0
    n = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, "doc_id", "text").collect()}
    assert n[1] == n[2] == 0 and n[3] == len(got[2][1])


def test_memory_bound_changes_nothing(encoder, monkeypatch):
    text = "Walk a little each day. 每天走一走，药要饭后吃。"
    a = encoder.encode(text)
    monkeypatch.setattr(bpe, "MEMORY_STRETCHES", 0)
    assert sum(encoder.encode(text), []) == sum(a, [])


# --- containers


def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, None, rng.randint(1, 300), rng.randint(200, 2500), 100, 9000])) for i in range(2000)]
    df = spark.createDataFrame(rows + rows[:50], "id long, size long").withColumn("bucket", F.lit("x"))
    out = pack.pack(df, "id", "size", 1000).collect()
    used, by = defaultdict(int), defaultdict(list)
    for r in out:
        used[r.container_id] += r.n_tokens
        by[r.id].append((r.part_no, r.token_from, r.n_tokens))
    assert max(used.values()) <= 1000
    for i, n in rows:
        parts = sorted(by.get(i, []))
        assert sum(p[2] for p in parts) == (n or 0)
        assert len(parts) == (0 if not n else -(-n // 1000))
    assert sum(used.values()) / (len(used) * 1000) > 0.97
    assert pack.pack(df.where("false"), "id", "size").count() == 0


def test_fill_keeps_capacity():
    rng = random.Random(9)
    for _ in range(200):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(0, 60))]
        used = defaultdict(int)
        for s, w in zip(sizes, pack.harmonic_fill(sizes, 50)):
            used[w] += s
        assert all(v <= 50 for v in used.values())


# --- top n


def brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g, i] = max(s, best.get((g, i), -float("inf")))
    by = defaultdict(list)
    for (g, i), s in best.items():
        by[g].append((-s, i.encode()))
    return {(g, k + 1, i.decode()) for g, v in by.items() for k, (_, i) in enumerate(sorted(v)[:n])}


@pytest.mark.parametrize("seed", [1, 2])
def test_top_n_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"chunk-{i:04d}" for i in range(400)] + ["a", "ab", "abc", "é", "痛", "痛痛", "chunk-0001x" * 5, ""]
    rows = [(f"g{rng.randint(0, 6)}", rng.choice(names), rng.choice([0.5, 0.25, rng.random(), None, float("nan"), -0.0, 0.0, float("inf"), 1e300, -1e300])) for _ in range(1500)]
    rows += [("hot", rng.choice(names), 0.5) for _ in range(1500)] + [(None, "a", 1.0), ("g1", None, 1.0), ("one", "a", float("-inf"))]
    df = spark.createDataFrame(rows + rows[:100], "g string, i string, s double").withColumn("rank", F.lit(1)).withColumn("salt", F.lit("x")).withColumn("bin", F.lit(0))
    got = {tuple(r) for r in topn.top_n(df, "g", "i", "s", 10).collect()}
    assert got == brute_top(rows, 10)


def test_top_n_empty(spark):
    df = spark.createDataFrame([], "g string, i string, s double")
    assert topn.top_n(df, "g", "i", "s", 3).count() == 0


def test_top_n_hot_group_is_salted(spark, monkeypatch):
    monkeypatch.setattr(topn, "ROWS_PER_SALT", 1000)
    df = spark.range(30_000).select(F.lit("hot").alias("g"), F.col("id").cast("string").alias("i"), (F.col("id") % 7).cast("double").alias("s"))
    want = sorted(str(x) for x in range(30_000) if x % 7 == 6)[:5]
    for few in (100, 0):  # hot groups broadcast, and joined
        monkeypatch.setattr(topn, "BROADCAST_GROUPS", few)
        assert [r.i for r in topn.top_n(df, "g", "i", "s", 5).orderBy("top_rank").collect()] == want


def test_top_n_scores_over_all_magnitudes(spark):
    rng = random.Random(6)
    rows = [("g", f"c{i}", rng.choice([-1, 1]) * 10.0 ** rng.randint(-320, 307) * rng.random()) for i in range(800)]
    rows += [("g", f"x{i}", s) for i, s in enumerate([5e-324, -5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), 0.0, -0.0])]
    for n in (3, 300):
        got = {tuple(r) for r in topn.top_n(spark.createDataFrame(rows, "g string, i string, s double"), "g", "i", "s", n).collect()}
        assert got == brute_top(rows, n)


# --- same look


def test_canonical_forms():
    same = ["Knee pain", "Ｋｎｅｅ ｐａｉｎ", "Knee　pain", "Kn​ee pain", "Кnеe раin", "K­nee pain"]
    assert {canon.canonical(x) for x in same} == {"Knee pain"}
    assert canon.canonical("é") == canon.canonical("é") == "é" and canon.canonical("ﬁ") == "fi"
    assert canon.canonical("ロ服") == "口服" and canon.canonical("ロボット") == "ロボット"
    assert canon.canonical("follow‑up") == "follow-up"
    assert len({canon.canonical(x) for x in ["Knee", "knee", "Knée", "Knee1", "Knee2"]}) == 5


def test_rare_scripts_look_like_latin():
    assert canon.canonical("ꓮꓐ Ꭺ ո Ⲟ") == "AB A n O"
    assert canon.canonical(canon.canonical("ꓮꭰո")) == canon.canonical("ꓮꭰո")


def test_canonical_is_stable_and_splices_as_whole():
    rng = random.Random(4)
    pool = "aeKоАе́̈​ 　，．ｋﬁ痛カ力ㅎ각각ำเक़्!-–—"
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        c = canon.canonical(t)
        assert canon.canonical(c) == c, (t, c)


def test_same_look_pairs(spark):
    rows = [("b", "Knee pain"), ("a", "Knee pain"), ("c", "Knee pain"), ("d", "other"), ("d", "other"), ("e", None), ("f", " "), ("g", "​"), (None, "Knee pain"), ("h", "knee pain")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("look", F.lit(1)).withColumn("form", F.lit(2))
    assert {tuple(r) for r in canon.same_look_pairs(df, "id", "text").collect()} == {("a", "b"), ("a", "c")}
    assert canon.same_look_pairs(df.where("false"), "id", "text").count() == 0


def test_same_look_hot_group(spark):
    df = spark.range(400).select(F.format_string("%04d", "id").alias("id"), F.when(F.col("id") < 3, "a b").otherwise("a b").alias("text"))
    assert canon.same_look_pairs(df, "id", "text").count() == 3 * 397


def test_same_look_classes(spark):
    rows = [("b", "Knee pain"), ("a", "Ｋnee pain"), ("c", "Ｋnee pain"), ("d", "other"), ("e", None), ("b", "Knee pain")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("parts", F.lit(1))
    assert {tuple(r) for r in canon.same_look_classes(df, "id", "text").collect()} == {("a", "a", "a", 1), ("c", "a", "a", 1), ("b", "a", "b", 2)}
    assert canon.same_look_classes(df.where("false"), "id", "text").count() == 0
    # One look holds more rows than a part: pairs and membership say the same.
    many = spark.range(300).select(F.format_string("%04d", "id").alias("id"), F.when(F.col("id") % 3 == 0, "a b").when(F.col("id") % 3 == 1, "a\u00a0b").otherwise("a\u3000b").alias("text"))
    assert canon.same_look_pairs(many, "id", "text").count() == sum(r.links for r in canon.same_look_classes(many, "id", "text").collect()) // 2 == 3 * 100 * 100


# --- sentences


def cut(text):
    ends = sentences.sentence_ends(text)
    return [text[a:b].strip() for a, b in zip([0, *ends], ends)]


@pytest.mark.parametrize(
    "whole",
    [
        ["Pain was scored by approx. 4 raters, e.g. nurses.", "See Fig. 1 and Sect. 7.93 for details.", "It closes at 6 p.m.", "Then go home."],
        ["“Does the knee lock?” is the first question.", "The panel asked: “Is imaging needed?”", "pH was 7.4 in 3 samples.", "mRNA fell by 2.5%."],
        ["Walking aids include sticks, frames, etc.", "Was the dose reduced?!", "Form No. 64 (ver. 2.1.6) replaced it.", "It started after the age of 66.", "Regular exercise helps."],
        ["The review covered 1. pain, 2. fatigue and 3. effects.", "St. Alder clinic agreed."],
        ["“夜间疼痛明显吗？”是首诊时常用的问题。", "专家组提问：“首诊是否需要拍片？”", "专科随访时复查。", "疼痛时轻时重……5天后自行缓解。", "能否停用？！", "与分级无关.", "剂量由7.6 mg调整。"],
        ["治疗顺序为：1. 运动锻炼；2. 控制体重；3. 口服药。", "（A vs. B）评分下降6.9分；差异仍需验证。"],
        ["「夜も痛みますか？」と尋ねることが大切である。", "歩行時の痛みが続く。"],
        ["Am 9. Tag ließ die Steifigkeit nach.", "Wärme, Bewegung usw. lindern; Ruhe hilft kaum.", "Ca. 43 % der Befragten, z. B. Ältere."],
        ["¿Cuándo empezó el síntoma?", "Se recomienda, p. ej. por la mañana.", "¡No suspenda la medicación!"],
        ["लगभग 93.1 प्रतिशत रोगियों को लाभ हुआ।", "क्या दर्द होता है?"],
    ],
)
def test_sentences(whole):
    sep = "" if sentences.CJK.search(whole[0]) else " "
    assert cut(sep.join(whole)) == whole


def test_sentence_cases():
    assert cut("หากอาการไม่ดีขึ้น ควรพบแพทย์ หมายเลข275") == ["หากอาการไม่ดีขึ้น", "ควรพบแพทย์", "หมายเลข275"]
    assert cut("") == cut(" \n​") == []
    assert cut("no mark at all \n") == ["no mark at all"]
    assert cut("selected\npatients.In primary care，下降6.\n9分。") == ["selected\npatients.", "In primary care，下降6.\n9分。"]


def test_chunked_transducer_equals_whole():
    rng = random.Random(8)
    pool = ["“", "”", "。", ". ", "? ", "词语", "word ", "Word ", "：", "「", "」", "etc. ", "3.5 ", "\n", "(", ") "]
    for _ in range(400):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(1, 120)))
        assert sentences.sentence_ends(t, 20) == sentences.sentence_ends(t), repr(t)


def test_quotations_of_any_length():
    for n in (2, 30, 300):
        inner = "".join(f"Part {i} hurts. " for i in range(n)).strip()
        for a, b in ("“”", '""', "「」"):
            t = f"They said: {a}{inner}{b}, and that was all. Next one."
            assert len(cut(t)) == 2, (n, a)
    assert len(cut("A “ never closed. It goes on. “Here it is.” End.")) == 4
    assert cut('It measures 5" now. Then "all is well" again. Done.')[-1] == "Done."


def test_prefix_scan_against_a_loop():
    rng = random.Random(3)
    for n in range(1, 40):
        f = [[rng.randrange(5) for _ in range(5)] for _ in range(n)]
        state, want = 0, []
        for g in f:
            want.append(state)
            state = g[state]
        assert sentences.compose(f) == want


def test_long_documents_are_split_over_rows(spark, monkeypatch):
    monkeypatch.setattr(sentences, "CHUNK", 50)
    rng = random.Random(12)
    pool = ["“", "”", "。", ". ", "? ", "词语", "word ", "Word ", "：", "「", "」", '"', "etc. ", "3.5 ", "\n", "ปวดเข่า ", "\u200b"]
    rows = [(i, "".join(rng.choice(pool[: rng.choice([15, 17])]) for _ in range(rng.randint(1, 200)))) for i in range(150)]
    df = spark.createDataFrame(rows + rows[:20] + [(1, rows[0][1]), (None, rows[2][1])], "id long, text string")
    got = {(r.id, tuple(r.ends)) for r in sentences.split_sentences(df, "id", "text").collect()}
    want = {(i, tuple(sentences.sentence_ends(t, 10**9))) for i, t in rows + [(1, rows[0][1]), (None, rows[2][1])]}
    assert got == {(i, e) for i, e in want if e}


def test_split_sentences_table(spark):
    df = spark.createDataFrame([("a", "One. Two.", False), ("a", "One. Two.", False), ("b", None, False), ("c", " ", True), ("h", "Heading. Still", True), (None, "x", False)], "id string, text string, h boolean").withColumn("ends", F.lit(0))
    got = {(r.id, tuple(r.ends)) for r in sentences.split_sentences(df, "id", "text", "h").collect()}
    assert got == {("a", (4, 9)), ("h", (14,)), (None, (1,))}


# --- splitting


def test_pieces():
    rng = random.Random(6)
    for _ in range(500):
        t = "".join(rng.choice("ab 。.\n痛") for _ in range(rng.randint(1, 300)))
        limit, overlap = rng.randint(1, 50), rng.randint(0, 60)
        p = split.split_text(t, [0, len(t) // 2], limit, overlap)
        assert p[0][0] == 0 and p[-1][1] == len(t) and all(0 < e - s <= limit for s, e in p)
        assert all(a < x <= b < y for (a, b), (x, y) in zip(p, p[1:]))


def test_pieces_at_natural_places():
    text = "\n".join(["Sentence one is here. Sentence two is here."] * 20)
    units = [i * 44 for i in range(20)]
    p = split.split_text(text, units, 200, 44)
    assert all(s in units for s, _ in p)


def test_split_sections(spark):
    u = "array<struct<text string, page_start int, page_end int, unit_type string>>"
    long = "词" * 25
    rows = [("big", "v", [("句子。" * 5, 1, 1, "body"), (None, 1, 1, "body"), ("", 1, 1, "body")]), ("big", "v", [("句子。" * 5, 1, 1, "body"), (None, 1, 1, "body"), ("", 1, 1, "body")]), ("unit", "v", [("a", 1, 1, "body"), (long, 1, 1, "body")]), ("fits", "v", [("0123456789", 1, 1, "body")]), ("none", "v", []), ("null", "v", None), ("other", "w", [(long, 1, 1, "body")])]
    df = spark.createDataFrame(rows, f"section_id string, corpus_version string, units {u}").withColumn("limit", F.lit("x"))
    config = spark.createDataFrame([("v", 10, 3), ("z", None, None)], "corpus_version string, max_chars int, overlap_chars int")
    out = split.split_sections(df, config).collect()
    got = {r.section_id: r for r in out}
    assert set(got) == {"big", "unit"} and got["big"].size == 17
    assert all(len(p.text) <= 10 for r in out for p in r.pieces)
    assert split.split_sections(df.where("false"), config).count() == 0


# --- pairs


def test_pair_rules():
    assert all(pairs.is_empty(x) for x in [None, "", " \n", "​", "N/A", "无", "答：", "```\n```", "[]", "……", "Answer:", "<p></p>", "-"])
    assert not any(pairs.is_empty(x) for x in ["Yes.", "可以。", "7", "不推荐。"])
    q = "病例OA-1：口服抗炎药的疗程一般是多久？"
    assert all(pairs.is_copy(q, x) for x in [q, q + q, "问题：" + q, f"**{q}**", "口服抗炎药的疗程一般是多久？", f"您的问题是“{q}”。", f"Q: {q}\nA:"])
    assert pairs.is_copy("多久？要不要拍片？", "您的问题是“多久？要不要拍片？”。") and pairs.is_copy("Ref. НK-1, Which exеrcise helps?", "ref. нk-1, which exеrcise helps?")
    assert not pairs.is_copy(q, f"关于“{q}”，一般为8周。") and not pairs.is_copy(None, "x")
    assert all(pairs.is_refusal(x) for x in ["抱歉，我无法回答这个问题，请联系您的主治医生。", "根据现有证据，资料里看不到可用的依据，请以面诊意见为准。", "Unfortunately, I am unable to help with that request, so kindly contact your clinic.", "It is not possible to say whether this is suitable, and a doctor should be consulted."])
    assert all(pairs.is_refusal(x) for x in ["这类问题应由专科医师判断，恕不作答。", "很遗憾，这个问题我不作评论。", "The evidence is insufficient to answer this.", "Sorry, that is best decided by a specialist and I would rather not comment.", "This lies beyond what I can discuss. Please see a professional."])
    assert not any(pairs.is_refusal(x) for x in ["不推荐。", "虽然证据中未提及具体剂量，但热敷可以放松肌肉，冷敷则能减轻肿胀。", "The dose is not mentioned; however, the advice is clear. Exercise for 12 weeks helps most people."])
    assert pairs.is_foreign("膝痛怎么办？", "Exercise is advised for the knee.") and pairs.is_foreign("What helps?", "Die Schmerzen treten vor allem beim Gehen auf.")
    assert not pairs.is_foreign("膝痛怎么办？", "原文表述为“Rest and then move again.”建议锻炼。") and not pairs.is_foreign("膝痛怎么办？", "NSAID")


def test_what_gives_a_truncated_answer_away(spark):
    whole = "药物甲与凝胶联合应用时，须记录评估结果。Use ice, and rest the joint for a week."
    rows = [("r", str(i), "怎么办？", "answerable", a) for i, a in enumerate([whole, "药物甲与凝胶联合应", "药物丁与凝胶合并应用时，须记录评", "全新的一句话没有说完就", "1. 锻炼\n2. (", "锻炼"])]
    df = spark.createDataFrame(rows, "run_id string, query_id string, query string, answerability string, answer string")
    assert {(x.query_id, x.rule) for x in pairs.broken_pairs(df).collect()} == {("1", "prefix"), ("2", "clause_prefix"), ("3", "no_end_mark"), ("4", "open_end")}
    spike = [("r", f"s{i}", "怎么办？", "answerable", chr(0x4E00 + i) * 5) for i in range(12)]
    got = {(x.query_id, x.rule) for x in pairs.broken_pairs(spark.createDataFrame(rows + spike, df.schema)).collect()}
    assert {(f"s{i}", "length_limit") for i in range(12)} <= got
    foreign = spark.createDataFrame([("r", "1", "怎么办？", "unanswerable", "The evidence is insufficient to answer this question."), ("r", "2", "怎么办？", "unanswerable", "现有证据不足，无法回答。")], df.schema)
    assert [(x.query_id, x.defect_type) for x in pairs.broken_pairs(foreign).collect()] == [("1", "other_language")]


def test_long_closing_quotation():
    assert pairs.segments("It says “rest often" + " and often" * 100 + "”")[2]
    assert not pairs.segments("It says “rest often" + " and often" * 100)[2]


def test_broken_pairs(spark):
    whole = "Exercise helps most people with knee pain."
    rows = [("r", "1", "Q one?", "answerable", whole), ("r", "1", "Q one?", "answerable", whole), ("r", "2", "Q two?", "answerable", "Rest. Exercise helps most peo"), ("r", "3", "Q three?", "answerable", "Tips:\n1. rest well\n2. walk a lot"), ("r", "4", "Q four?", "answerable", "Tips:\n1. walk a lot\n2. rest w")]
    rows += [("r", "5", "Q five?", "answerable", None), ("r", "6", "Q six?", "unanswerable", "I cannot answer this question."), ("r", "7", None, "answerable", "I cannot answer this question."), ("r", "8", "Q?", None, whole + "[1][3]"), ("r", "9", "Q?", "answerable", "It says “rest often”")]
    df = spark.createDataFrame(rows, "run_id string, query_id string, query string, answerability string, answer string").withColumn("defect", F.lit(1)).withColumn("n", F.lit(1))
    got = {(r.query_id, r.defect_type) for r in pairs.broken_pairs(df).collect()}
    assert got == {("2", "truncated"), ("4", "truncated"), ("5", "empty"), ("7", "refusal")}
    assert pairs.broken_pairs(df.where("false")).count() == 0


def test_continued_against_brute_force(spark):
    rng = random.Random(2)
    texts = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(200)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.continued for r in pairs.continued(df, "t").collect()}
    assert got == {t: any(o != t and o.startswith(t) for o in texts) for t in texts}


# --- scans


def test_trie_retrieval_is_complete():
    rng = random.Random(1)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))): 1 for _ in range(150)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(row[j] if x == y else 1 + min(row[j], row[j + 1], new[j]))
            row = new
        return row[-1]

    trie = scan.Trie(words)
    for w in ["abc", "aabbcc", "", "cab"]:
        for k in (0, 1, 2):
            assert {x for x, _ in trie.within(w, k)} == {x for x in words if distance(w, x) <= k}


def test_confusions():
    assert scan.confusion_at("aclverse", "adverse") == 1 and scan.confusion_at("wa1king", "walking") == 2 and scan.confusion_at("prograrnmes", "programmes") is not None
    assert scan.confusion_at("nurse", "purse") is None


def test_page_numbers():
    assert scan.page_number("[4O]") == (40, True) and scan.page_number("第 12 页")[0] == 12 and scan.page_number("- 7 -") == (7, True) and scan.page_number("iv") == (None, True) and scan.page_number("231") == (231, False)
    assert scan.page_number("A组  38  58") is None and scan.page_number("days.") is None


def test_repair(spark):
    body = ["Structured exercise helps adults with knee pain and stiffness in the morn-", "ing after a long-", "term rest. The long-term plan is walking in the morning every day of the week,", "and adults walk with care because walking helps and knee pain fades after weeks."]
    rng = random.Random(1)
    own = lambda: " ".join("".join(rng.choice("bdgkmprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(9)) + "."
    page = lambda p, lines, number: "\n".join([f"Journal of joints 20{p:02d}", own(), own(), *lines, own(), own(), number])
    rows = [(f"s-{p}", "s", "Guideline on the knee", p, page(p, body, f"- {p + 100} -")) for p in range(1, 31)]
    bad = page(31, [body[0], body[1], body[2].replace("walking", "wa1king"), body[3]], "- l31 -")
    rows += [("s-31", "s", None, 31, bad), ("s-31", "s", None, 31, bad), ("s-32", "s", None, 32, None), ("s-33", None, None, 33, " "), ("u#0", None, None, None, "Plain unit with knee pain.\n17")]
    df = spark.createDataFrame(rows, "record_id string, source_id string, title string, page int, text string").withColumn("headers", F.lit(1)).withColumn("offset", F.lit(1))
    got = {r.record_id: ({(d.line_no, d.noise) for d in r.damage}, r.repaired) for r in scan.repair_scans(df).collect()}
    assert got["s-31"][0] == {(0, "running_header"), (3, "hyphen_break"), (5, "misread_char"), (9, "page_number")}
    assert got["s-1"][0] == {(0, "running_header"), (3, "hyphen_break"), (9, "page_number")}
    assert "morning after a long-term rest. The long-term plan is walking" in got["s-31"][1]
    assert got["u#0"][0] == set() and set(got) == {f"s-{p}" for p in range(1, 32)} | {"u#0"}
    assert scan.repair_scans(df.where("false")).count() == 0


def test_repair_does_not_depend_on_repetition(spark):
    texts = [f"Adults should walk for {n} weeks. The 6th visit is late (95 CI 10 to 20; I2 = {n} with care)." for n in range(10, 60)]
    texts += ["Adults sh0uld walk for 4O weeks. The 6th visit is late."]

    def damage(times):
        df = spark.createDataFrame([(f"{t}-{i}", x) for t in range(times) for i, x in enumerate(texts)], "record_id string, text string")
        df = df.select("record_id", F.lit("s").alias("source_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("page"), "text")
        return {(r.record_id.split("-")[1], d.line_no, d.noise) for r in scan.repair_scans(df).collect() for d in r.damage}, {r.record_id.split("-")[1]: r.repaired for r in scan.repair_scans(df).collect()}

    once, often = damage(1), damage(10)
    assert once == often and once[0] == {("50", 0, "misread_char")} and once[1]["50"].startswith("Adults should walk for")


def test_letters_in_numbers():
    texts = [f"Walk again within {n} weeks (grade {n % 9 + 1}B evidence), then rest; CI 10 to 20; I2 = {n}." for n in range(40, 60)] * 9
    counts = defaultdict(Counter)
    for x in texts:
        scan.count_tokens([x], {}, counts)
    vocabulary = scan.Vocabulary(**{k: dict(c) for k, c in counts.items()}).prepare()
    damaged = lambda x: scan.repair(x, {}, vocabulary)[0] == [(0, "misread_char")]
    assert all(damaged(f"Walk again within {n} weeks.") for n in ("4S", "S9", "S0", "4g", "4O", "4l"))
    assert not any(damaged(x) for x in ("Walk again within 45 weeks.", "Rest (grade 5B evidence), then rest; CI 10 to 20; I2 = 45.", "Kept at S5 here."))


# --- reading level


def test_reading_levels(spark):
    easy, hard = "Walk a little each day and rest if the knee hurts you. ", "Heterogeneity of the pooled estimates was explored by meta-regression models of the trials. "
    docs = [(i, (easy if i % 2 else hard) * (1 + i % 3), "zz") for i in range(40)] + [(100, None, "en"), (101, " ", "en"), (102, "膝の痛みは階段で強くなる。", "zh"), (103, "Die Schmerzen treten vor allem beim Gehen auf.", "en"), (104, easy, None), (None, easy, "en")]
    d = spark.createDataFrame(docs, "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(f"l{i}", i, "r", 1 if i % 2 else 4) for i in range(30)] + [("x", 3, "r", None), ("y", 999, "r", 2), ("l1", 1, "r", 1), ("z", 5, "q", 9)], "label_id string, doc_id long, rater string, grade int")
    model = reading.fit(d, labels)
    got = {r.doc_id: r.grade for r in reading.reading_levels(d, model).collect()}
    assert set(got) == set(range(40)) | {104} and all(got[i] == (1 if i % 2 else 4) for i in range(40)) and got[104] == 1
    nothing = reading.fit(d, labels.where("false"))
    assert reading.reading_levels(d, nothing).count() == 0 and reading.reading_levels(d.where("false"), model).count() == 0


def test_languages():
    cases = {"zh": "膝骨关节炎是常见病，NSAID可用。", "en": "The knee is a joint that hurts.", "ja": "膝の痛みが続く場合は医師に相談する。", "de": "Die Schmerzen sind nicht stark.", "es": "El dolor aumenta al caminar.", "th": "ควรพบแพทย์", "hi": "वज़न कम करने से लाभ हुआ।", "": "12 % …"}
    assert {k: language(v) for k, v in cases.items()} == {k: k for k in cases}
