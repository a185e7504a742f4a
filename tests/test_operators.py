import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import chunking, corpus, filters, generation, layout, quality, retrieval, sampling
from quern.plans import queries as core
from quern.sources import config, io


@pytest.mark.parametrize("block", [2048, 2])
def test_bm25_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "DOCUMENTS_PER_BLOCK", block)
    monkeypatch.setattr(retrieval, "QUERIES_PER_BLOCK", block)
    docs = {"d1": "膝痛 exercise", "d2": "膝痛 膝痛", "d3": "exercise exercise plan", "d4": "", "d0": "none of it"}
    queries = {"q1": "膝痛 exercise", "q2": "nothing here", "q3": "plan plan"}

    def tok(t):
        out = []
        for w in t.split():
            out += list(w) + [w[i : i + 2] for i in range(len(w) - 1)] if w[0] > "⿿" else [w]
        return out

    d = {k: Counter(tok(v)) for k, v in docs.items()}
    size = {k: sum(c.values()) for k, c in d.items()}
    mean = sum(size.values()) / len(size)
    df = Counter(t for c in d.values() for t in c)
    want = {}
    for q, text in queries.items():
        s = {k: sum(n * math.log(1 + (len(d) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * size[k] / mean)) for t, n in Counter(tok(text)).items() if c[t]) for k, c in d.items()}
        want[q] = [(k, round(s[k], 9)) for k in sorted(s, key=lambda k: (-round(s[k], 12), k))[:4]]
    dd = spark.createDataFrame(list(docs.items()), "id string, text string")
    qq = spark.createDataFrame(list(queries.items()), "query_id string, query string")
    got = {}
    for r in retrieval.bm25_topk(dd, "id", F.col("text"), qq, "query_id", "query", 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 9)))
    assert got == want


@pytest.mark.parametrize("block", [2048, 2])
def test_bm25_scores_of_all_pairs_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "DOCUMENTS_PER_BLOCK", block)
    monkeypatch.setattr(retrieval, "QUERIES_PER_BLOCK", block)
    monkeypatch.setattr(retrieval, "ROWS_PER_BATCH", 3)
    docs = [("d1", "a b"), ("d2", "a a c"), ("d2", "b"), ("d3", ""), ("d4", None), (None, "a e"), ("d5", "e"), ("d6", "f")]
    queries = [("q1", "a b"), ("q2", "c c z"), ("q3", "z"), ("q4", "a"), ("q4", "a e"), ("q5", None), (None, "a")]
    bags = [(i, Counter((t or "").split())) for i, t in docs]
    df, mean = Counter(t for _, c in bags for t in c), sum(c.total() for _, c in bags) / len(bags)
    asked = {}
    for q, t in queries:
        asked.setdefault(q, Counter()).update((t or "").split())
    want = {}
    for q, terms in asked.items():
        for i, c in bags:
            for t in terms.keys() & c.keys() if q and i else ():
                score, n = want.get((q, i), (0, 0))
                want[q, i] = (score + terms[t] * math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean)), n + 1)
    dd, qq = spark.createDataFrame(docs, "id string, text string"), spark.createDataFrame(queries, "query_id string, query string")
    for expected in (None, 1, 1000):
        got = retrieval.bm25_scores(dd, "id", F.col("text"), qq, "query_id", "query", expected=expected).collect()
        assert len(got) == len(want) and {(r.query_id, r.id): (round(r.score, 9), r.terms) for r in got} == {k: (round(s, 9), n) for k, (s, n) in want.items()}
    assert retrieval.bm25_scores(dd.where("false"), "id", F.col("text"), qq, "query_id", "query").count() == 0
    assert retrieval.bm25_scores(dd, "id", F.col("text"), qq.where("false"), "query_id", "query").count() == 0


def test_bm25_term_join_sends_no_table_to_the_driver(spark, tmp_path):
    """Spark guesses postings to be smaller than their texts; under its own threshold it broadcast them all."""
    d = str(tmp_path)
    spark.createDataFrame([(f"c{i}", ["t"], f"title {i}", f"word{i} shared") for i in range(50)], "chunk_id string, title_path array<string>, display_title string, text string").write.parquet(f"{d}/gold_corpus.parquet")
    spark.createDataFrame([(f"q{i}", "shared word7") for i in range(0, 60, 10)], "query_id string, query string").write.parquet(f"{d}/retrieval_eval.parquet")
    df = core.bm25_term_join(spark, d)
    assert len(rows := df.collect()) == 150 and {r.terms for r in rows if r.chunk_id == "c7"} == {2}
    plan = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in plan and "BroadcastHashJoin" not in plan


def test_dense_blocks_agree(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [(40, [0.0] * 4), (41, None)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.where("id % 20 = 0 AND id < 40").select(F.col("id").alias("q"), F.col("v").alias("w"))
    a = retrieval.dense_topk(v, "id", "v", q, "q", "w", 5, True).collect()
    monkeypatch.setattr(retrieval, "QUERIES_PER_BLOCK", 1)
    monkeypatch.setattr(retrieval, "DOCUMENTS_PER_BLOCK", 7)
    b = retrieval.dense_topk(v, "id", "v", q, "q", "w", 5, True).collect()
    assert sorted(a) == sorted(b) and len(a) == 10
    unit = lambda x: [y / math.sqrt(sum(z * z for z in x)) for y in x]
    best = sorted((-round(sum(x * y for x, y in zip(unit(rows[0][1]), unit(r[1]))), 9), r[0]) for r in rows[1:40])[:5]
    assert [r.id for r in sorted(a, key=lambda r: r.rank) if r.query_id == 0] == [i for _, i in best]


def test_different_questions_are_refused(spark):
    run = lambda *ids: spark.createDataFrame([(i, 1, "c", 1.0) for i in ids], "query_id string, rank int, id string, score double")
    with pytest.raises(ValueError, match="different questions"):
        retrieval.rrf(run("q1"), run("q1", "q2"))
    with pytest.raises(ValueError, match="different questions"):
        retrieval.rrf(run("q1"), run("q1"), questions=run("q2"))
    ranks = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "query_id string, first_gold_rank int")
    with pytest.raises(ValueError, match="different questions"):
        retrieval.compare_three({"a": ranks("q1"), "b": ranks("q1"), "c": ranks("q2")})
    frozen = spark.createDataFrame([("q1", ["a"]), ("q2", None)], "query_id string, gold array<string>")
    assert retrieval.require_frozen(frozen.orderBy(F.col("query_id").desc()).union(frozen), retrieval.frozen_hash(frozen)) is not None
    with pytest.raises(ValueError, match="not the frozen one"):
        retrieval.require_frozen(frozen.where("query_id = 'q1'"), retrieval.frozen_hash(frozen))


def test_rrf_ties_and_one_sided(spark):
    s = "query_id string, rank int, id string, score double"
    a = spark.createDataFrame([("q", 1, "x", 1.0), ("q", 2, "y", 0.5), ("q", 11, "deep", 0.1)], s)
    b = spark.createDataFrame([("q", 1, "z", 1.0), ("q", 2, "x", 0.5)], s)
    r = retrieval.rrf(a, b).orderBy("rank").collect()
    assert [(x.id, x.first_rank, x.second_rank) for x in r] == [("x", 1, 2), ("z", None, 1), ("y", 2, None)]
    assert r[0].score == round(1 / 61 + 1 / 62, 9)


def test_published_ranks_give_published_metrics(spark):
    # Ranks of the first gold chunk of eleven answerable questions and one that is not, in two runs.
    runs = {"bm25": ([1] * 8 + [7, 2, None], 0.785714 * 0 + round((8 + 1 / 7 + 1 / 2) / 11, 6)), "dense": ([1] * 9 + [3, 2], round((9 + 1 / 3 + 1 / 2) / 11, 6))}
    for ranks, mrr in runs.values():
        bench = spark.createDataFrame([(f"q{i}", "answerable", ["g"], []) for i in range(11)] + [("q11", "unanswerable", [], [])], "query_id string, answerability string, gold_chunk_ids array<string>, supporting_chunk_ids array<string>")
        res = spark.createDataFrame([(f"q{i}", r, "g", 1.0) for i, r in enumerate(ranks) if r] + [("q11", 1, "n", 1.0)], "query_id string, rank int, id string, score double")
        m = retrieval.run_metrics(retrieval.query_metrics(res, bench)).first()
        assert m.mrr == mrr and m.answerable == 11 and m.hit_at_1 == round(ranks.count(1) / 11, 6)


def test_comparisons(spark):
    s = "query_id string, first_gold_rank int"
    a, b, c = (spark.createDataFrame([("q1", x), ("q2", y), ("q3", None)], s) for x, y in ((1, 3), (2, 1), (1, 1)))
    two = {r.query_id: (r.rank_delta, r.winner) for r in retrieval.compare_two(a, b).collect()}
    assert two == {"q1": (-1, "bm25"), "q2": (2, "dense"), "q3": (None, "tie")}
    three = {r.query_id: r.winners for r in retrieval.compare_three({"bm25": a, "dense": b, "rrf": c}).collect()}
    assert three == {"q1": "bm25|rrf", "q2": "dense|rrf", "q3": "bm25|dense|rrf"}
    with pytest.raises(ValueError):
        retrieval.require_same_queries(a, b.where("query_id = 'q1'"))


def test_two_columns(spark):
    rows = [("s", 1, n, x0, x1, y0, y1, 100.0) for n, x0, x1, y0, y1 in [(1, 0, 100, 0, 10), (2, 55, 95, 12, 20), (3, 5, 45, 12, 20), (4, 5, 45, 22, 30), (5, 0, 100, 40, 50), (6, 55, 95, 60, 70), (7, 5, 45, 60, 70)]]
    b = spark.createDataFrame([(*r[:3], float(r[3]), float(r[4]), float(r[5]), float(r[6]), r[7], "t") for r in rows], "source_id string, page int, block_no int, x0 double, x1 double, y0 double, y1 double, page_width double, text string")
    assert [r.block_no for r in layout.two_column_order(b).orderBy("position").collect()] == [1, 3, 4, 2, 5, 7, 6]
    alone = b.where("block_no IN (2, 3)")
    assert [r.block_no for r in layout.two_column_order(alone).orderBy("position").collect()] == [3, 2]


def test_margins(spark):
    rows = [("s", p, n, t, y0, y0 + 10.0, 1000.0) for p in range(1, 5) for n, (t, y0) in enumerate([(f"Journal, page {p}", 0.0), (f"body {p}", 500.0), (str(p), 950.0)])]
    b = spark.createDataFrame(rows, "source_id string, page int, block_no int, text string, y0 double, y1 double, page_height double")
    assert {r.signature for r in layout.repeated_margins(b).collect()} == {"journal, page #", "#"}
    assert {r.text for r in layout.drop_margins(b).collect()} == {f"body {p}" for p in range(1, 5)}


def test_pack_keeps_all_atoms():
    rng = random.Random(2)
    for _ in range(500):
        n = [rng.randint(1, 50) for _ in range(rng.randint(0, 25))]
        lead, fixed = rng.choice([0, 7]), rng.randint(0, 1)
        got = chunking.pack_with_overlap(n, 40, rng.choice([0, 10]), lambda at: lead, fixed)
        width = lambda a, b: lead + sum(n[a:b]) + 2 * (b - a - 1)
        assert [x for a, b in got for x in range(a, b)] == sorted(x for a, b in got for x in range(a, b)) or all(b[0] <= a[1] for a, b in zip(got, got[1:]))
        assert {x for a, b in got for x in range(a, b)} == set(range(len(n)))
        # No chunk passes its limit unless one atom does.
        assert all(width(a, b) <= 40 or b - a == 1 for a, b in got)
        assert all(y[1] > x[1] and y[0] > x[0] and y[0] >= min(fixed, x[1]) for x, y in zip(got, got[1:]))


def brute_chunks(texts, limit, overlap, heading):
    """Section chunks as a plain walk over sentences."""
    show = lambda ts: (heading + "\n\n" if heading and not "\n\n".join(ts).startswith(heading) else "") + "\n\n".join(ts)
    out, current = [], []
    for t in texts:
        if current and len(show([*current, t])) > limit:
            out.append(show(current))
            kept = []
            for x in reversed(current):
                if kept and len("\n\n".join([x, *kept])) > overlap:
                    break
                kept.insert(0, x)
                if len("\n\n".join(kept)) >= overlap:
                    break
            while kept and len(show([*kept, t])) > limit:
                kept.pop(0)
            current = kept
        current.append(t)
    return [*out, show(current)] if current else out


def test_section_fold_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        texts = ["x" * rng.randint(1, 40) + "。" for _ in range(rng.randint(1, 20))]
        head = rng.choice(["", "x", "H"])
        unit = {"text": "".join(texts), "page_start": 1, "page_end": 1, "heading": head, "is_heading": False}
        assert [c["text"] for c in chunking.section_fold([unit], 60, 15)] == brute_chunks(texts, 60, 15, head)


def test_gold_pack_bounds():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("痛膝关。；，ab. 1") for _ in range(rng.randint(0, 900)))
        parts = chunking.pack_sentences(text, 60, 100, 20, 15)
        assert all(len(p) <= 115 for p in parts)
        squeezed = lambda t: "".join(t.split())
        assert squeezed("".join(parts)) == squeezed(text)
    assert chunking.cut_long("甲" * 50 + "。" + "乙" * 60, 100, 10)[0] == "甲" * 50 + "。"


def test_chunkers_on_pages(spark):
    pages = spark.createDataFrame([("s", "zh", 1, "一、概述\n\n膝痛很常\n\n应当锻炼"), ("s", "zh", 2, "并且减重。\n\n二、治疗\n\n用药。"), ("s", "zh", 3, None), ("t", "en", 1, "INTRODUCTION\n\nExer-\n\ncise helps. Walk.")], "source_id string, language string, pdf_page_number int, text string")
    assert [r.text for r in chunking.baseline_chunks(pages, 20, 5).where("source_id = 's' AND page = 2").collect()] == ["并且减重。\n\n二、治疗\n\n用药。"]
    sec = chunking.section_chunks(pages, 60, 10).where("source_id = 's'").orderBy("chunk_id").collect()
    assert [r.heading for r in sec] == ["一、概述", "二、治疗"] and sec[0].page_end == 2
    bnd = chunking.boundary_chunks(pages, 60, 5, 10).orderBy("chunk_id").collect()
    assert any(r.text.startswith("INTRODUCTION") and "Exercise" in r.text for r in bnd)


def test_filters(spark):
    pages = spark.createDataFrame([("s", 1, "a"), ("s", 2, "参考文献\n\nb"), ("s", 3, "c"), ("s", 4, "d")], "source_id string, pdf_page_number int, text string")
    policy = spark.createDataFrame([("s", 4, "review")], "source_id string, pdf_page_number int, chunk_policy string")
    got = [r.status for r in filters.stop_at_references(filters.resolve_policy(pages, policy), ["参考文献"]).orderBy("pdf_page_number").collect()]
    assert got == ["included", "included", "after_references", "after_references"]
    bad = spark.createDataFrame([("s", 4, "maybe")], policy.schema)
    with pytest.raises(Exception, match="unknown chunk policy"):
        filters.resolve_policy(pages, bad).collect()
    b = spark.createDataFrame([("s", 1, "a", 3, "c", 4)], "source_id string, body_start_page int, body_start_marker string, reference_start_page int, reference_start_marker string, body_end_page int")
    assert [r.text for r in filters.body_pages(pages, b).orderBy("pdf_page_number").collect()] == ["a", "参考文献\n\nb", ""]


def test_corpus_build(spark):
    nodes = spark.createDataFrame([("s", "n1", "", 1, "section", 1, 1, "概述", 1, "概述", "included", "auto_text"), ("s", "q", "n1", 2, "question", 2, 1, "问题1", 1, "问题1", "included", "auto_text"), ("s", "r", "q", 3, "recommendation", 3, 2, "推荐", 1, "推荐", "included", "hybrid")], "source_id string, node_id string, parent_id string, node_order int, node_type string, level int, pdf_page int, marker_text string, marker_occurrence int, display_title string, include_status string, extraction_mode string")
    pages = spark.createDataFrame([("s", 1, "概述\n膝骨关节炎很常见。\n问题1 怎么办"), ("s", 2, "推荐：坚持锻炼。参考文献")], "source_id string, pdf_page_number int, text string")
    n = corpus.title_paths(nodes)
    assert {r.node_id: r.title_path for r in n.collect()}["r"] == ["概述", "问题1", "推荐"]
    ends = corpus.document_ends(spark.createDataFrame([("s", 2, 8)], "source_id string, page int, pos int"))
    seg = corpus.slice_nodes(corpus.locate_nodes(n, pages), pages, ends)
    assert {r.node_id: r.segment_text for r in seg.collect()} == {"n1": "概述\n膝骨关节炎很常见。\n", "q": "问题1 怎么办", "r": "推荐：坚持锻炼。"}
    asked = F.lit(True)
    chunks, notes = corpus.section_chunks(n, seg, "v", by_question=asked)
    assert [(r.node_id, r.text, r.chunk_id) for r in chunks.collect()] == [("n1", "膝骨关节炎很常见。", "s-SEC-001-C01")] and notes.count() == 0
    q = corpus.question_chunks(n, seg, "v")[0].collect()
    assert [(r.chunk_id, r.node_id, r.source_order, r.text, r.question_node_id, r.recommendation_node_ids, r.pdf_page_start, r.pdf_page_end, r.cross_page) for r in q] == [("s-QR-002-003-C01", "q", 3, "问题1怎么办 推荐：坚持锻炼。", "q", ["r"], 1, 2, True)] or q[0].text == "问题1 怎么办 推荐：坚持锻炼。"
    assert chunks.columns == corpus.CHUNK_COLUMNS
    with pytest.raises(ValueError, match="question_without_recommendation"):
        corpus.question_chunks(n.where("node_id <> 'r'"), seg, "v")
    with pytest.raises(ValueError, match="no_room_beside_question"):
        corpus.question_chunks(n, seg, "v", limit=225)
    assert [r.category for r in corpus.question_chunks(n, seg, "v", limit=225, strict=False)[1].collect()] == ["no_room_beside_question"]
    rules = spark.createDataFrame([("n1", [("replace", "很", None, "最", 0, False, False, False, True, "r1")])], "node_id string, rules " + X.RULE)
    assert corpus.section_chunks(n, seg, "v", by_question=asked, cleanup=rules)[0].first().text == "膝骨关节炎最常见。"
    none = spark.createDataFrame([], "record_id string, source_id string, node_id string, pdf_page int, table_id string, display_title string, text string, include_status string, review_status string")
    located = corpus.locate_nodes(n, pages)
    both, notes = corpus.build_corpus(located, pages, ends, none, "v", by_question=asked)
    assert [r.content_type for r in corpus.corpus_order(both).collect()] == ["section_text", "question_recommendation"]
    assert [r.category for r in notes.collect()] == ["hybrid_without_manual_evidence"]
    with pytest.raises(ValueError, match="no evidence"):
        corpus.build_corpus(located.withColumn("extraction_mode", F.when(F.col("node_id") == "n1", "manual_table").otherwise(F.col("extraction_mode"))), pages, ends, none, "v", by_question=asked)
    with pytest.raises(ValueError):
        corpus.title_paths(nodes.withColumn("parent_id", F.lit("missing")))
    with pytest.raises(ValueError):
        corpus.require_pass(spark.createDataFrame([("review",)], "status string"))


def test_validators(spark):
    rules = [quality.Rule("neg", F.col("x") < 0), quality.Rule("odd", F.col("x") % 2 != 0, True)]
    df = spark.createDataFrame([(1, -1), (2, 3), (3, 2), (4, None)], "id int, x int")
    assert {r.id: (r.issues, r.status) for r in quality.validate(df, rules, "id").collect()} == {1: ("neg; odd", "error"), 2: ("odd", "review"), 3: ("", "pass"), 4: ("", "pass")}
    pages = spark.createDataFrame([("s", 1, "start x x"), ("s", 2, "refs")], "source_id string, pdf_page_number int, text string")
    b = spark.createDataFrame([("s", 1, "x", 2, "refs", 2), ("t", 1, "a", 2, "b", 2), ("s", 3, "q", 1, "nope", 2)], "source_id string, body_start_page int, body_start_marker string, reference_start_page int, reference_start_marker string, body_end_page int")
    got = sorted(r.issues for r in quality.validate_boundaries(b, pages).collect())
    assert got[1].startswith("start_marker_multiple") and "source_missing" in " ".join(got) and "start_page_out_of_range" in " ".join(got)


def test_generation(spark):
    res = spark.createDataFrame([("run", "q", "Q?", "answerable", k, f"c{k}", 1.0 / k) for k in (2, 1, 3)], "run_id string, query_id string, query string, answerability string, rank int, id string, score double")
    corp = spark.createDataFrame([(f"c{k}", "s", ["a", "b"], f"text {k}", "h") for k in (1, 2)], "chunk_id string, source_id string, title_path array<string>, text string, text_sha256 string")
    x = generation.generation_inputs(res, corp, "g", 2)
    r = x.first()
    assert [e.chunk_id for e in r.evidence] == ["c1", "c2"] and r.run_id == "g_top2"
    with pytest.raises(ValueError):
        generation.generation_inputs(res, corp, "g", 3)
    with pytest.raises(ValueError):
        generation.require_contract(x.withColumn("is_gold", F.lit(1)))
    p = generation.with_prompts(x, "sys", "v1")
    assert p.first().user_prompt.startswith("问题：\nQ?\n\n检索证据：\n[Evidence 1]\n来源：s\n章节：a > b\ntext 1")
    assert generation.generate(p, "m").first().generation_status == "prompt_ready"

    def client(system, user):
        raise RuntimeError("down")

    assert generation.generate(p, "m", client).first().generation_error == "down"


def test_judgements(spark):
    import json

    ok = dict(query_id="q", relevance_score=2, groundedness_score=2, completeness_score=2, unsupported_claim=False, unsupported_claim_severity="none", unanswerable_behavior="not_applicable", overall_verdict="pass", reason="r")
    cases = {"good": ok, "fenced": None, "missing": {k: v for k, v in ok.items() if k != "reason"}, "three": ok | {"groundedness_score": 3}, "float": ok | {"relevance_score": 1.5}, "enum": ok | {"overall_verdict": "maybe"}, "other": ok | {"query_id": "z"}, "major": ok | {"unsupported_claim_severity": "major"}, "listed": ok | {"unsupported_items": ["x"]}}
    raw = {k: json.dumps(v) for k, v in cases.items()} | {"fenced": "```json\n" + json.dumps(ok) + "\n```", "cut": json.dumps(ok)[:30]}
    df = spark.createDataFrame([(k, "q", v) for k, v in raw.items()], "case string, query_id string, raw string")
    x = df.withColumn("p", generation.parse_judgement("raw", "query_id")).withColumn("v", generation.hard_fail(F.col("p.judge_result"))).withColumn("c", generation.consistent(F.col("p.judge_result")))
    got = {r.case: (r.p.judge_error, r.v, r.c) for r in x.collect()}
    assert got["good"] == (None, "pass", True) and got["fenced"][0] is None and got["major"][1] == "fail" and got["listed"][2] is False
    assert {k: got[k][0] for k in ("missing", "three", "float", "enum", "other", "cut")} == {"missing": "missing_reason", "three": "invalid_groundedness_score", "float": "invalid_relevance_score", "enum": "invalid_overall_verdict", "other": "query_id_mismatch", "cut": "not_json"}


def test_judge_retries_once(spark):
    ok = '{"query_id":"q","relevance_score":2,"groundedness_score":0,"completeness_score":2,"unsupported_claim":false,"unsupported_claim_severity":"none","unanswerable_behavior":"pass","overall_verdict":"pass","reason":"r"}'
    cases = spark.createDataFrame([("q", "prompt")], "query_id string, judge_prompt string")
    for first in ("no json", ok.replace('"groundedness_score":0', '"groundedness_score":3'), ok.replace(',"reason":"r"', ""), ok.replace('"pass","reason"', '"maybe","reason"'), "[]"):
        r = generation.judge(cases, lambda p, first=first: ok if p.endswith("fields.") else first).first()
        assert r.judge_status == "success" and r.judge_result.overall_verdict == "fail", first
    r = generation.judge(cases, lambda p: ok.replace('"relevance_score":2', '"relevance_score":9')).first()
    assert (r.judge_status, r.judge_error) == ("error", "invalid_relevance_score")

    def down(p):
        raise RuntimeError("http")

    assert generation.judge(cases, down).first().judge_error == "http"


def test_evaluation_over_all_runs(spark, tmp_path):
    import __spark_entry__ as e

    ok = '{"query_id":"q1","relevance_score":2,"groundedness_score":2,"completeness_score":2,"unsupported_claim":false,"unsupported_claim_severity":"none","unanswerable_behavior":"pass","overall_verdict":"pass","reason":"r"}'
    rows = [("r1", "q1", "Walk daily."), ("r2", "q1", None), ("r2", "q2", "Rest."), ("r2", "q2", "Rest.")]
    df = spark.createDataFrame(rows, "run_id string, query_id string, answer string").withColumns({"query": F.lit("Q?"), "answerability": F.lit("answerable"), "top_k": F.lit(1), "generation_status": F.lit("success")})
    df = df.withColumn("evidence", F.array(F.struct(F.lit(1).alias("rank"))))
    df.write.parquet(f"{tmp_path}/generation_run.parquet")
    got = {n: e.queries()[n](spark, str(tmp_path)).collect() for n in ("evaluation_summary", "evaluation_totals", "review_queue")}
    assert sorted((r.run_id, r.query_id, r.deterministic_pass) for r in got["evaluation_summary"]) == [("r1", "q1", 1), ("r2", "q1", 0), ("r2", "q2", 1)]
    assert [(r.answers, r.deterministic_pass) for r in got["evaluation_totals"]] == [(3, 2)]
    queue = {(r.run_id, r.query_id): r.review_reason for r in got["review_queue"]}
    assert queue[("r2", "q1")].startswith("deterministic_fail") and "deterministic_fail" not in queue.get(("r1", "q1"), "")
    # The operators themselves: judgements of one run must not reach another's answers.
    cases = df.where("query_id = 'q1'").select("run_id", "query_id", F.col("run_id").alias("judge_prompt"))
    judged = generation.judge(cases, lambda p: ok if p.startswith("r1") else "no json")
    summary = generation.evaluation_summary(generation.deterministic_rules(df.where("query_id = 'q1'")), judged)
    assert sorted((r.run_id, r.judge_status, r.manual_review) for r in summary.collect()) == [("r1", "success", 0), ("r2", "error", 1)]
    assert [r.run_id for r in generation.review_queue(summary, df, judged).collect()] == ["r2"]
    with pytest.raises(ValueError, match="different keys"):
        generation.evaluation_summary(generation.deterministic_rules(df), judged)


def test_sampling(spark):
    df = spark.createDataFrame([(f"c{i:02d}", "s", f"n{i}", "section_text", False, 1, 1 + i % 2, i) for i in range(20)], "chunk_id string, source_id string, node_id string, content_type string, context_repeated boolean, pdf_page_start int, pdf_page_end int, char_count int")
    s = sampling.review_sample(df, 6, F.col("char_count") > 17)
    got = Counter(r.sample_reason for r in s.collect())
    assert got["high_risk"] == 2 and sum(got.values()) == 6
    assert {r.sample_reason for r in sampling.edge_samples(df).collect()} == {"first", "middle|cross_page", "last"} or sampling.edge_samples(df).count() >= 3
    a = [r.chunk_id for r in sampling.seeded_sample(df, "chunk_id", 5).collect()]
    assert a == [r.chunk_id for r in sampling.seeded_sample(df.repartition(3), "chunk_id", 5).collect()]


def test_sources(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿source_id,title\ns1, 膝痛 \ns2,\n".encode())
    df = io.read_keyed_csv(spark, str(p), "source_id string, title string", "source_id")
    assert [(r.source_id, r.title) for r in df.orderBy("source_id").collect()] == [("s1", "膝痛"), ("s2", "")]
    with pytest.raises(ValueError):
        io.require_key(df.unionByName(df), "source_id")
    out = str(tmp_path / "snap")
    assert io.snapshot(df, out) and not io.snapshot(df.orderBy(F.desc("source_id")), out)
    with pytest.raises(ValueError):
        io.snapshot(df.limit(1), out)
    io.write_jsonl(df, str(tmp_path / "j"))
    assert io.read_jsonl(spark, str(tmp_path / "j"), "source_id string, title string").count() == 2
    io.write_csv(df, str(tmp_path / "c"))
    with pytest.raises(ValueError):
        io.write_csv(df.where("false"), str(tmp_path / "d"))
    assert io.file_hashes(spark, str(p)).first().sha256 == __import__("hashlib").sha256(p.read_bytes()).hexdigest()
    assert io.resume(df, df.limit(1), "source_id").count() == 1
    signed = io.content_signature(df, "m", 5, "source_id", "title")
    assert io.missing_embeddings(signed, signed.limit(1)).count() == 1
    assert io.ChunkConfig.from_json('{"max_chars": 900}', '{"target_chars": 800}').max_chars == 900
    for bad in ('{"max_chars": 5}', '{"other": 1}'):
        with pytest.raises(ValueError):
            io.ChunkConfig.from_json(bad)


def test_streaming(spark, tmp_path):
    from quern.streaming import ingest

    df = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 05:00:00")], "doc_id long, source string, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    s = ingest.first_arrivals(ingest.document_stream(spark, str(tmp_path / "in"), df.schema), "doc_id", "t")
    ingest.write_batches(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_entry_contract():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60


def test_embed_and_detections(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, t string")
    got = {r.id: r.embedding for r in retrieval.embed(df, "id", "t", lambda ts: [[len(t), 4.0] for t in ts]).collect()}
    assert [round(x, 4) for x in got[1]] == [0.6, 0.8] and got[2] == [0.0, 1.0]
    d = spark.createDataFrame([("s", 1, 2, 2), ("s", 2, 0, 1), ("s", 3, None, 0)], "source_id string, page int, a int, b int")
    r = quality.detection_totals(d, "a", "b").first()
    assert (r.a_tables, r.a_pages, r.b_tables, r.b_pages, r.differing_pages) == (2, [1], 3, [1, 2], 1)


def test_predicates(spark):
    rows = ["一、概述", "（二）方法", "推荐意见 3 内容", "INTRODUCTION AND AIMS", "Not a heading.", "1. item", "• item", "plain"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = {r.t: (r.zh, r.en, r.s, r.l) for r in df.select("t", filters.is_heading("t", F.lit("zh")).alias("zh"), filters.is_heading("t", F.lit("en")).alias("en"), filters.starts_section("t").alias("s"), filters.is_list_item("t").alias("l")).collect()}
    assert [got[r][0] for r in rows] == [True, True, True, False, False, False, False, False]
    assert got["INTRODUCTION AND AIMS"][1] and got["INTRODUCTION AND AIMS"][2] and not got["Not a heading."][1]
    assert [got[r][3] for r in rows] == [False, True, False, False, False, True, True, False]
    assert [r[0] for r in df.select(filters.section_heading("t")).collect()][2] == "推荐意见 3"


def test_structure_and_tables(spark):
    n = "source_id string, node_id string, parent_id string, node_order int, node_type string, level int, pdf_page int, marker_text string, marker_occurrence int, include_status string, extraction_mode string"
    nodes = spark.createDataFrame([("s", "a", None, 1, "section", 1, 1, "A", 1, "included", "auto_text"), ("s", "b", "a", 2, "recommendation", 2, 1, "B", 2, "included", "exclude"), ("s", "b", "x", 2, "odd", 5, 9, "", 0, "maybe", None), ("t", "c", "a", 1, "question", 2, 1, "C", 1, "included", "manual_table")], n)
    pages = spark.createDataFrame([("s", 1, "B A"), ("t", 1, "C")], "source_id string, pdf_page_number int, text string")
    bounds = spark.createDataFrame([("s", 1, 1)], "source_id string, body_start_page int, body_end_page int")
    got = sorted((r.node_id, r.status, r.issues) for r in quality.validate_structure(nodes, pages, bounds).collect())
    assert got[0] == ("a", "pass", "")
    assert "marker_occurrence_out_of_range" in got[1][2] + got[2][2] and "pdf_page_not_found" in got[1][2] + got[2][2]
    assert got[3][2].startswith("parent_from_different_source") and "document_boundary_not_found" in got[3][2]
    located = corpus.locate_nodes(nodes.where("node_id <> 'c' AND marker_text <> ''").withColumn("marker_occurrence", F.lit(1)), pages)
    assert [r.node_id for r in quality.marker_order(located.withColumn("node_order", F.when(F.col("node_id") == "a", 1).otherwise(2))).collect()] == ["b"]
    e = "record_id string, source_id string, node_id string, pdf_page int, table_id string, table_title string, record_type string, scope string, display_title string, text string, include_status string, extraction_mode string, review_status string"
    long = "x" * 50
    ev = spark.createDataFrame([("r1", "t", "c", 1, "t1", "T", "row", "s", "d", long, "included", "manual_table", "human_verified"), ("r2", "s", "zz", None, "", "T", "row", "s", "d", "short", "included", "auto", None)], e)
    terms = spark.createDataFrame([("r1", ["x", "y"])], "record_id string, terms array<string>")
    got = {r.record_id: r.issues for r in quality.validate_tables(ev, nodes.where("node_id <> 'b'"), bounds, terms, ["s"]).collect()}
    assert got["r1"].startswith("missing_required_content; ") and "unexpected_source" in got["r1"]
    assert all(x in got["r2"] for x in ("invalid_pdf_page", "structure_node_not_found", "empty_table_id", "evidence_not_human_verified", "text_unusually_short", "record_not_in_expectation"))
    with pytest.raises(ValueError):
        corpus.table_chunks(ev, nodes.withColumn("title_path", F.array(F.lit("a"))), "v")


def test_freeze_gate(spark):
    b = "query_id string, phase string, split string, topic string, query_type string, difficulty string, query string, answerability string, gold_chunk_ids array<string>, supporting_chunk_ids array<string>, expected_source_ids array<string>, evidence_scope string, review_status string"
    good = ("q1", "pilot", "dev", "t", "k", "easy", "long question?", "answerable", ["c1"], [], ["s"], "single_chunk", "verified")
    corp = spark.createDataFrame([("c1", "s")], "chunk_id string, source_id string")
    quality.freeze_gate(spark.createDataFrame([good, good], b), corp, {"questions": 1})
    for bad in ({"gold_chunk_ids": ["zz"]}, {"split": None}, {"supporting_chunk_ids": ["c1"]}, {"evidence_scope": "multi_chunk"}, {"answerability": "unanswerable"}, {"expected_source_ids": ["other"]}):
        row = dict(zip([x.split()[0] for x in b.split(", ")], good)) | bad
        with pytest.raises(ValueError):
            quality.freeze_gate(spark.createDataFrame([tuple(row.values())], b), corp, {})
    with pytest.raises(ValueError):
        quality.freeze_gate(spark.createDataFrame([good], b), corp, {"multi_chunk": 2})


def test_helpers_without_queries(spark, tmp_path):
    b = spark.createDataFrame([("q1", "pilot", "verified"), ("q2", "expansion", "verified"), ("q3", "pilot", "draft"), ("q4", None, None)], "query_id string, phase string, review_status string")
    assert [r.query_id for r in filters.verified_questions(b).orderBy("query_id").collect()] == ["q1", "q2"]
    assert [r.query_id for r in filters.verified_questions(b, "pilot").collect()] == ["q1"]
    assert [r.query_id for r in filters.limit_rows(b, "query_id", limit=2).collect()] == ["q1", "q2"] and filters.limit_rows(b, "query_id", only="q3").count() == 1
    done = f"{tmp_path}/done"
    io.append_done(b.where("query_id = 'q1'"), done)
    io.append_done(b.where("query_id = 'q2'"), done)
    assert sorted(r.query_id for r in io.resume(b, spark.read.parquet(done), "query_id").collect()) == ["q3", "q4"]
    generation.require_same_keys(b, b.union(b))
    with pytest.raises(ValueError):
        generation.require_same_keys(b, b.where("query_id <> 'q4'"))


def test_csv_with_mark_and_ordered_pages(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x,\"y\"")], "k string, n int, t string")
    io.write_csv(df.coalesce(1), f"{tmp_path}/c")
    part = next(p for p in (tmp_path / "c").iterdir() if p.name.startswith("part-"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfk,n,t")
    assert [tuple(r) for r in io.read_csv(spark, f"{tmp_path}/c", "k string, n int, t string").orderBy("k").collect()] == [("a", 1, ""), ("b", 2, 'x,"y"')]
    with pytest.raises(ValueError, match="nothing to write"):
        io.write_csv(df.where("false"), f"{tmp_path}/d")
    (tmp_path / "p").mkdir()
    (tmp_path / "p/1.jsonl").write_text('{"source_id":"s","pdf_page_number":2}\n\n{"source_id":"a","pdf_page_number":9}\n')
    (tmp_path / "p/2.jsonl").write_text('{"source_id":"s","pdf_page_number":1}\n')
    got = io.read_pages(spark, f"{tmp_path}/p/*.jsonl", "source_id string, pdf_page_number int").collect()
    assert [tuple(r) for r in got] == [("a", 9), ("s", 1), ("s", 2)]
    (tmp_path / "p/3.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="FAILFAST|Malformed"):
        io.read_jsonl(spark, f"{tmp_path}/p/3.jsonl", "source_id string").collect()


def test_page_rules_and_registry(spark):
    pages = spark.createDataFrame([("s", 1, "head A body B tail"), ("s", 2, "x"), ("s", 3, None)], "source_id string, pdf_page_number int, text string")
    rules = spark.createDataFrame([("s", 1, 2, "trim_after", "B"), ("s", 1, 1, " Trim_Before ", "A"), ("s", 2, 1, "trim_after", "none")], "source_id string, pdf_page_number int, rule_order int, action string, marker string")
    assert [r.text for r in chunking.apply_page_rules(pages, rules).orderBy("pdf_page_number").collect()] == ["A body", "x", None]
    with pytest.raises(Exception, match="unknown cleanup action"):
        chunking.apply_page_rules(pages, rules.withColumn("action", F.lit("cut"))).collect()
    registry = spark.createDataFrame([("s", "ZH_cn")], "source_id string, language string")
    assert [r.language for r in chunking.prepare_pages(pages, registry).collect()] == ["ZH_cn"] * 3
    with pytest.raises(Exception, match="not in the registry"):
        chunking.prepare_pages(pages, registry.where("false")).collect()


def test_pages_in_blocks_follow_each_other(spark, monkeypatch):
    pages = spark.createDataFrame([("s", "zh", p, f"句{p}没有完" if p % 5 else f"第{p}句。\n\n一、题{p}") for p in range(1, 41) if p != 17], "source_id string, language string, pdf_page_number int, text string")
    whole = [tuple(r) for r in chunking.section_chunks(pages, 60, 10).orderBy("chunk_id").collect()]
    parts = [tuple(r) for r in chunking.boundary_chunks(pages, 60, 20, 10).orderBy("chunk_id").collect()]
    monkeypatch.setattr(chunking, "PAGES_PER_BLOCK", 3)
    assert [tuple(r) for r in chunking.section_chunks(pages, 60, 10).orderBy("chunk_id").collect()] == whole
    assert [tuple(r) for r in chunking.boundary_chunks(pages, 60, 20, 10).orderBy("chunk_id").collect()] == parts


def test_build_settings(spark):
    base = {"corpus_version": "v", "included_sources": ["s"], "target_chars": 10, "max_chars": 20, "min_chars": 5, "review_sample_size": 3, "random_seed": 1, "other": 0}
    c = config.CorpusConfig.from_json(json.dumps(base))
    assert (c.included_sources, c.sentence_overflow_chars, c.recommendation_context_max_chars) == (("s",), 300, 420)
    for bad in ({"included_sources": []}, {"min_chars": 11}, {"max_chars": 9}, {"sentence_overflow_chars": -1}, {"recommendation_context_max_chars": 119}):
        with pytest.raises(ValueError, match="out of bounds"):
            config.CorpusConfig.from_json(json.dumps(base | bad))
    with pytest.raises(ValueError, match="missing"):
        config.CorpusConfig.from_json("{}")
    public = {"recommendation_context_overrides": {"a": "public", "b": "kept"}, "required_recommendation_context_override_ids": ["a", "c"], "node_cleanup_rules": {"n": [{"operation": "replace", "old": "x", "new": "y"}, {"operation": "trim_after", "marker": "END", "required": False}]}}
    private = {"recommendation_context_overrides": {"a": "private", "c": "new"}}
    got = config.CleanupConfig.from_json(json.dumps(public), json.dumps(private))
    assert {r.node_id: r.context for r in got.overrides(spark).collect()} == {"a": "private", "b": "kept", "c": "new"}
    for over in (None, json.dumps({"recommendation_context_overrides": {"c": " "}})):
        with pytest.raises(ValueError, match="required context overrides"):
            config.CleanupConfig.from_json(json.dumps(public), over)
    with pytest.raises(ValueError, match="unknown cleanup operations"):
        config.CleanupConfig.from_json('{"node_cleanup_rules": {"n": [{"operation": "drop"}]}}')
    bodies = spark.createDataFrame([("n", "a x  x END b"), ("m", "x")], "node_id string, t string")
    assert {r.node_id: r.t for r in corpus.clean_bodies(bodies, "t", got.rules(spark)).collect()} == {"n": "a y y", "m": "x"}
    with pytest.raises(Exception, match="required rule did not apply"):
        corpus.clean_bodies(bodies.withColumn("t", F.lit("none")), "t", got.rules(spark)).collect()
