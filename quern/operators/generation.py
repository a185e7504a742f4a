"""Generation inputs, prompts, model calls, grading and review."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import blank

#: Columns that would leak the evaluation into what a model sees.
FORBIDDEN_INPUT = ("gold_chunk_ids", "supporting_chunk_ids", "is_gold", "is_support")
INPUT_COLUMNS = ("run_id", "query_id", "query", "answerability", "retrieval_run_id", "top_k", "evidence")
EVIDENCE = "array<struct<rank:int,chunk_id:string,source_id:string,title_path:string,score:double,text:string,text_sha256:string>>"


def require_contract(df: DataFrame) -> DataFrame:
    """The input contract: all required columns, none that leaks, at any depth."""
    names = set(df.columns) | {f.name for c in df.schema if isinstance(c.dataType, T.ArrayType) and isinstance(c.dataType.elementType, T.StructType) for f in c.dataType.elementType}
    if missing := set(INPUT_COLUMNS) - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    if leaked := names & set(FORBIDDEN_INPUT):
        raise ValueError(f"evaluation labels in the input: {sorted(leaked)}")
    return df


def generation_inputs(results: DataFrame, corpus: DataFrame, run_id: str, top_k: int = 5, strict: bool = True) -> DataFrame:
    """One row per question with its top_k chunks as ordered evidence, without any label.

    ``results`` has run_id, query_id, query, answerability, rank, id and score.  A
    result whose chunk is not in the corpus is an error if strict, else dropped.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    top = results.where(F.col("rank") <= top_k)
    c = corpus.select(F.col("chunk_id").alias("id"), "source_id", F.array_join("title_path", " > ").alias("title_path"), "text", "text_sha256").dropDuplicates(["id"])
    if strict and not top.join(c, "id", "left_anti").isEmpty():
        raise ValueError("a retrieved chunk is not in the corpus")
    x = top.join(c, "id")
    e = F.struct(F.col("rank").cast("int").alias("rank"), F.col("id").alias("chunk_id"), "source_id", "title_path", F.col("score").cast("double").alias("score"), "text", "text_sha256")
    out = x.groupBy(F.col("run_id").alias("retrieval_run_id"), "query_id", "query", "answerability").agg(F.array_sort(F.collect_list(e)).alias("evidence"))
    return require_contract(out.select(F.lit(f"{run_id}_top{top_k}").alias("run_id"), "query_id", "query", "answerability", "retrieval_run_id", F.lit(top_k).alias("top_k"), "evidence"))


# The prompt templates.
USER_TEMPLATE = ("问题：\n", "\n\n检索证据：\n", "\n\n请依据以上证据回答问题。")


def evidence_text(evidence="evidence") -> Column:
    one = lambda e: F.concat(F.lit("[Evidence "), e["rank"].cast("string"), F.lit("]\n来源："), F.coalesce(e["source_id"], F.lit("")), F.lit("\n章节："), F.coalesce(e["title_path"], F.lit("")), F.lit("\n"), F.coalesce(e["text"], F.lit("")))
    return F.array_join(F.transform(X.col(evidence), one), "\n\n")


def with_prompts(inputs: DataFrame, system_prompt: str, version: str) -> DataFrame:
    a, b, c = USER_TEMPLATE
    prompt = F.concat(F.lit(a), F.coalesce("query", F.lit("")), F.lit(b), evidence_text(), F.lit(c))
    return inputs.withColumn("prompt_version", F.lit(version)).withColumn("system_prompt", F.lit(system_prompt)).withColumn("user_prompt", prompt)


def generate(prompts: DataFrame, model: str, client: Callable[[str, str], str] | None = None) -> DataFrame:
    """Prompts with answer, status and error; without a client a dry run: status prompt_ready, no answer.

    ``client`` maps system and user prompt to an answer; it runs in the workers, and
    an error stays with its row.
    """
    if client is None:
        return prompts.withColumn("generator_model", F.lit(model)).withColumn("answer", F.lit(None).cast("string")).withColumn("generation_status", F.lit("prompt_ready")).withColumn("generation_error", F.lit(None).cast("string"))

    @F.pandas_udf("answer string, generation_status string, generation_error string")
    def call(system: pd.Series, user: pd.Series) -> pd.DataFrame:
        rows = []
        for s, u in zip(system, user):
            try:
                rows.append((client(s, u), "success", None))
            except Exception as error:
                rows.append((None, "error", str(error)))
        return pd.DataFrame(rows, columns=["answer", "generation_status", "generation_error"])

    x = prompts.withColumn("generator_model", F.lit(model)).withColumn("_c", call("system_prompt", "user_prompt"))
    return x.select("*", "_c.answer", "_c.generation_status", "_c.generation_error").drop("_c")


def deterministic_rules(runs: DataFrame) -> DataFrame:
    """Rule results per answer as 0 or 1, and deterministic_pass."""
    ok, filled = F.coalesce(F.col("generation_status") == "success", F.lit(False)), ~blank(F.col("answer"))
    full = F.coalesce(F.size("evidence") == F.col("top_k"), F.lit(False))
    unanswerable = F.coalesce(F.col("answerability") == "unanswerable", F.lit(False))
    says = X.says_insufficient("answer")
    i = lambda c, name: c.cast("int").alias(name)
    return runs.select("run_id", "query_id", "answerability", i(ok, "generation_success"), i(filled, "answer_nonempty"), i(full, "evidence_count_ok"), i(says, "says_insufficient"), i(~unanswerable | says, "unanswerable_ok"), i(ok & filled & full & (~unanswerable | says), "deterministic_pass"))


SCORES = ("relevance_score", "groundedness_score", "completeness_score")
JUDGE = "query_id string, relevance_score int, groundedness_score int, completeness_score int, unsupported_claim boolean, unsupported_claim_severity string, unanswerable_behavior string, overall_verdict string, reason string, unsupported_items array<string>"
JUDGE_DOMAIN = {"unsupported_claim_severity": ("none", "minor", "major"), "unanswerable_behavior": ("pass", "fail", "not_applicable"), "overall_verdict": ("pass", "fail")}


def judge_prompt(rubric: dict, query="query", answer="answer", evidence="evidence", answerability="answerability") -> Column:
    """The judge's prompt: criteria, rules, policy and schema of a rubric as JSON, then the case."""
    head = "\n\n".join(f"{k}:\n{json.dumps(rubric[k], ensure_ascii=False, indent=2)}" for k in sorted(rubric))
    part = lambda name, c: F.concat(F.lit(f"\n\n{name}:\n"), F.coalesce(c, F.lit("")))
    return F.concat(F.lit(head), part("query", X.col(query)), part("answerability", X.col(answerability)), part("evidence", evidence_text(evidence)), part("answer", X.col(answer)))


def parse_judgement(raw, query_id) -> Column:
    """struct(judge_status, judge_error, judge_result) of a judge's raw answer.

    A code fence is taken off; required fields, integer scores from 0 to 2, closed
    domains and the echoed query_id are checked; what fails has no result.
    """
    text = F.regexp_replace(F.regexp_replace(X.col(raw), r"(?s)^\s*```[a-zA-Z]*\s*", ""), r"(?s)\s*```\s*$", "")
    r = F.from_json(text, JUDGE, {"mode": "PERMISSIVE"})
    typed = F.from_json(text, JUDGE.replace("int", "string").replace("boolean", "string"))
    need = ["query_id", *SCORES, "unsupported_claim", *JUDGE_DOMAIN, "reason"]
    bad = F.coalesce(
        F.when(F.get_json_object(text, "$").isNull(), "not_json"),
        *[F.when(typed[c].isNull(), f"missing_{c}") for c in need],
        *[F.when(~F.coalesce(typed[c].isin("0", "1", "2"), F.lit(False)), f"invalid_{c}") for c in SCORES],
        F.when(r["unsupported_claim"].isNull(), "invalid_unsupported_claim"),
        *[F.when(~F.coalesce(r[c].isin(*v), F.lit(False)), f"invalid_{c}") for c, v in JUDGE_DOMAIN.items()],
        F.when(r["query_id"] != X.col(query_id), "query_id_mismatch"),
    )
    return F.struct(F.when(bad.isNull(), "success").otherwise("error").alias("judge_status"), bad.alias("judge_error"), F.when(bad.isNull(), r).alias("judge_result"))


def hard_fail(result: Column) -> Column:
    """The verdict after the policy: it can turn pass into fail, never the other way."""
    fails = (result["groundedness_score"] == 0) | (result["relevance_score"] == 0) | (result["unsupported_claim_severity"] == "major") | (result["unanswerable_behavior"] == "fail")
    return F.when(fails, "fail").otherwise(result["overall_verdict"])


def consistent(result: Column) -> Column:
    """Whether listed unsupported items go with the flag and with less than full groundedness; the verdict is left alone."""
    listed = F.coalesce(F.size(result["unsupported_items"]), F.lit(0)) > 0
    return ~listed | (result["unsupported_claim"] & (result["groundedness_score"] < 2))


def _keys(judged: DataFrame) -> list[str]:
    """The key of judged answers: with the run where judgements of several runs are kept apart."""
    return ["run_id", "query_id"] if "run_id" in judged.columns else ["query_id"]


def judgement_error(raw: str | None) -> str | None:
    """Why a judge's raw answer cannot be used, or None; the checks of parse_judgement but for the echoed id, which a new answer would not mend."""
    text = re.sub(r"(?s)\s*```\s*$", "", re.sub(r"(?s)^\s*```[a-zA-Z]*\s*", "", raw or ""))
    try:
        r = json.loads(text)
    except ValueError:
        return "not_json"
    if not isinstance(r, dict):
        return "not_json"
    missing = [c for c in ("query_id", *SCORES, "unsupported_claim", *JUDGE_DOMAIN, "reason") if r.get(c) is None]
    if missing:
        return f"missing_{missing[0]}"
    wrong = [c for c in SCORES if isinstance(r[c], bool) or r[c] not in (0, 1, 2)] + [c for c, v in JUDGE_DOMAIN.items() if r[c] not in v] + ([] if isinstance(r["unsupported_claim"], bool) else ["unsupported_claim"])
    return f"invalid_{wrong[0]}" if wrong else None


def judge(cases: DataFrame, client: Callable[[str], str], retry_note: str = "\n\nReturn only one complete, valid JSON object with all required fields.") -> DataFrame:
    """Cases with judge_prompt judged; one retry where the answer does not parse or fails its checks, none where the call fails; run_id is kept if there."""
    key = _keys(cases)

    def attempt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *k, p in zip(*(b[c] for c in key), b.judge_prompt):
                raw = error = None
                for note in ("", retry_note):
                    try:
                        raw = client(p + note)
                    except Exception as e:
                        raw, error = None, str(e)
                        break
                    if judgement_error(raw) is None:
                        break
                rows.append((*k, raw, error))
            yield pd.DataFrame(rows, columns=[*key, "raw_response", "call_error"])

    x = cases.select(*key, "judge_prompt").mapInPandas(attempt, ", ".join(f"{c} string" for c in [*key, "raw_response", "call_error"]))
    x = x.withColumn("_p", parse_judgement("raw_response", "query_id"))
    r = F.col("_p.judge_result")
    fixed = F.when(r.isNotNull(), r.withField("overall_verdict", hard_fail(r)))
    return x.select(*key, F.when(F.col("call_error").isNotNull(), "error").otherwise(F.col("_p.judge_status")).alias("judge_status"), fixed.alias("judge_result"), F.coalesce("call_error", F.col("_p.judge_error")).alias("judge_error"), "raw_response")


def evaluation_summary(rules: DataFrame, judged: DataFrame) -> DataFrame:
    """One row per answer with the flags of rules and judge, manual_review and its ordered reasons.

    Where ``judged`` has run_id, rows are joined on (run_id, query_id) and keep both;
    else on query_id, which holds for the answers of one run only.  Both must have the
    same keys; otherwise it is an error.
    """
    key = _keys(judged)
    require_same_keys(rules, judged, *key)
    x = rules.join(judged.select(*key, "judge_status", "judge_result"), key)
    r = F.col("judge_result")
    below = ~F.coalesce((r["relevance_score"] == 2) & (r["groundedness_score"] == 2) & (r["completeness_score"] == 2), F.lit(False))
    reasons = [("deterministic_fail", F.col("deterministic_pass") == 0), ("judge_error", F.col("judge_status") != "success"), ("judge_fail", r["overall_verdict"] == "fail"), ("unsupported_claim", r["unsupported_claim"]), ("non_max_score", below)]
    why = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons]), lambda v: v.isNotNull())
    return x.select(*key, "answerability", "deterministic_pass", "judge_status", *[r[s].alias(s) for s in SCORES], r["unsupported_claim"].alias("unsupported_claim"), r["overall_verdict"].alias("overall_verdict"), (F.size(why) > 0).cast("int").alias("manual_review"), F.array_join(why, "; ").alias("review_reason"))


def evaluation_totals(summary: DataFrame) -> DataFrame:
    """One row: passes, and mean scores over judged answers, three places."""
    ok = F.col("judge_status") == "success"
    return summary.agg(F.count("*").alias("answers"), F.sum("deterministic_pass").alias("deterministic_pass"), F.count_if(ok).alias("judged"), F.count_if(ok & (F.col("overall_verdict") == "pass")).alias("judge_pass"), F.count_if(F.col("unsupported_claim")).alias("unsupported"), F.sum("manual_review").alias("manual_review"), *[F.round(F.avg(F.when(ok, F.col(s))), 3).alias(f"mean_{s}") for s in SCORES])


def require_same_keys(a: DataFrame, b: DataFrame, *key: str) -> None:
    """Both tables must hold the same keys; counted in one pass."""
    key = key or ("query_id",)
    both = a.select(*key, F.lit(0).alias("_side")).unionByName(b.select(*key, F.lit(1).alias("_side")))
    odd = both.groupBy(*key).agg(F.countDistinct("_side").alias("_n")).where("_n < 2").limit(3).collect()
    if odd:
        raise ValueError(f"the tables hold different keys: {[tuple(r[c] for c in key) for r in odd]}")


HUMAN = {"human_relevance_score": "int", "human_groundedness_score": "int", "human_completeness_score": "int", "human_unsupported_claim": "boolean", "human_verdict": "string", "human_review_notes": "string"}


def review_queue(summary: DataFrame, runs: DataFrame, judged: DataFrame) -> DataFrame:
    """Answers to be reviewed, with evidence, judgement and empty columns for the reviewer; keyed as ``judged`` is."""
    key = _keys(judged)
    q = summary.where("manual_review = 1").select(*key, "review_reason")
    x = q.join(runs.select(*key, "query", "answerability", "answer", "evidence"), key).join(judged.select(*key, "judge_result"), key)
    return x.select(*key, "query", "answerability", "answer", "evidence", "judge_result", "review_reason", *[F.lit(None).cast(t).alias(c) for c, t in HUMAN.items()])


PAIRS = {"relevance_score": "human_relevance_score", "groundedness_score": "human_groundedness_score", "completeness_score": "human_completeness_score", "unsupported_claim": "human_unsupported_claim", "overall_verdict": "human_verdict"}


def calibration(reviewed: DataFrame) -> DataFrame:
    """(key, field, agrees): judge against reviewer by field; two nulls agree.  The key is null in the totals."""
    key, r = _keys(reviewed), F.col("judge_result")
    items = F.array(*[F.struct(F.lit(a).alias("field"), r[a].cast("string").eqNullSafe(F.col(b).cast("string")).alias("ok")) for a, b in PAIRS.items()])
    x = reviewed.select(*key, F.explode(items).alias("i")).select(*key, "i.*")
    cases = x.select(*key, "field", F.col("ok").cast("bigint").alias("agrees"), F.lit(1).cast("bigint").alias("compared"))
    totals = x.groupBy("field").agg(F.count_if("ok").alias("agrees"), F.count("*").alias("compared"))
    return cases.unionByName(totals.select(*[F.lit(None).cast("string").alias(k) for k in key], "field", "agrees", "compared"))
