"""SQL that gives the same rows as the registered core queries, independent of the Spark code."""

from .chunk_oracles import CHUNK_SQL, compact, pack_sentences
from .oracle_parts import GOLD, HEADING, PAGES, WS, blank, nfkc, squeeze, strip

_TOKENS = """list_transform(regexp_extract_all(lower({c}), '[\\x{4e00}-\\x{9fff}]+|[a-z0-9]+(?:[._/-][a-z0-9]+)*'),
  lambda r: CASE WHEN regexp_matches(r, '^[\\x{4e00}-\\x{9fff}]') THEN list_concat(list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1)), list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) ELSE [r] END)"""


def tokens(c: str) -> str:
    return "flatten(" + _TOKENS.replace("{c}", c) + ")"


_TITLE = "concat_ws(' ', array_to_string(title_path, ' '), display_title)"
_INDEX = f"concat_ws(' ', {_TITLE}, {_TITLE}, coalesce(text, ''))"
_QUESTIONS = f"(SELECT DISTINCT * FROM retrieval_eval WHERE try_cast(regexp_extract(query_id, '(\\d+)$', 1) AS BIGINT) % 20 = 0 AND NOT {blank('query')})"

_BM25 = f"""
doc AS (SELECT chunk_id AS id, {tokens(_INDEX)} AS t FROM {GOLD}),
stat AS (SELECT count(*) AS n, avg(len(t)) AS al FROM doc),
tok AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM doc),
post AS (SELECT id, dl, term, count(*) AS tf FROM tok GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM {_QUESTIONS}) GROUP BY ALL),
sc AS (SELECT query_id, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / al))), 12) AS score
  FROM post JOIN qt USING (term) JOIN dfs USING (term), stat GROUP BY ALL),
al AS (SELECT q.query_id, d.id, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM {_QUESTIONS}) q CROSS JOIN doc d LEFT JOIN sc ON sc.query_id = q.query_id AND sc.id = d.id),
bm AS (SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM al) WHERE rank <= 10)"""

_DENSE = """
best AS (SELECT query_id, retrieved_chunk_id AS id, max(score) AS score FROM retrieval_results WHERE query_id IS NOT NULL AND retrieved_chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
dn AS (SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM best) WHERE rank <= 10)"""

_RRF = f"""
rr0 AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.rank AS bm25_rank, b.rank AS dense_rank,
  round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 15) AS s
  FROM (SELECT * FROM bm WHERE query_id IN (SELECT query_id FROM dn)) a FULL JOIN (SELECT * FROM dn WHERE query_id IN (SELECT query_id FROM {_QUESTIONS})) b ON a.query_id = b.query_id AND a.id = b.id),
rf AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, least(bm25_rank, dense_rank), id) AS INTEGER) AS rank FROM rr0) WHERE rank <= 10)"""


def _metrics(name: str, run: str, questions: str) -> str:
    return f"""
{name} AS (SELECT q.query_id, q.answerability, len(q.g) AS gc, len(q.s) AS scn, min(CASE WHEN list_contains(g, id) THEN rank END) AS fg, min(CASE WHEN list_contains(g, id) OR list_contains(s, id) THEN rank END) AS fr,
  count(CASE WHEN list_contains(g, id) AND rank <= 5 THEN 1 END) AS g5, min_by(id, rank) AS top1
  FROM (SELECT query_id, answerability, list_distinct(coalesce(gold_chunk_ids, [])) AS g, list_distinct(coalesce(supporting_chunk_ids, [])) AS s FROM {questions}) q LEFT JOIN (SELECT query_id, id, rank FROM {run}) r ON r.query_id = q.query_id GROUP BY q.query_id, q.answerability, q.g, q.s)"""


_ALL_Q = "(SELECT DISTINCT * FROM retrieval_eval)"


def _hit(c: str, k: int, name: str) -> str:
    return f"CASE WHEN answerability = 'answerable' THEN CASE WHEN {c} <= {k} THEN 1 ELSE 0 END END AS {name}"


_PER_QUERY = f"""SELECT query_id, answerability, CAST(gc AS INTEGER) AS gold_count, CAST(scn AS INTEGER) AS support_count, CASE WHEN answerability = 'answerable' THEN fg END AS first_gold_rank, CASE WHEN answerability = 'answerable' THEN fr END AS first_relevant_rank,
  {_hit('fg', 1, 'hit_at_1')}, {_hit('fg', 3, 'hit_at_3')}, {_hit('fg', 5, 'hit_at_5')}, {_hit('fr', 1, 'relevant_hit_at_1')}, {_hit('fr', 3, 'relevant_hit_at_3')}, {_hit('fr', 5, 'relevant_hit_at_5')},
  top1 AS top1_chunk_id, round(CASE WHEN answerability = 'answerable' AND gc > 0 THEN g5 / gc END, 6) AS recall_at_5, round(CASE WHEN answerability = 'answerable' THEN coalesce(1.0 / fg, 0) END, 6) AS reciprocal_rank FROM m"""

_NODES = f"""
nd AS (SELECT DISTINCT * REPLACE ({strip('node_id')} AS node_id, {strip("coalesce(parent_id, '')")} AS parent_id) FROM document_structure_map WHERE {strip('node_id')} <> ''),
nodes AS (SELECT n.* FROM nd n JOIN (SELECT node_id, max(updated_at) AS u FROM nd GROUP BY node_id) x ON n.node_id = x.node_id AND n.updated_at = x.u)"""

_H = lambda k, n: f"((strpos('0123456789abcdef', substr(md5(query_id), {k}, 1)) - 1) % {n})"

_JUDGE = f"""
gen AS (SELECT DISTINCT run_id, query_id, answerability, top_k, len(evidence) AS ne, answer, generation_status FROM generation_run),
ju0 AS (SELECT DISTINCT run_id, query_id, 2 - {_H(1, 8)} % 3 AS rel, CASE WHEN {_H(2, 16)} = 0 THEN 3 ELSE 2 - {_H(2, 8)} % 3 END AS gr, {_H(3, 2)} = 1 AS uns, {_H(4, 3)} AS sev, {_H(5, 3)} AS beh, {_H(6, 2)} AS ver, ({_H(7, 4)} <> 0 AND {_H(8, 16)} = 0) AS broken FROM gen),
ju AS (SELECT run_id, query_id, CASE WHEN broken THEN 'x' WHEN gr = 3 THEN 'invalid_groundedness_score' END AS err, rel, gr, uns, CASE WHEN gr = 0 OR rel = 0 OR sev = 2 OR beh = 2 OR ver = 1 THEN 'fail' ELSE 'pass' END AS verdict FROM ju0)"""

_RULES = f"""
ru AS (SELECT run_id, query_id, answerability, CAST(coalesce(generation_status = 'success', false) AS INTEGER) AS generation_success, CAST(NOT {blank('answer')} AS INTEGER) AS answer_nonempty, CAST(coalesce(ne = top_k, false) AS INTEGER) AS evidence_count_ok,
  CAST(coalesce(regexp_matches(answer, '证据不足|证据中未|现有证据.*不足|无法.*回答|无法明确|不能.*回答|未明确|未提及'), false) AS INTEGER) AS says_insufficient FROM {{src}}),
rules AS (SELECT *, CAST(answerability IS DISTINCT FROM 'unanswerable' OR says_insufficient = 1 AS INTEGER) AS unanswerable_ok FROM ru),
rule AS (SELECT *, generation_success * answer_nonempty * evidence_count_ok * unanswerable_ok AS deterministic_pass FROM rules)"""

_SUMMARY = f"""
su AS (SELECT r.run_id, r.query_id, r.answerability, deterministic_pass, CASE WHEN err IS NULL THEN 'success' ELSE 'error' END AS judge_status, CASE WHEN err IS NULL THEN rel END AS relevance_score, CASE WHEN err IS NULL THEN gr END AS groundedness_score,
  CASE WHEN err IS NULL THEN uns END AS unsupported_claim, CASE WHEN err IS NULL THEN verdict END AS overall_verdict,
  concat_ws('; ', CASE WHEN deterministic_pass = 0 THEN 'deterministic_fail' END, CASE WHEN err IS NOT NULL THEN 'judge_error' END, CASE WHEN err IS NULL AND verdict = 'fail' THEN 'judge_fail' END, CASE WHEN err IS NULL AND uns THEN 'unsupported_claim' END, CASE WHEN err IS NOT NULL OR rel < 2 OR gr < 2 THEN 'non_max_score' END) AS review_reason
  FROM rule r JOIN ju USING (run_id, query_id))"""

_RULE_GF = _RULES.replace("{src}", "gen")

_LINES = f"""
ln AS (SELECT source_id, pdf_page_number AS page, l, len(l) AS n FROM (SELECT source_id, pdf_page_number, string_split(text, chr(10)) AS l FROM {PAGES} WHERE NOT {blank('text')})),
bl AS (SELECT source_id, page, n, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS i FROM ln),
bk AS (SELECT *, ((i + 1) * 1000.0 / n <= 150 OR i * 1000.0 / n >= 900) AS margin, regexp_replace(lower({squeeze('text')}), '\\p{{Nd}}+', '#', 'g') AS sig FROM bl),
np AS (SELECT source_id, count(DISTINCT page) AS pages FROM bk GROUP BY source_id),
rm AS (SELECT b.source_id, sig AS signature FROM bk b JOIN np USING (source_id) WHERE margin AND sig <> '' AND length(sig) <= 180 GROUP BY b.source_id, sig, pages HAVING count(DISTINCT page) >= greatest(2, ceil(pages * 30 / 100)))"""

_BOUNDS = f"""
bs AS (SELECT source_id, min(pdf_page_number) AS fp, max(pdf_page_number) AS lp, min_by(text, pdf_page_number) AS a, max_by(text, pdf_page_number) AS z FROM {PAGES} WHERE text IS NOT NULL GROUP BY 1),
bn AS (SELECT source_id, fp, CASE WHEN lp % 2 = 1 THEN substr(a, 1, 6) ELSE '。' END AS sm, lp - 1 AS ep, lp - 2 * (lp % 2) AS rp, CASE WHEN lp % 3 = 0 THEN 'no such text' ELSE substr(z, 10, 4) END AS rm FROM bs)"""
_TIMES = lambda t, m: f"CASE WHEN length({m}) > 0 THEN CAST((length({t}) - length(replace({t}, {m}, ''))) / length({m}) AS INTEGER) ELSE 0 END"

_STRUCT = f"""{_BOUNDS},
sn0 AS (SELECT DISTINCT * FROM document_structure_map),
sn AS (SELECT *, {strip("coalesce(node_id, '')")} AS nid, {strip("coalesce(parent_id, '')")} AS pid, {strip("coalesce(source_id, '')")} AS sid FROM sn0),
pr AS (SELECT nid AS pid, max({{'s': sid, 'l': coalesce(level, -2147483648), 'o': coalesce(node_order, -2147483648), 't': coalesce(node_type, ''), 'i': coalesce(include_status, '')}}) AS p FROM sn GROUP BY nid),
sx AS (SELECT sn.*, p.s AS ps, nullif(p.l, -2147483648) AS pl, nullif(p.o, -2147483648) AS po, nullif(p.t, '') AS pt, nullif(p.i, '') AS pi, count(*) OVER (PARTITION BY nid) > 1 AS dup, count(*) OVER (PARTITION BY sid, node_order) > 1 AS dupo FROM sn LEFT JOIN pr ON sn.pid = pr.pid),
sy AS (SELECT sx.*, pg.t AS pgt, {_TIMES('pg.t', 'marker_text')} AS mk, fp, ep, NOT (sx.pdf_page BETWEEN fp AND ep) AS outside FROM sx LEFT JOIN (SELECT source_id AS psid, pdf_page_number AS pn, coalesce(text, '') AS t FROM {PAGES}) pg ON psid = sid AND pn = sx.pdf_page LEFT JOIN (SELECT source_id AS bsid, fp, ep FROM bn) b ON bsid = sid),
sv AS (SELECT nid AS node_id, sid AS source_id,
  concat_ws('; ', CASE WHEN NOT coalesce(marker_occurrence, 0) >= 1 THEN 'invalid_marker_occurrence' END, CASE WHEN sid = '' THEN 'empty_source_id' END, CASE WHEN nid = '' THEN 'empty_node_id' END, CASE WHEN {blank('marker_text')} THEN 'empty_marker_text' END, CASE WHEN dup THEN 'duplicate_node_id' END, CASE WHEN dupo THEN 'duplicate_order_within_source' END,
    CASE WHEN NOT coalesce(node_type IN ('section', 'subsection', 'question', 'recommendation'), false) THEN 'invalid_node_type' END, CASE WHEN NOT coalesce(include_status IN ('included', 'excluded'), false) THEN 'invalid_include_status' END, CASE WHEN NOT coalesce(extraction_mode IN ('auto_text', 'manual_table', 'hybrid', 'exclude'), false) THEN 'invalid_extraction_mode' END,
    CASE WHEN include_status = 'included' AND extraction_mode = 'exclude' THEN 'included_node_cannot_use_extraction_mode_exclude' END, CASE WHEN pid <> '' AND ps IS NULL THEN 'parent_not_found' END, CASE WHEN pid <> '' AND ps <> sid THEN 'parent_from_different_source' END, CASE WHEN pid <> '' AND ps IS NOT NULL AND NOT coalesce(level = pl + 1, false) THEN 'parent_level_mismatch' END,
    CASE WHEN pid <> '' AND po >= node_order THEN 'parent_not_before_child' END, CASE WHEN node_type = 'recommendation' AND ps IS NOT NULL AND pt <> 'question' THEN 'recommendation_parent_is_not_question' END, CASE WHEN pid = '' AND level > 1 THEN 'non_root_node_missing_parent' END, CASE WHEN node_type = 'recommendation' AND level < 2 THEN 'invalid_recommendation_level' END,
    CASE WHEN pgt IS NULL THEN 'pdf_page_not_found' END, CASE WHEN pgt IS NOT NULL AND mk = 0 THEN 'marker_not_found' END, CASE WHEN mk > 0 AND marker_occurrence > mk THEN 'marker_occurrence_out_of_range' END, CASE WHEN mk > 0 AND marker_occurrence < 1 THEN 'marker_occurrence_position_not_found' END,
    CASE WHEN include_status = 'included' AND outside THEN 'included_node_outside_document_body' END, CASE WHEN fp IS NULL THEN 'document_boundary_not_found' END) AS e,
  concat_ws('; ', CASE WHEN include_status = 'excluded' AND extraction_mode <> 'exclude' THEN 'excluded_node_should_use_extraction_mode_exclude' END, CASE WHEN include_status = 'included' AND pi = 'excluded' THEN 'included_child_under_excluded_parent' END, CASE WHEN node_type = 'section' AND level <> 1 THEN 'section_expected_at_level_1' END,
    CASE WHEN mk > 1 AND marker_occurrence IS NULL THEN 'marker_found_multiple_without_occurrence' END, CASE WHEN include_status = 'excluded' AND outside THEN 'excluded_node_outside_document_body' END) AS w FROM sy),
st AS (SELECT DISTINCT node_id, source_id, concat_ws('; ', nullif(e, ''), nullif(w, '')) AS issues, CASE WHEN e <> '' THEN 'error' WHEN w <> '' THEN 'review' ELSE 'pass' END AS status FROM sv)"""

_G, _S, _X = "coalesce(gold_chunk_ids, [])", "coalesce(supporting_chunk_ids, [])", "coalesce(expected_source_ids, [])"


def _domain(c: str, *v: str) -> str:
    return f"CASE WHEN NOT coalesce({c} IN ({', '.join(repr(x) for x in v)}), false) THEN 'invalid_{c}' END"


_BENCH = f"""
be AS (SELECT DISTINCT * FROM retrieval_eval),
kn AS (SELECT DISTINCT chunk_id, source_id FROM gold_corpus),
bx AS (SELECT *, count(*) OVER (PARTITION BY query_id) > 1 AS dup,
  (SELECT count(*) FROM (SELECT unnest(list_distinct(list_concat({_G}, {_S}))) AS c) u WHERE c NOT IN (SELECT chunk_id FROM kn)) AS unk,
  (SELECT coalesce(list_sort(list_distinct(list(k.source_id))), []) FROM (SELECT unnest({_G}) AS c) u JOIN kn k ON k.chunk_id = u.c) AS gs FROM be),
bv AS (SELECT query_id, concat_ws('; ', {_domain('phase', 'pilot', 'expansion')}, {_domain('split', 'dev', 'test')}, {_domain('difficulty', 'easy', 'medium', 'hard')}, {_domain('answerability', 'answerable', 'unanswerable')}, {_domain('evidence_scope', 'single_chunk', 'multi_chunk', 'no_gold')},
  CASE WHEN dup THEN 'duplicate_query_id' END, CASE WHEN coalesce(review_status, '') <> 'verified' THEN 'row_not_verified' END, CASE WHEN {blank('query')} THEN 'empty_query' END, CASE WHEN {blank('topic')} THEN 'empty_topic' END, CASE WHEN {blank('query_type')} THEN 'empty_query_type' END,
  CASE WHEN unk > 0 THEN 'unknown_chunk_ids' END, CASE WHEN len(list_distinct({_G})) < len({_G}) THEN 'duplicate_gold_chunk_id' END, CASE WHEN list_has_any({_G}, {_S}) THEN 'gold_supporting_overlap' END, CASE WHEN answerability = 'answerable' AND len({_G}) = 0 THEN 'answerable_without_gold' END,
  CASE WHEN answerability = 'answerable' AND evidence_scope = 'no_gold' THEN 'answerable_with_no_gold_scope' END, CASE WHEN answerability <> 'answerable' AND len({_G}) > 0 THEN 'unanswerable_has_gold' END, CASE WHEN answerability <> 'answerable' AND evidence_scope <> 'no_gold' THEN 'unanswerable_scope_not_no_gold' END,
  CASE WHEN evidence_scope = 'single_chunk' AND len({_G}) <> 1 THEN 'single_chunk_requires_one_gold' END, CASE WHEN evidence_scope = 'multi_chunk' AND len({_G}) < 2 THEN 'multi_chunk_requires_multiple_gold' END,
  CASE WHEN list_sort(list_distinct({_X})) <> gs THEN 'expected_source_mismatch' END) AS e, CASE WHEN length({strip('query')}) < 6 THEN 'query_unusually_short' ELSE '' END AS w FROM bx)"""

_CITE = r"length(regexp_replace(regexp_replace(text, '［[^］]{1,30}］|\[[^\]]{1,30}\]', '', 'g'), '[^A-Za-z0-9\x{3400}-\x{9fff}]+', '', 'g')) < 4"

_CORPUS = f"""
cx AS (SELECT *, count(*) OVER (PARTITION BY chunk_id) > 1 AS dup, count(*) OVER (PARTITION BY sha256({squeeze('text')})) > 1 AS dupt, {blank('text')} AS bt FROM {GOLD}),
cv AS (SELECT chunk_id, concat_ws('; ', CASE WHEN {blank('chunk_id')} THEN 'empty_chunk_id' END, CASE WHEN dup THEN 'duplicate_chunk_id' END, CASE WHEN dupt AND NOT bt THEN 'duplicate_text' END, CASE WHEN {blank('source_id')} THEN 'missing_source' END, CASE WHEN bt THEN 'empty_text' END, CASE WHEN NOT bt AND {_CITE} THEN 'citation_only' END,
  CASE WHEN regexp_matches(text, '参考文献') THEN 'forbidden_reference_section' END, CASE WHEN regexp_matches(text, '共识工作组成员名单|首席临床专家：|秘书组：') THEN 'forbidden_workgroup_roster' END, CASE WHEN regexp_matches(text, 'Kunming City,\\s*Yunnan Province') THEN 'forbidden_known_layout_address' END,
  CASE WHEN regexp_matches(text, '表[1-7]骨关节炎(?:临床分期|口服药物治疗推荐|外用药物治疗推荐|物理治疗推荐|常见骨关节炎的临床表现)') THEN 'forbidden_table_header_pollution' END,
  CASE WHEN content_type = 'question_recommendation' AND {blank('question_node_id')} THEN 'missing_question_node' END, CASE WHEN content_type = 'question_recommendation' AND coalesce(len(recommendation_node_ids), 0) <= 0 THEN 'missing_recommendation_nodes' END,
  CASE WHEN content_type = 'manual_table_chunk' AND coalesce(review_status, '') <> 'human_verified' THEN 'unverified_manual_table' END) AS e,
  concat_ws('; ', CASE WHEN length(text) < 30 THEN 'short_chunk' END, CASE WHEN length(text) > 1800 THEN 'long_chunk' END) AS w FROM cx)"""

_REPORT = "concat_ws('; ', nullif(e, ''), nullif(w, '')) AS issues, CASE WHEN e <> '' THEN 'error' WHEN w <> '' THEN 'review' ELSE 'pass' END AS status"
_STATS = "CAST(min(char_count) AS INTEGER) AS min_chars, round_even(median(char_count), 1) AS median_chars, round_even(avg(char_count), 1) AS mean_chars, CAST(max(char_count) AS INTEGER) AS max_chars"
_SOME = lambda c: f"nullif({strip(c)}, '')"
_DENSE_TEXT = f"coalesce({_SOME('retrieval_text')}, concat_ws(chr(10), {_SOME(chr(97) + 'rray_to_string(title_path, ' + repr(' > ') + ')')}, {_SOME('display_title')}, {_SOME('text')}))"

ORACLE_SQL = {
    "bm25_index_stats": f"SELECT count(*) AS n_docs, round(avg(len({tokens(_INDEX)})), 6) AS avg_length FROM {GOLD}",
    "token_df_topn": f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({tokens('text')}) AS term FROM {GOLD}) GROUP BY ALL) GROUP BY term ORDER BY df DESC, term LIMIT 100",
    "bm25_topk_plain": f"WITH {_BM25} SELECT query_id, rank, id AS chunk_id, round(score, 6) AS score FROM bm",
    "dense_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.e, b.e) / (a.n * b.n), 9) + 0.0 AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""",
    "rrf_fusion": f"WITH {_BM25}, {_DENSE}, {_RRF} SELECT query_id, rank, id AS chunk_id, round(s, 9) AS score, bm25_rank, dense_rank FROM rf",
    "retrieval_query_metrics": f"WITH {_DENSE}, {_metrics('m', 'dn', _ALL_Q)} {_PER_QUERY}",
    "retrieval_metrics": f"""WITH {_DENSE}, {_metrics('m', 'dn', _ALL_Q)}, p AS ({_PER_QUERY}) SELECT count(*) AS queries, count(CASE WHEN answerability = 'answerable' THEN 1 END) AS answerable,
  round(avg(hit_at_1), 6) AS hit_at_1, round(avg(hit_at_3), 6) AS hit_at_3, round(avg(hit_at_5), 6) AS hit_at_5, round(avg(relevant_hit_at_1), 6) AS relevant_hit_at_1, round(avg(relevant_hit_at_3), 6) AS relevant_hit_at_3, round(avg(relevant_hit_at_5), 6) AS relevant_hit_at_5,
  (SELECT round(avg(CASE WHEN answerability = 'answerable' AND gc > 0 THEN g5 / gc END), 6) FROM m) AS recall_at_5, (SELECT round(avg(CASE WHEN answerability = 'answerable' THEN coalesce(1.0 / fg, 0) END), 6) FROM m) AS mrr FROM p""",
    "compare_two_way": f"""WITH {_BM25}, {_DENSE}, {_metrics('a', 'bm', _QUESTIONS)}, {_metrics('b', 'dn', _QUESTIONS)}, z AS (SELECT query_id, CASE WHEN a.answerability = 'answerable' THEN a.fg END AS x, CASE WHEN a.answerability = 'answerable' THEN b.fg END AS y FROM a JOIN b USING (query_id))
SELECT query_id, x AS bm25_rank, y AS dense_rank, x - y AS rank_delta, CASE WHEN coalesce(x, 999) < coalesce(y, 999) THEN 'bm25' WHEN coalesce(y, 999) < coalesce(x, 999) THEN 'dense' ELSE 'tie' END AS winner FROM z""",
    "compare_three_way": f"""WITH {_BM25}, {_DENSE}, {_RRF}, {_metrics('a', 'bm', _QUESTIONS)}, {_metrics('b', 'dn', _QUESTIONS)}, {_metrics('c', 'rf', _QUESTIONS)},
z AS (SELECT query_id, coalesce(CASE WHEN a.answerability = 'answerable' THEN a.fg END, 999) AS x, coalesce(CASE WHEN a.answerability = 'answerable' THEN b.fg END, 999) AS y, coalesce(CASE WHEN a.answerability = 'answerable' THEN c.fg END, 999) AS w FROM a JOIN b USING (query_id) JOIN c USING (query_id))
SELECT query_id, x AS bm25_rank, y AS dense_rank, w AS rrf_rank, concat_ws('|', CASE WHEN x = least(x, y, w) THEN 'bm25' END, CASE WHEN y = least(x, y, w) THEN 'dense' END, CASE WHEN w = least(x, y, w) THEN 'rrf' END) AS winners FROM z""",
    "text_normalize": f"SELECT DISTINCT chunk_id, {squeeze('text')} AS normalized, regexp_replace(lower({squeeze('text')}), '\\p{{Nd}}+', '#', 'g') AS signature FROM gold_corpus WHERE text IS NOT NULL",
    "heading_normalize": f"SELECT DISTINCT display_title, {HEADING.replace('{c}', 'display_title')} AS normalized FROM document_structure_map",
    "chunk_hash": f"SELECT DISTINCT chunk_id, sha256(text) AS raw_sha256, sha256({squeeze('text')}) AS text_hash, coalesce(sha256(text) = text_sha256, false) AS hash_ok FROM gold_corpus",
    "dup_text_audit": f"SELECT sha256({squeeze('text')}) AS text_hash, count(DISTINCT chunk_id) AS copies, min(chunk_id) AS first_id FROM gold_corpus WHERE NOT {blank('text')} GROUP BY 1 HAVING count(DISTINCT chunk_id) > 1",
    "sentence_units": f"""WITH x AS (SELECT chunk_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([。！？；])', '\\1' || chr(1), 'g'), '([.!?;])[\\t-\\r ]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '') AS a,
  list_filter(list_transform(regexp_extract_all(text, '(?s).+?(?:[。！？；!?;]+|$)'), lambda s: {strip('s')}), lambda s: s <> '') AS b FROM {GOLD} WHERE text IS NOT NULL)
SELECT chunk_id, CAST(len(a) AS INTEGER) AS spaced, CAST(len(b) AS INTEGER) AS strong, CAST(coalesce(list_max(list_transform(b, lambda s: length(s))), 0) AS INTEGER) AS longest FROM x""",
    "text_fields": f"SELECT chunk_id, {_DENSE_TEXT} AS dense_text, concat_ws(chr(10), '主题：膝', '章节：' || nullif(array_to_string(title_path, ' > '), ''), CASE WHEN {_SOME('text')} IS NOT NULL THEN text END) AS retrieval_text, coalesce({_CITE}, true) AS citation_only FROM {GOLD}",
    "extractability_audit": f"""WITH g AS (SELECT source_id, count(*) AS pages, count(CASE WHEN length({strip("coalesce(text, '')")}) >= 20 THEN 1 END) AS nonempty_pages, CAST(sum(length({strip("coalesce(text, '')")})) AS BIGINT) AS chars, round_even(avg(length({strip("coalesce(text, '')")})), 1) AS mean_chars FROM {PAGES} GROUP BY source_id)
SELECT *, CASE WHEN chars < 500 OR nonempty_pages / pages < 0.3 THEN 'ocr_required' WHEN chars / pages < 200 OR nonempty_pages / pages < 0.7 THEN 'partial' ELSE 'ok' END AS status FROM g""",
    "page_policy_status": f"""WITH p AS (SELECT *, CASE WHEN removed_margin_block_count = 0 THEN 'exclude' WHEN pdf_page_number % 10 = 9 THEN 'exclude_pending' ELSE 'include' END AS cp FROM {PAGES}),
r AS (SELECT *, cp = 'include' AND coalesce(len(list_filter(string_split(text, chr(10)), lambda s: {HEADING.replace('{c}', 's')} = '鉴别诊断')) > 0, false) AS ref FROM p),
a AS (SELECT *, coalesce(bool_or(ref) OVER (PARTITION BY source_id ORDER BY pdf_page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS aft FROM r)
SELECT page_id, cp AS chunk_policy, CASE WHEN aft THEN 'after_references' WHEN cp <> 'include' THEN 'policy_excluded' ELSE 'included' END AS status FROM a""",
    "included_sources": f"SELECT DISTINCT source_id, lower(substr(language, 1, 2)) AS language, try_cast(publication_year AS INTEGER) AS year FROM source_registry WHERE lower({strip('include_status')}) = 'included'",
    "repeated_margin_lines": f"WITH {_LINES} SELECT source_id, signature FROM rm",
    "stripped_pages": f"""WITH {_LINES} SELECT source_id, page, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM bk WHERE NOT (margin AND (source_id, sig) IN (SELECT source_id, signature FROM rm)) AND NOT regexp_matches({strip('text')}, '^\\p{{Nd}}+$') GROUP BY ALL""",
    "chunk_summary": f"SELECT source_id, content_type, count(*) AS chunks, {_STATS}, count(CASE WHEN pdf_page_end > pdf_page_start THEN 1 END) AS cross_page, count(CASE WHEN char_count < 120 THEN 1 END) AS below_minimum FROM {GOLD} GROUP BY ALL",
    "corpus_summary": f"SELECT CASE WHEN grouping(source_id) = 1 THEN 'ALL' ELSE source_id END AS source_id, CASE WHEN grouping(content_type) = 1 THEN 'ALL' ELSE content_type END AS content_type, count(*) AS chunks, {_STATS}, count(CASE WHEN cross_page THEN 1 END) AS cross_page FROM {GOLD} g GROUP BY GROUPING SETS ((g.source_id, g.content_type), ())",
    "title_path": f"""WITH RECURSIVE {_NODES}, lk AS (SELECT n.node_id, n.display_title, p.node_id AS par FROM nodes n LEFT JOIN nodes p ON p.node_id = n.parent_id),
dw AS (SELECT node_id, display_title AS tp FROM lk WHERE par IS NULL UNION ALL SELECT l.node_id, d.tp || ' > ' || l.display_title FROM lk l JOIN dw d ON l.par = d.node_id) SELECT l.node_id, tp AS title_path FROM lk l LEFT JOIN dw d ON l.node_id = d.node_id""",
    "structure_validation": f"WITH {_STRUCT} SELECT * FROM st",
    "structure_status": f"WITH {_STRUCT} SELECT source_id, status, count(*) AS records FROM st GROUP BY ALL",
    "manual_coverage": f"""WITH {_NODES} SELECT source_id, node_id, CASE WHEN extraction_mode = 'manual_table' THEN 'error' ELSE 'note' END AS severity FROM nodes WHERE include_status = 'included' AND extraction_mode IN ('manual_table', 'hybrid') AND node_id NOT IN (SELECT node_id FROM gold_corpus WHERE content_type = 'manual_table_chunk' AND node_id IS NOT NULL)""",
    "benchmark_validation": f"WITH {_BENCH} SELECT query_id, {_REPORT} FROM bv",
    "benchmark_composition": "SELECT count(*) AS questions, count(DISTINCT query_id) AS query_ids, count(CASE WHEN evidence_scope = 'multi_chunk' THEN 1 END) AS multi_chunk, count(CASE WHEN evidence_scope = 'no_gold' THEN 1 END) AS no_gold, count(CASE WHEN len(list_distinct(expected_source_ids)) > 1 THEN 1 END) AS cross_source, count(CASE WHEN review_status = 'verified' THEN 1 END) AS verified FROM (SELECT DISTINCT * FROM retrieval_eval)",
    "benchmark_topics": f"SELECT coalesce(topic, '') AS topic, evidence_scope, review_status, count(*) AS questions FROM {_ALL_Q} GROUP BY ALL",
    "corpus_validation": f"WITH {_CORPUS} SELECT chunk_id, {_REPORT} FROM cv",
    "generation_inputs": f"""WITH {_DENSE}, q AS (SELECT query_id, query, answerability FROM {_ALL_Q} WHERE query_id IS NOT NULL)
SELECT 'generation_top5' AS run_id, query_id, answerability, 5 AS top_k, CAST(count(*) AS INTEGER) AS evidence_count, string_agg(id, '|' ORDER BY rank) AS chunk_ids FROM dn JOIN q USING (query_id) WHERE rank <= 5 AND id IN (SELECT chunk_id FROM gold_corpus) GROUP BY query_id, query, answerability""",
    "prompt_render": """WITH g AS (SELECT DISTINCT run_id, query_id, query, answerability, retrieval_run_id, top_k, evidence FROM generation_run),
p AS (SELECT run_id, query_id, '问题：' || chr(10) || coalesce(query, '') || chr(10) || chr(10) || '检索证据：' || chr(10) || array_to_string(list_transform(evidence, lambda e: '[Evidence ' || e.rank || ']' || chr(10) || '来源：' || coalesce(e.source_id, '') || chr(10) || '章节：' || coalesce(e.title_path, '') || chr(10) || coalesce(e.text, '')), chr(10) || chr(10)) || chr(10) || chr(10) || '请依据以上证据回答问题。' AS u FROM g)
SELECT run_id, query_id, CAST(length(u) AS INTEGER) AS prompt_chars, md5(u) AS prompt_md5, 'prompt_ready' AS generation_status FROM p""",
    "deterministic_rules": f"WITH gen AS (SELECT DISTINCT run_id, query_id, answerability, top_k, len(evidence) AS ne, answer, generation_status FROM generation_run), {_RULES.replace('{src}', 'gen')} SELECT run_id, query_id, answerability, generation_success, answer_nonempty, evidence_count_ok, says_insufficient, unanswerable_ok, deterministic_pass FROM rule",
    "judge_parse": f"""WITH {_JUDGE} SELECT run_id, query_id, CASE WHEN err IS NULL THEN 'success' ELSE 'error' END AS judge_status, CASE WHEN err = 'x' THEN 'not_json' ELSE err END AS judge_error, CAST(CASE WHEN err IS NULL THEN rel END AS INTEGER) AS relevance_score, CAST(CASE WHEN err IS NULL THEN gr END AS INTEGER) AS groundedness_score, CASE WHEN err IS NULL THEN verdict END AS overall_verdict FROM ju""",
    "evaluation_summary": f"WITH {_JUDGE}, {_RULE_GF}, {_SUMMARY} SELECT run_id, query_id, answerability, deterministic_pass, judge_status, CAST(relevance_score AS INTEGER) AS relevance_score, CAST(groundedness_score AS INTEGER) AS groundedness_score, unsupported_claim, overall_verdict, CAST(review_reason <> '' AS INTEGER) AS manual_review, review_reason FROM su",
    "evaluation_totals": f"""WITH {_JUDGE}, {_RULE_GF}, {_SUMMARY} SELECT count(*) AS answers, CAST(sum(deterministic_pass) AS BIGINT) AS deterministic_pass, count(CASE WHEN judge_status = 'success' THEN 1 END) AS judged, count(CASE WHEN overall_verdict = 'pass' THEN 1 END) AS judge_pass, count(CASE WHEN unsupported_claim THEN 1 END) AS unsupported, count(CASE WHEN review_reason <> '' THEN 1 END) AS manual_review,
  round(avg(relevance_score), 3) AS mean_relevance_score, round(avg(groundedness_score), 3) AS mean_groundedness_score, round(avg(CASE WHEN judge_status = 'success' THEN 2 END), 3) AS mean_completeness_score FROM su""",
    "review_queue": f"WITH {_JUDGE}, {_RULE_GF}, {_SUMMARY} SELECT su.run_id, su.query_id, review_reason, CAST(ne AS INTEGER) AS evidence_count, CAST(NULL AS VARCHAR) AS human_verdict FROM su JOIN gen USING (run_id, query_id) WHERE review_reason <> ''",
    "calibration": f"""WITH {_JUDGE}, c AS (SELECT run_id, query_id, err IS NULL AS ok, rel, uns, {_H(9, 4)} > 0 AS same FROM ju),
x AS (SELECT run_id, query_id, 'relevance_score' AS field, CASE WHEN same THEN true WHEN ok THEN rel = 1 ELSE false END AS a FROM c UNION ALL SELECT run_id, query_id, 'groundedness_score', true FROM c UNION ALL SELECT run_id, query_id, 'completeness_score', ok FROM c UNION ALL SELECT run_id, query_id, 'unsupported_claim', NOT ok FROM c UNION ALL SELECT run_id, query_id, 'overall_verdict', true FROM c)
  SELECT run_id, query_id, field, CAST(a AS BIGINT) AS agrees, CAST(1 AS BIGINT) AS compared FROM x UNION ALL SELECT NULL, NULL, field, CAST(sum(CAST(a AS INTEGER)) AS BIGINT), count(*) FROM x GROUP BY field""",
    "seeded_sample": f"SELECT chunk_id, source_id FROM {GOLD} ORDER BY sha256('42|' || chunk_id), chunk_id LIMIT 20",
    "edge_samples": f"""WITH x AS (SELECT source_id, chunk_id, row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) AS i, count(*) OVER (PARTITION BY source_id) AS n, min(CASE WHEN pdf_page_end > pdf_page_start THEN chunk_id END) OVER (PARTITION BY source_id) AS c FROM {GOLD}),
y AS (SELECT source_id, chunk_id, concat_ws('|', CASE WHEN i = 1 THEN 'first' END, CASE WHEN i = (n + 1) // 2 THEN 'middle' END, CASE WHEN i = n THEN 'last' END, CASE WHEN chunk_id = c THEN 'cross_page' END) AS sample_reason FROM x) SELECT * FROM y WHERE sample_reason <> ''""",
    "review_sample": f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY chunk_id DESC) = 1 AS l, node_id IN (SELECT node_id FROM gold_corpus WHERE context_repeated) AS ct FROM {GOLD}),
r AS (SELECT chunk_id, source_id, CASE WHEN content_type = 'manual_table_chunk' THEN 'manual_table' WHEN coalesce(char_count > 700, false) THEN 'high_risk' WHEN coalesce(context_repeated, false) THEN 'continuation' WHEN ct AND regexp_matches(chunk_id, '-C0*1$') THEN 'continuation_start' WHEN l THEN 'last_of_source' END AS sample_reason FROM x),
f AS (SELECT * FROM r WHERE sample_reason IS NOT NULL), o AS (SELECT chunk_id, source_id, row_number() OVER (ORDER BY sha256('42|' || chunk_id), chunk_id) AS k FROM r WHERE sample_reason IS NULL)
SELECT * FROM f UNION ALL SELECT chunk_id, source_id, 'fill' FROM o WHERE k + (SELECT count(*) FROM f) <= 400""",
    "preview_pages": f"SELECT source_id, page_id, pdf_page_number FROM (SELECT source_id, page_id, pdf_page_number, row_number() OVER (PARTITION BY source_id ORDER BY pdf_page_number) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS n FROM {PAGES}) WHERE i < 2 OR i = n // 2 OR i = n - 1",
    "full_text": f"WITH t AS (SELECT source_id, string_agg('===== page ' || pdf_page_number || ' =====' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY pdf_page_number, text) AS t FROM {PAGES} GROUP BY source_id) SELECT source_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS md5 FROM t",
    "authoring_catalog": "SELECT DISTINCT array_to_string(title_path, ' > ') AS title_path, source_id, chunk_id, content_type, display_title, pdf_page_start, pdf_page_end, cross_page, review_status, char_count FROM gold_corpus",
    "embedding_signatures": f"SELECT chunk_id, sha256('model' || chr(31) || '512' || chr(31) || chunk_id || chr(31) || sha256(coalesce({_DENSE_TEXT}, ''))) AS signature FROM {GOLD}",
    "marker_positions": f"""WITH x AS (SELECT p.page_id, coalesce(p.text, '') AS t, s.title AS m FROM {PAGES} p JOIN (SELECT DISTINCT source_id, title FROM source_registry) s USING (source_id)),
y AS (SELECT page_id, t, m, CAST((length(t) - length(replace(t, m, ''))) / length(m) AS INTEGER) AS k, strpos(t, m) AS a FROM x)
SELECT page_id, CASE WHEN k = 0 THEN 'not_found' WHEN k = 1 THEN 'unique' ELSE 'multiple' END AS status, CAST(a - 1 AS INTEGER) AS position, md5(CASE WHEN a > 0 THEN substr(t, greatest(1, a - 10), a - greatest(1, a - 10) + length(m) + 10) ELSE '' END) AS snippet_md5 FROM y""",
}
ORACLE_SQL["table_detections"] = f"""WITH x AS (SELECT source_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '^(?:A组|Group A|合计|Total|对照|Control)'))) AS r, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '^\\d+\\.\\d$'))) AS n FROM {PAGES})
SELECT source_id, CAST(sum(r) AS BIGINT) AS rows_tables, CAST(sum(n) AS BIGINT) AS numbers_tables, CAST(count(CASE WHEN r > 0 THEN 1 END) AS INTEGER) AS rows_pages, CAST(count(CASE WHEN n > 0 THEN 1 END) AS INTEGER) AS numbers_pages, count(CASE WHEN r <> n THEN 1 END) AS differing_pages FROM x GROUP BY source_id"""
ORACLE_SQL["winner_counts"] = f"SELECT winner, count(*) AS queries FROM ({ORACLE_SQL['compare_two_way']}) GROUP BY winner"
ORACLE_SQL |= CHUNK_SQL
_BM25_NFKC = _BM25.replace(tokens(_INDEX), tokens(nfkc(_INDEX))).replace(tokens("query"), tokens(nfkc("query")))
ORACLE_SQL["bm25_topk"] = f"WITH {_BM25_NFKC} SELECT query_id, rank, id AS chunk_id, round(score, 6) AS score FROM bm"
ORACLE_SQL["bm25_term_join"] = f"WITH {_BM25} SELECT query_id, id AS chunk_id, round(score, 6) AS score, terms FROM sc JOIN (SELECT query_id, id, count(*) AS terms FROM post JOIN qt USING (term) GROUP BY ALL) USING (query_id, id)"
ORACLE_SQL["retrieval_metrics_bm25"] = ORACLE_SQL["retrieval_metrics"].replace(f"WITH {_DENSE}, {_metrics('m', 'dn', _ALL_Q)}", f"WITH {_BM25_NFKC}, {_metrics('m', 'bm', _QUESTIONS)}")

_BREAK = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'"
_NUMBERED = f"'^{WS}*\\p{{Nd}}{{1,3}}{WS}+'"
_PIECE = """CASE WHEN b IS NULL THEN a WHEN starts_with(lang, 'en') AND ends_with(a, '-') AND regexp_matches(b, '^\\p{L}') THEN left(a, length(a) - 1)
  WHEN CASE WHEN starts_with(lang, 'zh') THEN regexp_matches(a, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}（《【]$') OR regexp_matches(b, '^[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}，。；：！？、）》】]') ELSE regexp_matches(b, '^[,.;:!?)\\]}]') END THEN a ELSE a || ' ' END"""
ORACLE_SQL["unwrapped_pages"] = f"""WITH x AS (SELECT page_id, lower(coalesce(language, 'zh')) AS lang, text IS NULL AS none, list_filter(list_transform(regexp_split_to_array(text, {_BREAK}), lambda s: regexp_replace(s, '{WS}+$', '')), lambda s: s <> '') AS f FROM {PAGES}),
y AS (SELECT *, list_filter(list_transform(CASE WHEN 2 * len(list_filter(f, lambda s: regexp_matches(s, {_NUMBERED}))) >= len(f) THEN list_transform(f, lambda s: regexp_replace(s, {_NUMBERED}, '')) ELSE f END, lambda s: {squeeze('s')}), lambda s: s <> '') AS l FROM x),
z AS (SELECT page_id, i, a, b, lang FROM (SELECT page_id, lang, unnest(l) AS a, unnest(l[2:] || [NULL]) AS b, generate_subscripts(l, 1) AS i FROM y)),
w AS (SELECT page_id, string_agg({_PIECE}, '' ORDER BY i) AS t FROM z GROUP BY page_id)
SELECT page_id, CASE WHEN NOT none THEN coalesce({squeeze('t')}, '') END AS text FROM y LEFT JOIN w USING (page_id)"""
ORACLE_SQL["cjk_compact"] = f"SELECT DISTINCT chunk_id, {compact(squeeze('text'))} AS compacted FROM gold_corpus WHERE text IS NOT NULL"
_MARKS = "['。', '！', '？', '；', '!', '?', ';']"
ORACLE_SQL["context_selection"] = f"""WITH x AS (SELECT chunk_id, {squeeze('text')} AS t FROM {GOLD} WHERE content_type = 'question_recommendation' AND text IS NOT NULL),
y AS (SELECT *, list_filter({_MARKS}, lambda m: strpos(t, m) > 60 AND strpos(t, m) <= 120)[1] AS near, list_filter({_MARKS}, lambda m: strpos(substr(t, 121, 180), m) > 0)[1] AS far FROM x)
SELECT chunk_id, {compact("CASE WHEN length(t) <= 120 THEN t WHEN near IS NOT NULL THEN left(t, strpos(t, near)) WHEN far IS NOT NULL THEN left(t, 120 + strpos(substr(t, 121, 180), far)) ELSE left(t, 300) END")} AS context FROM y"""
ORACLE_SQL["reading_order"] = f"""WITH {_LINES}, b AS (SELECT source_id, page, i AS block_no, i * 1000.0::DOUBLE / n AS y0, (i + 1) * 1000.0::DOUBLE / n AS y1, i % 9 = 0 AS bar, CASE WHEN i % 9 <> 0 AND i % 2 = 1 THEN 1 ELSE 0 END AS r FROM bl),
f AS (SELECT *, row_number() OVER w AS zone, coalesce(max(y1) OVER (PARTITION BY source_id, page ORDER BY round_even(y0, 1), block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-infinity'::DOUBLE) AS top FROM b WHERE bar WINDOW w AS (PARTITION BY source_id, page ORDER BY round_even(y0, 1), block_no)),
zn AS (SELECT source_id, page, zone, top, y0 AS bottom FROM f UNION ALL SELECT source_id, page, max(zone) + 1, max(y1), 'infinity'::DOUBLE FROM f GROUP BY ALL),
co AS (SELECT b.source_id, b.page, block_no, y0, r, min(CASE WHEN zn.top <= (y0 + y1) / 2 AND (y0 + y1) / 2 < zn.bottom THEN zone END) AS zone, count(zone) AS zones FROM b LEFT JOIN zn ON zn.source_id = b.source_id AND zn.page = b.page WHERE NOT bar GROUP BY ALL),
al AS (SELECT source_id, page, block_no, y0, r, 0 AS q, coalesce(zone, CASE WHEN zones = 0 THEN 1 ELSE 2147483647 END) AS zone FROM co UNION ALL SELECT source_id, page, block_no, y0, 0, 1, zone FROM f)
SELECT source_id, page, CAST(block_no AS INTEGER) AS block_no, CAST(row_number() OVER (PARTITION BY source_id, page ORDER BY zone, q, r, round_even(y0, 1), block_no) AS INTEGER) AS position FROM al"""
ORACLE_SQL["assembled_pages"] = f"""WITH {_LINES}, k AS (SELECT source_id, page, i, {squeeze(f"regexp_replace(text, {_NUMBERED}, '')")} AS t FROM bk WHERE NOT (margin AND (source_id, sig) IN (SELECT source_id, signature FROM rm)) AND NOT regexp_matches({strip('text')}, '^\\p{{Nd}}+$'))
SELECT source_id, page, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text, count(*) AS text_block_count FROM k WHERE t <> '' GROUP BY ALL"""

_SLICES = f"""{_NODES},
lo AS (SELECT n.*, greatest(coalesce(CASE WHEN marker_text <> '' AND len(string_split(text, marker_text)) > coalesce(marker_occurrence, 1) THEN CAST(list_sum(list_transform(string_split(text, marker_text)[: coalesce(marker_occurrence, 1)], lambda y: length(y))) AS BIGINT) + (coalesce(marker_occurrence, 1) - 1) * length(marker_text) END, -1), 0) AS pos
  FROM nodes n LEFT JOIN {PAGES} p ON p.source_id = n.source_id AND p.pdf_page_number = n.pdf_page),
ld AS (SELECT *, lead({{'p': pdf_page, 'o': pos}}) OVER (PARTITION BY source_id ORDER BY node_order NULLS FIRST, node_id) AS nx FROM lo),
bd AS (SELECT ld.*, coalesce(nx.p, m) AS pb, coalesce(nx.o, 2147483647) AS ob FROM ld LEFT JOIN (SELECT source_id, max(pdf_page_number) AS m FROM {PAGES} GROUP BY 1) USING (source_id)),
sl AS (SELECT node_id, page, substr(text, a + 1, greatest(b - a, 0)) AS x FROM (SELECT b.node_id, p.pdf_page_number AS page, p.text, CASE WHEN p.pdf_page_number = b.pdf_page THEN b.pos ELSE 0 END AS a, CASE WHEN p.pdf_page_number = b.pb THEN b.ob ELSE length(p.text) END AS b
  FROM bd b JOIN {PAGES} p ON p.source_id = b.source_id AND p.pdf_page_number BETWEEN b.pdf_page AND b.pb)),
sg AS (SELECT node_id, array_to_string(list(x ORDER BY page), chr(10)) AS seg, min(page) AS ps, max(page) AS pe FROM sl WHERE NOT {blank('x')} GROUP BY 1),
sx AS (SELECT bd.*, coalesce(seg, '') AS seg, coalesce(ps, pdf_page) AS ps, coalesce(pe, pdf_page) AS pe FROM bd LEFT JOIN sg USING (node_id))"""
ORACLE_SQL["node_slice_lead"] = f"WITH {_SLICES} SELECT node_id, ps AS pdf_page_start, pe AS pdf_page_end, CAST(length(seg) AS INTEGER) AS chars FROM sx"

_BARE = lambda c: f"regexp_replace(coalesce({c}, ''), '{WS}+', '', 'g')"
_COVER = lambda c: f"coalesce(list_min(list_filter(range(1, 3 * length({c}) + 2), lambda i: i <= length(s) AND {c} <> '' AND replace(left(s, i), ' ', '') = {c})), 0)"
_RULES_ON = lambda c: f"CASE WHEN node_order % 3 = 0 THEN {squeeze(f'regexp_replace({squeeze(f'replace({c}, chr(25512) || chr(33616), chr(24314) || chr(35758))')}, ' + repr('[（(][^（）()]{0,20}[）)]') + ', ' + repr('') + ', ' + repr('g') + ')')} ELSE {c} END"
_BUILD = f"""WITH RECURSIVE {_SLICES.lstrip()},
lk AS (SELECT n.node_id, coalesce(nullif(n.display_title, ''), nullif(n.marker_text, ''), n.node_id) AS title, p.node_id AS par FROM nodes n LEFT JOIN nodes p ON p.node_id = n.parent_id),
dw AS (SELECT node_id, [title] AS tp FROM lk WHERE par IS NULL UNION ALL SELECT l.node_id, list_append(d.tp, l.title) FROM lk l JOIN dw d ON l.par = d.node_id),
cf AS (SELECT DISTINCT target_chars AS tgt, max_chars AS lim, min_chars AS mn, sentence_overflow_chars AS ov FROM chunk_config WHERE corpus_version = (SELECT min(corpus_version) FROM chunk_config)),
nn AS (SELECT sx.*, coalesce(tp, [display_title]) AS tp, regexp_matches(source_id, '[02468]$') AS byq, {squeeze('seg')} AS s, {_BARE('marker_text')} AS mk, {_BARE('display_title')} AS tk FROM sx LEFT JOIN dw USING (node_id)),
inc AS (SELECT * FROM nn WHERE include_status = 'included' AND extraction_mode IN ('auto_text', 'hybrid')),
hd AS (SELECT *, CASE WHEN length({strip("coalesce(display_title, '')")}) >= length({strip("coalesce(marker_text, '')")}) THEN tk ELSE mk END AS c1, CASE WHEN length({strip("coalesce(display_title, '')")}) >= length({strip("coalesce(marker_text, '')")}) THEN mk ELSE tk END AS c2 FROM inc WHERE NOT (byq AND node_type IN ('question', 'recommendation'))),
bo0 AS (SELECT *, CASE WHEN mk <> '' AND tk <> '' AND (starts_with(mk, tk) OR starts_with(tk, mk)) THEN regexp_replace(substr(s, 1 + CASE WHEN {_COVER('c1')} > 0 THEN {_COVER('c1')} ELSE {_COVER('c2')} END), '^[ :：、，,；;。]+', '') ELSE s END AS b0 FROM hd),
bo1 AS (SELECT *, {_RULES_ON('b0')} AS b1 FROM bo0),
ts AS MATERIALIZED (SELECT bo.node_id, text AS t, tgt, lim, mn, ov FROM (SELECT *, {compact('b1')} AS text FROM bo1) bo, cf WHERE text <> '' AND NOT {_CITE}),
{pack_sentences('ts', 'node_id')},
qb AS (SELECT *, {_RULES_ON('s')} AS b1 FROM inc WHERE byq),
qc AS MATERIALIZED (SELECT *, {compact('b1')} AS body FROM qb),
qr AS (SELECT r.node_id, q.node_id AS qn, q.node_order AS qo, r.node_order AS ro, r.source_id, q.display_title, q.tp, least(q.ps, r.ps) AS ps, greatest(q.pe, r.pe) AS pe, q.body AS q, r.body AS t FROM qc q JOIN qc r ON r.parent_id = q.node_id AND r.source_id = q.source_id WHERE q.node_type = 'question' AND r.node_type = 'recommendation'),
qx AS (SELECT *, list_filter({_MARKS}, lambda m: strpos(t, m) > 60 AND strpos(t, m) <= 120)[1] AS near, list_filter({_MARKS}, lambda m: strpos(substr(t, 121, 180), m) > 0)[1] AS far FROM qr),
qy AS (SELECT *, {compact("CASE WHEN length(t) <= 120 THEN t WHEN near IS NOT NULL THEN left(t, strpos(t, near)) WHEN far IS NOT NULL THEN left(t, 120 + strpos(substr(t, 121, 180), far)) ELSE left(t, 300) END")} AS ctx FROM qx),
qz AS MATERIALIZED (SELECT qy.*, cf.lim - length(q) - length(ctx) - 2 AS room, tgt AS tg, mn AS mi, ov FROM qy, cf),
tr AS MATERIALIZED (SELECT node_id, t, least(room, greatest(300, tg - length(q) - length(ctx))) AS tgt, room AS lim, least(mi, greatest(100, room // 3)) AS mn, ov FROM qz WHERE length(q) >= 4 AND length(t) >= 4 AND room >= 220),
{pack_sentences('tr', 'node_id', '_r')},
ev AS (SELECT chunk_id, min(source_id) AS source_id, min(node_id) AS node_id, min(pdf_page_start) AS pg, min(table_id) AS table_id, min(display_title) AS display_title, min(text) AS text, min(review_status) AS rs FROM gold_corpus WHERE content_type = 'manual_table_chunk' AND text IS NOT NULL GROUP BY chunk_id),
un AS (
  SELECT printf('%s-SEC-%03d-C%02d', source_id, node_order, part_no + 1) AS chunk_id, source_id, node_order AS source_order, node_id, 'section_text' AS content_type, display_title, tp, ps, pe, extraction_mode, 'auto_extracted_structure_validated' AS review_status, 'hierarchy_bounded_section_v3' AS build_method, '' AS question_node_id, '' AS recommendation_node_ids, '' AS table_id, part_no > 0 AS context_repeated, part AS raw FROM pk JOIN nn USING (node_id)
  UNION ALL SELECT printf('%s-QR-%03d-%03d-C%02d', source_id, qo, ro, part_no + 1), source_id, ro, qn, 'question_recommendation', display_title, tp, ps, pe, 'auto_text', 'auto_extracted_structure_validated', 'question_recommendation_v3', qn, node_id, '', part_no > 0, CASE WHEN part_no = 0 THEN q || ' ' || part ELSE q || ' ' || ctx || ' ' || part END FROM pk_r JOIN qz USING (node_id)
  UNION ALL SELECT chunk_id, ev.source_id, nn.node_order, node_id, 'manual_table_chunk', ev.display_title, tp, pg, pg, 'manual_table', 'human_verified', 'manual_table_import_v1', '', '', coalesce(table_id, ''), false, text FROM ev JOIN nn USING (node_id, source_id) WHERE rs = 'human_verified' AND extraction_mode IN ('manual_table', 'hybrid'))
SELECT chunk_id, source_id, source_order, node_id, content_type, display_title, array_to_string(tp, ' > ') AS title_path, ps AS pdf_page_start, pe AS pdf_page_end, ps <> pe AS cross_page, extraction_mode, review_status, build_method, question_node_id, recommendation_node_ids, table_id, context_repeated, {squeeze('raw')} AS text,
  md5(concat_ws(chr(10), '主题：' || nullif(display_title, ''), '章节：' || nullif(array_to_string(tp, ' > '), ''), {squeeze('raw')})) AS retrieval_md5, CAST(length({squeeze('raw')}) AS INTEGER) AS char_count, sha256({squeeze('raw')}) AS text_sha256, 'built' AS corpus_version FROM un"""
ORACLE_SQL["corpus_build"] = _BUILD

_AT = lambda page: f"(SELECT text FROM {PAGES} q WHERE q.source_id = bn.source_id AND q.pdf_page_number = {page})"
ORACLE_SQL["boundary_validation"] = f"""WITH {_BOUNDS},
x AS (SELECT bn.*, (SELECT max(pdf_page_number) FROM {PAGES} q WHERE q.source_id = bn.source_id) AS n, coalesce({_AT('fp')}, '') AS a, coalesce({_AT('rp')}, '') AS z FROM bn),
y AS (SELECT *, CASE WHEN length(sm) = 0 THEN -1 ELSE {_TIMES('a', 'sm')} END AS ka, CASE WHEN length(rm) = 0 THEN -1 ELSE {_TIMES('z', 'rm')} END AS kz FROM x),
v AS (SELECT source_id, concat_ws('; ', CASE WHEN NOT fp BETWEEN 1 AND n THEN 'start_page_out_of_range' END, CASE WHEN NOT ep BETWEEN 1 AND n THEN 'end_page_out_of_range' END, CASE WHEN NOT rp BETWEEN 1 AND n THEN 'tail_page_out_of_range' END, CASE WHEN fp > ep THEN 'start_after_end' END,
  CASE WHEN rp < fp THEN 'tail_before_start' END, CASE WHEN ka = 0 THEN 'start_marker_not_found' END, CASE WHEN kz = 0 THEN 'tail_marker_not_found' END) AS e,
  concat_ws('; ', CASE WHEN rp < ep THEN 'tail_page_before_end_page' END, CASE WHEN ka > 1 THEN 'start_marker_multiple' END, CASE WHEN kz > 1 THEN 'tail_marker_multiple' END) AS w FROM y)
SELECT source_id, {_REPORT} FROM v"""
ORACLE_SQL["marker_order"] = f"""WITH {_NODES}, l AS (SELECT n.*, CASE WHEN left(display_title, 1) <> '' AND len(string_split(p.text, left(display_title, 1))) > coalesce(marker_occurrence, 1) THEN CAST(list_sum(list_transform(string_split(p.text, left(display_title, 1))[: coalesce(marker_occurrence, 1)], lambda y: length(y))) AS BIGINT) + coalesce(marker_occurrence, 1) - 1 END AS pos FROM nodes n JOIN {PAGES} p ON p.source_id = n.source_id AND p.pdf_page_number = n.pdf_page),
o AS (SELECT *, lag(pos) OVER (PARTITION BY source_id, pdf_page ORDER BY node_order NULLS FIRST, node_id) AS prev FROM l WHERE pos >= 0)
SELECT source_id, node_id, pdf_page, CAST(pos AS INTEGER) AS start_pos, CAST(prev AS INTEGER) AS previous_pos FROM o WHERE prev > pos"""
ORACLE_SQL["table_validation"] = f"""WITH {_BOUNDS}, {_NODES.lstrip()},
ev AS (SELECT *, array_to_string(title_path, ' > ') AS scope FROM {GOLD} WHERE content_type = 'manual_table_chunk'),
ex AS (SELECT ev.*, n.source_id AS ns, n.include_status AS ni, n.extraction_mode AS nm, n.pdf_page AS np, n.node_id IS NOT NULL AS found, fp, ep, count(*) OVER (PARTITION BY chunk_id) > 1 AS dup, count(*) OVER (PARTITION BY sha256({squeeze('ev.text')})) > 1 AS dupt
  FROM ev LEFT JOIN nodes n ON n.node_id = ev.node_id LEFT JOIN bn ON bn.source_id = ev.source_id),
v AS (SELECT DISTINCT chunk_id AS record_id, source_id, node_id, concat_ws('; ', CASE WHEN NOT coalesce(pdf_page_start >= 1, false) THEN 'invalid_pdf_page' END, CASE WHEN {blank('chunk_id')} THEN 'empty_record_id' END, CASE WHEN dup THEN 'duplicate_record_id' END, CASE WHEN {blank('node_id')} THEN 'empty_node_id' END,
  CASE WHEN ns IS NULL THEN 'structure_node_not_found' END, CASE WHEN ns <> source_id THEN 'structure_source_mismatch' END, CASE WHEN ni <> 'included' THEN 'structure_node_not_included' END, CASE WHEN nm NOT IN ('manual_table', 'hybrid') THEN 'structure_node_not_manual_or_hybrid' END,
  CASE WHEN ns IS NOT NULL AND NOT coalesce(np >= 1, false) THEN 'invalid_structure_pdf_page' END, CASE WHEN fp IS NULL THEN 'document_boundary_not_found' END, CASE WHEN NOT pdf_page_start BETWEEN fp AND ep THEN 'evidence_outside_document_body' END,
  CASE WHEN NOT coalesce(extraction_mode IN ('manual_table', 'hybrid'), false) THEN 'invalid_evidence_extraction_mode' END, CASE WHEN coalesce(review_status, '') <> 'human_verified' THEN 'evidence_not_human_verified' END,
  CASE WHEN {blank('table_id')} THEN 'empty_table_id' END, CASE WHEN {blank('display_title')} THEN 'empty_table_title' END, CASE WHEN {blank('display_title')} THEN 'empty_display_title' END, CASE WHEN {blank('scope')} THEN 'empty_scope' END, CASE WHEN {blank('text')} THEN 'empty_text' END, CASE WHEN dupt AND NOT {blank('text')} THEN 'duplicate_evidence_text' END) AS e,
  concat_ws('; ', CASE WHEN pdf_page_start <> np THEN 'evidence_page_differs_from_structure_start_page' END, CASE WHEN length(text) < 40 THEN 'text_unusually_short' END) AS w FROM ex)
SELECT record_id, source_id, node_id, {_REPORT} FROM v"""
