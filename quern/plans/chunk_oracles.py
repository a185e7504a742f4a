"""SQL of the chunkers: each chunk's end and its successor's start in closed form, followed from chunk to chunk by recursion."""

import re

from .oracle_parts import HEADING, PAGES, WS, squeeze, strip

STOP = "鉴别诊断"
_START = r"^[一二三四五六七八九十]+、|^\d+(?:\.\d+)*[.、]\s*\S+|^(?:推荐意见|推荐建议|临床问题|问题)\s*\d+|^(?i:recommendation|question)\s*\d+"
_LABEL = r"^((?:推荐意见|推荐建议|临床问题|问题)\s*\d+|(?i:recommendation|question)\s*\d+)"
_STRONG = "。！？；!?;"

#: Included pages with the registry's language; n is the page, l its non-empty lines up to a stop heading.
PREPARED = f"""
pp AS (SELECT p.source_id, pdf_page_number AS page, text, removed_margin_block_count = 0 OR pdf_page_number % 10 = 9 AS out, lower(r.language) AS lang FROM {PAGES} p JOIN (SELECT source_id, max(language) AS language FROM source_registry GROUP BY 1) r USING (source_id)),
lp AS (SELECT *, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: {squeeze('s')}), lambda s: s <> '') AS al FROM pp),
sp AS (SELECT *, NOT out AND len(list_filter(al, lambda s: {HEADING.replace('{c}', 's')} = '{STOP}')) > 0 AS ref FROM lp),
ip AS (SELECT * FROM sp WHERE NOT out AND NOT coalesce((SELECT min(page) FROM sp z WHERE z.ref AND z.source_id = sp.source_id) < page, false)),
il AS (SELECT source_id, page, lang, CASE WHEN ref THEN al[: list_min(list_filter(range(1, len(al) + 1), lambda i: {HEADING.replace('{c}', 'al[i]')} = '{STOP}')) - 1] ELSE al END AS l FROM ip)"""


def _pack(name: str, limit: int, overlap: int, lead: str, fixed: str, keys: str) -> str:
    """Chunks [a, b) of the packed lists of ``name``: its texts t, prefix sums p of lengths with separators, and size n."""
    width = lambda a, b: f"(p[{b} + 1] - p[{a} + 1] - 2)"
    end = lambda a: f"coalesce(list_min(list_filter(range({a} + 1, n), lambda z: {lead.replace('$', a)} + {width(a, 'z + 1')} > {limit})), n)"
    back = f"coalesce(list_min(list_filter(range(greatest(a, {fixed}), b), lambda z: {width('z', 'b')} <= {overlap})), greatest(b - 1, least(b, {fixed})))"
    new = f"list_min(list_filter(range(k, b + 1), lambda z: z = b OR {lead.replace('$', 'z')} + {width('z', 'b + 1')} <= {limit}))"
    return f"""
{name}_c AS (SELECT {keys}, 0 AS i, 0::BIGINT AS a, {end('0')} AS b FROM {name}
  UNION ALL SELECT {keys}, i + 1, a2, {end('a2')} FROM (SELECT *, {new} AS a2 FROM (SELECT g.*, c.i, c.a, c.b, {back.replace('greatest(a,', 'greatest(c.a,').replace(', b)', ', c.b)')} AS k FROM {name}_c c JOIN {name} g USING ({keys}) WHERE c.b < g.n)))"""


def _lists(source: str, keys: str, order: str, more: str = "") -> str:
    """Per group its texts, prefix sums of length + 2, and page ranges, in order."""
    return f"""SELECT {keys}, list(t ORDER BY {order}) AS t, list_prepend(0::BIGINT, list(s ORDER BY {order})) AS p, list(ps ORDER BY {order}) AS ps, list(pe ORDER BY {order}) AS pe, count(*) AS n{more}
  FROM (SELECT *, CAST(sum(length(t) + 2) OVER (PARTITION BY {keys} ORDER BY {order}) AS BIGINT) AS s FROM {source}) GROUP BY {keys}"""


_SPACED = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace({{c}}, '([。！？；])', '\\1' || chr(1), 'g'), '([.!?;]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"
_STARTS = f"(regexp_matches(t, '{_START}') OR (length(t) <= 80 AND regexp_matches(t, '^[A-Z][A-Z0-9 /,&():\\-]+$')))"

SECTIONS = f"""{PREPARED},
su AS (SELECT source_id, page, lang, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM il),
sj AS (SELECT *, lag(t) OVER w AS pt, lag(page) OVER w AS pq, (source_id, page - 1) IN (SELECT source_id, page FROM il) AS fo FROM su WINDOW w AS (PARTITION BY source_id ORDER BY page, i)),
sk AS (SELECT *, CAST(sum(CASE WHEN coalesce(pq < page AND fo AND NOT regexp_matches(pt, '[。！？；.!?;：:]$') AND NOT {_STARTS}, false) THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY page, i) AS BIGINT) AS island FROM sj),
si AS (SELECT source_id, island, min(page) AS ps, max(page) AS pe, CASE WHEN starts_with(lang, 'zh') THEN string_agg(t, '' ORDER BY page, i) ELSE string_agg(t, ' ' ORDER BY page, i) END AS t FROM sk GROUP BY source_id, island, lang),
sn AS (SELECT *, CAST(sum(CASE WHEN island = 1 OR {_STARTS} THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY island) AS BIGINT) AS section_no, {_STARTS} AS st,
  CASE WHEN regexp_extract(t, '{_LABEL}', 1) <> '' THEN regexp_extract(t, '{_LABEL}', 1) WHEN length(t) <= 100 THEN t ELSE '' END AS own FROM si),
sh AS (SELECT source_id, section_no, CASE WHEN arg_min(st, island) THEN arg_min(own, island) ELSE '' END AS heading FROM sn GROUP BY ALL)"""

SECTION_CHUNKS = f"""WITH RECURSIVE {SECTIONS},
sa AS (SELECT source_id, section_no, island, ps, pe, unnest({_SPACED.replace('{c}', 't')}) AS t, generate_subscripts({_SPACED.replace('{c}', 't')}, 1) AS j FROM sn),
sg0 AS ({_lists('sa', 'source_id, section_no', 'island, j')}),
sg AS (SELECT sg0.*, heading FROM sg0 JOIN sh USING (source_id, section_no)),
{_pack('sg', 1200, 120, "(CASE WHEN heading = '' OR starts_with(t[$ + 1], heading) THEN 0 ELSE length(heading) + 2 END)", '0', 'source_id, section_no')},
so AS (SELECT source_id, section_no, i, heading, CASE WHEN heading = '' OR starts_with(t[a + 1], heading) THEN '' ELSE heading || chr(10) || chr(10) END || array_to_string(t[a + 1 : b], chr(10) || chr(10)) AS text, list_min(ps[a + 1 : b]) AS page_start, list_max(pe[a + 1 : b]) AS page_end FROM sg_c JOIN sg USING (source_id, section_no))
SELECT source_id, section_no, printf('%s-S%03d-C%03d', source_id, section_no, row_number() OVER (PARTITION BY source_id ORDER BY section_no, i)) AS chunk_id, heading, page_start, page_end, text, CAST(length(text) AS INTEGER) AS char_count FROM so"""

_LETTERS = "length(regexp_replace(t, '[^\\p{L}]', '', 'g'))"
_IS_HEADING = f"""(t <> '' AND length(t) <= 90 AND NOT regexp_matches(t, '[。；.;，,]$') AND CASE WHEN starts_with(lang, 'zh') THEN regexp_matches(t, '^(?:[一二三四五六七八九十]+、\\S.{{0,60}}|[（(][一二三四五六七八九十]+[）)]\\S.{{0,60}}|(?:推荐意见|推荐建议|临床问题|问题)\\s*\\d+\\S*.{{0,60}})$')
  ELSE regexp_matches(t, '(?i)^(?:RECOMMENDATION|QUESTION)\\s+\\d+\\S*.{{0,60}}$') OR ({_LETTERS} > 0 AND length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) / nullif({_LETTERS}, 0) >= 0.85 AND len(string_split(t, ' ')) <= 12) END)"""
_ITEM = r"^(?:\d+[.、）)]|[（(][一二三四五六七八九十\d]+[）)]|[①②③④⑤⑥⑦⑧⑨⑩]|[-•])"

BOUNDARY_CHUNKS = f"""WITH RECURSIVE {PREPARED},
wl AS (SELECT source_id, page, lang, list_filter(l, lambda s: NOT regexp_matches(s, '^[0-9]{{1,4}}$')) AS l FROM (SELECT source_id, page, lang, al AS l FROM ip)),
bu AS (SELECT source_id, page, lang, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM wl),
bh AS (SELECT *, {_IS_HEADING} AS h FROM bu),
bj AS (SELECT *, lag(t) OVER w AS pt, lag(page) OVER w AS pq, lag(h) OVER w AS ph, (source_id, page - 1) IN (SELECT source_id, page FROM ip) AS fo FROM bh WINDOW w AS (PARTITION BY source_id ORDER BY page, i)),
bk AS (SELECT *, CAST(sum(CASE WHEN coalesce((fo OR pq = page) AND NOT h AND NOT ph AND NOT regexp_matches(pt, '[。！？；.!?;]$') AND NOT regexp_matches(t, '{_ITEM}'), false) THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY page, i) AS BIGINT) AS island FROM bj),
be AS (SELECT *, lead(t) OVER (PARTITION BY source_id, island ORDER BY page, i) IS NULL AS fin FROM bk),
bi AS (SELECT source_id, island, max(h) AS h, min(page) AS ps, max(page) AS pe, {squeeze("string_agg(CASE WHEN fin OR starts_with(lang, 'zh') THEN t WHEN t LIKE '%-' THEN left(t, length(t) - 1) ELSE t || ' ' END, '' ORDER BY page, i)")} AS t FROM be GROUP BY source_id, island),
br AS (SELECT *, CAST(sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY island) AS BIGINT) AS run FROM bi),
ba AS (SELECT source_id, run, island, h, ps, pe, unnest(CASE WHEN h THEN [t] ELSE {_SPACED.replace('{c}', 't')} END) AS t, generate_subscripts(CASE WHEN h THEN [t] ELSE {_SPACED.replace('{c}', 't')} END, 1) AS j FROM br),
bg AS ({_lists('ba', 'source_id, run', 'island, j', ', CAST(max(h) AS INTEGER) AS f, coalesce(max(CASE WHEN h THEN t END), chr(0)) AS heading')}),
{_pack('bg', 1000, 100, '0', 'f', 'source_id, run')},
bd AS (SELECT source_id, heading, array_to_string(t[a + 1 : b], chr(10) || chr(10)) AS text, list_min(ps[a + 1 : b]) AS ps, list_max(pe[a + 1 : b]) AS pe, row_number() OVER (PARTITION BY source_id ORDER BY run, i) AS d FROM bg_c JOIN bg USING (source_id, run)),
bm AS (SELECT source_id, d, heading, 1 AS m, text AS whole FROM bd WHERE d = 1
  UNION ALL SELECT b.source_id, b.d, b.heading, CASE WHEN ok THEN m ELSE m + 1 END, CASE WHEN ok THEN whole || chr(10) || chr(10) || b.text ELSE b.text END
  FROM (SELECT bd.*, bm.m, bm.whole, length(bd.text) < 250 AND bd.heading = bm.heading AND length(bm.whole) + 2 + length(bd.text) <= 1000 AS ok FROM bm JOIN bd ON bd.source_id = bm.source_id AND bd.d = bm.d + 1) b),
bo AS (SELECT bm.source_id, m, arg_min(bm.heading, bm.d) AS heading, string_agg(text, chr(10) || chr(10) ORDER BY bm.d) AS text, arg_min(ps, bm.d) AS page_start, max(pe) AS page_end FROM bm JOIN bd ON bd.source_id = bm.source_id AND bd.d = bm.d GROUP BY ALL)
SELECT source_id, printf('%s-B%03d', source_id, m) AS chunk_id, replace(heading, chr(0), '') AS heading, page_start, page_end, text, CAST(length(text) AS INTEGER) AS char_count FROM bo"""

_BARE = f"regexp_replace(replace(replace(s, chr(160), ' '), chr(12288), ' '), '[ \\t]+', ' ', 'g')"
_PARA = f"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '\\n{WS}*\\n', chr(1), 'g'), chr(1)), lambda s: {strip(_BARE)}), lambda s: s <> '')"

BASELINE_CHUNKS = f"""WITH RECURSIVE {PREPARED},
ap AS (SELECT source_id, page, unnest({_PARA}) AS para, generate_subscripts({_PARA}, 1) AS i FROM pp WHERE NOT out),
aw AS (SELECT source_id, page, i, unnest(CASE WHEN length(para) <= 900 THEN [para] ELSE list_transform(string_split(regexp_replace(para, '([。！？；.!?;]){WS}*', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}) END) AS s,
  generate_subscripts(CASE WHEN length(para) <= 900 THEN [para] ELSE string_split(regexp_replace(para, '([。！？；.!?;]){WS}*', '\\1' || chr(1), 'g'), chr(1)) END, 1) AS j FROM ap),
ax AS (SELECT source_id, page, i, j, q, {strip('substr(s, q * 900 + 1, 900)')} AS t, page AS ps, page AS pe FROM (SELECT *, unnest(range(0, CAST(ceil(length(s) / 900) AS BIGINT))) AS q FROM aw)),
ag AS ({_lists("(SELECT * FROM ax WHERE t <> '')", 'source_id, page', 'i, j, q')}),
{_pack('ag', 900, 150, '0', '0', 'source_id, page')},
ao AS (SELECT source_id, page, i, array_to_string(t[a + 1 : b], chr(10) || chr(10)) AS text FROM ag_c JOIN ag USING (source_id, page))
SELECT source_id, page, printf('%s-P%03d-C%02d', source_id, page, i + 1) AS chunk_id, CAST(i + 1 AS INTEGER) AS chunk_no, text, CAST(length(text) AS INTEGER) AS char_count FROM ao"""

_W = "left(r, lim + 1)"
_LAST = lambda marks: f"length(regexp_extract({_W}, '(?s)^(.*[{marks}])', 1))"
_CUT = f"""CASE WHEN {_LAST(_STRONG)} - 1 >= CAST(floor(lim * 0.45) AS BIGINT) THEN {_LAST(_STRONG)}
  WHEN regexp_matches(substr(r, lim + 1, ov + 1), '[{_STRONG}]') THEN lim + length(regexp_extract(substr(r, lim + 1, ov + 1), '(?s)^([^{_STRONG}]*)', 1)) + 1
  WHEN num IS NOT NULL THEN num WHEN {_LAST('，,、：:')} - 1 >= CAST(floor(lim * 0.85) AS BIGINT) THEN {_LAST('，,、：:')} ELSE lim END"""
_NUM = f"list_max(list_filter(range(CAST(floor(lim * 0.45) AS BIGINT), length({_W})), lambda i: regexp_matches(substr({_W}, i + 1, 3), '^(?:[1-9]|1[0-9])\\.') AND (i = 0 OR NOT regexp_matches(substr(r, i, 1), '[0-9.]'))))"


def pack_sentences(texts: str, keys: str, mark: str = "") -> str:
    """CTEs: ``pk`` has the parts of ``texts``, which has the keys, t, tgt, lim, mn and ov; ``mark`` is put behind the names."""
    using = keys
    sql = f"""
pu AS (SELECT {keys}, tgt, lim, mn, ov, unnest(u) AS r, generate_subscripts(u, 1) AS k FROM (SELECT *, list_filter(list_transform(regexp_extract_all(t, '(?s).+?(?:[{_STRONG}]+|$)'), lambda s: {strip('s')}), lambda s: s <> '') AS u FROM {texts} WHERE length(t) > lim)),
pl AS (SELECT {keys}, k, 0 AS j, lim, ov, r, '' AS piece FROM pu WHERE length(r) > lim
  UNION ALL SELECT {keys}, k, j + 1, lim, ov, {strip('substr(r, ct + 1)')}, {strip('left(r, ct)')} FROM (SELECT *, CASE WHEN length(r) > lim THEN {_CUT} ELSE length(r) END AS ct FROM (SELECT *, {_NUM} AS num FROM pl WHERE r <> ''))),
pv AS (SELECT {keys}, k, 0 AS j, r AS u FROM pu WHERE length(r) <= lim UNION ALL SELECT {keys}, k, j, piece FROM pl WHERE piece <> ''),
pq AS (SELECT {keys}, tgt, lim, mn, ov, u, row_number() OVER (PARTITION BY {keys} ORDER BY k, j) AS n FROM pv JOIN (SELECT {keys}, tgt, lim, mn, ov FROM {texts}) USING ({keys})),
ps AS (SELECT {keys}, n, 1 AS c, u AS cur, tgt, lim, mn, ov FROM pq WHERE n = 1
  UNION ALL SELECT {keys}, n, CASE WHEN fresh THEN c + 1 ELSE c END, CASE WHEN fresh THEN u ELSE cur || u END, tgt, lim, mn, ov
  FROM (SELECT pq.*, ps.c, ps.cur, length(cur) + length(pq.u) > pq.lim + pq.ov OR (length(cur) >= pq.tgt AND regexp_matches(cur, '[{_STRONG}]$')) AS fresh FROM ps JOIN pq USING ({using}) WHERE pq.n = ps.n + 1)),
pw AS (SELECT {keys}, c, arg_max(cur, n) AS x, any_value(lim) AS lim, any_value(mn) AS mn, any_value(ov) AS ov, max(c) OVER (PARTITION BY {keys}) AS top FROM ps GROUP BY {keys}, c),
pz AS (SELECT *, lag(x) OVER (PARTITION BY {keys} ORDER BY c) AS px, lead(x) OVER (PARTITION BY {keys} ORDER BY c) AS nx, lead(c) OVER (PARTITION BY {keys} ORDER BY c) = top AS nl FROM pw),
pk AS (SELECT {keys}, CAST(c - 1 AS INTEGER) AS part_no, CASE WHEN nl AND length(nx) < mn AND length(x) + length(nx) <= lim + ov THEN x || nx ELSE x END AS part FROM pz WHERE NOT (c = top AND top > 1 AND length(x) < mn AND length(px) + length(x) <= lim + ov)
  UNION ALL SELECT {keys}, 0, t FROM {texts} WHERE length(t) <= lim AND t <> '')"""
    return re.sub(r"\b(p[ulvqswzk])\b", rf"\1{mark}", sql)


def compact(c: str) -> str:
    """Blanks out of Chinese text; twice, as a single ideograph stands between two blanks."""
    one = lambda x: f"regexp_replace({x}, '([\\x{{3400}}-\\x{{9fff}}]){WS}+([\\x{{3400}}-\\x{{9fff}}])', '\\1\\2', 'g')"
    marks = f"regexp_replace({one(one(c))}, '{WS}+([，。；：、！？、）】])', '\\1', 'g')"
    return squeeze(f"regexp_replace({marks}, '([（【]){WS}+', '\\1', 'g')")


GOLD_PACK = f"""WITH RECURSIVE tx AS MATERIALIZED (SELECT corpus_version AS config, chunk_id, {compact(squeeze('text'))} AS t, target_chars AS tgt, max_chars AS lim, min_chars AS mn, sentence_overflow_chars AS ov FROM
  (SELECT DISTINCT * EXCLUDE (corpus_version) FROM gold_corpus WHERE text IS NOT NULL), (SELECT DISTINCT corpus_version, target_chars, max_chars, min_chars, sentence_overflow_chars FROM chunk_config)),
{pack_sentences('tx', 'config, chunk_id')} SELECT config, chunk_id, part_no, part AS text FROM pk"""

CHUNK_SQL = {
    "baseline_chunks": BASELINE_CHUNKS,
    "section_chunks": SECTION_CHUNKS,
    "boundary_chunks": BOUNDARY_CHUNKS,
    "gold_pack": GOLD_PACK,
    "section_carry_forward": f"WITH {SECTIONS} SELECT source_id, island, section_no, heading, CAST(length(t) AS INTEGER) AS chars FROM sn JOIN sh USING (source_id, section_no)",
}
