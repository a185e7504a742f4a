"""Sentence boundaries across languages and scripts (problem 4).

The rules are compiled into a finite transducer.  Its input symbols are events:
sentence marks, quotes and, in Thai, blanks, each classed by a bounded window of
context (is the dot an abbreviation's, a decimal's, a list number's; what follows).
Its states say whether a sentence has begun and what kind of quotation is open:

    fresh  nothing of the next sentence seen       start  in a quotation that opened the sentence
    inside in a sentence, no quotation open        after  in a quotation opened after a colon or comma
                                                   middle in a quotation opened elsewhere

A text is cut into chunks.  Each chunk becomes a transition function, the exit state
and sentence ends for every entry state, worked out by any task without knowing what
came before; a parallel prefix scan composes the functions of a text and so picks
the ends that hold.  Whether a quotation is ever closed, which a chunk may not see,
comes to it from a suffix scan over the quotes of the chunks behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, table
from . import canon

#: Characters of one chunk, and those around it that its events look at.
CHUNK, CONTEXT = 16_384, 64
#: Characters before a dot that are looked at.
BEFORE = 40

# Abbreviations never closing a sentence by their dot.
NEVER = set("vs e.g i.e eg ie cf viz approx ca resp incl excl esp dr prof mr mrs ms st sr sra dra dres z.b d.h bzw evtl ggf inkl vgl ej p.ej pag aprox núm डॉ श्री श्रीमती al".split())
# Abbreviations only before a number or a sign.
BEFORE_NUMBER = set("no nos nr fig figs sect sec tab vol ver rev p pp min max art eq ch ref núm abb kap s pos st".split())
# Abbreviations that may close a sentence.
CLOSING = set("etc usw a.m p.m am pm q.d b.i.d t.i.d q.i.d u.s u.k u.a ff jr inc ltd co".split())
# German words before an ordinal number.
ORDINAL = set("am im vom zum der die das den dem des bis seit beim ab nach zur jeden jedem".split())
# Common first words of a sentence, which close one after a single capital letter.
STARTERS = set("The This That These In It A An For After At As When If Most Many There Symptoms Patients".split())
# Words with which a Chinese or Japanese sentence goes on after a quotation.
GOES_ON = tuple("的 是 这 那 等 与 和 或 为 也 都 就 并 而 及 之 则 被 成 作 とと と は が を に の で も など という って".split())

# Those of them with which it goes on even after a quotation that a colon announced.
GOES_ON_ALWAYS = ("的", "等", "这样", "と", "という", "って")

CJK = re.compile(r"[\u2e80-\u2fdf\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff\uac00-\ud7af]")
THAI = re.compile(r"[\u0e01-\u0e4e]")
_INVISIBLE = "\u00ad\u200b-\u200f\u2060-\u2064\ufeff"
_CLOSE = "”’」』»"
_OPEN = "“「『„«"
_PAIR = {"“": "”", "„": "“”", "「": "」", "『": "』", "«": "»", '"': '"'}
_MARK = ".．。｡!！?？।॥۔؟…‥‼⁇⁈⁉"
_EVENT = re.compile(f"[{_MARK}]+(?:[{_INVISIBLE}]*[{_CLOSE}\"\\])）】])*|[{_OPEN}]|[{_CLOSE}]|\"")
_EVENT_THAI = re.compile(_EVENT.pattern + r"|\s+")
_STRONG = set("。｡!！?？।॥۔؟‼⁇⁈⁉")
_TOKEN = re.compile(r"(?:[^\W_]|[\u0900-\u0963])(?:[^\W_]|[\u0900-\u0963]|[.’'](?=[^\W_]))*$")
_SKIP = re.compile(f"[\\s{_INVISIBLE}]*")
_TAIL = re.compile(f"[\\s{_INVISIBLE}]+$")
_WORD = re.compile(r"[^\W\d_]+")

_NEXT_QUOTE = {c: re.compile("[" + c + shut + "]") for c, shut in _PAIR.items()}
QUOTES = tuple(_PAIR)

STATES = FRESH, INSIDE, START, AFTER, MIDDLE = range(5)
KINDS = OPEN, CLOSE, END, QUOTED, THAI_BLANK, BREAK = range(6)
#: What follows an end: nothing, a word that goes on, one that starts anew, ideographs, those that likely or surely go on.
FOLLOWS = EOT, LOW, NEW, IDEO, IDEO_ON, IDEO_SURE = range(6)


def _step(state: int, kind: int, follow: int, lead: bool, content: bool) -> tuple[int, bool]:
    """(next state, whether a sentence ends) of the transducer; ``content`` says that anything visible lies between the last event and this."""
    if kind == BREAK:
        return (INSIDE if state == FRESH and content else state), False
    if kind == OPEN:
        if state == FRESH and not content:
            return START, False
        return ((AFTER if lead else MIDDLE) if state in (FRESH, INSIDE) else state), False
    if kind == CLOSE:
        return INSIDE, False
    if kind == QUOTED:
        on = follow in (LOW, IDEO_SURE) or (follow == IDEO_ON and state != AFTER) or (follow in (IDEO, IDEO_ON) and state == START)
        return (INSIDE, False) if on and follow not in (EOT, NEW) else (FRESH, True)
    ends = state in (FRESH, INSIDE) and (content if kind == THAI_BLANK else follow != LOW)
    return (FRESH, True) if ends else (state, False)


#: The compiled transducer: by symbol, which is ((kind * 6 + follow) * 2 + lead) * 2 + content, and state the next state, and the same number negative and less one where a sentence ends.
TABLE = [[-1 - to if ends else to for to, ends in (_step(s, k, f, lead, content) for s in STATES)] for k in KINDS for f in FOLLOWS for lead in (False, True) for content in (False, True)]


def _follow(text: str, at: int) -> tuple[int, int]:
    """(what follows, position of the next visible character)."""
    at = _SKIP.match(text, at).end()
    if at >= len(text):
        return EOT, at
    c = text[at]
    if c in ",;:，；：、,;)）]】%％" or c in _CLOSE or c in ".。．":
        return LOW, at
    if CJK.match(c):
        return (IDEO_SURE if text.startswith(GOES_ON_ALWAYS, at) else IDEO_ON if text.startswith(GOES_ON, at) else IDEO), at
    word = canon.canonical(text[at : at + 24])
    m = _WORD.match(word)
    if m and m.group()[0].islower():
        return (NEW if any(x.isupper() for x in m.group()) else LOW), at
    return NEW, at


def _dot_ends(text: str, at: int, end: int) -> bool:
    """Whether the single dot at ``at`` ends a sentence; ``end`` is behind its closing quotes."""
    follow, nxt = _follow(text, end)
    if follow == EOT:
        return True
    c = text[nxt]
    spaced = nxt > end and any(x.isspace() for x in text[end:nxt])
    before = text[max(0, at - BEFORE) : at]
    if not before.isascii():
        before = canon.canonical(before)
    m = _TOKEN.search(before)
    token = m.group() if m else ""
    low = token.lower()
    lead = before[: m.start()] if m else before
    ideo = bool(CJK.search(before[-14:]) or CJK.search(text[nxt : nxt + 14]))
    digit = c.isdigit()
    if end == at + 1 and token and token[-1].isdigit() and digit and (not spaced or ideo or (CJK.search(before) and text[end:nxt].strip(" ") == "\n")):
        return False  # a decimal or version, also one wrapped between lines of ideographs
    if follow == LOW and c in ",;:，；：、,;)）]】%％.。．":
        return False
    if low in NEVER or (low in BEFORE_NUMBER and (digit or c in "#(（" or ideo)):
        return False
    if low.rpartition(".")[2] in NEVER and "." in low:
        return False
    if token.isdigit():
        if follow == LOW:
            return False
        left = lead.rstrip()
        word = re.search(r"[^\W\d_]+$", left)
        if not left or left[-1] in ":;,、(-•" or lead.endswith("\n") or (word is None and left[-1] in "：；，（"):
            return False  # a list number
        return not (word and word.group().lower() in ORDINAL and not ideo and c.isupper())
    if low in CLOSING or ("." in low and len(low) <= 6):
        return follow == NEW and not digit and spaced
    if len(token) == 1 and token.isalpha() and token.isascii():
        if follow != NEW or not spaced:
            return follow == IDEO and not spaced and token.isupper()
        word = _WORD.match(text, nxt)
        return token.isupper() and bool(word) and word.group() in STARTERS and bool(re.search(r"[a-z]\s$", lead))
    if follow == LOW:
        return spaced and len(token) >= 5
    if not spaced and c.isascii() and c.isalpha():
        return c.isupper() and len(token) > 1
    return True


def _opens(text: str, s: int) -> bool:
    """Whether a straight quote stands where a quotation opens."""
    return (s == 0 or text[s - 1].isspace() or text[s - 1] in "：:（(，,") and not text[s + 1 : s + 2].isspace()


def _quote(text: str, c: str, a: int, b: int) -> int:
    """The next quote in [a, b) that matters to a quotation opened by ``c``: 1 closes it, -1 opens another one first, 0 there is none."""
    m = _NEXT_QUOTE[c].search(text, a, b)
    if not m:
        return 0
    return -1 if m.group() == c and (c != '"' or _opens(text, m.start())) else 1


def first_quotes(text: str, a: int, b: int) -> list[int]:
    return [_quote(text, c, a, b) for c in QUOTES]


def _symbols(text: str, a: int, b: int, thai: bool, later: list[int]) -> tuple[list[int], list[int]]:
    """(symbols, positions behind them) of the events that begin in [a, b), and the break at the end; ``later`` are the next quotes behind b."""
    symbols, places = [], []
    done = a

    def put(kind: int, at: int, follow: int, lead: bool = False, upto: int | None = None) -> None:
        nonlocal done
        # Only these symbols ask what lies before them.
        content = (kind == OPEN or kind >= THAI_BLANK) and _content(text, done, at if upto is None else upto)
        symbols.append(((kind * 6 + follow) * 2 + lead) * 2 + content)
        places.append(at)
        done = at

    for m in (_EVENT_THAI if thai else _EVENT).finditer(text, a):
        s, e = m.span()
        if s >= b:
            break
        x = m.group()
        c = x[0]
        if c in _MARK:
            n = 1
            while n < len(x) and x[n] in _MARK:
                n += 1
            run, quotes = x[:n], x[n:]
            if not _STRONG.isdisjoint(run):
                ends, (follow, _) = True, _follow(text, e)
                if follow == LOW and not quotes and text[e : e + 1] not in ")）":
                    follow = NEW  # a strong mark ends whatever comes, except inside brackets or quotes
            elif n == 1 and c in ".．":
                ends = _dot_ends(text, s, e)
                follow = _follow(text, e)[0]
                if ends and not quotes:
                    follow = NEW
            else:
                ends, follow = False, LOW
            if any(q in _CLOSE or q == '"' for q in quotes):
                put(QUOTED if ends else CLOSE, e, follow)
            elif ends:
                put(END, e, follow if quotes else NEW)
        elif c in _OPEN or (c == '"' and _opens(text, s)):
            if (_quote(text, c, e, b) or later[QUOTES.index(c)]) > 0:
                put(OPEN, e, 0, text[:s].rstrip()[-1:] in tuple("：:，,") if s else False, s)
        elif c.isspace():
            p, q = text[s - 1 : s], text[e : e + 1]
            run = re.search(r"\S+$", text[max(0, s - CONTEXT) : s])
            if e < len(text) and s and (THAI.search(run.group() if run else p) or THAI.match(q)):
                put(THAI_BLANK, s, NEW)
        else:
            put(CLOSE, e, LOW)
    put(BREAK, b, 0)
    return symbols, places


def _content(text: str, a: int, b: int) -> bool:
    return _SKIP.match(text, a, b).end() < b


def _run(symbols: list[int], places: list[int], state: int) -> tuple[int, list[int]]:
    """The transducer over one chunk from one entry state: (exit state, sentence ends)."""
    ends = []
    for x, at in zip(symbols, places):
        state = TABLE[x][state]
        if state < 0:
            state = -1 - state
            ends.append(at)
    return state, ends


def _borders(text: str, size: int) -> list[int]:
    """Chunk borders between two word characters, so that no event spans one."""
    out, at = [0], size
    while at < len(text):
        while at < len(text) and not (text[at].isalnum() and text[at - 1].isalnum()):
            at += 1
        out.append(at)
        at += size
    if out[-1] < len(text):
        out.append(len(text))
    return out


def compose(functions: list[list[int]]) -> list[int]:
    """Entry state of every chunk from the chunks' transition functions, by a prefix scan that doubles its reach with every step."""
    f = np.array([list(x) for x in functions], dtype=np.int64).reshape(-1, len(STATES))
    reach = 1
    while reach < len(f):
        f = np.vstack([f[:reach], np.take_along_axis(f[reach:], f[:-reach], 1)])
        reach *= 2
    return [FRESH, *f[:-1, FRESH].tolist()] if len(f) else []


def later_quotes(firsts: list[list[int]]) -> list[list[int]]:
    """For every chunk the next quotes behind it, by a suffix scan over each chunk's first ones."""
    out, seen = [], [0] * len(QUOTES)
    for own in list(firsts)[::-1]:
        out.append(seen)
        seen = [int(x or y) for x, y in zip(own, seen)]
    return out[::-1]


def stripped(text: str) -> str:
    """The text without white space behind it; empty if nothing of it is visible."""
    stop = len(text.rstrip())
    return text[:stop] if stop and _content(text, 0, stop) else ""


def _closed(text: str, ends: list[int]) -> list[int]:
    return ends if ends and not _content(text, ends[-1], len(text)) else [*ends, len(text)]


def sentence_ends(text: str, chunk: int = CHUNK) -> list[int]:
    """Ends of the sentences of a text, in code points; none for a blank text."""
    text = stripped(text)
    if not text:
        return []
    thai = bool(THAI.search(text))
    borders = _borders(text, chunk)
    spans = list(zip(borders, borders[1:]))
    later = later_quotes([first_quotes(text, a, b) for a, b in spans]) if len(spans) > 1 else [[0] * len(QUOTES)]
    found = [_symbols(text, a, b, thai, q) for (a, b), q in zip(spans, later)]
    entries = compose([[_run(*f, s)[0] for s in STATES] for f in found]) if len(spans) > 1 else [FRESH]
    return _closed(text, [e for f, s in zip(found, entries) for e in _run(*f, s)[1]])


def _pieces(text: str) -> Iterator[tuple[int, int, int, int, str, list[int]]]:
    """(number, begin, end, begin of the window, window, first quotes) of a text's chunks."""
    borders = _borders(text, CHUNK)
    for n, (a, b) in enumerate(zip(borders, borders[1:])):
        at = max(0, a - CONTEXT)
        yield n, a, b, at, text[at : b + CONTEXT], first_quotes(text, a, b)


_CHUNKS = "key string, ends array<int>, n int, a int, b int, at int, window string, firsts array<int>, thai boolean, last int"
_ARROW = [pa.string(), pa.list_(pa.int32()), *[pa.int32()] * 4, pa.string(), pa.list_(pa.int32()), pa.bool_(), pa.int32()]


def split_sentences(df: DataFrame, id_col: str, text_col: str, whole_col: str | None = None) -> DataFrame:
    """(id, ends): the ends of each text's sentences, in order.

    Null and blank texts give no row; a row whose ``whole_col`` is true is one
    sentence; repeated rows count once; a null id is kept as any other; texts are
    handled whole; other columns are ignored; an empty table gives no rows.

    A text of one chunk is done where it is read; the chunks of a longer one are rows
    of their own, worked out by any tasks, and of what meets for a text there are only
    a few numbers a chunk.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(whole_col) if whole_col else F.lit(False)).alias("whole")).where("text IS NOT NULL")
    key = F.when(F.length("text") > CHUNK, F.sha2(F.concat_ws("\x1f", F.to_json(F.struct("id")), "text"), 256))
    setup = canon.tables()
    names = [c.split()[0] for c in _CHUNKS.split(", ")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon.install(setup)
        for batch in batches:
            take, out = [], []
            for i, (t, w, k) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                t = stripped(t)
                if t and not w and k and len(t) > CHUNK:
                    thai = bool(THAI.search(t))
                    new = [(k, None, n, a, b, at, window, firsts, thai, len(t)) for n, a, b, at, window, firsts in _pieces(t)]
                elif t:
                    new = [(None, [len(t)] if w else sentence_ends(t), *[None] * 8)]
                else:
                    continue
                take += [i] * len(new)
                out += new
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out), _ARROW)] if out else [pa.array([], kind) for kind in _ARROW]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int32())), *columns], names=["id", *names])

    fields = T._parse_datatype_string(_CHUNKS).fields
    parts = rows.withColumn("key", key).mapInArrow(split, T.StructType([T.StructField("id", rows.schema["id"].dataType), *fields]))
    parts = cut(parts)
    short = parts.where("key IS NULL").select("id", "ends")
    chunks = parts.where("key IS NOT NULL").drop("ends").dropDuplicates(["key", "n"])
    listed = lambda t, c: F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c])
    behind = F.udf(later_quotes, "array<array<int>>", useArrow=True)
    quotes = chunks.groupBy("key").agg(listed(chunks, "firsts").alias("f")).select("key", F.posexplode(behind("f")).alias("n", "later"))
    shape = T.StructType([chunks.schema["id"], *T._parse_datatype_string("key string, n int, last int, exits array<int>, found array<array<int>>, tail int").fields])

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon.install(setup)
        for batch in batches:
            exits, found, tails = [], [], []
            for a, b, at, window, thai, later in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "at", "window", "thai", "later"))):
                f = _symbols(window, a - at, b - at, thai, later)
                both = [_run(*f, s) for s in STATES]
                exits.append([x for x, _ in both])
                found.append([[e + at for e in ends] for _, ends in both])
                # Where what is visible in the chunk ends: behind it no sentence has to be closed.
                tails.append(at + len(_TAIL.sub("", window[: b - at])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), batch.column("n"), batch.column("last"), pa.array(exits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.list_(pa.int32()))), pa.array(tails, pa.int32())],
                names=["id", "key", "n", "last", "exits", "found", "tail"])

    done = cut(chunks.join(quotes, ["key", "n"]).repartition("key", "n").mapInArrow(functions, shape))
    scan = F.udf(compose, "array<int>", useArrow=True)
    entries = done.groupBy("key").agg(listed(done, "exits").alias("f")).select("key", F.posexplode(scan("f")).alias("n", "entry"))
    held = done.join(entries, ["key", "n"]).select("id", "key", "n", "last", "tail", F.element_at("found", F.col("entry") + 1).alias("e"))
    long = held.groupBy("id", "key", "last").agg(F.flatten(listed(held, "e")).alias("e"), F.max("tail").alias("tail"))
    ended = F.coalesce(F.try_element_at("e", F.lit(-1)) >= F.col("tail"), F.lit(False))
    long = long.select("id", F.when(ended, F.col("e")).otherwise(F.concat("e", F.array("last"))).alias("ends"))
    return short.unionByName(long).distinct().withColumnRenamed("id", id_col)


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, text, heading) of gold_corpus and of the units of section_drafts."""
    units = table(spark, sf_dir, "section_drafts").select("section_id", F.posexplode("units").alias("i", "u"))
    units = units.select(F.concat_ws("#", "section_id", F.col("i").cast("string")).alias("record_id"), F.col("u.text").alias("text"), (F.col("u.unit_type") == "heading").alias("heading"))
    chunks = table(spark, sf_dir, "gold_corpus").select(F.col("chunk_id").alias("record_id"), "text", F.lit(False).alias("heading"))
    return chunks.unionByName(units)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = split_sentences(all_texts(spark, sf_dir), "record_id", "text", "heading")
    return ends.select("record_id", F.explode("ends").alias("end_pos")).distinct()


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, sentence_no, sentence): the sentences themselves, in order."""
    texts = all_texts(spark, sf_dir).where("text IS NOT NULL").distinct()
    setup = canon.tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon.install(setup)
        for b in batches:
            out = []
            for t, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                ends = ([len(t.rstrip())] if t.strip() else []) if w else sentence_ends(t)
                out.append([t[a:z].strip() for a, z in zip([0, *ends], ends)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["record_id", "s"])

    found = texts.mapInArrow(run, "record_id string, s array<string>")
    return found.select("record_id", F.posexplode("s").alias("sentence_no", "sentence")).distinct()
