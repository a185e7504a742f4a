"""Exact byte-pair encoding by per-prefix dynamic programming (problem 8).

For a vocabulary built by merging in rank order, the encoding of every prefix of a
piece ends in exactly one token, and that token can be found without running the
merges: a token ``t`` that is a suffix of the prefix is its last token if and only
if ``t`` and the last token of what lies before it form a pair that encoding leaves
alone.  An Aho-Corasick automaton over all tokens (a suffix automaton for dictionary
matches) gives the candidates of every prefix in one pass; the pair test undoes the
merges of the two tokens from the youngest on and looks for a merge across the
border that would have come first.  Back-pointers then give the ids.

Texts are cut into pieces by the tokenizer's published pattern first, and no token
crosses a piece, so each distinct piece is encoded once per worker and remembered.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import default_tokenizer_path, table

#: Stretches a worker remembers before it starts afresh; bounds memory, changes no result.
MEMORY_STRETCHES = 150_000
CLAUSE = re.compile(r"[^，。]*[，。]+(?:[^\w\s]|_)*|[^，。]+")
BLANK_RUN = re.compile(r"\s ")


@functools.cache
def _classes() -> tuple[str, str, str]:
    """Regex classes of letters, numbers and white space (rule: Unicode general category)."""
    def ranges(test) -> str:
        out, start = [], None
        for c in range(sys.maxunicode + 2):
            ok = c <= sys.maxunicode and test(c)
            if ok and start is None:
                start = c
            elif not ok and start is not None:
                out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        return "".join(out)

    cat = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return ranges(lambda c: cat[c] == "L"), ranges(lambda c: cat[c] == "N"), space


@functools.cache
def pattern_source() -> str:
    """The public pattern of byte_bpe_50k: contractions, words, numbers, marks, blanks."""
    letter, number, space = _classes()
    return (
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


class PrefixEncoder:
    """Encoder by ``pattern`` over a ``.tiktoken`` rank file (base64 token, rank), rank order = merge order."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick

        self.pieces = re.compile(pattern).findall
        self.rank: dict[str, int] = {}
        with open(path, "rb") as f:
            for line in f:
                token, _, rank = line.rstrip().partition(b" ")
                self.rank[base64.b64decode(token).decode("latin-1")] = int(rank)
        size = max(self.rank.values()) + 1
        self.length = [0] * size
        text = [""] * size
        for t, r in self.rank.items():
            text[r], self.length[r] = t, len(t)
        # Halves: the two tokens whose merge made this one, themselves if it is a byte.
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        self.fits = functools.lru_cache(2_000_000)(self._fits)
        automaton = ahocorasick.Automaton()
        for t in self.rank:
            automaton.add_word(t, self.rank[t])
        automaton.make_automaton()
        self.automaton = automaton
        for r in range(size):
            t = text[r]
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
                if a is not None and b is not None and a < r and b < r and self._fits(a, b):
                    self.left[r], self.right[r] = a, b
                    self.merged[a, b] = r
                    break
        #: Ids of pieces, of clauses, and of words with a blank before them.
        self.memory: dict[str, list[int]] = {}
        self.clauses: dict[str, list[int]] = {}
        self.words: dict[str, list[int]] = {}

    def _fits(self, a: int, b: int) -> bool:
        """Whether encoding leaves ``a`` and ``b`` side by side as they are."""
        bound = sys.maxsize
        while True:
            # A merge across the border older than what was undone would have happened.
            if self.merged.get((a, b), bound) < bound:
                return False
            if a > b:
                bound, a = a, self.right[a]
                if a == bound:  # the larger one is a byte, so both are
                    return True
            else:
                if self.left[b] == b:
                    return True
                bound, b = b + 1, self.left[b]

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8").decode("latin-1")
        whole = self.rank.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        last = [-1] * (n + 1)
        at = -1
        fits, length = self.fits, self.length
        # Matches come by end position, the longest first.
        for end, token in self.automaton.iter(raw):
            end += 1
            if end == at:
                continue
            start = end - length[token]
            if start == 0 or (last[start] >= 0 and fits(last[start], token)):
                last[end] = token
                at = end
        out = []
        while n:
            out.append(last[n])
            n -= length[last[n]]
        out.reverse()
        return out

    def span(self, text: str) -> list[int]:
        """Ids of a stretch that starts and ends where pieces do."""
        out: list[int] = []
        memory = self.memory
        for p in self.pieces(text):
            ids = memory.get(p)
            if ids is None:
                ids = memory[p] = self.piece(p)
            out += ids
        return out

    def encode(self, text: str) -> list[list[int]]:
        """Ids by stretch; each distinct stretch is cut into pieces once.

        Stretches are clauses where the text has ideographic commas or stops, else
        words with the blank before them.  Both end where a piece must end: a mark
        before a letter, digit or blank; a character before a single blank.
        """
        for m in (self.memory, self.words, self.clauses):
            if len(m) > MEMORY_STRETCHES:
                m.clear()
        if "，" in text or "。" in text:
            memory, parts, lead = self.clauses, CLAUSE.findall(text), ""
        elif BLANK_RUN.search(text):
            return [self.span(text)]
        else:
            memory, parts, lead = self.words, text.split(" "), " "
        first = [self.span(parts[0])]
        try:
            return first + [memory[p] for p in parts[1:]]
        except KeyError:
            for p in parts[1:]:
                if p not in memory:
                    memory[p] = self.span(lead + p)
            return first + [memory[p] for p in parts[1:]]


@functools.cache
def encoder(path: str, pattern: str) -> PrefixEncoder:
    return PrefixEncoder(path, pattern)


def ship(df: DataFrame, vocabulary: str | None) -> str:
    """Sends the vocabulary file, which only the driver needs to have, to all workers; its name there."""
    path = vocabulary or default_tokenizer_path("byte_bpe_50k.tiktoken")
    df.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """(id, ids): the token ids of each row's text, without special tokens.

    Null and empty texts get an empty list; texts are encoded whole however long
    they are; equal texts and repeated rows each get their (equal) row; an empty
    table gives an empty result; columns other than the two named are not read.
    One pass without a shuffle.
    """
    name, pattern = ship(df, vocabulary), pattern_source()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name), pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            flat: list[int] = []
            offsets = np.zeros(len(texts) + 1, dtype=np.int32)
            for i, t in enumerate(texts):
                if t:
                    flat.extend(chain.from_iterable(enc.encode(t)))
                offsets[i + 1] = len(flat)
            values = pa.array(np.array(flat, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def count_tokens(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens): as encode_texts, but only the number of ids; 0 for null and empty texts."""
    name, pattern = ship(df, vocabulary), pattern_source()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name), pattern)
        for b in batches:
            n = [sum(map(len, enc.encode(t))) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document (doc_id is unique in the table, so no rows need merging)."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
