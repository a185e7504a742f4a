"""Noise in text from scanned pages (problem 2).

Candidates for a word that was misread come from the intersection of a Levenshtein
automaton with a trie of the corpus vocabulary, which misses none within the
distance; those an optical confusion explains are ranked by how often they stand
beside the neighbouring words.  For ideographs the trie holds windows of three
characters, and the automaton lets only the one in the middle differ.  Page furniture
is told by what repeats at the edges of pages near each other, by the title and by
the run of page numbers.  What is left is
joined over line ends and flowed into paragraphs.

The vocabulary is what makes up at least FREQUENT of all words (or windows) of the
tables given, so it has at most 1/FREQUENT entries however large the corpus is.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from operator import add

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import canon

#: Share of all tokens that makes one part of the vocabulary, and the count it needs in any case.
FREQUENT, FREQUENT_LEAST = 1e-6, 4
#: How many times more often a correction must be found than what stands there.
TIMES = 8
#: Times that a correction must be found where what stands there is not in the vocabulary.
UNKNOWN_LEAST = 6
#: Lines at either edge of a page that may be furniture.
EDGE = 3
#: Pages on which a line repeats at the edge if it is a running header, among so many that follow each other, whatever the source's length.
HEADER_PAGES, HEADER_SPAN = 3, 25
#: Share of a source's pages from which a header counts on all of them, be they far from where it repeats.
HEADER_SHARE = 0.12
#: A header line may appear within pages in at most this share of its occurrences.
HEADER_WITHIN = 0.1

# Pairs of letter groups that scanning confuses, either way.
CONFUSED = [("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("ri", "n"), ("in", "m"), ("nn", "m"), ("lc", "k"), ("tl", "d"), ("fi", "h"),
            ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("2", "z"), ("4", "a"), ("q", "g"), ("c", "e"), ("f", "t"), ("l", "i"), ("l", "t"), ("i", "t"), ("i", "j"),
            ("h", "b"), ("u", "n"), ("u", "v"), ("v", "y"), ("a", "o"), ("o", "e"), ("o", "c"), ("s", "a"), ("r", "t"), ("n", "h"), ("h", "k"), ("f", "l"), ("|", "l"), ("@", "a"), ("€", "e"), ("$", "s"), ("a", "e"), ("y", "g")]
_CONFUSED = {p for a, b in CONFUSED for p in ((a, b), (b, a))}
# Signs put for a character that was not recognised.
UNREADABLE = "�□¤■▯◻▢"
_DIGIT_LIKE = str.maketrans("OoQlI|iSsBZzqg" + UNREADABLE, "00011115582299" + "0" * len(UNREADABLE))
_HYPHEN_END = re.compile(r"([-‐‑­¬⁃‧])[ \t    　]*$")
_WORD = re.compile(f"[A-Za-zÀ-ɏ0-9@€$|{UNREADABLE}]+")
_WORD_OR_END = re.compile(_WORD.pattern + r"|\n")
_NUMBER_LIKE = re.compile(r"(?=.*\d)[\dOoQlI|iSsBZzqg]{1,6}")
_KANA = re.compile("[ぁ-ヺ]")
_STANDALONE = re.compile(r"(?<![\w\-‐‑­¬])[a-zà-ɏ]+(?![\w\-‐‑­¬])")
_COMPOUND = re.compile(r"(?<![\w-])[a-zà-ɏ0-9]+(?:-[a-zà-ɏ0-9]+)+(?![\w-])")
_HAN = re.compile("[㐀-鿿]")
_TIGHT = re.compile("[㐀-鿿，。；：、“”（）！？]")
_DIGIT = re.compile(r"\d")
_UNREADABLE = re.compile(f"[{UNREADABLE}]")
_HAN_OR_UNREADABLE = re.compile(f"[㐀-鿿{UNREADABLE}]")
_NUMBER_LINE = re.compile(
    rf"^(?P<deco>[-–—·•.\[［(（【|~=\s]*(?:(?:page|pag\.?|seite|p\.?|第)\s*)?)(?P<n>[\dOoQlI|iSBZ{UNREADABLE}]{{1,5}})(?P<of>\s*(?:/|of)\s*[\dOoQlI|iSBZ{UNREADABLE}]{{1,5}})?(?P<end>\s*页?[-–—·•.\]］)）】|~=\s]*)$", re.I)
_ROMAN = re.compile(r"^[-–—·\[(\s]*(m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))[-–—·\])\s]*$", re.I)


class Trie:
    """Vocabulary as nested dictionaries; "" marks the end of a word and holds its count."""

    def __init__(self, counts: dict[str, int]):
        self.root: dict = {}
        for word, n in counts.items():
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = n

    def within(self, word: str, most: int) -> list[tuple[str, int]]:
        """(entry, count) of all entries within ``most`` edits.

        The automaton is the same for all words: its state is the band of distances at
        word positions d - most to d + most, its input which of the word's characters
        there equal the one read, and which positions there are; every transition is
        worked out once.  A branch of the trie is left when the state is dead.
        """
        found: list[tuple[str, int]] = []
        n, wide = len(word), 2 * most + 1
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << (i + most)
        full, steps, far = (1 << wide) - 1, _STEPS, most + 1
        start = (far,) * most + tuple(i if i <= n else far for i in range(most + 1))
        stack = [(self.root, "", 0, start)]
        while stack:
            node, prefix, d, row = stack.pop()
            end = n - d + most
            if "" in node and 0 <= end < wide and row[end] <= most:
                found.append((prefix, node[""]))
            # Band position j stands for i = d + 1 - most + j characters of the word.
            skip, there = max(0, most - d - 1), min(wide, n - d + most)
            if there <= 0:
                continue
            for c, below in node.items():
                if c:
                    key = (row, masks.get(c, 0) >> d & full, skip, there)
                    new = steps.get(key, 0)
                    if new == 0:
                        new = steps[key] = _transition(row, key[1], skip, there, most)
                    if new:
                        stack.append((below, prefix + c, d + 1, new))
        return found

    def completions(self, prefix: str) -> list[tuple[str, int]]:
        """(next character, count) of the entries that are one character longer than ``prefix``."""
        node = self.root
        for c in prefix:
            node = node.get(c)
            if node is None:
                return []
        return [(c, below[""]) for c, below in node.items() if c and "" in below]


#: Transitions of the Levenshtein automaton found so far: None where all branches are dead.
_STEPS: dict[tuple, tuple[int, ...] | None] = {}


def _transition(row: tuple[int, ...], equal: int, skip: int, there: int, most: int) -> tuple[int, ...] | None:
    """The band after one more character: bit j of ``equal`` says that it is the word's at band position j."""
    far, wide = most + 1, 2 * most + 1
    new, before = [], far
    for j in range(wide):
        if j < skip or j >= there:
            v = far
        else:
            v = min(before + 1, row[j + 1] + 1 if j + 1 < wide else far, row[j] + (not equal >> j & 1), far)
        new.append(v)
        before = v
    return tuple(new) if min(new) <= most else None


def confusion_at(seen: str, meant: str) -> int | None:
    """Where optical confusion of one letter group made ``seen`` of ``meant``; None if nothing so simple explains it."""
    a = 0
    while a < min(len(seen), len(meant)) and seen[a] == meant[a]:
        a += 1
    z = 0
    while z < min(len(seen), len(meant)) - a and seen[-1 - z] == meant[-1 - z]:
        z += 1
    for left in range(a, max(-1, a - 3), -1):
        for right in range(z, max(-1, z - 3), -1):
            x, y = seen[left : len(seen) - right], meant[left : len(meant) - right]
            if len(x) > 2 or len(y) > 2:
                break
            if (x, y) in _CONFUSED or (len(x) == 1 and x in UNREADABLE and len(y) == 1):
                return left
    if len(seen) == len(meant):
        wrong = [i for i in range(len(seen)) if seen[i] != meant[i]]
        if wrong and all((seen[i], meant[i]) in _CONFUSED or seen[i] in UNREADABLE for i in wrong) and len(wrong) <= 2:
            return wrong[0]
    return None


@dataclass
class Vocabulary:
    words: dict[str, int] = field(default_factory=dict)
    compounds: dict[str, int] = field(default_factory=dict)
    beside: dict[str, int] = field(default_factory=dict)
    pairs: dict[str, int] = field(default_factory=dict)
    windows: dict[str, int] = field(default_factory=dict)
    numbers: dict[str, int] = field(default_factory=dict)

    def prepare(self) -> Vocabulary:
        self.trie = Trie(self.words)
        self.most = max(self.words.values(), default=0)
        # The middle last, so that the automaton that lets only the middle differ reads its neighbours first.
        self.window_trie = Trie({w[0] + w[2] + w[1]: n for w, n in self.windows.items()})
        self.most_after: dict[str, int] = {}
        self.most_before: dict[str, int] = {}
        for p, n in self.pairs.items():
            self.most_after[p[0]] = max(n, self.most_after.get(p[0], 0))
            self.most_before[p[1]] = max(n, self.most_before.get(p[1], 0))
        #: Pairs that leave no doubt about the first of the two: no other character is so much likelier before the second.
        self.sure = {p for p, n in self.pairs.items() if self.most_before[p[1]] < TIMES * n}
        self.left_parts = Counter()
        for c, n in self.compounds.items():
            parts = c.split("-")
            for i in range(1, len(parts)):
                self.left_parts["-".join(parts[:i])] += n
        self.candidates = lru_cache(200_000)(self._candidates)
        return self

    def _candidates(self, word: str) -> list[tuple[str, int, int]]:
        """(correction, count, position of the confusion) of a word, the likeliest first."""
        own = self.words.get(word, 0)
        out: list[tuple[str, int, int]] = []
        if TIMES * own > self.most:
            return out  # nothing is so much more frequent
        for meant, n in self.trie.within(word, 1 if len(word) < 5 else 2):
            if meant != word and n >= (TIMES * own if own else UNKNOWN_LEAST):
                at = confusion_at(word, meant)
                if at is not None:
                    out.append((meant, n, at))
        return sorted(out, key=lambda x: (-x[1], x[0]))

    def near(self, before: str, word: str, after: str) -> int:
        """How often a word (digits masked) stands beside either neighbour."""
        return self.beside.get(f"{before} {word}", 0) + self.beside.get(f"{word} {after}", 0)

    def stands(self, seen: str, meant: str, before: str, after: str) -> bool:
        """Whether ``seen`` is found between its neighbours and ``meant`` is not so much more often; a ratio, as misreads repeat too where there is much text."""
        own = self.near(before, seen, after)
        return own > 0 and self.near(before, meant, after) < TIMES * own

    def number_misread(self, word: str, before: str, after: str) -> bool:
        """Whether letters in a number are misread digits.

        With only O, o, l and I they are, unless the token is found here and the pure
        number is not so much more often in the whole or beside these words; other
        letters also mark grades and the like, so they are only where the pure number
        is so much more often in the whole and beside these words.
        """
        masked, pure = _DIGIT.sub("0", word.lower()), "0" * len(word)
        more = self.numbers.get(word.translate(_DIGIT_LIKE), 0) >= TIMES * max(1, self.numbers.get(word.lower(), 0))
        found = self.near(before, masked, after)
        # Numbers stand beside any number, so only words tell.
        before, after = (w if any(map(str.isalpha, w)) else "" for w in (before, after))
        if re.fullmatch(r"[\dOolI]+", word):
            return not found or (more and not self.stands(masked, pure, before, after))
        return more and self.near(before, pure, after) >= TIMES * max(1, self.near(before, masked, after))

    def correction(self, word: str, before: str, after: str) -> tuple[str, int] | None:
        """(correction, position) of a misread word between its neighbours, or None if it may stand."""
        if len(word) < 2 or not any(map(str.isalpha, word)):
            return None
        found = self.candidates(word)
        if not found:
            return None
        near = lambda w: self.near(before, w, after)
        ranked = max(found, key=lambda x: (near(x[0]), x[1]))
        if word in self.words and near(ranked[0]) < TIMES * max(1, near(word)):
            return None  # a known word stands unless its place clearly asks for another
        if word not in self.words and len(word) <= 3 and not near(ranked[0]):
            return None
        return ranked[0], ranked[2]

    def doubtful(self, left: str, seen: str, right: str) -> bool:
        """Whether any other ideograph could be so much likelier here; false for almost all that is right."""
        return self.most_before.get(right, 0) >= TIMES * max(1, self.pairs.get(seen + right, 0)) and (
            self.most_after.get(left, 0) >= TIMES * max(1, self.pairs.get(left + seen, 0)) or self.most_after.get("。", 0) >= TIMES * max(1, self.pairs.get("。" + seen, 0))
        )

    def ideograph(self, left: str, seen: str, right: str) -> str | None:
        """The ideograph that belongs between two characters if ``seen`` does not."""
        here = self.windows.get(left + seen + right, 0)
        best, most = None, max(TIMES * here, 2 * FREQUENT_LEAST) - 1
        for x, n in self.window_trie.completions(left + right):
            if x != seen and n > most and _HAN.match(x):
                if self.pairs.get(left + x, 0) >= TIMES * max(1, self.pairs.get(left + seen, 0)) and self.pairs.get(x + right, 0) >= TIMES * max(1, self.pairs.get(seen + right, 0)):
                    best, most = x, n
        return best


def signature(line: str) -> str:
    return "".join(c for c in canon.canonical(line).casefold() if c.isalpha())


def similar(a: str, b: str) -> bool:
    """Whether two signatures differ in at most a fifth of their letters."""
    if not a or not b or abs(len(a) - len(b)) > max(len(a), len(b)) // 5:
        return False
    most = max(1, max(len(a), len(b)) // 5)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(row[j] if x == y else 1 + min(row[j], row[j + 1], new[j]))
        row = new
        if min(row) > most:
            return False
    return row[-1] <= most


def page_number(line: str) -> tuple[int | None, bool] | None:
    """(number, it is marked as a page number) of a line that may be one; None otherwise."""
    line = canon.canonical(line).strip()
    m = _NUMBER_LINE.match(line)
    if m and (any(c.isdigit() for c in line) or m["deco"].strip() or m["of"] or any(c in UNREADABLE for c in line)):
        digits = m["n"].translate(_DIGIT_LIKE)
        known = int(digits) if digits.isdigit() and not any(c in UNREADABLE for c in m["n"]) else None
        return known, bool(m["deco"].strip(" .") or m["of"] or m["end"].strip(" .)"))
    if line and _ROMAN.match(line) and _ROMAN.match(line)[1]:
        return None, True
    return None


def furniture(lines: list[str], headers: list[str], title: str, offset: int | None, page: int | None) -> dict[int, str]:
    """Line numbers of page furniture and what it is, peeled from the edges inwards."""
    out: dict[int, str] = {}
    title = signature(title)
    full = [i for i, x in enumerate(lines) if x.strip()]
    for order in (full[:EDGE], full[::-1][:EDGE]):
        for i in order:
            if i in out:
                continue
            number = page_number(lines[i])
            if number:
                value, marked = number
                expected = offset is not None and page is not None and value == page + offset
                if marked or expected or (value is None) or offset is None:
                    out[i] = "page_number"
                    continue
                digits = canon.canonical(lines[i]).strip()
                if not digits.isdigit() and i in (full[0], full[-1]):
                    out[i] = "page_number"
                    continue
                break
            s = signature(lines[i])
            bare = re.sub(r"[ivxl]+$", "", s)
            if len(s) >= 4 and any(s == h or similar(s, h) or (len(h) >= 6 and similar(bare, h)) for h in headers):
                out[i] = "running_header"
            elif len(title) >= 6 and len(s) >= 0.8 * len(title) and (similar(s, title) or similar(s[: len(title)], title) or similar(s[-len(title) :], title)) and len(s) <= len(title) + 40:
                out[i] = "running_header"
            else:
                break
    return out


def _tokens(lines: list[str], skip: dict[int, str]) -> tuple[str, list[int], list[int]]:
    """The running text with digits masked and line ends joined; where each line starts in it; the lines' numbers."""
    parts, starts, numbers, at, last = [], [], [], 0, ""
    for i, line in enumerate(lines):
        if i in skip:
            continue
        if last and last != " " and not (_TIGHT.match(last) or (line and _HAN.match(line[0]))):
            parts.append(" ")
            at += 1
            last = " "
        starts.append(at)
        numbers.append(i)
        parts.append(_DIGIT.sub("0", line))
        at += len(line)
        last = line[-1:] or last
    return "".join(parts), starts, numbers


def count_tokens(lines: list[str], skip: dict[int, str], counts: dict[str, Counter]) -> None:
    """Adds a text's words, compounds, word pairs, and windows of two and three characters to the counts."""
    kept = []
    for i, line in enumerate(lines):
        if i not in skip:
            if _HYPHEN_END.search(line):
                line = re.sub(r"\S*$", "", line.rstrip())
            if i and _HYPHEN_END.search(lines[i - 1]):
                line = re.sub(r"^\s*\S*", "", line)
            kept.append(line)
    low = "\n".join(kept).lower()
    counts["words"].update(_STANDALONE.findall(low))
    counts["compounds"].update(_COMPOUND.findall(low.replace("‐", "-").replace("‑", "-")))
    # Line ends are tokens too, so that words of two lines are no neighbours.
    words = _WORD_OR_END.findall(low)
    masked = _DIGIT.sub("0", "\x1f".join(words)).split("\x1f") if words else []
    counts["beside"].update(f"{a} {b}" for a, b in zip(masked, masked[1:]) if a != "\n" != b)
    counts["numbers"].update(w for w in words if len(w) <= 6 and not w.isalpha() and (_NUMBER_LIKE.fullmatch(w) or _NUMBER_LIKE.fullmatch(w.upper())))
    text = _tokens(lines, skip)[0]
    if _HAN.search(text) and not _KANA.search(text):
        # All of them; those without ideographs are left out once for many texts, by ``counted``.
        pairs = list(map(add, text, text[1:]))
        counts["pairs"].update(pairs)
        counts["windows"].update(map(add, pairs, text[2:]))


def counted(kind: str, c: Counter) -> dict[str, int]:
    if kind == "pairs":
        return {k: n for k, n in c.items() if k[0] > "⺀" or k[1] > "⺀"}
    if kind == "windows":
        return {k: n for k, n in c.items() if "㐀" <= k[1] <= "鿿"}
    return c


def _broken(vocabulary: Vocabulary, head: str, mark: str, tail: str | None) -> bool:
    """Whether a line ends inside a divided word: ``head`` before the mark, ``tail`` at the start of the next line."""
    m = re.search(r"[^\W\d_]+$", head)
    if not m:
        return False
    if mark in "­¬‧":
        return True
    left = m.group().lower()
    token = re.search(r"[\w-]+$", re.sub("[‐‑]", "-", head)).group().lower()
    w = re.match(r"[^\W\d_]+", tail or "")
    if not w:
        if tail:
            return False
        return left not in vocabulary.words and vocabulary.left_parts.get(token, 0) == 0
    right = w.group().lower()
    rest = re.match(r"[\w-]+", re.sub("[‐‑]", "-", tail)).group().lower()
    joined = vocabulary.words.get(left + right, 0)
    hyphened = max(vocabulary.compounds.get(f"{token}-{rest}", 0), vocabulary.compounds.get(f"{token}-{right}", 0), vocabulary.left_parts.get(f"{token}-{right}", 0), vocabulary.compounds.get(f"{left}-{right}", 0))
    if "-" in token:  # part of a longer compound: the last part may still be divided
        joined = max(joined, vocabulary.compounds.get(token + right, 0))
    if joined or hyphened:
        return joined >= hyphened
    if len(left + right) > 4 and any(n for _, n in vocabulary.trie.within(left + right, 1)):
        return True
    if vocabulary.left_parts.get(token, 0) and right in vocabulary.words:
        return False
    return not (left in vocabulary.words and right in vocabulary.words)


def repair(text: str, skip: dict[int, str], vocabulary: Vocabulary) -> tuple[list[tuple[int, str]], str]:
    """(damaged lines with the kind of noise, the text as continuous paragraphs)."""
    lines = text.split("\n")
    damage = {(i, kind) for i, kind in skip.items()}
    kept = [i for i in range(len(lines)) if i not in skip]
    body = [i for i in kept if lines[i].strip()]
    following = dict(zip(body, body[1:]))
    fixed: dict[int, list[str]] = {}  # characters of the lines in which any changes

    def put(i: int, j: int, c: str) -> None:
        if i not in fixed:
            fixed[i] = list(lines[i])
        fixed[i][j] = c

    joins: dict[int, str] = {}
    for i in body:
        m = _HYPHEN_END.search(lines[i])
        if m:
            tail = lines[following[i]].lstrip() if i in following else None
            if _broken(vocabulary, lines[i][: m.start()], m[1], tail):
                damage.add((i, "hyphen_break"))
                joins[i] = "divided"
            else:
                joins[i] = "hyphen"
    # Words, whole over line ends where they were divided, with where their parts stand.
    stream: list[str] = []
    spans: list[list[tuple[int, int, int]]] = []
    glue = False
    for i in body:
        line = lines[i]
        cut_at = _HYPHEN_END.search(line).start() if i in joins else len(line)
        at = -1
        for k, m in enumerate(_WORD.finditer(line, 0, cut_at)):
            start, at = m.span()
            if glue and k == 0 and stream and not line[:start].strip():
                stream[-1] += m.group()
                spans[-1].append((i, start, at))
            else:
                stream.append(m.group())
                spans.append([(i, start, at)])
        glue = joins.get(i) == "divided" and at == cut_at
    low = [_DIGIT.sub("0", w) for w in "\n".join(stream).lower().split("\n")] if stream else []
    words = vocabulary.words
    for k, word in enumerate(stream):
        bare = word.lower()
        n = words.get(bare)
        if n and TIMES * n > vocabulary.most:
            continue  # nothing is so much more frequent
        if bare.isdigit() or not any(map(str.isalnum, bare)):
            if _UNREADABLE.search(bare):
                damage.update((i, "misread_char") for i, a, b in spans[k] if _UNREADABLE.search(lines[i], a, b))
            continue
        places = [(i, j) for i, a, b in spans[k] for j in range(a, b)] if n is None else None
        if n is None and _UNREADABLE.search(bare):
            damage.update((i, "misread_char") for (i, _), c in zip(places, word) if c in UNREADABLE)
        before, after = low[k - 1] if k else "", low[k + 1] if k + 1 < len(low) else ""
        mixed = n is None and bare.isascii() and _DIGIT.search(bare)
        better = vocabulary.correction(bare, before, after)
        if mixed and better and vocabulary.stands(low[k], better[0], before, after):
            better = None
        number = mixed and _NUMBER_LIKE.fullmatch(word) and vocabulary.number_misread(word, before, after)
        if number and better and vocabulary.near(before, "0" * len(word), after) >= vocabulary.near(before, better[0], after):
            better = None
        if better:
            meant, at = better
            places = places or [(i, j) for i, a, b in spans[k] for j in range(a, b)]
            i, j = places[min(at, len(places) - 1)]
            damage.add((i, "misread_char"))
            if len(meant) == len(word):
                for (a, b), old, new in zip(places, bare, meant):
                    if old != new:
                        put(a, b, new)
            else:
                a, b = places[0]
                put(a, b, meant)
                for x, y in places[1:]:
                    put(x, y, "")
        elif number or (re.fullmatch("[lO]{2,}", word) and low[k] not in words):
            damage.add((spans[k][0][0], "misread_char"))
    joined, starts, numbers = _tokens(lines, skip)
    chinese = bool(joined) and not _KANA.search(joined)
    chars = list(joined)
    doubts: Iterable[int] = ()
    if chinese:
        sure = vocabulary.sure
        doubts = [k for k, p in enumerate(map(add, joined, joined[1:] + "。")) if p not in sure and ("㐀" <= p[0] <= "鿿" or p[0] in UNREADABLE)]
    elif _UNREADABLE.search(joined):
        doubts = [m.start() for m in _UNREADABLE.finditer(joined)]
    for k in doubts:
        c = joined[k]
        # The character before may have been put right just now; the ends of the text count as those of a sentence.
        left, right = chars[k - 1] if k else "。", joined[k + 1] if k + 1 < len(joined) else "。"
        unread = c in UNREADABLE
        if not unread and not vocabulary.doubtful(left, c, right):
            continue
        n = bisect_right(starts, k) - 1
        i, j = numbers[n], k - starts[n]
        if unread:
            damage.add((i, "misread_char"))
        if chinese:
            meant = vocabulary.ideograph(left, c, right) or (vocabulary.ideograph("。", c, right) if j == 0 else None)
            if meant:
                damage.add((i, "misread_char"))
                chars[k] = meant
                put(i, j, meant)
    longest = max((len(lines[i]) for i in body), default=0)
    out: list[str] = []
    for n, i in enumerate(body):
        line = ("".join(fixed[i]) if i in fixed else lines[i]).strip()
        if i in joins:
            m = _HYPHEN_END.search(line)
            line = line[: m.start()] + ("" if joins[i] == "divided" else m[1]) if m else line
        if not out:
            out.append(line)
            continue
        p = body[n - 1]
        ended = lines[p].rstrip()[-1:] in "。！？.!?”\"」" and len(lines[p]) < 0.6 * longest
        if ended or any(not lines[x].strip() for x in range(p + 1, i)) or (p not in joins and len(lines[p]) < 0.35 * longest):
            out.append(line)
        elif p in joins or (out[-1][-1:] and line[:1] and (out[-1][-1] > "⺀" or line[0] > "⺀")):
            out[-1] += line
        else:
            out[-1] += " " + line
    return sorted(damage), "\n\n".join(out)


_ROWS = "record_id string, source_id string, title string, page int, text string, headers array<string>, offset int"


def _with_sources(records: DataFrame) -> DataFrame:
    """Each record with what repeats at the page edges of its source, and the run of its page numbers."""
    lines = records.where("page IS NOT NULL").select("source_id", "record_id", "page", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("l"))
    lines = lines.select("source_id", "record_id", "page", F.size("l").alias("n"), F.posexplode("l").alias("i", "line"))
    edge = (F.col("i") < EDGE) | (F.col("i") >= F.col("n") - EDGE)
    signed = lines.select("source_id", "record_id", "page", F.lower(F.regexp_replace("line", r"(?U)[^\p{L}]", "")).alias("s"), edge.alias("edge")).where(F.length("s") >= 4)
    within = signed.groupBy("s").agg(F.avg((~F.col("edge")).cast("double")).alias("within"))
    # Spans of pages overlap by half, so that a run of pages is never cut in all of them.
    spans = lambda page: F.array(*[F.struct(F.lit(k).alias("k"), F.floor((F.col(page) + k * HEADER_SPAN / 2) / HEADER_SPAN).cast("int").alias("at")) for k in (0, 1)])
    at_edge = signed.where("edge").select("source_id", "record_id", "s", F.explode(spans("page")).alias("span")).groupBy("source_id", "s", "span").agg(F.countDistinct("record_id").alias("pages"))
    pages = records.where("page IS NOT NULL").groupBy("source_id").agg(F.countDistinct("record_id").alias("all"), F.max("title").alias("source_title"))
    repeats = cut(at_edge.join(within.where(F.col("within") <= HEADER_WITHIN), "s"))
    near = repeats.where(F.col("pages") >= HEADER_PAGES)
    wide = repeats.where("span.k = 0").groupBy("source_id", "s").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= HEADER_PAGES).join(pages, "source_id").where(F.col("pages") >= HEADER_SHARE * F.col("all"))
    # At most EDGE * 2 / HEADER_SHARE headers of a source, and EDGE * 2 * HEADER_SPAN / HEADER_PAGES of a span.
    headers = wide.groupBy("source_id").agg(F.collect_set("s").alias("headers"))
    local = near.groupBy("source_id", "span").agg(F.collect_set("s").alias("local"))
    numbers = lines.where(edge).select("source_id", "record_id", "page", F.regexp_extract("line", r"^[^\p{L}\d]*(?:[Pp]age|第|[Pp]\.?)?\s*(\d{1,5})\s*(?:/\s*\d+)?\s*页?[^\p{L}\d]*$", 1).alias("d")).where("d <> ''")
    runs = numbers.select("source_id", "record_id", (F.col("d").cast("int") - F.col("page")).alias("offset")).groupBy("source_id", "offset").agg(F.countDistinct("record_id").alias("c"))
    offsets = runs.groupBy("source_id").agg(F.max(F.struct("c", "offset")).alias("m")).where("m.c >= 2").select("source_id", F.col("m.offset").alias("offset"))
    out = records.join(pages.select("source_id", "source_title"), "source_id", "left").join(headers, "source_id", "left").join(offsets, "source_id", "left")
    for k in (0, 1):
        own = local.where(F.col("span.k") == k).select("source_id", F.col("span.at").alias("_at"), F.col("local").alias(f"_local{k}"))
        out = out.withColumn("_at", spans("page")[k]["at"]).join(own, ["source_id", "_at"], "left")
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    found = F.sort_array(F.array_union(some("headers"), F.array_union(some("_local0"), some("_local1"))))
    return out.select("record_id", "source_id", F.coalesce("title", "source_title", F.lit("")).alias("title"), "page", "text", found.alias("headers"), "offset")


def _skip(row) -> dict[int, str]:
    if row.page is None or pd.isna(row.page):
        return {}
    offset = None if row.offset is None or pd.isna(row.offset) else int(row.offset)
    return furniture(row.text.split("\n"), list(row.headers), row.title, offset, int(row.page))


def learn(records: DataFrame) -> Vocabulary:
    """The vocabulary of all running text; counted over all records, kept where frequent."""
    setup = canon.tables()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon.install(setup)
        for b in batches:
            counts = {k: Counter() for k in ("words", "compounds", "beside", "pairs", "windows", "numbers")}
            for row in b.itertuples(index=False):
                count_tokens(row.text.split("\n"), _skip(row), counts)
            for kind, c in counts.items():
                c = counted(kind, c)
                if c:
                    yield pd.DataFrame({"kind": kind, "token": list(c.keys()), "n": list(c.values())})

    counts = cut(records.mapInPandas(run, "kind string, token string, n bigint").groupBy("kind", "token").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("all"))
    kept = counts.join(totals, "kind").where((F.col("n") >= FREQUENT * F.col("all")) & (F.col("n") >= F.when(F.col("kind") == "numbers", 1).when(F.col("kind") == "compounds", 2).otherwise(FREQUENT_LEAST)))
    vocabulary = Vocabulary()
    # At most 1/FREQUENT rows of a kind.
    rows = kept.select("kind", "token", "n").toPandas()
    for kind, part in rows.groupby("kind"):
        getattr(vocabulary, kind).update(zip(part.token, part.n.tolist()))
    return vocabulary


def repair_scans(records: DataFrame) -> DataFrame:
    """(record_id, damage, repaired) of each record: damaged lines by kind, and the continuous text.

    ``records`` has record_id, source_id, title, page and text; a null page says
    that the text has no page edges, so that nothing of it is furniture.  Null and
    blank texts are left out; repeated rows count once; a null source or title only
    takes that evidence away; an empty table gives no rows.
    """
    rows = records.select("record_id", "source_id", "title", F.col("page").cast("int").alias("page"), "text").where("text IS NOT NULL AND trim(text) <> ''").distinct()
    rows = cut(_with_sources(rows))
    vocabulary = learn(rows)
    setup = canon.tables()
    sent = records.sparkSession.sparkContext.broadcast(vocabulary)
    memo: list[Vocabulary] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon.install(setup)
        if not memo:
            memo.append(sent.value.prepare())
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                damage, text = repair(row.text, _skip(row), memo[0])
                out.append((row.record_id, [{"line_no": i, "noise": kind} for i, kind in damage], text))
            yield pd.DataFrame(out, columns=["record_id", "damage", "repaired"])

    return rows.mapInPandas(run, "record_id string, damage array<struct<line_no int, noise string>>, repaired string")


def scanned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "guideline_pages").select(F.col("page_id").alias("record_id"), "source_id", "title", F.col("pdf_page_number").alias("page"), "text")
    units = table(spark, sf_dir, "section_drafts").select("section_id", "source_id", F.posexplode("units").alias("i", "u"))
    units = units.select(F.concat_ws("#", "section_id", F.col("i").cast("string")).alias("record_id"), "source_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("page"), F.col("u.text").alias("text"))
    return pages.unionByName(units)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair_scans(scanned_records(spark, sf_dir))
    return found.select("record_id", F.explode("damage").alias("d")).select("record_id", F.col("d.line_no").alias("line_no"), F.col("d.noise").alias("noise")).distinct()


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_scans(scanned_records(spark, sf_dir)).select("record_id", "repaired").distinct()
