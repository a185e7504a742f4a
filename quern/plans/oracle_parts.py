"""Pieces of SQL that several oracles share."""

import sys
import unicodedata

# Unicode white space for an engine whose \s is ASCII's.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'), ' ')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def blank(c: str) -> str:
    return f"coalesce(regexp_replace({c}, '{WS}+', '', 'g') = '', true)"


GOLD = "(SELECT DISTINCT * FROM gold_corpus)"
PAGES = "(SELECT DISTINCT * FROM guideline_pages)"
HEADING = f"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({{c}}, '{WS}+', '', 'g')), '^(?:[一二三四五六七八九十.、（）()]|\\p{{Nd}})+', ''), '^[：:]+', ''), '[：:]+$', '')"


def _compatibility() -> tuple[str, str]:
    """Characters that only compatibility composition changes, as a class, and a map to what they become; by rule over all of Unicode."""
    found = {}
    for c in map(chr, range(0xA0, sys.maxunicode + 1)):
        to = unicodedata.normalize("NFKD", c)
        if not 0xD800 <= ord(c) <= 0xDFFF and to != c and to != unicodedata.normalize("NFD", c):
            found[c] = to
    runs: list[list[int]] = []
    for c in map(ord, found):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]", "MAP {" + ", ".join(f"{quote(a)}: {quote(b)}" for a, b in found.items()) + "}"


_CLASS, _MAP = _compatibility()


def nfkc(c: str) -> str:
    """Unicode compatibility composition: the compatibility characters of a text replaced one by one, then composition."""
    return f"nfc_normalize(list_reduce(list_prepend({c}, list_distinct(regexp_extract_all({c}, '{_CLASS}'))), lambda acc, x: replace(acc, x, ({_MAP})[x])))"
