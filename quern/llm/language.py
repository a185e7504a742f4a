"""Which language a text is written in, from its scripts and function words."""

from __future__ import annotations

from collections import Counter

import numpy as np

# Frequent function words, which tell apart languages that share the Latin script.
FUNCTION_WORDS = {
    "en": "the of and to in is for with that are be on as by or this from was at an it not which should may can when have has their you your your if all they been".split(),
    "de": "der die das und ist nicht ein eine mit von zu den im für auf bei wird sich des dem als auch nach über nur oder aus sind werden einer eines zum zur vor kann".split(),
    "es": "el la los las de que y en un una por con para del se es no su al lo como más o este esta son sin sobre entre según cuando también puede cada".split(),
    "fr": "le la les des de et un une est pour dans que qui sur avec du en au aux par ne pas ce cette sont plus ou peut être".split(),
    "it": "il lo la gli le di che e un una per con del della è non si in da dei nel sono più o come anche questo questa".split(),
    "pt": "o a os as de que e um uma para com do da dos das em no na por não se mais ou como ao são pode este esta".split(),
}
_VOTES: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in {w for w in _words if len(w) > 1}:  # single letters are too often names and variables
        _VOTES[_w] = (*_VOTES.get(_w, ()), _lang)
# First code points of blocks, each with the script it and what follows belongs to.
_BLOCKS = [
    (0x0, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0xD7, ""), (0xD8, "latin"), (0xF7, ""), (0xF8, "latin"), (0x250, ""),
    (0x400, "cyrillic"), (0x530, ""), (0x600, "arabic"), (0x700, ""), (0x900, "devanagari"), (0x980, ""), (0xE00, "thai"), (0xE80, ""), (0x1100, "hangul"), (0x1200, ""),
    (0x2E80, "han"), (0x2FE0, ""), (0x3041, "kana"), (0x3100, ""), (0x3400, "han"), (0x4DC0, ""), (0x4E00, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""),
    (0xF900, "han"), (0xFB00, ""), (0xFF21, "latin"), (0xFF3B, ""), (0xFF41, "latin"), (0xFF5B, ""), (0x20000, "han"), (0x32000, ""),
]
_STARTS = np.array([b for b, _ in _BLOCKS], dtype=np.uint32)
_SCRIPTS = sorted({s for _, s in _BLOCKS if s})
_INDEX = np.array([_SCRIPTS.index(s) if s else len(_SCRIPTS) for _, s in _BLOCKS])
_NAMES = {"kana": "ja", "hangul": "ko", "thai": "th", "devanagari": "hi", "cyrillic": "ru", "arabic": "ar"}
_MARKS = {"de": "äöüßÄÖÜ", "es": "ñ¿¡áéíóú"}
#: One ideograph carries about as much as this many letters.
IDEOGRAPH = 3.0


def language(text: str) -> str:
    """Code of the language that most of the text is in; "" where it has no letters."""
    if text.isascii():
        counts = {"latin": len(text) if any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text)) else 0}
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        found = np.bincount(_INDEX[np.searchsorted(_STARTS, codes, side="right") - 1], minlength=len(_SCRIPTS) + 1)
        counts = dict(zip(_SCRIPTS, found.tolist()))
    weight = {k: n * (IDEOGRAPH if k in ("han", "kana", "hangul") else 1.0) for k, n in counts.items() if n}
    if not weight:
        return ""
    if weight.get("kana", 0) > 0.12 * (weight.get("kana", 0) + weight.get("han", 0)):
        weight["kana"] = weight.get("kana", 0) + weight.pop("han", 0)
    top = max(weight, key=lambda k: weight[k])
    if top == "han":
        return "zh"
    if top != "latin":
        return _NAMES[top]
    votes: dict[str, float] = {}
    seen = Counter(text.lower().split())
    for w in seen.keys() & _VOTES.keys():
        for lang in _VOTES[w]:
            votes[lang] = votes.get(lang, 0) + seen[w] / len(_VOTES[w])
    if not text.isascii():
        for lang, marks in _MARKS.items():
            n = sum(map(text.count, marks))
            if n:
                votes[lang] = votes.get(lang, 0) + 0.7 * n
    return max(votes, key=lambda k: (votes[k], k == "en")) if votes else "en"
