"""Surface structure of a text: words of running sentences, list markers, cells, character classes."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

#: Words that sentences need and items, cells and labels mostly do without (fixed values, four languages).
SENTENCE_WORDS = frozenset(
    """the a an was were is are has have had be been being it its that which who whom whose this these those there they them their he she his her we you i not could would should can will by to from since after before because when while if but or also than then with for as into where what why how did do does on in so until during unlike said
    le la les un une des du est sont était étaient a ont été dans par pour avec sur qui que ne pas plus il elle ils elles se en au aux ce cette ces mais depuis encore aussi
    el los las una es son fue fueron está están por con para no se su sus más que lo al como desde también pero todavía hay ha tiene del
    der die das den dem ein eine einer eines einem einen ist sind war waren wurde wurden hat haben im mit auf für nicht aus bei als es sich auch noch nach zu zum zur aber gibt liegt kommt""".split()
)
#: Start of a list item.
MARKER = re.compile(r"^[ \t]*(?:[-*•–‣◦·]|\d{1,3}[.)]|\(?[A-Za-z]\)|\(\d{1,3}\))[ \t]+")
SENTENCE_END = re.compile(r"[.!?…:;][\"'”’»)\]]*$")
STRIP = "\"'“”‘’«»()[]{}.,;:!?…*_"
WINDOW = 12

LETTER, DIGIT, SPACE, SYMBOL, ODD = range(5)


def _class_table() -> np.ndarray:
    table = np.full(0x10000, LETTER, np.uint8)
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "N":
            table[c] = DIGIT
        elif kind[0] == "Z" or kind in ("Cc", "Cf"):
            table[c] = SPACE
        elif kind[0] not in "LM":
            table[c] = SYMBOL if c < 0x80 or 0x2010 <= c <= 0x2027 or c in (0xAB, 0xBB) else ODD
    return table


_CLASSES: list[np.ndarray] = []


def char_classes(texts: list[str]) -> np.ndarray:
    """Counts of letters, digits, spaces, symbols and odd symbols in each text (rows)."""
    if not _CLASSES:
        _CLASSES.append(_class_table())
    out = np.zeros((len(texts), 5), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _CLASSES[0][np.minimum(chars, 0xFFFF)]
    some = np.nonzero(sizes)[0]
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        for k in range(5):
            out[some, k] = np.add.reduceat(kinds == k, starts)
    return out


class _Flags(dict):
    """Part -> whether it is a word of running sentences; computed when first asked for."""

    def __missing__(self, part: str) -> bool:
        flag = self[part] = part.strip(STRIP).lower() in SENTENCE_WORDS
        return flag


_FLAGS = _Flags()


def sentence_flags(parts: list[str]) -> list[bool]:
    """For each white-space separated part, whether it is a word of running sentences."""
    if len(_FLAGS) > 500_000:
        _FLAGS.clear()
    return [_FLAGS[p] for p in parts]


def running_share(flags: list[bool]) -> float:
    """Share of parts inside stretches of about ``WINDOW`` that hold enough sentence words."""
    n = len(flags)
    if not n:
        return 0.0
    count = max(1, round(n / WINDOW))
    inside = 0
    for k in range(count):
        a, b = n * k // count, n * (k + 1) // count
        if sum(flags[a:b]) >= 0.15 * (b - a):
            inside += b - a
    return inside / n
