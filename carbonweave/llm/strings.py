"""String measures used by the name and value matchers: edits, skeletons, inflections."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache


@lru_cache(maxsize=200_000)
def osa(a: str, b: str, most: int = 99) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two short strings; most + 1 when beyond `most`."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, prev = [], list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        row = [i]
        least = i
        for j, cb in enumerate(b, 1):
            d = prev[j - 1] + (ca != cb)
            if prev[j] + 1 < d:
                d = prev[j] + 1
            if row[j - 1] + 1 < d:
                d = row[j - 1] + 1
            if i > 1 and j > 1 and ca == b[j - 2] and cb == a[i - 2] and before[j - 2] + 1 < d:
                d = before[j - 2] + 1
            row.append(d)
            if d < least:
                least = d
        if least > most:
            return most + 1
        before, prev = prev, row
    return prev[-1]


def edit_similarity(a: str, b: str, least: float = 0.0) -> float:
    """Share of letters that need no edit; what is below `least` may come out as anything below it."""
    n = max(len(a), len(b))
    return 1.0 - osa(a, b, int((1 - least) * n + 1e-9) if least else 99) / n if n else 1.0


@lru_cache(maxsize=100_000)
def skeleton(t: str) -> str:
    """First letter and the consonants after it, doubled letters once."""
    return re.sub(r"(.)\1+", r"\1", t[:1] + re.sub(r"[aeiouy]", "", t[1:]))


@lru_cache(maxsize=100_000)
def stem(t: str) -> str:
    """Plain English inflections removed."""
    for end, put, least in (("ies", "y", 5), ("ied", "y", 5), ("ings", "", 7), ("ing", "", 6), ("tted", "t", 6), ("ed", "", 5), ("es", "", 6), ("s", "", 4)):
        if t.endswith(end) and len(t) >= least and not (end == "s" and t.endswith("ss")):
            return t[: len(t) - len(end)] + put
    return t


#: Irregular English verb forms and what they are forms of.
IRREGULAR = {
    "has": "have", "had": "have", "having": "have", "does": "do", "did": "do", "done": "do", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be",
    "made": "make", "led": "lead", "bought": "buy", "sold": "sell", "held": "hold", "built": "build", "ran": "run", "gave": "give", "given": "give", "paid": "pay",
    "took": "take", "taken": "take", "grew": "grow", "grown": "grow", "kept": "keep", "met": "meet", "won": "win", "went": "go", "gone": "go", "sent": "send", "spent": "spend",
    "brought": "bring", "found": "find", "got": "get", "lost": "lose", "left": "leave", "said": "say", "told": "tell", "wrote": "write", "written": "write", "began": "begin", "begun": "begin",
}


def lemma(t: str) -> str:
    """What an irregular form is a form of; else the stem."""
    return IRREGULAR.get(t) or stem(t)


@lru_cache(maxsize=10_000)
def irregular_forms(t: str) -> tuple[str, ...]:
    """The forms of an irregular verb that t is a form of; nothing for other words."""
    base = IRREGULAR.get(t, t)
    found = {w for w, b in IRREGULAR.items() if b == base}
    return tuple(sorted(found | {base})) if found else ()


def letters(t: str) -> int:
    """The set of characters as bits, for a cheap first look."""
    out = 0
    for c in t:
        out |= 1 << (ord(c) & 63)
    return out


def is_subsequence(a: str, b: str) -> bool:
    it = iter(b)
    return all(c in it for c in a)


def fold(s: str) -> str:
    """Compatibility form, lower case, accents dropped."""
    if s.isascii():
        return s.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", s).lower() if not unicodedata.combining(c))


def key_of(s: str) -> str:
    """Lower case with everything but letters and digits removed."""
    return "".join(c for c in s.lower() if c.isalnum())
