"""Parsing of typed organisation and person names into comparable parts.

Nothing of a name list is built in but the legal forms, titles and short forms of given names below.
Which words are common (descriptors, trades) is learned from counts over all names: a common word
stands in many different names, a proper word in few. Typed tokens are then read as the common word
they abbreviate or misspell, and what is left over is the proper word that identifies the bearer. Given
names are learned too (variants.learn_given); the short forms only say which of them mean one another.
"""

from __future__ import annotations

import re
from functools import lru_cache

from carbonweave.llm.strings import fold, is_subsequence, letters, osa

#: Legal forms as single tokens after folding (dots removed).
LEGAL = {"inc", "incorporated", "ltd", "limited", "llc", "gmbh", "ges", "mbh", "company", "co", "corporation", "corp", "sa", "pty", "plc", "ag", "bv", "kg", "oy", "ab", "spa", "srl"}
#: Titles and particles that carry no identity.
NOISE = {"the", "dr", "mr", "mrs", "ms", "prof", "and"}
#: Short forms of given names.
SHORT_FORMS = {
    "alex": "alexander", "al": "alexander", "tony": "anthony", "chris": "christopher", "dan": "daniel", "danny": "daniel", "deb": "deborah", "debbie": "deborah", "ted": "edward", "ed": "edward", "eddie": "edward", "ned": "edward",
    "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "jim": "james", "jimmy": "james", "jen": "jennifer", "jenny": "jennifer", "joe": "joseph", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "peggy": "margaret", "maggie": "margaret", "meg": "margaret",
    "mike": "michael", "mick": "michael", "nick": "nicholas", "pat": "patricia", "patty": "patricia", "trish": "patricia", "dick": "richard", "rick": "richard", "rich": "richard", "bob": "robert", "rob": "robert", "bobby": "robert", "sue": "susan", "susie": "susan",
    "tom": "thomas", "tommy": "thomas", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "bill": "william", "will": "william", "billy": "william", "liam": "william", "steve": "stephen", "dave": "david", "sam": "samuel", "ben": "benjamin", "greg": "gregory", "andy": "andrew", "matt": "matthew", "becky": "rebecca", "cathy": "catherine", "charlie": "charles", "chuck": "charles", "fred": "frederick", "harry": "henry", "jack": "john", "larry": "lawrence", "ron": "ronald", "sandy": "sandra", "tim": "timothy", "barb": "barbara", "cindy": "cynthia", "dot": "dorothy", "jeff": "jeffrey", "ken": "kenneth", "don": "donald",
}
LONG_LEGAL = ("company", "corporation", "incorporated", "limited")
#: Share of its names in which a descriptor stands next to the proper word, at least.
BESIDE = 0.75


@lru_cache(maxsize=64)
def name_tokens(name: str) -> list[str]:
    """Folded tokens; dotted capitals such as S.A. or L.L.C. are one token, a comma is kept as a token of its own."""
    s = fold(name)
    if "." in s:
        s = re.sub(r"\b(?:[a-z]\.){2,}(?:[a-z]\b)?|\b[a-z]\.[a-z]\b\.?", lambda m: m.group().replace(".", "") + " ", s)
    return re.findall(r"[^\W_]+|,", s)


class Vocabulary:
    """Common words of names and the reading of typed tokens as one of them."""

    def __init__(self, words: dict[str, int], beside: dict[str, float], given: set[str] | frozenset[str] = frozenset()) -> None:
        """words: names per common word. beside: share of them in which it stands next to a rare word.

        A descriptor is a common word that keeps beside the proper word; trades do so only now and then.
        """
        ranked = sorted(((n, w) for w, n in words.items() if w not in LEGAL and w not in NOISE and len(w) > 1), reverse=True)
        self.full: list[str] = []
        for n, w in ranked:
            # An abbreviation or slip of a more frequent word is no word of its own.
            if len(w) >= 4 and not any(len(f) > len(w) and f[0] == w[0] and is_subsequence(w, f) or 5 * n < words[f] and osa(w, f, 1) <= 1 for f in self.full):
                self.full.append(w)
        self.descriptors = {w for w in self.full if beside.get(w, 0.0) >= BESIDE}
        self.given = GivenNames(given)
        self._ready()

    @classmethod
    def of(cls, full: list[str], descriptors: set[str], given: set[str] | frozenset[str] = frozenset()) -> Vocabulary:
        v = cls({}, {}, given)
        v.full, v.descriptors = full, descriptors
        v._ready()
        return v

    def _ready(self) -> None:
        self.masks = [(w, letters(w)) for w in self.full]
        self.known = frozenset(self.full)
        self.read = lru_cache(maxsize=200_000)(self._read)

    def _read(self, t: str) -> tuple[tuple[str, float], ...]:
        """Common words the token may stand for, best first, with how sure that is."""
        if t in self.known:
            return ((t, 1.0),)
        found = []
        own, n = letters(t), len(t)
        for w, theirs in self.masks:
            # Two edits change at most four members of the letter set; else only an abbreviation is possible.
            far = (own ^ theirs).bit_count() > 4 or abs(n - len(w)) > 2
            if far and t[0] != w[0]:
                continue
            x = 0.0
            if len(t) < len(w) and t[0] == w[0] and len(t) >= 2:
                if w.startswith(t) and len(t) >= 2:
                    x = 0.93
                elif is_subsequence(t, w) and sum(c in "aeiou" for c in t) <= max(1, len(t) // 3) and (len(t) >= 3 or len(w) <= 5):
                    x = 0.9
            d = 9 if far else osa(t, w, 2)
            if len(t) >= 3 and (d == 1 or d == 2 and len(w) >= 6):
                x = max(x, 0.97 - 0.08 * d)
            elif len(t) >= 3 and 2 <= len(w) - len(t) <= len(w) - 2 and t[0] == w[0] and len(t) <= 7:
                # An abbreviation that was itself mistyped.
                head = w[: len(t)]
                if osa(t, head, 1) <= 1 and len(t) >= 4:
                    x = max(x, 0.7)
            if x:
                found.append((w, x))
        return tuple(sorted(found, key=lambda f: (-f[1], f[0])))

    def split(self, t: str) -> list[str] | None:
        """Two common words run together, at most one letter between them."""
        for i in range(4, len(t) - 3):
            for j in (i, i + 1):
                if len(t) - j >= 4 and t[:i] in self.known and t[j:] in self.known:
                    return [t[:i], t[j:]]
        return None


def parse_org(name: str, v: Vocabulary) -> tuple[str, str, str, str] | None:
    """(proper word, descriptor, trade, legal form) or None where the name has not that shape."""
    ts = [t for t in name_tokens(name) if t not in NOISE]
    words = [t for t in ts if t != ","]
    if len(words) < 2 or any(c.isdigit() for t in words for c in t):
        return None
    legal, rest = [], []
    for k, t in enumerate(words):
        # "ag" is a legal form only at the end of a name; else it abbreviates a trade.
        if t in LEGAL and not (t == "ag" and k < len(words) - 1):
            legal.append(t)
        else:
            rest.append(t)
    if len(rest) < 2:
        return None
    readings = [v.read(t) for t in rest]
    if sum(not r for r in readings) > 1:
        # Legal forms that were mistyped, and two words typed as one.
        for k in range(len(rest) - 1, -1, -1):
            if readings[k]:
                continue
            form = next((f for f in LONG_LEGAL if abs(len(f) - len(rest[k])) <= 1 and osa(rest[k], f, 2) <= (1 if len(f) < 8 else 2)), None)
            if form:
                legal.append(form)
                del rest[k], readings[k]
                continue
            two = v.split(rest[k])
            if two:
                rest[k : k + 1] = two
                readings[k : k + 1] = [v.read(t) for t in two]
        if len(rest) < 2:
            return None
    scored = sorted((r[0][1] if r else 0.0, k) for k, r in enumerate(readings))
    if scored[0][0] >= 0.85 or len(rest) > 2 and scored[1][0] < 0.6:
        return None
    at = scored[0][1]
    proper = rest[at]
    # A word of few letters is as likely the rest of another word, unless all others are read without doubt.
    if len(proper) < 5 and (readings[at] or any(not r or r[0][1] < 1 for k, r in enumerate(readings) if k != at)):
        return None
    descriptor, trade = "", []
    near = [k for k in (at + 1, at - 1) if 0 <= k < len(rest)]
    best = sorted(((-x, abs(k - at), k, w) for k in near for w, x in readings[k] if w in v.descriptors))
    if not best:
        return None
    _, _, used, descriptor = best[0]
    for k, r in enumerate(readings):
        if k not in (at, used):
            other = [w for w, _ in r if w not in v.descriptors] or [w for w, _ in r]
            trade += other[:1]
    return proper, descriptor, " ".join(sorted(set(trade))), " ".join(sorted(set(legal)))


class GivenNames:
    """Known given names, found again with slips by letters left out of either side."""

    def __init__(self, learned: set[str] | frozenset[str] = frozenset()) -> None:
        self.known = frozenset(SHORT_FORMS.values()) | learned
        self.near: dict[str, list[str]] = {}
        for g in sorted(self.known):
            for w in _left_out(g, 2 if len(g) >= 7 else 1):
                self.near.setdefault(w, []).append(g)

    def read(self, typed: str, most: int) -> str | None:
        """The given name that is meant: its long form, or the nearest known one within `most` slips."""
        name = SHORT_FORMS.get(typed, typed)
        # A short name with a slip is as likely another word.
        if name in self.known or not most or len(name) < 4:
            return name if name in self.known else None
        met = {g for w in _left_out(name, most) for g in self.near.get(w, ()) if len(g) > 4}
        d, g = min(((osa(name, g, most), g) for g in met), default=(9, ""))
        return SHORT_FORMS.get(g, g) if d <= most else None


def _left_out(word: str, most: int) -> set[str]:
    out = edge = {word}
    for _ in range(most):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out = out | edge
    return out


def parse_person(name: str, v: Vocabulary, most: int = 1) -> tuple[str, str, str, str] | None:
    """kind, surname, given name or initial, middle initial; or None. The given name may have `most` slips, one more when long.

    kind p: the given name is known, or the form shows the person (initials, or "Surname, Given" of words
    that are not both common). kind q: two words that may be a given name and a surname.
    """
    raw = [t for t in name_tokens(name) if t not in NOISE]
    comma = "," in raw
    ts = [t for t in raw if t != ","]
    if not 2 <= len(ts) <= 4 or any(c.isdigit() for t in ts for c in t) or any(t in LEGAL for t in ts):
        return None
    if comma:
        head = raw.index(",")
        if head != 1:
            return None
        ts = ts[1:] + ts[:1]
    if len(ts) == 2 and len(ts[1]) == 2 and len(ts[0]) > 3 and not comma and not v.given.read(ts[0], 0):
        return "p", ts[0], ts[1][0], ts[1][1]
    if len(ts) == 3 and len(ts[1]) == 1 and len(ts[2]) == 1:
        return "p", ts[0], ts[1], ts[2]
    surname, first, middle = ts[-1], ts[0], ts[1][0] if len(ts) > 2 else ""
    if len(surname) < 2:
        return None
    if len(first) == 1:
        return ("p", surname, first, middle) if len(surname) > 3 or comma else None
    given = v.given.read(first, most + (most and len(first) >= 9))
    if given:
        return "p", surname, given, middle
    # An unknown given name: not both may be common words, and the form tells how sure it is.
    if not most or len(ts) > 2 and len(ts[1]) > 1 or v.read(surname) and v.read(first):
        return None
    return "p" if comma else "q", surname, first, middle


def sounds(word: str) -> str:
    """Spellings of one sound as one letter."""
    return word.replace("ph", "f").replace("ck", "k")


def parse_name(name: str, v: Vocabulary) -> tuple[str, str, str, str, str] | None:
    """kind (p, q or o), proper word, second part, third part, legal form; None for what is no name.

    A known given name makes a person; a mistyped one does unless the name reads as an organisation
    whose words are all typed right. q: a person only if another spelling bears it out.
    """
    person = parse_person(name, v, 0)
    if person is None:
        org = parse_org(name, v)
        person = parse_person(name, v, 1)
        if org and (person is None or person[0] == "q" or any(t in v.descriptors for t in name_tokens(name))):
            return ("o", sounds(org[0]), *org[1:])
    return (person[0], sounds(person[1]), *person[2:], "") if person else None
