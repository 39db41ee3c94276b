"""Free-entered values mapped to the entries of a canonical list, unmatched values reported as 0.

Stage 1 is one multi-pattern automaton over the canonical names and their aliases. Its patterns are
sequences of word classes: a word and its inflected, plural and irregular forms are one class, so an
entry is one pattern however many forms its words have. It finds mentions embedded in the value, the
longest non-overlapping one wins. Stage 2 takes the values without a mention to token-set similarity:
each canonical token takes its best token of the value (edits, abbreviation, skeleton, inflection),
tokens weigh by their rarity in the list, order does not count. Only entries that share a similar token
with the value are scored (an inverted index from token to entries). A value longer than WINDOW tokens is
scored window by window and its best window counts. Run-together values are cut where the pieces fit an
entry best, by dynamic programming over the cut positions.

Scale: work is done once per distinct value (aggregated map-side, then spread over all cores), and the
mapping goes back to the rows by broadcast while its counted rows and bytes allow, else by a join salted
against hot values. The canonical list is the only thing held whole; it is a reference list and its size
is checked.

Defined results: null values and values that stand literally in the list give no row; blank values and
values without any match give 0; ties go to the smallest entry id; very long values are read whole by
both stages; repeated rows each come out; an empty list maps everything to 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carbonweave.llm.strings import edit_similarity, fold, irregular_forms, is_subsequence, lemma, letters, skeleton, stem
from carbonweave.session import cut, is_small, python_tasks

#: Tokens of a value that are weighed together against one entry.
WINDOW = 12
MAX_LIST = 100_000
#: Least share of a canonical entry's weight that a value must cover.
LEAST_SCORE = 0.45
#: Least likeness of two tokens that counts at all.
LEAST_LIKENESS = 0.4
#: What a cut that had to be guessed costs.
CUT_COST = 0.1
SALTS = 32


def tokens(value: str) -> list[str]:
    value = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value)
    return [t for t in re.split(r"[^a-z0-9]+", fold(value)) if t]


def inflections(t: str) -> set[str]:
    """The forms of a word that mean the same entry; words of up to three letters have irregular forms only."""
    out = {t, *irregular_forms(t)}
    if len(t) > 3:
        s = stem(t)
        out |= {s, s + "s", s + "es", s + "ed", s + "ing", s + s[-1:] + "ed", s + s[-1:] + "ing"}
        if s.endswith("e"):
            out |= {s + "d", s[:-1] + "ing"}
        if s.endswith("y"):
            out |= {s[:-1] + "ies", s[:-1] + "ied"}
    return {x for x in out if len(x) > 1 or x == t}


class Matcher:
    """The automaton and the similarity over one canonical list."""

    def __init__(self, entries: list[tuple[int, str]], aliases: dict[str, int] | None = None) -> None:
        self.entries = sorted((i, tuple(tokens(name))) for i, name in entries if name and tokens(name))
        df: dict[str, int] = {}
        for _, ts in self.entries:
            for t in set(ts):
                df[t] = df.get(t, 0) + 1
        n = max(1, len(self.entries))
        self.weight = {t: (0.35 + math.log(1 + n / d)) * (0.5 if len(t) <= 2 else 0.8 if len(t) == 3 else 1.0) for t, d in df.items()}
        self.vocabulary = [(t, stem(t), skeleton(t), irregular_forms(t)) for t in sorted(df)]
        self.masks = np.array([letters(t) for t, *_ in self.vocabulary], np.uint64)
        #: Letters that the forms of an irregular word have beside its own.
        self.forms = np.array([letters("".join((t, *forms))) for t, _, _, forms in self.vocabulary], np.uint64)
        self.sizes = np.bitwise_count(self.masks)
        self.holding: dict[str, list[int]] = {}
        for at, (_, ts) in enumerate(self.entries):
            for t in set(ts):
                self.holding.setdefault(t, []).append(at)
        self._patterns([(i, ts, True) for i, ts in self.entries] + [(i, tuple(tokens(a)), False) for a, i in (aliases or {}).items()])
        self.at = {t: k for k, (t, *_) in enumerate(self.vocabulary)}
        self.likeness = lru_cache(maxsize=400_000)(self._likeness)
        self.similar = lru_cache(maxsize=100_000)(self._similar)
        self.resolve = lru_cache(maxsize=200_000)(self._resolve)

    def _patterns(self, listed: list[tuple[int, tuple[str, ...], bool]]) -> None:
        """One pattern of word classes per entry or alias. Words that share a form share a class; hits are checked word by word."""
        joined: dict[str, str] = {}

        def root(w: str) -> str:
            while joined.setdefault(w, w) != w:
                w = joined[w]
            return w

        self.allowed: dict[str, set[str]] = {}
        for _, ts, inflected in listed:
            for t in ts:
                if t not in self.allowed or inflected:
                    self.allowed[t] = inflections(t) if inflected else self.allowed.get(t, {t})
                for x in self.allowed[t]:
                    joined[root(x)] = root(t)
        number = {r: k for k, r in enumerate(sorted({root(w) for w in joined}), 1)}
        self.word_class = {w: number[root(w)] for w in list(joined)}
        found: dict[tuple[int, ...], list[tuple[int, tuple[str, ...], bool]]] = {}
        for i, ts, inflected in listed:
            if ts:
                found.setdefault(tuple(self.word_class[t] for t in ts), []).append((i, ts, inflected))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, payload in found.items():
            self.automaton.add_word(key, payload)
        if found:
            self.automaton.make_automaton()

    def mention(self, typed: list[str]) -> int:
        """Leftmost-longest mentions; of those the longest in letters wins, the smaller id on a tie."""
        if not len(self.automaton):
            return 0
        found = []
        for end, payload in self.automaton.iter(tuple(self.word_class.get(t, 0) for t in typed)):
            for i, ts, inflected in payload:
                words = typed[end + 1 - len(ts) : end + 1]
                if all(w in self.allowed[t] if inflected else w == t for w, t in zip(words, ts)):
                    found.append((end + 1 - len(ts), -sum(map(len, words)) - len(ts) + 1, i, end + 1))
        best, at = (0, 0), 0
        for start, size, i, end in sorted(found):
            if start >= at:
                at = end
                best = min(best, (size, i))
        return best[1]

    def _similar(self, t: str) -> dict[str, float]:
        """Similarity of a typed token to each token of the list, where worth counting."""
        if any(c.isdigit() for c in t):
            return {}
        own = np.uint64(letters(t))
        shared = 5 * np.bitwise_count(self.masks & own).astype(np.int32) >= 3 * np.minimum(self.sizes, np.bitwise_count(own)).astype(np.int32)
        irregular = (self.forms != self.masks) & (5 * np.bitwise_count(self.forms & own).astype(np.int32) >= 3 * int(np.bitwise_count(own)))
        near = ((self.vocabulary[at][0], self.likeness(t, int(at))) for at in np.flatnonzero(shared | irregular))
        return {c: x for c, x in near if x >= LEAST_LIKENESS}

    def _likeness(self, t: str, at: int) -> float:
        """How much a typed token looks like one token of the list."""
        c, cs, ck, forms = self.vocabulary[at]
        s, k = stem(t), skeleton(t)
        if t == c or s == cs or forms and lemma(c) == lemma(t):
            return 1.0
        if len(c) <= 3 and len(t) > 2 * len(c) and not forms:
            return 0.0
        x = max(edit_similarity(t, c, LEAST_LIKENESS), edit_similarity(s, cs, LEAST_LIKENESS) - 0.02)
        if len(t) >= 3 and len(c) > 4:
            if c.startswith(t):
                x = max(x, 0.9)
            elif len(t) < len(c) - 1 and t[0] == c[0]:
                head = edit_similarity(t, c[: len(t)], 0.66)
                if head >= 0.66:
                    x = max(x, 0.74 * head + 0.14)
        if len(k) >= 2 and t[0] == c[0] and len(c) > 3:
            if is_subsequence(k, c) and len(t) >= 3:
                x = max(x, 0.62 + 0.3 * min(1.0, len(k) / max(2, len(ck))))
            x = max(x, 0.9 * edit_similarity(k, ck, LEAST_LIKENESS))
        for f in forms:
            x = max(x, edit_similarity(t, f, LEAST_LIKENESS) - 0.03)
        return x

    def piece(self, piece: str, c: str) -> float:
        """similar() of one piece to one token of the list; a piece that shares under three fifths of its letters has none."""
        at = self.at[c]
        own = letters(piece)
        if 5 * (own & int(self.forms[at])).bit_count() < 3 * min(own.bit_count(), int(self.sizes[at])) or any(x.isdigit() for x in piece):
            return 0.0
        x = self.likeness(piece, at)
        return x if x >= LEAST_LIKENESS else 0.0

    def score(self, typed: list[str]) -> tuple[float, int]:
        """Best entry and the share of both sides' weight that the aligned tokens cover."""
        maps = [self.similar(t) for t in typed]
        best = (0.0, 0)
        for at in sorted({e for m in maps for c in m for e in self.holding[c]}):
            i, ts = self.entries[at]
            pairs = sorted(((m[c], j, k) for j, m in enumerate(maps) for k, c in enumerate(ts) if c in m), reverse=True)
            used_t, used_c, got = set(), set(), 0.0
            for x, j, k in pairs:
                if j not in used_t and k not in used_c:
                    used_t.add(j)
                    used_c.add(k)
                    got += x * x * self.weight[ts[k]]
            whole = sum(self.weight[c] for c in ts)
            extra = sum(0.25 * min(1.5, len(t) / 4) for j, t in enumerate(typed) if j not in used_t)
            s = got / (whole + extra)
            if s > best[0] + 1e-12:
                best = (s, i)
        return best

    def window_score(self, typed: list[str]) -> tuple[float, int]:
        """score() of the best WINDOW tokens in a row; windows whose tokens all resemble nothing are passed over."""
        if len(typed) <= WINDOW:
            return self.score(typed)
        best = (0.0, 0)
        live = [bool(self.similar(t)) for t in typed]
        ahead = sum(live[: WINDOW - 1])
        for at in range(len(typed) - WINDOW + 1):
            ahead += live[at + WINDOW - 1]
            # A window starts with a token that resembles something, or is the last one.
            if ahead and (live[at] or at == len(typed) - WINDOW):
                s, i = self.score(typed[at : at + WINDOW])
                if s > best[0] + 1e-12:
                    best = (s, i)
            ahead -= live[at]
        return best

    def cut_score(self, word: str) -> tuple[float, int]:
        """Best entry for a run-together value, each entry's tokens in order or in reverse order, at the best cuts.

        An entry is looked at when its letters and the value's differ in number by half at most; a cut may
        lie as far from the entry's own boundary as the difference of the lengths lets it.
        """
        best = (0.0, 0)
        n = len(word)
        for i, ts in self.entries:
            whole = sum(map(len, ts))
            if len(ts) < 2 or abs(whole - n) > max(4, n // 2):
                continue
            reach = max(2, n // 2) if len(ts) == 2 else 2 + abs(whole - n) // 2
            weights = sum(self.weight[c] for c in ts)
            for order in {ts, ts[::-1]}:
                # got, unmatched length penalty of the best way to end a piece at each position.
                ways = {0: (0.0, 0.0)}
                at = 0
                for k, c in enumerate(order):
                    at += len(c)
                    ends = range(max(2, at - reach), min(n - 1, at + reach + 1)) if k + 1 < len(order) else (n,)
                    nxt: dict[int, tuple[float, float]] = {}
                    for end in ends:
                        for start, (got, extra) in ways.items():
                            if end - start >= 2:
                                piece = word[start:end]
                                x = self.piece(piece, c)
                                way = (got + x * x * self.weight[c], extra + (0.0 if x else 0.25 * min(1.5, len(piece) / 4)))
                                if end not in nxt or way[0] - way[1] > nxt[end][0] - nxt[end][1]:
                                    nxt[end] = way
                    ways = nxt
                if n in ways:
                    got, extra = ways[n]
                    s = got / (weights + extra)
                    if s > best[0] + 1e-12:
                        best = (s, i)
        return best

    def _resolve(self, text: str) -> int:
        typed = text.split(" ") if text else []
        hit = self.mention(typed)
        if hit or not typed:
            return hit
        if all(any(c.isdigit() for c in t) or len(t) == 1 for t in typed):
            return 0
        s, i = self.window_score(typed)
        if s < LEAST_SCORE and len(typed) == 1 and len(typed[0]) > 4:
            s2, i2 = self.cut_score(typed[0])
            if s2 - CUT_COST > s:
                s, i = s2 - CUT_COST, i2
        return i if s >= LEAST_SCORE else 0


def map_values(df: DataFrame, value_col: str, catalog: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(value, entry): the entry of each distinct value that is not literally in the list."""
    entries = [(r[0], r[1]) for r in catalog.select(F.col(id_col).cast("bigint"), F.col(name_col)).where(F.col(id_col).isNotNull() & F.col(name_col).isNotNull()).limit(MAX_LIST + 1).collect()]
    if len(entries) > MAX_LIST:
        raise ValueError(f"a canonical list has at most {MAX_LIST} entries")
    built: list[Matcher] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not built:
                built.append(Matcher(entries))
            m = built[0]
            values = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.resolve(" ".join(tokens(v))) for v in values], pa.int64())], ["cw_value", "cw_entry"])

    listed = df.sparkSession.createDataFrame([(name,) for _, name in entries], "cw_value string")
    distinct = df.select(F.col(value_col).cast("string").alias("cw_value")).where("cw_value is not null").distinct()
    # The entries were counted above.
    open_values = distinct.join(F.broadcast(listed), "cw_value", "left_anti").repartition(python_tasks(df.sparkSession))
    return open_values.mapInArrow(run, "cw_value string, cw_entry bigint")


def map_to_canonical(df: DataFrame, row_id: str, value_col: str, catalog: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(row id, entry id) for each row whose value is neither null nor literally an entry; 0 where none is meant."""
    mapping = cut(map_values(df, value_col, catalog, id_col, name_col))
    rows = df.select(F.col(row_id).alias("cw_row"), F.col(value_col).cast("string").alias("cw_value")).where("cw_value is not null")
    if is_small(mapping):
        out = rows.join(F.broadcast(mapping), "cw_value")
    else:
        salted = mapping.withColumn("cw_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn("cw_salt", F.pmod(F.hash("cw_row"), F.lit(SALTS))).join(salted, ["cw_value", "cw_salt"])
    return out.select(F.col("cw_row").alias(row_id), F.col("cw_entry").alias(id_col))
