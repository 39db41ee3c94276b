"""Text garbled by a wrong character encoding: affected records found, originals restored where possible.

Unknown code-page swaps are treated as substitution ciphers per source. A cipher unit is either a
sequence of characters that would be one UTF-8 character had it been read with some 8-bit code page
(once or twice over), or a single character of one 8-bit page that stands for another page's byte. For
each unit the hidden letter is learned by expectation-maximization against the bigrams (neighbour
before, neighbour after) of the language's clean text: first over the corpus, then per source with the
corpus result as prior; "the unit is meant as it stands" is always one of the hypotheses, which is
what spares box drawings, Cyrillic words and capitals such as in SÃO. The mapping is applied with
str.translate() after each unit has been put into one private character, occurrence by occurrence:
where the context speaks for the unit itself it stays. U+FFFD marks text that is lost for good.

The pages that a reader is likely to have used say where a unit ends; what it may stand for, and runs that none
of them explains, are read with every other 8-bit page that the Python library knows too. A text that keeps a sign between letters after its
ciphers were solved is not put out as restored: it is marked unresolved.

Scale: one pass over the texts yields counts (source, language, unit, neighbours), aggregated before
the shuffle. Expectation-maximization is independent for every unit, and for every unit of a source, so both
passes are spread by those keys and no source, however large, is one task. Only the language model comes to
the driver: single characters with their neighbours by side, in the languages that hold LANG_SHARE of the
characters (others are pooled), characters under LETTER_SHARE left to the background; so it is bounded by
alphabet x neighbours, not by documents. Only affected documents are shuffled, to meet their source's
mapping; a hot source is salted.

Defined results: null or empty text: not affected; null language: the model pooled over languages is
used; null source: one source of its own; ids that repeat come out as often as they stand; whole texts
are read whatever their length; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import encodings.aliases
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carbonweave.session import cut, python_tasks, small

#: 8-bit code pages a text may have been read with, and written in. Latin-1's controls count as cp1252's gaps.
READ_AS = ["cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859_15", "koi8_r"]
WRITTEN_IN = ["cp1252", "mac_roman", "cp437", "cp850"]
#: Marks of running text beyond the letters.
QUOTES = "‘’“”„«»–—…"
ROUNDS = 12
#: Decided units of one page that vouch for the page.
FIRM = 3
#: A single character with a larger share of the corpus is common.
COMMON_SHARE = 1e-3
GATHERED = 0.5
#: Languages with a smaller share of the non-ASCII characters are pooled; characters with a smaller one are no letters of the model.
LANG_SHARE, LETTER_SHARE = 1e-2, 1e-6
SALTS = 16
LOST = "�"
_PRIVATE = 0xF0000


@lru_cache(maxsize=1)
def other_pages() -> tuple[str, ...]:
    """Every other page of the Python library that reads ASCII as it stands and a byte as a character."""
    out = []
    for page in sorted({codecs.lookup(x).name for x in encodings.aliases.aliases.values() if _is_page(x)}):
        if page.replace("-", "_") not in {codecs.lookup(x).name.replace("-", "_") for x in READ_AS}:
            out.append(page)
    return tuple(out)


def _is_page(name: str) -> bool:
    try:
        codecs.lookup(name)
        whole = bytes(range(128)).decode(name) == bytes(range(128)).decode("ascii")
        upper = [bytes([b]).decode(name, "replace") for b in range(128, 256)]
        whole = whole and len(bytes(range(128, 256)).decode(name, "replace")) == 128
    except (LookupError, UnicodeError, ValueError):
        return False
    return whole and all(len(c) == 1 for c in upper) and sum(c != LOST for c in upper) > 40


@lru_cache(maxsize=1)
def _bytes_of() -> dict[str, dict[str, int]]:
    """page -> character -> byte, for the upper half."""
    out = {}
    for page in (*READ_AS, *other_pages()):
        table = {}
        for b in range(0x80, 0x100):
            ch = bytes([b]).decode(page, "replace")
            table[chr(b) if ch == LOST else ch] = b
        if page == "cp1252":
            table |= {chr(b): b for b in range(0x80, 0xA0)}
        out[page] = table
    return out


def _plausible(ch: str) -> bool:
    o = ord(ch)
    return 0xA0 <= o < 0x250 or 0x370 <= o < 0x460 or 0x2010 <= o < 0x2600 or 0xFB00 <= o < 0xFB07


def _utf8_at(run: str, i: int, table: dict[str, int]) -> tuple[int, str] | None:
    """The character whose UTF-8 bytes stand at i when run is written in the page of `table`."""
    lead = table.get(run[i], 0)
    n = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
    if not n or i + n > len(run):
        return None
    raw = [lead]
    for ch in run[i + 1 : i + n]:
        b = table.get(ch, 0)
        if not 0x80 <= b < 0xC0:
            return None
        raw.append(b)
    try:
        return i + n, bytes(raw).decode("utf-8")
    except UnicodeDecodeError:
        return None


def _unit_at(run: str, i: int) -> tuple[int, dict[str, str]] | None:
    """End and candidate letters of the longest unit that starts at i; letters that had been garbled twice come first."""
    likely, other = _unit_of(run, i, tuple(READ_AS)), _unit_of(run, i, other_pages())
    if likely and other and likely[0] == other[0]:
        return likely[0], {**likely[1], **{x: p for x, p in other[1].items() if x not in likely[1]}}
    return likely or other


def _unit_of(run: str, i: int, pages: tuple[str, ...]) -> tuple[int, dict[str, str]] | None:
    best: tuple[int, dict[str, str]] | None = None
    for page in pages:
        table = _bytes_of()[page]
        chain, ends, at = "", [i], i
        while len(chain) < 4 and at < len(run):
            got = _utf8_at(run, at, table)
            if got is None:
                break
            at = got[0]
            chain += got[1]
            ends.append(at)
        if not chain:
            continue
        twice = _utf8_at(chain, 0, table) if len(chain) > 1 else None
        end, letter = (ends[twice[0]], twice[1]) if twice and _plausible(twice[1]) else (ends[1], chain[0])
        if _plausible(letter) and (best is None or end > best[0]):
            best = (end, {letter: page})
        elif _plausible(letter) and end == best[0]:
            best[1].setdefault(letter, page)
    return best


@lru_cache(maxsize=50_000)
def pieces(run: str) -> tuple[str, ...]:
    """A run of non-ASCII characters cut into units and single characters."""
    out, i = [], 0
    while i < len(run):
        unit = _unit_at(run, i) if i + 1 < len(run) else None
        end = unit[0] if unit else i + 1
        out.append(run[i:end])
        i = end
    return tuple(out)


@lru_cache(maxsize=50_000)
def candidates(unit: str) -> tuple[str, ...]:
    """Letters the unit may stand for."""
    if len(unit) > 1:
        got = _unit_at(unit, 0)
        return tuple(got[1]) if got and got[0] == len(unit) else ()
    out = []
    for page in READ_AS:
        b = _bytes_of()[page].get(unit)
        for written in WRITTEN_IN if b is not None else ():
            ch = bytes([b]).decode(written, "replace")
            if written != page and ch not in (unit, LOST) and ((ch.isalpha() or ch in "²³°¿¡") and ord(ch) < 0x180 or ch in QUOTES):
                out.append(ch)
    return tuple(dict.fromkeys(out))


_RUN = re.compile(r"[^\x00-\x7f]+")


def neighbour(ch: str) -> str:
    """The class of a neighbouring character: letters as such, in lower case; digits, blanks and non-ASCII as one class each."""
    if ch == "":
        return "^"
    if ch > "\x7f":
        return "U"
    return "0" if ch.isdigit() else " " if ch.isspace() else ch.lower()


def occurrences(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """start, end, unit, neighbour before and after, over the whole text."""
    for m in _RUN.finditer(text):
        at = m.start()
        for unit in pieces(m.group()):
            end = at + len(unit)
            yield at, end, unit, neighbour(text[at - 1 : at]) if at else "^", neighbour(text[end : end + 1])
            at = end


def unit_counts(df: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """source, lang, unit, before, after, n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["source", "lang", "unit", "before", "after", "n"]
        for batch in batches:
            c: Counter = Counter()
            for source, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for _, _, unit, before, after in occurrences(text or ""):
                    c[source, lang, unit, before, after] += 1
            cols = list(zip(*c)) if c else [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(list(x), pa.string()) for x in cols), pa.array(list(c.values()), pa.int64())], names)

    texts = df.select(F.coalesce(F.col(source_col), F.lit("")), F.coalesce(F.col(lang_col), F.lit("")), F.col(text_col)).where(F.col(text_col).rlike(r"[^\x00-\x7f]"))
    rows = texts.mapInArrow(run, "source string, lang string, unit string, before string, after string, n bigint")
    return rows.groupBy("source", "lang", "unit", "before", "after").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Neighbours of each non-ASCII letter by language, smoothed by the pool of languages and the background."""

    def __init__(self, rows: list[tuple[str, str, int, str, int]], gathered: frozenset[str] = frozenset()) -> None:
        """rows: language, letter, side (0 before, 1 after), neighbour, count; the letter '' counts all characters and units."""
        self.gathered = gathered
        self.side: dict[tuple[str, str, int], Counter] = defaultdict(Counter)
        self.total: Counter = Counter()
        self.by_lang: Counter = Counter()
        background: list[Counter] = [Counter(), Counter()]
        for lang, letter, side, ctx, n in rows:
            if letter == "":
                background[side][ctx] += n
                if not side:
                    self.by_lang[lang] += n
                    self.by_lang[""] += n if lang else 0
                continue
            for where in {lang, ""}:
                self.side[where, letter, side][ctx] += n
                self.total[where, letter] += 0 if side else n
        self.background = [{k: v / (sum(b.values()) or 1) for k, v in b.items()} for b in background]

    def count(self, lang: str, letter: str) -> int:
        return self.total[lang, letter]

    def share(self, lang: str, letter: str) -> float:
        return self.total[lang, letter] / max(1, self.by_lang[lang])

    def chance(self, lang: str, letter: str, before: str, after: str) -> float:
        out = 1.0
        for k, ctx in enumerate((before, after)):
            base = 0.02 * self.background[k].get(ctx, 0.0) + 0.002
            pooled = (self.side["", letter, k][ctx] + 2 * base) / (self.total["", letter] + 2)
            out *= (self.side[lang, letter, k][ctx] + 3 * pooled) / (self.total[lang, letter] + 3)
        return out

    def as_it_stands(self, before: str, after: str, lang: str = "", unit: str = "") -> float:
        """Neighbours of a sign that is meant: the background, half of it among its like or between blanks; of common characters in a row, their own."""
        if len(unit) > 1 and all(self.share("", c) > COMMON_SHARE for c in unit):
            first, last = self.chance(lang, unit[0], before, "U"), self.chance(lang, unit[-1], "U", after)
            inner = self.chance(lang, unit[0], "U", "U") * self.chance(lang, unit[-1], "U", "U")
            return max((first * last / max(inner, 1e-12)) ** 0.5 if inner else 0.0, self._sign(before, after))
        return self._sign(before, after)

    def _sign(self, before: str, after: str) -> float:
        out = 1.0
        for k, ctx in enumerate((before, after)):
            out *= 0.5 * self.background[k].get(ctx, 1e-4) + (0.25 if ctx in "U " else 0.25 / 30)
        return out


def suspicious(unit: str, model: LanguageModel) -> list[str]:
    """Candidate letters that the corpus knows. A single character that is common itself is no cipher, unless few sources hold it."""
    if len(unit) == 1 and model.share("", unit) > COMMON_SHARE:
        # Its count says nothing then: a hot source may hold it nearly as often as the others hold the letter.
        return [x for x in candidates(unit) if model.share("", x) > COMMON_SHARE and x not in model.gathered] if unit in model.gathered else []
    # A letter must be commoner than the unit that would stand for it, unless the unit's structure gives it away.
    return [x for x in candidates(unit) if model.count("", x) > (0 if len(unit) > 1 else 5 * model.count("", unit))]


def gathered_units(counts: DataFrame) -> frozenset[str]:
    """Common single characters that stand in less than GATHERED of the sources that would hold them if they were spread as their languages' text is."""
    seen = cut(counts.groupBy("source", "lang", "unit").agg(F.sum("n").alias("n")))
    total = seen.agg(F.sum("n")).first()[0] or 0
    single = seen.where(F.length("unit") == 1)
    common = single.groupBy("unit").agg(F.sum("n").alias("all"), F.count_distinct("source").alias("sources")).where(F.col("all") > COMMON_SHARE * total)  # at most 1 / COMMON_SHARE
    of_lang = single.join(F.broadcast(common.select("unit")), "unit").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    whole = seen.groupBy("lang").agg(F.sum("n").alias("whole"))
    shares = seen.groupBy("source", "lang").agg(F.sum("n").alias("own")).join(F.broadcast(whole), "lang").select("source", "lang", (F.col("own") / F.col("whole")).alias("share"))
    missed = shares.join(F.broadcast(of_lang), "lang").groupBy("source", "unit").agg(F.exp(F.sum(F.col("n") * F.log1p(-F.least("share", F.lit(1 - 1e-9))))).alias("missed"))
    expected = missed.groupBy("unit").agg(F.sum(1 - F.col("missed")).alias("expected"))
    return frozenset(r.unit for r in common.join(expected, "unit").where(F.col("sources") < GATHERED * F.col("expected")).select("unit").collect())


def learn_unit(unit: str, rows: list[tuple[str, str, str, int]], model: LanguageModel, prior: dict[str, float] | None = None, weight: float = 2.0) -> dict[str, float]:
    """hypothesis -> share by expectation-maximization over (language, before, after, count); '' is the unit as it stands. Empty where the unit is no cipher."""
    letters = suspicious(unit, model)
    # One letter for another shows inside words; a sign that never touches a letter is meant as it stands.
    alone = len(unit) == 1 and prior is None and not (unit.isalpha() and unit in model.gathered)
    if not letters or alone and not any("a" <= x <= "z" for _, b, a, _ in rows for x in (b, a)):
        return {}
    stand = 0.2 if len(unit) > 1 else 0.7
    start = prior or {"": stand, **{x: (1 - stand) / len(letters) for x in letters}}
    theta = dict(start)
    likely = [({h: model.chance(lang, h, b, a) if h else model.as_it_stands(b, a, lang, unit) for h in theta}, n) for lang, b, a, n in rows]
    for _ in range(ROUNDS):
        got = {h: weight * start[h] for h in theta}
        for chance, n in likely:
            z = sum(theta[h] * chance[h] for h in theta)
            for h in theta:
                got[h] += n * theta[h] * chance[h] / z
        whole = sum(got.values())
        theta = {h: v / whole for h, v in got.items()}
    return theta


def _grouped(df: DataFrame, keys: list[str], of: Callable[[tuple, list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Rows of one key at a time, in Python, spread over all cores by the keys."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.float64() if x.endswith("double") else pa.string() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def told() -> Iterator[pa.RecordBatch]:
            found = of(tuple(held[0][k] for k in keys), held) if held else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), types)], names)

        for batch in batches:
            for row in batch.to_pylist():
                if held and any(row[k] != held[0][k] for k in keys):
                    yield from told()
                    held = []
                held.append(row)
        yield from told()

    return df.repartition(python_tasks(df.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


@lru_cache(maxsize=50_000)
def letter_in(unit: str, page: str) -> str:
    """What a unit of several characters is, had it been read with one page; '' if nothing."""
    got = _unit_of(unit, 0, (page,))
    return next(iter(got[1])) if got and got[0] == len(unit) else ""


def restore(text: str, lang: str, theta: dict[str, dict[str, float]], model: LanguageModel) -> str:
    """The text with every unit replaced whose context speaks for a letter; the rest is untouched.

    Where one page explains all units of several characters that were decided, at least FIRM of them, it
    also decides those that the corpus has too rarely to tell.
    """
    spans: list[tuple[int, int, str, str]] = []
    for start, end, unit, before, after in occurrences(text):
        shares = theta.get(unit)
        letter = ""
        if shares:
            scores = {h: math.log(p + 1e-12) + math.log(model.chance(lang, h, before, after) if h else model.as_it_stands(before, after, lang, unit)) for h, p in shares.items()}
            letter = max(scores, key=lambda h: (scores[h], h))
        if letter or len(unit) > 1:
            spans.append((start, end, unit, letter))
    firm = [(u, x) for _, _, u, x in spans if x and len(u) > 1]
    if len(firm) >= FIRM and len(firm) < sum(len(u) > 1 for _, _, u, _ in spans):
        page = next((p for p in (*READ_AS, *other_pages()) if all(letter_in(u, p) == x for u, x in firm)), None)
        if page:
            spans = [(a, b, u, x or letter_in(u, page) if len(u) > 1 else x) for a, b, u, x in spans]
    out, mapping, at, units = [], {}, 0, {}
    for start, end, unit, letter in spans:
        if letter:
            private = units.setdefault((unit, letter), _PRIVATE + len(units))
            mapping[private] = letter
            out += [text[at:start], chr(private)]
            at = end
    return "".join([*out, text[at:]]).translate(mapping) if out else text


def unresolved(text: str) -> bool:
    """Whether a sign that words do not hold stands between two letters."""
    return any(unicodedata.category(text[k]) in ("So", "Sm", "Sk", "Cc", "Cn", "Co") and text[k - 1].isalpha() and text[k + 1].isalpha() for m in _RUN.finditer(text) for k in range(max(1, m.start()), min(m.end(), len(text) - 1)))


def language_model(counts: DataFrame) -> LanguageModel:
    """The model of single characters; counts: source, lang, unit, before, after, n with rare languages pooled already."""
    flat = counts.select("lang", F.when(F.length("unit") == 1, F.col("unit")).otherwise("").alias("letter"), "n", F.posexplode(F.array("before", "after")).alias("side", "ctx"))
    sides = cut(flat.groupBy("lang", "letter", "side", "ctx").agg(F.sum("n").alias("n")))
    whole = sides.where("side = 0").agg(F.sum("n")).first()[0] or 0
    letters = sides.where("letter <> '' and side = 0").groupBy("letter").agg(F.sum("n").alias("m")).where(F.col("m") >= LETTER_SHARE * whole).select("letter")
    kept = sides.join(small(letters), "letter", "left_semi").unionByName(sides.groupBy("lang", F.lit("").alias("letter"), "side", "ctx").agg(F.sum("n").alias("n")))
    # At most 1 / LANG_SHARE languages x 1 / LETTER_SHARE letters x some dozens of neighbours; in practice some hundred letters.
    return LanguageModel([tuple(r) for r in kept.select("lang", "letter", "side", "ctx", "n").collect()], gathered_units(counts))


def repair(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """id, restored, lost, unresolved of the affected rows; restored is null where original characters are lost or ciphers are left."""
    spark = df.sparkSession
    raw = cut(unit_counts(df, text_col, lang_col, source_col))
    langs = raw.groupBy("lang").agg(F.sum("n").alias("m"))
    total = raw.agg(F.sum("n")).first()[0] or 0
    known = frozenset(r.lang for r in langs.where(F.col("m") >= LANG_SHARE * total).select("lang").collect())  # at most 1 / LANG_SHARE
    counts = raw.withColumn("lang", F.when(F.col("lang").isin(*known), F.col("lang")).otherwise("")) if known else raw
    model = spark.sparkContext.broadcast(language_model(counts))

    def pooled(key: tuple, rows: list[dict]) -> list[tuple]:
        theta = learn_unit(key[0], [(r["lang"], r["before"], r["after"], r["n"]) for r in rows], model.value)
        # Units with a real share of letters; the others are meant as they stand throughout.
        return [(key[0], h, p) for h, p in theta.items()] if theta and 1 - theta[""] > 0.01 else []

    contexts = counts.groupBy("lang", "unit", "before", "after").agg(F.sum("n").alias("n"))
    learned = cut(_grouped(contexts, ["unit"], pooled, "unit string, letter string, share double"))
    # Units are UTF-8 characters in some page or single characters, so their number is bounded by the pages.
    corpus: dict[str, dict[str, float]] = defaultdict(dict)
    for r in learned.collect():
        corpus[r.unit][r.letter] = r.share
    prior = spark.sparkContext.broadcast(dict(corpus))

    def per_source(key: tuple, rows: list[dict]) -> list[tuple]:
        theta = learn_unit(key[1], [(r["lang"], r["before"], r["after"], r["n"]) for r in rows], model.value, prior.value[key[1]])
        return [(*key, h, p) for h, p in theta.items()]

    suspects = counts.join(small(learned.select("unit").distinct()), "unit").select("source", "unit", "lang", "before", "after", "n")
    found = _grouped(suspects, ["source", "unit"], per_source, "source string, unit string, letter string, share double")
    theta = cut(found.groupBy("source").agg(F.collect_list(F.struct("unit", "letter", "share")).alias("theta")))

    def affected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [LOST in t or any(u in prior.value for m in _RUN.finditer(t) for u in pieces(m.group())) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    lang = F.coalesce(F.col(lang_col), F.lit(""))
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), (F.when(lang.isin(*known), lang).otherwise("") if known else lang).alias("lang"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]"))
    kept = texts.mapInArrow(affected, texts.schema).withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS)))
    salted = theta.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, dict[str, dict[str, float]]] = (None, {})
        for batch in batches:
            texts_, restored, lost, left = batch.column("text").to_pylist(), [], [], []
            for k, (text, lang_, source) in enumerate(zip(texts_, batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
                if source != last[0]:
                    shares: dict[str, dict[str, float]] = defaultdict(dict)
                    for r in batch.column("theta")[k].as_py() or ():
                        shares[r["unit"]][r["letter"]] = r["share"]
                    last = (source, shares)
                gone = LOST in text
                new = restore(text, lang_, last[1], model.value)
                open_ = not gone and new != text and unresolved(new)
                lost.append(gone)
                left.append(open_)
                restored.append(None if gone or open_ else new)
            keep = [g or o or r != t for g, o, r, t in zip(lost, left, restored, texts_)]
            out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(restored, pa.string()), pa.array(lost, pa.bool_()), pa.array(left, pa.bool_())], ["id", "restored", "lost", "unresolved"])
            yield out.filter(pa.array(keep, pa.bool_()))

    kind = df.schema[id_col].dataType.simpleString()
    return kept.join(salted, ["source", "salt"], "left").select("id", "source", "lang", "text", "theta").mapInArrow(apply, f"id {kind}, restored string, lost boolean, unresolved boolean").withColumnRenamed("id", id_col)
