"""Variant spellings of names typed by people, linked by merge-and-rematch resolution.

Every distinct spelling (by key: lower case, letters and digits only) is parsed into parts. Spellings
with equal parts merge at once. Then rounds run: each profile (a merged set of spellings: the union of
its proper words, trades, legal forms, given names and initials) enters blocks made from its proper
words with up to two letters left out, together with its descriptor; profiles that share a block are
compared; matches merge, and the richer profiles enter blocking again, until no merge occurs (every
round with a merge lowers the number of profiles, so the rounds end).

Given names are learned from forms that only persons have ("Surname, Given", "Given M. Surname"). Two words
that may be a person of a given name not learned count as one once another spelling bears them out: the
same two words the other way round after a comma, or the surname with the initial. Names that have neither
shape - of one word, with digits, without a common word - link where all words but the legal form are
equal and at least one spelling shows a legal form.

Scale: rows are aggregated to distinct spellings before anything else, so a subject with a third of
all rows is one record. Blocks hold profiles, not rows: two profiles share a block only if their
proper words differ by few letters and their descriptor is equal; a block that many profiles share is
split on both sides by adaptive execution. class_members is the form for large data (one row per spelling);
linked_pairs spells out the pairs of each class where the result is defined as pairs. Rounds end in
reliable checkpoints.

Defined results: null and blank texts and texts without the shape of a name give nothing; a name that
could belong to several entities and has nothing to tell them apart is left unlinked; so are bare words
between two legal forms; texts are read whole; repeated rows change nothing; ties fall to the smaller key;
empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carbonweave.llm.names import LEGAL, NOISE, Vocabulary, name_tokens, parse_name
from carbonweave.llm.strings import osa
from carbonweave.operators.resolve import connected
from carbonweave.session import cut, small

#: A common word stands in at least this share of the names, which bounds their number.
COMMON_SHARE = 0.008
#: A given name stands with this many surnames, and with this share of all spellings at least, which bounds their number.
GIVEN_SURNAMES, GIVEN_SHARE = 3, 1e-5
_RECORD = "key string, kind string, proper string, second string, third string, legal string"
#: Legal forms that mean the same.
_LEGAL_NAMES = {"limited": "ltd", "ges": "gmbh", "mbh": "gmbh", "incorporated": "inc", "corporation": "corp", "company": "co"}


def key_column(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


#: What a name of words has: no digit, and two words at least.
_WORDS = r"\p{L}[^\p{L}]+\p{L}"


def spellings(columns: list[tuple[DataFrame, str, bool]], shaped: bool = False) -> DataFrame:
    """key, text, named, shaped: each distinct key with its most frequent text. named: from a column that mostly holds names.

    shaped: whether the text is words without digits; as an argument, to get only those.
    """
    parts = [df.select(F.col(c).cast("string").alias("text"), F.lit(named).alias("named")) for df, c, named in columns]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # The cheap tests first: most values that are no names hold a plain digit.
    no_digit = lambda c: ~c.rlike("[0-9]") & ~c.rlike(r"\p{N}")
    rows = rows.where(F.col("text").isNotNull())
    rows = rows.where(no_digit(F.col("text")) & F.col("text").rlike(_WORDS)) if shaped else rows.where(F.col("text").rlike(r"\p{L}"))
    texts = rows.groupBy("text").agg(F.count("*").alias("n"), F.max("named").alias("named")).withColumn("key", key_column(F.col("text")))
    keys = texts.groupBy("key").agg(F.max_by("text", F.struct("n", "text")).alias("text"), F.max("named").alias("named")).where("key <> ''")
    return keys.withColumn("shaped", F.lit(True) if shaped else no_digit(F.col("key")) & F.col("text").rlike(_WORDS))


def learn_given(names: DataFrame) -> set[str]:
    """Given names from the forms that only persons have; at most 1 / GIVEN_SHARE of them."""
    t = F.col("text")
    after = lambda k: F.regexp_extract(t, r"^(\p{L}{2,}), (\p{L}{3,})(?: \p{L}\.?)?$", k)
    middle = lambda k: F.regexp_extract(t, r"^(\p{L}{3,}) \p{L}\.? (\p{L}{2,})$", k)
    seen = names.where(t.rlike(r"^\p{L}+(?:,| \p{L}\.?) \p{L}+(?: \p{L}\.?)?$")).select(F.lower(F.when(after(1) != "", after(1)).otherwise(middle(2))).alias("surname"), F.lower(F.when(after(1) != "", after(2)).otherwise(middle(1))).alias("given"))
    counted = seen.where("given <> ''").groupBy("given").agg(F.count_distinct("surname").alias("n"))
    return {r.given for r in counted.where(F.col("n") >= max(GIVEN_SURNAMES, GIVEN_SHARE * names.count())).collect()}


def learn_vocabulary(names: DataFrame) -> Vocabulary:
    """Counts per word over the names; only words above COMMON_SHARE reach the driver (at most a few per 1 / share)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter = Counter()
            for text in batch.column(0).to_pylist():
                words.update({t for t in name_tokens(text) if t not in LEGAL and t not in NOISE and t != ","})
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    texts = names.where("named").select("text")
    total = texts.count()
    counts = texts.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    common = {r[0]: r[1] for r in counts.where(F.col("n") >= max(4, COMMON_SHARE * total)).collect()}

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """word, other, beside: rare words of a common word's names, and whether one stands right next to it."""
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                ts = [t for t in name_tokens(text) if t not in LEGAL and t not in NOISE]
                for k, w in enumerate(ts):
                    if w not in common:
                        continue
                    rare = [t != "," and 3 * common.get(t, 0) <= common[w] for t in ts]
                    beside = k > 0 and rare[k - 1] or k + 1 < len(ts) and rare[k + 1]
                    for other in {t for t, r in zip(ts, rare) if r} or {""}:
                        seen[w, other, bool(beside)] += 1
            cols = list(zip(*seen)) if seen else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.string()), pa.array(list(cols[1]), pa.string()), pa.array(list(cols[2]), pa.bool_()), pa.array(list(seen.values()), pa.int64())], ["word", "other", "beside", "n"])

    met = texts.mapInArrow(neighbours, "word string, other string, beside boolean, n bigint")
    pairs = met.groupBy("word", "other").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("beside"), F.col("n")).otherwise(0)).alias("beside"))
    told = pairs.groupBy("word").agg(F.count_if(F.col("other") != "").alias("others"), (F.sum("beside") / F.sum("n")).alias("share")).collect()
    # A common word stands with many different rare words, a proper word with few.
    kept = {r.word: common[r.word] for r in told if r.others >= max(3, 0.25 * common[r.word])}
    given = learn_given(names)
    return Vocabulary({w: n for w, n in kept.items() if w not in given}, {r.word: r.share for r in told if r.word in kept}, given)


def parsed(names: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One record of parts for each spelling that has the shape of a name."""
    spec = (vocabulary.full, vocabulary.descriptors, vocabulary.given.known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.of(*spec)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = parse_name(text, v)
                if p:
                    legal = " ".join(sorted({_LEGAL_NAMES.get(t, t) for t in p[4].split()}))
                    rows.append((key, *p[:4], legal))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], ["key", "kind", "proper", "second", "third", "legal"])

    return names.select("key", "text").mapInArrow(run, _RECORD)


def edits(letters: int) -> int:
    """The most edits between two proper words of which the shorter has so many letters."""
    return 0 if letters < 4 else 1 if letters < 7 else 2


def shortened(word: str, most: int) -> set[str]:
    """The word with up to `most` letters left out; short words stay closer to themselves."""
    out = {word}
    edge = {word}
    for _ in range(most if len(word) > 5 else 1 if len(word) > 2 else 0):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out |= edge
    return out


def _profiles(records: DataFrame) -> DataFrame:
    parts = {"propers": "proper", "seconds": "second", "thirds": "third", "legals": "legal"}
    one = records.groupBy("cluster", "kind").agg(*[F.array_sort(F.collect_set(c)).alias(a) for a, c in parts.items()])
    return one.withColumn("id", F.monotonically_increasing_id())


def _blocked(profiles: DataFrame, most: int) -> DataFrame:
    """A row per profile and block; words that differ in more than edits() are never taken for one, so they need not meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, blocks = [], []
            kinds, propers, seconds = (batch.column(c).to_pylist() for c in ("kind", "propers", "seconds"))
            for k, (kind, ps, ss) in enumerate(zip(kinds, propers, seconds)):
                heads = [f"o|{s}|" for s in ss] if kind == "o" else [f"p|{i}|" for i in {s[:1] for s in ss}]
                own = {xxhash.xxh3_64_intdigest(h + w) for h in heads for p in ps for w in shortened(p, min(most, edits(len(p))))}
                rows += [k] * len(own)
                blocks += own
            out = batch.column("id").take(pa.array(rows, pa.int64()))
            # Blocks travel as numbers; two blocks that fell together would only cost a comparison.
            yield pa.RecordBatch.from_arrays([pa.array(np.array(blocks, np.uint64).view(np.int64)), out], ["block", "id"])

    return profiles.mapInArrow(run, "block bigint, id bigint")


def near(a: list[str], b: list[str]) -> int:
    """Fewest edits between any two proper words of two profiles that are long enough for them; 9 for none."""
    return min((d for x in a for y in b if (d := osa(x, y, 2)) <= edits(min(len(x), len(y)))), default=9)


def given_match(a: list[str], b: list[str]) -> int:
    """2: a full given name in common; 1: only an initial against a name; 0: contradiction."""
    full_a, full_b = {x for x in a if len(x) > 1}, {x for x in b if len(x) > 1}
    if full_a and full_b:
        return 2 if full_a & full_b else 0
    return 1 if {x[0] for x in a if x} & {x[0] for x in b if x} else 0


def compare(kind: str, a: tuple[list[str], ...], b: tuple[list[str], ...]) -> tuple[int, int] | None:
    """(strength, edits): strength 2 a match, 1 a match if it is the only one; None for no match."""
    d = near(a[0], b[0])
    if d > 2:
        return None
    if kind == "p":
        g = given_match(a[1], b[1])
        middle_a, middle_b = {x for x in a[2] if x}, {x for x in b[2] if x}
        if not g or middle_a and middle_b and not middle_a & middle_b:
            return None
        return (2, d) if g == 2 else (1, d) if d < 2 else None
    words_a, words_b = {w for t in a[2] for w in t.split()}, {w for t in b[2] for w in t.split()}
    if words_a and words_b:
        return (2, d) if words_a & words_b else None
    legal_a, legal_b = {x for x in a[3] if x}, {x for x in b[3] if x}
    clash = bool(legal_a and legal_b and not legal_a & legal_b)
    if d == 2 or clash and d:
        return None
    if not words_a and not words_b:
        return None if clash else (2, d)
    return (1, d + (1 if clash else 0))


def _links(profiles: DataFrame, most: int, changed: DataFrame | None) -> DataFrame:
    """Scored candidates of one round, a < b; changed: the clusters that grew in the round before."""
    blocks = _blocked(profiles, most)
    if changed is None:
        pairs = blocks.join(blocks.withColumnRenamed("id", "other_id"), "block").where("id < other_id").select("id", "other_id").distinct()
    else:
        # Only a profile that grew can find new partners: its blocks meet those of all others.
        grown = _blocked(profiles.join(changed, "cluster", "left_semi"), most).withColumnRenamed("id", "other_id")
        met = blocks.join(small(grown), "block").where("id <> other_id")
        pairs = met.select(F.least("id", "other_id").alias("id"), F.greatest("id", "other_id").alias("other_id")).distinct()
    side = lambda p: profiles.select(F.col("id").alias("id" if p == "a" else "other_id"), F.col("cluster").alias("cluster" if p == "a" else "other"), *([F.col("kind")] if p == "a" else []), *[F.col(c).alias(f"{p}_{c}") for c in ("propers", "seconds", "thirds", "legals")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("propers", "seconds", "thirds", "legals")
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            rows = []
            for k in range(batch.num_rows):
                a, b = tuple(cols[f"a_{f}"][k] for f in fields), tuple(cols[f"b_{f}"][k] for f in fields)
                one, two = cols["cluster"][k], cols["other"][k]
                if one > two:
                    a, b, one, two = b, a, two, one
                got = compare(cols["kind"][k], a, b)
                if got:
                    # What tells the candidates of a vague profile apart: trade or given name.
                    vague_a = not any(a[2]) if cols["kind"][k] == "o" else all(len(x) < 2 for x in a[1])
                    tells = (b if vague_a else a)[2 if cols["kind"][k] == "o" else 1]
                    rows.append((one, two, got[0], got[1], (one if vague_a else two) if got[0] == 1 else None, " ".join(tells)))
            c = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c[0]), pa.string()), pa.array(list(c[1]), pa.string()), pa.array(list(c[2]), pa.int32()), pa.array(list(c[3]), pa.int32()), pa.array(list(c[4]), pa.string()), pa.array(list(c[5]), pa.string())], ["a", "b", "strength", "edits", "vague", "tells"])

    scored = pairs.join(side("a"), "id").join(side("b"), "other_id").mapInArrow(run, "a string, b string, strength int, edits int, vague string, tells string")
    return scored


def _settled(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links: sure matches, and of each vague profile the nearest candidates if they agree among themselves. And the profiles whose candidates disagree."""
    sure = scored.where("strength = 2").select("a", "b")
    vague = scored.where("strength = 1")
    best = vague.groupBy("vague").agg(F.min("edits").alias("least"))
    nearest = vague.join(best, "vague").where("edits = least")
    kinds = nearest.groupBy("vague").agg(F.count_distinct("tells").alias("kinds"))
    single = kinds.where("kinds = 1").select("vague")
    return sure.unionByName(nearest.join(single, "vague").select("a", "b")).distinct(), kinds.where("kinds > 1").select(F.col("vague").alias("cluster"))


def borne_out(records: DataFrame) -> DataFrame:
    """Records with those of kind q (two words that may be a person) made persons where another spelling bears them out, else left out."""
    maybe = records.where("kind = 'q'")
    persons = records.where("kind = 'p'")
    # The same surname and given name, or the surname with the given name's initial.
    whole = persons.select("proper", "second").distinct()
    proven = maybe.join(whole, ["proper", "second"], "left_semi").select("key")
    initials = persons.where(F.length("second") == 1).select("proper", F.col("second").alias("initial")).distinct()
    by_initial = maybe.withColumn("initial", F.substring("second", 1, 1)).join(initials, ["proper", "initial"], "left_semi").select("key")
    added = maybe.join(proven.unionByName(by_initial).distinct(), "key", "left_semi").withColumn("kind", F.lit("p"))
    return records.where("kind <> 'q'").unionByName(added)


def resolve(records: DataFrame, most: int = 2) -> DataFrame:
    """records with their entity as column cluster."""
    records = cut(borne_out(records))
    same = records.groupBy("kind", "proper", "second", "third").agg(F.min("key").alias("cluster"))
    current = cut(records.join(same, ["kind", "proper", "second", "third"]))
    changed = None
    while True:
        scored = cut(_links(cut(_profiles(current)), most, changed))
        links, torn = _settled(scored)
        links = cut(links)
        if links.isEmpty():
            return current
        label = connected(links)
        current = cut(current.join(label.withColumnRenamed("a", "cluster"), "cluster", "left").withColumn("cluster", F.coalesce("label", "cluster")).drop("label"))
        # A profile whose candidates disagree is judged anew against all of them.
        changed = cut(label.select(F.col("label").alias("cluster")).unionByName(torn).distinct())


def equal_but_legal(names: DataFrame, parsed_: DataFrame) -> DataFrame:
    """cluster, key of names without the shape of parsed ones whose words are equal but for the legal form.

    Words that two different legal forms share are two organisations, and the bare words belong to neither.
    """
    known = F.create_map(*[F.lit(x) for t in sorted(LEGAL) for x in (t, _LEGAL_NAMES.get(t, t))])
    dotless = F.regexp_replace(F.lower("text"), r"(?<=\b\p{L})\.(?=\p{L}\b)", "")
    words = F.filter(F.split(dotless, r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (t != "the"))
    rest = names.join(parsed_.select("key"), "key", "left_anti").select("key", "text")
    shown = rest.where(dotless.rlike(rf"\b(?:{'|'.join(sorted(LEGAL))})\b")).select("key", words.alias("words"))
    legal = F.array_sort(F.array_distinct(F.transform(F.filter("words", lambda t: t.isin(*LEGAL)), lambda t: F.try_element_at(known, t))))
    formed = cut(shown.select("key", F.array_join(F.filter("words", lambda t: ~t.isin(*LEGAL)), "").alias("core"), F.array_join(legal, " ").alias("legal")).where("core <> '' and legal <> ''"))
    forms = formed.groupBy("core").agg(F.count_distinct("legal").alias("forms"))
    one = forms.where("forms = 1").select("core")
    # The key of the bare words is the core itself.
    bare = rest.select("key", F.col("key").alias("core")).join(small(one), "core", "left_semi").select("core", "key")
    single = formed.join(one, "core", "left_semi").select("core", "key").unionByName(bare)
    several = formed.join(forms.where("forms > 1").select("core"), "core", "left_semi").select(F.concat_ws("|", "core", "legal").alias("core"), "key")
    members = cut(single.unionByName(several).distinct())
    heads = members.groupBy("core").agg(F.min("key").alias("cluster"), F.count("*").alias("n")).where("n > 1").select("core", "cluster")
    return members.join(heads, "core").select("cluster", "key")


def classes(columns: list[tuple[DataFrame, str, bool]]) -> DataFrame:
    """cluster, key of every spelling that belongs to an entity, lone ones among them."""
    names = cut(spellings(columns))
    shaped = names.where("shaped")
    records = cut(parsed(shaped, learn_vocabulary(shaped)))
    resolved = resolve(records)
    return cut(resolved.select("cluster", "key").unionByName(equal_but_legal(names, resolved)).distinct())


def class_members(columns: list[tuple[DataFrame, str, bool]]) -> DataFrame:
    """key, class_id, n_links: one row per spelling that is linked with others, its class and with how many."""
    members = classes(columns)
    size = members.groupBy("cluster").agg(F.min("key").alias("class_id"), (F.count("*") - 1).alias("n_links")).where("n_links > 0")
    return members.join(size, "cluster").select("key", "class_id", "n_links")


def linked_pairs(members: DataFrame) -> DataFrame:
    """(name_a, name_b) for every two keys of one entity."""
    return members.select("cluster", F.col("key").alias("name_a")).join(members.select("cluster", F.col("key").alias("name_b")), "cluster").where("name_a < name_b").select("name_a", "name_b")


def link_spellings(columns: list[tuple[DataFrame, str, bool]]) -> DataFrame:
    return linked_pairs(classes(columns))
