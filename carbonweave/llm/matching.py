"""Entities matched across two tables without a shared key, each match with a confidence.

A deterministic cascade of rules. Every rule is an exact join on a combination of attributes that is
weaker than the one before: the key of the name; all parts of the name; proper word, descriptor and
trade; the same with letters of the proper word left out (an exact join on shortened words); and, where
a name lacks its trade, the remaining parts together with region, category or spend. Records resolved
by one pass are anti-joined from the next. Registry rows that are re-sent or retyped are first brought
to one registry organisation by the same rules, chains of likeness included.

A rule's confidence is its precision on labelled pairs, smoothed. A pair is labelled where both sides state
a spend, and the label is whether the spends agree within SPEND_TOLERANCE. The rules are measured with
spend held back from their choice, so no label judges a choice it made itself. Spends of one organisation
may disagree and those of two may agree by chance: how often is measured on identical names and on the
distribution of spends, and the precision is corrected for both. Rules stand in order of strength, so where a
weaker one measures higher the two are pooled.

What a typed predicate means is problem 3's mapping to the catalogue. How the triples write a region or
category is not built in either: each typed value stands for the registry's value it meets most often
among the pairs of the first two rules.

Scale: triples are aggregated to one record per key before any join, so a subject with a third of all
rows is one record; every join is an equi-join on name parts. The candidates of the later rules are joined
and weighed once and written; each pass reads them without the keys resolved before and writes its new
matches only. The registry's regions and the value tables are bounded by distinct typed values and are
joined, not broadcast, unless small. Only a few numbers per rule and the histogram of log spends come to
the driver.

Defined results: null or blank names match nothing; null attributes neither support nor contradict;
a key joins one organisation only - where two fit equally it stays unmatched; repeated registry rows each
come out; empty tables give an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carbonweave.llm.canonical import map_values
from carbonweave.llm.strings import osa
from carbonweave.llm.variants import key_column, learn_vocabulary, parsed, shortened, spellings
from carbonweave.operators.resolve import connected
from carbonweave.session import cut, small

#: Two spends agree when they differ by less than this share of the larger. Records of one organisation differ by a few per cent.
SPEND_TOLERANCE = 0.12
#: The canonical predicates that state an attribute.
FACTS = {"OPERATES_IN": "region", "BELONGS_TO_CATEGORY": "category", "REPORTS_PURCHASE": "spend"}
_MONEY = r"(?i)(?:usd|\$|us\$)\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(million|mn|m|k|thousand|bn|billion)?|([0-9][0-9,]*(?:\.[0-9]+)?)\s*(million|mn|m|k|thousand|bn|billion)?\s*(?:usd|us\$|dollars)"


def fact_predicates(triples: DataFrame, predicate: str, catalog: DataFrame | None, facts: dict[str, str]) -> DataFrame:
    """p, kind: the typed predicates that state a fact. catalog: predicate_id and predicate; without one only literal names count."""
    literal = triples.sparkSession.createDataFrame(list(facts.items()), "p string, kind string")
    if catalog is None:
        return literal
    meant = literal.join(catalog.select(F.col("predicate").alias("p"), F.col("predicate_id").cast("bigint").alias("cw_entry")), "p")
    typed = map_values(triples, predicate, catalog, "predicate_id", "predicate").join(F.broadcast(meant.select("cw_entry", "kind")), "cw_entry")
    return literal.unionByName(typed.select(F.col("cw_value").alias("p"), "kind"))


def money(c: F.Column) -> F.Column:
    pick = lambda a, b: F.coalesce(F.nullif(F.regexp_extract(c, _MONEY, a), F.lit("")), F.nullif(F.regexp_extract(c, _MONEY, b), F.lit("")))
    unit = F.lower(pick(2, 4))
    by = F.when(unit.isin("k", "thousand"), 1e3).when(unit.isin("m", "mn", "million"), 1e6).when(unit.isin("bn", "billion"), 1e9).otherwise(1.0)
    return F.regexp_replace(pick(1, 3), ",", "").try_cast("double") * by


def subject_records(triples: DataFrame, subject: str, value: str, predicate: str, meant: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, spend) and (key, kind, value): what the triples say of each key."""
    rows = triples.select(F.col(subject).cast("string").alias("s"), F.col(predicate).cast("string").alias("p"), F.col(value).cast("string").alias("v")).where("s is not null and v is not null")
    said = rows.join(small(cut(meant)), "p").select("s", "kind", "v")
    told = cut(said.groupBy("s", "kind", "v").agg(F.count("*").alias("n")).groupBy(key_column(F.col("s")).alias("key"), "kind", "v").agg(F.sum("n").alias("n")).where("key <> ''"))
    spend = told.where("kind = 'spend'").select("key", money(F.col("v")).alias("spend")).where("spend > 0").groupBy("key").agg(F.percentile_approx("spend", 0.5).alias("spend"))
    facts = told.where("kind <> 'spend'").groupBy("key", "kind", key_column(F.col("v")).alias("value")).agg(F.sum("n").alias("n")).where("value <> ''")
    return spend, facts


def _near(pairs: DataFrame, most: int) -> DataFrame:
    """Keeps pairs whose proper words differ by at most `most` edits; adds them as column edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = pa.array([osa(x, y, most) for x, y in zip(batch.column("proper_a").to_pylist(), batch.column("proper_b").to_pylist())], pa.int32())
            out = batch.append_column("edits", d)
            yield out.filter(pc.less_equal(d, most)) if batch.num_rows else out

    return pairs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", edits int")


def _shortened(records: DataFrame, most: int) -> DataFrame:
    """A row per record and shortened proper word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words = [], []
            for k, p in enumerate(batch.column("proper").to_pylist()):
                for w in shortened(p, most if len(p) >= 7 else 1):
                    rows.append(k)
                    words.append(w)
            out = batch.take(pa.array(rows, pa.int64()))
            yield out.append_column("short", pa.array(words, pa.string()))

    return records.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema) + ", short string")


def _tokens_meet(a: str, b: str) -> F.Column:
    return F.arrays_overlap(F.split(a, " "), F.split(b, " "))


def _scored(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds blind (region and category that agree minus those that contradict), votes (with spend, which counts twice) and the label where both state a spend."""
    e = evidence.select(F.col("key"), F.col("spend").alias("spend_a"), F.col("region").alias("region_a"), F.col("category").alias("category_a"))
    p = pairs.join(e, "key", "left")
    gap = F.abs(F.col("spend_a") - F.col("spend_b")) / F.greatest("spend_a", "spend_b")
    vote = lambda same, both: F.when(both, F.when(same, 1).otherwise(-1)).otherwise(0)
    blind = vote(F.array_contains("regions_b", F.col("region_a")), F.col("region_a").isNotNull() & (F.size("regions_b") > 0)) + vote(F.array_contains("categories_b", F.col("category_a")), F.col("category_a").isNotNull() & (F.size("categories_b") > 0))
    return p.select("key", "org", "edits", *[c for c in ("third", "third_b") if c in pairs.columns], blind.alias("blind"), (blind + 2 * vote(gap <= SPEND_TOLERANCE, gap.isNotNull())).alias("votes"), F.when(gap.isNotNull(), gap <= SPEND_TOLERANCE).alias("label"))


def _one_org_each(pairs: DataFrame, votes: str) -> DataFrame:
    """Of each key's candidates the best; keys with two equally good organisations are left out."""
    # Of the equally good candidates the smallest and the largest organisation are the same exactly if there is one.
    top = F.max(F.struct((-F.col("edits")).alias("e"), F.col(votes).alias("v"), "org", "label")).alias("top")
    low = F.min(F.struct(F.col("edits").alias("e"), (-F.col(votes)).alias("v"), "org")).alias("low")
    return pairs.groupBy("key").agg(top, low).where("top.org = low.org").select("key", "top.org", "top.label")


def _confidences(told: dict[int, tuple[int, int]], chance: float) -> dict[int, float]:
    """rule -> confidence. told: per rule the labelled pairs and those of them whose spends agree; chance: how often two organisations' spends agree.

    Rule 1 pairs identical names and tells how often the spends of one organisation agree.
    """
    n1, agree1 = told.get(1, (0, 0))
    same = (agree1 + 1) / (n1 + 2) if n1 else 1.0
    pools: list[list] = []
    for rule, (n, agree) in sorted(told.items()):
        rate = (agree + 1) / (n + 2)
        right = 1.0 if rule == 1 else (rate - chance) / (same - chance) if same > chance else rate
        pools.append([min(max(right, 1 / (n + 2)), (n + 1) / (n + 2)), n + 2, [rule]])
        while len(pools) > 1 and pools[-2][0] < pools[-1][0]:
            right, weight, rules = pools.pop()
            before = pools[-1]
            pools[-1] = [(before[0] * before[1] + right * weight) / (before[1] + weight), before[1] + weight, before[2] + rules]
    return {rule: round(right, 6) for right, _, rules in pools for rule in rules}


def _chance(spends: DataFrame) -> float:
    """How often two organisations' spends agree within the tolerance, from the histogram of their logarithms."""
    width = -math.log(1 - SPEND_TOLERANCE)
    bins = {r[0]: r[1] for r in spends.where("spend_b > 0").groupBy(F.floor(F.log("spend_b") / width)).count().collect()}
    n = sum(bins.values())
    # Values that differ by less than the width lie in one bin or in neighbouring ones.
    return sum(k * (0.75 * k + 0.625 / 2 * (bins.get(b - 1, 0) + bins.get(b + 1, 0))) for b, k in bins.items()) / n**2 if n else 0.0


def registry_orgs(registry: DataFrame, parts: DataFrame, most: int = 2) -> DataFrame:
    """id, org: registry rows of one organisation under one name; the rules applied within the registry."""
    rows = registry.join(parts.select(F.col("key").alias("name_key"), "proper", "second", "third"), "name_key", "left")
    exact = F.when(F.col("proper").isNotNull(), F.concat_ws("|", "proper", "second", "third")).otherwise(F.col("name_key"))
    rows = cut(rows.withColumn("org", exact))
    groups = rows.where("proper is not null").groupBy("org", "proper", "second", "third").agg(F.percentile_approx("spend", 0.5).alias("spend"), F.first("region_key", ignorenulls=True).alias("region"), F.count("*").alias("n"))
    s = _shortened(groups, most)
    a, b = (s.select(F.col("short"), F.col("second"), *[F.col(c).alias(f"{c}_{x}") for c in ("org", "proper", "third", "spend", "region")]) for x in "ab")
    met = a.join(b, ["short", "second"]).where("org_a < org_b").drop("short").distinct()
    met = _near(met, most)
    gap = F.abs(F.col("spend_a") - F.col("spend_b")) / F.greatest("spend_a", "spend_b")
    both = (F.col("third_a") != "") & (F.col("third_b") != "")
    alike = met.where(F.when(both, _tokens_meet("third_a", "third_b")).otherwise((gap <= SPEND_TOLERANCE) & ((F.col("third_a") == "") & (F.col("third_b") == "") | (F.col("edits") < 2))))
    # Chains of likeness are one organisation, under its smallest name.
    label = connected(cut(alike.select(F.col("org_a").alias("a"), F.col("org_b").alias("b")))).withColumnRenamed("a", "org")
    return rows.join(label, "org", "left").withColumn("org", F.coalesce("label", "org")).drop("label")


def match_entities(registry: DataFrame, triples: DataFrame, columns: dict[str, str], catalog: DataFrame | None = None, facts: dict[str, str] = FACTS) -> DataFrame:
    """id, key, rule, confidence. columns names: id, name, region, category, spend; subject, predicate, value. catalog: the canonical predicates."""
    c = columns
    names = cut(spellings([(triples, c["subject"], True), (registry, c["name"], True)], shaped=True))
    parts = cut(parsed(names, learn_vocabulary(names)).where("kind = 'o'"))
    reg = registry.select(F.col(c["id"]).alias("id"), key_column(F.col(c["name"]).cast("string")).alias("name_key"), F.col(c["spend"]).cast("double").alias("spend"), key_column(F.col(c["region"]).cast("string")).alias("region_key"), key_column(F.col(c["category"]).cast("string")).alias("category_key")).where("name_key <> ''").withColumn("spend", F.when(F.isnan("spend"), None).otherwise(F.col("spend")))
    reg = cut(registry_orgs(reg, parts))
    spend, said = subject_records(triples, c["subject"], c["value"], c["predicate"], fact_predicates(triples, c["predicate"], catalog, facts))
    subjects = triples.select(F.col(c["subject"]).cast("string").alias("s")).distinct().select(key_column(F.col("s")).alias("key")).where("key <> ''").distinct()
    keyed = cut(subjects.join(parts.select("key", "proper", "second", "third", "legal"), "key", "left"))

    # Rules 1 and 2 need no attributes; their pairs teach what the typed regions and categories mean.
    org_names = reg.select("org", "name_key", "proper", "second", "third").distinct()
    first = keyed.join(org_names.select(F.col("name_key").alias("key"), "org").distinct(), "key").select("key", "org")
    rest = keyed.join(first.select("key").distinct(), "key", "left_anti")
    second = rest.join(org_names.select("proper", "second", "third", "org").where("proper is not null").distinct(), ["proper", "second", "third"]).select("key", "org")
    sure = cut(first.withColumn("rule", F.lit(1)).unionByName(second.withColumn("rule", F.lit(2))).distinct())
    values = reg.select("org", F.lit("region").alias("kind"), F.col("region_key").alias("stands")).unionByName(reg.select("org", F.lit("category").alias("kind"), F.col("category_key").alias("stands"))).where("stands <> ''").groupBy("org", "kind", "stands").agg(F.count("*").alias("m"))
    met = said.join(sure, "key").join(values, ["org", "kind"]).groupBy("kind", "value", "stands").agg(F.count("*").alias("n"))
    # A registry value written in several ways counts under its commonest spelling.
    meaning = cut(met.groupBy("kind", "value").agg(F.max_by("stands", F.struct("n", "stands")).alias("stands")))
    own = meaning.select("kind", F.col("value").alias("typed"), F.col("stands").alias("official"))
    stated = said.join(meaning, ["kind", "value"]).groupBy("key", "kind").agg(F.max_by("stands", F.struct("n", "stands")).alias("stands"))
    pivoted = stated.groupBy("key").agg(F.max(F.when(F.col("kind") == "region", F.col("stands"))).alias("region"), F.max(F.when(F.col("kind") == "category", F.col("stands"))).alias("category"))
    evidence = cut(spend.join(pivoted, "key", "full"))
    official = values.join(own, (values.kind == own.kind) & (F.col("stands") == F.col("typed")), "left").select("org", values.kind.alias("kind"), F.coalesce("official", "stands").alias("stands"))
    org_facts = official.groupBy("org").agg(F.collect_set(F.when(F.col("kind") == "region", F.col("stands"))).alias("regions_b"), F.collect_set(F.when(F.col("kind") == "category", F.col("stands"))).alias("categories_b"))
    org_spend = reg.groupBy("org").agg(F.percentile_approx("spend", 0.5).alias("spend_b"))
    about_org = cut(org_spend.join(org_facts, "org", "left"))
    orgs = reg.where("proper is not null").select("org", F.col("proper"), F.col("second"), F.col("third").alias("third_b")).distinct()

    weighed = cut(_scored(sure.withColumn("edits", F.lit(0)).join(about_org, "org", "left"), evidence).join(sure, ["key", "org"]))
    parted = [(rule, weighed.where(F.col("rule") == rule)) for rule in (1, 2)]
    done = [cut(_one_org_each(pairs, "votes").withColumn("rule", F.lit(rule))) for rule, pairs in parted]

    def unresolved(df: DataFrame) -> DataFrame:
        return df.join(reduce(DataFrame.unionByName, [x.select("key") for x in done]), "key", "left_anti")

    # The candidates of the later rules: the descriptor alike, the proper word with up to two slips.
    a = _shortened(unresolved(keyed.where("proper is not null")).select("key", "proper", "second", "third"), 2).withColumnRenamed("proper", "proper_a")
    b = _shortened(orgs, 2).withColumnRenamed("proper", "proper_b")
    near = _near(a.join(b, ["short", "second"]).select("key", "org", "proper_a", "proper_b", "third", "third_b").distinct(), 2)
    candidates = cut(_scored(near.select("key", "org", "edits", "third", "third_b").distinct().join(about_org, "org", "left"), evidence))
    a_, b_ = F.col("third") != "", F.col("third_b") != ""
    trades = {"common": _tokens_meet("third", "third_b") & a_ & b_, "none": ~a_ & ~b_, "one": a_ != b_, "lacking": ~a_ | ~b_}
    # 3: proper word and descriptor alike, a trade in common. 4: the same, proper word with slips.
    # 5: proper word and descriptor alike, one side without trade, attributes decide. 6: neither side has
    # a trade, one slip, nothing contradicts. 7: one side has a trade, one slip, attributes support it.
    for rule, slips, trade, least in ((3, 0, "common", None), (4, 2, "common", None), (5, 0, "lacking", 0), (6, 1, "none", 0), (7, 1, "one", 1)):
        pairs = unresolved(candidates.where((F.col("edits") <= slips) & trades[trade]))
        parted.append((rule, pairs if least is None else pairs.where(F.col("blind") >= least)))
        done.append(cut(_one_org_each(pairs if least is None else pairs.where(F.col("votes") >= least), "votes").withColumn("rule", F.lit(rule))))

    # Each rule as it would have chosen without the spend.
    blind = reduce(DataFrame.unionByName, [_one_org_each(pairs, "blind").select(F.lit(rule).alias("rule"), "label") for rule, pairs in parted])
    told = {r[0]: (r[1], r[2]) for r in blind.groupBy("rule").agg(F.count("label"), F.count_if("label")).collect()}
    confidence = _confidences(told, _chance(about_org))
    known = F.create_map(*[F.lit(x) for rule, right in ({0: 0.5} | confidence).items() for x in (rule, float(right))])
    found = reduce(DataFrame.unionByName, [x.select("key", "org", "rule") for x in done])
    return found.join(reg.select("id", "org"), "org").select(F.col("id").alias(c["id"]), F.col("key").alias("subject_key"), "rule", F.coalesce(F.try_element_at(known, F.col("rule")), F.lit(0.5)).alias("confidence")).distinct()
