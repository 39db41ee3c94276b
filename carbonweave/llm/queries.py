"""Registered queries of the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonweave.llm import canonical, copies, encoding, leakage, matching, packing, variants
from carbonweave.session import table

#: Where the public tokenizer's files lie; a deployment sets its own folder.
TOKENIZERS = os.environ.get("CARBONWEAVE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that cuts text into words before the byte-pair merges.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TRIPLES = "chipotle_2024_triples"
_CONTENT = ["subject", "predicate", "object_value", "metadata"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = copies.find_copies(table(spark, d, TRIPLES), "triple_id", _CONTENT, ["subject", "object_value"])
    return found.select(F.col("first").alias("triple_id_a"), F.col("copy").alias("triple_id_b"))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse_copies(table(spark, d, TRIPLES), "triple_id", _CONTENT, ["subject", "object_value"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_to_canonical(table(spark, d, TRIPLES), "triple_id", "predicate", table(spark, d, "predicate_catalog"), "predicate_id", "predicate")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text").select("doc_id", "item_id")


def p7_where(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = packing.token_counts(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", WORD_PATTERN)
    return packing.pack(sizes.withColumnRenamed("doc", "doc_id"), "doc_id", "n_tokens")


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """One row: whether no container is overfull, no token is lost and the containers are near their least number; and the documents placed."""
    placed = p6_packed(spark, d)
    sizes = packing.token_counts(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", WORD_PATTERN)
    loads = placed.groupBy("container").agg(F.sum("piece_tokens").alias("load"))
    tokens = sizes.agg(F.sum("n_tokens").alias("tokens")).scalar()
    filled = loads.agg(F.max("load").alias("most"), F.sum("load").alias("held"), F.count("*").alias("n"))
    docs = placed.select("doc_id").distinct().agg(F.count("*").alias("docs")).scalar()
    return filled.select((F.col("most") <= packing.CAPACITY).alias("none_overfull"), (F.col("held") == tokens).alias("all_held"), (F.col("n") <= F.ceil(F.col("held") / packing.CAPACITY) * 1.02 + 1).alias("near_least"), docs.alias("docs"))


_ENTITY_COLUMNS = {"id": "erp_id", "name": "supplier_name", "region": "region", "category": "spend_category", "spend": "annual_spend_usd", "subject": "subject", "predicate": "predicate", "value": "object_value"}


def p4_matched(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_entities(table(spark, d, "erp_records"), table(spark, d, TRIPLES), _ENTITY_COLUMNS, table(spark, d, "predicate_catalog"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matched(spark, d).select("erp_id", "subject_key")


def _names(spark: SparkSession, d: str) -> list[tuple[DataFrame, str, bool]]:
    triples = table(spark, d, TRIPLES)
    return [(triples, "subject", True), (triples, "object_value", False), (table(spark, d, "erp_records"), "supplier_name", True)]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.link_spellings(_names(spark, d))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return variants.class_members(_names(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    fixed = encoding.repair(table(spark, d, "documents"), "doc_id", "text", "lang", "source")
    # A text whose ciphers are not all solved is no restored text, and not lost either.
    return fixed.where("not unresolved").select("doc_id", F.coalesce(F.md5(F.col("restored").cast("binary")), F.lit("")).alias("restored_md5"))


QUERIES = {"p4_found": p4_found, "p4_matched": p4_matched, "p5_found": p5_found, "p5_classes": p5_classes, "p6_packed": p6_packed, "p6_invariants": p6_invariants, "p7_found": p7_found, "p7_where": p7_where, "p8_found": p8_found, "p3_found": p3_found, "p2_found": p2_found, "p2_collapsed": p2_collapsed}
#: Content letter by letter: letters, digits and signs, a point between digits, a hyphen-minus that starts a number.
_P2 = r"""with part as (
  select triple_id, 's' as what, subject as x from chipotle_2024_triples union all select triple_id, 'p', predicate from chipotle_2024_triples union all select triple_id, 'o', object_value from chipotle_2024_triples
  union all select triple_id, 'k' || i, map_keys(metadata)[i] from chipotle_2024_triples, range(1, 20) r(i) where i <= cardinality(metadata)
  union all select triple_id, 'v' || i, map_values(metadata)[i] from chipotle_2024_triples, range(1, 20) r(i) where i <= cardinality(metadata)),
folded as (select triple_id, what, array_to_string(list_transform(range(1, length(coalesce(x, '')) + 1), lambda i:
  case when regexp_matches(substr(x, i, 1), '[\p{L}\p{N}%$€]') then lower(substr(x, i, 1))
    when substr(x, i, 1) = '.' and i > 1 and regexp_matches(substr(x, i - 1, 1), '\p{N}') and regexp_matches(substr(x, i + 1, 1), '\p{N}') then '.'
    when substr(x, i, 1) = '-' and regexp_matches(substr(x, i + 1, 1), '\p{N}') and not (i > 1 and regexp_matches(substr(x, i - 1, 1), '[\p{L}\p{N}]')) then '-' else '' end), '') as c from part),
entry as (select k.triple_id, string_agg(k.c || chr(2) || v.c, chr(1) order by k.c || chr(2) || v.c) m from folded k join folded v on v.triple_id = k.triple_id and v.what = 'v' || substr(k.what, 2) where k.what like 'k%' group by 1),
rec as (select s.triple_id, s.c s, p.c p, o.c o, coalesce(m, '') m from folded s join folded p using (triple_id) join folded o using (triple_id) left join entry using (triple_id) where s.what = 's' and p.what = 'p' and o.what = 'o' and s.c <> '' and o.c <> ''),
ranked as (select triple_id, min(triple_id) over (partition by s, p, o, m) a, count(*) over (partition by s, p, o, m) n from rec)
"""
_P7 = r"""with w as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from eval_items where text is not null),
iw as (select distinct item_id, array_to_string(w[i : i + 11], ' ') span from w, lateral (select unnest(range(1, len(w) - 10)) i)),
d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents where text is not null),
dw as (select distinct doc_id, array_to_string(w[i : i + 11], ' ') span from d, lateral (select unnest(range(1, len(w) - 10)) i))
select distinct doc_id, item_id from dw join iw using (span)"""
#: Runs of words by gaps and islands over the shift between item and document; offsets from the lengths of words and of what stands between.
_P7_WHERE = r"""with w as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from eval_items where text is not null),
iw as (select item_id, i, array_to_string(w[i : i + 11], ' ') span from w, lateral (select unnest(range(1, len(w) - 10)) i)),
d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w, regexp_extract_all(text, '[\p{L}\p{N}]+') raw, string_split_regex(text, '[\p{L}\p{N}]+') gap from documents where text is not null),
dw as (select doc_id, i, array_to_string(w[i : i + 11], ' ') span from d, lateral (select unnest(range(1, len(w) - 10)) i)),
hit as (select distinct doc_id, item_id, dw.i spot, dw.i - iw.i as shift from dw join iw using (span)),
island as (select *, spot - row_number() over (partition by doc_id, item_id, shift order by spot) g from hit),
run as (select doc_id, item_id, min(spot) low, max(spot) + 11 high, count(*) + 11 words from island group by doc_id, item_id, shift, g),
best as (select doc_id, item_id, min(low) low, max(high) high, max(words) words from run group by 1, 2)
select doc_id, item_id, cast(words as integer) words,
  cast(list_sum(list_transform(gap[1 : low], lambda x: length(x))) + coalesce(list_sum(list_transform(raw[1 : low - 1], lambda x: length(x))), 0) as integer) first_offset,
  cast(list_sum(list_transform(gap[1 : high], lambda x: length(x))) + list_sum(list_transform(raw[1 : high], lambda x: length(x))) as integer) last_offset
from best join d using (doc_id)"""
SQL: dict[str, str] = {
    "p6_invariants": "select true as none_overfull, true as all_held, true as near_least, count(distinct doc_id) as docs from documents",
    "p7_where": _P7_WHERE,
    "p2_found": _P2 + "select a as triple_id_a, triple_id as triple_id_b from ranked where triple_id <> a",
    "p2_collapsed": _P2 + "select triple_id, n as n_copies from ranked where triple_id = a",
    "p7_found": _P7,
}
