"""Column expressions for the text rules of the graph: predicates, trimming, numbers, candidates.

All of them are built-in functions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from carbonweave.ontology import DEFAULT_PREDICATE, DEFAULT_SUBJECT, FALLBACK_LABEL, OBJECT_LABELS, SUBJECT_LABELS, VALUE_KEYED

#: All Unicode white space; plain trim() removes U+0020 only.
BLANKS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: What counts as a number; engines differ in what their casts let through.
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
#: Fixed value: a run that starts with a capital, as names in a question do.
CANDIDATE = r"[A-Z][a-zA-Z0-9&\.\-\s]{1,40}"
#: Words of a question that ask for targets.
TARGET_WORDS = ("target", "net-zero", "netzero", "commit", "reduction")
#: Words of an error message that tell of a spent quota.
QUOTA_WORDS = ("429", "quota", "resource exhausted", "rate limit")


def normalize_predicate(c: Column) -> Column:
    s = F.translate(F.upper(c), " -", "__")
    s = F.regexp_replace(s, r"[^A-Z0-9_]", "_")
    s = F.btrim(F.regexp_replace(s, r"_+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(DEFAULT_PREDICATE))


def strip(c: Column) -> Column:
    # Hardly any text has blanks at its ends, and a look at two letters is far cheaper than a search through all.
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.coalesce(F.when(ends.rlike(BLANKS), F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")).otherwise(c), F.lit(""))


def _lookup(table: Mapping[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def subject_label(predicate: Column) -> Column:
    return _lookup(SUBJECT_LABELS, predicate, DEFAULT_SUBJECT)


def object_label(predicate: Column) -> Column:
    return _lookup(OBJECT_LABELS, predicate, FALLBACK_LABEL)


def identity_property(label: Column) -> Column:
    return F.when(label.isin(*VALUE_KEYED), "value").otherwise("name")


def metadata_map(c: Column) -> Column:
    """Never null; values as text."""
    return F.coalesce(F.transform_values(c, lambda k, v: v.cast("string")), F.create_map().cast("map<string,string>"))


def empty_to_null(m: Column) -> Column:
    return F.when(F.size(m) > 0, m)


def to_number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), F.btrim(c).try_cast("double"))


def or_default(c: Column, default: str) -> Column:
    """Null and empty text count as absent."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "_")


def contains_fold(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def candidate_names(question: Column) -> Column:
    found = F.transform(F.regexp_extract_all(question, F.lit(CANDIDATE), F.lit(0)), strip)
    return F.filter(found, lambda x: F.length(x) > 2)


def asks_for_targets(question: Column) -> Column:
    return F.lower(question).rlike("|".join(TARGET_WORDS))


def is_quota_error(message: Column) -> Column:
    return F.lower(message).rlike("|".join(QUOTA_WORDS))


def extra_properties(props: Column, hidden: Sequence[str]) -> Column:
    return F.map_filter(props, lambda k, v: ~k.isin(*hidden) & v.isNotNull())


def merged(old: Column, new: Column) -> Column:
    """old with the entries of new set over it; an entry that is null in new is taken out."""
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_filter(F.map_concat(kept, new), lambda k, v: v.isNotNull())


def entries_text(props: Column) -> Column:
    """Map entries in key order as one text, for output and comparison."""
    pairs = F.array_sort(F.transform(F.map_entries(props), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    return F.array_join(pairs, ";")
