"""Registered queries of the general data operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from carbonweave.operators.units import _FOLD as FOLDED
from carbonweave.operators.units import ALIASES, to_common_units
from carbonweave.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "collin_foods_2024_triples")
    return to_common_units(rows, table(spark, d, "unit_factors")).select("triple_id", "common_unit", "common_value")


def _p1_sql() -> str:
    """The same rules without look-around: signs for thousands and millions are marked first, tokens valued by cases."""
    words = sorted({w for v in ALIASES.values() for w in v}, key=lambda w: (-len(w), w))
    units = "|".join(re.sub(r"([^\w °])", r"\\\1", w) for w in words)
    names = ", ".join(f"('{w}', '{u}')" for u, v in ALIASES.items() for w in v)
    plain = "".join(FOLDED.values()).replace("'", "''")
    fold = lambda c: f"trim(regexp_replace(lower(translate({c}, '{''.join(FOLDED)}', '{plain}')), ' +', ' ', 'g'))"
    join = lambda c: f"regexp_replace({c}, '([0-9])[ '']([0-9]{{3}})($|[^0-9])', '\\1\\2\\3', 'g')"
    mark = lambda c: f"regexp_replace(regexp_replace(regexp_replace({c}, '([0-9])(k|mn|m)($|[^a-z0-9/])', '\\1 \\2#\\3', 'g'), '([0-9])(?: *thousands?| +''?000s?)($|[^a-z0-9])', '\\1 k#\\2', 'g'), '([0-9]) *(?:millions?|mio|mln|mn)($|[^a-z0-9#])', '\\1 m#\\2', 'g')"
    num = r"[0-9]+(?:[.,][0-9]+)*(?:e[+-]?[0-9]+)?"
    context = r"\b(?:fy|scopes?|iso|in|across|of|per|by|since|page|p\.|year|no\.)[ -]?[0-9][0-9.,]*|\b(?:19|20)[0-9][0-9] (?:total|figure|value)\b"
    return rf"""with alias(word, sym) as (values {names}),
f as (select triple_id, {fold("object_value")} t0, nullif({fold("unit")}, '') u from collin_foods_2024_triples),
g as (select triple_id, u, {mark(join(join(join("t0"))))} t from f where regexp_matches(t0, '[0-9]')),
m as (select triple_id, t, u,
  regexp_extract(t, '^(.*?)(minus |-)?({num})( [km]n?#)? *[\[(]?({units})($|[^a-z0-9_#].*)$', ['before', 'sign', 'num', 'scale', 'word', 'after']) a,
  regexp_extract(t, '^(|.*?[^a-z0-9/.])({units}) *[:=]? *(minus |-)?({num})( [km]n?#)?($|[^a-z0-9/%].*)$', ['before', 'word', 'sign', 'num', 'scale', 'after']) b,
  regexp_extract(u, '^[\[(]* *(thousands?|millions?|''?000s?|mio|mln|mn|k|m)? *({units}) *[\])]*$', ['scale', 'word']) c,
  regexp_replace(t, '{context}', ' ', 'g') bare from g),
n as (select *, regexp_extract(bare, '^([^0-9]*?)(minus |-)?({num})( [km]n?#)?([^0-9]*)$', ['before', 'sign', 'num', 'scale', 'after']) d from m),
r as (select triple_id,
  case when a.word <> '' then a.before || case when a.sign = '-' and regexp_matches(a.before, '[a-z0-9_.,)]$') then '-' else '' end when b.word <> '' then b.before else '' end before,
  case when a.word <> '' then a.after when b.word <> '' then b.after else '' end after,
  case when a.word <> '' then case when a.sign = '-' and regexp_matches(a.before, '[a-z0-9_.,)]$') then '' else a.sign end when b.word <> '' then b.sign else d.sign end sign,
  case when a.word <> '' then a.num when b.word <> '' then b.num else d.num end num,
  case when a.word <> '' then a.scale when b.word <> '' then b.scale else d.scale end scale,
  case when a.word <> '' then a.word when b.word <> '' then b.word else c.word end word,
  case when a.word <> '' or b.word <> '' then '' else c.scale end uscale from n
  where a.word <> '' or b.word <> '' or (coalesce(c.word, '') <> '' and d.num <> '' and not regexp_matches(bare, '[$€£%]|\b(?:percent|per|usd|eur|aud|gbp|hours?)\b'))),
v as (select *, split_part(num, 'e', 1) mant, case when contains(num, 'e') then cast(split_part(num, 'e', 2) as integer) else 0 end ex from r
  where not regexp_matches(before, '[0-9] *[a-z.]* *(?:-|to|and|or|up to) *$|\bbetween *$|[$€£] *$|\b(?:aud|usd|eur) *$')
  and not regexp_matches(after, '^ *(?:/|-|\^|[a-z]* *\bper\b)|\bper\b|^ *(?:to|and|-) *[0-9]|^[^a-z0-9]*/ *[a-z]')),
w as (select *, length(mant) - length(replace(mant, ',', '')) nc, length(mant) - length(replace(mant, '.', '')) np from v),
x as (select *, cast(case when nc = 0 and np <= 1 then mant when nc = 0 then replace(mant, '.', '') when np = 0 and nc = 1 then case when regexp_matches(mant, '^[0-9]+,[0-9]{{3}}$') then replace(mant, ',', '') else replace(mant, ',', '.') end
  when np = 0 then replace(mant, ',', '') when strpos(reverse(mant), ',') < strpos(reverse(mant), '.') then replace(replace(mant, '.', ''), ',', '.') else replace(mant, ',', '') end || 'e' || ex as double) value from w)
select triple_id, common_unit, cast(round(value * case when sign <> '' then -1 else 1 end
  * case when contains(scale, 'k') then 1e3 when contains(scale, 'm') then 1e6 else 1 end
  * case when uscale = '' or uscale is null then 1 when regexp_matches(uscale, '^(?:k|thousand|''?000)') then 1e3 else 1e6 end * factor + offset_value) as bigint) as common_value
from x join alias using (word) join unit_factors on unit = sym"""


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {"p1_found": _p1_sql()}
