"""Quantities recorded in different units, brought to the common unit of their kind.

Pure SQL expressions: number and unit are cut out with regexp_extract, the unit's spelling is
normalised by a join with an alias table, the text's unit overrules the unit column, which overrules
a source default, and factor and offset are applied. A text is searched once for a number with its unit
(and once more for a unit ahead of a number if there is none); the parts are then taken from what was
found. The spellings of all units are one prefix tree in the pattern, so their number hardly matters.
One narrow scan, no shuffle: the alias table is a constant of a few hundred rows at most and is the only
thing broadcast.

Defined results
- null or empty text, no number, no unit, unknown unit: no row.
- ranges ("14 to 29 MWh", "between 3 and 44 t"), rates ("kWh/m2", "t per week"), percentages and
  money: no row.
- text with several numbers and no unit of its own: years, scopes and site counts are set aside; if
  more than one number is left the row is no single quantity and gives no row.
- repeated rows: each keeps its own id and comes out once.
- an input column that clashes with a working name is never read: only the named columns are.
- very long texts are matched whole; rows come out of an empty table as an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carbonweave.session import small

#: Spellings of each unit symbol, in lower case, superscripts as digits.
ALIASES = {
    "kgCO2e": ["kgco2e", "kg co2e", "kg co2-e", "kgco2-e", "kg of co2 equivalent", "kg co2 equivalent", "kilograms co2e", "kilogram co2e", "kilograms of co2e"],
    "gCO2e": ["gco2e", "g co2e", "g co2-e", "grams co2e", "gram co2e", "grams of co2e"],
    "tCO2e": ["tco2e", "t co2e", "t co2-e", "tco2-e", "mtco2e", "mt co2e", "metric tons co2e", "metric tonnes co2e", "tons co2e", "tonnes co2e", "tonne co2e", "tonnes of co2e", "tonnes of co2 equivalent", "tonnes co2 equivalent"],
    "ktCO2e": ["ktco2e", "kt co2e", "kt co2-e", "kilotonnes co2e", "kilotonnes of co2e", "kilotons co2e"],
    "lbCO2e": ["lbco2e", "lb co2e", "lbs co2e", "pounds co2e", "pounds of co2e"],
    "kg": ["kg", "kg.", "kgs", "kgs.", "kilo", "kilos", "kilogram", "kilograms", "kilogramme", "kilogrammes"],
    "g": ["g", "g.", "gm", "gms", "gram", "grams", "gramme", "grammes"],
    "t": ["t", "mt", "tonne", "tonnes", "metric ton", "metric tons", "metric tonne", "metric tonnes"],
    "lb": ["lb", "lb.", "lbs", "lbs.", "pound", "pounds"],
    "oz": ["oz", "oz.", "ounce", "ounces"],
    "short_ton": ["short_ton", "short ton", "short tons", "us ton", "us tons", "ton (us)", "tons (us)"],
    "kWh": ["kwh", "kw h", "kw-h", "kilowatt hour", "kilowatt hours", "kilowatt-hour", "kilowatt-hours"],
    "MWh": ["mwh", "mw h", "mw-h", "megawatt hour", "megawatt hours", "megawatt-hour", "megawatt-hours"],
    "GWh": ["gwh", "gw h", "gw-h", "gigawatt hour", "gigawatt hours", "gigawatt-hour", "gigawatt-hours"],
    "MJ": ["mj", "megajoule", "megajoules"],
    "GJ": ["gj", "gigajoule", "gigajoules"],
    "therm": ["therm", "therms", "thm"],
    "L": ["l", "ltr", "ltrs", "litre", "litres", "liter", "liters"],
    "kL": ["kl", "kilolitre", "kilolitres", "kiloliter", "kiloliters"],
    "ML": ["ml", "megalitre", "megalitres", "megaliter", "megaliters"],
    "m3": ["m3", "cbm", "cu m", "cu. m", "cubic metre", "cubic metres", "cubic meter", "cubic meters"],
    "gal": ["gal", "gal.", "gals", "gallon", "gallons", "us gal", "us gals", "us gallon", "us gallons"],
    "m2": ["m2", "sqm", "sq m", "sq. m", "square metre", "square metres", "square meter", "square meters"],
    "ft2": ["ft2", "sqft", "sq ft", "sq. ft", "square foot", "square feet"],
    "ha": ["ha", "hectare", "hectares"],
    "acre": ["acre", "acres", "ac"],
    "km": ["km", "kms", "kilometre", "kilometres", "kilometer", "kilometers"],
    "mi": ["mi", "mi.", "mile", "miles"],
    "m": ["m", "metre", "metres", "meter", "meters"],
    "degC": ["degc", "deg c", "°c", "degree celsius", "degrees celsius"],
    "degF": ["degf", "deg f", "°f", "degree fahrenheit", "degrees fahrenheit"],
}

#: Words and signs for thousands and millions.
SCALES = {"k": 1e3, "thousand": 1e3, "thousands": 1e3, "000": 1e3, "'000": 1e3, "000s": 1e3, "'000s": 1e3, "m": 1e6, "mn": 1e6, "mio": 1e6, "mln": 1e6, "million": 1e6, "millions": 1e6}

MOST_UNITS = 10_000

_NUMBER = r"\d+(?:[ '.,]\d{3}(?!\d))*(?:[.,]\d+)?(?:e[+-]?\d+(?!\d))?"
_SIGN = r"(?:(?<![a-z])minus |(?<![\w.,)])-)?"
_WORDS = r"'?000s?|thousands?|millions?|mio|mln|mn"
_TIGHT = r"(?<=\d)(?:k|mn|m)(?![a-z0-9/])"
_SCALE = rf"(?:{_TIGHT}|\s+(?:{_WORDS})(?![a-z0-9]))"
_NOT_A_QUANTITY = r"\b(?:fy|scopes?|iso|in|across|of|per|by|since|page|p\.|year|no\.)[ -]?\d[\d.,]*(?! ?%)|\b(?:19|20)\d\d (?:total|figure|value)\b"


def _alternatives(words: set[str]) -> str:
    """All words as one prefix tree, longest first. A bare m straight after the digits is the sign for million, not the metre."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w

    def pattern(node: dict) -> str:
        ways = [re.sub(r"([^\w °])", r"\\\1", c) + pattern(child) for c, child in sorted(node.items()) if c]
        if "" in node and (ways or node[""] == "m"):
            ways.append("(?<![0-9]m)" if node[""] == "m" else "")
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""

    return pattern(tree)


#: Blanks, quotes, minus signs and raised or lowered digits, each folded to the plain sign.
_FOLD = {" ": " ", " ": " ", " ": " ", " ": " ", "\t": " ", "\n": " ", "\r": " ", "’": "'", "‘": "'", "′": "'", "`": "'", "−": "-", "–": "-", "—": "-", "‒": "-", "₂": "2", "²": "2", "³": "3"}


def fold_text(c: Column) -> Column:
    """Lower case, one kind of blank, quote and minus, superscripts as digits."""
    c = F.translate(c, "".join(_FOLD), "".join(_FOLD.values()))
    return F.btrim(F.regexp_replace(F.lower(c), r" {2,}", " "))


def number_value(raw: Column) -> Column:
    """A number token in any of the usual styles as double; null where it is none.

    A lone comma before exactly three digits groups thousands, a lone point is a decimal mark, of two
    kinds of mark the last is the decimal one, repeated marks of one kind group thousands.
    """
    s = F.regexp_replace(raw, r"[ ']|(?<!\.\d{3}),(?=\d{3}(?:[,.e]|$))", "")
    s = F.regexp_replace(s, r"\.(?=\d{3}[.,]\d)|(?<=\.\d{3})\.(?=\d{3}(?:\D|$))", "")
    return F.translate(s, ",", ".").try_cast("double")


def scale_value(raw: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in {"": 1.0, **SCALES}.items() for x in kv])
    return F.try_element_at(known, F.btrim(F.coalesce(raw, F.lit(""))))


def alias_table(factors: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """alias -> common unit, factor, offset: the fixed spellings, and each listed symbol as it stands."""
    spark = factors.sparkSession
    fixed = spark.createDataFrame([(a, u) for u, v in aliases.items() for a in v], "cw_alias string, cw_unit string")
    listed = factors.select(fold_text(F.col("unit")).alias("cw_alias"), F.col("unit").alias("cw_unit"))
    f = factors.select(F.col("unit").alias("cw_unit"), F.col("quantity_kind").alias("cw_kind"), F.col("common_unit").alias("cw_common"), F.col("factor").cast("double").alias("cw_factor"), F.coalesce(F.col("offset_value").cast("double"), F.lit(0.0)).alias("cw_offset"))
    own = listed.join(fixed.select("cw_alias"), "cw_alias", "left_anti")
    return fixed.unionByName(own).dropDuplicates(["cw_alias"]).join(small(f), "cw_unit")


def to_common_units(rows: DataFrame, factors: DataFrame, id_col: str = "triple_id", text_col: str = "object_value", unit_col: str = "unit", source_default: Column | None = None, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """One row per input row that states a single absolute quantity: id, quantity_kind, common_unit, exact_value, common_value.

    `factors` holds unit, quantity_kind, common_unit, factor, offset_value. `source_default` is an
    expression over `rows` for the unit of sources that never write one.
    """
    listed = [r[0] for r in factors.select(fold_text(F.col("unit"))).where("unit is not null").limit(MOST_UNITS + 1).collect()]
    if len(listed) > MOST_UNITS:
        raise ValueError(f"a table of units has at most {MOST_UNITS} rows")
    units = _alternatives({a for v in aliases.values() for a in v} | set(listed))
    tail = r"(?![a-z0-9_])"
    # Found from the start of the text to the end of the match; what was matched stands at its end.
    attached = rf"({_SIGN})({_NUMBER})({_SCALE})?\s*[\[(]?({units})"
    leading = rf"({units}){tail}\s*[:=]?\s*({_SIGN})({_NUMBER})({_SCALE})?"
    to_attached, to_leading = rf"^.*?{attached}{tail}", rf"^.*?(?<![a-z0-9/.]){leading}(?![a-z0-9/%])"
    column = rf"^[\[(]*\s*({_WORDS}|k|m)?\s*({units})\s*[\])]*$"
    single = rf"^([^0-9]*?)({_SIGN})({_NUMBER})({_SCALE})?(?![0-9])([^0-9]*)$"
    money = r"[$€£%]|\b(?:percent|per|usd|eur|aud|gbp|hours?)\b"
    part = lambda c, pattern, k: F.regexp_extract(c, pattern, k)

    def held(df: DataFrame, **columns: Column) -> DataFrame:
        """Adds columns behind a Generate node, which keeps the optimizer from copying a match into every later expression."""
        kept = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("cw_held")
        return df.select("*", kept).select(*df.columns, "cw_held.*")

    base = rows.select(
        F.col(id_col).alias("cw_id"),
        fold_text(F.col(text_col)).alias("cw_t"),
        F.coalesce(F.nullif(fold_text(F.col(unit_col)), F.lit("")), fold_text(source_default) if source_default is not None else F.lit(None).cast("string")).alias("cw_u"),
    ).where(F.col("cw_t").rlike(r"\d"))
    t, u, found_a, found_b, bare, m = (F.col(c) for c in ("cw_t", "cw_u", "cw_a", "cw_b", "cw_bare", "cw_m"))
    none = F.lit("")
    step = held(base, cw_a=part(t, to_attached, 0))
    # Without a unit in the text: the numbers that remain once years, scopes and counts of sites are set aside.
    step = held(step, cw_b=F.when(found_a == "", part(t, to_leading, 0)).otherwise(none), cw_c=F.when((found_a == "") & u.isNotNull(), part(u, column, 2)).otherwise(none))
    bared = F.when((found_a == "") & (found_b == "") & (F.col("cw_c") != ""), F.regexp_replace(t, _NOT_A_QUANTITY, " "))
    step = held(step, cw_bare=bared).where((found_a != "") | (found_b != "") | (bare.rlike(single) & ~bare.rlike(money)))
    step = held(step, cw_m=F.when(found_a != "", part(found_a, attached + "$", 0)).when(found_b != "", part(found_b, r"(?<![a-z0-9/.])" + leading + "$", 0)).otherwise(bare))
    pick = lambda a, b, c: F.when(found_a != "", part(m, f"^{attached}$", a)).when(found_b != "", part(m, f"^{leading}$", b)).otherwise(part(m, single, c))
    ended = F.when(found_a != "", found_a).otherwise(found_b)
    in_text = (found_a != "") | (found_b != "")
    cut = held(
        step,
        cw_before=F.when(in_text, F.left(ended, F.length(ended) - F.length(m))).otherwise(part(bare, single, 1)),
        cw_after=F.when(in_text, F.substr(t, F.length(ended) + 1)).otherwise(none),
        cw_sign=pick(1, 2, 2),
        cw_number=pick(2, 3, 3),
        cw_scale=pick(3, 4, 4),
        cw_alias=F.when(found_a != "", part(m, f"^{attached}$", 4)).when(found_b != "", part(m, f"^{leading}$", 1)).otherwise(F.col("cw_c")),
        cw_column_scale=F.when(in_text, none).otherwise(part(u, column, 1)),
    )
    before, after = F.col("cw_before"), F.col("cw_after")
    is_range = before.rlike(r"\d\s*[a-z.]*\s*(?:-|to|and|or|up to)\s*$|\bbetween\s*$|[$€£]\s*$|\b(?:aud|usd|eur)\s*$")
    goes_on = after.rlike(r"^\s*(?:/|-|\^|[a-z]*\s*\bper\b)|\bper\b|^\s*(?:to|and|-)\s*\d|^[^a-z0-9]*(?:/|÷)\s*[a-z]")
    sign = F.when(F.col("cw_sign") != "", -1.0).otherwise(1.0)
    value = sign * number_value(F.col("cw_number")) * scale_value(F.col("cw_scale")) * scale_value(F.col("cw_column_scale"))
    found = cut.where(~is_range & ~goes_on).select("cw_id", "cw_alias", value.alias("cw_value")).where("cw_value is not null")
    exact = F.col("cw_value") * F.col("cw_factor") + F.col("cw_offset")
    return found.join(small(alias_table(factors, aliases)), "cw_alias").select(
        F.col("cw_id").alias(id_col),
        F.col("cw_kind").alias("quantity_kind"),
        F.col("cw_common").alias("common_unit"),
        exact.alias("exact_value"),
        F.round(exact).cast("bigint").alias("common_value"),
    )
