"""Quantities in common units."""

import pytest

from carbonweave.operators.units import to_common_units

FACTORS = [("kg", "mass", "kg", 1.0, 0.0), ("t", "mass", "kg", 1000.0, 0.0), ("g", "mass", "kg", 0.001, 0.0), ("tCO2e", "emissions", "kgCO2e", 1000.0, 0.0), ("kWh", "energy", "kWh", 1.0, 0.0), ("MWh", "energy", "kWh", 1000.0, 0.0), ("m", "distance", "km", 0.001, 0.0), ("m2", "area", "m2", 1.0, 0.0), ("degF", "temperature", "degC", 5 / 9, -160 / 9), ("gal", "volume", "L", 3.785411784, 0.0), ("furlong", "distance", "km", 0.201168, 0.0)]
CASES = [
    ("8,224.1", "KG", 8224),
    ("2'078 kg", None, 2078),
    ("43 182 US gal", None, 163462),
    ("88,5", "kg", 89),
    ("1.234,5 kg", None, 1235),
    ("1,234,567 kg", None, 1234567),
    ("1.234.567 kg", None, 1234567),
    ("548,800", "kg", 548800),
    ("1.5E3 kg", None, 1500),
    ("2.615e2T CO2e", None, 261500),
    ("13.6k kilograms", None, 13600),
    ("0.4m", "kg", 400000),
    ("0.4m", None, None),
    ("2 000 m", None, 2),
    ("0.5mn kWh", None, 500000),
    ("3 thousand kWh", None, 3000),
    ("2.5", "'000 kWh", 2500),
    ("2.5", "[million kWh]", 2500000),
    ("KWH 493.6", "", 494),
    ("t: 4", "kg", 4000),
    ("5 t", "kg", 5000),
    ("2019 total: 27.2", "MWh", 27200),
    ("Scope 1 (location-based): 9", "tCO2e", 9000),
    ("711.4 across 12 sites", "g", 1),
    ("81.3 in 2024", "kg", 81),
    ("−40", "degF", -40),
    ("minus 40 deg F", None, -40),
    ("12 furlong", None, 2),
    ("14 to 29 MWh", None, None),
    ("between 3 and 44 tonnes", None, None),
    ("41-81 kg per week", None, None),
    ("21.65 kWh/m2", None, None),
    ("12 kg CO2e per meal", None, None),
    ("5 m2-equivalents per 33 stores", None, None),
    ("6%", "kg", None),
    ("AUD 498", None, None),
    ("72", "n/a", None),
    ("no number", "kg", None),
    (None, "kg", None),
    ("", "kg", None),
    ("7", None, None),
]


@pytest.fixture(scope="module")
def factors(spark):
    return spark.createDataFrame(FACTORS, "unit string, quantity_kind string, common_unit string, factor double, offset_value double")


def test_styles(spark, factors):
    rows = spark.createDataFrame([(k, v, u) for k, (v, u, _) in enumerate(CASES)], "triple_id bigint, object_value string, unit string")
    got = {r.triple_id: r.common_value for r in to_common_units(rows, factors).collect()}
    assert {CASES[k][:2]: got.get(k) for k in range(len(CASES))} == {c[:2]: c[2] for c in CASES}


def test_repeats_clashing_columns_long_text_and_source_default(spark, factors):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "5 kg", None, "x", "a"), (2, "5 kg", None, "x", "a"), (3, "word " * 20000 + "7 kg", None, "y", "b"), (4, "9", None, "z", "s")], "triple_id bigint, object_value string, unit string, cw_id string, source string")
    plain = {r.triple_id: r.common_value for r in to_common_units(rows, factors).collect()}
    assert plain == {1: 5, 2: 5, 3: 7}
    default = to_common_units(rows, factors, source_default=F.when(F.col("source") == "s", "t"))
    assert {r.triple_id: r.common_value for r in default.collect()}[4] == 9000


def test_empty_tables(spark, factors):
    rows = spark.createDataFrame([], "triple_id bigint, object_value string, unit string")
    assert to_common_units(rows, factors).count() == 0
    some = spark.createDataFrame([(1, "5 kg", None)], "triple_id bigint, object_value string, unit string")
    assert to_common_units(some, factors.where("false")).count() == 0


def test_plan_is_one_scan_without_python(spark, factors, tmp_path):
    rows = spark.createDataFrame([(1, "5 kg", None)], "triple_id bigint, object_value string, unit string")
    rows.write.parquet(str(tmp_path / "r"))
    plan = to_common_units(spark.read.parquet(str(tmp_path / "r")), factors)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
