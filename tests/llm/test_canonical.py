"""Typed values mapped to a canonical list."""

import pytest

from carbonweave.llm import canonical
from carbonweave.llm.canonical import Matcher, map_to_canonical, tokens

LIST = [(1, "REPORTS_METRIC"), (2, "REPORTS_EMISSION"), (3, "HAS_SUPPLIER"), (4, "SUPPLIES_TO"), (5, "COMMITTED_TO"), (6, "COMMITS_TO_NET_ZERO"), (7, "SETS_TARGET"), (8, "LED_BY"), (9, "REPORTS_WATER_WITHDRAWAL"), (10, "OPERATES_IN")]
CASES = {"reports metric": 1, " Reports-Metric! ": 1, "reportsMetric": 1, "reportsmetric": 1, "REPORTS_METRC": 1, "METRIC_REPORTED": 1, "rpts emission": 2, "EMISSOIN_REPORTS": 2, "hasSupplier": 3, "HAVING_SUPPLIERS": 3, "supp has": 3, "supplying to": 4, "SUPPLIES_TOO": 4, "comittted to": 5, "commitstonetzero": 6, "tgt sets": 7, "ledd by": 8, "repo wter withdrawal": 9, "OPER_IN": 10, "photo credit": 0, "mascot": 0, "x": 0, "???": 0, "": 0, "fig. 12": 0, "see footnote": 0}


def test_cases():
    m = Matcher(LIST)
    assert {v: m.resolve(" ".join(tokens(v))) for v in CASES} == CASES


def test_longest_mention_wins():
    m = Matcher([(1, "net zero"), (2, "net zero target"), (3, "target")])
    assert m.resolve("our net zero target for all") == 2
    assert m.resolve("a target and a net zero aim") == 1
    assert Matcher([(4, "led by"), (2, "led by")]).resolve("led by") == 2


@pytest.mark.parametrize("fits", [True, False])
def test_rows(spark, monkeypatch, fits):
    monkeypatch.setattr(canonical, "is_small", lambda df: fits)
    values = [*CASES, None, "REPORTS_METRIC", "word " * 20_000, "photo credit"]
    rows = spark.createDataFrame([(k, v, "clash") for k, v in enumerate(values)], "triple_id bigint, predicate string, cw_value string")
    catalog = spark.createDataFrame(LIST, "predicate_id bigint, predicate string")
    got = {r.triple_id: r.predicate_id for r in map_to_canonical(rows, "triple_id", "predicate", catalog, "predicate_id", "predicate").collect()}
    want = {k: CASES.get(v, 0) for k, v in enumerate(values) if v is not None and v != "REPORTS_METRIC"}
    assert got == want
    none = map_to_canonical(rows, "triple_id", "predicate", catalog.where("false"), "predicate_id", "predicate").collect()
    assert {r.predicate_id for r in none} == {0}
    assert map_to_canonical(rows.where("false"), "triple_id", "predicate", catalog, "predicate_id", "predicate").count() == 0


def test_long_values_are_read_whole():
    m = Matcher([(1, "HAS_SUPPLIER"), (2, "COMMITS_TO_NET_ZERO"), (3, "OPERATES_IN")])
    filler = "lorem ipsum dolor amet quux zyx blorb".split()
    for n in (13, 60, 3000):
        words = [filler[k % 7] for k in range(n)]
        for at in (0, n // 2, n):
            assert m.resolve(" ".join([*words[:at], "has", "suplier", *words[at:]])) == 1
            assert m.resolve(" ".join([*words[:at], "having", "suppliers", *words[at:]])) == 1
        assert m.resolve(" ".join(words)) == 0


def test_run_together_values_of_any_length():
    entries = [(1, "COMMITS_TO_NET_ZERO"), (2, "DISTRIBUTES_REFRIGERATED_MERCHANDISE_THROUGH_INTERMEDIARIES"), (3, "HAS_SUPPLIER")]
    m = Matcher(entries)
    assert m.resolve("comittsnetzero") == 1 and m.resolve("commitstonetzeros") == 1
    assert m.resolve("distributsrefrigeratedmerchandisethroughintermediaris") == 2
    assert m.resolve("suplierhas") == 3 and m.resolve("x" * 5000) == 0


def test_forms_of_words_are_one_pattern():
    m = Matcher([(7, "HOLDS_SITES_LED_BY"), (8, "HOLDS_SITES")], {"owned plants": 8})
    assert m.resolve("we held sites led by others") == 7 and m.resolve("holding site now") == 8
    assert m.resolve("owned plants") == 8 and m.mention(["owned", "plant"]) == 0
