"""Name parts, linked spellings and matched entities on invented names."""

import itertools
import random

from carbonweave.llm import matching, variants
from carbonweave.llm.names import SHORT_FORMS, Vocabulary, parse_name

DESCRIPTORS = ["Meridian", "Granite", "Harbour", "Orchard", "Sunrise", "Copper", "Valley", "Pacific"]
TRADES = ["Dairy Products", "Cold Storage", "Manufacturing", "Logistics", "Foods"]
LEGAL = ["Inc.", "Ltd", "GmbH", "S.A."]


def organisations(n, seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        proper = "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(4)).title()
        out.append((proper, DESCRIPTORS[k % 8], TRADES[k % 5], LEGAL[k % 4]))
    return out


def spellings_of(org, rng):
    p, d, t, legal = org
    k = rng.randrange(1, 7)
    slip = p[:k] + p[k + 1] + p[k] + p[k + 2 :]
    return [f"{p} {d} {t} {legal}", f"{p} {d} {t}", f"{d} {p} {t}", f"The {p} {d} {t} {legal}", f"{t}, {p} {d} {legal}", f"{slip} {d} {t} {legal}"]


def rows_of(orgs):
    rng = random.Random(4)
    return [(s, k) for k, o in enumerate(orgs) for s in spellings_of(o, rng)]


def test_vocabulary_reads_short_and_wrong_forms():
    v = Vocabulary({"manufacturing": 50, "mfg": 9, "meridian": 60, "mrdn": 8, "harbour": 55, "dairy": 40, "products": 38}, {"meridian": 0.9, "harbour": 0.8, "dairy": 0.2})
    assert v.descriptors == {"meridian", "harbour"}
    assert v.read("mfg")[0][0] == "manufacturing" and v.read("mrdn")[0][0] == "meridian" and v.read("habrour")[0][0] == "harbour"
    assert parse_name("Mfg, Donogedu Mrdn Pty Ltd", v) == ("o", "donogedu", "meridian", "manufacturing", "ltd pty")
    assert parse_name("Dr. Bob Q. Fugogani", v) == ("p", "fugogani", "robert", "q", "")
    assert parse_name("Fugogani, Bob", v) == ("p", "fugogani", "robert", "", "")
    assert parse_name("Fugogani R.Q", v) == ("p", "fugogani", "r", "q", "")
    assert parse_name("Section 1.2", v) is None and parse_name("we", v) is None
    assert "william" in SHORT_FORMS.values()


def test_spellings_link(spark):
    orgs = organisations(60)
    rows = rows_of(orgs) + [("Table of contents", -1), (None, -1), ("", -1), ("12 t", -1)]
    people = [("Robert Fugogani", "p1"), ("Bob Fugogani", "p1"), ("Fugogani, Robert", "p1"), ("R. Fugogani", "p1"), ("Susan Fugogani", "p2"), ("Sue Fugogani", "p2")]
    people = people[:4] + [(n.replace("Fugogani", "Vedokura"), k) for n, k in people[4:]]
    df = spark.createDataFrame([(s, "x") for s, _ in rows for _ in range(2)], "subject string, key string")
    objects = spark.createDataFrame([(s,) for s, _ in people], "object_value string")
    key = lambda s: "".join(c for c in s.lower() if c.isalnum())
    entity = {key(s): k for s, k in rows + people if s and key(s)}
    want = {tuple(sorted((a, b))) for a, b in itertools.combinations(entity, 2) if entity[a] == entity[b] != -1}
    got = {tuple(r) for r in variants.link_spellings([(df, "subject", True), (objects, "object_value", False)]).collect()}
    assert got <= want
    assert len(got) >= 0.97 * len(want)


def test_same_name_of_two_trades_stays_apart(spark):
    orgs = organisations(60)
    twin = (orgs[0][0], orgs[0][1], "Logistics", "Ltd")
    names = [s for s, _ in rows_of(orgs)] + [f"{twin[0]} {twin[1]} {twin[2]} {twin[3]}", f"{twin[0]} {twin[1]}"]
    df = spark.createDataFrame([(s,) for s in names], "n string")
    key = lambda s: "".join(c for c in s.lower() if c.isalnum())
    got = {tuple(r) for r in variants.link_spellings([(df, "n", True)]).collect()}
    for s in names[-2:]:
        assert not [p for p in got if key(s) in p]


def key(s):
    return "".join(c for c in s.lower() if c.isalnum())


def linked(spark, names):
    df = spark.createDataFrame([(s,) for s in names], "n string")
    return {tuple(r) for r in variants.link_spellings([(df, "n", True)]).collect()}


def pair(a, b):
    return tuple(sorted((key(a), key(b))))


def test_names_of_other_shapes_link(spark):
    same = [["Siemens AG", "Siemens", "Siemens A.G."], ["Microsoft Corp.", "Microsoft Corporation", "Microsoft"], ["3M Company", "3M Co.", "3M"], ["Hans Mueller", "Mueller, Hans", "H. Mueller", "Mueller, H."], ["Bob Lee", "Robert Lee", "Lee, Robert"], ["Priya Raman", "Raman, Priya"]]
    alone = ["Total emissions", "Net zero", "Section 3", "Section 4", "we", "Table 3M", "Acme AG", "Acme Inc", "Acme", None, "", "x" * 3000, "long phrase of words " * 400, "Heike Mueller-Lüdenscheidt"]
    got = linked(spark, [n for group in same for n in group] + alone)
    want = {pair(a, b) for group in same for a, b in itertools.combinations({key(n): n for n in group}.values(), 2)}
    assert got == want


def test_given_names_are_learned(spark):
    surnames = ["Okonkwo", "Lindqvist", "Tanaka", "Moreau"]
    names = [f"{s}, Ngozi" for s in surnames] + ["Ngozi Halvorsen", "Nogzi Halvorsen", "Ngozi B. Petrov", "Ngozi Petrov", "Dairy Halvorsen"]
    df = spark.createDataFrame([(key(s), s) for s in names], "key string, text string")
    assert variants.learn_given(df) == {"ngozi"}
    assert linked(spark, names) == {pair("Ngozi Halvorsen", "Nogzi Halvorsen"), pair("Ngozi B. Petrov", "Ngozi Petrov")}


def test_long_names_and_short_proper_words(spark):
    orgs = organisations(60)
    names = [s for s, _ in rows_of(orgs)]
    names += ["Bako Granite Logistics Ltd", "Logistics, Bako Granite Ltd", "The " + "Zuvolera Harbour Dairy Products Manufacturing Cold Storage Logistics Foods Inc. Ltd. Company", "Zuvolera Harbour Dairy Products Manufacturing Cold Storage Logistics Foods"]
    got = linked(spark, names)
    assert pair(*names[-4:-2]) in got and pair(*names[-2:]) in got


def test_classes_count_links(spark):
    df = spark.createDataFrame([("Siemens AG",), ("Siemens",), ("Siemens A.G",), ("Acme Ltd",)], "n string")
    rows = {tuple(r) for r in variants.class_members([(df, "n", True)]).collect()}
    assert rows == {("siemens", "siemens", 1), ("siemensag", "siemens", 1)}


def test_registry_chains_are_one_organisation(spark):
    rows = [(1, "a", "bakolidu", 10.0), (2, "b", "bakolidumu", 10.0), (3, "c", "bakolidumuro", 10.0), (4, "d", "zzzzzzzzz", 10.0)]
    registry = spark.createDataFrame([(i, k, s, "r") for i, k, _, s in rows], "id bigint, name_key string, spend double, region_key string")
    parts = spark.createDataFrame([(k, p, "granite", "foods") for _, k, p, _ in rows], "key string, proper string, second string, third string")
    orgs = {r.id: r.org for r in matching.registry_orgs(registry, parts).collect()}
    assert orgs[1] == orgs[2] == orgs[3] != orgs[4]


def test_confidence_is_calibrated():
    rng = random.Random(3)
    truth = {1: 1.0, 2: 0.98, 3: 0.9, 4: 0.8, 5: 0.6}
    same, chance = 0.94, 0.07
    told = {r: (3000, sum(rng.random() < (same if rng.random() < p else chance) for _ in range(3000))) for r, p in truth.items()}
    got = matching._confidences(told, chance)
    assert all(abs(got[r] - p) < 0.05 for r, p in truth.items())
    assert list(got.values()) == sorted(got.values(), reverse=True)
    assert matching._confidences({1: (0, 0), 2: (10, 10), 3: (10, 5), 4: (10, 8)}, 0.0)[3] == matching._confidences({1: (0, 0), 2: (10, 10), 3: (10, 5), 4: (10, 8)}, 0.0)[4]
    assert matching._confidences({}, 0.0) == {}


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "n string")
    assert variants.link_spellings([(df, "n", True)]).count() == 0


def test_entities_match(spark):
    orgs = organisations(80)
    rng = random.Random(9)
    regions, categories = ["Europe", "Asia Pacific", "Middle East"], ["Energy", "Packaging"]
    erp, triples, want = [], [], set()
    key = lambda s: "".join(c for c in s.lower() if c.isalnum())
    for k, o in enumerate(orgs):
        forms = spellings_of(o, rng)
        region, category, spend = regions[k % 3], categories[k % 2], 1e6 * (k + 1)
        if k % 2 == 0:
            erp += [(k, forms[0], spend, category, region), (1000 + k, forms[1], spend * 1.01, category, region)]
        for s in forms[1:]:
            triples += [(s, "OPERATES_IN", {"Europe": "Germany", "Asia Pacific": "APAC", "Middle East": "Qatar"}[region]), (s, "belongs to category", category), (s, "REPORTS_PURCHASE", f"USD {spend * 0.98:,.0f}")]
            if k % 2 == 0:
                want |= {(k, key(s)), (1000 + k, key(s))}
    triples += [(None, "OPERATES_IN", "Germany"), ("we", None, "x"), ("Section 1", "OPERATES_IN", None)] + [("Hot Subject Inc", "OPERATES_IN", "Germany")] * 500
    e = spark.createDataFrame(erp + [(5000, None, None, None, None)], "erp_id bigint, supplier_name string, annual_spend_usd double, spend_category string, region string")
    t = spark.createDataFrame(triples, "subject string, predicate string, object_value string")
    columns = {"id": "erp_id", "name": "supplier_name", "region": "region", "category": "spend_category", "spend": "annual_spend_usd", "subject": "subject", "predicate": "predicate", "value": "object_value"}
    out = matching.match_entities(e, t, columns).collect()
    got = {(r.erp_id, r.subject_key) for r in out}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert all(0 < r.confidence < 1 for r in out)
    assert matching.match_entities(e.where("false"), t, columns).count() == 0


def test_money(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("$0.8 million annual spend",), ("USD 579,746",), ("2.66m USD purchased",), ("12 trees",)], "v string")
    assert [r[0] for r in df.select(matching.money(F.col("v"))).collect()] == [800000.0, 579746.0, 2660000.0, None]
