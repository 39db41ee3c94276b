"""Resolution at sizes and in shapes that took too long."""

import random
import time

import pytest
from pyspark.sql import functions as F

from carbonweave.functions.text import BLANKS, strip
from carbonweave.operators import nearby, resolve
from carbonweave.operators.graph import Graph


def like_names(rng, n):
    ends = ["Foods Ltd.", "Copper", "Ridge Poultry Processors", "Group, Inc.", "Orchard S.A.", "Meadow Technologies"]
    return sorted({"".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)).title() + " " + rng.choice(ends) for _ in range(n)})


def test_low_threshold_over_many_names(spark):
    """All pairs of 3,000 names at 70; name by name this took minutes."""
    names = like_names(random.Random(1), 3000)
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(4)
    began = time.time()
    got = {(r.canonical, r.duplicate): r.score for r in resolve.duplicate_pairs(df, "name", 70.0).collect()}
    assert time.time() - began < 60
    some = random.Random(2).sample(names, 12)
    for x in some:
        want = {y for y in names if y != x and resolve.similarity(x, y) >= 70}
        assert want == {b if a == x else a for a, b in got if x in (a, b)}
    assert all(got[p] == resolve.similarity(*p) for p in random.Random(3).sample(sorted(got), 200))


@pytest.mark.parametrize("threshold", [55.0, 70.0, 85.0, 100.0])
def test_pairs_of_any_length(threshold):
    """Letters of any plane and texts of none to several words of bits, within one list and across two."""
    rng = random.Random(4)
    of = lambda n: "".join(rng.choice("ab é\U0001f600KlmnoP") for _ in range(n))
    texts = [of(rng.choice([0, 1, 5, 12, 63, 64, 65, 129, 256, 257, 300])) for _ in range(80)]
    texts = sorted({*texts, *(t[: len(t) // 2] + "x" + t[len(t) // 2 + rng.randrange(3) :] for t in texts)})
    like = lambda a, b: 200.0 * nearby.common_subsequence(a, b) / (len(a) + len(b))
    want = {(a, b): like(a, b) for k, a in enumerate(texts) for b in texts[k + 1 :] if like(a, b) >= threshold}
    found = lambda x, y: [(min(a, b), max(a, b), s) for p, q, ss in nearby.near_pairs(x, y, threshold) for a, b, s in zip(p, q, ss)]
    got = found(texts, None)
    assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want
    one = set(texts[::2])
    assert {(a, b): s for a, b, s in found(texts[::2], texts[1::2])} == {p: s for p, s in want.items() if (p[0] in one) != (p[1] in one)}


def test_groups_of_lengths():
    assert resolve._groups({3: 4, 5: 5, 6: 30, 9: 1, 1000: 2}, 10) == [(3, 5, 1), (6, 6, 3), (9, 1000, 1)]
    assert resolve._groups({}, 10) == []


@pytest.mark.parametrize("few", [0, 50, 10_000])
def test_long_chains_are_connected_in_few_rounds(spark, monkeypatch, few):
    """A chain of 300 names, a star and a pair; one step a round needed 300 rounds."""
    rng = random.Random(5)
    order = rng.sample(range(1000, 1300), 300)
    links = [(f"n{a}", f"n{b}") for a, b in zip(order, order[1:])] + [("hub", f"s{k}") for k in range(20)] + [("x", "yy")]
    cuts = []

    def cut(df, real=resolve.cut):
        cuts.append(1)
        assert len(cuts) < 40
        return real(df)

    monkeypatch.setattr(resolve, "cut", cut)
    monkeypatch.setattr(resolve, "_FEW_LINKS", few, raising=False)
    pairs = spark.createDataFrame(links, "canonical string, duplicate string")
    got = {r.name: r.canonical for r in resolve.components(pairs).collect()}
    want = {f"n{k}": "n1000" for k in order} | {f"s{k}": "hub" for k in range(20)} | {"hub": "hub", "x": "yy", "yy": "yy"}
    assert got == want
    assert resolve.components(pairs.limit(0)).count() == 0


def test_summary_reads_the_edges_once(spark, tmp_path):
    rows = [("Company:d", "T", "Company:c"), ("Company:c", "T", "Company:d"), ("Company:x", "T", "Company:d"), ("Company:d", "T", "Company:d"), ("Company:x", "T", "Company:y")]
    spark.createDataFrame(rows, "src string, type string, dst string").write.parquet(f"{tmp_path}/e")
    g = Graph(spark.createDataFrame([], "node_id string, label string, key string"), spark.read.parquet(f"{tmp_path}/e"))
    out = resolve.redirected(g, spark.createDataFrame([("d", "c"), ("c", "c")], "name string, canonical string"))
    # Outgoing: d-c, d-d; incoming but from the canonical: x-d, d-d.
    assert [tuple(r) for r in out.collect()] == [(1, 1, 4)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [src") == 1


def test_strip_takes_all_blanks_off_both_ends(spark):
    texts = ["", " ", "a", " a", "a ", "　a b\x85", "a\n", "a \r\n", "\n\na ", "a b", "\x1c", "\U0001f600 ", "​a", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(F.regexp_replace("t", f"^{BLANKS}+|{BLANKS}+$", ""), F.lit(""))
    assert [r.got for r in df.select(strip(F.col("t")).alias("got")).collect()] == [r.want for r in df.select(plain.alias("want")).collect()]
