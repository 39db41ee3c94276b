"""Copies that differ in formatting only."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from carbonweave.llm import copies

SCHEMA = "id bigint, s string, p string, o string, m map<string,string>, cw_id string"
COLUMNS, REQUIRED = ["s", "p", "o", "m"], ["s", "o"]


def content(x):
    """The rule of the problem, letter by letter."""
    out = []
    for i, c in enumerate(x or ""):
        digit_next = i + 1 < len(x) and unicodedata.category(x[i + 1])[0] == "N"
        if c.isalnum() or c in "%$€":
            out.append(c.casefold())
        elif c == "." and digit_next and i and unicodedata.category(x[i - 1])[0] == "N":
            out.append(c)
        elif c == "-" and digit_next and not (i and x[i - 1].isalnum()):
            out.append(c)
    return "".join(out)


def brute(rows):
    first, out = {}, set()
    for r in sorted(rows, key=lambda r: r[0]):
        if not content(r[1]) or not content(r[3]):
            continue
        k = (content(r[1]), content(r[2]), content(r[3]), tuple(sorted((content(a), content(b)) for a, b in (r[4] or {}).items())))
        if k in first:
            out.add((first[k], r[0]))
        else:
            first[k] = r[0]
    return out


def some_rows(seed, n):
    rng = random.Random(seed)
    words = ["Straße", "STRASSE", "50%", "$5", "-5", "a-5", "1.5", "15", "é", "É", "tCO₂e", "x​y", "xy", "…", "", "5-", "..", "€", "A.B"]
    text = lambda: rng.choice([None, "", " ", *(" ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 1, 2]))) for _ in range(9))])
    meta = lambda: rng.choice([None, {}, {"Year": "2020", "page": "1"}, {"PAGE": "1", "year ": "2020"}, {"year": "2021"}, {"note": None}])
    return [(k, text(), rng.choice([None, "p", "P!"]), text(), meta(), "x") for k in range(n)]


@pytest.mark.parametrize("hot", [10**6, 3])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(copies, "HOT_ROWS", hot)
    rows = some_rows(1, 900)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    assert len(want) > 20
    assert {tuple(r) for r in copies.find_copies(df, "id", COLUMNS, REQUIRED).collect()} == want
    whole = copies.collapse_copies(df, "id", COLUMNS, REQUIRED).collect()
    assert sum(r.n_copies for r in whole) == sum(bool(content(r[1]) and content(r[3])) for r in rows)


def test_hash_collisions_are_verified(spark, monkeypatch):
    rows = [(1, "a", "p", "b", None, ""), (2, "c", "p", "d", None, ""), (3, "C!", "p", "d", None, ""), (4, "A", "P", "b", None, "")]
    whole = copies.record_hashes

    def poor(columns):
        h1, h2, n = whole(columns)
        return h1 & np.uint64(0), h2 & np.uint64(0), n

    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    base = df.selectExpr("id as cw_id", "1L as first", "0 as salt", "s as b0", "p as b1", "o as b2", "m as b3").sortWithinPartitions("first", "cw_id")
    tested = {r.copy: r.ok for r in copies._walked(base, 4).collect()}
    assert tested == {2: False, 3: False, 4: True}
    rest = base.where("cw_id in (2, 3)").withColumnRenamed("cw_id", "copy")
    assert [tuple(r) for r in copies._regrouped(rest, COLUMNS).collect()] == [(2, 3)]
    assert not poor([pa.array(["x"])])[0].any()


def test_hashes_do_not_depend_on_chunks(monkeypatch):
    texts = [r[1] for r in some_rows(5, 300)] + ["ß" * 999 + "1.5-" + "ﬁ-5." * 400, "x" * 5000, "", None, "5" + ".5" * 700 + "-"]
    whole = [h.tolist() for h in copies.poly_hashes(pa.array(texts))]
    assert whole[2] == [sum(1 for _ in copies.kept_symbols(t)) for t in texts] == [len(content(t)) for t in texts]
    by = {}
    for t, a, b in zip(texts, *whole[:2]):
        by.setdefault(content(t), set()).add((a, b))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(copies, "CHUNK_BYTES", size)
        assert [h.tolist() for h in copies.poly_hashes(pa.array(texts))] == whole
        assert [h.tolist() for h in copies.poly_hashes(pa.array(["a", *texts]).slice(1))] == whole


@pytest.mark.parametrize("long", [1 << 16, 4])
def test_cursors_against_content(monkeypatch, long):
    monkeypatch.setattr(copies, "LONG_BYTES", long)
    rng = random.Random(8)
    texts = [r[1] for r in some_rows(6, 200)] + ["Straße!", "STRASSE", "ﬁn", "f i n"]
    x, y = [rng.choice(texts) for _ in range(3000)], [rng.choice(texts) for _ in range(3000)]
    assert copies.same_symbols(pa.array(x, pa.string()), pa.array(y, pa.string())).tolist() == [content(a) == content(b) for a, b in zip(x, y)]


def test_memory_stays_with_the_chunk():
    import tracemalloc

    text = "Ärger, 1.5 - straße; " * 400_000
    copies.poly_hashes(pa.array(["x"]))
    column = pa.array([text, text.upper().replace(", ", ";")])
    tracemalloc.start()
    h1, _, n = copies.poly_hashes(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert h1[0] == h1[1] and n[0] == n[1] > 5_000_000 and peak < 60_000_000


def test_a_hot_group_lies_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(copies, "HOT_ROWS", 50)
    seen = []
    walked = copies._walked
    monkeypatch.setattr(copies, "_walked", lambda m, w: seen.append(m) or walked(m, w))
    rows = [(k, "Hot, row" if k % 3 == 0 else f"s{k}", "p", "HOT" if k % 3 == 0 else f"o{k // 6}", None, "") for k in range(3000)]
    got = copies.find_copies(spark.createDataFrame(rows, SCHEMA), "id", COLUMNS, REQUIRED)
    assert {(r.first, r.copy) for r in got.collect()} == {(0, k) for k in range(3, 3000, 3)}
    from pyspark.sql import functions as F

    sizes = [r["count"] for r in seen[0].where("first = 0").groupBy("salt").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 100
    assert seen[0].where("first = 0").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_empty_and_long(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert copies.find_copies(df, "id", COLUMNS, REQUIRED).count() == 0
    long = "word, " * 50_000
    df = spark.createDataFrame([(1, long, None, "x", None, ""), (2, long.upper().replace(", ", ";"), None, "X", {}, ""), (3, long + "y", None, "x", None, ""), (3, long + "y", None, "x", None, "")], SCHEMA)
    assert {tuple(r) for r in copies.find_copies(df, "id", COLUMNS, REQUIRED).collect()} == {(1, 2)}
