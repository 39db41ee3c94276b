"""Packing, leaks and encodings."""

import random
import re

import pytest

from carbonweave.llm import encoding, leakage, packing


def test_plan_uses_every_item_once():
    rng = random.Random(5)
    for n in (0, 1, 7, 400, 5000):
        histogram = {}
        for _ in range(n):
            s = min(2048, int(rng.expovariate(1 / 300)) + 1)
            histogram[s] = histogram.get(s, 0) + 1
        used = {}
        plan = packing.plan(histogram)
        for sizes, times in plan:
            assert sum(sizes) <= 2048 and times > 0
            for s in sizes:
                used[s] = used.get(s, 0) + times
        assert used == histogram
        bins, total = sum(t for _, t in plan), sum(s * k for s, k in histogram.items())
        assert bins <= -(-total // 2048) * 1.02 + 1


def test_pack_rows(spark):
    rng = random.Random(6)
    sizes = [(k, rng.choice([0, None, 17, 17, 17, rng.randrange(1, 2049), 2048, 2049, 5000])) for k in range(3000)]
    out = packing.pack(spark.createDataFrame(sizes, "id bigint, n bigint").repartition(5), "id", "n").collect()
    load, pieces = {}, {}
    for r in out:
        load[r.container] = load.get(r.container, 0) + r.piece_tokens
        pieces.setdefault(r.id, []).append((r.piece, r.piece_tokens))
    assert max(load.values()) <= 2048 and set(load) == set(range(len(load)))
    for k, n in sizes:
        got = sorted(pieces[k])
        assert [p for p, _ in got] == list(range(max(1, -(-(n or 0) // 2048)))) and sum(s for _, s in got) == (n or 0)
    total = sum(n or 0 for _, n in sizes)
    assert len(load) <= -(-total // 2048) * 1.02 + 1


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], "id bigint, n bigint"), "id", "n").count() == 0


@pytest.mark.parametrize("block", [leakage.BLOCK_WORDS, 40])
def test_leaks_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", block)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)] + ["Größe", "é", "x9"]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([5, 12, 30])))) for k in range(20)] + [(20, None), (21, ""), (22, None)]
    items[22] = (22, items[0][1])
    docs = []
    for k in range(120):
        t = say(60)
        if k % 2:
            src = rng.choice(items[:20])[1].split()
            at = rng.randrange(max(1, len(src) - 11))
            t[20:20] = [w.upper() if w != "Größe" else "GRÖSSE" for w in src[at : at + rng.choice([11, 12, 40])]]
        docs.append((k, rng.choice([" ", ", ", "_-\n"]).join(t)))
    docs += [(500, None), (501, ""), (502, "word " * 100_000 + items[0][1] + " end")]
    fold = lambda s: [w.casefold() for w in re.findall(r"[^\W_]+", s or "")]
    want = set()
    for i, text in items:
        w = fold(text)
        spans = {tuple(w[a : a + 12]) for a in range(len(w) - 11)}
        for d, t in docs:
            v = fold(t)
            if any(tuple(v[a : a + 12]) in spans for a in range(len(v) - 11)):
                want.add((d, i))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    ev = spark.createDataFrame(items, "item_id bigint, text string")
    hits = leakage.find_leaks(df, "doc_id", "text", ev, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in hits} == want and len(hits) == len(want) > 20
    texts = dict(docs)
    assert all(len(fold(texts[r.doc_id][r.first_offset : r.last_offset])) >= 12 and r.words >= 12 for r in hits)
    assert leakage.find_leaks(df, "doc_id", "text", ev.where("false"), "item_id", "text").count() == 0


def test_thousands_of_items_are_one_scan(spark):
    rng = random.Random(17)
    items = [(k, " ".join(f"{rng.choice('abcdef')}{rng.randrange(500)}" for _ in range(20))) for k in range(6001)]
    items += [(6000, items[17][1]), (3, items[17][1])]
    assert len(list(leakage._blocks(iter(sorted(items))))) == 1
    docs = spark.createDataFrame([(k, f"x, {items[k * 700][1].upper()}. y") for k in range(8)] + [(9, f"z {items[17][1]}")], "doc_id bigint, text string")
    hits = leakage.find_leaks(docs, "doc_id", "text", spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text")
    assert sum("MapInArrow" in line for line in hits._jdf.queryExecution().executedPlan().toString().splitlines()) == 1
    got = sorted((r.doc_id, r.item_id, r.words) for r in hits.collect())
    assert got == sorted([(k, k * 700, 20) for k in range(8)] + [(9, 17, 20), (9, 3, 20), (9, 6000, 20)])


FR = "Le café près de l’hôtel a été rénové, très élégant à côté du château. "
DE = "Die Küche prüft Größen für Öfen, übergeordnet und schön: „heiß“. "
EN = "The café said “no” — it’s 5 °C over 3 m³. "


def garbled(text, written, read):
    return "".join(bytes([b]).decode(read) if b < 0x80 or bytes([b]).decode(read, "replace") != "�" else chr(b) for b in text.encode(written))


SWAPS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman")]


@pytest.fixture(scope="module")
def documents():
    docs, want, k = [], {}, 0
    for _ in range(60):
        for lang, t in (("fr", FR), ("de", DE), ("en", EN)):
            docs.append((k, t * 2, lang, f"s{k % 7}"))
            k += 1
    for n in range(6):
        for lang, t in (("fr", FR), ("de", DE), ("en", EN)):
            for w, r in SWAPS:
                docs.append((k, t + garbled(t, w, r), lang, f"s{n}"))
                want[k] = t + t
                k += 1
            docs.append((k, garbled(garbled(t, "utf-8", "cp1252"), "utf-8", "cp1252"), None, None))
            want[k] = t
            k += 1
    docs.append((k, FR.replace("é", "�"), "fr", "s1"))
    want[k] = None
    for t in ("SÃO BENTO / PRODUÇÃO", "├─ kitchen\n└─ depots", "«Север» or «Юг»", "√ meters √ invoice", "plain", None, "", "x" * 200_000):
        k += 1
        docs.append((k, t, "en", "s1"))
    return docs, want


def test_restores_and_spares(spark, documents):
    docs, want = documents
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    out = {r.doc_id: r.restored for r in encoding.repair(df, "doc_id", "text", "lang", "source").collect()}
    assert out == want


def test_restores_a_hot_source_of_one_byte_letters(spark):
    """A third of the rows in one source, cp1252 read as cp1251: the cipher's characters are common in the corpus."""
    docs, want = [], {}
    for k in range(240):
        lang, t = (("fr", FR), ("de", DE), ("en", EN))[k % 3]
        docs.append((k, t, lang, f"s{k % 8}"))
        if k % 2:
            docs.append((1000 + k, garbled(t, "cp1252", "cp1251"), lang, "hot"))
            if docs[-1][1] != t:
                want[1000 + k] = t
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    assert {r.doc_id: r.restored for r in encoding.repair(df, "doc_id", "text", "lang", "source").collect()} == want


SENTENCES = ["Le café près de l’hôtel a été rénové, très élégant à côté du château.", "La société a réduit ses émissions de gaz à effet de serre l’année dernière.", "Nos usines à Orléans et à Besançon ont été équipées de systèmes très performants.", "Les forêts gérées durablement abritent des espèces protégées.", "Ça a coûté cher, mais le résultat final était déjà à la hauteur.", "Où êtes-vous allés après le dîner près de la forêt ?"]


@pytest.mark.parametrize(("written", "read"), [("utf-8", "cp1257"), ("utf-8", "cp866"), ("cp1252", "cp437")])
def test_one_bad_source_of_any_page(spark, written, read):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(SENTENCES) for _ in range(4))
    docs = [(k, text(), "fr", f"s{k % 10}") for k in range(200)]
    want = {1000 + k: text() for k in range(40)}
    docs += [(k, garbled(t, written, read), "fr", "bad") for k, t in want.items()]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    assert {r.doc_id: r.restored for r in encoding.repair(df, "doc_id", "text", "lang", "source").collect()} == want


def test_what_stays_garbled_is_not_put_out_as_restored():
    assert encoding.unresolved("caf├e pr├s") and not encoding.unresolved("SÃO ├─ kitchen │ x, 5 °C, m³")
    model = encoding.LanguageModel([("fr", x, side, ctx, 50) for x in "éèô" for side in (0, 1) for ctx in "frtc s^"])
    theta = {u: {"": 0.01, x: 0.99} for u, x in (("Ã©", "é"), ("Ã¨", "è"), ("Ã´", "ô"))}
    assert encoding.restore("cafÃ© prÃ¨s cÃ´tÃ© Ð®Ð³", "fr", theta, model) == "café près côté Юг"
    assert encoding.restore("cafÃ© Ð®Ð³", "fr", theta, model) == "café Ð®Ð³"


def test_clean_or_empty_texts(spark):
    df = spark.createDataFrame([(1, "ok", "en", "s"), (2, None, None, None)], "doc_id bigint, text string, lang string, source string")
    assert encoding.repair(df, "doc_id", "text", "lang", "source").count() == 0
    assert encoding.repair(df.where("false"), "doc_id", "text", "lang", "source").count() == 0
