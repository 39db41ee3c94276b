"""Graph operators on hand-written rows."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from carbonweave.functions import text as X
from carbonweave.operators import chunking, enrich, resolve, search, traverse
from carbonweave.operators.graph import Graph, broken_keys, ingest_stats, merge_nodes
from carbonweave.plans import context, stats
from carbonweave.plans.pipeline import WARNING, AlreadyRunning, Pipeline, Stage
from carbonweave.sources import files

TRIPLE = "pos bigint, subject string, predicate string, object_value string, metadata map<string,string>, file string"


def triples(spark, rows):
    return spark.createDataFrame([(k, s, p, o, m, f) for k, (s, p, o, m, f) in enumerate(rows)], TRIPLE)


def test_predicates(spark):
    cases = [("reports-emission", "REPORTS_EMISSION"), ("Reports Emission", "REPORTS_EMISSION"), ("reports__(emission)!", "REPORTS_EMISSION"), ("***", "RELATED_TO"), (None, "RELATED_TO")]
    df = spark.createDataFrame(cases, "p string, want string")
    assert df.where(X.normalize_predicate(F.col("p")) != F.col("want")).count() == 0


def test_strip_removes_all_white_space(spark):
    df = spark.createDataFrame([("\t A \n", "A"), ("  B ", "B"), (None, ""), ("  ", "")], "s string, want string")
    assert [r[0] for r in df.select(X.strip(F.col("s")) == F.col("want")).collect()] == [True] * 4


def test_numbers(spark):
    df = spark.createDataFrame([("5,000 tCO2e",), ("12d",), ("1_000",), (" 12.5 ",), ("1e3",), (None,)], "v string")
    assert [r[0] for r in df.select(X.to_number(F.col("v"))).collect()] == [None, None, None, 12.5, 1000.0, None]


def test_merge_is_idempotent_and_last_writer_wins(spark):
    t = triples(spark, [("A", "has supplier", "B", {"u": "1", "y": "1"}, "a"), ("A", "HAS-SUPPLIER", "B", {"u": "2"}, "b"), ("A", "OPERATES_IN", "A", None, "b"), (" ", "X", "y", None, "b"), ("A", "FOO", "C", {"n": "5"}, "b")])
    g = Graph.from_triples(t, ["pos"])
    twice = Graph.from_triples(t.unionByName(t), ["pos"])
    assert {tuple(r) for r in g.nodes.collect()} == {("Company:A", "Company", "A"), ("Company:B", "Company", "B"), ("Region:A", "Region", "A"), ("Entity:C", "Entity", "C")}
    edges = {(r.src, r.type, r.dst): r.props for r in g.edges.collect()}
    assert edges == {("Company:A", "HAS_SUPPLIER", "Company:B"): {"u": "2", "y": "1"}, ("Company:A", "OPERATES_IN", "Region:A"): {}, ("Company:A", "FOO", "Entity:C"): {"n": "5"}}
    assert twice.edges.count() == 3 and twice.nodes.count() == 4
    assert broken_keys(g.nodes).count() == 0 and merge_nodes(g.nodes, twice.nodes).count() == 4
    s = {r.file: (r.processed, r.written, r.skipped) for r in ingest_stats(t, "file", ["pos"]).collect()}
    assert s == {"a": (1, 1, 0), "b": (4, 3, 1), None: (5, 4, 1)}


def test_shared_metric_fans_out_and_limit_modes(spark):
    rows = [("A", "REPORTS_EMISSION", "5", None, "f"), ("B", "REPORTS_EMISSION", "5", None, "f"), ("5", "MEASURED_IN_YEAR", "2020", None, "f"), ("5", "MEASURED_IN_YEAR", "2021", None, "f")]
    assert stats.emission_rows(Graph.from_triples(triples(spark, rows), ["pos"])).count() == 4
    rows = [("A", "REPORTS_EMISSION", v, None, "f") for v in ("x", "y", "z", "1", "2")]
    g = Graph.from_triples(triples(spark, rows), ["pos"])
    assert stats.emissions(g, 3, "compat").count() == 0
    assert [r.value for r in stats.emissions(g, 3).collect()] == [2.0, 1.0]
    with pytest.raises(ValueError):
        stats.emissions(g, 501)


def test_targets_collapse(spark):
    g = Graph.from_triples(triples(spark, [("A", "SETS_TARGET", "t1", None, "f"), ("A", "SETS_TARGET", "t2", None, "f")]), ["pos"])
    assert [tuple(r) for r in stats.targets(g).collect()] == [("A", "unknown", "")]


def brute_ego(edges, root, hops):
    """Edges on any trail of at most `hops` steps."""
    out = set()

    def walk(at, used):
        for k, (a, b) in enumerate(edges):
            if k not in used and at in (a, b) and len(used) < hops:
                out.add((a, b))
                walk(b if at == a else a, used | {k})

    walk(root, frozenset())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ego_equals_trails(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(9)]
    e = spark.createDataFrame([(f"Company:{a}", "T", f"Company:{b}") for a, b in edges], "src string, type string, dst string").distinct()
    n = spark.createDataFrame([(f"Company:n{k}", "Company", f"n{k}") for k in range(7)], "node_id string, label string, key string")
    for hops in (1, 2, 3):
        got = {(r.src[8:], r.dst[8:]) for r in traverse.ego(Graph(n, e), "Company:n0", hops).edges.collect()}
        assert got == brute_ego(sorted(set(edges)), "n0", hops)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarity_values():
    want = {("red bolt", "bolt red"): 100, ("red bolt", "red bolts"): 94.12, ("red bolt", "red bolT"): 87.5, ("red bolt", "red bolt Co"): 84.21, ("red bolt", "Red bolt"): 50}
    assert {k: round(resolve.similarity(*k), 2) for k in want} == want
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert resolve.common_subsequence(a, b) == lcs(a, b)


def test_blocking_loses_no_pair(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randrange(4, 12))) for _ in range(120)]
    names += [n[:k] + rng.choice("abcd") + n[k:] for n in names[:60] for k in (0, len(n) // 2)]
    names = sorted(set(names))
    want = {(a, b) for a, b in product(names, names) if a < b and resolve.similarity(a, b) >= 85}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {tuple(sorted((r.canonical, r.duplicate))) for r in resolve.duplicate_pairs(df, "name").collect()}
    assert got == want and len(want) > 50


def test_resolution_ties_bounds_and_chain(spark):
    df = spark.createDataFrame([("Suppliers",), ("suppliers",)], "name string")
    assert [(r.canonical, r.duplicate, round(r.score, 2)) for r in resolve.duplicate_pairs(df, "name").collect()] == [("Suppliers", "suppliers", 88.89)]
    assert resolve.duplicate_pairs(df.limit(1), "name", mode="capped").count() == 0
    assert resolve.duplicate_pairs(df, "name", mode="capped", most=1).count() == 0
    chain = spark.createDataFrame([("A", "B", 90.0), ("B", "C", 90.0)], "canonical string, duplicate string, score double")
    assert {tuple(r) for r in resolve.components(chain).collect()} == {("A", "A"), ("B", "A"), ("C", "A")}


def brute_components(names, threshold=85.0):
    """Pairs by comparing all with all, and each name's canonical name."""
    pairs = {(a, b) for a, b in product(names, names) if a < b and resolve.similarity(a, b) >= threshold}
    group = {n: {n} for n in names}
    for a, b in pairs:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    return pairs, {n: min(g, key=lambda x: (-len(x), x)) for n, g in group.items()}


def test_similarities_all_at_once():
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab \u00e9\U0001f600") for _ in range(rng.choice([0, 1, 5, 30, 63, 64, 65, 90]))) for _ in range(400)]
    a, b = [resolve.sorted_tokens(x) for x in texts], [resolve.sorted_tokens(x) for x in reversed(texts)]
    assert list(resolve.sorted_similarities(a, b)) == [resolve.similarity(x, y) for x, y in zip(a, b)]


@pytest.mark.parametrize("threshold", [60.0, 70.0, 80.0, 92.5, 100.0])
def test_pairs_at_other_thresholds(spark, threshold):
    rng = random.Random(12)
    words = ["Foods", "Group", "Inc.", "Ltd", "cold", "Café"] + ["".join(rng.choice("aeioklmn") for _ in range(rng.randrange(1, 9))) for _ in range(20)]
    names = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(120)}
    names |= {n[:k] + rng.choice(" aX") + n[k + rng.randrange(3) :] for n in sorted(names) for k in (0, len(n) // 2, len(n))} | {" ", "a", "ab", "aaaaaaaaaa", "aaaaaaaaa"}
    df = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    got = [tuple(sorted((r.canonical, r.duplicate))) for r in resolve.duplicate_pairs(df, "name", threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_components(sorted(names), threshold)[0]


@pytest.fixture()
def report_triples(spark, tmp_path):
    rng = random.Random(13)
    names = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(5)).title() + " Foods" for _ in range(40)]
    rows = [(f"{n}{end}", p, o) for k, n in enumerate(names) for end, p, o in (("", "OPERATES_IN", "Europe"), (" Co", "has supplier", f"{names[k - 1]}."), ("s", "HAS_SUPPLIER", n))]
    triples(spark, [(s, p, o, None, "f") for s, p, o in rows]).withColumnRenamed("pos", "triple_id").write.parquet(f"{tmp_path}/chipotle_2024_triples.parquet")
    return str(tmp_path)


def test_resolution_queries_run_on_company_nodes(spark, report_triples):
    from carbonweave.queries_graph import QUERIES, triple_graph

    g = triple_graph(spark, report_triples)
    names = sorted(r.key for r in g.label("Company").collect())
    pairs, canonical = brute_components(names)
    moved = {n: c for n, c in canonical.items() if n != c}
    found = lambda q: {tuple(sorted((r.canonical, r.duplicate))) for r in QUERIES[q](spark, report_triples).collect()}
    assert found("jn10_name_pairs") == found("qy12_entity_resolution") == pairs and len(pairs) > 80
    assert found("ud3_fuzzy_ratio") == brute_components(names, 70.0)[0]
    assert {r.name: r.canonical for r in QUERIES["jn15_components"](spark, report_triples).collect()} == {n: c for n, c in canonical.items() if n in moved or n in moved.values()}
    at = lambda x: "Company:" + canonical[x[8:]] if x.startswith("Company:") else x
    want = sorted((at(r.src), r.type, at(r.dst)) for r in g.edges.collect() if not (r.dst[8:] in moved and r.src[8:] not in moved and r.src == at(r.dst)))
    assert sorted((r.src, r.type, r.dst) for r in QUERIES["qy12_merged_graph"](spark, report_triples).collect()) == want


def test_resolution_has_no_limit_of_names(spark, tmp_path):
    from carbonweave.queries_graph import QUERIES

    rows = [(f"{k:05d}" * 3, "FOO", "x", None, "f") for k in range(2100)] + [("Harbour Foods", "FOO", "x", None, "f"), ("Harbour Food", "FOO", "x", None, "f")]
    triples(spark, rows).withColumnRenamed("pos", "triple_id").write.parquet(f"{tmp_path}/chipotle_2024_triples.parquet")
    assert ("Harbour Foods", "Harbour Food") in {(r.canonical, r.duplicate) for r in QUERIES["qy12_entity_resolution"](spark, str(tmp_path)).collect()}
    assert QUERIES["qy12_entity_resolution_compat"](spark, str(tmp_path)).count() == 0


def test_redirect_self_edges(spark):
    n = spark.createDataFrame([("Company:c", "Company", "c"), ("Company:d", "Company", "d"), ("Company:x", "Company", "x")], "node_id string, label string, key string")
    e = spark.createDataFrame([("Company:d", "T", "Company:c"), ("Company:c", "T", "Company:d"), ("Company:x", "T", "Company:d")], "src string, type string, dst string")
    m = spark.createDataFrame([("d", "c")], "name string, canonical string")
    g = resolve.redirect(Graph(n, e), m)
    assert {(r.src, r.dst) for r in g.edges.collect()} == {("Company:c", "Company:c"), ("Company:x", "Company:c")}
    assert g.nodes.count() == 2
    lost = resolve.merge_pairs_in_order(Graph(n, e), [("c", "d"), ("d", "x")])
    assert {(r.src, r.dst) for r in lost.edges.collect()} == {("Company:c", "Company:c")}
    assert resolve.drop_with_edges(Graph(n, e), m).edges.count() == 0


def test_upsert_branches_and_second_run(spark):
    nodes = spark.createDataFrame([("A", "old")], "key string, region string")
    erp = spark.createDataFrame([("A", 1.0, "c", "new", 1, True), ("B", 2.0, "c", "new", 2, False)], "supplier_name string, annual_spend_usd double, spend_category string, region string, tier int, contract_active boolean")
    up = enrich.upsert_suppliers(nodes, erp)
    rows = {r.key: r for r in up.collect()}
    assert (rows["A"].region, rows["A"].annual_spend_usd, rows["A"].was_new, rows["A"].erp_loaded) == ("old", 1.0, False, None)
    assert (rows["B"].region, rows["B"].was_new, rows["B"].source) == ("new", True, "ERP")
    again = enrich.upsert_stats(enrich.upsert_suppliers(up.drop("was_new"), erp)).first()
    assert (again.created, again.updated) == (0, 2)


def test_geocode_retries_and_empty(spark):
    n = spark.createDataFrame([("Region", "X", True), ("Region", "Y", False), ("Region", "Z", None), ("Company", "Z", None)], "label string, key string, geocode_failed boolean")
    g = spark.createDataFrame([("Z", 1.0, 2.0)], "name string, latitude double, longitude double")
    found = enrich.geocode(n, "Region", g)
    assert {(r.key, r.geocode_failed) for r in found.collect()} == {("Y", True), ("Z", False)}
    assert tuple(enrich.geo_stats(found).first()) == (2, 1, 1)
    assert tuple(enrich.geo_stats(enrich.geocode(n.where("false"), "Region", g)).first()) == (0, 0, 0)


def test_candidates_history_and_context(spark):
    q = spark.createDataFrame([(1, "Does Alpha Beta supply Gamma?")], "question_id int, question string")
    assert q.select(X.candidate_names(F.col("question"))).first()[0] == ["Does Alpha Beta supply Gamma"]
    turns = spark.createDataFrame([(1, k, "system" if k == 9 else "user", "x" * 600) for k in range(12)], "c int, t int, role string, content string")
    got = context.recent_turns(turns, "c", "t", "role", "content").collect()
    assert len(got) == 9 and max(len(r.content) for r in got) == 500
    g = Graph.from_triples(triples(spark, [("Alpha", "REPORTS_EMISSION", "5", None, "f"), ("Alpha", "COMMITS_TO_NET_ZERO", "2040", None, "f")]), ["pos"])
    text = context.context_text(g, "What is the target of Alpha").first()
    assert text.context_used and "- Alpha: net-zero by 2040" in text.context
    assert "net-zero by" not in context.context_text(g, "Alpha in general").first().context


def test_search(spark):
    n = spark.createDataFrame([("Green Foods",), ("Green Green Energy",), ("Blue",)], "name string")
    assert [r.name for r in search.bm25(n, "name", "green").collect()] == ["Green Green Energy", "Green Foods"]
    assert [r.name for r in search.containing(n, "name", "GREEN").collect()] == ["Green Foods", "Green Green Energy"]
    with pytest.raises(ValueError):
        search.bm25(n, "name", "x", 101)


def test_chunks(spark):
    text = "\n\n".join(["a" * 3000, "b" * 900, "c" * 9000, "d"])
    out = chunking.pack_paragraphs(text)
    assert "".join(out).replace("\n\n", "") == text.replace("\n\n", "") and max(map(len, out)) <= chunking.HARD_MAX
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    assert chunking.chunks(df, "id", "text").groupBy("doc").count().collect()[0][1] == len(out)
    e = spark.createDataFrame([("CompositeElement", "x" * 100), ("Title", "x" * 100), ("Table", "x"), (None, None)], "element_type string, text string")
    assert chunking.select_chunks(e).count() == 1


def test_json_sources(spark, tmp_path):
    (tmp_path / "a_triples.json").write_text('[{"subject": "A", "predicate": "p", "object_value": "B", "metadata": {"n": 5}}, {"subject": "C"}]')
    (tmp_path / "b_triples.json").write_text('[{"subject": "A"')
    t = files.read_triples(spark, str(tmp_path))
    assert {(r.file, r.processed, r.errors) for r in files.file_errors(t).collect()} == {("a_triples.json", 2, 0), ("b_triples.json", 0, 1)}
    assert t.where("subject = 'A' and pos = 0 and object_value = 'B'").first().metadata == {"n": "5"}
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.json").write_text('[{"type": "Title", "text": "t", "other": 1}]')
    (tmp_path / "e" / "y.json").write_text("not json")
    assert [tuple(r) for r in files.read_elements(spark, str(tmp_path / "e")).collect()] == [("x.json", 0, "Title", "t")]
    assert files.preflight(str(tmp_path / "e")) and not files.preflight(str(tmp_path / "none"))


def test_log_sink_is_set_up_once(tmp_path, monkeypatch):
    import logging

    from carbonweave.logs import setup_logging

    root = logging.getLogger()
    monkeypatch.setattr(root, "handlers", [])
    for _ in range(2):
        setup_logging(tmp_path / "a" / "run.log")
    assert len(root.handlers) == 2
    logging.getLogger("x").warning("été")
    assert "| WARNING  | x |  été" in (tmp_path / "a" / "run.log").read_text("utf-8")
    root.handlers[1].close()


def test_connect_and_preflight(spark, tmp_path, monkeypatch):
    from carbonweave.session import SessionError, connect

    monkeypatch.delenv("SPARK_MASTER", raising=False)
    with pytest.raises(SessionError):
        connect()
    assert connect("local[4]") is spark
    assert not files.preflight(f"file://{tmp_path}", spark=spark)
    (tmp_path / "x.json").write_text("[]")
    assert files.preflight(f"file://{tmp_path}", spark=spark) and not files.preflight(f"file://{tmp_path}/none", spark=spark)


def test_failed_rows_are_not_seen(spark):
    df = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "b", None), (4, "c", True)], "pos int, url string, ok boolean")
    assert [(r.url, r.pos) for r in files.first_n_distinct(df, "url", ["pos"], 5, F.col("ok")).collect()] == [("a", 2), ("c", 4)]


def test_chunks_do_not_cross_titles(spark):
    rows = [("d", 1, "Text", "before"), ("d", 2, "Title", "One"), ("d", 3, "Text", "x" * 3000), ("d", 4, "Table", "y" * 1500), ("d", 5, "Title", "Two"), ("d", 6, "Text", None), ("e", 1, "Text", " "), ("e", 2, "Text", "only")]
    df = spark.createDataFrame(rows, "doc string, pos int, element_type string, text string")
    got = sorted((r.doc, r.section, r.pos, r.chunk) for r in chunking.chunks_by_title(df, F.col("doc"), ["pos"]).collect())
    assert got == [("d", 0, 0, "before"), ("d", 1, 0, "One\n\n" + "x" * 3000), ("d", 1, 1, "y" * 1500), ("d", 2, 0, "Two"), ("e", 0, 0, "only")]


def test_node_properties(spark):
    t = triples(spark, [("A", "OPERATES_IN", "Oslo", None, "f"), ("A", "OPERATES_IN", "Nowhere", None, "f")])
    erp = spark.createDataFrame([("A", 1.5, "c", "new", 1, True), ("B", 2.0, None, "new", None, False)], "supplier_name string, annual_spend_usd double, spend_category string, region string, tier int, contract_active boolean")
    places = spark.createDataFrame([("Oslo", 59.9, 10.7)], "name string, latitude double, longitude double")
    g = enrich.load_coordinates(enrich.load_suppliers(Graph.from_triples(t, ["pos"]), erp), ("Region",), places)
    props = {r.node_id: r.props for r in g.nodes.collect()}
    assert props["Company:A"] == {"name": "A", "_is_new": "false", "annual_spend_usd": "1.50", "supply_chain_tier": "1", "contract_active": "true"}
    assert props["Company:B"] == {"name": "B", "_is_new": "true", "annual_spend_usd": "2.00", "contract_active": "false", "erp_loaded": "true", "region": "new", "source": "ERP"}
    assert props["Region:Oslo"]["latitude"] == "59.900000" and props["Region:Nowhere"] == {"name": "Nowhere", "geocode_failed": "true"}
    assert stats.summary(g).first().suppliers == 1
    again = {r.node_id: r.props for r in enrich.load_suppliers(g, erp).nodes.collect()}
    assert again["Company:B"]["_is_new"] == "false" and again["Company:B"]["source"] == "ERP"
    m = spark.createDataFrame([("B", "A")], "name string, canonical string")
    merged = {r.node_id: r.props for r in resolve.drop_with_edges(g, m).nodes.collect()}
    assert merged["Company:A"]["annual_spend_usd"] == "2.00" and merged["Company:A"]["name"] == "A" and "Company:B" not in merged


def test_settings_fall_back():
    s = files.Settings.from_env({"SIMILARITY_THRESHOLD": "ninety", "MAX_RETRIES": "5"})
    assert (s.similarity_threshold, s.max_retries) == (85.0, 5)


def test_pipeline_rules():
    def boom(state):
        raise RuntimeError("no")

    p = Pipeline([Stage("extract", lambda s: {"n": 1}), Stage("load", lambda s: {"written": 0}, proceed=lambda s: s["written"] > 0), Stage("resolve", boom)])
    p.run()
    assert p.state.status == "halted"
    p = Pipeline([Stage("geo", boom, WARNING), Stage("load", lambda s: {"ok": True})])
    assert p.run()["ok"] and p.state.warnings and p.state.status == "completed"
    p = Pipeline([Stage("load", boom), Stage("geo", lambda s: {"x": 1})])
    assert "x" not in p.run() and p.state.status == "failed"
    with pytest.raises(ValueError):
        p.run(skip=frozenset({"load", "geo"}))
    p.state.status = "running"
    with pytest.raises(AlreadyRunning):
        p.run()


def test_stream_ingests_only_new_files(spark, tmp_path):
    from carbonweave.streaming.ingest import ingest_available

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    t = triples(spark, [("A", "p q", "B", None, "f"), ("", "p", "B", None, "f")])
    t.write.parquet(src)
    for _ in range(2):
        ingest_available(spark, src, TRIPLE, out, ck, ["pos"])
    assert spark.read.parquet(out).count() == 1
    t.write.mode("append").parquet(src)
    ingest_available(spark, src, TRIPLE, out, ck, ["pos"])
    assert spark.read.parquet(out).count() == 2
