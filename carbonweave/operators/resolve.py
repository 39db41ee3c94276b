"""Near-duplicate names by order-free sequence similarity, and the merging of their nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carbonweave.functions.text import merged
from carbonweave.operators import nearby
from carbonweave.operators.graph import Graph, one_row
from carbonweave.operators.nearby import common_subsequence
from carbonweave.session import cut

THRESHOLD = 85.0
#: The reference behaviour leaves resolution out above this many names; mode "blocked" has no such limit.
MOST_NAMES = 2000
#: Forms of a bucket at most, and at least where there are many; forms of this many letters or more count as one length.
_BUCKET, _LEAST_BUCKET, _LONG = 50_000, 1_000, 1_000
#: Tasks of the search at most; beyond, a task has several pairs of buckets.
_TASKS = 2_000
#: Links that one task connects.
_FEW_LINKS = 300_000


def sorted_tokens(name: str) -> str:
    return " ".join(sorted(name.split()))


def similarity(a: str, b: str) -> float:
    """0..100: twice the common subsequence of the sorted tokens over the length of both."""
    return _sorted_similarity(sorted_tokens(a), sorted_tokens(b))


def _sorted_similarity(a: str, b: str) -> float:
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def sorted_similarities(a: list[str], b: list[str]) -> np.ndarray:
    """similarity() of many pairs whose tokens are sorted already, all at once."""
    return nearby.scores(a, b)


def _groups(sizes: dict[int, int], texts: int) -> list[tuple[int, int, int]]:
    """(shortest, longest, parts): lengths side by side whose texts are about one bucket, or one length in several; sizes has the number of texts by length."""
    out: list[tuple[int, int, int]] = []
    held = 0
    for n in sorted(sizes):
        if out and held + sizes[n] <= texts:
            out[-1] = (out[-1][0], n, 1)
            held += sizes[n]
        else:
            out.append((n, n, -(-sizes[n] // texts)))
            held = sizes[n]
    return out


def _near_forms(forms: DataFrame, threshold: float) -> DataFrame:
    """text_a, text_b, score of all pairs of different forms at the threshold: every bucket of forms of like length meets every other that it can reach."""
    slack = 1 - threshold / 100
    sizes = {r.n: r["count"] for r in forms.groupBy(F.least(F.length("text"), F.lit(_LONG)).alias("n")).count().collect()}
    groups = _groups(sizes, max(_LEAST_BUCKET, min(_BUCKET, sum(sizes.values()) // 10)))
    first = [0, *np.cumsum([g[2] for g in groups]).tolist()]
    group_of = np.zeros(_LONG + 1, np.int64)
    for k, (low, high, _) in enumerate(groups):
        group_of[low : high + 1] = k
    # The longest of one group and the shortest of the other; lengths from _LONG on count as one.
    meet = [(x, y) for x, (_, a, _) in enumerate(groups) for y, (b, _, _) in enumerate(groups) if x == y or x < y and b - a <= slack * (a + b) + 1e-9]
    pairs = [(i, j) for x, y in meet for i in range(first[x], first[x + 1]) for j in range(max(i, first[y]), first[y + 1])]
    places: list[list[tuple[int, bool]]] = [[] for _ in range(first[-1])]
    for p, (i, j) in enumerate(pairs):
        places[i].append((p, True))
        if i != j:
            places[j].append((p, False))
    parts, starts = np.array([g[2] for g in groups]), np.array(first)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.minimum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False), _LONG)
            group = group_of[size]
            bucket = starts[group] + batch.column(0).to_numpy() % parts[group]
            for k in np.unique(bucket):
                texts = batch.column(1).take(pa.array(np.flatnonzero(bucket == k)))
                for p, left in places[k]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), p)), pa.array(np.full(len(texts), left)), texts], ["pair", "is_left", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[str], list[str]]] = {}
        for batch in batches:
            pair, is_left = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for p in np.unique(pair).tolist():
                sides = held.setdefault(p, ([], []))
                for side, mine in zip(sides, (is_left, ~is_left)):
                    side += batch.column(2).take(pa.array(np.flatnonzero((pair == p) & mine))).to_pylist()
        while held:
            p, (one, other) = held.popitem()
            for a, b, score in nearby.near_pairs(one, None if pairs[p][0] == pairs[p][1] else other, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(score)], ["text_a", "text_b", "score"])

    sent = forms.mapInArrow(send, "pair bigint, is_left boolean, text string")
    tasks = max(1, min(len(pairs), _TASKS))
    return sent.repartitionById(tasks, (F.col("pair") % tasks).cast("int")).mapInArrow(run, "text_a string, text_b string, score double")


def duplicate_pairs(names: DataFrame, column: str, threshold: float = THRESHOLD, mode: str = "blocked", most: int = MOST_NAMES) -> DataFrame:
    """(canonical, duplicate, score): the longer name is canonical, the first in binary order on a tie.

    mode "capped" keeps the reference's rule of doing nothing below 2 or above `most` names.
    """
    distinct = names.select(F.col(column).alias("name")).where("name is not null and name <> ''").distinct()
    if mode == "capped" and not 2 <= distinct.limit(most + 1).count() <= most:
        distinct = distinct.where(F.lit(False))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("text", pa.array([sorted_tokens(x) for x in batch.column(0).to_pylist()], pa.string()))

    named = cut(distinct.mapInArrow(sort, "name string, text string"))
    # Names whose sorted tokens are equal are compared with others once.
    forms = cut(named.select("text").distinct().select(F.monotonically_increasing_id().alias("form"), "text"))
    # Written once: the search is far dearer than its pairs, which are read for both directions.
    scored = cut(_near_forms(forms, threshold))
    a, b_ = (named.select(F.col("text").alias(f"text_{x}"), F.col("name").alias(f"name_{x}")) for x in "ab")
    across = scored.join(a, "text_a").join(b_, "text_b").select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"), "score")
    same = a.join(b_, F.col("text_a") == F.col("text_b")).where("name_a < name_b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), F.lit(100.0).alias("score"))
    first = F.length("a") >= F.length("b")
    return across.unionByName(same).select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("canonical"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("duplicate"), "score")


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, label of every end of the links: the end that stands for all it is connected with."""
    head: dict[str, str] = {}

    def find(x: str) -> str:
        while head[x] != x:
            head[x] = x = head[head[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(head.setdefault(a, a)), find(head.setdefault(b, b))
            head[max(x, y)] = min(x, y)
    names = list(head)
    for at in range(0, len(names), 10_000):
        part = names[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([find(x) for x in part], pa.string())], ["a", "label"])


def connected(links: DataFrame) -> DataFrame:
    """(a, label): every end of the links (a, b) and the smallest end it is connected with.

    Every end goes over into the smallest of its neighbours and on into that one's, at least halving the ends, until the
    links left are few enough for one task. Links are read more than once.
    """
    rounds: list[DataFrame] = []
    while links.count() > _FEW_LINKS:
        both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
        near = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
        to = cut(near.join(near.select(F.col("a").alias("label"), F.col("label").alias("on")), "label").select("a", F.col("on").alias("label")))
        ends = [to.select(F.col("a").alias(c), F.col("label").alias(f"{c}_label")) for c in "ab"]
        moved = links.join(ends[0], "a").join(ends[1], "b").where("a_label <> b_label")
        links = cut(moved.select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b")).distinct())
        rounds.append(to)
    rounds.append(links.repartition(1).mapInArrow(_closed, "a string, label string"))
    label = rounds[0]
    for to in rounds[1:]:
        label = label.join(to.select(F.col("a").alias("label"), F.col("label").alias("on")), "label", "left").select("a", F.coalesce("on", "label").alias("label"))
    return cut(label)


def components(pairs: DataFrame) -> DataFrame:
    """(name, canonical): every name of a component and its longest, smallest name."""
    label = connected(cut(pairs.select(F.col("canonical").alias("a"), F.col("duplicate").alias("b"))))
    head = label.groupBy("label").agg(F.min(F.struct((-F.length("a")).alias("n"), F.col("a").alias("name"))).alias("h"))
    return cut(label.join(head, "label").select(F.col("a").alias("name"), F.col("h.name").alias("canonical")))


def redirect(graph: Graph, mapping: DataFrame, label: str = "Company") -> Graph:
    """Edges move from duplicates to their canonical node, duplicates go.

    mapping: name, canonical. An edge from the canonical to its duplicate is dropped; one from the
    duplicate to the canonical stays as a self-loop.
    """
    m = mapping.where("name <> canonical").select(F.concat(F.lit(f"{label}:"), "name").alias("dup"), F.concat(F.lit(f"{label}:"), "canonical").alias("can"))
    out = graph.edges.join(m.select(F.col("dup").alias("src"), F.col("can").alias("new_src")), "src", "left")
    out = out.join(m.select(F.col("dup").alias("dst"), F.col("can").alias("new_dst")), "dst", "left")
    kept = out.where(F.col("new_dst").isNull() | (F.coalesce("new_src", "src") != F.col("new_dst")) | F.col("new_src").isNotNull())
    moved = kept.select(F.coalesce("new_src", "src").alias("src"), "type", F.coalesce("new_dst", "dst").alias("dst"), *[c for c in graph.edges.columns if c not in ("src", "type", "dst")])
    return Graph(graph.nodes.join(m.select(F.col("dup").alias("node_id")), "node_id", "left_anti"), moved)


def redirected(graph: Graph, mapping: DataFrame, label: str = "Company") -> DataFrame:
    """One row: pairs_found, pairs_merged, rels_redirected."""
    m = mapping.where("name <> canonical").select(F.concat(F.lit(f"{label}:"), "name").alias("dup"), F.concat(F.lit(f"{label}:"), "canonical").alias("can"))
    ends = graph.edges.select("src", "dst")
    for end in ("src", "dst"):
        ends = ends.join(m.select(F.col("dup").alias(end), F.col("can").alias(f"{end}_can")), end, "left")
    rels = ends.agg((F.count("src_can") + F.count_if(F.col("src") != F.col("dst_can"))).alias("rels_redirected"))
    return one_row(m.agg(F.count("*").alias("pairs_found"), F.count("*").alias("pairs_merged")), rels)


def merge_pairs_in_order(graph: Graph, pairs: list[tuple[str, str]], label: str = "Company") -> Graph:
    """The reference's sequential application: a later pair whose canonical is gone loses its duplicate's edges. Small pair lists only."""
    if len(pairs) > MOST_NAMES:
        raise ValueError("sequential merging is for short pair lists")
    gone: set[str] = set()
    spark = graph.nodes.sparkSession
    for canonical, duplicate in pairs:
        if canonical in gone:
            node = f"{label}:{duplicate}"
            graph = Graph(graph.nodes.where(F.col("node_id") != node), graph.edges.where((F.col("src") != node) & (F.col("dst") != node)))
        elif duplicate not in gone:
            graph = redirect(graph, spark.createDataFrame([(duplicate, canonical)], "name string, canonical string"), label)
        gone.add(duplicate)
    return graph


def drop_with_edges(graph: Graph, mapping: DataFrame, label: str = "Company") -> Graph:
    """The degenerate merge: the canonical node takes its duplicates' properties, duplicates go, and their edges with them.

    The property that identifies the canonical node stays; of several duplicates the last in order of names prevails.
    """
    m = mapping.where("name <> canonical").select(F.concat(F.lit(f"{label}:"), "name").alias("dup"), F.concat(F.lit(f"{label}:"), "canonical").alias("can"))
    dups = m.select("dup").distinct()
    edges = graph.edges.join(dups.withColumnRenamed("dup", "src"), "src", "left_anti").join(dups.withColumnRenamed("dup", "dst"), "dst", "left_anti")
    nodes = graph.nodes
    if "props" in nodes.columns:
        one = nodes.join(m, nodes.node_id == m.dup).select("can", "dup", F.explode("props").alias("k", "v")).where(~F.col("k").isin("name", "value"))
        last = one.groupBy("can", "k").agg(F.max_by("v", "dup").alias("v")).groupBy("can").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("taken"))
        j = nodes.join(last, nodes.node_id == last.can, "left")
        nodes = j.select("node_id", "label", "key", F.when(F.col("taken").isNull(), F.col("props")).otherwise(merged(F.col("props"), F.col("taken"))).alias("props"))
    return Graph(nodes.join(dups.withColumnRenamed("dup", "node_id"), "node_id", "left_anti"), edges)
