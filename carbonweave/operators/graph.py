"""The property graph as two DataFrames, built set-wise from triples.

nodes: node_id (label:key), label, key and, once enriched, props. edges: src, type, dst, props. Node and edge creation is
match-or-create, expressed as deduplication: running it again on the same triples changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carbonweave.functions.text import identity_property, metadata_map, normalize_predicate, object_label, strip, subject_label
from carbonweave.ontology import FALLBACK_LABEL, QUERY_LABELS
from carbonweave.session import cut


def node_id(label: Column, key: Column) -> Column:
    return F.concat(label, F.lit(":"), key)


def normalize_triples(triples: DataFrame, order: list[str]) -> DataFrame:
    """Predicate, ends and labels of each triple; `pos` orders the triples for last-writer-wins. Blank ends stay and are marked."""
    p = normalize_predicate(F.col("predicate"))
    t = triples.select(strip(F.col("subject")).alias("subject"), p.alias("type"), strip(F.col("object_value")).alias("object"), metadata_map(F.col("metadata")).alias("props"), F.struct(*order).alias("pos"))
    return t.withColumn("skipped", (F.col("subject") == "") | (F.col("object") == "")).withColumn("src_label", subject_label(F.col("type"))).withColumn("dst_label", object_label(F.col("type")))


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def from_triples(triples: DataFrame, order: list[str], with_props: bool = True) -> Graph:
        t = normalize_triples(triples, order).where(~F.col("skipped"))
        ends = F.explode(F.array(F.struct(F.col("src_label").alias("label"), F.col("subject").alias("key")), F.struct(F.col("dst_label").alias("label"), F.col("object").alias("key"))))
        nodes = t.select(ends.alias("end")).select("end.label", "end.key").distinct().select(node_id(F.col("label"), F.col("key")).alias("node_id"), "label", "key")
        e = t.select(node_id(F.col("src_label"), F.col("subject")).alias("src"), "type", node_id(F.col("dst_label"), F.col("object")).alias("dst"), "props", "pos")
        return Graph(nodes, merge_edges(e) if with_props else e.select("src", "type", "dst").distinct())

    def written(self) -> Graph:
        """The graph with its edges written once to the shared folder and its nodes read off their ends.

        For queries that use the whole graph several times; every node of a graph from triples has an edge.
        """
        edges = cut(self.edges)
        ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
        at = F.instr("node_id", ":")
        return Graph(ends.select("node_id", F.substr("node_id", F.lit(1), at - 1).alias("label"), F.substr("node_id", at + 1).alias("key")), edges)

    def label(self, label: str) -> DataFrame:
        if label not in QUERY_LABELS:
            raise ValueError(f"unknown label {label}")
        return self.nodes.where(F.col("label") == label)

    def pattern(self, a: str, types: list[str], b: str, left: str = "a", right: str = "b") -> DataFrame:
        """(a:label)-[:type]->(b:label) with the keys of both ends; labels are part of node ids, so no node join is needed."""
        e = self.edges.where(F.col("type").isin(*types) & F.col("src").startswith(f"{a}:") & F.col("dst").startswith(f"{b}:"))
        return e.select(F.substring("src", len(a) + 2, 1 << 30).alias(left), F.substring("dst", len(b) + 2, 1 << 30).alias(right))

    def incident(self, node: str) -> DataFrame:
        """Edges at a node in either direction; a self-loop comes once."""
        return self.edges.where((F.col("src") == node) | (F.col("dst") == node))

    def with_props(self) -> Graph:
        """The graph whose nodes carry their properties as props; at first the one that identifies them."""
        if "props" in self.nodes.columns:
            return self
        return self.with_nodes(self.nodes.withColumn("props", F.create_map(identity_property(F.col("label")), F.col("key"))))

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return replace(self, nodes=nodes)


def merge_edges(e: DataFrame) -> DataFrame:
    """One edge per (src, type, dst); of each property the value written last."""
    # A null key keeps edges without properties; partial aggregation absorbs edges that are written over and over.
    flat = e.select("src", "type", "dst", "pos", F.explode_outer("props").alias("k", "v"))
    last = flat.groupBy("src", "type", "dst", "k").agg(F.max_by("v", "pos").alias("v"))
    pairs = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))
    return last.groupBy("src", "type", "dst").agg(F.map_from_entries(pairs).alias("props"))


def node_rows(nodes: DataFrame) -> DataFrame:
    """id, label, name, properties: what a node looks like to a reader; properties without nulls."""
    p = F.col("props")
    name = F.coalesce(F.nullif(F.try_element_at(p, F.lit("name")), F.lit("")), F.nullif(F.try_element_at(p, F.lit("value")), F.lit("")), "node_id")
    return nodes.select(F.col("node_id").alias("id"), F.coalesce("label", F.lit(FALLBACK_LABEL)).alias("label"), name.alias("name"), F.map_filter(p, lambda k, v: v.isNotNull()).alias("properties"))


def edge_rows(edges: DataFrame) -> DataFrame:
    """source, target, type, properties without nulls."""
    return edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "type", F.map_filter("props", lambda k, v: v.isNotNull()).alias("properties"))


def list_nodes(graph: Graph, label: str | None = None, skip: int = 0, limit: int = 50) -> DataFrame:
    """A page of nodes in order of label and key."""
    if skip < 0 or not 1 <= limit <= 500:
        raise ValueError("skip must be 0 or more and limit 1..500")
    nodes = graph.with_props().nodes if label is None else graph.with_props().label(label)
    return node_rows(nodes.orderBy("label", "key").offset(skip).limit(limit))


def merge_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Adds the nodes that are not there yet."""
    missing = new.select("node_id", "label", "key").distinct().join(nodes.select("node_id"), "node_id", "left_anti")
    return nodes.unionByName(missing, allowMissingColumns=True)


def one_row(*parts: DataFrame) -> DataFrame:
    """Several one-row results side by side: stacked with nulls, then folded into one row."""
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def broken_keys(nodes: DataFrame) -> DataFrame:
    """The uniqueness constraint as a post-condition: empty unless a (label, key) occurs twice."""
    return nodes.groupBy("label", "key").count().where("count > 1")


def ingest_stats(triples: DataFrame, file: str, order: list[str]) -> DataFrame:
    """processed, written and skipped per file and in total (file null)."""
    t = normalize_triples(triples.withColumn("cw_file", F.col(file)), ["cw_file", *order])
    return t.select(F.col("pos.cw_file").alias("file"), "skipped").rollup("file").agg(F.count("*").alias("processed"), F.count_if(~F.col("skipped")).alias("written"), F.count_if("skipped").alias("skipped"), F.grouping("file").alias("is_total"))
