"""Bounded neighbourhoods by level-wise expansion; paths are never enumerated.

An edge lies on a trail of at most h steps from the root exactly if its nearer end is within h - 1
steps, and a node if it is within h: so h joins with a visited set replace the enumeration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carbonweave.operators.graph import Graph
from carbonweave.session import cut

MOST_HOPS = 3
MOST_CHAIN = 500


def distances(graph: Graph, root: str, hops: int) -> DataFrame:
    """node_id, dist of every node within `hops` undirected steps of the root."""
    if not 1 <= hops <= MOST_HOPS:
        raise ValueError(f"hops must be 1..{MOST_HOPS}")
    e = graph.edges.select("src", "dst")
    # Each level is written before the next reads it twice; levels hold node ids only.
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = graph.nodes.where(F.col("node_id") == root).select("node_id", F.lit(0).alias("dist"))
    for k in range(1, hops + 1):
        front = seen.where(F.col("dist") == k - 1).select(F.col("node_id").alias("src"))
        found = both.join(front, "src").select(F.col("dst").alias("node_id")).distinct()
        seen = cut(seen.unionByName(found.join(seen, "node_id", "left_anti").withColumn("dist", F.lit(k))))
    return seen


def ego(graph: Graph, root: str, hops: int, limit: int = 200) -> Graph:
    """The nodes nearest to the root (at most `limit`, by distance, label, key) and the edges among them that a trail of `hops` steps can use."""
    near = distances(graph, root, hops)
    kept = cut(near.join(graph.nodes, "node_id").orderBy("dist", "label", "key").limit(limit))
    d = kept.select("node_id", "dist")
    e = graph.edges.select("src", "type", "dst").distinct()
    e = e.join(d.select(F.col("node_id").alias("src"), F.col("dist").alias("ds")), "src").join(d.select(F.col("node_id").alias("dst"), F.col("dist").alias("dd")), "dst")
    edges = e.where(F.least("ds", "dd") <= hops - 1).select("src", "type", "dst")
    touched = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id"))).distinct()
    return Graph(kept.join(touched, "node_id", "left_semi"), edges)


def node_detail(graph: Graph, label: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The node and its edges in either direction, with their properties; both empty where there is none."""
    node = graph.label(label).where(F.col("key") == key)
    return node, graph.incident(f"{label}:{key}")


def supply_chain(graph: Graph, limit: int = MOST_CHAIN) -> DataFrame:
    """Edges between companies that supply one another, in order of their ends."""
    if not 1 <= limit <= MOST_CHAIN:
        raise ValueError(f"limit must be 1..{MOST_CHAIN}")
    pairs = graph.edges.where(F.col("type").isin("HAS_SUPPLIER", "SUPPLIES_TO") & F.col("src").startswith("Company:") & F.col("dst").startswith("Company:"))
    return pairs.orderBy("src", "type", "dst").limit(limit)


def supply_chain_nodes(graph: Graph, chain: DataFrame) -> DataFrame:
    """The nodes at the ends of a chain's edges, each once."""
    ends = chain.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return graph.with_props().nodes.join(ends, "node_id", "left_semi")
