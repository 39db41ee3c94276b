"""Supplier upsert and geocode enrichment as set-based joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carbonweave.functions.text import merged
from carbonweave.operators.graph import Graph, node_id
from carbonweave.session import small

REFRESHED = ("annual_spend_usd", "supply_chain_tier", "contract_active")
CREATED_ONLY = ("spend_category", "region", "source", "erp_loaded")


def latest_records(erp: DataFrame, name: str, order: list[str]) -> DataFrame:
    """One record per supplier: re-sent rows give way to the one written last."""
    rest = [c for c in erp.columns if c != name]
    return erp.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(name).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(name, "r.*")


def upsert_suppliers(nodes: DataFrame, erp: DataFrame) -> DataFrame:
    """Company nodes after the load, with was_new (null where the load did not touch the node).

    nodes: key and optional supplier columns. erp: supplier_name, annual_spend_usd, spend_category,
    region, tier, contract_active. A new supplier gets all properties; of one that exists only spend,
    tier and contract are refreshed.
    """
    columns = (*REFRESHED, *CREATED_ONLY)
    kinds = {"annual_spend_usd": "double", "supply_chain_tier": "int", "contract_active": "boolean", "erp_loaded": "boolean"}
    have = nodes.select("key", F.lit(True).alias("there"), *[(F.col(c) if c in nodes.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(f"o_{c}") for c in columns])
    new = erp.select(F.col("supplier_name").alias("key"), F.lit(True).alias("sent"), F.col("annual_spend_usd").alias("n_annual_spend_usd"), F.col("tier").cast("int").alias("n_supply_chain_tier"), F.col("contract_active").alias("n_contract_active"), F.col("spend_category").alias("n_spend_category"), F.col("region").alias("n_region"), F.lit("ERP").alias("n_source"), F.lit(True).alias("n_erp_loaded"))
    j = have.join(new, "key", "full")
    sent, there = F.coalesce("sent", F.lit(False)), F.coalesce("there", F.lit(False))
    refreshed = [F.when(sent, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in REFRESHED]
    created = [F.when(sent & ~there, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in CREATED_ONLY]
    return j.select("key", *refreshed, *created, F.when(sent, ~there).alias("was_new"))


def upsert_stats(upserted: DataFrame) -> DataFrame:
    return upserted.agg(F.count_if("was_new").alias("created"), F.count_if(~F.col("was_new")).alias("updated"), F.lit(0).cast("bigint").alias("errors"))


def _amount(c: str, kind: str) -> F.Column:
    return F.col(c).cast(kind).cast("string")


def load_suppliers(graph: Graph, erp: DataFrame) -> Graph:
    """The graph with supplier records on its Company nodes; names without a node get one.

    A node that is created takes all properties; one that exists only spend, tier and contract. erp: one
    row per supplier_name.
    """
    refreshed = [F.lit("annual_spend_usd"), _amount("annual_spend_usd", "decimal(20,2)"), F.lit("supply_chain_tier"), _amount("tier", "int"), F.lit("contract_active"), F.col("contract_active").cast("string")]
    created = [F.lit("erp_loaded"), F.lit("true"), F.lit("spend_category"), F.col("spend_category"), F.lit("region"), F.col("region"), F.lit("source"), F.lit("ERP")]
    is_new = lambda v: [F.lit("_is_new"), F.lit(v)]
    sent = erp.select(node_id(F.lit("Company"), F.col("supplier_name")).alias("node_id"), F.col("supplier_name").alias("sent_key"), F.create_map(*is_new("false"), *refreshed).alias("on_match"), F.create_map(F.lit("name"), F.col("supplier_name"), *is_new("true"), *refreshed, *created).alias("on_create"))
    j = graph.with_props().nodes.join(sent, "node_id", "full")
    props = F.when(F.col("sent_key").isNull(), F.col("props")).when(F.col("key").isNull(), F.map_filter("on_create", lambda k, v: v.isNotNull())).otherwise(merged(F.col("props"), F.col("on_match")))
    return graph.with_nodes(j.select("node_id", F.coalesce("label", F.lit("Company")).alias("label"), F.coalesce("key", "sent_key").alias("key"), props.alias("props")))


def load_coordinates(graph: Graph, labels: tuple[str, ...], gazetteer: DataFrame) -> Graph:
    """The graph with latitude and longitude, or geocode_failed, on the nodes of the labels that lack them."""
    g = graph.with_props()
    here = gazetteer.select(F.col("name").alias("key"), _amount("latitude", "decimal(12,6)").alias("lat"), _amount("longitude", "decimal(12,6)").alias("lon")).dropDuplicates(["key"]).withColumn("found", F.lit(True))
    have = lambda k: F.try_element_at("props", F.lit(k))
    work = F.col("label").isin(*labels) & (have("latitude").isNull() | have("longitude").isNull()) & (F.coalesce(have("geocode_failed"), F.lit("false")) != "true")
    j = g.nodes.withColumn("work", work).join(small(here), "key", "left")
    placed = F.create_map(F.lit("latitude"), F.col("lat"), F.lit("longitude"), F.col("lon"))
    failed = F.create_map(F.lit("geocode_failed"), F.lit("true"))
    props = F.when(~F.col("work"), F.col("props")).when(F.coalesce("found", F.lit(False)), merged(F.col("props"), placed)).otherwise(merged(F.col("props"), failed))
    return g.with_nodes(j.select("node_id", "label", "key", props.alias("props")))


def geocoded(graph: Graph) -> DataFrame:
    """label, name, latitude, longitude, props of every node with coordinates, whatever its label."""
    at = lambda k: F.try_element_at("props", F.lit(k)).try_cast("double").alias(k)
    return graph.with_props().nodes.select("label", F.col("key").alias("name"), at("latitude"), at("longitude"), "props").where("latitude is not null and longitude is not null")


def geocode(nodes: DataFrame, label: str, gazetteer: DataFrame) -> DataFrame:
    """Nodes of the label that lack coordinates and are not marked failed, looked up by name: latitude, longitude, geocode_failed.

    gazetteer: name, latitude, longitude; a name that is missing is a failure.
    """
    have = {"latitude": "double", "longitude": "double", "geocode_failed": "boolean"}
    n = nodes.where(F.col("label") == label).select("key", *[(F.col(c) if c in nodes.columns else F.lit(None)).cast(k).alias(c) for c, k in have.items()])
    work = n.where((F.col("latitude").isNull() | F.col("longitude").isNull()) & ~F.coalesce("geocode_failed", F.lit(False))).select("key")
    g = gazetteer.select(F.col("name").alias("key"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).dropDuplicates(["key"])
    return work.join(small(g), "key", "left").select("key", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("lat").isNull().alias("geocode_failed"))


def geo_stats(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("attempted"), F.count("latitude").alias("geocoded"), F.count_if("geocode_failed").alias("failed"))
