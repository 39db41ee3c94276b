"""Composite statistics over a graph: summary, emissions, categories, targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carbonweave.functions.text import to_number
from carbonweave.operators.graph import Graph, one_row

MOST_EMISSIONS = 500


def summary(graph: Graph) -> DataFrame:
    """One row of seven counts; suppliers are the companies with a tier."""
    graph = graph.with_props()
    tier = F.try_element_at("props", F.lit("supply_chain_tier"))
    by = lambda label: F.count_if(F.col("label") == label)
    n = graph.nodes.agg(F.count("*").alias("total_nodes"), by("Company").alias("companies"), by("EmissionMetric").alias("emission_metrics"), by("Region").alias("regions"), by("Facility").alias("facilities"), F.count_if((F.col("label") == "Company") & tier.isNotNull()).alias("suppliers"))
    e = graph.edges.agg(F.count("*").alias("total_relationships"))
    return one_row(n, e).select("total_nodes", "total_relationships", "companies", "emission_metrics", "regions", "facilities", "suppliers")


def emission_rows(graph: Graph) -> DataFrame:
    """company, metric, year, scope: the metric's year and scope are optional, each all or nothing."""
    base = graph.pattern("Company", ["REPORTS_EMISSION"], "EmissionMetric", "company", "metric")
    year = graph.pattern("EmissionMetric", ["MEASURED_IN_YEAR"], "Year", "metric", "year")
    scope = graph.pattern("EmissionMetric", ["FALLS_UNDER_SCOPE"], "Scope", "metric", "scope")
    return base.join(year, "metric", "left").join(scope, "metric", "left").select("company", "metric", "year", "scope")


def emissions(graph: Graph, limit: int = 50, mode: str = "fixed") -> DataFrame:
    """company, value, unit, year, scope of the largest metrics.

    fixed: unparseable values are left out before the cut. compat: they sort first, take up places, and
    go only after the cut.
    """
    if not 1 <= limit <= MOST_EMISSIONS and mode == "fixed":
        raise ValueError(f"limit must be 1..{MOST_EMISSIONS}")
    rows = emission_rows(graph).withColumn("value", to_number(F.col("metric")))
    ties = ["company", F.col("year").asc_nulls_first(), F.col("scope").asc_nulls_first(), "metric"]
    if mode == "compat":
        cut = rows.orderBy(F.col("value").desc_nulls_first(), *ties).limit(limit).where("value is not null")
    else:
        cut = rows.where("value is not null").orderBy(F.col("value").desc(), *ties).limit(limit)
    return cut.select("company", "value", F.lit("tCO2e").alias("unit"), F.coalesce("year", F.lit("unknown")).alias("year"), F.coalesce("scope", F.lit("unknown")).alias("scope"))


def categories(graph: Graph) -> DataFrame:
    p = graph.pattern("EmissionMetric", ["BELONGS_TO_CATEGORY"], "Category", "metric", "category")
    return p.where("category <> ''").groupBy("category").agg(F.count("metric").alias("count")).orderBy(F.desc("count"), "category")


def targets(graph: Graph) -> DataFrame:
    """company, target_year, description; targets carry no year of their own, so a company's collapse into one."""
    years = graph.pattern("Company", ["COMMITS_TO_NET_ZERO"], "Year", "company", "target_year")
    aims = graph.pattern("Company", ["SETS_TARGET"], "Target", "company", "target").select("company", F.lit("unknown").alias("target_year"))
    return years.unionByName(aims).withColumn("description", F.lit("")).distinct().orderBy("target_year", "company", "description")
