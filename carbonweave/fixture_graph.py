"""The emissions graph projected from the star-schema tables, so every graph query has a large input.

Suppliers and customers are companies; a metric is a supplier's shipped quantity per year, return flag
and line status, unparseable for open lines; regions, scopes, years, categories and targets follow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonweave.operators.graph import Graph
from carbonweave.session import table


def _triple(df: DataFrame, subject: F.Column, predicate: str, obj: F.Column) -> DataFrame:
    return df.select(subject.alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object_value"))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """l_suppkey, year, l_returnflag, l_linestatus, value."""
    li = table(spark, d, "lineitem")
    g = li.groupBy("l_suppkey", F.year("l_shipdate").cast("string").alias("year"), "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("bigint").cast("string").alias("q"))
    return g.select("l_suppkey", "year", "l_returnflag", "l_linestatus", F.concat("q", F.when(F.col("l_linestatus") == "O", " tCO2e").otherwise("")).alias("value"))


def triples(spark: SparkSession, d: str) -> DataFrame:
    """The projection as triples with empty metadata and no order of writing."""
    supplier, customer, nation, region = (table(spark, d, t) for t in ("supplier", "customer", "nation", "region"))
    m = metrics(spark, d)
    named = m.join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    scope = F.concat(F.lit("Scope "), F.when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "N", "2").otherwise("3"))
    types = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    shipped = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").cast("string").alias("year"), "l_returnflag", "l_linestatus", "l_partkey").join(types, "l_partkey").select("l_suppkey", "year", "l_returnflag", "l_linestatus", "p_type").distinct()
    categories = m.join(shipped, ["l_suppkey", "year", "l_returnflag", "l_linestatus"])
    targets = shipped.select("l_suppkey", "p_type").distinct().join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    where = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    parts = [
        _triple(named, F.col("s_name"), "REPORTS_EMISSION", F.col("value")),
        _triple(m, F.col("value"), "MEASURED_IN_YEAR", F.col("year")),
        _triple(m, F.col("value"), "FALLS_UNDER_SCOPE", scope),
        _triple(categories, F.col("value"), "BELONGS_TO_CATEGORY", F.col("p_type")),
        _triple(supplier, F.col("s_name"), "COMMITS_TO_NET_ZERO", (2030 + F.col("s_suppkey") % 21).cast("string")),
        _triple(targets, F.col("s_name"), "SETS_TARGET", F.concat(F.lit("Reduce "), "p_type")),
        _triple(top_suppliers(spark, d), F.col("c_name"), "HAS_SUPPLIER", F.col("s_name")),
        _triple(supplier.join(where, supplier.s_nationkey == where.n_nationkey), F.col("s_name"), "OPERATES_IN", F.col("r_name")),
        _triple(customer.join(where, customer.c_nationkey == where.n_nationkey), F.col("c_name"), "OPERATES_IN", F.col("r_name")),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("metadata", F.lit(None).cast("map<string,string>")).withColumn("pos", F.lit(0))


def sales(spark: SparkSession, d: str) -> DataFrame:
    """l_suppkey, o_custkey, qty."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(o, "l_orderkey").groupBy("o_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("qty"))


def top_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's one supplier by quantity, the smaller key on a tie."""
    best = sales(spark, d).groupBy("o_custkey").agg(F.max_by("l_suppkey", F.struct(F.col("qty"), -F.col("l_suppkey"))).alias("s_suppkey"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return best.join(c, "o_custkey").join(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select("c_name", "s_name")


def graph(spark: SparkSession, d: str) -> Graph:
    return Graph.from_triples(triples(spark, d), ["pos"], with_props=False)


#: The same projection for the SQL oracle: tri, then nodes and edges.
SQL = """
em as (select l_suppkey, cast(year(l_shipdate) as varchar) yr, l_returnflag rf, l_linestatus ls,
  cast(cast(sum(l_quantity) as bigint) as varchar) || case when l_linestatus = 'O' then ' tCO2e' else '' end val
  from lineitem group by l_suppkey, year(l_shipdate), l_returnflag, l_linestatus),
shipped as (select distinct l_suppkey, cast(year(l_shipdate) as varchar) yr, l_returnflag rf, l_linestatus ls, p_type from lineitem join part on p_partkey = l_partkey),
sold as (select o_custkey, l_suppkey, sum(l_quantity) qty from lineitem join orders on o_orderkey = l_orderkey group by 1, 2),
best as (select o_custkey, l_suppkey from (select *, row_number() over (partition by o_custkey order by qty desc, l_suppkey) rn from sold) where rn = 1),
place as (select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey),
tri as (
  select s_name s, 'REPORTS_EMISSION' p, val o from em join supplier on s_suppkey = l_suppkey
  union select val, 'MEASURED_IN_YEAR', yr from em
  union select val, 'FALLS_UNDER_SCOPE', case rf when 'A' then 'Scope 1' when 'N' then 'Scope 2' else 'Scope 3' end from em
  union select val, 'BELONGS_TO_CATEGORY', p_type from em join shipped using (l_suppkey, yr, rf, ls)
  union select s_name, 'COMMITS_TO_NET_ZERO', cast(2030 + s_suppkey % 21 as varchar) from supplier
  union select s_name, 'SETS_TARGET', 'Reduce ' || p_type from shipped join supplier on s_suppkey = l_suppkey
  union select c_name, 'HAS_SUPPLIER', s_name from best join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
  union select s_name, 'OPERATES_IN', r_name from supplier join place on n_nationkey = s_nationkey
  union select c_name, 'OPERATES_IN', r_name from customer join place on n_nationkey = c_nationkey),
lab as (select case when p in ('MEASURED_IN_YEAR', 'FALLS_UNDER_SCOPE', 'BELONGS_TO_CATEGORY') then 'EmissionMetric' else 'Company' end sl, s, p,
  case p when 'REPORTS_EMISSION' then 'EmissionMetric' when 'MEASURED_IN_YEAR' then 'Year' when 'FALLS_UNDER_SCOPE' then 'Scope' when 'BELONGS_TO_CATEGORY' then 'Category'
    when 'COMMITS_TO_NET_ZERO' then 'Year' when 'SETS_TARGET' then 'Target' when 'HAS_SUPPLIER' then 'Company' when 'OPERATES_IN' then 'Region' end ol, o from tri),
edges as (select sl || ':' || s src, p as type, ol || ':' || o dst from lab),
nodes as (select distinct label || ':' || key node_id, label, key from (select sl label, s key from lab union select ol, o from lab))
"""
