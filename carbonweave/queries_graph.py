"""Registered queries of the graph engine and the SQL that must give the same rows.

Keys are operator ids of the blueprint plus a slug. Two graphs serve as inputs: the projection of the
star schema (fixture_graph) and the report triples.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carbonweave import fixture_graph
from carbonweave.functions import text as X
from carbonweave.ontology import DETAIL_HIDDEN, LABELS, MAP_HIDDEN, OBJECT_LABELS, QUERY_LABELS, REGIONS, SPEND_CATEGORIES, SUBJECT_LABELS, SUGGESTIONS
from carbonweave.operators import chunking, enrich, resolve, search, traverse
from carbonweave.operators.graph import Graph, broken_keys, edge_rows, ingest_stats, list_nodes, merge_nodes, node_rows, normalize_triples, one_row
from carbonweave.plans import context, stats
from carbonweave.session import checkpoint_dir, cut, small, table
from carbonweave.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TRIPLES = "chipotle_2024_triples"
ROOT = "Supplier#000000001"


def query(name: str, sql: str | None = None, graph: bool = False, triples: bool = False, enriched: bool = False) -> Callable[[Query], Query]:
    """Registers a query; graph, triples and enriched put the shared table expressions ahead of its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            head = [*([fixture_graph.SQL.strip()] if graph else []), *([_NTRI] if triples or enriched else []), *([_ENRICHED] if enriched else [])]
            recursive = "recursive " if "recursive" in sql.split("select")[0] else ""
            body = sql.strip().replace("with recursive ", "with ", 1)
            SQL[name] = (f"with {recursive}" + ",\n".join(head) + (",\n" + body[5:] if body.startswith("with ") else "\n" + body)) if head else body
        return f

    return add


def _case(table_: dict[str, str], default: str) -> str:
    return "case p " + " ".join(f"when '{k}' then '{v}'" for k, v in table_.items()) + f" else '{default}' end"


_PRED = "coalesce(nullif(trim(regexp_replace(regexp_replace(translate(upper(predicate), ' -', '__'), '[^A-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'RELATED_TO')"
_STRIP = lambda c: f"coalesce(regexp_replace({c}, '^{X.BLANKS}+|{X.BLANKS}+$', '', 'g'), '')"
_NTRI = f"""raw as (select triple_id, source_file, metadata, {_STRIP("subject")} s, {_PRED} p, {_STRIP("object_value")} o from {TRIPLES}),
ntri as (select *, {_case(SUBJECT_LABELS, "Company")} sl, {_case(OBJECT_LABELS, "Entity")} ol from raw where s <> '' and o <> ''),
tnodes as (select distinct label || ':' || key node_id, label, key from (select sl label, s key from ntri union all select ol, o from ntri)),
tedges as (select distinct sl || ':' || s src, p as type, ol || ':' || o dst from ntri)"""
_LATEST = "erp as (select * exclude rn from (select *, row_number() over (partition by supplier_name order by updated_at desc, erp_id desc) rn from erp_records where supplier_name is not null and supplier_name <> '') where rn = 1)"
_LAST_EDGE_PROPS = """em_all as (select sl || ':' || s source, ol || ':' || o target, p as type, triple_id, unnest(map_keys(metadata)) k, unnest(map_values(metadata)) v from ntri),
em_last as (select source, target, type, k, arg_max(v, triple_id) v from em_all where v is not null group by all)"""
#: The triple graph with supplier records and coordinates, a row per node and property.
_ENRICHED = f"""{_LATEST},
en_erp as (select *, 'Company:' || supplier_name node_id, 'Company:' || supplier_name not in (select node_id from tnodes) fresh from erp),
en_nodes as (select node_id, label, key from tnodes union all select node_id, 'Company', supplier_name from en_erp where fresh),
en_geo as (select node_id, name is not null hit, cast(cast(latitude as decimal(12, 6)) as varchar) lat, cast(cast(longitude as decimal(12, 6)) as varchar) lon from tnodes left join gazetteer on name = key where label in ('Region', 'Facility')),
en_props as (select node_id, case when label in ('EmissionMetric', 'Year') then 'value' else 'name' end k, key v from en_nodes
  union all select node_id, '_is_new', case when fresh then 'true' else 'false' end from en_erp
  union all select node_id, 'annual_spend_usd', cast(cast(annual_spend_usd as decimal(20, 2)) as varchar) from en_erp where annual_spend_usd is not null
  union all select node_id, 'supply_chain_tier', cast(tier as varchar) from en_erp where tier is not null
  union all select node_id, 'contract_active', case when contract_active then 'true' else 'false' end from en_erp where contract_active is not null
  union all select node_id, 'spend_category', spend_category from en_erp where fresh and spend_category is not null
  union all select node_id, 'region', region from en_erp where fresh and region is not null
  union all select node_id, 'erp_loaded', 'true' from en_erp where fresh
  union all select node_id, 'source', 'ERP' from en_erp where fresh
  union all select node_id, 'latitude', lat from en_geo where lat is not null
  union all select node_id, 'longitude', lon from en_geo where lon is not null
  union all select node_id, 'geocode_failed', 'true' from en_geo where not hit)"""
_PROP_TEXT = "coalesce(string_agg(k || '=' || v, ';' order by k || '=' || v), '')"


#: A page of a source stands for a parsed document.
_page = lambda: F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce(F.col("page_no"), F.lit(0)).cast("string"))


def tpch(spark: SparkSession, d: str) -> Graph:
    return fixture_graph.graph(spark, d)


def triple_graph(spark: SparkSession, d: str, with_props: bool = False) -> Graph:
    return Graph.from_triples(table(spark, d, TRIPLES), ["triple_id"], with_props)


def enriched_graph(spark: SparkSession, d: str) -> Graph:
    """The triple graph after the supplier load and the enrichment of places."""
    g = enrich.load_suppliers(triple_graph(spark, d), _erp(spark, d))
    return enrich.load_coordinates(g, ("Region", "Facility"), table(spark, d, "gazetteer"))


def _shared(spark: SparkSession, d: str, what: str) -> str:
    """A folder below the shared one, the same at every run over the same tables."""
    return f"{checkpoint_dir(spark)}/{what}-{zlib.crc32(d.encode())}"


def _text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("properties", X.entries_text(F.col("properties")))


#: Pairs of company names by dynamic programming, letter by letter, over the pairs whose letters as bags could reach the threshold.
def _pairs_sql(threshold: float) -> str:
    return f"""nm as (select key as name, array_to_string(list_sort(list_filter(string_split_regex(key, '{X.BLANKS}+'), lambda t: t <> '')), ' ') as form from tnodes where label = 'Company'),
fm as (select form, string_split(form, '') as cs, length(form) as n, row_number() over (order by form) as id from (select distinct form from nm)),
bag as (select id, n, c || row_number() over (partition by id, c) as letter from (select id, n, unnest(cs) as c from fm)),
near as (select x.id as a, y.id as b from bag x join bag y using (letter) where x.id < y.id group by x.id, y.id, x.n, y.n having 200.0 * count(*) / (x.n + y.n) >= {threshold}),
dp(a, b, i, lcs) as (select a, b, 0, list_transform(range(0, (select n from fm where id = b) + 1), lambda k: 0) from near
  union all select a, b, i + 1, [0] || list_transform(range(1, len(best) + 1), lambda k: list_max(best[1 : k]))
  from (select d.a, d.b, d.i, list_transform(range(1, len(d.lcs)), lambda k: greatest(d.lcs[k + 1], d.lcs[k] + case when x.cs[d.i + 1] = y.cs[k] then 1 else 0 end)) as best from dp d join fm x on x.id = d.a join fm y on y.id = d.b where d.i < x.n)),
met as (select x.form as fa, y.form as fb, 200.0 * lcs[-1] / (x.n + y.n) as score from dp join fm x on x.id = dp.a join fm y on y.id = dp.b where i = x.n and 200.0 * lcs[-1] / (x.n + y.n) >= {threshold} union all select form, form, 100.0 from fm),
both_ as (select distinct least(p.name, q.name) as a, greatest(p.name, q.name) as b, cast(score as double) as score from met join nm p on p.form = fa join nm q on q.form = fb where p.name <> q.name),
pairs as (select case when length(a) >= length(b) then a else b end as canonical, case when length(a) >= length(b) then b else a end as duplicate, score from both_)"""


_PAIRS = _pairs_sql(85)
_CLOSED = f"""{_PAIRS},
reach(a, b) as (select canonical, duplicate from pairs union select duplicate, canonical from pairs union select r.a, p.other from reach r join (select canonical as one, duplicate as other from pairs union select duplicate, canonical from pairs) p on p.one = r.b),
class as (select a as name, arg_min(b, (-length(b), b)) as canonical from (select a, b from reach union select a, a from reach) group by a),
map as (select 'Company:' || name as dup, 'Company:' || canonical as can from class where name <> canonical)"""


# --- 2.1 sources and sinks ---------------------------------------------------------------------


@query("sc1_corpus_scan", "select doc_id, source, lang from documents where element_type = 'Table'")
def _(spark, d):
    return table(spark, d, "documents").where("element_type = 'Table'").select("doc_id", "source", "lang")


@query("sc2_first_n_distinct", "with f as (select source, min(doc_id) doc_id from documents where source is not null group by source) select source, doc_id from f order by doc_id limit 5")
def _(spark, d):
    return files.first_n_distinct(table(spark, d, "documents"), "source", ["doc_id"], 5)


@query("sc4_binary_scan")
def _(spark, d):
    return files.read_reports(spark, d, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


@query("sc5_chunks")
def _(spark, d):
    return chunking.chunks(table(spark, d, "documents"), "doc_id", "text")


@query(
    "sc5_title_sections",
    """with e as (select coalesce(source, '') || '|' || coalesce(page_no, 0) as doc, doc_id, text, sum(case when element_type = 'Title' then 1 else 0 end) over (partition by coalesce(source, '') || '|' || coalesce(page_no, 0) order by doc_id) as section from documents)
select doc, cast(section as bigint) as section, string_agg(text, chr(10) || chr(10) order by doc_id) as text from e where trim(text, ' ') <> '' group by all""",
)
def _(spark, d):
    return chunking.title_sections(table(spark, d, "documents"), _page(), ["doc_id"])


@query("sc5_chunks_by_title")
def _(spark, d):
    return chunking.chunks_by_title(table(spark, d, "documents"), _page(), ["doc_id"])


@query("sc5_paragraphs", r"""with s as (select doc_id as doc, unnest(string_split_regex(text, '\n\s*\n')) paragraph, generate_subscripts(string_split_regex(text, '\n\s*\n'), 1) - 1 as pos from documents)
select doc, cast(pos as integer) pos, paragraph from s where trim(paragraph) <> ''""")
def _(spark, d):
    return chunking.paragraphs(table(spark, d, "documents"), "doc_id", "text")


@query("sc6_sc7_elements_roundtrip", "select element_type as type, count(*) n, sum(length(text)) chars from documents where element_type is not null and text is not null group by 1")
def _(spark, d):
    docs = table(spark, d, "documents").where("element_type is not null and text is not null").select(F.col("element_type").alias("type"), "text", "lang")
    path = _shared(spark, d, "elements")
    docs.coalesce(8).write.mode("overwrite").json(path)
    return spark.read.schema("type string, text string").json(path).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("sc8_sc9_triples_roundtrip", f"select predicate, count(*) n from {TRIPLES} where predicate is not null group by 1")
def _(spark, d):
    path = _shared(spark, d, "triples")
    files.write_triples(table(spark, d, TRIPLES).select("subject", "predicate", "object_value", "metadata"), path)
    return spark.read.schema("predicate string").json(path).where("predicate is not null").groupBy("predicate").agg(F.count("*").alias("n"))


@query("sc10_incremental_pending", "select doc_id from documents where doc_id not in (select doc_id from documents where parsed_at < timestamp '2024-04-01')")
def _(spark, d):
    docs = table(spark, d, "documents")
    return files.pending(docs.select("doc_id"), docs.where("parsed_at < timestamp_ntz '2024-04-01'"), "doc_id")


@query("sc11_graph_sink", "select 'edges' as part, type as name, count(*) n from edges group by type union all select 'nodes', label, count(*) from nodes group by label", graph=True)
def _(spark, d):
    g = tpch(spark, d)
    path = _shared(spark, d, "graph")
    files.write_graph(g.nodes, g.edges.distinct(), path)
    n = spark.read.parquet(f"{path}/nodes").groupBy("label").count().select(F.lit("nodes").alias("part"), F.col("label").alias("name"), F.col("count").alias("n"))
    e = spark.read.parquet(f"{path}/edges").groupBy("type").count().select(F.lit("edges").alias("part"), F.col("type").alias("name"), F.col("count").alias("n"))
    return n.unionByName(e)


_HASH = lambda salt: f"(('0x' || substr(md5('{salt}' || s_name), 1, 8))::bigint % 1000003)"
_PICK = lambda salt, xs: f"{list(xs)}[{_HASH(salt)} % {len(xs)} + 1]"


@query(
    "sc13_erp_source",
    f"""select s_name as supplier_name, round(500000 + {_HASH("spend")} * 49.5, 2) as annual_spend_usd, {_PICK("category", SPEND_CATEGORIES)} as spend_category, {_PICK("region", REGIONS)} as region,
cast(case when {_HASH("tier")} % 5 < 3 then 1 else 2 end as integer) as tier, {_HASH("active")} % 4 <> 0 as contract_active from (select distinct s_name from supplier order by s_name limit 20)""",
)
def _(spark, d):
    return files.erp_fixture(table(spark, d, "supplier"), "s_name", list(SPEND_CATEGORIES), list(REGIONS))


@query("sc14_geocode_lookup", "select c.name, g.latitude, g.longitude from (select distinct region as name from erp_records where region is not null) c left join gazetteer g on g.name = c.name")
def _(spark, d):
    names = table(spark, d, "erp_records").where("region is not null").select(F.col("region").alias("name")).distinct()
    return names.join(small(table(spark, d, "gazetteer")), "name", "left").select("name", "latitude", "longitude")


@query("sc15_parameterised_sql", "select s_name, s_acctbal from supplier where s_nationkey = 7 and s_acctbal > 1000")
def _(spark, d):
    return spark.sql("select s_name, s_acctbal from {s} where s_nationkey = :nation and s_acctbal > :least", args={"nation": 7, "least": 1000}, s=table(spark, d, "supplier"))


@query("sc16_json_rows", "select r_regionkey, '{\"r_name\":\"' || r_name || '\"}' as json from region")
def _(spark, d):
    return table(spark, d, "region").select("r_regionkey", F.to_json(F.struct("r_name")).alias("json"))


# --- 2.2 projections ---------------------------------------------------------------------------


@query("pr1_normalize_predicate", f"select distinct predicate, {_PRED} as type from {TRIPLES}")
def _(spark, d):
    return table(spark, d, TRIPLES).select("predicate").distinct().select("predicate", X.normalize_predicate(F.col("predicate")).alias("type"))


@query("pr2_strip", f"select triple_id, {_STRIP('subject')} as subject, {_STRIP('object_value')} as object_value from {TRIPLES}")
def _(spark, d):
    return table(spark, d, TRIPLES).select("triple_id", X.strip(F.col("subject")).alias("subject"), X.strip(F.col("object_value")).alias("object_value"))


@query("pr3_labels", "select sl as subject_label, p as type, ol as object_label, count(*) n from ntri group by all", triples=True)
def _(spark, d):
    t = normalize_triples(table(spark, d, TRIPLES), ["triple_id"]).where("not skipped")
    return t.groupBy(F.col("src_label").alias("subject_label"), "type", F.col("dst_label").alias("object_label")).agg(F.count("*").alias("n"))


@query("pr4_identity_property", "select label, case when label in ('EmissionMetric', 'Year') then 'value' else 'name' end as property, count(*) n from nodes group by all", graph=True)
def _(spark, d):
    return tpch(spark, d).nodes.groupBy("label", X.identity_property(F.col("label")).alias("property")).agg(F.count("*").alias("n"))


@query("pr5_metadata_map", f"select triple_id, coalesce(cardinality(metadata), 0) as n from {TRIPLES}")
def _(spark, d):
    return table(spark, d, TRIPLES).select("triple_id", F.size(X.metadata_map(F.col("metadata"))).cast("bigint").alias("n"))


@query("pr6_empty_to_null", f"select count(*) as rows, count(*) filter (where cardinality(metadata) > 0) as with_metadata from {TRIPLES}")
def _(spark, d):
    return table(spark, d, TRIPLES).agg(F.count("*").alias("rows"), F.count(X.empty_to_null(F.col("metadata"))).alias("with_metadata"))


@query("pr7_node_rows", f"select node_id as id, label, key as name, {_PROP_TEXT} as properties from en_nodes join en_props using (node_id) group by all", enriched=True)
def _(spark, d):
    return _text(node_rows(enriched_graph(spark, d).nodes))


@query(
    "pr8_edge_rows",
    """with m as (select sl || ':' || s source, ol || ':' || o target, p as type, triple_id, unnest(map_keys(metadata)) k, unnest(map_values(metadata)) v from ntri),
l as (select source, target, type, k, arg_max(v, triple_id) v from m where v is not null group by all)
select e.src as source, e.dst as target, e.type, coalesce(string_agg(k || '=' || v, ';' order by k || '=' || v), '') as properties
from tedges e left join l on l.source = e.src and l.target = e.dst and l.type = e.type group by e.src, e.dst, e.type""",
    triples=True,
)
def _(spark, d):
    e = triple_graph(spark, d, True).edges
    return e.select(F.col("src").alias("source"), F.col("dst").alias("target"), "type", X.entries_text(F.map_filter("props", lambda k, v: v.isNotNull())).alias("properties"))


_MAP_EXTRA = f"select label, key as name, (select {_PROP_TEXT} from en_props p where p.node_id = n.node_id and k not in {MAP_HIDDEN}) as extra from en_nodes n where node_id in (select node_id from en_props where k = 'latitude')"


@query("pr9_extra_properties", _MAP_EXTRA, enriched=True)
def _(spark, d):
    g = enrich.geocoded(enriched_graph(spark, d))
    return g.select("label", "name", X.entries_text(X.extra_properties(F.col("props"), MAP_HIDDEN)).alias("extra"))


@query("pr10_constant_column", "select s_name as company, '' as description from supplier")
def _(spark, d):
    return table(spark, d, "supplier").select(F.col("s_name").alias("company"), F.lit("").alias("description"))


@query("pr11_first_label", "select label, count(*) n from nodes group by label", graph=True)
def _(spark, d):
    labels = tpch(spark, d).nodes.select(F.array("label").alias("labels"))
    return labels.select(F.coalesce(F.get("labels", F.lit(0)), F.lit("Entity")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("pr12_property_map", "select erp_id, 'name=' || coalesce(supplier_name, '') || ';tier=' || cast(tier as varchar) as properties from erp_records where tier is not null")
def _(spark, d):
    m = F.map_from_arrays(F.array(F.lit("name"), F.lit("tier")), F.array(F.coalesce("supplier_name", F.lit("")), F.col("tier").cast("string")))
    return table(spark, d, "erp_records").where("tier is not null").select("erp_id", X.entries_text(m).alias("properties"))


@query("pr13_file_name", r"select distinct source, regexp_replace(source, '[^\p{L}\p{N}]', '_', 'g') as safe from documents where source is not null")
def _(spark, d):
    return table(spark, d, "documents").where("source is not null").select("source", X.file_name(F.col("source")).alias("safe")).distinct()


@query("pr14_context_lines", "select string_agg(r_regionkey || '. ' || r_name, chr(10) order by r_regionkey) as text from region")
def _(spark, d):
    lines = table(spark, d, "region").select("r_regionkey", F.format_string("%d. %s", "r_regionkey", "r_name").alias("line"))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query("pr15_prompt", "select n_nationkey, case when n_regionkey > 2 then 'Context:' || chr(10) || n_name || chr(10) || chr(10) || 'Question: ' || n_name else 'No graph context was found.' || chr(10) || chr(10) || 'Question: ' || n_name end as prompt, n_regionkey > 2 as context_used from nation")
def _(spark, d):
    c = F.when(F.col("n_regionkey") > 2, F.col("n_name")).otherwise("")
    return table(spark, d, "nation").select("n_nationkey", context.prompt(c, F.col("n_name")).alias("prompt"), (c != "").alias("context_used"))


@query("pr16_node_display", "select label, case when label = 'Company' then 6 else 3 end as size, count(*) n from nodes group by all", graph=True)
def _(spark, d):
    return tpch(spark, d).nodes.groupBy("label", F.when(F.col("label") == "Company", 6).otherwise(3).alias("size")).agg(F.count("*").alias("n"))


@query("pr17_display_text", "select doc_id, substring(text, 1, 40) as short, printf('%,d', n_chars) as chars from documents where text is not null")
def _(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.substring("text", 1, 40).alias("short"), F.format_number("n_chars", 0).alias("chars"))


SQL["pr17_display_text"] = "select doc_id, substring(text, 1, 40) as short, format('{:,}', n_chars) as chars from documents where text is not null"

# --- 2.3 filters -------------------------------------------------------------------------------


@query("fl1_chunk_filter", "select doc_id, element_type from documents where element_type in ('CompositeElement', 'Table') and length(text) >= 100")
def _(spark, d):
    return chunking.select_chunks(table(spark, d, "documents")).select("doc_id", "element_type")


@query("fl2_blank_triples", f"select count(*) as processed, count(*) filter (where {_STRIP('subject')} = '' or {_STRIP('object_value')} = '') as skipped from {TRIPLES}")
def _(spark, d):
    return normalize_triples(table(spark, d, TRIPLES), ["triple_id"]).agg(F.count("*").alias("processed"), F.count_if("skipped").alias("skipped"))


@query("fl3_label_filter", "select node_id, key from nodes where label = 'Region'", graph=True)
def _(spark, d):
    return tpch(spark, d).label("Region").select("node_id", "key")


@query("fl4_exact_key", f"select node_id, label, key from nodes where label = 'Company' and key = '{ROOT}'", graph=True)
def _(spark, d):
    return traverse.node_detail(tpch(spark, d), "Company", ROOT)[0]


@query("fl5_contains_fold", "select p_partkey, p_name from part where contains(lower(p_name), 'widget')")
def _(spark, d):
    return table(spark, d, "part").where(X.contains_fold(F.col("p_name"), F.lit("WIDGET"))).select("p_partkey", "p_name")


@query("fl6_null_predicates", f"select count(*) filter (where predicate is null) as no_predicate, count(*) filter (where source_file is not null) as with_file from {TRIPLES}")
def _(spark, d):
    return table(spark, d, TRIPLES).agg(F.count_if(F.col("predicate").isNull()).alias("no_predicate"), F.count_if(F.col("source_file").isNotNull()).alias("with_file"))


@query("fl7_three_valued_flag", "select erp_id from erp_records where contract_active is null or contract_active = false")
def _(spark, d):
    return table(spark, d, "erp_records").where(~F.coalesce("contract_active", F.lit(False))).select("erp_id")


@query("fl8_type_disjunction", "select type, count(*) n from tedges where type in ('HAS_SUPPLIER', 'SUPPLIES_TO') group by type", triples=True)
def _(spark, d):
    return triple_graph(spark, d).edges.where(F.col("type").isin("HAS_SUPPLIER", "SUPPLIES_TO")).groupBy("type").agg(F.count("*").alias("n"))


@query("fl9_malformed_rows", rf"select triple_id, cast(trim(object_value) as double) as value from collin_foods_2024_triples where regexp_matches(object_value, '{X.NUMBER}')")
def _(spark, d):
    return table(spark, d, "collin_foods_2024_triples").select("triple_id", X.to_number(F.col("object_value")).alias("value")).where("value is not null")


@query("fl10_drop_empty_groups", "select lang, count(*) n from documents where lang is not null and lang <> '' group by lang")
def _(spark, d):
    return table(spark, d, "documents").where(F.col("lang").isNotNull() & (F.col("lang") != "")).groupBy("lang").agg(F.count("*").alias("n"))


@query("fl11_keyword_trigger", f"select doc_id from documents where regexp_matches(lower(text), '{'|'.join(X.TARGET_WORDS)}')")
def _(spark, d):
    return table(spark, d, "documents").where(X.asks_for_targets(F.col("text"))).select("doc_id")


_CANDIDATES = rf"list_filter(list_transform(regexp_extract_all(text, '{X.CANDIDATE}'), lambda x: regexp_replace(x, '^{X.BLANKS}+|{X.BLANKS}+$', '', 'g')), lambda x: length(x) > 2)"


@query("fl12_candidate_filter", f"select doc_id, len({_CANDIDATES}) as n from documents where text is not null")
def _(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(X.candidate_names(F.col("text"))).cast("bigint").alias("n"))


def _turns(spark, d):
    role = F.when(F.col("event_type") == "view", "user").when(F.col("event_type") == "click", "assistant").otherwise("system")
    return table(spark, d, "events").select("user_id", "event_id", role.alias("role"), F.col("props").alias("content"))


@query(
    "fl13_chat_history",
    """with r as (select user_id, event_id, case event_type when 'view' then 'user' when 'click' then 'assistant' else 'system' end as role, props as content, row_number() over (partition by user_id order by event_id desc) rn from events)
select user_id, event_id, role, substring(content, 1, 500) as content from r where rn <= 10 and role in ('user', 'assistant') and content is not null""",
)
def _(spark, d):
    return context.recent_turns(_turns(spark, d), "user_id", "event_id", "role", "content")


@query("fl14_range_checks", "select key from nodes where label = 'Scope' order by key limit 3", graph=True)
def _(spark, d):
    g = tpch(spark, d)
    for bad in (lambda: stats.emissions(g, 501), lambda: traverse.distances(g, "x", 4), lambda: search.bm25(g.nodes, "key", "q", 101), lambda: traverse.supply_chain(g, 501), lambda: list_nodes(g, None, -1), lambda: list_nodes(g, None, 0, 501), lambda: g.label("Nope")):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError("an argument out of range was accepted")
    return g.label("Scope").select("key").orderBy("key").limit(3)


@query("fl15_self_exclusion", "select src, dst from tedges where type = 'HAS_SUPPLIER' and src <> dst", triples=True)
def _(spark, d):
    return triple_graph(spark, d).edges.where("type = 'HAS_SUPPLIER' and src <> dst").select("src", "dst")


@query("fl16_label_list", "select distinct label from nodes", graph=True)
def _(spark, d):
    return tpch(spark, d).nodes.select("label").distinct()


@query("fl17_hidden_properties", f"select node_id as id, {_PROP_TEXT} as shown from en_props where k not in {DETAIL_HIDDEN} group by node_id", enriched=True)
def _(spark, d):
    return enriched_graph(spark, d).nodes.select(F.col("node_id").alias("id"), X.entries_text(X.extra_properties(F.col("props"), DETAIL_HIDDEN)).alias("shown"))


# --- 2.4 joins and upserts ---------------------------------------------------------------------


@query("jn1_node_merge", "select node_id, label, key from tnodes", triples=True)
def _(spark, d):
    g = triple_graph(spark, d)
    return merge_nodes(g.nodes, g.nodes).select("node_id", "label", "key")


@query("jn2_edge_merge", SQL["pr8_edge_rows"].replace("as source", "as src").replace("as target", "as dst").replace("as properties", "as props"))
def _(spark, d):
    return triple_graph(spark, d, True).edges.select("src", "dst", "type", X.entries_text("props").alias("props"))


def _erp(spark, d):
    return enrich.latest_records(table(spark, d, "erp_records"), "supplier_name", ["updated_at", "erp_id"])


def _upserted(spark, d):
    companies = triple_graph(spark, d).label("Company").select("key", F.lit("old").alias("region"))
    return enrich.upsert_suppliers(companies, _erp(spark, d))


@query(
    "jn3_erp_upsert",
    f"""with {_LATEST}, c as (select key from tnodes where label = 'Company')
select coalesce(c.key, supplier_name) as key, annual_spend_usd, cast(tier as integer) as supply_chain_tier, contract_active,
 case when c.key is null then spend_category end as spend_category, case when c.key is null then erp.region else 'old' end as region,
 case when c.key is null then 'ERP' end as source, case when c.key is null then true end as erp_loaded, case when supplier_name is not null then c.key is null end as was_new
from c full join erp on supplier_name = c.key""",
    triples=True,
)
def _(spark, d):
    return _upserted(spark, d)


@query("jn4_edge_pattern", "select substr(src, 9) as company, substr(dst, 8) as region from edges where type = 'OPERATES_IN'", graph=True)
def _(spark, d):
    return tpch(spark, d).pattern("Company", ["OPERATES_IN"], "Region", "company", "region")


_EMISSIONS = """rows as (select r.s company, r.o metric, y.o "year", sc.o scope from tri r left join tri y on y.s = r.o and y.p = 'MEASURED_IN_YEAR' left join tri sc on sc.s = r.o and sc.p = 'FALLS_UNDER_SCOPE' where r.p = 'REPORTS_EMISSION')"""


@query("jn5_optional_pattern", f'with {_EMISSIONS} select company, metric, "year", scope from rows', graph=True)
def _(spark, d):
    return stats.emission_rows(tpch(spark, d))


_FACTS = """facts as (select distinct c.company, m.o emission, 'tCO2e' as unit, y.o "year", sc.o scope, n.o net_zero_year, h.o supplier from c
left join tri m on m.s = c.company and m.p = 'REPORTS_EMISSION' left join tri y on y.s = m.o and y.p = 'MEASURED_IN_YEAR' left join tri sc on sc.s = m.o and sc.p = 'FALLS_UNDER_SCOPE'
left join tri n on n.s = c.company and n.p = 'COMMITS_TO_NET_ZERO' left join tri h on h.s = c.company and h.p = 'HAS_SUPPLIER')"""


@query("jn6_chained_optional", f"with c as (select distinct s company from tri where p = 'REPORTS_EMISSION'), {_FACTS} select * from facts", graph=True)
def _(spark, d):
    g = tpch(spark, d)
    return context.company_facts(g, g.pattern("Company", ["REPORTS_EMISSION"], "EmissionMetric", "company", "metric").select("company"))


@query("jn7_unwind_contains", "with k(part) as (values ('#00000001'), ('#00000002')) select part, key as company from k join nodes on label = 'Company' and contains(lower(key), lower(part))", graph=True)
def _(spark, d):
    parts = spark.createDataFrame([(["#00000001", "#00000002"],)], "parts array<string>").select(F.explode("parts").alias("part"))
    companies = tpch(spark, d).label("Company").select(F.col("key").alias("company"))
    return search.containing_any(companies, "company", parts, "part").select("part", "company")


@query("jn8_incident_edges", f"select src, type, dst from edges where src = 'Company:{ROOT}' or dst = 'Company:{ROOT}'", graph=True)
def _(spark, d):
    return tpch(spark, d).incident(f"Company:{ROOT}").select("src", "type", "dst")


def _ego_sql(hops: int) -> str:
    levels = "".join(
        f"l{k} as (select * from l{k - 1} union all select distinct b.y, {k} from l{k - 1} join b on b.x = l{k - 1}.node_id where dist = {k - 1} and b.y not in (select node_id from l{k - 1})),\n" for k in range(1, hops + 1)
    )
    return f"""with b as (select src x, dst y from edges union all select dst, src from edges),
l0 as (select node_id, 0 dist from nodes where node_id = 'Company:{ROOT}'),
{levels}kept as (select node_id, dist from l{hops} join nodes using (node_id) order by dist, label, key limit 200)
select distinct e.src, e.type, e.dst from edges e join kept a on a.node_id = e.src join kept c on c.node_id = e.dst where least(a.dist, c.dist) <= {hops - 1}"""


for _h in (1, 2, 3):

    @query(f"jn9_ego_{_h}hop", _ego_sql(_h), graph=True)
    def _(spark, d, h=_h):
        return traverse.ego(tpch(spark, d).written(), f"Company:{ROOT}", h).edges


@query("jn10_name_pairs", f"with recursive {_PAIRS} select canonical, duplicate, score from pairs", triples=True)
def _(spark, d):
    return resolve.duplicate_pairs(triple_graph(spark, d).label("Company"), "key")


def _mapping(spark):
    rows = [("Supplier#000000001", "Supplier#000000000"), ("Supplier#000000003", "Supplier#000000002"), ("Supplier#000000000", "Supplier#000000000")]
    return spark.createDataFrame(rows, "name string, canonical string")


_MAP = "map(dup, can) as (values ('Company:Supplier#000000001', 'Company:Supplier#000000000'), ('Company:Supplier#000000003', 'Company:Supplier#000000002'))"
_MOVED = "from edges e left join map a on a.dup = e.src left join map b on b.dup = e.dst where not (b.dup is not null and a.dup is null and e.src = b.can)"


@query("jn11_jn12_redirect", f"with {_MAP} select coalesce(a.can, e.src) as src, type, coalesce(b.can, e.dst) as dst {_MOVED}", graph=True)
def _(spark, d):
    return resolve.redirect(tpch(spark, d), _mapping(spark)).edges


@query("jn13_drop_duplicates", f"with {_MAP} select node_id, label, key from nodes where node_id not in (select dup from map)", graph=True)
def _(spark, d):
    return resolve.redirect(tpch(spark, d), _mapping(spark)).nodes


@query("jn14_drop_with_edges", f"with {_MAP} select src, type, dst from edges where src not in (select dup from map) and dst not in (select dup from map)", graph=True)
def _(spark, d):
    return resolve.drop_with_edges(tpch(spark, d), _mapping(spark)).edges


#: Supplier records on three pairs of companies: duplicates that have more, other and no properties.
_COPIED = """with r as (select erp_id, 'Company:' || supplier_name node_id from en_erp), two as (select min(node_id) filter (where node_id like '%Company:%') lo from r),
pair as (select node_id can, lead(node_id) over (order by node_id) dup from (select distinct node_id from r)), map as (select can, dup from pair where dup is not null and can = (select lo from two)),
taken as (select can node_id, k, v from map join en_props p on p.node_id = dup where k not in ('name', 'value')),
after as (select node_id, k, v from en_props e where node_id not in (select dup from map) and not exists (select 1 from taken t where t.node_id = e.node_id and t.k = e.k) union all select node_id, k, v from taken)"""


@query("jn14_property_copy", f"{_COPIED} select node_id as id, {_PROP_TEXT} as properties from after group by node_id", enriched=True)
def _(spark, d):
    names = _erp(spark, d).select("supplier_name").orderBy("supplier_name").limit(2)
    mapping = names.agg(F.max("supplier_name").alias("name"), F.min("supplier_name").alias("canonical"))
    nodes = resolve.drop_with_edges(enriched_graph(spark, d), mapping).nodes
    return nodes.select(F.col("node_id").alias("id"), X.entries_text(F.col("props")).alias("properties"))


@query("jn15_components", f"with recursive {_CLOSED} select name, canonical from class", triples=True)
def _(spark, d):
    return resolve.components(resolve.duplicate_pairs(triple_graph(spark, d).label("Company"), "key"))


_GEO = "geo as (select key, latitude, longitude, latitude is null as geocode_failed from tnodes left join gazetteer on name = key where label = 'Region')"


@query("jn16_point_update", f"with {_GEO} select n.key, g.latitude, g.longitude, g.geocode_failed from tnodes n left join geo g using (key) where n.label = 'Region'", triples=True)
def _(spark, d):
    g = triple_graph(spark, d)
    found = enrich.geocode(g.nodes, "Region", table(spark, d, "gazetteer"))
    return g.label("Region").select("key").join(found, "key", "left").select("key", "latitude", "longitude", "geocode_failed")


@query("jn17_worklist", "select key from tnodes where label = 'Region' and key not in (select name from gazetteer)", triples=True)
def _(spark, d):
    g = triple_graph(spark, d)
    done = table(spark, d, "gazetteer").select(F.col("name").alias("key"))
    return g.label("Region").select("key").join(done, "key", "left_anti")


@query("jn18_semi_join", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '5-LOW')")
def _(spark, d):
    low = table(spark, d, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(low, "c_custkey", "left_semi")


# --- 2.5 aggregations --------------------------------------------------------------------------


@query("ag1_nodes_by_label", "select label, count(*) as count from tnodes group by label", triples=True)
def _(spark, d):
    return triple_graph(spark, d).nodes.groupBy("label").count()


@query("ag2_edge_count", "select count(*) as n from edges", graph=True)
def _(spark, d):
    return tpch(spark, d).edges.agg(F.count("*").alias("n"))


@query("ag3_filtered_count", "select count(*) as suppliers from en_nodes join en_props using (node_id) where label = 'Company' and k = 'supply_chain_tier'", enriched=True)
def _(spark, d):
    tier = F.try_element_at("props", F.lit("supply_chain_tier"))
    return enriched_graph(spark, d).nodes.agg(F.count_if((F.col("label") == "Company") & tier.isNotNull()).alias("suppliers"))


_SUMMARY = f"""with {_LATEST}, fresh as (select supplier_name from erp where 'Company:' || supplier_name not in (select node_id from nodes)),
everyone as (select label from nodes union all select 'Company' from fresh)
select count(*) as total_nodes, (select count(*) from edges) as total_relationships, count(*) filter (where label = 'Company') as companies, count(*) filter (where label = 'EmissionMetric') as emission_metrics,
count(*) filter (where label = 'Region') as regions, count(*) filter (where label = 'Facility') as facilities, (select count(*) from erp where tier is not null) as suppliers from everyone"""


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.summary(enrich.load_suppliers(tpch(spark, d).written(), _erp(spark, d)))


@query("ag4_label_pivot", _SUMMARY, graph=True)
def _(spark, d):
    return _summary(spark, d)


@query("ag5_count_by_category", "select o as category, count(*) as count from tri where p = 'BELONGS_TO_CATEGORY' group by o", graph=True)
def _(spark, d):
    return stats.categories(tpch(spark, d))


@query(
    "ag6_ingest_stats",
    f"""with t as (select source_file as file, {_STRIP("subject")} = '' or {_STRIP("object_value")} = '' as gone from {TRIPLES})
select file, count(*) as processed, count(*) filter (where not gone) as written, count(*) filter (where gone) as skipped, cast(grouping(file) as tinyint) as is_total from t group by rollup(file)""",
)
def _(spark, d):
    return ingest_stats(table(spark, d, TRIPLES), "source_file", ["triple_id"])


@query("ag7_erp_stats", f"with {_LATEST}, c as (select key from tnodes where label = 'Company') select count(*) filter (where c.key is null) as created, count(*) filter (where c.key is not null) as updated, cast(0 as bigint) as errors from erp left join c on c.key = supplier_name", triples=True)
def _(spark, d):
    return enrich.upsert_stats(_upserted(spark, d))


@query("ag8_geo_stats", f"with {_GEO} select count(*) as attempted, count(latitude) as geocoded, count(*) filter (where geocode_failed) as failed from geo", triples=True)
def _(spark, d):
    return enrich.geo_stats(enrich.geocode(triple_graph(spark, d).nodes, "Region", table(spark, d, "gazetteer")))


@query("ag9_redirect_count", f"with {_MAP} select (select count(*) from map) as pairs_found, (select count(*) from map) as pairs_merged, cast((select count(*) from edges join map on dup = src) + (select count(*) from edges join map on dup = dst where src <> can) as bigint) as rels_redirected", graph=True)
def _(spark, d):
    return resolve.redirected(tpch(spark, d), _mapping(spark))


@query("ag10_first_seen_names", "with f as (select lang, source, min(doc_id) i from documents where lang is not null and source is not null group by all) select lang, string_agg(source, ',' order by i, source) as sources from f group by lang")
def _(spark, d):
    first = table(spark, d, "documents").where("lang is not null and source is not null").groupBy("lang", "source").agg(F.min("doc_id").alias("i"))
    return first.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "source"))), lambda x: x["source"]), ",").alias("sources"))


@query("ag11_tallies", "select (select count(*) from tnodes) as nodes, (select count(*) from tedges) as edges", triples=True)
def _(spark, d):
    g = triple_graph(spark, d)
    return one_row(g.nodes.agg(F.count("*").alias("nodes")), g.edges.agg(F.count("*").alias("edges")))


# --- 2.6 window-like ---------------------------------------------------------------------------


@query("wn1_keep_first_node", f"select object_value, min(triple_id) as triple_id from {TRIPLES} where object_value is not null group by 1")
def _(spark, d):
    w = Window.partitionBy("object_value").orderBy("triple_id")
    return table(spark, d, TRIPLES).where("object_value is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("object_value", "triple_id")


@query("wn2_keep_first_edge", f"with {_MAP}, moved as (select coalesce(a.can, e.src) as src, type, coalesce(b.can, e.dst) as dst {_MOVED}) select distinct src, type, dst from moved", graph=True)
def _(spark, d):
    return resolve.redirect(tpch(spark, d), _mapping(spark)).edges.dropDuplicates(["src", "type", "dst"]).select("src", "type", "dst")


@query("wn3_last_turns", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) rn from events) where rn <= 10")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("rn")).where("rn <= 10").drop("rn")


@query("wn4_first_n_sources", "with f as (select source, min(doc_id) doc_id from documents where source is not null group by source) select source, doc_id from f order by doc_id limit 20")
def _(spark, d):
    return files.first_n_distinct(table(spark, d, "documents"), "source", ["doc_id"], 20)


# --- 2.7 sorts and limits ----------------------------------------------------------------------

_VALUE = rf"case when regexp_matches(metric, '{X.NUMBER}') then cast(trim(metric) as double) end"
_TIES = 'company, "year" nulls first, scope nulls first, metric'


def _emissions_sql(limit: int, mode: str) -> str:
    out = "select company, value, 'tCO2e' as unit, coalesce(\"year\", 'unknown') as \"year\", coalesce(scope, 'unknown') as scope from"
    if mode == "compat":
        return f"with {_EMISSIONS}, v as (select *, {_VALUE} as value from rows), top as (select * from v order by value desc nulls first, {_TIES} limit {limit}) {out} top where value is not null"
    return f"with {_EMISSIONS}, v as (select *, {_VALUE} as value from rows), top as (select * from v where value is not null order by value desc, {_TIES} limit {limit}) {out} top"


@query("st1_topk_fixed", _emissions_sql(500, "fixed"), graph=True)
def _(spark, d):
    return stats.emissions(tpch(spark, d), 500)


@query("st1_topk_compat", _emissions_sql(25000, "compat"), graph=True)
def _(spark, d):
    return stats.emissions(tpch(spark, d), 25000, "compat")


_TOP5 = rf"""select p.s as company, p.o as value, 'tCO2e' as unit, sc.o as scope from tri p left join tri sc on sc.s = p.o and sc.p = 'FALLS_UNDER_SCOPE' where p.p = 'REPORTS_EMISSION'
order by {_VALUE.replace("metric", "p.o")} desc nulls first, company, value, scope nulls first limit 5"""


@query("st2_top5_kept", _TOP5, graph=True)
def _(spark, d):
    return context.top_emitters(tpch(spark, d))


_GEOCODED = "select label, key as name, cast(a.v as double) as latitude, cast(o.v as double) as longitude from en_nodes join en_props a on a.node_id = en_nodes.node_id and a.k = 'latitude' join en_props o on o.node_id = en_nodes.node_id and o.k = 'longitude'"


@query("st3_multi_key_order", _GEOCODED + " order by label, name", enriched=True)
def _(spark, d):
    return enrich.geocoded(enriched_graph(spark, d)).drop("props").orderBy("label", "name")


@query("st4_count_order", "select p_type as category, count(*) as count from part group by 1 order by 2 desc, 1")
def _(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "category")


@query("st5_pagination", "select node_id, label, key from nodes order by label, key limit 50 offset 100", graph=True)
def _(spark, d):
    return tpch(spark, d).nodes.orderBy("label", "key").offset(100).limit(50)


@query("st6_bare_limit", "select key from nodes where label = 'Company' order by key limit 20", graph=True)
def _(spark, d):
    return tpch(spark, d).label("Company").select("key").orderBy("key").limit(20)


@query("st8_order_by_year", "select s as company, o as \"year\" from tri where p = 'COMMITS_TO_NET_ZERO' order by 2, 1 limit 10", graph=True)
def _(spark, d):
    return context.target_lines(tpch(spark, d))


_TARGETS = "select s as company, o as target_year, '' as description from tri where p = 'COMMITS_TO_NET_ZERO' union select s, 'unknown', '' from tri where p = 'SETS_TARGET'"


@query("st9_order_after_union", _TARGETS, graph=True)
def _(spark, d):
    return stats.targets(tpch(spark, d))


@query("st10_name_order", "select row_number() over (order by p_name) as pos, p_name from (select distinct p_name from part)")
def _(spark, d):
    # Positions over the distinct names of a small catalogue; the order is what is asked for.
    names = table(spark, d, "part").select("p_name").distinct()
    return names.select(F.row_number().over(Window.orderBy("p_name")).cast("bigint").alias("pos"), "p_name")


@query("st11_sorted_files")
def _(spark, d):
    return spark.read.format("binaryFile").load(d + "/*.parquet").select(F.col("_metadata.file_name").alias("file")).orderBy("file")


@query("st12_slices", "select c_name, c_acctbal from customer order by c_acctbal desc, c_name limit 10")
def _(spark, d):
    return table(spark, d, "customer").select("c_name", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_name").limit(10)


# --- 2.8 set operations ------------------------------------------------------------------------


@query("so1_union_distinct", _TARGETS, graph=True)
def _(spark, d):
    return stats.targets(tpch(spark, d))


@query("so2_distinct_rows", f"with c as (select distinct s company from tri where p = 'HAS_SUPPLIER'), {_FACTS} select * from facts", graph=True)
def _(spark, d):
    g = tpch(spark, d)
    return context.company_facts(g, g.pattern("Company", ["HAS_SUPPLIER"], "Company", "company", "supplier").select("company"))


@query("so3_distinct_ends", "select distinct src as node_id from edges union select dst from edges", graph=True)
def _(spark, d):
    e = tpch(spark, d).edges
    return e.select(F.col("src").alias("node_id")).unionByName(e.select(F.col("dst").alias("node_id"))).distinct()


@query("so4_valid_labels", "select unnest([" + ", ".join(f"'{x}'" for x in [*LABELS, "Entity"]) + "]) as label")
def _(spark, d):
    return spark.createDataFrame([(x,) for x in sorted(QUERY_LABELS)], "label string")


@query("so5_stage_difference", "select unnest(['extract', 'resolve', 'geo']) as stage")
def _(spark, d):
    todo = spark.createDataFrame([(s,) for s in ("extract", "load", "resolve", "erp", "geo")], "stage string")
    return todo.exceptAll(spark.createDataFrame([("load",), ("erp",)], "stage string"))


# --- 2.9 scalar functions ----------------------------------------------------------------------


@query("fn1_fn2_fn3_case_replace_regex", "select n_nationkey, lower(n_name) as low, upper(n_name) as up, replace(n_name, 'A', '-') as swapped, regexp_replace(n_name, '[AEIOU]+', '*', 'g') as masked from nation")
def _(spark, d):
    n = F.col("n_name")
    return table(spark, d, "nation").select("n_nationkey", F.lower(n).alias("low"), F.upper(n).alias("up"), F.replace(n, F.lit("A"), F.lit("-")).alias("swapped"), F.regexp_replace(n, "[AEIOU]+", "*").alias("masked"))


@query("fn4_find_all", f"select doc_id, array_to_string({_CANDIDATES}, '|') as names from documents where text is not null")
def _(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(X.candidate_names(F.col("text")), "|").alias("names"))


@query("fn5_to_fn9_text", "select doc_id, trim(text, ' ') as trimmed, length(text) as n, substring(text, 3, 7) as part, contains(text, 'the') as has_the, concat_ws('/', source, lang) as joined from documents where text is not null")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.btrim(t).alias("trimmed"), F.length(t).cast("bigint").alias("n"), F.substring(t, 3, 7).alias("part"), F.contains(t, F.lit("the")).alias("has_the"), F.concat_ws("/", "source", "lang").alias("joined"))


@query("fn10_to_fn14_null_case_cast", rf"select triple_id, coalesce(unit, '-') as unit0, coalesce(nullif(unit, ''), 'none') as unit1, case when unit is null then 0 else 1 end as has_unit, case when regexp_matches(object_value, '{X.NUMBER}') then cast(trim(object_value) as double) end as value, cast(triple_id as varchar) as id_text from collin_foods_2024_triples")
def _(spark, d):
    return table(spark, d, "collin_foods_2024_triples").select("triple_id", F.coalesce("unit", F.lit("-")).alias("unit0"), X.or_default(F.col("unit"), "none").alias("unit1"), F.when(F.col("unit").isNull(), 0).otherwise(1).alias("has_unit"), X.to_number(F.col("object_value")).alias("value"), F.col("triple_id").cast("string").alias("id_text"))


@query("fn15_fn16_graph_accessors", "select src, type, dst, split_part(src, ':', 1) as src_label from edges where type = 'OPERATES_IN'", graph=True)
def _(spark, d):
    e = tpch(spark, d).edges.where("type = 'OPERATES_IN'")
    exploded = e.select(F.explode(F.array(F.struct("src", "type", "dst"))).alias("r"))
    return exploded.select("r.src", "r.type", "r.dst", F.split_part("r.src", F.lit(":"), F.lit(1)).alias("src_label"))


@query("fn18_fn19_pair_functions", "select least(a.n_name, b.n_name) as first, greatest(a.n_name, b.n_name) as second, case when length(a.n_name) >= length(b.n_name) then a.n_name else b.n_name end as canonical from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def _(spark, d):
    n = table(spark, d, "nation")
    a, b = (n.select("n_regionkey", F.col("n_nationkey").alias(f"k{x}"), F.col("n_name").alias(x)) for x in "ab")
    return a.join(b, "n_regionkey").where("ka < kb").select(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"), F.when(F.length("a") >= F.length("b"), F.col("a")).otherwise(F.col("b")).alias("canonical"))


@query("fn21_iso_time", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("fn22_round", "select p_partkey, round(p_retailprice, 1) as price from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round("p_retailprice", 1).alias("price"))


@query("fn23_error_class", "select event_id, regexp_matches(lower(event_type || props), '429|quota|resource exhausted|rate limit') as quota from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", X.is_quota_error(F.concat("event_type", "props")).alias("quota"))


# --- 2.10 search -------------------------------------------------------------------------------

_BM25 = r"""with names as (select distinct key as name from tnodes where label = 'Company'),
tk as (select name, list_filter(string_split_regex(lower(name), '[^\p{L}\p{N}]+'), lambda t: t <> '') ts from names),
size as (select count(*) n, avg(len(ts)) mean from tk),
post as (select name, len(ts) length, token, count(*) tf from (select name, ts, unnest(ts) token from tk) group by all),
hit as (select * from post where token in ('harbour', 'foods')),
df as (select token, count(*) df from hit group by token)
select name, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score from hit join df using (token), size group by name order by score desc, name limit 20"""


@query("ft1_bm25", _BM25, triples=True)
def _(spark, d):
    return search.bm25(triple_graph(spark, d).label("Company"), "key", "Harbour Foods", 20)


@query("ft2_contains_key", "select key as name from nodes where label = 'Target' and contains(lower(key), 'promo') order by 1 limit 20", graph=True)
def _(spark, d):
    return search.containing(tpch(spark, d).label("Target"), "key", "promo")


@query("ft3_contains_name_only", "select key as name from nodes where label = 'Year' and false", graph=True)
def _(spark, d):
    # Value-keyed labels have no name, so a search by name finds none of them.
    g = tpch(spark, d).label("Year").withColumn("name", F.when(X.identity_property(F.col("label")) == "name", F.col("key")))
    return search.containing(g, "name", "20")


# --- 2.11 user functions and composite queries -------------------------------------------------


@query("ud1_extraction")
def _(spark, d):
    return chunking.extract(chunking.select_chunks(table(spark, d, "documents")), "doc_id", "text").withColumn("metadata", X.entries_text(X.metadata_map(F.col("metadata"))))


@query("ud3_fuzzy_ratio", f"with recursive {_pairs_sql(70)} select canonical, duplicate, score from pairs", triples=True)
def _(spark, d):
    return resolve.duplicate_pairs(triple_graph(spark, d).label("Company"), "key", 70.0)


@query("qy1_summary", _SUMMARY, graph=True)
def _(spark, d):
    return _summary(spark, d)


@query("qy2_emissions_fixed", _emissions_sql(50, "fixed"), graph=True)
def _(spark, d):
    return stats.emissions(tpch(spark, d), 50)


@query("qy2_emissions_compat", _emissions_sql(30000, "compat"), graph=True)
def _(spark, d):
    return stats.emissions(tpch(spark, d), 30000, "compat")


@query("qy3_categories", "select o as category, count(*) as count from tri where p = 'BELONGS_TO_CATEGORY' group by o", graph=True)
def _(spark, d):
    return stats.categories(tpch(spark, d))


@query("qy4_targets", _TARGETS, graph=True)
def _(spark, d):
    return stats.targets(tpch(spark, d))


@query("qy5_list_nodes", f"select node_id as id, label, key as name, {_PROP_TEXT} as properties from (select * from en_nodes where label = 'Company' order by key limit 50 offset 50) join en_props using (node_id) group by all", enriched=True)
def _(spark, d):
    return _text(list_nodes(enriched_graph(spark, d), "Company", 50, 50))


@query("qy6_search", f"select 'Company:' || name as id, 'Company' as label, name, score from ({_BM25.replace('with names', 'with names')})".replace("from (with names", "from (with names"), triples=True)
def _(spark, d):
    found = search.bm25(triple_graph(spark, d).label("Company"), "key", "Harbour Foods", 20)
    return found.select(F.concat(F.lit("Company:"), "name").alias("id"), F.lit("Company").alias("label"), "name", "score")


_DETAIL = f"""with {_LAST_EDGE_PROPS}
select 'node' as kind, node_id as source, cast(null as varchar) as target, label as type, {_PROP_TEXT} as properties from en_nodes join en_props using (node_id) where node_id = 'Region:Germany' group by node_id, label
union all select 'edge', e.src, e.dst, e.type, {_PROP_TEXT} from tedges e left join em_last l on l.source = e.src and l.target = e.dst and l.type = e.type where e.src = 'Region:Germany' or e.dst = 'Region:Germany' group by e.src, e.dst, e.type"""


@query("qy7_node_detail", _DETAIL, enriched=True)
def _(spark, d):
    g = enrich.load_coordinates(triple_graph(spark, d, True), ("Region", "Facility"), table(spark, d, "gazetteer"))
    node, edges = traverse.node_detail(g, "Region", "Germany")
    about = node_rows(node).select(F.lit("node").alias("kind"), F.col("id").alias("source"), F.lit(None).cast("string").alias("target"), F.col("label").alias("type"), "properties")
    return _text(about.unionByName(edge_rows(edges).withColumn("kind", F.lit("edge"))))


@query("qy8_ego_nodes", _ego_sql(2).rsplit("select distinct", 1)[0] + "select label, key from kept join nodes using (node_id)", graph=True)
def _(spark, d):
    return traverse.ego(tpch(spark, d).written(), f"Company:{ROOT}", 2).nodes.select("label", "key")


_CHAIN = f"""with {_LAST_EDGE_PROPS}, chain as (select * from tedges where type in ('HAS_SUPPLIER', 'SUPPLIES_TO') order by src, type, dst limit 500)"""


@query("qy9_supply_chain", f"{_CHAIN} select src as source, dst as target, e.type, {_PROP_TEXT} as properties from chain e left join em_last l on l.source = e.src and l.target = e.dst and l.type = e.type group by src, dst, e.type", enriched=True)
def _(spark, d):
    return _text(edge_rows(traverse.supply_chain(triple_graph(spark, d, True))))


@query("qy9_supply_chain_nodes", f"{_CHAIN} select node_id as id, label, key as name, {_PROP_TEXT} as properties from en_nodes join en_props using (node_id) where node_id in (select src from chain union select dst from chain) group by all", enriched=True)
def _(spark, d):
    g = enriched_graph(spark, d)
    return _text(node_rows(traverse.supply_chain_nodes(g, traverse.supply_chain(g))))


@query("qy9_map_nodes", f"select g.label, g.name, g.latitude, g.longitude, x.extra from ({_GEOCODED}) g join ({_MAP_EXTRA}) x on x.label = g.label and x.name = g.name", enriched=True)
def _(spark, d):
    g = enrich.geocoded(enriched_graph(spark, d))
    return g.select("label", "name", "latitude", "longitude", X.entries_text(X.extra_properties(F.col("props"), MAP_HIDDEN)).alias("extra"))


_FACT_ORDER = 'company, emission nulls first, unit, "year" nulls first, scope nulls first, net_zero_year nulls first, supplier nulls first'


@query("qy10_context_facts", f"with c as (select key as company from nodes where label = 'Company' and contains(lower(key), 'supplier#00000000')), {_FACTS} select * from facts order by {_FACT_ORDER} limit 20", graph=True)
def _(spark, d):
    g = tpch(spark, d)
    companies = g.label("Company").where(X.contains_fold(F.col("key"), F.lit("Supplier#00000000"))).select(F.col("key").alias("company"))
    return context.facts(g, companies)


@query(
    "qy10_context_text",
    rf"""with c as (select key as company from nodes where label = 'Company' and contains(lower(key), 'supplier')), {_FACTS},
f as (select *, row_number() over (order by {_FACT_ORDER}) r from facts qualify r <= 20),
l as (select 1 part, r, 1 item, '- ' || company || ': ' || emission || ' ' || unit || ' (' || coalesce(scope, 'unknown scope') || ', ' || coalesce("year", 'unknown year') || ')' line from f where emission is not null
  union all select 1, r, 2, '- ' || company || ': net-zero target by ' || net_zero_year from f where net_zero_year is not null
  union all select 1, r, 3, '- ' || company || ' has supplier: ' || supplier from f where supplier is not null
  union all select 2, r, 1, '- ' || company || ': ' || value || ' ' || unit || ' (' || coalesce(scope, 'unknown scope') || ')' from (select *, row_number() over (order by {_VALUE.replace("metric", "value")} desc nulls first, company, value, scope nulls first) r from ({_TOP5}))
  union all select 3, row_number() over (order by o, s), 1, '- ' || s || ': net-zero by ' || o from tri where p = 'COMMITS_TO_NET_ZERO' qualify row_number() over (order by o, s) <= 10),
t as (select part, case part when 1 then 'Specific company data:' when 2 then 'Top 5 emitters:' else 'Net-zero commitments:' end || chr(10) || string_agg(line, chr(10) order by r, item) as text from l group by part)
select string_agg(text, chr(10) || chr(10) order by part) as context, (select string_agg(distinct company, '|' order by company) from f) as sources, true as context_used from t""",
    graph=True,
)
def _(spark, d):
    return context.context_text(tpch(spark, d), "is there a target of any Supplier#000000001?")


@query("qy11_suggestions", "select * from (values " + ", ".join(f"('{q}', '{c}')" for q, c in SUGGESTIONS) + ") t(question, category)")
def _(spark, d):
    return spark.createDataFrame(list(SUGGESTIONS), "question string, category string")


def _resolution(spark: SparkSession, d: str, mode: str) -> DataFrame:
    pairs = cut(resolve.duplicate_pairs(triple_graph(spark, d).label("Company"), "key", mode=mode))
    return pairs.select("canonical", "duplicate", F.round("score", 2).alias("score"))


@query("qy12_entity_resolution", f"with recursive {_PAIRS} select canonical, duplicate, round(score, 2) as score from pairs", triples=True)
def _(spark, d):
    return _resolution(spark, d, "blocked")


@query("qy12_entity_resolution_compat", f"with recursive {_PAIRS} select canonical, duplicate, round(score, 2) as score from pairs where (select count(*) from nm) between 2 and 2000", triples=True)
def _(spark, d):
    return _resolution(spark, d, "capped")


@query("qy12_merged_graph", f"with recursive {_CLOSED} select coalesce(a.can, e.src) as src, type, coalesce(b.can, e.dst) as dst {_MOVED.replace('from edges', 'from tedges')}", triples=True)
def _(spark, d):
    g = triple_graph(spark, d)
    mapping = resolve.components(resolve.duplicate_pairs(g.label("Company"), "key"))
    return resolve.redirect(g, mapping).edges


@query("qy12_summary", f"with recursive {_CLOSED} select (select count(*) from map) as pairs_found, (select count(*) from map) as pairs_merged, cast((select count(*) from tedges join map on dup = src) + (select count(*) from tedges join map on dup = dst where src <> can) as bigint) as rels_redirected", triples=True)
def _(spark, d):
    g = triple_graph(spark, d)
    return resolve.redirected(g, resolve.components(resolve.duplicate_pairs(g.label("Company"), "key")))


@query("qy13_ingest", "select 'node' as kind, label as name, count(*) n from tnodes group by label union all select 'edge', type, count(*) from tedges group by type", triples=True)
def _(spark, d):
    g = triple_graph(spark, d)
    return g.nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n")).unionByName(g.edges.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("n")))


@query("qy13_unique_nodes", "select label, key, count(*) as count from tnodes group by all having count(*) > 1", triples=True)
def _(spark, d):
    return broken_keys(triple_graph(spark, d).nodes)


@query("qy14_erp_load", SQL["ag7_erp_stats"])
def _(spark, d):
    return enrich.upsert_stats(_upserted(spark, d))


_PLACED = "placed as (select label, case when latitude is null then 0 else 1 end as ok from tnodes left join gazetteer on name = key where label in ('Region', 'Facility'))"


@query("qy15_geo_enrich", f"with {_PLACED} select label, count(*) as attempted, sum(ok)::bigint as geocoded, (count(*) - sum(ok))::bigint as failed from placed group by label", triples=True)
def _(spark, d):
    nodes, places = triple_graph(spark, d).nodes, table(spark, d, "gazetteer")
    rows = [enrich.geo_stats(enrich.geocode(nodes, x, places)).select(F.lit(x).alias("label"), "*") for x in ("Region", "Facility")]
    # A label without nodes has nothing attempted and no row in a grouping.
    return rows[0].unionByName(rows[1]).where("attempted > 0")


@query("qy16_select_and_extract")
def _(spark, d):
    chosen = chunking.select_chunks(table(spark, d, "documents").withColumnRenamed("text", "whole"), text_col="whole")
    c = chunking.chunks(chosen, "doc_id", "whole").where(F.length("chunk") >= chunking.LEAST)
    return chunking.extract(c, "doc", "chunk").groupBy("predicate").agg(F.count("*").alias("n"))


@query("qy17_health", "select 1 as ok")
def _(spark, d):
    return spark.range(1).select(F.lit(1).alias("ok"))


# --- ids that another key already covers, for coverage by key ------------------------------------

for _alias, _of in {
    "st7_relevance_order": "ft1_bm25",
    "fn17_token_sort_ratio": "ud3_fuzzy_ratio",
    "fn20_fulltext_relevance": "ft1_bm25",
    "ud2_geocoder": "sc14_geocode_lookup",
    "ud4_edge_rewrite": "jn11_jn12_redirect",
    "ud5_fulltext_call": "ft1_bm25",
}.items():
    QUERIES[_alias] = QUERIES[_of]
    if _of in SQL:
        SQL[_alias] = SQL[_of]


# --- extensions beyond the blueprint's parity ------------------------------------------------------

_HAVERSINE = "round(12742 * asin(sqrt(power(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * power(sin(radians(b.longitude - a.longitude) / 2), 2))), 3)"


@query("ext_within_radius", f"select b.name, {_HAVERSINE} as km from gazetteer a, gazetteer b where a.name = 'Germany' and b.name <> 'Germany' and {_HAVERSINE} <= 8000")
def _(spark, d):
    g = table(spark, d, "gazetteer")
    lat0, lon0 = (g.where("name = 'Germany'").agg(F.first(c).alias(c)).scalar() for c in ("latitude", "longitude"))
    half = lambda x, y: F.pow(F.sin(F.radians(F.col(x) - y) / 2), 2)
    km = F.round(12742 * F.asin(F.sqrt(half("latitude", lat0) + F.cos(F.radians(lat0)) * F.cos(F.radians("latitude")) * half("longitude", lon0))), 3)
    return g.where("name <> 'Germany'").select("name", km.alias("km")).where("km <= 8000")


@query("ext_supplier_rollup", rf"select h.s as company, count(*) as metrics, sum({_VALUE.replace('metric', 'm.o')}) as total from tri h join tri m on m.s = h.o and m.p = 'REPORTS_EMISSION' where h.p = 'HAS_SUPPLIER' group by h.s", graph=True)
def _(spark, d):
    g = tpch(spark, d)
    bought = g.pattern("Company", ["HAS_SUPPLIER"], "Company", "company", "supplier")
    reported = g.pattern("Company", ["REPORTS_EMISSION"], "EmissionMetric", "supplier", "metric")
    # Metrics are summed per supplier before they meet the many customers of that supplier.
    per = reported.groupBy("supplier").agg(F.count("*").alias("n"), F.sum(X.to_number(F.col("metric"))).alias("v"))
    return bought.join(per, "supplier").groupBy("company").agg(F.sum("n").alias("metrics"), F.sum("v").alias("total"))


@query("ext_event_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def _(spark, d):
    from carbonweave.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type")
