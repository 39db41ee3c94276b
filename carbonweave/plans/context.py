"""Grounding context for a question: facts on the companies it names, the largest emissions, the targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carbonweave.functions.text import TARGET_WORDS, candidate_names, to_number
from carbonweave.operators.graph import Graph
from carbonweave.operators.search import containing_any
from carbonweave.session import cut

MOST_FACTS, MOST_TOP, MOST_TARGETS = 20, 5, 10
FACT_COLUMNS = ("company", "emission", "unit", "year", "scope", "net_zero_year", "supplier")
#: The default unit, and headings and wording of the context.
UNIT = "tCO2e"
FACTS_HEAD, TOP_HEAD, TARGETS_HEAD = "Specific company data:", "Top 5 emitters:", "Net-zero commitments:"


def named_companies(graph: Graph, questions: DataFrame) -> DataFrame:
    """question_id, company for each company whose name contains a candidate of the question."""
    q = questions.select("question_id", F.explode(candidate_names(F.col("question"))).alias("part"))
    companies = graph.label("Company").select(F.col("key").alias("company"))
    return containing_any(companies, "company", q, "part").select("question_id", "company").distinct()


def _branches(graph: Graph, few: DataFrame | None = None) -> list[tuple[DataFrame, list[str]]]:
    """The independent optional patterns of a company. A metric's year and scope hang on the metric. few: only those companies, some rows."""
    of = lambda df: df if few is None else df.join(F.broadcast(few), "company", "left_semi")
    metric = of(graph.pattern("Company", ["REPORTS_EMISSION"], "EmissionMetric", "company", "emission"))
    year = graph.pattern("EmissionMetric", ["MEASURED_IN_YEAR"], "Year", "emission", "year")
    scope = graph.pattern("EmissionMetric", ["FALLS_UNDER_SCOPE"], "Scope", "emission", "scope")
    return [
        (metric.join(year, "emission", "left").join(scope, "emission", "left"), ["emission", "year", "scope"]),
        (of(graph.pattern("Company", ["COMMITS_TO_NET_ZERO"], "Year", "company", "net_zero_year")), ["net_zero_year"]),
        (of(graph.pattern("Company", ["HAS_SUPPLIER"], "Company", "company", "supplier")), ["supplier"]),
    ]


def company_facts(graph: Graph, companies: DataFrame) -> DataFrame:
    """company, emission, unit, year, scope, net_zero_year, supplier: every combination of a company's optional facts, each once."""
    out = companies.select("company").distinct()
    for branch, columns in _branches(graph):
        out = out.join(branch.select("company", *columns).distinct(), "company", "left")
    return out.withColumn("unit", F.lit(UNIT)).select(*FACT_COLUMNS)


def facts(graph: Graph, companies: DataFrame, limit: int = MOST_FACTS) -> DataFrame:
    """The first `limit` combinations in order of their columns.

    That order is the order of the branches one after the other, so the first combinations need the first
    `limit` companies and of each branch a company's first `limit` rows; the full product is never formed.
    """
    out = first = cut(companies.select("company").distinct().orderBy("company").limit(limit))
    for branch, columns in _branches(graph, first):
        order = Window.partitionBy("company").orderBy(*[F.col(c).asc_nulls_first() for c in columns])
        few = branch.select("company", *columns).distinct().withColumn("cw_rank", F.row_number().over(order)).where(F.col("cw_rank") <= limit).drop("cw_rank")
        out = out.join(few, "company", "left")
    rows = out.withColumn("unit", F.lit(UNIT)).select(*FACT_COLUMNS)
    return rows.orderBy(*[F.col(c).asc_nulls_first() for c in FACT_COLUMNS]).limit(limit)


def top_emitters(graph: Graph, limit: int = MOST_TOP) -> DataFrame:
    """company, value, unit, scope: unparseable values sort first and stay."""
    p = graph.pattern("Company", ["REPORTS_EMISSION"], "EmissionMetric", "company", "value")
    scope = graph.pattern("EmissionMetric", ["FALLS_UNDER_SCOPE"], "Scope", "value", "scope")
    order = [to_number(F.col("value")).desc_nulls_first(), "company", "value", F.col("scope").asc_nulls_first()]
    # A left join only adds rows, so the first `limit` metrics hold the first `limit` rows.
    return p.orderBy(*order[:3]).limit(limit).join(scope, "value", "left").orderBy(*order).limit(limit).select("company", "value", F.lit(UNIT).alias("unit"), "scope")


def target_lines(graph: Graph, limit: int = MOST_TARGETS) -> DataFrame:
    p = graph.pattern("Company", ["COMMITS_TO_NET_ZERO"], "Year", "company", "year")
    return p.orderBy("year", "company").limit(limit)


def _numbered(rows: DataFrame, part: int, order: list[F.Column], lines: list[F.Column]) -> DataFrame:
    """part, row, item, line of a few rows that are to stand in the given order; null lines are left out."""
    numbered = rows.withColumn("row", F.row_number().over(Window.partitionBy(F.lit(part)).orderBy(*order)))
    return numbered.select(F.lit(part).alias("part"), "row", F.posexplode(F.array(*lines)).alias("item", "line")).where("line is not null")


def context_text(graph: Graph, question: str) -> DataFrame:
    """context, sources, context_used of one question; the targets stand only where the question asks for them."""
    q = graph.nodes.sparkSession.createDataFrame([(0, question)], "question_id int, question string")
    company, text = F.col("company"), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    about = F.concat(F.lit("("), F.coalesce(F.nullif("scope", F.lit("")), F.lit("unknown scope")))
    found = facts(graph, named_companies(graph, q))
    said = [
        F.when(F.col("emission").isNotNull(), text("- ", company, ": ", F.col("emission"), " ", F.col("unit"), " ", about, ", ", F.coalesce(F.nullif("year", F.lit("")), F.lit("unknown year")), ")")),
        F.when(F.coalesce("net_zero_year", F.lit("")) != "", text("- ", company, ": net-zero target by ", F.col("net_zero_year"))),
        F.when(F.coalesce("supplier", F.lit("")) != "", text("- ", company, " has supplier: ", F.col("supplier"))),
    ]
    lines = _numbered(found, 1, [F.col(c).asc_nulls_first() for c in FACT_COLUMNS], said)
    top = [to_number(F.col("value")).desc_nulls_first(), F.col("company"), F.col("value"), F.col("scope").asc_nulls_first()]
    lines = lines.unionByName(_numbered(top_emitters(graph), 2, top, [text("- ", company, ": ", F.col("value"), " ", F.col("unit"), " ", about, ")")]))
    if any(w in question.lower() for w in TARGET_WORDS):
        lines = lines.unionByName(_numbered(target_lines(graph), 3, [F.col("year"), company], [text("- ", company, ": net-zero by ", F.col("year"))]))
    # At most 3 x 20 + 5 + 10 lines.
    heads = F.create_map(*[F.lit(x) for kv in enumerate((FACTS_HEAD, TOP_HEAD, TARGETS_HEAD), 1) for x in kv])
    parts = lines.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("row", "item", "line"))).alias("ls"))
    parts = parts.select("part", F.concat(heads[F.col("part")], F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("text"))
    named = found.select(F.lit(0).alias("part"), F.lit(None).cast("string").alias("text"), "company")
    both = parts.withColumn("company", F.lit(None).cast("string")).unionByName(named)
    out = both.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("part", "text")))), lambda x: x["text"]), "\n\n").alias("context"), F.array_join(F.array_sort(F.collect_set("company")), "|").alias("sources"))
    return out.withColumn("context_used", F.col("context") != "")


def sources(facts_: DataFrame) -> DataFrame:
    """Distinct company names of the facts."""
    return facts_.select("company").distinct().orderBy("company")


def recent_turns(turns: DataFrame, conversation: str, order: str, role: str, content: str, last: int = 10, most_chars: int = 500) -> DataFrame:
    """The last turns of each conversation; roles are filtered after the cut, contents shortened."""
    w = Window.partitionBy(conversation).orderBy(F.desc(order))
    kept = turns.withColumn("cw_rank", F.row_number().over(w)).where(F.col("cw_rank") <= last)
    return kept.where(F.col(role).isin("user", "assistant") & F.col(content).isNotNull()).select(conversation, order, role, F.substring(content, 1, most_chars).alias(content))


def prompt(context: F.Column, question: F.Column) -> F.Column:
    return F.when(context != "", F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)).otherwise(F.concat(F.lit("No graph context was found.\n\nQuestion: "), question))
