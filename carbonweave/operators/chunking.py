"""Documents to chunks, chunk selection, and rule-based triple extraction."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HARD_MAX, SOFT_MAX, LEAST = 4000, 3800, 100
KEPT_TYPES = ("CompositeElement", "Table")

#: What an extractor gives for one chunk: subject, predicate, object, metadata.
Extractor = Callable[[str], list[tuple[str, str, str, dict[str, str] | None]]]


def paragraphs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Paragraphs of each text in order: id, pos, paragraph."""
    return df.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col), r"\n\s*\n")).alias("pos", "paragraph")).where(F.trim("paragraph") != "")


def pack_paragraphs(text: str, hard: int = HARD_MAX, soft: int = SOFT_MAX) -> list[str]:
    """Greedy packing: a chunk closes before it passes the soft limit; a paragraph over the hard limit is cut."""
    out: list[str] = []
    held = ""
    for p in re.split(r"\n\s*\n", text):
        p = p.strip()
        while len(p) > hard:
            if held:
                out.append(held)
                held = ""
            out.append(p[:hard])
            p = p[hard:]
        if not p:
            continue
        if held and len(held) + 2 + len(p) > soft:
            out.append(held)
            held = p
        else:
            held = f"{held}\n\n{p}" if held else p
    return [*out, held] if held else out


def chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, pos, chunk: whole texts packed into chunks of bounded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pos, out = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for i, c in enumerate(pack_paragraphs(text or "")):
                    rows.append(k)
                    pos.append(i)
                    out.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pos, pa.int32()), pa.array(out, pa.string())], ["doc", "pos", "chunk"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, f"doc {kind}, pos int, chunk string")


def title_sections(elements: DataFrame, doc: Column, order: list[str], type_col: str = "element_type", text_col: str = "text") -> DataFrame:
    """doc, section, text: a title opens a section of its document, what stands before the first is section 0; texts in order, blank ones left out."""
    w = Window.partitionBy("doc").orderBy(*order)
    e = elements.select(doc.alias("doc"), *order, F.col(type_col).alias("cw_type"), F.col(text_col).alias("cw_text")).where("doc is not null")
    e = e.withColumn("section", F.sum(F.when(F.col("cw_type") == "Title", 1).otherwise(0)).over(w)).where(F.trim("cw_text") != "")
    parts = F.array_sort(F.collect_list(F.struct(*order, "cw_text")))
    return e.groupBy("doc", "section").agg(F.array_join(F.transform(parts, lambda x: x["cw_text"]), "\n\n").alias("text"))


def chunks_by_title(elements: DataFrame, doc: Column, order: list[str], type_col: str = "element_type", text_col: str = "text") -> DataFrame:
    """doc, section, pos, chunk: sections cut and packed by length, never across a title."""
    s = title_sections(elements, doc, order, type_col, text_col).select(F.to_json(F.struct("doc", "section")).alias("id"), "text")
    c = chunks(s, "id", "text")
    at = F.from_json("doc", "doc string, section bigint")
    return c.select(at["doc"].alias("doc"), at["section"].alias("section"), "pos", "chunk")


def select_chunks(elements: DataFrame, type_col: str = "element_type", text_col: str = "text", least: int = LEAST) -> DataFrame:
    return elements.where(F.col(type_col).isin(*KEPT_TYPES) & (F.length(text_col) >= least))


_NAME = r"([A-Z][\w&.\-’']*(?: [A-Z][\w&.\-’']*){0,4})"
_AMOUNT = r"([\d][\d.,]*\s?(?:[kM]?tCO₂e|tCO2e|MWh|GWh|kWh|m³|litres|tonnes|%))"
_RULES = (
    (re.compile(rf"{_NAME} (?:reported|recorded|emitted|cut|consolidated) (?:\w+ )?{_AMOUNT}"), "REPORTS_EMISSION"),
    (re.compile(rf"{_NAME} (?:operates|works|is active) in {_NAME}"), "OPERATES_IN"),
    (re.compile(rf"{_NAME} (?:supplies|delivers to) {_NAME}"), "SUPPLIES_TO"),
)
_YEAR = re.compile(r"\b(?:19|20)\d\d\b")


def rule_extractor(chunk: str) -> list[tuple[str, str, str, dict[str, str] | None]]:
    """The deterministic default extractor: a few sentence patterns, with the sentence's year as metadata."""
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+", chunk):
        year = _YEAR.search(sentence)
        for pattern, predicate in _RULES:
            for m in pattern.finditer(sentence):
                out.append((m.group(1), predicate, m.group(2), {"year": year.group()} if year else None))
    return out


def extract(selected: DataFrame, id_col: str, text_col: str, extractor: Extractor = rule_extractor) -> DataFrame:
    """doc, subject, predicate, object_value, metadata: 0..n triples per chunk; empty metadata is null."""
    kind = selected.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for t in extractor(text or ""):
                    rows.append(k)
                    found.append(t)
            c = list(zip(*found)) if found else [()] * 4
            metadata = pa.array([list(m.items()) if m else None for m in c[3]], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(list(x), pa.string()) for x in c[:3]), metadata], ["doc", "subject", "predicate", "object_value", "metadata"])

    return selected.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, f"doc {kind}, subject string, predicate string, object_value string, metadata map<string,string>")
