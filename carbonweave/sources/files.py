"""Readers and writers of element, triple and report files."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELEMENT = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))
TRIPLE = T.ArrayType(T.StructType([T.StructField("subject", T.StringType()), T.StructField("predicate", T.StringType()), T.StructField("object_value", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]))


@dataclass(frozen=True)
class Settings:
    """Typed settings from the environment; a value that does not parse falls back to the default."""

    min_chunk_chars: int = 100
    similarity_threshold: float = 85.0
    max_resolution_nodes: int = 2000
    max_retries: int = 3

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        got = {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            try:
                got[f.name] = type(f.default)(raw) if raw is not None else f.default
            except ValueError:
                got[f.name] = f.default
        return cls(**got)


def _json_arrays(spark: SparkSession, path: str, pattern: str, schema: T.DataType) -> DataFrame:
    """file, pos and fields of each array element; a file that does not parse has one row with pos null."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", schema).alias("rows"))
    return raw.select("file", F.posexplode_outer("rows").alias("pos", "r")).select("file", "pos", "r.*")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Parsed elements of all *.json files; unreadable files are left out."""
    return _json_arrays(spark, path, "*.json", ELEMENT).where("pos is not null")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of all *_triples.json files in file and array order; a corrupt file shows as a row with pos null."""
    return _json_arrays(spark, path, "*_triples.json", TRIPLE)


def file_errors(triples: DataFrame) -> DataFrame:
    return triples.groupBy("file").agg(F.count("pos").alias("processed"), F.max(F.col("pos").isNull().cast("int")).alias("errors"))


def write_elements(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).json(path)


def write_triples(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_reports(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Binary report files: path, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def first_n_distinct(df: DataFrame, key: str, order: list[str], n: int = 5, succeeded: Column | None = None) -> DataFrame:
    """The first row of each key, and of those the first n. A row that did not succeed is not seen: a later one of its key takes its place."""
    df = df if succeeded is None else df.where(F.coalesce(succeeded, F.lit(False)))
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("o"))
    return first.orderBy(*[f"o.{c}" for c in order]).limit(n).select(key, "o.*")


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without an output yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by label, edges by type, so a label or type filter prunes folders."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def preflight(path: str, pattern: str = ".json", spark: SparkSession | None = None) -> bool:
    """Whether the folder is there and holds at least one input; with a session, on whatever storage it reaches."""
    if spark is None:
        return os.path.isdir(path) and any(f.endswith(pattern) for f in os.listdir(path))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, f"*{pattern}"))
    return found is not None and len(found) > 0


def erp_fixture(names: DataFrame, column: str, categories: list[str], regions: list[str], n: int = 20) -> DataFrame:
    """Deterministic supplier records for names, in place of a random mock: every column follows from a hash of the name."""
    h = lambda salt: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(column)).cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(1_000_003))
    pick = lambda salt, xs: F.element_at(F.array(*map(F.lit, xs)), (h(salt) % len(xs) + 1).cast("int"))
    base = names.select(column).distinct().orderBy(column).limit(n)
    return base.select(F.col(column).alias("supplier_name"), F.round(500_000 + h("spend") * 49.5, 2).alias("annual_spend_usd"), pick("category", categories).alias("spend_category"), pick("region", regions).alias("region"), F.when(h("tier") % 5 < 3, 1).otherwise(2).alias("tier"), (h("active") % 4 != 0).alias("contract_active"))
