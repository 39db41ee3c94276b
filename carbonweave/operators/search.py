"""Name search: an inverted index with BM25, and plain containment."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carbonweave.functions.text import contains_fold
from carbonweave.session import small

K1, B = 1.2, 0.75


def tokens(c: F.Column) -> F.Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(names: DataFrame, column: str, query: str, limit: int = 20) -> DataFrame:
    """name, score of the best `limit` names for the query's tokens; names without one are left out before anything is grouped."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1..100")
    words = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    n = names.select(F.col(column).alias("name")).where("name is not null").distinct().select("name", tokens(F.col("name")).alias("ts"))
    sizes = n.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("mean"))
    total, mean = sizes.select("n").scalar(), sizes.select("mean").scalar()
    asked = F.array(*map(F.lit, words)).cast("array<string>")
    held = n.where(F.arrays_overlap("ts", asked)).select("name", "ts", F.explode(F.array_intersect("ts", asked)).alias("token"))
    hits = held.select("name", "token", F.size("ts").alias("length"), F.size(F.filter("ts", lambda t: t == F.col("token"))).alias("tf"))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    # At most one row per word of the query.
    scored = hits.join(F.broadcast(df), "token").withColumn("n", total).withColumn("mean", mean)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.groupBy("name").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "name").limit(limit)


def containing(names: DataFrame, column: str, part: str, limit: int = 20) -> DataFrame:
    return names.where(contains_fold(F.col(column), F.lit(part))).select(F.col(column).alias("name")).distinct().orderBy("name").limit(limit)


def trigrams(c: F.Column) -> F.Column:
    s = F.lower(c)
    return F.when(F.length(s) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: s.substr(i, F.lit(3)))))


def containing_any(names: DataFrame, name: str, parts: DataFrame, part: str) -> DataFrame:
    """Pairs of a name and a part (three letters or more) that it contains, case aside.

    A name that contains a part contains the part's first three letters, so an equi-join on those finds
    every pair; no name meets every part.
    """
    p = parts.where(F.length(part) >= 3).withColumn("cw_tri", F.lower(F.substring(part, 1, 3)))
    n = names.withColumn("cw_tri", F.explode(trigrams(F.col(name))))
    return n.join(small(p), "cw_tri").where(contains_fold(F.col(name), F.col(part))).drop("cw_tri").distinct()
