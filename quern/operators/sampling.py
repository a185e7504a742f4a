"""Deterministic samples for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_col: str, seed: int) -> Column:
    """A shuffled order that any engine can reproduce."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(id_col)), 256)


def seeded_sample(df: DataFrame, id_col: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows in hash order."""
    return df.orderBy(hash_order(id_col, seed), id_col).limit(size)


def edge_samples(chunks: DataFrame) -> DataFrame:
    """First, middle and last chunk and the first cross-page chunk of every source."""
    w = Window.partitionBy("source_id")
    o = w.orderBy("chunk_id")
    crossing = F.col("pdf_page_end") > F.col("pdf_page_start")
    x = chunks.withColumn("_i", F.row_number().over(o)).withColumn("_n", F.count("*").over(w)).withColumn("_c", F.min(F.when(crossing, F.col("chunk_id"))).over(w))
    pick = F.array_join(F.filter(F.array(F.when(F.col("_i") == 1, F.lit("first")), F.when(F.col("_i") == F.floor((F.col("_n") + 1) / 2), F.lit("middle")), F.when(F.col("_i") == F.col("_n"), F.lit("last")), F.when(F.col("chunk_id") == F.col("_c"), F.lit("cross_page"))), lambda v: v.isNotNull()), "|")
    return x.withColumn("sample_reason", pick).where("sample_reason <> ''").drop("_i", "_n", "_c")


def review_sample(chunks: DataFrame, size: int, high_risk: Column, seed: int = 42) -> DataFrame:
    """Chunks that must be reviewed (manual tables, high risk, continuations with their first part, the last of each source), filled up to ``size`` in hash order.

    The forced rows may be more than ``size``; then nothing is filled.  A row's
    reason is the first that applies.
    """
    last = chunks.groupBy("source_id").agg(F.max("chunk_id").alias("chunk_id")).withColumn("_last", F.lit(True))
    x = chunks.join(last, ["source_id", "chunk_id"], "left")
    continued = x.where("context_repeated").select("node_id").distinct().withColumn("_cont", F.lit(True))
    x = x.join(continued, "node_id", "left")
    reason = F.when(F.col("content_type") == "manual_table_chunk", "manual_table").when(F.coalesce(high_risk, F.lit(False)), "high_risk").when(F.coalesce(F.col("context_repeated"), F.lit(False)), "continuation").when(F.col("_cont") & F.col("chunk_id").rlike("-C0*1$"), "continuation_start").when(F.col("_last"), "last_of_source")
    x = x.withColumn("sample_reason", reason)
    forced = x.where("sample_reason IS NOT NULL").select("chunk_id", "source_id", "sample_reason")
    n = forced.agg(F.count("*").alias("forced"))  # one row
    rest = x.where("sample_reason IS NULL").select("chunk_id", "source_id", hash_order("chunk_id", seed).alias("_h")).orderBy("_h", "chunk_id").limit(size)
    rest = rest.withColumn("_k", F.row_number().over(Window.orderBy("_h", "chunk_id"))).crossJoin(F.broadcast(n))  # at most size rows
    fill = rest.where(F.col("_k") + F.col("forced") <= size).select("chunk_id", "source_id", F.lit("fill").alias("sample_reason"))
    return forced.unionByName(fill)
