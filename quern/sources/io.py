"""Scans and sinks: CSV with byte order mark, JSON lines, snapshots, hashes, embedding cache."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import strip


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with header; a byte order mark is skipped, missing cells are empty strings, string cells are stripped."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    return df.select([strip(F.coalesce(F.col(f"`{f.name}`"), F.lit(""))).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def read_keyed_csv(spark: SparkSession, path: str, schema: T.StructType | str, key: str) -> DataFrame:
    """As read_csv; an empty or repeated key is an error."""
    return require_key(read_csv(spark, path, schema), key)


def require_key(df: DataFrame, key: str) -> DataFrame:
    bad = df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull() | (F.col(key) == "")).limit(1).collect()
    if bad:
        raise ValueError(f"{key} is empty or repeated: {bad[0][0]!r}")
    return df


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines, one file or a glob of them; blank lines are skipped, a bad line is an error if strict, else a row of nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_pages(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Pages of one or several JSON-lines files, in the order of source and page, which sorts by ranges."""
    return read_jsonl(spark, path, schema).orderBy("source_id", "pdf_page_number")


def latest_per_key(df: DataFrame, key: str, order: str, reject: bool = False) -> DataFrame:
    """One row per key, that of the greatest ``order``; with ``reject`` a repeated key is an error instead."""
    if reject:
        return require_key(df, key)
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*[F.to_json(F.struct(c)) for c in df.columns]))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header and byte order mark; nulls are empty cells; an empty table is refused."""
    if df.isEmpty():
        raise ValueError("nothing to write")
    plain = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c in df.columns]
    # The header is written first in every part, so the mark stands in front of its first name.
    df.select(plain).withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]).write.mode(mode).option("header", True).option("escape", "\"").option("emptyValue", "").option("nullValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What an interrupted run has still to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def append_done(df: DataFrame, path: str) -> None:
    """Adds finished rows; each task's file is committed by itself with the write."""
    df.write.mode("append").parquet(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, hashed where they lie."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def snapshot(df: DataFrame, path: str) -> bool:
    """Writes an immutable copy; True if written, False if an equal one is there; a different one is an error."""
    content = lambda x: x.select(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(x.columns)]).cast("decimal(38,0)")).alias("h")).first()
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        if content(spark.read.parquet(path)) != content(df):
            raise ValueError(f"a different snapshot exists: {path}")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def content_signature(df: DataFrame, model: str, max_length: int, id_col: str, text_col: str) -> DataFrame:
    """Each row with the signature under which its embedding is cached."""
    return df.withColumn("signature", F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(str(max_length)), F.col(id_col), F.sha2(F.coalesce(text_col, F.lit("")), 256)), 256))


def missing_embeddings(signed: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose embedding is not in the cache yet."""
    return signed.join(cache.select("signature"), "signature", "left_anti")


def preview_pages(pages: DataFrame, source: str = "source_id", page: str = "pdf_page_number") -> DataFrame:
    """First, second, middle and last page of each source."""
    w = Window.partitionBy(source)
    ranked = pages.withColumn("_i", F.row_number().over(w.orderBy(page)) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.where((F.col("_i") < 2) | (F.col("_i") == F.floor(F.col("_n") / 2)) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def full_text(pages: DataFrame, source: str = "source_id", page: str = "pdf_page_number") -> DataFrame:
    """(source, text): pages in order, each under its heading line."""
    body = F.concat(F.lit("===== page "), F.col(page).cast("string"), F.lit(" =====\n"), F.coalesce("text", F.lit("")))
    return pages.groupBy(source).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), body.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def authoring_catalog(corpus: DataFrame) -> DataFrame:
    """The columns an author of questions needs, by source, title path and chunk."""
    cols = ["source_id", "chunk_id", "content_type", "display_title", "pdf_page_start", "pdf_page_end", "cross_page", "review_status", "char_count", "text"]
    return corpus.select(F.array_join("title_path", " > ").alias("title_path"), *cols).distinct().orderBy("source_id", "title_path", "chunk_id")


@dataclass(frozen=True)
class ChunkConfig:
    """Chunking parameters; from_json fills defaults, refuses unknown names and checks bounds."""

    target_chars: int = 1000
    max_chars: int = 1800
    min_chars: int = 120
    sentence_overflow_chars: int = 250
    overlap_chars: int = 120
    random_seed: int = 42

    def __post_init__(self):
        if not 0 < self.min_chars <= self.target_chars <= self.max_chars or not 0 <= self.overlap_chars < self.max_chars or self.sentence_overflow_chars < 0:
            raise ValueError(f"chunk sizes out of bounds: {self}")

    @classmethod
    def from_json(cls, text: str, private: str | None = None, required: tuple[str, ...] = ()) -> ChunkConfig:
        """A public configuration with a private one laid over it; ``required`` names must come from the private one."""
        given, over = json.loads(text), json.loads(private) if private else {}
        if missing := [k for k in required if k not in over]:
            raise ValueError(f"private configuration lacks {missing}")
        known = {f.name for f in fields(cls)}
        if unknown := set(given | over) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**(given | over))
