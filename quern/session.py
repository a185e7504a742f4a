"""Session helpers that every operator shares."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one parquet table; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared spark.checkpoint.dir; a folder of our own only in local mode, an error on a cluster that names none."""
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="quern-checkpoint-")
            atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The written copy survives the loss of executors and ends the lineage, which
    the iterative operators need: without it each round would replan all rounds before.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def blank(c) -> F.Column:
    """True where the text is null, empty or white space only (Unicode white space)."""
    return F.coalesce(F.regexp_replace(c, r"(?U)\s+", "") == "", F.lit(True))


def strip(c) -> F.Column:
    """Python's str.strip: Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def default_tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; QUERN_TOKENIZERS names another folder."""
    return os.path.join(os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers"), name)
