"""Session-level helpers shared by every operator: table access, checkpoints, guarded broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast side may have at most; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only where none is named (tests), a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "pathweave-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and cut its lineage; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` stay within ``limit``, else as it is (shuffled join)."""
    return F.broadcast(df) if rows <= limit else df


def norm_key(c: Column | str) -> Column:
    """Key for case- and blank-insensitive comparison."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def round6(c: Column | str) -> Column:
    """Doubles rounded to 6 places so sums in any order agree."""
    return F.round(c, 6)
