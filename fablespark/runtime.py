"""Session-level helpers shared by all operators: table access, lineage cuts, small-table checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ``str.strip`` style trimming removes; one list for Spark and for the SQL oracles.
BLANKS = " \t\n\r\u00a0\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only a local session without one gets a temporary folder, removed at the end.

    Checkpoints that nothing refers to any more are deleted by Spark where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        folder = tempfile.mkdtemp(prefix="fablespark-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_rows(df: DataFrame, most: int = 10_000) -> list:
    """Rows of a parameter table on the driver; raises if the table is larger than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a parameter table has more than {most} rows")
    return rows


def union_all(frames: list[DataFrame], missing: bool = False) -> DataFrame:
    """UNION ALL of frames with equal columns; with ``missing`` columns that a frame lacks are null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)


def cleaned(c: Column) -> Column:
    """Lower case, runs of spaces made one, no spaces at the ends; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), " +", " ")), F.lit(""))


def list_or_empty(c: Column, kind: str = "array<string>") -> Column:
    """An array column with null read as the empty array."""
    return F.coalesce(c, F.array().cast(kind))
