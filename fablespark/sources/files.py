"""Reading and writing of JSON, JSON lines, text and binary files with declared schemas."""

from __future__ import annotations

import json
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession

from fablespark.runtime import small_rows


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False, corrupt: str | None = None) -> DataFrame:
    """JSON documents, or with ``lines`` one object per line; ``corrupt`` names a column for rows that can't be read."""
    full = f"{schema}, {corrupt} STRING" if corrupt else schema
    reader = spark.read.schema(full).option("mode", "PERMISSIVE").option("multiLine", not lines)
    return (reader.option("columnNameOfCorruptRecord", corrupt) if corrupt else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object per line, replacing what is there; characters beyond ASCII stay as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) per line, without the line feed."""
    return spark.read.text(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(value) per file."""
    return spark.read.text(path, wholetext=True)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of the files that match; raises if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path).select("path", "length", "modificationTime")
    if files.isEmpty():
        raise FileNotFoundError(f"no file {pattern} in {path}")
    return files.orderBy("path")


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder if it is there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files of a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Named tables as parquet folders below a path, replacing what is there: the stored form of intermediate results."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def write_document(df: DataFrame, path: str, most: int = 10_000) -> None:
    """A small result (at most ``most`` rows, checked) as one readable JSON document: a list of objects, indented, keys sorted."""
    rows = [r.asDict(recursive=True) for r in small_rows(df, most)]
    text = json.dumps(rows, ensure_ascii=False, indent=2, sort_keys=True, default=str)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def copy_files(spark: SparkSession, source: str, target: str, pattern: str = "*", exclude: str | None = None) -> int:
    """Copies the files of a folder whose names match a pattern and not the other; the number of files copied."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(source)
    names = [f.getPath().getName() for f in folder.getFileSystem(conf).listStatus(folder) if f.isFile()]
    wanted = [n for n in names if fnmatch(n, pattern) and not (exclude and fnmatch(n, exclude))]
    return sum(copy(spark, f"{source}/{n}", f"{target}/{n}", overwrite=True) for n in wanted)


def copy(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> bool:
    """Copies a file or folder; False if the target is there and not to be overwritten."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    if b.getFileSystem(conf).exists(b) and not overwrite:
        return False
    return jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, overwrite, conf)
