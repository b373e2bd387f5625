"""Chapters from pages: filters, title and body, numbering, and statistics of paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fablespark.functions import text as tx
from fablespark.params import ChapterFilter
from fablespark.runtime import list_or_empty


def long_enough(chapters: DataFrame, p: ChapterFilter = ChapterFilter(), paragraphs: str = "paragraphs") -> DataFrame:
    """Chapters with the least number of characters (paragraphs joined by a blank line) and of paragraphs; null counts as empty."""
    whole = F.length(F.array_join(list_or_empty(F.col(paragraphs)), "\n\n"))
    return chapters.where((whole >= p.min_chars) & (F.size(list_or_empty(F.col(paragraphs))) >= p.min_paragraphs))


def numbered(chapters: DataFrame, book: str, order: list[str], number: str = "chapter_num") -> DataFrame:
    """Chapters numbered from 1 within their book, without gaps; to be applied after the filters."""
    return chapters.withColumn(number, F.row_number().over(Window.partitionBy(book).orderBy(*order)))


def build_chapters(pages: DataFrame, p: ChapterFilter = ChapterFilter(), parity: bool = False) -> DataFrame:
    """Chapter records of pages (book_num, position, paragraphs): filtered, title and body separated, numbered, measured.

    char_count is of the whole page, header included; paragraph_count of the body. With ``parity`` the paragraph lengths
    leave out two more paragraphs of the body.
    """
    kept = numbered(long_enough(pages, p), "book_num", ["position"])
    body = F.slice("paragraphs", p.header_paragraphs + 1, F.greatest(F.size("paragraphs") - p.header_paragraphs, F.lit(1)))
    parted = kept.select(
        "book_num",
        "chapter_num",
        F.try_element_at("paragraphs", F.lit(p.title_index + 1)).alias("chapter_title"),
        body.alias("paragraphs"),
        F.length(F.array_join("paragraphs", "\n\n")).alias("char_count"),
    )
    measured = F.slice("paragraphs", 3, 1_000_000_000) if parity else F.col("paragraphs")
    lengths = F.transform(measured, lambda x: F.length(x))
    total = F.aggregate(lengths, F.lit(0), lambda s, x: s + x)
    return parted.select(
        "book_num",
        "chapter_num",
        "chapter_title",
        "paragraphs",
        F.size("paragraphs").alias("paragraph_count"),
        "char_count",
        F.coalesce(F.array_min(lengths), F.lit(0)).alias("paragraph_min_chars"),
        F.coalesce(F.array_max(lengths), F.lit(0)).alias("paragraph_max_chars"),
        F.coalesce(F.floor(F.try_divide(total, F.size(lengths))), F.lit(0)).cast("int").alias("paragraph_avg_chars"),
    )


def paragraph_rows(chapters: DataFrame, keys: list[str], paragraphs: str = "paragraphs") -> DataFrame:
    """(keys, position, paragraph), position from 0; null paragraphs are left out."""
    return chapters.select(*keys, F.posexplode(paragraphs).alias("position", "paragraph")).where("paragraph IS NOT NULL")


def paragraph_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number, least, greatest and average length (rounded down) of the paragraphs of each key."""
    n = F.length("paragraph")
    return rows.groupBy(*keys).agg(F.count("*").alias("paragraphs"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.floor(F.avg(n)).alias("avg_chars"))


def short_paragraphs(rows: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """Paragraphs shorter than a share of the average of their key."""
    average = F.avg(F.length("paragraph")).over(Window.partitionBy(*keys))
    return rows.withColumn("average", average).where(F.length("paragraph") < share * F.col("average")).select(*keys, "position", F.length("paragraph").alias("chars"))


def word_distribution(rows: DataFrame) -> DataFrame:
    """Mean, population deviation, percentiles and deviation bands of the words per paragraph, in one row."""
    counted = rows.select(tx.word_count(F.col("paragraph")).alias("n"))
    cuts = [("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99_5", 0.995)]
    out = counted.agg(F.count("*").alias("paragraphs"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.percentile("n", F.array(*[F.lit(c) for _, c in cuts])).alias("p"))
    bands = [(f"{side}{k}_std", F.col("mean") + sign * k * F.col("std")) for k in (1, 2) for side, sign in (("minus_", -1), ("plus_", 1))]
    return out.select("paragraphs", *[F.round(c, 6).alias(c) for c in ("mean", "std")], *[F.round(F.col("p")[k], 6).alias(name) for k, (name, _) in enumerate(cuts)], *[F.round(e, 6).alias(name) for name, e in bands])


def latest(df: DataFrame, keys: list[str], time: str = "ingested_at") -> DataFrame:
    """One row per key: the one that was delivered last, and of those the greatest by all columns that can be ordered.

    Rows are few to a key, so they are shuffled as they are and aggregated once; a fixed number of partitions keeps what follows on
    long texts spread over all cores. Columns that are not needed are best left out of ``df``.
    """
    rest = [c for c in df.columns if c not in (*keys, time)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(parts, *keys)
    return rows.groupBy(*keys).agg(F.max(F.struct(time, *rest)).alias("row")).select(*keys, *[F.col(f"row.{c}").alias(c) for c in (time, *rest)]).select(*df.columns)
