"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fablespark.runtime import BLANKS


def strip(c: Column | str) -> Column:
    """White space taken off both ends."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def normalise(c: Column | str) -> Column:
    """Lower case without white space at the ends."""
    return F.lower(strip(c))


def collapse_breaks(c: Column) -> Column:
    """Three or more line feeds become two, runs of spaces one."""
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), " +", " ")


def blank_line_parts(c: Column, loose: bool = False) -> Column:
    """Parts between blank lines, stripped, empty ones left out; ``loose`` takes lines of white space as blank."""
    parts = F.split(c, "\n\\s*\n+" if loose else "\n\n")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def sentences(c: Column) -> Column:
    """Sentences of a text: a cut after each . ! or ? that white space follows."""
    return F.filter(F.transform(F.split(c, "(?<=[.!?])\\s+"), strip), lambda s: s != "")


def words(c: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.when(strip(c) == "", F.array().cast("array<string>")).otherwise(F.split(strip(c), "\\s+"))


def word_count(c: Column) -> Column:
    """Number of words, the default token count; null counts as 0."""
    return F.coalesce(F.size(words(c)), F.lit(0))


def char_slices(c: Column, width: int) -> Column:
    """Consecutive slices of at most ``width`` characters; an empty text has none."""
    starts = F.sequence(F.lit(1), F.length(c), F.lit(width))
    return F.when(F.length(c) > 0, F.transform(starts, lambda i: F.substring(c, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def approx_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(c) / 4)


def preview(c: Column, width: int = 1000, empty: str = "[Empty chunk]") -> Column:
    """The first ``width`` characters, or a mark for an empty text."""
    return F.coalesce(F.nullif(F.substring(c, 1, width), F.lit("")), F.lit(empty))


def chunk_id(book: Column, chapter: Column, index: Column) -> Column:
    return F.format_string("book_%02d_ch_%02d_chunk_%03d", book, chapter, index)


def scene_id(book: Column, chapter: Column, index: Column, kind: str = "scene") -> Column:
    return F.format_string(f"book_%02d_ch_%02d_{kind}_%03d", book, chapter, index)


def literal_pattern(term: Column) -> Column:
    """A term with the characters escaped that mean something in a pattern."""
    return F.regexp_replace(term, "([\\\\.^$|?*+()\\[\\]{}])", "\\\\$1")


def mentions(text: Column, term: Column) -> Column:
    """Whether a text mentions a term: a term with a space as part of the text, any other as a whole word; case is ignored."""
    low = F.lower(term)
    word = F.concat(F.lit("(^|[^\\p{L}\\p{N}_])"), literal_pattern(low), F.lit("($|[^\\p{L}\\p{N}_])"))
    return F.when(F.contains(term, F.lit(" ")), F.contains(F.lower(text), low)).otherwise(F.rlike(F.lower(text), word))
