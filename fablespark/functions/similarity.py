"""String similarity that the JVM has no function for, as Arrow-batched UDFs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one integer as bit vector of a row."""
    places: dict[str, int] = {}
    for k, c in enumerate(b):
        places[c] = places.get(c, 0) | (1 << k)
    row = 0
    for c in a:
        here = places.get(c, 0) | row
        row = here & (here ^ (here - ((row << 1) | 1)))
    return row.bit_count()


def ratio(a: str | None, b: str | None) -> int | None:
    """200 times the common subsequence over both lengths, rounded; 100 for two empty strings."""
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    return round(200 * common_subsequence(a, b) / total) if total else 100


@F.pandas_udf(IntegerType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="Int32")


def alike(a: str, b: str, least: float = 0.85) -> bool:
    """Whether two texts are alike by matching blocks, case ignored; the order of the two matters."""
    return SequenceMatcher(None, a.lower(), b.lower()).ratio() >= least
