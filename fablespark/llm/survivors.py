"""Best representative of each duplicate group by skyline selection.

Every record of a group is a point in five criteria. Its first dominance layer is the skyline, the second that of the rest, and so on. A
lexicographic policy picks the base record from the first layer, and each null field is filled from the first layer that has a value.
The first layer and the best records that have each field come from skylines: a skyline of a union comes from the skylines of its
parts, so partitions are thinned out before the shuffle and a group that holds a third of the rows is no single task's work. Only
where the first layer lacks a field are deeper layers counted: a record's layer is the longest chain of records above it, so only
records above those that have the field are read again, in order of time and with one number kept per combination of the other criteria.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablespark.runtime import cleaned, cut, list_or_empty

KEY = ["book_num", "entity_type", "clean_name"]
CRITERIA = ["description_length", "alias_count", "chapter_count", "extracted_us", "trust"]
#: Fields that may be null, each with its bit in ``has``.
FIELDS = {"description": 1, "aliases": 2, "source_chapters": 4, "extractor_id": 8}
#: Order of the policy: first the criterion that decides.
POLICY = ["trust", "extracted_us", "description_length", "alias_count", "chapter_count"]

_POINTS = "book_num int, entity_type string, clean_name string, description_length long, alias_count long, chapter_count long, extracted_us long, trust long, has int, first_id long, last_id long, group_first long, group_last long"
_OPEN = "array<struct<field: string, id: bigint, description_length: bigint, alias_count: bigint, chapter_count: bigint, extracted_us: bigint, trust: bigint>>"
_PICKS = f"book_num int, entity_type string, clean_name string, base_id long, description_from long, aliases_from long, source_chapters_from long, extractor_id_from long, dominant boolean, open {_OPEN}"
_FILLED = "book_num int, entity_type string, clean_name string, field string, id long"
_MISSING_TIME = -(1 << 62)


def measure(entities: DataFrame, extractors: DataFrame) -> DataFrame:
    """(key, criteria, has, mention_id) of every record that is in a group.

    Length of a null description and trust of a missing extractor are 0; aliases count distinct values that are neither null
    nor blank, as stored; chapters count distinct values; a null extracted_at is before any other. ``has`` has the bits of the fields that
    have a value.
    """
    trust = extractors.where("extractor_id IS NOT NULL").groupBy("extractor_id").agg(F.max("trust").alias("trust"))
    visible = F.filter(list_or_empty(F.col("aliases")), lambda a: a.isNotNull() & (F.trim(a) != ""))
    chapters = F.filter(list_or_empty(F.col("source_chapters"), "array<int>"), lambda c: c.isNotNull())
    has = F.lit(0)
    for field, there in (("description", F.length(F.trim("description")) > 0), ("aliases", F.size(visible) > 0), ("source_chapters", F.size(chapters) > 0), ("extractor_id", F.col("extractor_id").isNotNull())):
        has = has + F.when(there, FIELDS[field]).otherwise(0)
    return (
        entities.select("mention_id", "book_num", "entity_type", "name", "description", "aliases", "source_chapters", "extractor_id", "extracted_at")
        .join(trust, "extractor_id", "left")
        .select(
            "book_num",
            "entity_type",
            cleaned(F.col("name")).alias("clean_name"),
            F.coalesce(F.length("description"), F.lit(0)).cast("long").alias("description_length"),
            F.size(F.array_distinct(visible)).cast("long").alias("alias_count"),
            F.size(F.array_distinct(chapters)).cast("long").alias("chapter_count"),
            F.coalesce(F.unix_micros(F.col("extracted_at").cast("timestamp")), F.lit(_MISSING_TIME)).alias("extracted_us"),
            F.coalesce("trust", F.lit(0)).cast("long").alias("trust"),
            has.alias("has"),
            "mention_id",
        )
        .where("book_num IS NOT NULL AND entity_type IS NOT NULL AND clean_name IS NOT NULL AND mention_id IS NOT NULL")
    )


def latest_points(points: DataFrame) -> DataFrame:
    """One point per distinct combination of criteria and fields: of records that differ in extracted_at alone the latest, which dominates the others.

    ``first_id`` and ``last_id`` are the smallest and the largest mention_id at the point, ``group_first`` and ``group_last`` those of all
    records it stands for.
    """
    rest = [*KEY, "description_length", "alias_count", "chapter_count", "trust", "has"]
    return (
        points.groupBy(*rest)
        .agg(
            F.max(F.struct("extracted_us", (-F.col("mention_id")).alias("id"))).alias("a"),
            F.max(F.struct("extracted_us", F.col("mention_id").alias("id"))).alias("b"),
            F.min("mention_id").alias("group_first"),
            F.max("mention_id").alias("group_last"),
        )
        .select(*KEY, "description_length", "alias_count", "chapter_count", F.col("a.extracted_us").alias("extracted_us"), "trust", "has", (-F.col("a.id")).alias("first_id"), F.col("b.id").alias("last_id"), "group_first", "group_last")
    )


def skyline(points: np.ndarray) -> np.ndarray:
    """Mask of the rows that no other row dominates (at least as large in all columns and larger in one)."""
    n = len(points)
    if n == 1:
        return np.ones(1, dtype=bool)
    order = np.lexsort(points.T[::-1])[::-1]  # a row can only be dominated by one before it
    kept: list[int] = []
    front = np.empty_like(points)
    for i in order:
        row = points[i]
        k = len(kept)
        if k and ((front[:k] >= row).all(axis=1) & (front[:k] > row).any(axis=1)).any():
            continue
        front[k] = row
        kept.append(i)
    mask = np.zeros(n, dtype=bool)
    mask[kept] = True
    return mask


def candidates(points: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Mask of the skyline and of the skyline of the rows that have each field."""
    keep = skyline(points)
    for bit in FIELDS.values():
        rows = np.flatnonzero(has & bit)
        if len(rows) and not (keep[rows].all()):
            keep[rows[skyline(points[rows])]] = True
    return keep


def _groups(batch: pd.DataFrame) -> Iterator[np.ndarray]:
    """Row numbers of each group of a batch."""
    codes = batch.groupby(KEY, sort=False).ngroup().to_numpy()
    order = np.argsort(codes, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)


def _thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates of each group within a batch; the ids of dropped rows stay in group_first and group_last."""
    for batch in batches:
        if batch.empty:
            continue
        points, has = batch[CRITERIA].to_numpy(), batch["has"].to_numpy()
        first, last = batch["group_first"].to_numpy().copy(), batch["group_last"].to_numpy().copy()
        keep = np.ones(len(batch), dtype=bool)
        for rows in _groups(batch):
            if len(rows) > 1:
                keep[rows] = candidates(points[rows], has[rows])
                first[rows], last[rows] = first[rows].min(), last[rows].max()
        yield batch.assign(group_first=first, group_last=last)[keep]


def _policy_order(points: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, *(-points[:, CRITERIA.index(c)] for c in reversed(POLICY))))


def _pick(points: np.ndarray, has: np.ndarray, ids: np.ndarray, last_ids: np.ndarray) -> tuple:
    """(base, one id per field or None, dominant, open) of one group; a field that the first layer lacks leaves its skyline open."""
    top = np.flatnonzero(skyline(points))
    order = top[_policy_order(points[top], ids[top])]
    found, open_fields = [], []
    for field, bit in FIELDS.items():
        found.append(next((int(ids[k]) for k in order if has[k] & bit), None))
        rows = np.flatnonzero(has & bit)
        if found[-1] is None and len(rows):
            best = rows[skyline(points[rows])]
            open_fields += [(field, int(ids[k]), *map(int, points[k])) for k in best]
    alone = (points[top] == points[top[0]]).all() and len(top) == 1 and ids[top[0]] == last_ids[top[0]]
    return int(ids[order[0]]), *found, bool(alone), [dict(zip(("field", "id", *CRITERIA), x)) for x in open_fields]


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The picks of each group; the input has all rows of a group next to each other."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        tail = (rest[KEY] == rest[KEY].iloc[-1]).all(axis=1).to_numpy()
        yield _picks(rest[~tail])
        rest = rest[tail].reset_index(drop=True)
        if len(rest) > 5000:  # a hot group arrives in several batches: thin it out as it comes
            rest = next(_thin(iter([rest])), rest).reset_index(drop=True)
    if rest is not None:
        yield _picks(rest)


def _picks(batch: pd.DataFrame) -> pd.DataFrame:
    rows = []
    if len(batch):
        points, has = batch[CRITERIA].to_numpy(), batch["has"].to_numpy()
        first, last = batch["first_id"].to_numpy(), batch["last_id"].to_numpy()
        group_first, group_last = batch["group_first"].to_numpy(), batch["group_last"].to_numpy()
        keys = batch[KEY].to_numpy()
        for at in _groups(batch):
            if group_first[at].min() != group_last[at].max():
                rows.append((*keys[at[0]], *_pick(points[at], has[at], first[at], last[at])))
    out = pd.DataFrame(rows, columns=[*KEY, "base_id", *[f"{f}_from" for f in FIELDS], "dominant", "open"])
    return out.astype({f"{f}_from": "Int64" for f in FIELDS})


def chain_lengths(batches: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Layers of the distinct points of one group, which come in falling order of time and then of the other criteria.

    The layer is one more than the greatest layer above; per combination of the criteria beside time the greatest so far is kept.
    """
    at = CRITERIA.index("extracted_us")
    combos, layers, place = np.zeros((0, len(CRITERIA) - 1), dtype=np.int64), np.zeros(0, dtype=np.int64), {}
    for points in batches:
        rest = np.delete(points, at, axis=1)
        out = np.empty(len(points), dtype=np.int64)
        for k, row in enumerate(rest):
            above = (combos[: len(place)] >= row).all(axis=1)
            out[k] = 1 + (layers[: len(place)][above].max() if above.any() else 0)
            key = row.tobytes()
            if key not in place:
                place[key] = len(place)
                if len(place) > len(combos):
                    grown = max(64, 2 * len(combos))
                    combos = np.concatenate([combos, np.zeros((grown - len(combos), combos.shape[1]), dtype=np.int64)])
                    layers = np.concatenate([layers, np.zeros(grown - len(layers), dtype=np.int64)])
                combos[place[key]] = row
            layers[place[key]] = out[k]
        yield out


def _fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, field, id): of the records that are open for a field the one of the first layer, by policy.

    The input has the points of a group next to each other, in falling order, with the ids that are open at each (null at most).
    """
    group, state, best = None, None, {}

    def decided() -> pd.DataFrame:
        rows = [(*group, field, x[-1]) for field, x in best.items()]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _FILLED.split(", ")])

    for batch in batches:
        codes = (batch[KEY] != batch[KEY].shift()).any(axis=1).cumsum()
        for _, part in batch.groupby(codes, sort=False):
            key = tuple(part[KEY].iloc[0])
            if key != group:
                if best:
                    yield decided()
                group, best, feed = key, {}, []
                state = chain_lengths(feed.pop(0) for _ in count())
            points = part[CRITERIA].to_numpy()
            feed.append(points)
            for layer, point, wanted in zip(next(state), points, part["wanted"]):
                for x in wanted if wanted is not None else ():
                    rank = (int(layer), *(-int(point[CRITERIA.index(c)]) for c in POLICY), int(x["id"]))
                    best[x["field"]] = min(best.get(x["field"], rank), rank)
    if best:
        yield decided()


def choose(entities: DataFrame, extractors: DataFrame) -> DataFrame:
    """One row per group of two or more records: the base record and the record of its first layer that each field comes from.

    A group is equal book_num, entity_type and cleaned name; rows without one of them, or without mention_id, are in none.
    ``dominant`` says that the base is the only record which no other record of the group exceeds in any criterion. Ties of the
    policy go to the smallest mention_id. A field that the first layer lacks has a null source; ``open`` has the best records that have it.
    """
    thinned = latest_points(measure(entities, extractors)).mapInPandas(_thin, _POINTS)
    return thinned.repartition(*KEY).sortWithinPartitions(*KEY).mapInPandas(_decide, _PICKS)


def choose_all(entities: DataFrame, extractors: DataFrame) -> DataFrame:
    """``choose`` with the fields that the first layer lacks filled from the next layer that has them; only values null in all records stay null."""
    picks = cut(choose(entities, extractors))
    wanted = picks.select(*KEY, F.explode("open").alias("x")).select(*KEY, "x.*")
    if wanted.isEmpty():
        return picks.drop("open")
    # Of the groups' points those at or above an open record, each distinct point once with the records that are open at it.
    goals = wanted.select(*KEY, *[F.col(c).alias(f"_{c}") for c in CRITERIA]).distinct()
    above = reduce(and_, [F.col(c) >= F.col(f"_{c}") for c in CRITERIA])
    points = measure(entities, extractors).select(*KEY, *CRITERIA).distinct().join(goals, KEY).where(above).select(*KEY, *CRITERIA).distinct()
    marks = wanted.groupBy(*KEY, *CRITERIA).agg(F.collect_list(F.struct("field", "id")).alias("wanted"))
    falling = [F.desc(c) for c in ("extracted_us", *[c for c in CRITERIA if c != "extracted_us"])]
    filled = points.join(marks, [*KEY, *CRITERIA], "left").repartition(*KEY).sortWithinPartitions(*KEY, *falling).select(*KEY, *CRITERIA, "wanted").mapInPandas(_fill, _FILLED)
    of = filled.groupBy(*KEY).agg(*[F.max(F.when(F.col("field") == f, F.col("id"))).alias(f"_{f}") for f in FIELDS])
    joined = picks.drop("open").join(of, KEY, "left")
    return joined.select(*KEY, "base_id", *[F.coalesce(f"{f}_from", f"_{f}").alias(f"{f}_from") for f in FIELDS], "dominant")


def survivors(entities: DataFrame, extractors: DataFrame) -> DataFrame:
    """The surviving record of each group, built field by field from the records that ``choose_all`` names.

    If a mention_id is stored more than once with other values, its greatest row by name, description and the further columns speaks.
    """
    picks = choose_all(entities, extractors)
    roles = F.array(*[F.struct(F.lit(f).alias("role"), F.col(c).alias("mention_id")) for f, c in (("base", "base_id"), *((f, f"{f}_from") for f in FIELDS))])
    wanted = picks.select(*KEY, "dominant", F.explode(roles).alias("x")).select(*KEY, "dominant", "x.*").where("mention_id IS NOT NULL")
    values = ["name", "description", "aliases", "source_chapters", "extractor_id", "extracted_at"]
    records = entities.groupBy("mention_id").agg(F.max(F.struct(*values)).alias("r")).select("mention_id", "r.*")
    rows = wanted.join(records, "mention_id")
    of = lambda role, c: F.max_by(c, F.when(F.col("role") == role, F.lit(1)))
    return (
        rows.groupBy(*KEY)
        .agg(
            of("base", "mention_id").alias("mention_id"),
            of("base", "name").alias("name"),
            of("description", "description").alias("description"),
            of("aliases", "aliases").alias("aliases"),
            of("source_chapters", "source_chapters").alias("source_chapters"),
            of("extractor_id", "extractor_id").alias("extractor_id"),
            of("base", "extracted_at").alias("extracted_at"),
            F.bool_or("dominant").alias("dominant"),
        )
    )
