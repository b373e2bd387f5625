"""Mixing sources to target weights by Pfair scheduling of source blocks.

The token stream of a source (its documents in a hashed order, repeated while it may be) is cut into equal blocks. Block i of
a source with weight w is released at floor(i/w) and due at ceil((i+1)/w); earliest-deadline-first over the released blocks
keeps each source within one block of its weight at every slot. Weights are exact fractions, so the schedule has a
period, which is computed once; a block's slot follows from its number, and no schedule of the whole mix is ever gathered.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from math import gcd, lcm

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fablespark.runtime import cut, small_rows

#: Longest period of a schedule in blocks. Weights whose exact period is longer are rounded to it, none to less than one block.
LONGEST_PERIOD = 100_000


def period_schedule(weights: dict[str, int]) -> list[str]:
    """Source of each slot of one period; ``weights`` are blocks per period."""
    length, done, slots = sum(weights.values()), dict.fromkeys(weights, 0), []
    for slot in range(length):
        due = [(-(-(done[s] + 1) * length // n), s) for s, n in weights.items() if done[s] < n and done[s] * length // n <= slot]
        source = min(due)[1]
        done[source] += 1
        slots.append(source)
    return slots


def block_weights(shares: dict[str, float]) -> dict[str, int]:
    """Blocks per period of each positive share: the smallest integers in the proportion of the shares as they are written in decimals."""
    exact = {s: Fraction(str(w)) for s, w in sorted(shares.items()) if w and w > 0}
    scale = reduce(lcm, (w.denominator for w in exact.values()), 1)
    counts = {s: int(w * scale) for s, w in exact.items()}
    divisor = reduce(gcd, counts.values(), 0)
    counts = {s: n // divisor for s, n in counts.items()}
    total = sum(counts.values())
    return counts if total <= LONGEST_PERIOD else {s: max(1, round(Fraction(n * LONGEST_PERIOD, total))) for s, n in counts.items()}


def source_stream(tokens: DataFrame, documents_per_bucket: int = 50_000) -> DataFrame:
    """(source, doc_id, tokens, start): the documents' offsets in the token stream of their source.

    Offsets are running sums within hash buckets on top of the buckets' own prefix sums, so a source with a third of all
    documents is still spread over as many tasks as it has buckets.
    """
    rows = tokens.where("tokens > 0").select("source", "doc_id", "tokens")
    buckets = max(1, -(-rows.count() // documents_per_bucket))
    rows = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")).select("source", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("end", F.sum("tokens").over(within)).join(base, ["source", "bucket"]).select("source", "doc_id", "tokens", (F.col("base") + F.col("end") - F.col("tokens")).alias("start"))


def plan_mixes(targets: list, supply: dict[str, int], total_tokens: int | str | None = None) -> list[dict]:
    """One entry for each mix and source: share wanted, tokens wanted and to take, blocks per period.

    Without ``total_tokens`` a mix is as large as its scarcest source allows when repeated max_repeats times, so that all have their shares.
    With a number the mix has that size where it can, and with ``"supply"`` the size of all its sources together: each source is wanted with
    its share of it, and gives what it has when repeated max_repeats times. Sources without documents, or with a share or max_repeats that is null or not positive, contribute nothing and
    their share is divided among the others in proportion.
    """
    mixes: dict[str, dict[str, tuple[float, int]]] = {}
    for mix, source, share, repeats in targets:
        if mix is not None and source is not None:
            mixes.setdefault(mix, {})[source] = (float(share or 0), int(repeats or 0))
    plan = []
    for mix, wanted in sorted(mixes.items()):
        usable = {s: w for s, (w, n) in wanted.items() if w > 0 and n > 0 and supply.get(s)}
        weights = block_weights(usable)
        period = sum(weights.values())
        most = {s: supply[s] * wanted[s][1] for s in weights}
        if total_tokens is None:
            size = min((Fraction(most[s] * period, n) for s, n in weights.items()), default=Fraction(0))
        else:
            size = Fraction(sum(supply[s] for s in weights) if total_tokens == "supply" else total_tokens)
        slots: dict[str, list[int]] = {}
        for k, s in enumerate(period_schedule(weights)):
            slots.setdefault(s, []).append(k)
        for s, (share, repeats) in sorted(wanted.items()):
            asked = int(size * weights[s] / period) if s in weights else 0
            plan.append({"mix_name": mix, "source": s, "target_share": share, "max_repeats": repeats, "period": period, "per_period": weights.get(s, 0), "wanted": asked, "take": min(asked, most.get(s, 0)), "supply": supply.get(s, 0), "slots": slots.get(s, [])})
    return plan


def _plan_frame(spark: SparkSession, plan: list[dict]) -> DataFrame:
    kind = "mix_name string, source string, target_share double, max_repeats int, period long, per_period long, wanted long, take long, supply long, slots array<long>"
    return spark.createDataFrame([tuple(x.values()) for x in plan], kind)


def mix_documents(tokens: DataFrame, targets: DataFrame, block_tokens: int = 1024, total_tokens: int | str | None = None) -> DataFrame:
    """The mixes as rows (mix_name, slot, source, block, repeat, doc_id, tokens, start), in order of slot and start.

    ``tokens`` has (doc_id, source, tokens), ``targets`` the rows of mix_targets; ``total_tokens`` as in ``plan_mixes``. A document is in the
    block in which it starts. What the mix takes of a source are the first documents of its stream, and then, until none fits any
    more, the largest later one that what is left has room for. Texts without tokens are not used. A document occurs at most
    max_repeats times in a mix.
    """
    return _mix(tokens, targets, block_tokens, total_tokens)[0]


_KEY = ["mix_name", "source"]


def _greedy(group: pd.DataFrame) -> pd.DataFrame:
    """The rows of one mix and source that go into its gap, each the largest that what is left has room for."""
    left, kept, start = int(group["gap"].iloc[0]), [], int(group["taken"].iloc[0])
    for row in group.sort_values(["tokens", "repeat", "doc_id"], ascending=[False, True, True]).itertuples(index=False):
        if row.tokens <= left:
            kept.append((row.mix_name, row.source, row.repeat, row.doc_id, row.tokens, start))
            left, start = left - row.tokens, start + row.tokens
    return pd.DataFrame(kept, columns=[*_KEY, "repeat", "doc_id", "tokens", "start"])


def _fill(later: DataFrame, gap: DataFrame) -> DataFrame:
    """Greedy filling of the gaps of all mixes and sources.

    Of documents of one size no more than the gap has room for can be used, so at most gap ln gap rows of a source meet in one task, and a
    gap is smaller than one document.
    """
    rows = later.join(gap, _KEY).where("tokens <= gap")
    nth = F.row_number().over(Window.partitionBy(*_KEY, "tokens").orderBy("repeat", "doc_id"))
    few = rows.withColumn("nth", nth).where("nth * tokens <= gap").drop("nth")
    return few.groupBy(*_KEY).applyInPandas(_greedy, "mix_name string, source string, repeat int, doc_id long, tokens long, start long")


def _mix(tokens: DataFrame, targets: DataFrame, block_tokens: int, total_tokens: int | str | None) -> tuple[DataFrame, DataFrame]:
    spark = tokens.sparkSession
    listed = small_rows(targets.select("mix_name", "source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")))
    sources = sorted({r["source"] for r in listed if r["source"] is not None})
    used = cut(tokens.where(F.col("source").isin(sources) & (F.col("tokens") > 0)))
    supply = {r["source"]: r["t"] for r in used.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # no more rows than targets has
    plan = _plan_frame(spark, plan_mixes(listed, supply, total_tokens))
    wanted = plan.where("take > 0").select(*_KEY, "max_repeats", "take", "supply")
    stream = cut(source_stream(used)).join(wanted, "source")

    def repeated(first: Column, last: Column) -> DataFrame:
        """The stream's rows with their places in the passes from ``first`` to ``last``."""
        passes = stream.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("repeat"))
        return passes.withColumn("start", F.col("start") + (F.col("repeat") - 1) * F.col("supply"))

    fits = F.floor((F.col("take") - F.col("start") - F.col("tokens")) / F.col("supply")).cast("int") + 1  # passes in which the document ends in time
    columns = [*_KEY, "repeat", "doc_id", "tokens", "start"]
    whole = repeated(F.lit(1), F.least(fits, "max_repeats")).select(*columns)
    zero = F.lit(0).cast("long")
    gap = wanted.join(whole.groupBy(*_KEY).agg(F.sum("tokens").alias("taken")), _KEY, "left").select(*_KEY, F.coalesce("taken", zero).alias("taken"), (F.col("take") - F.coalesce("taken", zero)).alias("gap"))
    later = repeated(F.greatest(fits, F.lit(0)) + 1, F.col("max_repeats")).select(*_KEY, "repeat", "doc_id", "tokens")
    rows = whole.unionByName(_fill(later, cut(gap)))
    rows = rows.join(plan.select(*_KEY, "per_period", "period", "slots"), _KEY).withColumn("block", F.floor(F.col("start") / block_tokens))
    slot = F.floor(F.col("block") / F.col("per_period")) * F.col("period") + F.element_at("slots", (F.col("block") % F.col("per_period") + 1).cast("int"))
    return rows.select("mix_name", slot.alias("slot"), "source", "block", "repeat", "doc_id", "tokens", "start"), plan


def mix_report(tokens: DataFrame, targets: DataFrame, block_tokens: int = 1024, total_tokens: int | str | None = None) -> DataFrame:
    """Shares really reached and tokens short of what was wanted, one row per mix and listed source; absent sources have share 0."""
    rows, plan = _mix(tokens, targets, block_tokens, total_tokens)
    got = rows.groupBy(*_KEY).agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.max("repeat").alias("most_repeats"))
    total = Window.partitionBy("mix_name")
    zero = F.lit(0).cast("long")
    out = plan.join(got, _KEY, "left").withColumn("tokens", F.coalesce("tokens", zero))
    share = F.round(F.try_divide(F.col("tokens"), F.sum("tokens").over(total)), 6)
    return out.select("mix_name", "source", "target_share", "max_repeats", "tokens", F.coalesce(share, F.lit(0.0)).alias("actual_share"), (F.col("wanted") - F.col("tokens")).alias("short_tokens"), F.coalesce("documents", zero).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
