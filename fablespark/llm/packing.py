"""Filling fixed-capacity containers with texts by mixture-controlled packing.

Documents are spread by hash over packing partitions. In each, a deficit round-robin over the source queues fills one container
after the other: a queue's turn adds its quantum, in proportion to its target, to what it is owed, and it puts in its largest texts that
fit into what it is owed and into the room. What is owed goes on from container to container, and a partition starts with what all partitions
before it leave. As every partition packs all its texts, that follows from token sums per partition, so none waits for another.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fablespark.runtime import cut, small_rows

PACKED = "container_id int, container_no string, slot int, doc_id long, source string, piece_index int, n_pieces int, first_token long, tokens long"


def pack_queue(items: list[tuple[int, str, int]], capacity: int, shares: dict[str, float], deficits: dict[str, float], turns: int = 8) -> list[tuple[int, int, int, str, int, int, int, int]]:
    """Containers of one partition: (container, slot, doc_id, source, piece, pieces, first token, tokens) per item.

    ``items`` are (doc_id, source, tokens). A text above the capacity is cut into full containers and a rest, which is
    packed like a text of its own. ``shares`` are the target proportions, ``deficits`` the tokens each source is owed. About ``turns``
    turns of every queue fill a container. Room that no queue's due text fits goes to the largest text that fits, from the queue that is
    owed most, which then owes; a source without texts left is owed on, and the others fill the rest.
    """
    out, number = [], 0
    queues: dict[str, list[tuple[int, int, int, int, int]]] = {}
    owed = dict(deficits)
    for doc_id, source, tokens in sorted(items):
        pieces = -(-tokens // capacity)
        for k in range(tokens // capacity):
            out.append((number, 1, doc_id, source, k + 1, pieces, k * capacity, capacity))
            number += 1
            owed[source] = owed.get(source, 0.0) - capacity
            for s in shares:
                owed[s] = owed.get(s, 0.0) + shares[s] * capacity
        rest = tokens % capacity
        if rest:
            queues.setdefault(source, []).append((rest, doc_id, pieces, pieces, tokens - rest))
    for queue in queues.values():
        queue.sort()
    ring = sorted(queues)
    for s in ring:
        owed.setdefault(s, 0.0)
    while queues:
        room, slot, granted = capacity, 0, 0

        def put(s: str, most: float) -> bool:
            """Puts in the largest text of a queue up to a size, if there is one."""
            nonlocal room, slot
            at = bisect_right(queues[s], (most, float("inf"))) if s in queues else 0
            if not at:
                return False
            tokens, doc_id, piece, pieces, first = queues[s].pop(at - 1)
            slot += 1
            out.append((number, slot, doc_id, s, piece, pieces, first, tokens))
            owed[s] -= tokens
            room -= tokens
            if not queues[s]:
                del queues[s]
            return True

        while granted < turns:
            for s in ring:
                owed[s] += shares.get(s, 0.0) * capacity / turns
                while room and put(s, min(room, owed[s])):
                    pass
            granted += 1
        while room and any(put(s, room) for s in sorted(queues, key=lambda s: (-owed[s], s))):
            pass
        ring = ring[1:] + ring[:1]  # another queue has the first turn
        number += 1
    return out


def pack_documents(tokens: DataFrame, containers: DataFrame, targets: DataFrame | None = None, items_per_partition: int = 20_000) -> DataFrame:
    """Container of every text, for each capacity of ``containers``.

    ``tokens`` has (doc_id, source, tokens); ``targets`` may give (source, share), else each source's share of all tokens
    is its target. Shares of a source that is listed twice are added; sources that are not listed have the target 0 and fill what
    the others leave. Every text is packed whatever the targets: how far containers follow them is in ``mixture_report``. Returns one row per
    text, or per piece of a text above the capacity. Texts without tokens need no container and give no rows; containers
    without a positive capacity are left out.
    """
    items = tokens.where("tokens > 0").select("doc_id", "source", "tokens")
    items = cut(items)
    parts = max(1, -(-items.count() // items_per_partition))
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    sums = cut(items.groupBy("part", "source").agg(F.sum("tokens").alias("t")))  # a row per source and items_per_partition texts
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = sums.groupBy("part").agg(F.sum("t").alias("part_t")).select("part", F.coalesce(F.sum("part_t").over(before), F.lit(0)).alias("all_before"))
    share = target_shares(sums, targets)
    own = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        sums.withColumn("own_before", F.coalesce(F.sum("t").over(own), F.lit(0)))
        .join(totals, "part")
        .join(share, "source")
        .select("part", "source", "share", (F.col("share") * F.col("all_before") - F.col("own_before")).alias("carried"))
    )
    sized = sorted({(int(r[0]), int(r[1])) for r in small_rows(containers.where("container_id IS NOT NULL AND capacity_tokens > 0").select("container_id", "capacity_tokens"))})
    container = F.array(*[F.struct(F.lit(k).alias("container_id"), F.lit(c).cast("long").alias("capacity")) for k, c in sized]) if sized else F.array().cast("array<struct<container_id:int,capacity:bigint>>")
    work = items.join(carry, ["part", "source"]).withColumn("container", F.explode(container)).select("*", "container.*").drop("container")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        head = group.iloc[0]
        per_source = group.drop_duplicates("source")
        rows = pack_queue(
            list(group[["doc_id", "source", "tokens"]].itertuples(index=False, name=None)),
            int(head["capacity"]),
            dict(zip(per_source["source"], per_source["share"])),
            dict(zip(per_source["source"], per_source["carried"])),
        )
        out = pd.DataFrame(rows, columns=["no", "slot", "doc_id", "source", "piece_index", "n_pieces", "first_token", "tokens"])
        out["container_id"] = head["container_id"]
        out["container_no"] = out.pop("no").map(lambda n: f"{head['part']}-{n}")
        return out[["container_id", "container_no", "slot", "doc_id", "source", "piece_index", "n_pieces", "first_token", "tokens"]]

    return work.groupBy("container_id", "part").applyInPandas(pack, PACKED)


def target_shares(sums: DataFrame, targets: DataFrame | None) -> DataFrame:
    """(source, share) of the sources of ``sums`` (source, t): as given, or each source's share of all tokens."""
    everything = F.sum("source_t").over(Window.partitionBy(F.lit(1)))  # over one row per source
    natural = sums.groupBy("source").agg(F.sum("t").alias("source_t")).select("source", (F.col("source_t") / everything).alias("share"))
    if targets is None:
        return natural
    given = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum("share").alias("given"))
    return natural.join(given, "source", "left").select("source", F.coalesce("given", F.lit(0.0)).cast("double").alias("share"))


def packing_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Containers, tokens and fill of each capacity."""
    used = packed.groupBy("container_id").agg(F.countDistinct("container_no").alias("containers"), F.sum("tokens").alias("tokens"))
    return containers.select("container_id", "container_name", "capacity_tokens").distinct().join(used, "container_id").select("container_id", "container_name", "capacity_tokens", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"))


def mixture_report(packed: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(container_id, source, target_share, share, tokens, owed_tokens, containers) of each capacity and source that is packed or a target.

    ``owed_tokens`` is what the target would have had of all tokens more than the source had, negative where it had more: a target that
    its source can't meet shows here. ``containers`` counts those with the source.
    """
    cells = packed.groupBy("container_id", "source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("container_no").alias("containers"))
    totals = cells.groupBy("container_id").agg(F.sum("tokens").alias("all_tokens"))
    if targets is None:
        listed = cells.join(totals, "container_id").select("container_id", "source", (F.col("tokens") / F.col("all_tokens")).alias("target_share"))
    else:
        given = small_rows(targets.where("source IS NOT NULL").groupBy("source").agg(F.sum("share").cast("double").alias("target_share")))
        goals = F.array(*[F.struct(F.lit(r["source"]).alias("source"), F.lit(r["target_share"]).cast("double").alias("target_share")) for r in given]) if given else F.array().cast("array<struct<source:string,target_share:double>>")
        listed = totals.select("container_id", F.explode(goals).alias("x")).select("container_id", "x.*")
    out = cells.join(listed, ["container_id", "source"], "full").join(totals, "container_id")
    zero = lambda c, z=0: F.coalesce(F.col(c), F.lit(z))
    return out.select(
        "container_id",
        "source",
        F.round(zero("target_share", 0.0), 6).alias("target_share"),
        F.round(zero("tokens") / F.col("all_tokens"), 6).alias("share"),
        zero("tokens").cast("long").alias("tokens"),
        F.round(zero("target_share", 0.0) * F.col("all_tokens") - zero("tokens")).cast("long").alias("owed_tokens"),
        zero("containers").cast("long").alias("containers"),
    )
