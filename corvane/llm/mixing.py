"""Mixing sources to target weights: a subset-sum fit on document lengths."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

#: Budget that the knapsack fits exactly; documents that are ranked in one group.
FITTED, RANKED = 16_384, 4_096


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """source, source_size, target: by weight, at most ``most`` times the source's size, the excess shared anew.

    Sources are in order of code points, null last. With sources in order of the weight at which each is full,
    the first that does not fill up fixes the level for all that follow. One row a source takes part in the windows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", cycle.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    fill = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (share * F.sum("source_size").over(everything) - F.col("full")) / F.col("open"))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    rows = rows.withColumn("at", level["level"])
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def fit(lengths: list[int], counts: list[int], budget: int, seed: int) -> list[int]:
    """How many documents of each length to take, so that the lengths add up to ``budget`` or little less.

    Every length gets its share of the budget first, rounded down; single documents in a seeded order follow until
    at most ``FITTED`` is left; a bounded knapsack over the documents left fits that, exactly where a sum exists.
    """
    total = sum(a * c for a, c in zip(lengths, counts, strict=True))
    taken = [c * budget // total if total else 0 for c in counts]
    left = budget - sum(a * t for a, t in zip(lengths, taken, strict=True))
    order = [i for i, a in enumerate(lengths) if a > 0]
    random.Random(seed).shuffle(order)
    for step in (lambda i: 1, lambda i: left // lengths[i]):
        for i in order:
            if left <= FITTED:
                break
            more = min(step(i), counts[i] - taken[i], left // lengths[i])
            taken[i] += more
            left -= more * lengths[i]
    if left > FITTED:  # only longer documents than that are left
        return taken
    reach, steps, full = 1, [], (1 << left + 1) - 1
    for i in sorted(order, key=lambda i: lengths[i]):
        room, part = min(counts[i] - taken[i], left // lengths[i]), 1
        while room > 0 and not reach >> left & 1:
            part = min(part, room)
            steps.append((i, part, reach))
            reach |= reach << part * lengths[i] & full
            room, part = room - part, part * 2
    at = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += part
            at -= part * lengths[i]
    return taken


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, taken, source: one row for each row of ``docs``.

    size is the number of words (null text: 0). Every document can be taken up to ``most`` times, those of one length as
    evenly as can be; ``taken`` is a multiple of size. Which ones is fixed by ``seed`` and the id. Repeated rows are documents of their own; an empty table gives no rows.

    Lengths are counted first: a source's whole choice is made on at most one row for each different length, and
    documents learn their rank within their length from groups of about ``RANKED``, whatever the source's share.
    """
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ).withColumn("draw", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 33))
    sized = staged(sized)
    lengths = staged(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = staged(targets(sources, weights, share, most))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        rows = rows.sort_values("size")
        taken = np.array(fit(rows["size"].tolist(), (rows["n"] * most).tolist(), int(min(target, most * size)), seed), dtype=np.int64)
        return rows.assign(whole=taken // rows["n"], extra=taken % rows["n"])[["source", "size", "n", "source_size", "target", "whole", "extra"]]

    plan = lengths.join(aims, lengths["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    plan = staged(plan.groupBy("source").applyInPandas(choose, "source string, size long, n long, source_size long, target double, whole long, extra long"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"])
    rows = sized.join(plan, same(sized, plan)).drop(plan["source"], plan["size"])
    slot = F.shiftright(F.col("draw") * F.ceil(F.col("n") / RANKED), 31)
    rows = rows.withColumn("slot", slot)
    slots = rows.groupBy("source", "size", "slot").agg(F.count("*").alias("c"))
    ahead = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(F.col("source").alias("s"), F.col("size").alias("l"), F.col("slot").alias("t"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("ahead"))
    rows = rows.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l")) & (F.col("slot") == F.col("t")))
    rank = F.row_number().over(Window.partitionBy("source", "size", "slot").orderBy("draw", "doc_id")) + F.col("ahead")
    copies = F.col("whole") + (rank <= F.col("extra")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source")
