"""Ordered rows: dense indexes, open notes, batches, shards, ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavework.operators.profile import cumulative
from stavework.operators.tables import spare


def dense_index(df: DataFrame, group: str, *order: str) -> DataFrame:
    """0, 1, 2 ... in a group's order."""
    return df.withColumn("index", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def ratio_to_maximum(df: DataFrame, group: str, value: str) -> DataFrame:
    """value over its group's maximum; 1 in a group whose maximum is 0 or null."""
    top = F.max(value).over(Window.partitionBy(group))
    return df.withColumn("ratio", F.when(F.coalesce(top, F.lit(0)) > 0, F.coalesce(F.col(value), F.lit(0)) / top).otherwise(F.lit(1.0)))


def monophony(events: DataFrame, group: Sequence[str]) -> DataFrame:
    """Whether a note never begins while another is open.

    events: the group, ``seq``, ``on``, ``note``. A note that begins twice is open once,
    and closing one that isn't open changes nothing: so an event counts if the one before
    it of the same note was of the other kind, and the running sum of what counts is how
    many notes are open. Windows sort and spill; no group is held as an array.
    """
    last = F.lag("on").over(Window.partitionBy(*group, "note").orderBy("seq", "on"))
    change = F.when(F.col("on") & ~F.coalesce(last, F.lit(False)), 1).when(~F.col("on") & F.coalesce(last, F.lit(False)), -1).otherwise(0)
    before = Window.partitionBy(*group).orderBy("seq", "on", "note").rowsBetween(Window.unboundedPreceding, -1)
    open_ = events.withColumn("note_change", change).withColumn("open_notes", F.coalesce(F.sum("note_change").over(before), F.lit(0)))
    return open_.groupBy(*group).agg((~F.bool_or(F.col("on") & (F.col("open_notes") > 0))).alias("monophonic"))


def run_batches(tasks: DataFrame, group: str, key: str, cap: int, *order: str, alone: Column | None = None) -> DataFrame:
    """Batch numbers within a group: a new batch when the key changes or the batch is full.

    alone: tasks that are a batch of their own; the next task begins another.
    """
    names = {c: spare(tasks, c) for c in ("task_island", "task_opens", "task_alone")}
    island, opens, single = names["task_island"], names["task_opens"], names["task_alone"]
    by = Window.partitionBy(group).orderBy(*order)
    running = by.rowsBetween(Window.unboundedPreceding, 0)
    marked = tasks.withColumn(single, F.coalesce(F.lit(False) if alone is None else alone, F.lit(False)))
    change = (
        (~F.col(key).eqNullSafe(F.lag(key).over(by))) | (F.row_number().over(by) == 1) | F.col(single) | F.coalesce(F.lag(single).over(by), F.lit(False))
    )
    islands = marked.withColumn(island, F.sum(change.cast("long")).over(running))
    within = F.row_number().over(Window.partitionBy(group, island).orderBy(*order)) - 1
    counted = islands.withColumn(opens, (within % cap == 0).cast("long"))
    return counted.withColumn("batch", F.sum(opens).over(running) - 1).drop(island, opens, single)


def contiguous_shards(df: DataFrame, group: str, shards: int, order: str) -> DataFrame:
    """Shards of neighbours by a numeric key, unique in its group, whose sizes differ by one at most, the larger ones first.

    Places come from counts by ranges of the key, so a group isn't sorted in one task.
    """
    counts = df.withColumn("c", F.lit(1).cast("long"))
    ranked = cumulative(counts, [group], order, df)
    at, size, larger = F.col("upto") - 1, F.floor(F.col("n") / shards), F.col("n") % shards
    late = F.floor((at - larger * (size + 1)) / F.greatest(size, F.lit(1)))
    shard = F.when(at < larger * (size + 1), F.floor(at / (size + 1))).otherwise(larger + late)
    return ranked.withColumn("shard", shard.cast("int")).select(*df.columns, "shard")


def nearest_levels(levels: DataFrame, level: str) -> DataFrame:
    """Each level with the next lower and higher one, or itself at the ends."""
    by = Window.orderBy(level)  # of the grid's few levels
    distinct = levels.select(level).distinct()
    return distinct.select(level, F.coalesce(F.lag(level).over(by), level).alias("lower"), F.coalesce(F.lead(level).over(by), level).alias("higher"))
