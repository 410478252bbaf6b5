"""Selections that depend on what was selected before, in a bounded number of rounds."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavework.operators.sampling import seeded_key


#: Cells that a pick rules out, with room for starts that are rounded at a cell's edge.
CELLS = 5


def best_apart(windows: DataFrame, group: str, start: str, score: str, n: int, separation: float) -> DataFrame:
    """The n best windows of each group that begin at least ``separation`` apart.

    Greedy by score, then the earlier start; rows without a score or start don't count.
    Returns the group, ``index`` (0 first, by start) and the start.

    Starts are cut into cells as wide as the separation. A pick rules out windows of its
    own cell and its neighbours only, so while n picks are made, one of the CELLS * n best
    cells of a group is still whole, and its best window is at least as good as the worst
    of them: windows below that can't be picked. The input is read twice, however large n
    is, for the cells' best (with map-side partials) and for the windows that are left;
    these are sorted by score and passed once, with no more than the picks in memory.
    """
    if separation <= 0:
        raise ValueError("separation must be positive")
    rows = windows.select(F.col(group).alias("g"), F.col(start).alias("s"), F.col(score).alias("v")).where("s is not null and v is not null")
    rank = F.struct(F.col("v"), (-F.col("s")).alias("before")).alias("rank")
    cells = rows.groupBy("g", F.floor(F.col("s") / separation)).agg(F.max(rank).alias("rank"))
    best = cells.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("rank")))).where(F.col("k") <= CELLS * n)
    least = best.groupBy(F.col("g").alias("of")).agg(F.min("rank").alias("least"))  # of all cells, if there are fewer
    left = rows.withColumn("rank", rank).join(least, F.col("g").eqNullSafe(F.col("of"))).where(F.col("rank") >= F.col("least")).select("g", "s", "v")
    kinds = dict(left.dtypes)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, picks = None, None

        def done(types: list[pa.DataType]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([of] * len(picks), types[0]), pa.array(range(len(picks)), pa.int32()), pa.array(picks, types[1])], names=["g", "k", "s"])

        for batch in batches:
            types = [c.type for c in batch.columns]
            for g, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if picks is None or g != of:
                    if picks:
                        yield done(types)
                    of, picks = g, []
                if len(picks) < n:
                    at = bisect(picks, s)
                    if (at == 0 or s - picks[at - 1] >= separation) and (at == len(picks) or picks[at] - s >= separation):
                        picks.insert(at, s)
        if picks:
            yield done(types)

    by_score = left.repartition("g").sortWithinPartitions("g", F.desc("v"), "s").select("g", "s")
    found = by_score.mapInArrow(pick, f"g {kinds['g']}, k int, s {kinds['s']}")
    return found.toDF(group, "index", start)


def audible_windows(hops: DataFrame, group: str, clip: int, stride: int, least_rms: float, least_active: float, first: int = 0) -> DataFrame:
    """Windows of ``clip`` hops with enough in them: (group, ``hop``, ``rms``, ``active``).

    hops: the group, ``hop`` (0 first, none missing) and ``energy`` (mean square). A
    window may begin at ``first`` and every ``stride`` hops, and must end within the
    waveform; its level and its share of hops at the level must be reached.
    """
    clip_of = Window.partitionBy(group).orderBy("hop").rowsBetween(0, clip - 1)
    loud = (F.sqrt("energy") >= least_rms).cast("int")
    windows = hops.select(
        group, "hop", F.sqrt(F.sum("energy").over(clip_of) / clip).alias("rms"), (F.sum(loud).over(clip_of) / clip).alias("active"), F.count("*").over(clip_of).alias("held")
    )
    may = (F.col("held") == clip) & (F.col("hop") >= first) & ((F.col("hop") - first) % stride == 0)
    return windows.where(may & (F.col("rms") >= least_rms) & (F.col("active") >= least_active)).drop("held")


def clip_start(windows: DataFrame, group: str, densest: bool = False) -> DataFrame:
    """(group, ``hop``): the first audible window, or the one with the largest active share, the earlier of two."""
    best = F.max_by("hop", F.struct("active", -F.col("hop"))) if densest else F.min("hop")
    return windows.groupBy(group).agg(best.alias("hop"))


def window_score(rms: Column, active: Column, onsets: Column, start: Column, clip: float, duration: Column, least_rms: float, edge: float = 0.1) -> Column:
    """Twice the level, the active share and a quarter of the onsets a second, less what is near an end; null if too quiet."""
    zone = F.greatest(F.lit(clip), duration * edge)
    tail = F.greatest(duration - start - clip, F.lit(0.0))
    lead = F.when(start < zone, 0.35 * (1 - start / zone)).otherwise(0.0)
    trail = F.when(start + clip > duration - zone, 0.35 * (1 - tail / zone)).otherwise(0.0)
    return F.when(rms >= least_rms, 2 * rms + active + 0.25 * onsets / max(clip, 1e-6) - lead - trail)


def latest_phase(records: DataFrame, category: str, phases: Sequence[str]) -> DataFrame:
    """Of each category's records that of the latest phase in the list; other phases don't count."""
    order = F.array_position(F.array(*map(F.lit, phases)), F.col("phase"))
    by = F.struct(order.alias("order"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(records.columns)))
    best = records.where(order > 0).groupBy(F.col(category).alias("of")).agg(F.max(by).alias("best"))
    return best.select(*(F.col(f"best.c{i}").alias(c) for i, c in enumerate(records.columns)))


def resolved_setting(own: Column, phase: Column, owner: str, winner: Column, default: Column) -> Column:
    """A setting in its phase: the variant's own value in the phase that tries it, the winner's after, else the default."""
    return F.coalesce(F.when(phase == owner, own).when(phase > owner, winner), default)


def fill_quotas(rows: DataFrame, song: str, category: str, categories: Sequence[str], quota: int, most: int, seed: int) -> DataFrame:
    """Rows of the songs that fill quotas of categories, with the song's ``position``.

    Songs go in a seeded order. One is kept if it has a row of a category whose quota is
    not filled yet (the first song always is); all its rows then count. It ends when the
    categories that occur are filled or ``most`` songs are kept. Songs without an id don't
    take part.

    While a category is open every song that has it is kept, so its count before a song
    is that of all songs before, whatever else is kept, and it is filled within its first
    ``quota`` songs: these (limited before the shuffle too) and their sums decide it.
    """
    known = rows.where(F.col(song).isNotNull())
    place = F.struct(seeded_key(seed, song).alias("key"), F.col(song).alias("song")).alias("place")
    counts = known.where(F.col(category).isin(*categories)).groupBy(F.col(category).alias("category"), place).agg(F.count("*").alias("n"))
    by = Window.partitionBy("category").orderBy("place")
    early = counts.withColumn("k", F.row_number().over(by)).where(F.col("k") <= quota)
    before = early.withColumn("before", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    first = known.agg(F.min(place).alias("place")).where("place is not null")
    fillers = before.where(F.col("before") < quota).select("place").unionByName(first).distinct()
    # of at most quota songs a category, and the first
    position = F.row_number().over(Window.orderBy("place")) - 1
    chosen = fillers.orderBy("place").limit(most).select(F.col("place.song").alias("of"), position.alias("position"))
    joined = known.join(chosen, F.col(song) == F.col("of"))
    return joined.select("position", *rows.columns)


def persisted_or_derived(tracks: DataFrame, song: str, stored: str, derived: str) -> DataFrame:
    """``scale``: the stored values of a song of which every track has one, else the derived."""
    whole = F.min(F.col(stored).isNotNull()).over(Window.partitionBy(song))
    return tracks.withColumn("scale", F.when(whole, F.col(stored)).otherwise(F.col(derived)))
