"""Waveforms as blocks of samples, and what is known about them as sets of intervals.

A waveform comes as one array and is worked on as rows (group, ``block``, array), BLOCK
samples each, so that long ones are shuffled and spilled in pieces. Masks are rows
(group, ``start``, ``end``), end exclusive: where a level is reached, a waveform of half an
hour has some thousand of them, not a row for each of its millions of samples. Intervals
are dealt to the blocks that they reach, and numpy works on one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavework.functions.arrays import peak_gain

#: Samples of a block, and blocks of an Arrow batch that ``blocks`` returns.
BLOCK = 1 << 13
OUT_BLOCKS = 256
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def blocks(waves: DataFrame, group: str, *columns: str, block: int = BLOCK) -> DataFrame:
    """(group, ``n``, ``block``, the columns as arrays of doubles) over the shortest of the columns' arrays.

    A null or NaN sample is silence; a null or empty array gives no row.
    """
    kinds = dict(waves.dtypes)
    names = [group, "n", "block", *columns]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waves = [rows_of(c if pa.types.is_floating(c.type.value_type) else c.cast(pa.list_(pa.float64()))) for c in batch.columns[1:]]
            for k, own in enumerate(zip(*waves, strict=True)):
                n = min(map(len, own))
                for low in range(0, n, block * OUT_BLOCKS):
                    ends = range(low, min(n, low + block * OUT_BLOCKS), block)
                    parts = [[np.nan_to_num(x[a : min(a + block, n)].astype(np.float64), posinf=np.inf, neginf=-np.inf) for a in ends] for x in own]
                    arrays = [pa.array(p, pa.list_(pa.float64())) for p in parts]
                    same = batch.column(0).take(pa.array([k] * len(ends)))
                    yield pa.RecordBatch.from_arrays([same, pa.array([n] * len(ends), pa.int64()), pa.array([a // block for a in ends], pa.int64()), *arrays], names=names)

    schema = ", ".join([f"`{group}` {kinds[group]}", "n long", "block long", *(f"`{c}` array<double>" for c in columns)])
    return waves.select(group, *columns).mapInArrow(cut, schema)


def rows_of(lists: pa.Array) -> Iterator[np.ndarray]:
    """The lists of an Arrow column as numpy arrays; a null is empty."""
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), 0
    for size in pc.list_value_length(lists).fill_null(0).to_pylist():
        yield flat[at : at + size]
        at += size


def spans_of(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of each row of a column of intervals."""
    flat = lists.flatten()
    starts, ends = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    at = 0
    for size in pc.list_value_length(lists).fill_null(0).to_pylist():
        yield starts[at : at + size], ends[at : at + size]
        at += size


def runs(flags: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of set flags, counted from ``first``."""
    edges = np.diff(np.r_[False, flags, False].astype(np.int8))
    return np.flatnonzero(edges == 1) + first, np.flatnonzero(edges == -1) + first


def covered(starts: np.ndarray, ends: np.ndarray, low: int, high: int) -> np.ndarray:
    """Flags of low to high: whether any of the intervals holds the place."""
    steps = np.zeros(high - low + 1, dtype=np.int64)
    inside = (ends > low) & (starts < high)
    np.add.at(steps, np.maximum(starts[inside], low) - low, 1)
    np.add.at(steps, np.minimum(ends[inside], high) - low, -1)
    return np.cumsum(steps)[:-1] > 0


def _spans(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)] for s, e in pairs], SPANS)


def loud_chunks(wave: DataFrame, group: str, samples: str, chunk: int, overlap: int, threshold_db: float, block: int = BLOCK) -> DataFrame:
    """(group, ``n``, ``start``, ``end``) of the chunks whose peak reaches the level.

    Chunks begin every ``chunk - overlap`` samples until one reaches the end. A block gives
    the peak of each chunk that it is part of; a chunk's is the largest of those.
    """
    if not 0 <= overlap < chunk:
        raise ValueError("overlap must be at least 0 and less than the chunk")
    hop = chunk - overlap

    @F.arrow_udf("array<struct<chunk: long, top: double>>")
    def peaks(samples: pa.Array, number: pa.Array, n: pa.Array) -> pa.Array:
        found = []
        for own, k, size in zip(rows_of(samples), number.to_pylist(), n.to_pylist(), strict=True):
            low, final = k * block, max(-(-(size - chunk) // hop), 0)
            which = np.arange(max(0, (low - chunk) // hop + 1), min((low + len(own) - 1) // hop, final) + 1)
            starts = np.maximum(which * hop, low) - low
            ends = np.minimum(which * hop + chunk, low + len(own)) - low
            level = np.abs(own)
            # of every pair of places the first counts: the largest from a chunk's start to its end
            bounds = np.stack([starts, np.minimum(ends, len(own) - 1)], axis=1).reshape(-1)
            tops = np.maximum.reduceat(level, bounds)[::2] if len(which) else level[:0]
            tops = np.where(ends == len(own), np.maximum(tops, level[-1]), tops)
            found.append([{"chunk": c, "top": t} for c, t in zip(which.tolist(), tops.tolist(), strict=True)])
        return pa.array(found, pa.list_(pa.struct([("chunk", pa.int64()), ("top", pa.float64())])))

    tops = wave.select(group, "n", F.inline(peaks(samples, "block", "n"))).groupBy(group, "n", "chunk").agg(F.max("top").alias("top"))
    loud = tops.where(20 * F.log10(F.col("top") + 1e-10) >= threshold_db)
    return loud.select(group, "n", (F.col("chunk") * hop).alias("start"), F.least(F.col("chunk") * hop + chunk, F.col("n")).alias("end"))


def dilated_runs(wave: DataFrame, group: str, samples: str, least: float, margin: int, block: int = BLOCK) -> DataFrame:
    """(group, ``start``, ``end``) of samples that reach a level, widened by the margin.

    Those of a block that touch when widened are one. In a waveform no longer than both
    margins and the sample, any such sample stands for all of it.
    """

    @F.arrow_udf("array<struct<start: long, end: long>>")
    def found(samples: pa.Array, number: pa.Array) -> pa.Array:
        def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for own, k in zip(rows_of(samples), number.to_pylist(), strict=True):
                starts, ends = runs(np.abs(own) >= least, k * block)
                apart = starts[1:] - ends[:-1] > 2 * margin
                yield starts[np.r_[True, apart]] if len(starts) else starts, ends[np.r_[apart, True]] if len(ends) else ends

        return _spans(each())

    spans = wave.select(group, "n", F.inline(found(samples, "block")))
    if margin <= 0:
        return spans.drop("n")
    short = F.col("n") <= 2 * margin + 1
    start = F.when(short, 0).otherwise(F.greatest(F.col("start") - margin, F.lit(0)))
    return spans.select(group, start.alias("start"), F.when(short, F.col("n")).otherwise(F.least(F.col("end") + margin, F.col("n"))).alias("end"))


def subtracted(kept: DataFrame, taken: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """(group, ``start``, ``end``): what ``kept`` holds and ``taken`` doesn't, cut at the blocks' ends."""
    both = kept.select(group, "start", "end", F.lit(True).alias("kept")).unionByName(taken.select(group, "start", "end", F.lit(False).alias("kept")))
    reached = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))
    dealt = both.where("start < end").select("*", F.explode(reached).alias("block"))
    span = lambda k: F.collect_list(F.when(F.col("kept") == k, F.struct("start", "end")))
    held = dealt.groupBy(group, "block").agg(span(True).alias("kept"), span(False).alias("taken")).where(F.size("kept") > 0)

    @F.arrow_udf("array<struct<start: long, end: long>>")
    def left(kept: pa.Array, taken: pa.Array, number: pa.Array) -> pa.Array:
        def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a, b, k in zip(spans_of(kept), spans_of(taken), number.to_pylist(), strict=True):
                low, high = k * block, (k + 1) * block
                yield runs(covered(*a, low, high) & ~covered(*b, low, high), low)

        return _spans(each())

    return held.select(group, F.inline(left("kept", "taken", "block")))


def hallucinated(wave: DataFrame, group: str, reference: str, rendered: str, chunk: int, overlap: int, threshold_db: float, margin: int, block: int = BLOCK) -> DataFrame:
    """(group, ``start``, ``end``): samples to silence, of rows of ``blocks``.

    A sample is, if a chunk of the rendering that covers it is loud, the reference is
    silent there, and no active sample of the reference is within the margin.
    """
    loud = loud_chunks(wave, group, rendered, chunk, overlap, threshold_db, block)
    return subtracted(loud, dilated_runs(wave, group, reference, 10 ** (threshold_db / 20.0), margin, block), group, block)


def enforce_silence(wave: DataFrame, silent: DataFrame, group: str, rendered: str, fade: int, block: int = BLOCK) -> DataFrame:
    """(group, ``block``, ``silent``, ``value``): arrays, the rendering 0 where it is silent, with linear ramps behind each edge.

    wave: rows of ``blocks``; silent: (group, ``start``, ``end``). The ramp of the latest
    falling edge within ``fade`` samples goes before that of the latest rising edge;
    without either the sample stays as it is or is 0.
    """
    fade = max(fade, 0)
    reached = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") + fade) / block))
    dealt = silent.select(F.col(group).alias("of"), "start", "end", F.explode(reached).alias("at"))
    cuts = dealt.groupBy("of", "at").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    joined = wave.select(group, "block", rendered).join(cuts, F.col(group).eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")), "left")

    def ramped(own: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = max(first - fade - 1, 0), first + len(own)
        mask = covered(starts, ends, low, high)
        before = np.r_[False, mask[:-1]]
        place, here = np.arange(low, high), slice(first - low, None)
        value = np.where(mask[here], 0.0, own)
        for edges, ramp in ((mask & ~before, lambda t: 1.0 - t), (~mask & before, lambda t: t)):  # falling ones last
            past = place - np.maximum.accumulate(np.where(edges, place, low - fade - 1))
            near = (past < fade)[here]
            value[near] = own[near] * ramp((past[here][near] + 1) / float(fade or 1))
        return mask[here], value

    @F.arrow_udf("struct<silent: array<boolean>, value: array<double>>")
    def done(samples: pa.Array, number: pa.Array, cuts: pa.Array) -> pa.Array:
        masks, values = [], []
        for own, k, (starts, ends) in zip(rows_of(samples), number.to_pylist(), spans_of(cuts), strict=True):
            mask, value = ramped(own, starts, ends, k * block)
            masks.append(mask)
            values.append(value)
        return pa.StructArray.from_arrays([pa.array(masks, pa.list_(pa.bool_())), pa.array(values, pa.list_(pa.float64()))], names=["silent", "value"])

    return joined.select(group, "block", done(rendered, "block", "cuts").alias("_d")).select(group, "block", "_d.silent", "_d.value")


def silence_score(wave: DataFrame, silent: DataFrame, group: str, rendered: str, rate: int, block: int = BLOCK) -> DataFrame:
    """By waveform: samples that the rendering adds where the reference is silent, their seconds, the loudest, and whether it passes.

    The loudest is taken over every k-th of them, k being a hundredth of their number, and
    is minus infinity without any. silent: intervals that don't overlap.
    """
    length = F.col("end") - F.col("start")
    counts = silent.groupBy(F.col(group).alias("of")).agg(F.sum(length).alias("samples"))
    # of one waveform's intervals
    by = Window.partitionBy(group)
    placed = silent.select(group, "start", "end", F.sum(length).over(by.orderBy("start")).alias("upto"), F.sum(length).over(by).alias("all"))
    k = F.greatest(F.floor(F.col("all") / 100), F.lit(1))
    first = F.col("upto") - length
    # the multiples of k from ``first`` to before ``upto``
    low, high = F.ceil(first / k), F.ceil(F.col("upto") / k) - 1
    places = F.transform(F.sequence(low, high), lambda i: i * k - first + F.col("start"))
    some = placed.where(low <= high).select(group, F.explode(places).alias("pos"))
    asked = some.groupBy(F.col(group).alias("of"), F.floor(F.col("pos") / block).alias("at")).agg(F.collect_list("pos").alias("places"))
    found = wave.select(group, "block", rendered).join(asked, F.col(group).eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    tops = found.select(group, F.array_max(F.transform("places", lambda p: F.abs(F.get(rendered, (p - F.col("block") * block).cast("int"))))).alias("top"))
    loud = tops.groupBy(F.col(group).alias("loud_of")).agg(F.max(20 * F.log10(F.col("top") + 1e-10)).alias("max_db"))
    every = wave.select(group).distinct()
    joined = every.join(counts, F.col(group).eqNullSafe(F.col("of")), "left").join(loud, F.col(group).eqNullSafe(F.col("loud_of")), "left")
    n = F.coalesce("samples", F.lit(0)).cast("long")
    return joined.select(group, n.alias("samples"), (n / rate).alias("seconds"), F.coalesce("max_db", F.lit(float("-inf"))).alias("max_db"), (n == 0).alias("passes"))


def stitch(chunks: DataFrame, group: str, overlap: int, block: int = BLOCK) -> DataFrame:
    """Overlapping chunks blended with linear ramps: (group, ``block``, ``value``).

    chunks: the group, ``chunk`` (0 first), ``last`` (whether no chunk follows), ``start``,
    ``end``, ``samples``. Samples are cut, or filled with zeros, to the span. The first
    chunk doesn't fade in and the last doesn't fade out; a fade is the overlap or the
    whole chunk, whichever is shorter. An empty span gives nothing, and what no chunk
    covers is 0. Samples are shuffled once, as arrays by block, and weighed where they meet.
    """
    spans = chunks.where("end > start")
    reached = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("end"), (F.col("block") + 1) * block)
    part = F.transform(F.slice("samples", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    cut = spans.select("*", F.explode(reached).alias("block")).select(group, "block", F.struct("chunk", "last", F.col("start").cast("long"), F.col("end").cast("long"), part.alias("samples")).alias("piece"))
    met = cut.groupBy(group, "block").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))

    @F.arrow_udf("array<double>")
    def blended(pieces: pa.Array, number: pa.Array) -> pa.Array:
        flat = pieces.flatten()
        chunk, last, start, end = (flat.field(k).to_pylist() for k in range(4))
        parts, at, out = list(rows_of(flat.field(4))), 0, []
        for size, k in zip(pc.list_value_length(pieces).to_pylist(), number.to_pylist(), strict=True):
            own, first = range(at, at + size), k * block
            total = np.zeros(min(max(end[i] for i in own), first + block) - first)
            weights = np.zeros_like(total)
            for i in own:
                a, b = max(start[i], first), min(end[i], first + block)
                here, length = np.arange(a, b) - start[i], end[i] - start[i]
                fade = min(overlap, length)
                left = length - 1 - here
                weight = np.ones(b - a)
                if chunk[i] > 0:
                    weight = np.where(here < fade, np.minimum(weight, here / max(fade - 1, 1)), weight)
                if not last[i] and fade > 1:
                    weight = np.where(left < fade, np.minimum(weight, left / max(fade - 1, 1)), weight)
                total[a - first : a - first + len(parts[i])] += parts[i] * weight[: len(parts[i])]
                weights[a - first : b - first] += weight
            out.append(total / np.maximum(weights, 1e-8))
            at += size
        return pa.array(out, pa.list_(pa.float64()))

    return met.select(group, "block", blended("pieces", "block").alias("value"))


def summed(stems: DataFrame, group: str, samples: str, digits: int = 6) -> DataFrame:
    """(group, ``block``, ``total``): the sum of a group's waveforms in units of ten to the minus ``digits``.

    stems: the group, ``block``, arrays. Whole numbers, so sums don't depend on their
    order; shorter waveforms end in silence. Each task sums its own rows first and holds
    one block's sum for each of a bounded number of blocks; then a block's partial sums are
    sorted together and pass one at a time.
    """
    whole = F.transform(samples, lambda v: F.coalesce((v.cast(f"decimal(18,{digits})") * 10**digits).cast("long"), F.lit(0).cast("long")))
    rows = stems.select(group, F.col("block").cast("long").alias("block"), whole.alias("total"))
    kind = dict(rows.dtypes)[group]

    def add(held: dict, key: tuple, own: np.ndarray) -> None:
        old = held.get(key)
        if old is None:
            held[key] = own.copy()
        elif len(old) < len(own):
            held[key] = own.copy()
            held[key][: len(old)] += old
        else:
            old[: len(own)] += own

    def out(held: dict, group_type: pa.DataType) -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in keys], group_type), pa.array([b for _, b in keys], pa.int64()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=[group, "block", "total"])

    def partial(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
        held, kind_of = {}, pa.null()
        for batch in batches:
            kind_of = batch.column(0).type
            for g, b, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), rows_of(batch.column(2)), strict=True):
                if len(held) >= most and (g, b) not in held:
                    yield out(held, kind_of)
                    held = {}
                add(held, (g, b), own)
        if held:
            yield out(held, kind_of)

    schema = f"`{group}` {kind}, block long, total array<long>"
    parts = rows.mapInArrow(lambda batches: partial(batches, HELD_BLOCKS), schema)
    return parts.repartition(group, "block").sortWithinPartitions(group, "block").mapInArrow(lambda batches: partial(batches, 1), schema)


#: Blocks whose sums a task holds.
HELD_BLOCKS = 512


def mixture_gain(stems: DataFrame, group: str, samples: str, limit: float = 1.0, digits: int = 6) -> DataFrame:
    """(group, ``peak``, ``gain``): the gain that keeps the sum of a group's waveforms below the limit."""
    top = F.array_max(F.transform("total", F.abs))
    tops = summed(stems, group, samples, digits).groupBy(group).agg((F.max(top) / 10**digits).alias("peak"))
    return tops.withColumn("gain", peak_gain(F.col("peak"), limit))


def with_gain(stems: DataFrame, gains: DataFrame, group: str, samples: str) -> DataFrame:
    """Every waveform of a group with the group's gain."""
    of = gains.select(F.col(group).alias("gain_of"), "gain")
    joined = stems.join(of, F.col(group).eqNullSafe(F.col("gain_of")))
    return joined.withColumn(samples, F.transform(samples, lambda v: v.cast("double") * F.col("gain"))).drop("gain_of", "gain")
