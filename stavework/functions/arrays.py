"""Numeric array expressions: levels, sums and windows of samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def rms(samples: Column) -> Column:
    """Root of the mean square; 0 for null and empty arrays."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return F.when(F.coalesce(F.size(samples), F.lit(0)) > 0, F.sqrt(total / F.size(samples))).otherwise(F.lit(0.0))


def is_silent(samples: Column, least: float = 0.01) -> Column:
    return rms(samples) < least


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda v: F.abs(v.cast("double")))), F.lit(0.0))


def peak_db(samples: Column) -> Column:
    """20 log10 of the peak; minus infinity for an empty array."""
    return F.when(F.size(samples) > 0, 20 * F.log10(peak(samples) + 1e-10)).otherwise(F.lit(float("-inf")))


def peak_gain(top: Column, limit: float = 1.0) -> Column:
    """The gain that brings a peak down to the limit; 1 where it is below."""
    return F.when(top > limit, F.lit(limit) / top).otherwise(F.lit(1.0))


def padded(samples: Column, length: Column) -> Column:
    """Cut, or filled with zeros, to the length."""
    zeros = F.array_repeat(F.lit(0.0), F.greatest(length - F.size(samples), F.lit(0)))
    return F.concat(F.slice(F.transform(samples, lambda v: v.cast("double")), 1, length), zeros)


def mono(left: Column, right: Column) -> Column:
    """The mean of two channels; a missing sample is silence."""
    value = lambda v: F.coalesce(v.cast("double"), F.lit(0.0))
    return F.zip_with(left, right, lambda a, b: (value(a) + value(b)) / 2)


def channels(samples: Column, n: int) -> Column:
    """One waveform as n equal channels."""
    return F.array_repeat(samples, n)


def active_fraction(samples: Column, hop: int, least_rms: float) -> Column:
    """Share of hops whose rms reaches the level; a trailing hop is aligned to the end."""
    n = F.size(samples)
    starts = F.array_distinct(
        F.concat(F.sequence(F.lit(1), F.greatest(n - hop + 1, F.lit(1)), F.lit(hop)), F.array(F.greatest(n - hop + 1, F.lit(1))))
    )
    loud = F.transform(starts, lambda s: (rms(F.slice(samples, s, hop)) >= least_rms).cast("double"))
    return F.when(n > 0, F.aggregate(loud, F.lit(0.0), lambda a, x: a + x) / F.size(starts)).otherwise(F.lit(0.0))


def chunk_spans(total: Column, chunk: int, overlap: int) -> Column:
    """(start, end) of overlapping chunks; the last ends at ``total``; none if it is not positive."""
    if not 0 <= overlap < chunk:
        raise ValueError("overlap must be at least 0 and less than the chunk")
    hop = chunk - overlap
    n = F.when(total <= chunk, 1).otherwise(F.ceil((total - chunk) / hop) + 1)
    spans = F.transform(
        F.sequence(F.lit(0), n.cast("int") - 1),
        lambda k: F.struct((k * hop).cast("long").alias("start"), F.least(k * hop + chunk, total).cast("long").alias("end")),
    )
    return F.when(total > 0, spans).otherwise(F.expr("cast(array() as array<struct<start: long, end: long>>)"))


def match_count(reference: np.ndarray, rendered: np.ndarray, tolerance: float) -> int:
    """How many of the reference's values find a partner, both sorted.

    Each in turn looks only at its nearest unused candidate, the earlier of two as near.
    ``after[k]`` leads to the first unused candidate from k on, ``before[k]`` to the last
    one below k (counted from 1; 0 is none); a used one points on to its neighbour, and
    paths are halved while they are followed.
    """
    n, found, values = len(rendered), 0, rendered.tolist()
    after, before = list(range(n + 1)), list(range(n + 1))
    for x, k in zip(reference.tolist(), np.searchsorted(rendered, reference).tolist(), strict=True):
        right = left = k
        while after[right] != right:
            after[right] = right = after[after[right]]
        while before[left] != left:
            before[left] = left = before[before[left]]
        below = x - values[left - 1] if left else np.inf
        above = values[right] - x if right < n else np.inf
        if min(below, above) <= tolerance:
            used = left - 1 if below <= above else right
            after[used], before[used + 1] = used + 1, used
            found += 1
    return found


def matched_onsets(reference: Column, rendered: Column, tolerance: float) -> Column:
    """How many reference onsets find a partner, one to one.

    In ascending order each looks only at its nearest unused candidate (the earlier of
    two as near) and takes it if that is within the tolerance. Null arrays are empty;
    null and NaN onsets have no partner.
    """

    def sorted_rows(lists: pa.Array) -> Iterator[np.ndarray]:
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        start = 0
        for size in pc.list_value_length(lists).fill_null(0).to_pylist():
            row = np.sort(flat[start : start + size])
            yield row[: np.searchsorted(row, np.nan)]  # NaN, as null comes here, is last
            start += size

    @F.arrow_udf("long")
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([match_count(x, y, tolerance) for x, y in zip(sorted_rows(a), sorted_rows(b), strict=True)], pa.int64())

    return count(reference.cast("array<double>"), rendered.cast("array<double>"))


def f1(matched: Column, n_reference: Column, n_rendered: Column) -> Column:
    """Harmonic mean of precision and recall; 1 if both sides are empty, 0 without a match."""
    precision, recall = matched / F.greatest(n_rendered, F.lit(1)), matched / F.greatest(n_reference, F.lit(1))
    score = F.when(matched > 0, 2.0 * precision * recall / (precision + recall)).otherwise(0.0)
    return F.when((n_reference == 0) & (n_rendered == 0), 1.0).otherwise(score)


def active_onsets(onsets: Column, active: Column, rate: int) -> Column:
    """Onsets (seconds) whose nearest sample, clamped to the mask, is active."""
    at = lambda t: F.least(F.greatest(F.bround(t * rate, 0).cast("int"), F.lit(0)), F.size(active) - 1)
    return F.filter(onsets, lambda t: F.coalesce(F.get(active, at(t)), F.lit(False)))
