"""The 0 to 100 rating scale: five bands, midpoints and a 1 to 5 equivalent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lowest score of each band but the first.
EDGES = (20, 40, 60, 80)
MIDPOINTS = (10, 30, 50, 70, 90)
#: What the bands are called, by rubric.
LABELS = {
    "content": ("Very different", "Different", "Mostly same", "Same", "Identical"),
    "realism": ("Very synthetic", "Synthetic", "Mixed", "Realistic", "Very realistic"),
}


def clamped(score: Column) -> Column:
    """Rounded half to even, then held within 0 to 100."""
    return F.least(F.greatest(F.bround(score, 0), F.lit(0)), F.lit(100)).cast("int")


def band(score: Column) -> Column:
    """0 to 4; an edge belongs to the band above it."""
    out = F.lit(0)
    for k, edge in enumerate(EDGES, 1):
        out = F.when(clamped(score) >= edge, k).otherwise(out)
    return F.when(score.isNotNull(), out)


def midpoint(score: Column) -> Column:
    return F.get(F.array(*map(F.lit, MIDPOINTS)), band(score))


def likert(score: Column) -> Column:
    return band(score) + 1


def label(score: Column, rubric: str | Column) -> Column:
    """What a score's band is called; any rubric but realism reads as content."""
    rubric = F.lit(rubric) if isinstance(rubric, str) else rubric
    of = lambda name: F.get(F.array(*map(F.lit, LABELS[name])), band(score))
    return F.when(rubric == "realism", of("realism")).otherwise(of("content"))
