"""Profiles of a column: quantiles, shares, frequencies, two-level breakdowns, histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def exact(value: Column, scale: int = 2) -> Column:
    """A value as a decimal, so that sums don't depend on their order."""
    return value.cast(f"decimal(18,{scale})")


def exact_mean(value: Column, scale: int = 2) -> Column:
    """Mean of values with a fixed scale: an exact sum and one division."""
    return F.sum(exact(value, scale)).cast("double") / F.nullif(F.count(value), F.lit(0)).cast("double")


def as_number(value: Column, cap: float | None = None) -> Column:
    """A number or null, never an error; NaN is null; values over ``cap`` are the cap."""
    number = value.try_cast("double")
    number = F.when(~F.isnan(number), number)
    return number if cap is None else F.when(number.isNotNull(), F.least(number, F.lit(cap)))


#: Ranges of values that ranks are counted in.
RANGES = 64


def cumulative(counts: DataFrame, groups: Sequence[str], value: str, rows: DataFrame | None = None) -> DataFrame:
    """``upto``: how many rows of a group have a value at or below each of ``counts``' rows; ``n``: all of the group's.

    counts: the groups, a numeric value, ``c`` (rows). Values are cut into RANGES ranges
    at approximate quantiles, which are a scalar subquery over ``rows`` (counts itself, if
    it isn't given) and so part of the plan. Rows are summed within a range of a group,
    and ranges' totals are added: no group is in one task, and the sums are exact
    wherever the cuts lie.
    """
    kept = counts.where(F.col(value).isNotNull())
    levels = [k / RANGES for k in range(1, RANGES)]
    cuts = (kept if rows is None else rows).agg(F.percentile_approx(F.col(value).cast("double"), levels, 1_000)).scalar()
    keys = [*groups, "range"]
    # how many cuts are below a value, by a search in halves
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(RANGES.bit_length() - 1))))
    low = lambda at, step: F.when(F.get("cuts", at + step - 1) < F.col(value), at + step).otherwise(at)
    cut = kept.withColumn("cuts", cuts).withColumn("range", F.aggregate(steps, F.lit(0), low)).drop("cuts")
    totals = cut.groupBy(*keys).agg(F.sum("c").alias("t"))
    whole = Window.partitionBy(*groups)  # a group's few ranges
    before = F.sum("t").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*(F.col(k).alias(f"of_{k}") for k in keys), F.coalesce(before, F.lit(0)).alias("offset"), F.sum("t").over(whole).alias("n"))
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    own = Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    joined = cut.withColumn("upto", F.sum("c").over(own)).join(offsets, reduce(and_, same))
    return joined.withColumn("upto", F.col("upto") + F.col("offset")).select(*counts.columns, "upto", "n")


def quantiles(rows: DataFrame, groups: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """``q``: interpolated quantiles of each group, exact, without a group in one task."""
    ranked = cumulative(rows.groupBy(*groups, value).agg(F.count("*").alias("c")), groups, value, rows)
    # the least value that more rows than a place are at or below is the one at that place
    at = lambda x: (F.col("n") - 1) * F.lit(x)
    pick = lambda place: F.min(F.when(F.col("upto") > place, F.col(value).cast("double")))
    found = [c for k, x in enumerate(levels) for c in (pick(F.floor(at(x))).alias(f"low_{k}"), pick(F.ceil(at(x))).alias(f"high_{k}"))]
    picked = ranked.groupBy(*groups).agg(F.max("n").alias("n"), *found)
    between = lambda k, x: F.col(f"low_{k}") + (F.col(f"high_{k}") - F.col(f"low_{k}")) * (at(x) - F.floor(at(x)))
    return picked.select(*groups, F.array(*(between(k, x) for k, x in enumerate(levels))).alias("q"))


def length_profile(df: DataFrame, value: Column, limits: Sequence[float], levels: Sequence[float] = LEVELS) -> DataFrame:
    """One row: count, interpolated quantiles, the share at or below and the count above each limit."""
    rows = df.select(value.alias("v")).where(F.col("v").isNotNull())
    counts = rows.groupBy("v").agg(F.count("*").alias("c"))  # the quantiles' too, and shuffled once
    held = lambda test: F.coalesce(F.sum(F.when(test, F.col("c"))), F.lit(0))
    n = F.coalesce(F.sum("c"), F.lit(0))
    out = counts.agg(
        n.alias("n"),
        *((held(F.col("v") <= x).cast("double") / F.nullif(n, F.lit(0))).alias(f"share_{k}") for k, x in enumerate(limits)),
        *(held(F.col("v") > x).alias(f"above_{k}") for k, x in enumerate(limits)),
    )
    names = [f"p{format(100 * x, 'g').replace('.', '_')}" for x in levels]
    joined = out.join(F.broadcast(quantiles(rows, [], "v", levels)))  # one row each
    return joined.select(*out.columns, *(F.get("q", F.lit(k)).alias(c) for k, c in enumerate(names)))


def fitting_model(df: DataFrame, value: Column, limits: Sequence[tuple[str, float]], threshold: float) -> DataFrame:
    """One row: the first model (by limit) that at least ``threshold`` percent of the values fit, else the last, and why."""
    rows = df.select(value.alias("v")).where(F.col("v").isNotNull())
    shares = rows.agg(*(F.coalesce(100.0 * F.count_if(F.col("v") <= x) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias(f"s{k}") for k, (_, x) in enumerate(limits)))
    say = lambda k, more: F.format_string(f"%.2f%% of values are at most {limits[k][1]:g}{more}", F.col(f"s{k}"))
    last = len(limits) - 1
    decision, reason = F.lit(limits[last][0]), say(last, "")
    for k in range(last - 1, -1, -1):
        fits = F.col(f"s{k}") >= threshold
        decision, reason = F.when(fits, limits[k][0]).otherwise(decision), F.when(fits, say(k, "")).otherwise(reason)
    return shares.select(decision.alias("model"), reason.alias("reason"))


def frequency_share(df: DataFrame, *keys: str) -> DataFrame:
    """Count and percentage of each key; rows with a null key don't count."""
    counts = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row, not a window over everything
    return counts.join(F.broadcast(total)).select(*keys, "n", (100.0 * F.col("n") / F.col("total")).alias("share"))


def named_profile(df: DataFrame, song: str, name: str) -> DataFrame:
    """One row: tracks with and without a name, distinct names, songs, named tracks a song (0 of no songs)."""
    has = F.coalesce(F.trim(name), F.lit("")) != ""
    out = df.agg(
        F.count_if(has).alias("named"), F.count_if(~has).alias("unnamed"), F.countDistinct(F.when(has, F.col(name))).alias("names"), F.countDistinct(song).alias("songs")
    )
    return out.withColumn("per_song", F.coalesce(F.col("named") / F.nullif(F.col("songs"), F.lit(0)), F.lit(0.0)))


def two_level_breakdown(df: DataFrame, song: str, value: str, label: str, top: int) -> DataFrame:
    """Largest value of each song, then count, median and maximum by its label: the ``top`` largest labels.

    A song's label is the first in order among its non-null ones. Ties by label.
    """
    songs = df.where(F.col(song).isNotNull()).groupBy(song).agg(F.max(value).alias("longest"), F.min(label).alias(label))
    known = songs.where(F.col(label).isNotNull())
    best = known.groupBy(label).agg(F.count("*").alias("n"), F.max("longest").alias("longest")).orderBy(F.desc("n"), label).limit(top)
    middle = quantiles(known.where("longest is not null").select(label, "longest"), [label], "longest", [0.5])
    return best.join(middle, label, "left").select(label, "n", F.get("q", F.lit(0)).alias("median"), "longest")


def top_and_other(df: DataFrame, key: str, top: int) -> DataFrame:
    """The ``top`` largest counts and, if anything is left, one row ``Other`` for the rest."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    largest = counts.orderBy(F.desc("n"), key).limit(top)
    rest = counts.join(F.broadcast(largest.select(key)), key, "left_anti").agg(F.sum("n").alias("n")).where("n > 0")
    return largest.select(F.col(key).cast("string").alias(key), "n").unionByName(rest.select(F.lit("Other").alias(key), "n"))


def dense_histogram(df: DataFrame, band: Column, domain: Sequence[int]) -> DataFrame:
    """Counts of every band of the domain, empty ones too, with percentages."""
    spark = df.sparkSession
    counts = df.groupBy(band.alias("band")).agg(F.count("*").alias("c")).where("band is not null")
    every = spark.createDataFrame([(int(b),) for b in domain], "band int")
    total = counts.agg(F.sum("c").alias("total"))
    dense = every.join(counts, "band", "left").join(F.broadcast(total))
    n = F.coalesce("c", F.lit(0))
    return dense.select("band", n.alias("n"), F.coalesce(100.0 * n / F.col("total"), F.lit(0.0)).alias("share"))


def fixed_histogram(df: DataFrame, value: Column, high: float, bins: int) -> DataFrame:
    """Equal bins over the range of the values cut off at ``high``; the top edge is in the last bin.

    Values that are all equal are in the middle of a range of one.
    """
    rows = df.select(F.least(value, F.lit(high)).cast("double").alias("v")).where("v is not null")
    counts = rows.groupBy("v").agg(F.count("*").alias("c"))
    ends = counts.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    flat = F.col("low") == F.col("high")
    low, width = F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")), F.when(flat, 1.0).otherwise(F.col("high") - F.col("low"))
    at = F.least(F.floor((F.col("v") - low) * bins / width), F.lit(bins - 1)).cast("int")
    return counts.join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.sum("c").alias("n"))


def ecdf(df: DataFrame, value: str, group: str) -> DataFrame:
    """Distinct values by group with the percentage of rows at or below."""
    rows = df.where(F.col(value).isNotNull()).select(group, value)
    counts = rows.groupBy(group, value).agg(F.count("*").alias("c"))
    return cumulative(counts, [group], value, rows).select(group, value, (100.0 * F.col("upto") / F.col("n")).alias("pct"))


def top_keeping(df: DataFrame, key: str, top: int, always: object) -> DataFrame:
    """The ``top`` largest counts; if one key isn't among them it takes the last place."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), key).limit(top)
    mine = F.col(key) == F.lit(always)
    ranked = best.unionByName(counts.where(mine)).distinct()  # at most one row more than ``top``
    return ranked.orderBy((~mine).cast("int"), F.desc("n"), key).limit(top) if top > 0 else counts


def register_report(df: DataFrame, status: str, program: str) -> DataFrame:
    """Counts by status, by program, and overall, in one pass."""
    sets = df.groupingSets([[status], [program], []], status, program)
    return sets.agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def share_compare(a: DataFrame, b: DataFrame, key: str, top: int | None = None, rank_by: str = "share_a") -> DataFrame:
    """Percentages of each key in two tables; 0 where one lacks it. With ``top``, the largest of one side."""
    one, two = (frequency_share(t, key).select(key, F.col("share").alias(c)) for t, c in ((a, "share_a"), (b, "share_b")))
    both = one.join(two, key, "full_outer").select(key, F.coalesce("share_a", F.lit(0.0)).alias("share_a"), F.coalesce("share_b", F.lit(0.0)).alias("share_b"))
    return both if top is None else both.orderBy(F.desc(rank_by), key).limit(top)
