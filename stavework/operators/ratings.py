"""Listening-test ratings: two-level statistics and the rules that pick winners.

ratings: ``listener``, ``stem``, ``category``, ``variant``, ``content``, ``realism``
(decimals). Every rule has a total order, so results don't depend on row order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = "decimal(18,6)"
TIE = 1e-9
#: Parts, at least, that rows are dealt to where nearly each is a group of its own.
PARTS = 200


def _mean(value: str) -> Column:
    """Exact sum over exact count, kept as a decimal so that it can be summed again."""
    return (F.sum(value).cast("double") / F.count(value)).cast(SCALE)


def two_level_stats(ratings: DataFrame) -> DataFrame:
    """Means of each stem, then of each (category, variant); null keys are a group.

    Rows are dealt to many parts before they are grouped, not by the size of their files
    nor merged again by what they take packed: a task's memory is that of its part's groups.
    """
    keys = ["stem", "category", "variant"]
    parts = max(PARTS, int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = ratings.select(*keys, "content", "realism").repartition(parts, *keys)
    stems = dealt.groupBy(*keys).agg(_mean("content").alias("content"), _mean("realism").alias("realism"))
    return stems.groupBy("category", "variant").agg(
        _mean("content").cast("double").alias("mean_content"),
        _mean("realism").cast("double").alias("mean_realism"),
        F.min("content").cast("double").alias("min_content"),
        F.count("stem").alias("stems"),  # each is there once
    )


def _best(rows: DataFrame, *order: Column | str) -> DataFrame:
    by = Window.partitionBy("category").orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_rank")


def winner_global_fallback(stats: DataFrame, least_content: float = 3.0, least_mean: float = 3.5) -> DataFrame:
    """Best eligible variant of each category; if nothing at all is eligible, of all rows.

    Order: realism and content descending, then variant.
    """
    passes = (F.col("min_content") >= least_content) & (F.col("mean_content") >= least_mean)
    some = stats.agg(F.coalesce(F.bool_or(passes), F.lit(False)).alias("_any"))
    pool = stats.join(F.broadcast(some)).where(passes | ~F.col("_any")).drop("_any")
    return _best(pool, F.desc("mean_realism"), F.desc("mean_content"), "variant")


def winner_group_fallback(stats: DataFrame, least_mean: float, level: str = "level") -> DataFrame:
    """Best of a category's rows over the threshold, or of all its rows if none is.

    Order: realism, level and content descending, then variant.
    """
    whole = Window.partitionBy("category")
    passes = F.col("mean_content") >= least_mean
    pool = stats.withColumn("_any", F.max(passes).over(whole)).where(passes | ~F.col("_any")).drop("_any")
    return _best(pool, F.desc("mean_realism"), F.desc(level), F.desc("mean_content"), "variant")


def audit_winner(stats: DataFrame, winners: DataFrame, least_mean: float, level: str = "level") -> DataFrame:
    """Choose again between each winner and the level one step lower; ties go lower.

    Returns the category, the level chosen, and whether that revises the winner.
    """
    levels = stats.select("category", level).distinct()
    lower = levels.withColumn("_lower", F.lag(level).over(Window.partitionBy("category").orderBy(level)))
    allowed = winners.select("category", F.col(level).alias("_won")).join(lower.withColumnRenamed(level, "_won"), ["category", "_won"])
    rows = stats.join(allowed, "category").where((F.col(level) == F.col("_won")) | (F.col(level) == F.col("_lower")))
    passes = F.col("mean_content") >= least_mean
    pool = rows.withColumn("_any", F.max(passes).over(Window.partitionBy("category"))).where(passes | ~F.col("_any"))
    best = _best(pool, F.desc("mean_realism"), F.asc(level), F.desc("mean_content"), "variant")
    return best.select("category", F.col(level).alias("chosen"), (F.col(level) < F.col("_won")).alias("revised"))


def shortlist(stats: DataFrame, realism: float, mean_rating: float) -> DataFrame:
    """Variants over either threshold; a category without one keeps its single best."""
    whole = Window.partitionBy("category")
    passes = (F.col("mean_realism") >= realism) | ((F.col("mean_content") + F.col("mean_realism")) / 2 >= mean_rating)
    ranked = stats.select(
        "*",
        passes.alias("_ok"),
        F.max(passes).over(whole).alias("_any"),
        F.row_number().over(whole.orderBy(F.desc("mean_realism"), F.desc("mean_content"), "variant")).alias("_rank"),
    )
    return ranked.where("_ok or (not _any and _rank = 1)").select("category", "variant", "mean_content", "mean_realism")


def metric_stats(ratings: DataFrame, metric: str, variants: Sequence[str] | None = None) -> DataFrame:
    """Mean, standard error and count by (category, variant).

    In a category with more than one listener they are over the listeners' own means,
    else over the ratings. With ``variants`` every category has a row for each of them,
    with nulls where it has no rating.
    """
    rated = ratings.where(F.col(metric).isNotNull())
    own = rated.groupBy("category", "variant", "listener").agg(_mean(metric).alias("m"))
    error = lambda v: F.coalesce(F.stddev_samp(v.cast("double")) / F.sqrt(F.count(v).cast("double")), F.lit(0.0))
    m, raw = F.col("m"), F.col(metric)
    keys = ["category", "variant"]
    many = own.groupBy(*keys).agg((F.sum(m).cast("double") / F.count(m)).alias("mean"), error(m).alias("sem"), F.count(m).alias("n"))
    one = rated.groupBy(*keys).agg((F.sum(raw).cast("double") / F.count(raw)).alias("mean"), error(raw).alias("sem"), F.count(raw).alias("n"))
    heard = own.groupBy("category").agg((F.countDistinct("listener") > 1).alias("several"))
    renamed = one.select(*(F.col(k).alias(f"of_{k}") for k in keys), *(F.col(c).alias(f"one_{c}") for c in ("mean", "sem", "n")))
    both = many.join(renamed, F.col("category").eqNullSafe(F.col("of_category")) & F.col("variant").eqNullSafe(F.col("of_variant")))
    told = both.join(heard.withColumnRenamed("category", "in_category"), F.col("category").eqNullSafe(F.col("in_category")))
    out = told.select(*keys, *(F.when(F.col("several"), F.col(c)).otherwise(F.col(f"one_{c}")).alias(c) for c in ("mean", "sem", "n")))
    if variants is None:
        return out
    every = heard.select("category", F.explode(F.array(*map(F.lit, variants))).alias("variant"))
    return every.join(out, keys, "left")


def hidden_conditions(ratings: DataFrame) -> DataFrame:
    """(category, variant) of which every rating was copied from a donor (``auto``; null is no)."""
    return ratings.groupBy("category", "variant").agg(F.bool_and(F.coalesce("auto", F.lit(False))).alias("hidden")).where("hidden").drop("hidden")


def leaderboard(stats: DataFrame, hidden: DataFrame | None = None, prefix: str | None = None) -> DataFrame:
    """Winners of each category (within a tiny tolerance), the runner-up's mean and the margin.

    hidden: (category, variant) that don't take part. With ``prefix``, also the margin of
    the first winner of that prefix over its donor, the variant without the prefix.
    """
    shown = stats if hidden is None else stats.join(hidden, ["category", "variant"], "left_anti")
    whole = Window.partitionBy("category")
    rows = shown.where("mean is not null").withColumn("best", F.max("mean").over(whole))
    wins = F.col("mean") >= F.col("best") - TIE
    out = rows.groupBy("category").agg(
        F.max("best").alias("best"),
        F.array_join(F.array_sort(F.collect_list(F.when(wins, F.col("variant")))), ",").alias("winners"),
        F.max(F.when(~wins, F.col("mean"))).alias("runner_up"),
    ).withColumn("margin", F.col("best") - F.col("runner_up"))
    if prefix is None:
        return out
    copies = F.filter(F.split("winners", ","), lambda w: w.startswith(prefix))
    donor = F.substring(F.get(copies, 0), len(prefix) + 1, 1_000)
    means = rows.select(F.col("category").alias("of"), F.col("variant").alias("donor"), F.col("mean").alias("donor_mean"))
    asked = out.withColumn("asked", donor)
    joined = asked.join(means, F.col("category").eqNullSafe(F.col("of")) & (F.col("asked") == F.col("donor")), "left")
    return joined.withColumn("donor_margin", F.col("best") - F.col("donor_mean")).drop("of", "donor", "donor_mean", "asked")


def means_with_override(ratings: DataFrame, reference: str) -> DataFrame:
    """Mean ``content`` and ``realism`` by variant; content without reference rows where there are others.

    ratings: ``variant``, ``is_reference`` (null is no), ``content``, ``realism``. The
    reference variant itself has no content if all its rows are reference rows.
    """
    plain = ~F.coalesce("is_reference", F.lit(False))
    of = lambda v: F.sum(v).cast("double") / F.nullif(F.count(v), F.lit(0))
    means = ratings.groupBy("variant").agg(
        of(F.when(plain, F.col("content"))).alias("others"), of(F.col("content")).alias("every"), of(F.col("realism")).alias("realism")
    )
    content = F.coalesce("others", F.when(F.col("variant") != reference, F.col("every")))
    return means.select("variant", content.alias("content"), "realism")


def content_difference(ratings: DataFrame, base_of: dict[str, str], place: str) -> DataFrame:
    """Each rating's content less its base variant's for the same listener and stem.

    The base side is the first row of its key by ``place``, so no row is multiplied;
    variants that have a base themselves are none. Variants without a base differ by 0
    where they have content; ratings without a base row, or whose base row has no
    content, have null.
    """
    bases = F.create_map(*(F.lit(x) for pair in base_of.items() for x in pair))
    own = ratings.withColumn("base", bases[F.col("variant")])
    # a base's rows, first by place, before those that ask for it: each row is dealt out and sorted once
    has, ordered = F.col("base").isNotNull(), F.col("base").isNull() & F.col(place).isNotNull()
    by = Window.partitionBy("stem", "listener", F.coalesce("base", "variant")).orderBy(F.desc(ordered), place)
    first = F.first(F.when(ordered, F.struct("content"))).over(by.rowsBetween(Window.unboundedPreceding, 0))  # a null content is first too
    joined = own.withColumn("base_content", F.when(has, first["content"]))
    apart = F.when(has, F.col("content") - F.col("base_content")).when(F.col("content").isNotNull(), 0)
    return joined.withColumn("difference", apart.cast("double"))


def _means_of(ratings: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """A column for each metric with the mean that ``metric_stats`` gives, of one pass over the ratings; null without a rating."""
    keys = ["category", "variant"]
    sums = [c for k, m in enumerate(metrics) for c in (F.sum(m).alias(f"sum_{k}"), F.count(m).alias(f"n_{k}"), _mean(m).alias(f"own_{k}"))]
    own = ratings.groupBy(*keys, "listener").agg(*sums)
    over = lambda total, n: F.sum(total).cast("double") / n
    whole, found, told = Window.partitionBy("category"), [], []
    for k, metric in enumerate(metrics):
        who = F.when(F.col(f"n_{k}") > 0, F.col("listener"))
        found += [over(f"own_{k}", F.count(f"own_{k}")).alias(f"many_{k}"), over(f"sum_{k}", F.sum(f"n_{k}")).alias(f"one_{k}"), F.min(who).alias(f"from_{k}"), F.max(who).alias(f"to_{k}")]
        several = F.min(f"from_{k}").over(whole) < F.max(f"to_{k}").over(whole)
        told.append(F.when(several, F.col(f"many_{k}")).otherwise(F.col(f"one_{k}")).alias(metric))
    return own.groupBy(*keys).agg(*found).select(*keys, *told)


def category_winners(ratings: DataFrame, base_of: dict[str, str], place: str, hidden: DataFrame | None = None, prefix: str | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """Each category's winners by mean realism, with their content and content difference, rounded to two digits.

    Means are those of ``metric_stats``; a variant takes part if it has a mean realism and
    isn't in ``hidden``. Winners within a tiny tolerance stand in the order of realism,
    content (none last) and name; the first one's figures are given. ``margin`` is over
    the best of the others; with ``prefix``, ``donor_margin`` is that of the first winner
    of that prefix over the variant without it. labels: what variants are called.
    """
    rows = content_difference(ratings, base_of, place).withColumn("difference", F.col("difference").cast(SCALE))
    keys = ["category", "variant"]
    named = reduce(and_, (F.col(k).isNotNull() for k in keys))  # without both names, only the mean realism is told
    shown = (F.when(named, F.col(m)).alias(c) for m, c in (("content", "content"), ("difference", "content_diff")))
    means = _means_of(rows, ["realism", "content", "difference"]).where("realism is not null").select(*keys, "realism", *shown)
    if hidden is not None:
        means = means.join(hidden.select(*keys), keys, "left_anti")
    whole = Window.partitionBy("category")
    ranked = means.withColumn("best", F.max("realism").over(whole))
    wins = F.col("realism") >= F.col("best") - TIE
    # sorted by the negated means, so that the best is first and a null, as infinity, last
    down = lambda c: F.coalesce(-F.col(c), F.lit(float("inf")))
    row = F.struct(down("realism").alias("r"), down("content").alias("c"), "variant", "realism", "content", "content_diff")
    figures = [F.max("best").alias("best"), F.array_sort(F.collect_list(F.when(wins, row))).alias("won"), F.max(F.when(~wins, F.col("realism"))).alias("second")]
    if prefix is not None:
        copy = F.min(F.when(wins & F.startswith("variant", F.lit(prefix)), row)).over(whole)  # the first winner of them
        ranked = ranked.withColumn("donor", F.substring(copy["variant"], len(prefix) + 1, 1_000))
        figures.append(F.max(F.when(F.col("variant") == F.col("donor"), F.col("realism"))).alias("donor_mean"))
    out = ranked.groupBy("category").agg(*figures)
    called = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)) if labels else None
    name = lambda w: w.variant if called is None else F.coalesce(called[w.variant], w.variant)
    two = lambda c: F.bround(c, 2)
    first = F.get("won", F.lit(0))
    return out.select(
        "category",
        F.array_join(F.transform("won", lambda w: w.variant), ",").alias("winner"),
        F.array_join(F.transform("won", name), ",").alias("winner_label"),
        *(two(first[c]).alias(c) for c in ("content", "content_diff", "realism")),
        two(F.col("best") - F.col("second")).alias("margin"),
        *([two(F.col("best") - F.col("donor_mean")).alias("donor_margin")] if prefix is not None else []),
    )


def donor_expansion(ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Copies of donors' rows for their duplicates, where those have no row of their own.

    pairs: ``donor``, ``duplicate``. New rows are marked ``auto`` and name their donor; of
    several donors the first by name counts.
    """
    keys = ["listener", "stem", "variant"]
    made = ratings.join(pairs, ratings["variant"] == pairs["donor"]).drop("variant").withColumnRenamed("duplicate", "variant")
    new = made.join(ratings.select(*keys).distinct(), keys, "left_anti")
    order = Window.partitionBy(*keys).orderBy("donor", F.desc("content"), F.desc("realism"))
    first = new.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    own = ratings.select("*", F.lit(None).cast("string").alias("donor"), F.lit(False).alias("auto"))
    if "is_reference" in ratings.columns:  # a copy is never the reference
        first = first.withColumn("is_reference", F.lit(False))
    return own.unionByName(first.withColumn("auto", F.lit(True)))


def overall_winner(means: DataFrame, reference: str) -> DataFrame:
    """One row: best realism among variants whose content is near enough to the best.

    Floor: the larger of 50 and the best content less 20; without any, content of 60 and
    more; without any, the highest content.
    """
    rows = means.where(F.col("variant") != reference)
    best = rows.agg(F.max("content").alias("_top"))
    pool = rows.join(F.broadcast(best))
    grade = F.when(F.col("content") >= F.greatest(F.lit(50.0), F.col("_top") - 20), 0).when(F.col("content") >= 60, 1).when(F.col("content") == F.col("_top"), 2)
    return pool.withColumn("_grade", grade).where("_grade is not null").orderBy("_grade", F.desc("realism"), F.desc("content"), "variant").limit(1).select(
        "variant", "content", "realism"
    )


def threshold_grid(scores: DataFrame, thresholds: int = 21) -> DataFrame:
    """Share of rows on which ``score >= t`` agrees with ``label``, for t from 0 to 1.

    scores: ``score``, ``label``. Counts are taken once for each distinct pair, then
    compared with the grid; ``best`` is the last threshold with the highest agreement.
    """
    counts = scores.groupBy("score", "label").agg(F.count("*").alias("n"))
    grid = scores.sparkSession.range(thresholds).select((F.col("id") / (thresholds - 1)).alias("t"))
    agree = F.sum(F.when((F.col("score") >= F.col("t")) == F.col("label"), F.col("n")).otherwise(0))
    shares = counts.join(F.broadcast(grid)).groupBy("t").agg((agree / F.sum("n")).alias("agreement"))
    return shares.withColumn("best", F.row_number().over(Window.orderBy(F.desc("agreement"), F.desc("t"))) == 1)  # of the grid's few rows
