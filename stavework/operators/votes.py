"""Swipe votes: last vote counts, sibling cascades, tiered pools.

votes: ``card``, ``category``, ``variant``, ``tier``, ``at`` (arrival order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from stavework.operators.tables import keyed_union, last_of_each, one_of_each

REJECT, WEAK_REJECT, WEAK_ACCEPT, ACCEPT = "strong_reject", "weak_reject", "weak_accept", "strong_accept"
TIERS = (REJECT, WEAK_REJECT, WEAK_ACCEPT, ACCEPT)


def last_votes(votes: DataFrame) -> DataFrame:
    """The last vote of each card; unknown tiers don't count."""
    return last_of_each(votes.where(F.col("tier").isin(*TIERS)), ["card"], "at", "tier")


def merged(session: DataFrame, incoming: DataFrame) -> DataFrame:
    """A session's votes with incoming ones in them: the last vote of a card counts, at the card's first place.

    Both: ``card`` (if null or empty, made of variant and clip), ``variant``, ``clip``, ``tier``,
    ``at``. Votes without a card, variant and clip go.
    """
    made = F.coalesce(F.nullif("card", F.lit("")), F.when(F.col("variant").isNotNull() & F.col("clip").isNotNull(), F.concat_ws("|", "variant", "clip")))
    named = lambda df: df.select(made.alias("card"), "variant", "clip", "tier", "at").where("card is not null")
    return keyed_union(named(session), named(incoming), ["card"], "at")


def cascade(cards: DataFrame, votes: DataFrame, place: str, overwrite: bool = True) -> DataFrame:
    """Votes of all cards after strong votes have spread to their siblings.

    cards: ``card``, ``category``, ``variant`` and their order, ``place``; votes: one a
    card. A strong reject overwrites every sibling (same category and variant), or without
    ``overwrite`` fills those without a vote; then a strong accept fills siblings that
    still have none. ``source`` is the first card in order that triggered it.
    """
    voted = cards.join(votes.select("card", "tier"), "card", "left")
    siblings = Window.partitionBy("category", "variant")
    first = lambda tier: F.min_by("card", F.when(F.col("tier") == tier, F.col(place))).over(siblings)
    rejecter, accepter = first(REJECT), first(ACCEPT)
    marked = voted.select("*", rejecter.alias("_rejecter"), accepter.alias("_accepter"))
    reached = ~F.col("tier").eqNullSafe(F.lit(REJECT)) if overwrite else F.col("tier").isNull()
    spread = F.col("_rejecter").isNotNull() & reached
    filled = F.col("_rejecter").isNull() & F.col("tier").isNull() & F.col("_accepter").isNotNull()
    return marked.select(
        "card",
        "category",
        "variant",
        F.when(spread, REJECT).when(filled, ACCEPT).otherwise(F.col("tier")).alias("tier"),
        F.when(spread, F.col("_rejecter")).when(filled, F.col("_accepter")).alias("source"),
    )


def tier_pools(votes: DataFrame, weak_cap: int = 3, most: int | None = None, strict: bool = False) -> DataFrame:
    """Each category's variants of the best tier that any of its variants has.

    A variant is in the pool of its best vote: 0 strong accepts, 1 weak accepts, 2 weak
    and 3 strong rejects. Accepted variants rank by votes in the pool's tier and then by
    name, rejected ones by name. Pools of strong accepts are whole, others keep
    ``weak_cap`` variants; no pool keeps over ``most``. strict: a category without any
    accept is an error.
    """
    rank = F.when(F.col("tier") == ACCEPT, 0).when(F.col("tier") == WEAK_ACCEPT, 1).when(F.col("tier") == WEAK_REJECT, 2).otherwise(3)
    counts = votes.where(F.col("tier").isin(*TIERS)).groupBy("category", "variant", rank.alias("pool")).agg(F.count("*").alias("votes"))
    best = one_of_each(counts, ["category", "variant"], "pool")
    top = best.groupBy(F.col("category").alias("of")).agg(F.min("pool").alias("top"))
    pooled = best.join(top, F.col("category").eqNullSafe(F.col("of")) & (F.col("pool") == F.col("top"))).drop("of", "top")
    if strict:
        none = F.raise_error(F.concat(F.coalesce("category", F.lit("no category")), F.lit(": no accepts")))
        pooled = pooled.withColumn("pool", F.when(F.col("pool") <= 1, F.col("pool")).otherwise(none.cast("int")))
    by = Window.partitionBy("category").orderBy(F.desc(F.when(F.col("pool") <= 1, F.col("votes"))), "variant")
    ranked = pooled.withColumn("rank", F.row_number().over(by))
    kept = ranked.where((F.col("pool") == 0) | (F.col("rank") <= max(weak_cap, 1)))
    return kept if most is None else kept.where(F.col("rank") <= most)


def sanitised(votes: DataFrame, variants: DataFrame, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """Votes without those cascaded from another variant and those for unknown variants; and a row of how many went.

    votes: ``variant``, ``cascaded_from`` (a card id that begins with its variant);
    variants: ``variant``. The second table has ``crossed`` and ``unknown``. With ``seen``,
    the first table's own pass counts them too (and ``votes``), so that the second isn't
    needed.
    """
    crossed = F.coalesce(F.substring_index("cascaded_from", "|", 1) != F.col("variant"), F.lit(False)) & (F.coalesce("cascaded_from", F.lit("")) != "")
    known = variants.select("variant").distinct().withColumn("listed", F.lit(True))
    marked = votes.withColumn("crossed", crossed).join(known, "variant", "left")
    counts = F.count_if("crossed").alias("crossed"), F.count_if(~F.col("crossed") & F.col("listed").isNull()).alias("unknown")
    passed = marked if seen is None else marked.observe(seen, F.count("*").alias("votes"), *counts)
    return passed.where("not crossed and listed").select(votes.columns), marked.agg(*counts)


def tiers_seen(votes: DataFrame) -> DataFrame:
    """(category, variant, ``tiers``): the known tiers that a variant was given, in order."""
    order = F.array(*map(F.lit, TIERS))
    seen = votes.where(F.col("tier").isin(*TIERS)).groupBy("category", "variant").agg(F.collect_set("tier").alias("seen"))
    return seen.select("category", "variant", F.filter(order, lambda t: F.array_contains("seen", t)).alias("tiers"))


def progress(cards: DataFrame, votes: DataFrame) -> DataFrame:
    """By category: cards without a vote, accepted, and voted otherwise."""
    joined = cards.join(votes.select("card", "tier"), "card", "left")
    return joined.groupBy("category").agg(
        F.count_if(F.col("tier").isNull()).alias("open"),
        F.count_if(F.col("tier") == ACCEPT).alias("accepted"),
        F.count_if(F.col("tier") != ACCEPT).alias("rejected"),
    )
