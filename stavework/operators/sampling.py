"""Deterministic samples and blinded orders, by hashes of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_key(seed: int, *keys: str) -> Column:
    """What a seeded order goes by: a hash that other engines have too."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def sample_rows(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows without replacement, the same for a seed whatever the row order."""
    return df.orderBy(seeded_key(seed, *keys), *keys).limit(n)


def label(position: Column) -> Column:
    """A to Z, AA to ZZ, AAA and on, from 0."""
    def letter(state: Column, _: Column) -> Column:
        more = state.left >= 0
        text = F.when(more, F.concat(F.char(65 + state.left % 26), state.text)).otherwise(state.text)
        return F.struct(text.alias("text"), F.when(more, F.floor(state.left / 26) - 1).otherwise(state.left).alias("left"))

    start = F.struct(F.lit("").alias("text"), position.cast("long").alias("left"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, letter, lambda s: s.text)


def blinded(df: DataFrame, group: str, item: str, seed: int) -> DataFrame:
    """Items of each group in a seeded order, labelled A to Z, AA and on."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(seeded_key(seed, group, item), item)) - 1
    return df.withColumn("position", at).withColumn("label", label(F.col("position")))


def unblinded(ratings: DataFrame, trials: DataFrame, group: str, item: str) -> DataFrame:
    """Ratings by blind label with what was behind it: trials as ``blinded`` gives them, ratings with the group and ``label``.

    Ratings of a label that the group's trial doesn't have go.
    """
    key = trials.select(F.col(group).alias("of"), F.col("label").alias("as"), item)
    return ratings.join(key, F.col(group).eqNullSafe(F.col("of")) & (F.col("label") == F.col("as"))).drop("of", "as")


def card_order(cards: DataFrame, mode: str, seed: int, card: str, place: str, *group: str) -> DataFrame:
    """``turn``: the key that cards are shown by: as they come, shuffled, or in shuffled groups shuffled inside."""
    if mode not in ("sequential", "shuffle", "group"):
        raise ValueError(f"unknown order {mode!r}")
    shuffled = seeded_key(seed, card)
    keys = {"sequential": F.format_string("%020d", F.col(place).cast("long")), "shuffle": shuffled, "group": F.concat_ws("|", seeded_key(seed, *group), shuffled) if group else shuffled}
    return cards.withColumn("turn", keys[mode])


def seeded_choice(choices: Column, seed: int, *keys: str) -> Column:
    """One of an array's values by the keys' hash; null of an empty one."""
    number = F.conv(F.substring(seeded_key(seed, *keys), 1, 12), 16, 10).cast("long")
    return F.get(choices, (number % F.nullif(F.size(choices), F.lit(0))).cast("int"))


def preferred_first(df: DataFrame, category: str, preferred: str, usable: str, n: int, seed: int, *keys: str) -> DataFrame:
    """n usable rows of each category, preferred ones before others, each in a seeded order, with their ``rank``."""
    order = [(~F.coalesce(F.col(preferred), F.lit(False))).cast("int"), seeded_key(seed, *keys), *keys]
    rank = F.row_number().over(Window.partitionBy(category).orderBy(*order))
    return df.where(F.col(usable)).withColumn("rank", rank).where(F.col("rank") <= n)


def distinct_songs_first(df: DataFrame, category: str, song: str, n: int, seed: int, *keys: str, strict: bool = False) -> DataFrame:
    """n rows of each category: one of each song before a second of any. strict: fewer are an error."""
    by_song = F.row_number().over(Window.partitionBy(category, song).orderBy(seeded_key(seed, *keys), *keys))
    turn = df.withColumn("_turn", by_song)
    rank = F.row_number().over(Window.partitionBy(category).orderBy("_turn", seeded_key(seed, *keys), *keys))
    out = turn.withColumn("rank", rank).where(F.col("rank") <= n).drop("_turn")
    if not strict:
        return out
    short = df.groupBy(F.col(category).alias("of")).count().where(F.col("count") < n)
    say = F.raise_error(F.concat(F.col("of").cast("string"), F.lit(f": fewer than {n} rows")))
    joined = out.join(short, F.col(category).eqNullSafe(F.col("of")), "left")
    return joined.withColumn("rank", F.when(F.col("count").isNull(), F.col("rank")).otherwise(say.cast("int"))).select(out.columns)
