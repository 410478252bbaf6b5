"""Keyed tables: last-wins merges, upserts, completeness, drift, work lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_of_each(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a total order; null keys are keys."""
    rank = spare(df, "rank_of_key")
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(by)).where(F.col(rank) == 1).drop(rank)


def last_of_each(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The row of each key that is last by some columns; rows are reduced before they are shuffled.

    Rows with equal order columns are told apart by all their columns. Null keys are keys.
    """
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), *(F.col(c).alias(f"r{i}") for i, c in enumerate(rest)))
    best = df.groupBy(*keys).agg(F.max(by).alias("best_of_key"))
    return best.select(*keys, *(F.col(f"best_of_key.r{i}").alias(c) for i, c in enumerate(rest))).select(df.columns)


def keyed_union(old: DataFrame, new: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """Rows of both tables, one a key: new ones win over old, the last ``place`` of a table wins, and the first place is kept."""
    side, first = spare(old, "side"), spare(old, "first_place")
    both = old.withColumn(side, F.lit(0)).unionByName(new.withColumn(side, F.lit(1)))
    kept = last_of_each(both, keys, side, place)
    places = both.groupBy(*(F.col(k).alias(f"of_{k}") for k in keys)).agg(F.min(F.struct(side, place)).alias(first))
    joined = kept.join(places, reduce(and_, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys)))
    return joined.select(*(F.col(f"{first}.{place}").alias(c) if c == place else F.col(c) for c in old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old without the keys of new, then all of new; repeats inside new stay."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def complete_songs(tracks: DataFrame, songs: DataFrame, song: str, track: str, expected: str) -> DataFrame:
    """Songs with at least the expected number of distinct tracks."""
    counts = tracks.groupBy(song).agg(F.countDistinct(track).alias("found"))
    return songs.join(counts, song).where(F.col("found") >= F.col(expected)).select(song, "found")


def songs_not_covered(tracks: DataFrame, songs: DataFrame, song: str, track: str, expected: str) -> DataFrame:
    """Songs of which a track from 0 to expected - 1 has no row. Further tracks don't matter; a song of none is covered."""
    number = F.col(track).cast("long")
    own = tracks.select(F.col(song).alias("of_song"), number.alias("of_track")).distinct()
    counted = songs.join(own, (F.col(song) == F.col("of_song")) & (F.col("of_track") >= 0) & (F.col("of_track") < F.col(expected)), "left")
    found = counted.groupBy(song, expected).agg(F.count("of_track").alias("found"))
    return found.where(F.col("found") < F.col(expected)).select(song, expected, "found")


def missing_tracks(tracks: DataFrame, songs: DataFrame, song: str, track: str, expected: str) -> DataFrame:
    """Every (song, track) from 0 to expected - 1 that has no row."""
    due = songs.where(F.col(expected) > 0).select(song, F.explode(F.sequence(F.lit(0), F.col(expected).cast("int") - 1)).alias(track))
    return due.join(tracks.select(song, F.col(track).cast("int").alias(track)).distinct(), [song, track], "left_anti")


def drift(wanted: DataFrame, recorded: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Wanted rows whose record is missing or differs; nulls compare as values, in keys too."""
    there = spare(wanted, "has_record")
    was = recorded.select(*(F.col(k).alias(f"of_{k}") for k in keys), *(F.col(v).alias(f"was_{v}") for v in values), F.lit(True).alias(there))
    joined = wanted.join(was, reduce(and_, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys)), "left")
    same = F.struct(*values).eqNullSafe(F.struct(*(F.col(f"was_{v}").alias(v) for v in values)))
    kind = F.when(F.col(there).isNull(), "missing").when(~same, "changed")
    return joined.withColumn("conflict", kind).where("conflict is not null").drop(there, *(f"of_{k}" for k in keys))


def grid_minus_done(left: DataFrame, right: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every pair of two small dimensions that isn't done."""
    return left.crossJoin(right).join(done.select(*keys).distinct(), list(keys), "left_anti")


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str, default: Column, *order: str) -> DataFrame:
    """df with ``value`` from a table, or the default. Of repeated keys the last by ``order`` (and value) counts."""
    found = spare(df, f"found_{value}")
    one = table.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(*order, F.col(value).alias("by_value"))).alias(found))
    return df.join(one, list(keys), "left").withColumn(value, F.coalesce(found, default)).drop(found)


def must_lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str, *order: str) -> DataFrame:
    """df with ``value`` from a table, of repeated keys the first by ``order``; a key that isn't there is an error."""
    found, there = spare(df, f"found_{value}"), spare(df, "has_key")
    one = table.groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order, F.col(value).alias("by_value"))).alias(found))
    joined = df.join(one.withColumn(there, F.lit(True)), list(keys), "left")
    say = F.raise_error(F.concat_ws(" ", F.lit(f"no {value} for"), *(F.col(k).cast("string") for k in keys)))
    return joined.withColumn(value, F.when(F.col(there), F.col(f"{found}.v")).otherwise(say.cast(dict(table.dtypes)[value]))).drop(found, there)


def inner_join(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str]) -> DataFrame:
    """Rows with equal keys; columns that both tables have get a suffix."""
    both = (set(left.columns) & set(right.columns)) - set(keys)
    named = lambda df, suffix: df.select(*(F.col(c).alias(c + suffix if c in both else c) for c in df.columns))
    return named(left, suffixes[0]).join(named(right, suffixes[1]), list(keys))


def first_key_lookup(df: DataFrame, table: DataFrame, row: str, candidates: Sequence[Column], key: str, value: str) -> DataFrame:
    """``row`` and the ``value`` of the first of several keys that the table (one row a key) has; null without any."""
    tried = F.filter(F.transform(F.array(*candidates), lambda k, i: F.struct(i.alias("turn"), k.alias("tried"))), lambda k: k.tried.isNotNull())
    asked = df.select(row, F.explode(tried).alias("k")).select(row, "k.*")
    hits = asked.join(table.select(F.col(key).alias("tried"), F.struct(F.col(value).alias("v")).alias("found")), "tried")
    best = hits.groupBy(row).agg(F.min_by("found", "turn").alias("best"))
    return df.select(row).distinct().join(best, row, "left").select(row, F.col("best.v").alias(value))


def fallback_track(asked: DataFrame, stems: DataFrame, song: str) -> DataFrame:
    """The file track of each asked (song, ``original``, ``fallback``).

    stems: the song, ``track``, ``original_track``. In order: a stem whose original track
    (its track if it has none) is the asked one, one whose track is, one whose track is
    the fallback, else the fallback itself; of several the lowest track.
    """
    own = stems.select(F.col(song).alias("of_song"), "track", F.coalesce("original_track", "track").alias("was"))
    grade = F.when(F.col("was") == F.col("original"), 0).when(F.col("track") == F.col("original"), 1).when(F.col("track") == F.col("fallback"), 2)
    hit = (F.col("was") == F.col("original")) | (F.col("track") == F.col("original")) | (F.col("track") == F.col("fallback"))
    keys = [song, "original", "fallback"]
    joined = asked.select(*keys).distinct().join(own, (F.col(song) == F.col("of_song")) & hit, "left")
    best = joined.groupBy(*keys).agg(F.min(F.when(F.col("of_song").isNotNull(), F.struct(grade.alias("grade"), "track"))).alias("best"))
    return best.select(*keys, F.coalesce("best.track", "fallback").alias("file_track"))


def reuse(tasks: DataFrame, outputs: DataFrame, donors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tasks with ``action``: skip, copy, pass or render.

    tasks: the keys, ``fingerprint``, ``fallback`` (whether a donor may stand in),
    ``enabled``; outputs: the keys and the ``fingerprint`` that they were made with;
    donors: the keys. Outputs that are current are skipped, fallbacks with a donor are
    copied, disabled ones are passed through.
    """
    made = outputs.groupBy(*keys).agg(F.collect_set("fingerprint").alias("made"))
    given = donors.select(*keys).distinct().withColumn("given", F.lit(True))
    joined = tasks.join(made, list(keys), "left").join(given, list(keys), "left")
    current = F.coalesce(F.array_contains("made", F.col("fingerprint")), F.lit(False))
    copied = F.coalesce(F.col("fallback"), F.lit(False)) & F.col("given").isNotNull()
    action = F.when(current, "skip").when(copied, "copy").when(~F.coalesce("enabled", F.lit(True)), "pass").otherwise("render")
    return joined.withColumn("action", action).drop("made", "given")


def larger_overlap(wanted: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One row: which of two catalogs to take. The first if it has any wanted key and no fewer than the second, else
    the second if that has any, else whichever has rows."""
    keys = wanted.select(key).distinct()
    count = lambda df, name: keys.join(df.select(key), key, "left_semi").agg(F.count("*").alias(name))
    rows = first.agg((F.count("*") > 0).alias("any_first"))
    both = count(first, "in_first").join(F.broadcast(count(second, "in_second"))).join(F.broadcast(rows))  # one row each
    hit = (F.col("in_first") > 0) & (F.col("in_first") >= F.col("in_second"))
    return both.select("in_first", "in_second", F.when(hit, "first").when(F.col("in_second") > 0, "second").when(F.col("any_first"), "first").otherwise("second").alias("chosen"))


def distinct_in_order(df: DataFrame, columns: Sequence[str], place: str) -> DataFrame:
    """Each distinct row of some columns at its first place."""
    return df.groupBy(*columns).agg(F.min(place).alias(place))


def merge_settings(base: DataFrame, override: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Entries of both tables by key; an override's entry replaces the whole base entry, nulls too."""
    own = override.select(F.col(key).alias("of_key"), F.struct(*values).alias("new"))
    joined = base.select(key, F.struct(*values).alias("old")).join(own, F.col(key).eqNullSafe(F.col("of_key")), "full_outer")
    entry = F.when(F.col("new").isNotNull(), F.col("new")).otherwise(F.col("old"))
    return joined.select(F.coalesce(key, "of_key").alias(key), entry.alias("entry")).select(key, "entry.*")


def by_list(df: DataFrame, column: str, order: Sequence, *then: str) -> DataFrame:
    """Rows sorted by a value's place in a list, unknown ones last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), *then)


def subset(df: DataFrame, name: str) -> DataFrame:
    """A named subset of songs: all, all_valid, or rated_deduplicated (which must be valid too). A null flag is no."""
    flags = {"all": [], "all_valid": ["all_valid"], "rated_deduplicated": ["all_valid", "rated_deduplicated"]}
    if name not in flags:
        raise ValueError(f"unknown subset {name!r}")
    return df.where(reduce(and_, (F.coalesce(F.col(f), F.lit(False)) for f in flags[name]), F.lit(True)))


def tagged(name: Column, hints: Sequence[tuple[str, Sequence[str]]], default: str = "general") -> Column:
    """Every tag of which a name has a hint, in the hints' order, or the default."""
    low = F.lower(F.coalesce(name, F.lit("")))
    has = lambda words: reduce(or_, (F.contains(low, F.lit(w)) for w in words))
    tags = F.array_compact(F.array(*(F.when(has(words), tag) for tag, words in hints)))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(default)))


def candidates(df: DataFrame, key: str, tags: str, place: str, wanted_ids: Sequence = (), wanted_tags: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Rows by id if ids are given, else with any of the wanted tags, else all; the first ``limit`` by place."""
    if wanted_ids:
        df = df.where(F.col(key).isin(*wanted_ids))
    elif wanted_tags:
        df = df.where(F.arrays_overlap(F.col(tags), F.array(*map(F.lit, wanted_tags))))
    return df if limit is None else df.orderBy(place).limit(limit)


def filled(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Nulls of some columns filled, in the columns' types."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(dict(df.dtypes)[c])) for c, v in defaults.items()})


def ready(songs: DataFrame, routing: DataFrame, song: str, track: str, expected: str, expected_songs: int) -> DataFrame:
    """One row: songs, those not covered by routing, and whether the next pass may begin."""
    open_ = songs_not_covered(routing, songs, song, track, expected).agg(F.count("*").alias("uncovered"))
    counts = songs.agg(F.countDistinct(song).alias("songs")).join(F.broadcast(open_))
    return counts.withColumn("ready", (F.col("songs") > 0) & (F.col("songs") >= expected_songs) & (F.col("uncovered") == 0))


def remaining_work(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """``key``, ``remaining``: expected ``n`` less what is done, not below 0."""
    counts = done.groupBy(key).agg(F.count("*").alias("n_done"))
    left = F.greatest(F.col("n") - F.coalesce("n_done", F.lit(0)), F.lit(0))
    return expected.join(counts, key, "left").select(key, left.alias("remaining"))


def has_all(df: DataFrame, key: str, member: str, members: Sequence) -> DataFrame:
    """Keys that occur with every one of the members."""
    return df.where(F.col(member).isin(*members)).groupBy(key).agg(F.countDistinct(member).alias("n")).where(F.col("n") == len(members)).select(key)


def pivot_counts(df: DataFrame, key: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts by key with one column for each value, 0 where there are none."""
    return df.groupBy(key).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values))


def ordered_categories(df: DataFrame, key: str, category: str, order: Sequence[str]) -> DataFrame:
    """``categories``: the distinct known ones of each key, in the domain's order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(category))
    found = df.where(F.col(category).isin(*order)).groupBy(key).agg(F.collect_set(F.struct(place.alias("at"), F.col(category).alias("c"))).alias("found"))
    return found.select(key, F.transform(F.array_sort("found"), lambda x: x.c).alias("categories"))


def catalog_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Entries of both catalogs, one a key; the second one's win, and of repeated ones the largest."""
    source = spare(first, "source_rank")
    both = first.withColumn(source, F.lit(0)).unionByName(second.withColumn(source, F.lit(1)))
    return last_of_each(both, [key], source).drop(source)


def fan_out(df: DataFrame, conditions: Sequence[str], path: str) -> DataFrame:
    """Every row once for each condition, its path's first folder replaced by the condition's."""
    each = df.withColumn("condition", F.explode(F.array(*map(F.lit, conditions))))
    return each.withColumn(path, F.concat(F.col("condition"), F.regexp_extract(path, r"^[^/]*(/.*)?$", 1)))


def coverage(df: DataFrame, category: str, item: str, active: str) -> DataFrame:
    """By category: active rows, and their distinct items."""
    return df.where(F.coalesce(F.col(active), F.lit(False))).groupBy(category).agg(F.count("*").alias("n"), F.countDistinct(item).alias("items"))


def attempt_counts(df: DataFrame, key: str, attempts: str) -> DataFrame:
    """By key: attempts, those that passed, those that failed, and rows that were passed through without any.

    attempts: an array of booleans; null and empty ones are a row passed through.
    """
    rows = df.select(key, F.explode_outer(attempts).alias("passed"))
    return rows.groupBy(key).agg(
        F.count("passed").alias("attempts"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("passed").isNull()).alias("passed_through")
    )


def recorded(old: Column, new: Column) -> Column:
    """A map with the entries of another set in it; null maps are empty."""
    of = lambda m: F.coalesce(m, F.expr("cast(map() as map<string, string>)"))
    return F.map_concat(F.map_filter(of(old), lambda k, _: ~F.map_contains_key(of(new), k)), of(new))


def merge_rules(existing: DataFrame, new: DataFrame, columns: Sequence[str], place: str) -> DataFrame:
    """All existing rules, then each distinct new one that isn't there, at its first ``place`` after them; nulls compare as values."""
    known = existing.select(*(F.col(c).alias(f"of_{c}") for c in columns)).distinct()
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in columns))
    added = distinct_in_order(new, columns, place).join(known, same, "left_anti")
    source = spare(existing, "is_new")
    return existing.select(*columns, place).withColumn(source, F.lit(False)).unionByName(added.select(*columns, place).withColumn(source, F.lit(True)))


def when_complete(df: DataFrame, phases: DataFrame, required: Sequence[str]) -> DataFrame:
    """df, if every required phase is ``completed`` (phases: ``phase``, ``completed``); else an error, at once and whatever df holds."""
    done = {r[0] for r in phases.where(F.col("completed") & F.col("phase").isin(*required)).select("phase").distinct().collect()}  # at most the required ones
    if open_ := [p for p in required if p not in done]:
        raise ValueError(f"phases are not complete: {', '.join(open_)}")
    return df


def selected_work(songs: DataFrame, found: DataFrame, drifted: DataFrame, song: str, track: str, expected: str) -> DataFrame:
    """Songs with work to do and the ``reason``: missing (no track is there), incomplete, or outdated (a recipe drifted).

    songs: the song and how many tracks are expected; found: the tracks that there are;
    drifted: the songs whose recorded recipe differs.
    """
    counts = found.groupBy(song).agg(F.countDistinct(track).alias("found"))
    changed = drifted.select(song).distinct().withColumn("drifted", F.lit(True))
    joined = songs.select(song, expected).join(counts, song, "left").join(changed, song, "left")
    n = F.coalesce("found", F.lit(0))
    reason = F.when((n == 0) & (F.col(expected) > 0), "missing").when(n < F.col(expected), "incomplete").when(F.col("drifted"), "outdated")
    return joined.select(song, expected, n.alias("found"), reason.alias("reason")).where("reason is not null")
