"""Manifests of rendered clips: checks of probes, lookups, payloads, replacements, suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavework.functions import arrays
from stavework.operators import routing, sampling, tables

#: The backend of a stem that the source has no record of.
DEFAULT_BACKEND = "fluidsynth"


def some(text: Column) -> Column:
    """Text without white space at its ends; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def prefix_remapped(value: Column, old: str, new: str) -> Column:
    """A path moved from one folder to another; other values stay."""
    return F.when(value.startswith(old), F.concat(F.lit(new), F.substr(value, F.lit(len(old) + 1)))).otherwise(value)


# ---- probes


def active_probes(stems: DataFrame) -> DataFrame:
    """Stems that aren't ``legacy``; null is no."""
    return stems.where(~F.coalesce("legacy", F.lit(False)))


def legacy_ids(stems: DataFrame) -> DataFrame:
    """The distinct ids of ``legacy`` stems."""
    return stems.where(F.col("legacy") & (F.coalesce("id", F.lit("")) != "")).select("id").distinct()


def probe_problems(stems: DataFrame, allowed: dict[str, Sequence[str]], target: int) -> DataFrame:
    """(``subject``, ``problem``) for every rule that a set of probe stems breaks.

    stems: ``id``, ``category``, ``song_id``, ``track``, ``gm_class``, ``legacy``; allowed:
    the program classes of each needed category. Every category has exactly ``target``
    active stems; ids are unique, and so are (song, track) of active ones, which legacy
    ones don't use; active stems are complete and of an allowed class. None is a set without problems.
    """
    live, key = active_probes(stems), F.concat_ws("/", "song_id", F.col("track").cast("string"))
    problem = lambda df, subject, text: df.select(subject.cast("string").alias("subject"), F.lit(text).alias("problem"))
    needed = stems.sparkSession.createDataFrame([(c, list(k)) for c, k in allowed.items()], "needed string, classes array<string>")
    counts = live.groupBy("category").agg(F.count("*").alias("n"))
    held = needed.join(F.broadcast(counts), F.col("needed") == F.col("category"), "left")
    several = lambda df, by: df.groupBy(by.alias("of")).agg(F.count("*").alias("n")).where("n > 1")
    whole = (some(F.col("id")).isNotNull()) & (some(F.col("category")).isNotNull()) & (some(F.col("song_id")).isNotNull()) & F.col("track").isNotNull()
    classed = live.where(whole).join(F.broadcast(needed), F.col("needed") == F.col("category"), "left")
    clash = stems.where("legacy").select(key.alias("of")).distinct().join(live.select(key.alias("of")), "of", "left_semi")
    found = [
        problem(held.where("n is null"), F.col("needed"), "missing category"),
        problem(held.where(f"n < {target}"), F.col("needed"), "too few"),
        problem(held.where(f"n > {target}"), F.col("needed"), "too many"),
        problem(several(stems.where(F.coalesce("id", F.lit("")) != ""), F.col("id")), F.col("of"), "repeated id"),
        problem(several(live.where(whole), key), F.col("of"), "repeated stem"),
        problem(clash, F.col("of"), "legacy stem in use"),
        problem(stems.where(~whole), F.coalesce("id", F.lit("?")), "incomplete"),
        problem(classed.where(~F.coalesce(F.array_contains("classes", F.col("gm_class")), F.lit(False))), F.col("id"), "class not allowed"),
    ]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def replaced_picks(stems: DataFrame, candidates: DataFrame, seed: int) -> DataFrame:
    """Each stem as it is to be used: kept, clipped again from a later start, or another one in its place.

    stems (a short list): ``position``, ``category``, ``song_id``, ``track``, ``usable``,
    ``later_start`` (of an audible clip, if there is one); candidates: ``category``,
    ``song_id``, ``track``. The n-th stem of a category that needs another one gets the
    category's n-th candidate in a seeded order. Stems of the list are no candidates, and
    no candidate is used twice; if none is left, that is an error. Returns ``position``,
    ``category``, ``song_id``, ``track``, ``clip_start`` and ``action``.
    """
    usable = F.coalesce("usable", F.lit(False))
    action = F.when(usable, "keep").when(F.col("later_start").isNotNull(), "clip").otherwise("replace")
    judged = stems.withColumn("action", action)
    kept = judged.where("action <> 'replace'").select("position", "category", "song_id", "track", F.when(F.col("action") == "clip", F.col("later_start")).alias("clip_start"), "action")
    needy = judged.where("action = 'replace'").select("position", "category", F.row_number().over(Window.partitionBy("category").orderBy("position")).alias("rank"))
    most = needy.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0]
    order = Window.partitionBy("category").orderBy(sampling.seeded_key(seed, "song_id", "track"), "song_id", "track")
    free = candidates.select("category", "song_id", "track").distinct().join(stems.select("song_id", "track").distinct(), ["song_id", "track"], "left_anti")
    ranked = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)  # a limit that is pushed below the sort
    joined = needy.join(ranked, ["category", "rank"], "left")
    say = F.raise_error(F.concat(F.lit("no replacement left for "), "category"))
    song = F.when(F.col("song_id").isNotNull(), F.col("song_id")).otherwise(say.cast("string"))
    return kept.unionByName(joined.select("position", "category", song.alias("song_id"), "track", F.lit(None).cast(dict(stems.dtypes)["later_start"]).alias("clip_start"), F.lit("replace").alias("action")))


def mixture_trials(songs: DataFrame, mixtures: DataFrame, conditions: Sequence[str], n: int, seed: int) -> DataFrame:
    """n songs with a mixture of every condition and an audible reference, in a seeded order; fewer are an error.

    songs: ``song_id``, ``audible``; mixtures: ``song_id``, ``condition``. Returns ``id``
    (``mix_01`` and on) and ``song_id``.
    """
    whole = tables.has_all(mixtures, "song_id", "condition", conditions)
    fit = songs.where("audible").select("song_id").distinct().join(whole, "song_id", "left_semi")
    turn = sampling.seeded_key(seed, "song_id")
    picked = sampling.sample_rows(fit, n, seed, "song_id").agg(F.array_sort(F.collect_list(F.struct(turn.alias("turn"), "song_id"))).alias("picks"))
    say = F.raise_error(F.concat(F.lit(f"{n} trials needed, there are "), F.size("picks").cast("string")))
    checked = picked.select(F.when(F.size("picks") >= n, F.col("picks")).otherwise(say.cast(dict(picked.dtypes)["picks"])).alias("picks"))
    rows = checked.select(F.posexplode("picks").alias("at", "pick"))
    return rows.select(F.format_string("mix_%02d", F.col("at") + 1).alias("id"), "pick.song_id")


# ---- joins


def manifest_clips(manifest: DataFrame, clips: DataFrame) -> DataFrame:
    """Every clip of every manifest row's stem, with the ``clip_path`` below the variant's folder.

    manifest: ``variant_id``, ``stem_id``; clips: ``stem_id``, ``index``. Rows without a clip go.
    """
    name = F.format_string("%s/%s_clip%02d", "variant_id", "stem_id", "index")
    return tables.inner_join(manifest, clips, ["stem_id"], ("", "_clip")).withColumn("clip_path", name)


def synced_sidecar(stems: DataFrame, source: DataFrame, recipe: DataFrame, source_root: str, root: str, *order: str) -> DataFrame:
    """The recipe sidecar of copied stems, by the present recipe and the source's record of each.

    stems: ``path`` (below root), ``track``, ``name``, ``program``, ``is_drum``; source:
    ``path`` (below source_root), ``track``, ``category``, ``backend``, of repeated keys the
    last by ``order``; recipe: ``category``, ``ablation``, ``method``, ``fallback``,
    ``realify``. A stem without a recorded category gets that of its name and program,
    one without a backend the default.
    """
    was = tables.last_of_each(source, ["path", "track"], *order).select(F.col("path").alias("source_path"), "track", F.col("category").alias("was"), F.col("backend").alias("by"))
    joined = stems.withColumn("source_path", prefix_remapped(F.col("path"), root, source_root)).join(was, ["source_path", "track"], "left")
    category = F.coalesce(some(F.col("was")), routing.category(F.col("name"), F.col("program"), F.col("is_drum")))
    named = joined.select("path", "track", category.alias("category"), F.coalesce(some(F.col("by")), F.lit(DEFAULT_BACKEND)).alias("backend"))
    return named.join(recipe, "category", "left").select("path", "track", "category", "ablation", "method", "fallback", "backend", F.coalesce("realify", F.lit(False)).alias("realify"))


def stem_metadata(rows: DataFrame, stems: DataFrame, *order: str) -> DataFrame:
    """rows with ``track_name``, ``program`` and ``is_drum`` of their (song_id, track): no name, 0 and false where unknown.

    Of stems with the same key the last by ``order`` counts; blank names are none.
    """
    last = tables.last_of_each(stems.select("song_id", "track", "name", "program", "is_drum", *(c for c in order if c not in ("song_id", "track", "name", "program", "is_drum"))), ["song_id", "track"], *order)
    known = last.select("song_id", "track", some(F.col("name")).alias("track_name"), "program", "is_drum")
    return tables.filled(rows.join(known, ["song_id", "track"], "left"), {"program": 0, "is_drum": False})


def song_details(songs: DataFrame, stems: DataFrame, cells: DataFrame) -> DataFrame:
    """A row for each song with its stems by track, each with its conditions in order.

    songs: ``song_id``, ``title``; stems: ``song_id``, ``track``, ``name``; cells:
    ``song_id``, ``track``, ``place``, ``condition``, ``path``, ``caption``, one a
    condition. A song has tens of stems and a stem a few conditions, so rows stay small.
    """
    held = F.array_sort(F.collect_list(F.struct("place", "condition", "path", "caption")))
    of = cells.groupBy("song_id", "track").agg(held.alias("conditions"))
    rows = stems.join(of, ["song_id", "track"], "left").groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("track", "name", "conditions"))).alias("stems"))
    return songs.join(rows, "song_id", "left")


# ---- payloads


def stem_list(manifest: DataFrame, probes: DataFrame, place: str) -> DataFrame:
    """Each stem of a manifest by its first row: ``stem_id``, ``category``, ``song_id``, ``track``, ``note``, sorted by category and id.

    probes: ``id``, ``category``, ``note``, one an id; their category stands in for a missing one.
    """
    first = manifest.groupBy("stem_id").agg(F.min_by(F.struct("category", "song_id", "track"), place).alias("r")).select("stem_id", "r.*")
    probe = probes.select(F.col("id").alias("stem_id"), F.col("category").alias("own"), "note")
    rows = first.join(probe, "stem_id", "left").select("stem_id", F.coalesce("category", "own").alias("category"), "song_id", "track", "note")
    return rows.orderBy(F.coalesce("category", F.lit("")), "stem_id")


def stem_tests(manifest: DataFrame, seed: int) -> DataFrame:
    """``samples`` of each stem in blinded order: their label, variant and path. manifest: ``stem_id``, ``variant_id``, ``out_path``.

    Of repeated variants of a stem the largest path is shown.
    """
    one = manifest.groupBy("stem_id", "variant_id").agg(F.max("out_path").alias("out_path"))
    shown = sampling.blinded(one, "stem_id", "variant_id", seed)
    cells = F.array_sort(F.collect_list(F.struct("position", F.col("label").alias("blind_label"), "variant_id", "out_path")))
    return shown.groupBy("stem_id").agg(cells.alias("s")).select("stem_id", F.transform("s", lambda s: s.dropFields("position")).alias("samples"))


def verification_meta(stats: DataFrame, eligible: DataFrame, winners: DataFrame, configs: DataFrame) -> DataFrame:
    """By category: ``auto_winner_variant_id`` and ``variants``, the most realistic first, then by content and id.

    stats: ``category``, ``variant_id``, ``mean_content``, ``mean_realism``, ``min_content``,
    ``n_stems``, one a variant; eligible: ``category``, ``variant_id``; winners the same,
    one a category; configs: ``variant_id`` and ``config`` (a map; of repeated ones any is the
    same). Means are rounded to two decimals, written halves up. Rows without a category go.
    """
    passed = eligible.select("category", "variant_id").distinct().withColumn("passed", F.lit(True))
    won = winners.select("category", F.col("variant_id").alias("auto_winner_variant_id"))
    config = configs.groupBy("variant_id").agg(F.any_value("config").alias("config"))
    rows = stats.where("category is not null").join(passed, ["category", "variant_id"], "left").join(config, "variant_id", "left").join(won, "category", "left")
    order = [(-F.col("mean_realism")).alias("by_realism"), (-F.col("mean_content")).alias("by_content")]
    two = lambda c: F.round(F.col(c).cast("decimal(28,9)"), 2).cast("double").alias(c)
    entry = F.struct(
        *order, "variant_id", F.coalesce("passed", F.lit(False)).alias("passed_filter"),
        F.coalesce(F.col("auto_winner_variant_id") == F.col("variant_id"), F.lit(False)).alias("is_auto_winner"),
        F.struct(two("mean_content"), two("mean_realism"), two("min_content"), "n_stems").alias("stats"), "config",
    )
    listed = rows.groupBy("category", "auto_winner_variant_id").agg(F.collect_list(entry).alias("v"))
    earlier = lambda a, b: (  # noqa: E731  (maps can't be compared, so array_sort needs the keys)
        F.when(a.by_realism != b.by_realism, F.signum(a.by_realism - b.by_realism)).when(a.by_content != b.by_content, F.signum(a.by_content - b.by_content))
        .when(a.variant_id < b.variant_id, -1).when(a.variant_id > b.variant_id, 1).otherwise(0).cast("int")
    )
    return listed.select("category", "auto_winner_variant_id", F.transform(F.array_sort("v", earlier), lambda v: v.dropFields("by_realism", "by_content")).alias("variants"))


def suggestions(winners: DataFrame, manifest: DataFrame, place: str, fields: Sequence[str], joiner: str = "\n") -> DataFrame:
    """``suggestion`` of each winning (category, variant_id): the fields of the variant's first manifest row as text.

    Fields that are null or empty are left out. A winner that the manifest doesn't have goes.
    """
    first = manifest.groupBy("variant_id").agg(F.min_by(F.struct(*fields), place).alias("row"))
    cell = lambda f: F.col(f"row.{f}").cast("string")
    lines = F.array_compact(F.array(*(F.when(cell(f) != "", F.concat(F.lit(f"{f}: "), cell(f))) for f in fields)))
    return winners.join(first, "variant_id").select("category", "variant_id", F.array_join(lines, joiner).alias("suggestion"))


def scored_manifest(manifest: DataFrame, onsets: DataFrame, candidates: Sequence[Column], tolerance: float, threshold: float) -> DataFrame:
    """Manifest rows that have an output, with the agreement of its onsets with the first reference that exists.

    manifest: ``out_path``, one a row; onsets: ``path``, ``onsets`` of each file that there
    is; candidates: paths that may be a row's reference, in order. No reference is an error.
    """
    known = onsets.withColumn("reference", F.struct("path", "onsets"))
    found = tables.first_key_lookup(manifest, known, "out_path", candidates, "path", "reference")
    made = onsets.select(F.col("path").alias("out_path"), F.col("onsets").alias("rendered"))
    rows = manifest.join(made, "out_path").join(found, "out_path")
    say = F.raise_error(F.concat(F.lit("no reference for "), "out_path"))
    path = F.when(F.col("reference").isNotNull(), F.col("reference.path")).otherwise(say.cast("string"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    matched = rows.withColumns({"reference_path": path, "matched": arrays.matched_onsets(F.col("reference.onsets"), F.col("rendered"), tolerance), "n_reference": size("reference.onsets"), "n_rendered": size("rendered")})
    scored = matched.withColumns({"score": arrays.f1(F.col("matched"), F.col("n_reference"), F.col("n_rendered")), "extra": F.col("n_rendered") - F.col("matched"), "missing": F.col("n_reference") - F.col("matched")})
    return scored.withColumn("passed", F.col("score") >= threshold).drop("reference", "rendered")


# ---- work


def batch_order(tasks: DataFrame, *keys: str) -> DataFrame:
    """Tasks in ranges of the keys, sorted inside, so that equal settings lie together; a null length or text comes first as 0 or nothing."""
    kinds = dict(tasks.dtypes)
    plain = [F.coalesce(F.col(k), F.lit("" if kinds[k] == "string" else 0).cast(kinds[k])) for k in keys]
    return tasks.repartitionByRange(*plain).sortWithinPartitions(*plain)


def backoff_levels(start: Column, step: float, floor: float, most: int) -> Column:
    """The levels that are tried in turn: the start, then each a step lower while not below the floor, at most so many."""
    tries = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(start - i * F.lit(step), 6))
    return F.filter(tries, lambda level, i: (i == 0) | (level >= floor - 1e-9))


def backed_off(tasks: DataFrame, results: DataFrame, key: str, step: float, floor: float, most: int) -> DataFrame:
    """What became of each task: the level of the first attempt that passed, or the reference.

    tasks: the key and ``start``; results: the key, ``level``, ``passed``. Attempts after one
    that passed don't count. Returns the key, ``attempts`` (tried until then), ``level`` and
    ``outcome``: passed, reference (all levels failed) or open (some are yet to be tried).
    """
    due = tasks.select(key, F.posexplode(backoff_levels(F.col("start"), step, floor, most)).alias("turn", "level"))
    tried = results.groupBy(key, F.bround("level", 6).alias("level")).agg(F.bool_or(F.coalesce("passed", F.lit(False))).alias("passed"))
    by = due.join(tried, [key, "level"], "left").groupBy(key).agg(
        F.min(F.when(F.col("passed"), F.struct("turn", "level"))).alias("hit"), F.count("passed").alias("n_tried"), F.count("*").alias("n_due")
    )
    outcome = F.when(F.col("hit").isNotNull(), "passed").when(F.col("n_tried") == F.col("n_due"), "reference").otherwise("open")
    return by.select(key, F.coalesce(F.col("hit.turn") + 1, "n_tried").cast("long").alias("attempts"), F.col("hit.level").alias("level"), outcome.alias("outcome"))


def partial_update(df: DataFrame, updates: DataFrame, keys: Sequence[str], column: str, *order: str) -> DataFrame:
    """df with one column set where updates have the key, to null too; of repeated ones the last by ``order``.

    A column that df doesn't have begins as null.
    """
    kind = dict(updates.dtypes)[column]
    base = df if column in df.columns else df.withColumn(column, F.lit(None).cast(kind))
    found = tables.spare(base, f"new_{column}")
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(F.col(column).alias("v")), F.struct(*order)).alias(found))
    value = F.when(F.col(found).isNotNull(), F.col(f"{found}.v")).otherwise(F.col(column))
    return base.join(last, list(keys), "left").withColumn(column, value).select(base.columns)
