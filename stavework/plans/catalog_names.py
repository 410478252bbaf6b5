"""Named queries of name correction and routing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.functions import names, programs
from stavework.operators import correction, routing
from stavework.plans.registry import named
from stavework.sources.tables import table

#: Track names of every kind; a part gets one by its key.
TRACKS = (
    "Harpsichord", "Piano", "Soprano", "Alto Sax", "bass", "Track 3", " ", "Ténor", "Flöte", "chor", "Contrabass", "String section", "Staff-2", "77",
    "MusicXML Part", "violin, solo", "Grand Piano", "Electric Piano", "Trumpet in B", "Muted trumpet", "English Horn", "lute", "absolute", "Choir Aahs", "oboe/sax",
    "Baritone Sax", "Voice", "organ pedal", "recorder", "cello", "fiddle", "kazoo", "brass", "Guitar 1", "piano guitar", "Tuba", "Score", "steel drums",
)
ALIASES = (("harpsichord", 6), ("soprano", 52), ("tenor", 52), ("chor", 52), ("flote", 73), ("solo", 40), ("sax", 65), ("oboe", 68), ("alto sax", 65), ("tuba", 58), ("pedal", 19))
FAMILIES = (("brass", 61, "brass"), ("string", 48, "ensemble"), ("voice", 52, "ensemble"), ("guitar", 24, "guitar"), ("strings", 48, "ensemble"), ("organ", 16, "organ"))
GENERIC = ("score", "untitled")
RECIPE = (
    ("piano", "midi-ddsp", "basic", False), ("organ", "basic", "basic", True), ("mallet", "slakh", "slakh", False), ("voice", "slakh", "slakh", True), ("strings", "midi-ddsp", "slakh", True),
    ("guitar", "basic", "basic", False), ("brass", "midi-ddsp", "basic", True), ("wind", "midi-ddsp", "basic", False), ("drums", "slakh", "slakh", False), ("polyphonic", "basic", None, None),
)


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.get(programs.strings(TRACKS), (key % len(TRACKS)).cast("int"))
    return table(spark, d, "part").select(
        key.alias("track"),
        F.when(key % 41 != 0, name).alias("name"),
        (key * 7 % 130).cast("int").alias("program"),
        (key % 17 == 0).alias("is_drum"),
        (key % 5).alias("notes"),
        (key % 3 != 0).alias("monophonic"),
    )


_list = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
_TRACKS_SQL = f"""
t AS (SELECT p_partkey AS track, CASE WHEN p_partkey % 41 <> 0 THEN ({_list(TRACKS)})[(p_partkey % {len(TRACKS)})::INT + 1] END AS name,
  (p_partkey * 7 % 130)::INT AS program, p_partkey % 17 = 0 AS is_drum, p_partkey % 5 AS notes, p_partkey % 3 <> 0 AS monophonic FROM part)
"""
_LABELS_SQL = f"labels AS (SELECT range::INT AS program, ({_list(programs.PROGRAM_NAMES)})[range + 1] AS label FROM range(128))"
_values = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in rows)
_IN = lambda needle, name: f"CASE WHEN length({needle}) < 5 THEN regexp_matches({name}, '(^|[^a-z0-9])' || {needle} || '([^a-z0-9]|$)') ELSE contains({name}, {needle}) END"
_tier = lambda name, needles: f"""
{name}_hits AS (SELECT p.name, needle, program, max(length(needle)) OVER (PARTITION BY p.name) AS longest FROM plain p JOIN {needles} ON {_IN('needle', 'p.name')}),
{name} AS (SELECT name, min(needle) AS needle, arg_min(program, (needle, program)) AS program, count(DISTINCT program) > 1 AS ambiguous FROM {name}_hits WHERE length(needle) = longest GROUP BY 1)
"""  # noqa: E731
_CORRECTION_SQL = f"""
{_TRACKS_SQL}, {_LABELS_SQL}, p0 AS (SELECT *, lower(strip_accents(coalesce(trim(regexp_replace(translate(name, ',', ' '), '\\s+', ' ', 'g')), ''))) AS plain FROM t),
plain AS (SELECT DISTINCT plain AS name FROM p0 WHERE plain <> ''),
aliases(needle, program) AS (VALUES {_values(ALIASES)}), families(needle, program, class) AS (VALUES {_values(FAMILIES)}),
low AS (SELECT program, lower(label) AS label, trim(regexp_replace(translate(lower(label), '()+,/', '     '), '\\s+', ' ', 'g')) AS clean FROM labels),
words AS (SELECT program, unnest(string_split(clean, ' ')) AS w FROM low),
telling AS (SELECT DISTINCT program, w FROM words WHERE length(w) >= 4 AND w NOT IN ('music', 'lead', 'synth', 'square', 'warm')),
label_needles AS (SELECT w AS needle, min(program) AS program FROM (SELECT program, w FROM telling UNION SELECT program, clean FROM low WHERE length(clean) >= 4) GROUP BY 1 HAVING count(DISTINCT program) = 1),
{_tier('a', 'aliases')}, {_tier('f', 'families')}, {_tier('l', 'label_needles')},
fits AS (SELECT p.plain AS name, p.program, bool_or(contains(p.plain, l.label) OR contains(l.label, p.plain) OR coalesce({_IN('w.w', 'p.plain')}, false)) AS fits
  FROM (SELECT DISTINCT plain, program FROM p0) p JOIN low l ON l.program = p.program LEFT JOIN telling w ON w.program = p.program GROUP BY ALL),
j AS (SELECT p0.*, a.needle AS an, a.program AS ap, a.ambiguous AS aa, f.needle AS fn, f.program AS fp, f.ambiguous AS fa, fam.class AS fc, l.needle AS ln, l.program AS lp, l.ambiguous AS la,
  coalesce(fits.fits, contains('unknown program ' || p0.program, p0.plain)) AS fits,
  CASE WHEN p0.program BETWEEN 16 AND 23 THEN 'organ' WHEN p0.program BETWEEN 24 AND 31 THEN 'guitar' WHEN p0.program BETWEEN 48 AND 55 THEN 'ensemble' WHEN p0.program BETWEEN 56 AND 63 THEN 'brass' END AS class
  FROM p0 LEFT JOIN a ON a.name = plain LEFT JOIN f ON f.name = plain LEFT JOIN families fam ON fam.needle = f.needle LEFT JOIN l ON l.name = plain
  LEFT JOIN fits ON fits.name = plain AND fits.program = p0.program),
s AS (SELECT *, CASE WHEN is_drum THEN 'skipped_drum' WHEN plain = '' THEN 'skipped_unnamed'
    WHEN plain IN ('score', 'untitled') OR regexp_full_match(plain, '(track|part|staff|channel)[\\s_-]*[0-9]+') OR regexp_full_match(plain, '[0-9]+') OR contains(plain, 'musicxml') THEN 'skipped_generic'
    WHEN fits THEN 'keep' WHEN an IS NOT NULL THEN CASE WHEN aa THEN 'skipped_ambiguous' WHEN ap = program THEN 'keep' ELSE 'corrected' END
    WHEN fn IS NOT NULL THEN CASE WHEN fa THEN 'skipped_ambiguous' WHEN fp = program OR coalesce(fc = class, false) THEN 'keep' ELSE 'corrected' END
    WHEN ln IS NOT NULL THEN CASE WHEN la THEN 'skipped_ambiguous' WHEN lp = program THEN 'keep' ELSE 'corrected' END ELSE 'skipped_no_match' END AS status,
  NOT is_drum AND plain <> '' AND NOT fits AND NOT (plain IN ('score', 'untitled') OR regexp_full_match(plain, '(track|part|staff|channel)[\\s_-]*[0-9]+') OR regexp_full_match(plain, '[0-9]+') OR contains(plain, 'musicxml')) AS matched FROM j),
r AS (SELECT track, is_drum, program AS program_original, CASE WHEN status = 'corrected' THEN coalesce(ap, fp, lp) ELSE program END AS program_corrected, status,
  CASE WHEN matched THEN coalesce(an, fn, ln) END AS match_key FROM s)
"""


def _register(spark: SparkSession, d: str) -> DataFrame:
    tracks = _tracks(spark, d)
    done = correction.corrected(F.col("name"), F.col("program"), F.col("is_drum"), ALIASES, FAMILIES, GENERIC)
    out = tracks.select("track", "is_drum", F.col("program").alias("program_original"), done.alias("done"))
    return out.select("track", "is_drum", "program_original", F.col("done.program").alias("program_corrected"), "done.status", "done.match_key")


@named(f"WITH {_CORRECTION_SQL} SELECT * FROM r")
def name_correction(spark: SparkSession, d: str) -> DataFrame:
    return _register(spark, d)


@named(f"""
WITH {_CORRECTION_SQL}, c AS (SELECT count(*) AS n_tracks, count(*) FILTER (status = 'corrected') AS n_corrected,
  count(*) FILTER (NOT is_drum AND status NOT IN ('skipped_unnamed', 'skipped_generic')) AS n_eligible,
  count(*) FILTER (NOT is_drum AND status = 'corrected') AS n_corrected_eligible, count(*) FILTER (status <> 'corrected') AS n_fine FROM r)
SELECT *, round(100.0 * n_corrected / n_tracks, 2)::DOUBLE AS pct_corrected, round(100.0 * n_fine / n_tracks, 2)::DOUBLE AS pct_fine,
  round(100.0 * n_corrected_eligible / n_eligible, 2)::DOUBLE AS pct_corrected_eligible FROM c
""")
def register_summary(spark: SparkSession, d: str) -> DataFrame:
    return correction.register_summary(_register(spark, d))


@named(f"""
WITH {_CORRECTION_SQL}, c AS (SELECT program_original, program_corrected, count(*) AS count FROM r WHERE status = 'corrected' GROUP BY ALL)
SELECT c.*, round(100.0 * count / (SELECT sum(count) FROM c), 2)::DOUBLE AS share, program_original || ' ' || coalesce(o.label, 'Unknown program ' || program_original) || ' → '
  || program_corrected || ' ' || coalesce(n.label, 'Unknown program ' || program_corrected) AS label
FROM c LEFT JOIN labels o ON o.program = program_original LEFT JOIN labels n ON n.program = program_corrected ORDER BY count DESC, program_original, program_corrected LIMIT 12
""")
def top_corrections(spark: SparkSession, d: str) -> DataFrame:
    return correction.top_corrections(_register(spark, d), 12)


@named(f"""
WITH {_TRACKS_SQL}, {_LABELS_SQL}, u AS (SELECT track, CASE WHEN track % 50 = 0 THEN 128 ELSE program END AS program, name, is_drum FROM t)
SELECT track, CASE WHEN u.program = 128 THEN '128: Drums (channel 10)' ELSE u.program || ': ' || coalesce(label, 'Unknown') END AS label,
  CASE WHEN u.program = 128 THEN 'Drums' ELSE coalesce(label, 'Unknown program ' || u.program) || ' (' || u.program || ')' END AS short,
  CASE WHEN is_drum THEN 'drums' WHEN coalesce(trim(name), '') <> '' THEN lower(trim(name)) ELSE 'midi program ' || u.program END AS instrument
FROM u LEFT JOIN labels l ON l.program = u.program
""")
def program_labels(spark: SparkSession, d: str) -> DataFrame:
    program = F.when(F.col("track") % 50 == 0, programs.DRUMS).otherwise(F.col("program"))
    return _tracks(spark, d).select(
        "track", programs.program_label(program).alias("label"), programs.short_label(program).alias("short"), programs.instrument(program, F.col("is_drum"), F.col("name")).alias("instrument")
    )


@named(f"""
WITH {_TRACKS_SQL}, f AS (SELECT track, unnest([('genre', CASE WHEN track % 2 = 0 THEN 'folk' END), ('title', name), ('notes', notes::VARCHAR)]) AS kv FROM t),
c AS (SELECT track, string_agg(kv[1] || ': ' || kv[2], ', ' ORDER BY md5(track || '|' || kv[1])) AS fields FROM f WHERE kv[2] IS NOT NULL GROUP BY 1)
SELECT t.track, concat_ws('. ', 'Realistic', c.fields, 'format: solo | instruments: ' || CASE WHEN is_drum THEN 'drums' WHEN coalesce(trim(name), '') <> '' THEN lower(trim(name)) ELSE 'midi program ' || program END) AS caption
FROM t LEFT JOIN c USING (track)
""")
def caption_assembly(spark: SparkSession, d: str) -> DataFrame:
    fields = {"genre": F.when(F.col("track") % 2 == 0, "folk"), "title": F.col("name"), "notes": F.col("notes")}
    text = programs.caption("Realistic", fields, F.col("program"), F.col("is_drum"), F.col("name"), F.col("track").cast("string"))
    return _tracks(spark, d).select("track", text.alias("caption"))


_any = lambda name, words: "(" + " OR ".join(f"contains({name}, '{w}')" for w in words) + ")"
_CATEGORY_SQL = "CASE WHEN is_drum THEN 'drums' " + " ".join(f"WHEN {_any('low', words)} THEN '{c}'" for c, words in routing.CATEGORY_WORDS) + """
  WHEN program < 8 THEN 'piano' WHEN program BETWEEN 24 AND 31 THEN 'guitar' WHEN program BETWEEN 56 AND 63 THEN 'brass' WHEN program BETWEEN 64 AND 79 THEN 'wind'
  WHEN program BETWEEN 40 AND 47 THEN 'strings' WHEN program BETWEEN 8 AND 15 THEN 'mallet' WHEN program BETWEEN 16 AND 23 THEN 'organ' WHEN program BETWEEN 48 AND 55 THEN 'voice'
  ELSE 'polyphonic' END"""
_BY_NAME = f"CASE WHEN {_any('low', routing.NOT_INSTRUMENTS)} THEN NULL " + " ".join(
    f"WHEN {_any('low', words)} THEN {'CASE WHEN program <> 59 THEN ' if i == 'trumpet' else ''}'{i}'{' END' if i == 'trumpet' else ''}" for i, words in routing.INSTRUMENT_WORDS
) + " END"
_ROUTE_SQL = f"""
{_TRACKS_SQL}, n AS (SELECT *, lower(trim(coalesce(name, ''))) AS low FROM t),
i AS (SELECT *, {_CATEGORY_SQL} AS category, coalesce({_BY_NAME}, CASE WHEN program BETWEEN 64 AND 67 THEN 'saxophone' ELSE
    (SELECT k FROM (VALUES {_values(routing.INSTRUMENT_PROGRAMS)}) x(k, p) WHERE p = program) END) AS ins,
  {_any('low', routing.VOICES)} OR (program NOT BETWEEN 64 AND 67 AND ((  {_any('low', routing.VOICE_PARTS)} AND NOT {_any('low', routing.NOT_VOICE_PARTS)}) OR program BETWEEN 52 AND 54)) AS voice,
  NOT {_any('low', routing.NOT_PIANOS)} AND (program IN (0, 1, 3) OR (contains(low, 'piano') AND NOT contains(low, 'guitar') AND program >= 8)) AS pno FROM n),
why AS (SELECT *, CASE WHEN is_drum THEN 'soundfont_drum' WHEN empty AND notes = 0 THEN 'empty_track' WHEN voice THEN 'soundfont_vocal' WHEN pno THEN 'piano'
  WHEN regexp_matches(low, 'guitar|gitar|\\blute\\b|\\bluit\\b') THEN 'soundfont_guitar' WHEN program BETWEEN 32 AND 39 THEN 'soundfont_bass_guitar' WHEN program BETWEEN 24 AND 31 THEN 'soundfont_guitar'
  WHEN ins IS NULL THEN 'soundfont_unsupported' WHEN empty AND NOT monophonic THEN 'soundfont_polyphonic' ELSE 'midi_ddsp_eligible' END AS reason
  FROM i, (VALUES (true), (false)) heard(empty)),
routed AS (SELECT *, CASE reason WHEN 'piano' THEN 'ddsp_piano' WHEN 'midi_ddsp_eligible' THEN 'midi_ddsp' ELSE 'soundfont' END AS backend,
  CASE WHEN reason = 'piano' THEN 'piano' WHEN reason IN ('midi_ddsp_eligible', 'soundfont_polyphonic') THEN ins END AS instrument FROM why)
"""


def _routed(spark: SparkSession, d: str) -> DataFrame:
    tracks = _tracks(spark, d)
    route = routing.route(*(F.col(c) for c in ("name", "program", "is_drum", "notes", "monophonic")))
    return tracks.select("*", route.alias("route")).select("track", "notes", "route.*")


@named(f"WITH {_ROUTE_SQL} SELECT track, notes, backend, instrument, reason FROM routed WHERE empty")
def route_with_reason(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d)


@named(f"""
WITH {_ROUTE_SQL}, s AS (SELECT backend, reason, count(*) AS tracks, sum(notes)::BIGINT AS notes FROM routed WHERE empty GROUP BY ALL)
SELECT *, round(100.0 * tracks / (SELECT sum(tracks) FROM s), 4)::DOUBLE AS track_share, round(100.0 * notes / (SELECT sum(notes) FROM s), 4)::DOUBLE AS note_share FROM s
""")
def backend_shares(spark: SparkSession, d: str) -> DataFrame:
    return routing.backend_shares(_routed(spark, d), "notes")


@named(f"WITH {_ROUTE_SQL}, p AS (VALUES {_values(routing.EQUIVALENT)}) SELECT track, p.col0 AS duplicate, p.col1 AS donor FROM routed, p WHERE empty AND backend = 'soundfont'")
def donor_equivalences(spark: SparkSession, d: str) -> DataFrame:
    return routing.equivalences(_routed(spark, d), "track")


@named(f"WITH {_ROUTE_SQL} SELECT track, category FROM i")
def probe_category(spark: SparkSession, d: str) -> DataFrame:
    return _tracks(spark, d).select("track", routing.category(F.col("name"), F.col("program"), F.col("is_drum")).alias("category"))


def _recipe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RECIPE, "category string, method string, fallback string, realify boolean")


@named(f"""
WITH {_ROUTE_SQL}, recipe(category, method, fallback, realify) AS (VALUES {_values(RECIPE)})
SELECT h.track, h.category, r.method, coalesce(r.realify, false) AS realify, r.method = 'slakh' OR coalesce(r.fallback = 'slakh', false) AS use_slakh,
  CASE WHEN r.method <> 'midi-ddsp' THEN 'category_soundfont' ELSE h.reason END AS reason,
  CASE WHEN r.method = 'midi-ddsp' AND h.backend <> 'soundfont' THEN h.backend ELSE 'fluidsynth' END AS backend,
  CASE WHEN r.method = 'midi-ddsp' AND u.backend <> 'soundfont' THEN u.backend ELSE 'fluidsynth' END AS pass
FROM routed h JOIN routed u ON u.track = h.track AND h.empty AND NOT u.empty JOIN recipe r ON r.category = h.category
""")
def recipe_plan(spark: SparkSession, d: str) -> DataFrame:
    planned = routing.plan(_tracks(spark, d), _recipe(spark))
    return planned.select("track", "category", "method", F.coalesce("realify", F.lit(False)).alias("realify"), "use_slakh", "route.reason", "backend", "pass")


_RECIPES_SQL = """
r AS (SELECT l_suppkey % 97 AS recipe, ['piano', 'drums', 'bass', 'strings', 'wind', 'voice', 'organ'][l_linenumber] AS category,
  CASE WHEN l_suppkey % 3 = 0 AND l_returnflag = 'A' THEN 'midi-ddsp' WHEN l_returnflag = 'N' THEN 'slakh' WHEN l_returnflag = 'R' THEN 'basic' END AS method,
  CASE WHEN l_suppkey % 5 = 0 THEN l_linestatus = 'F' END AS realify FROM lineitem)
"""


def _recipes(spark: SparkSession, d: str) -> DataFrame:
    """Recipes by a supplier's number, a category for each line."""
    lines, flag = table(spark, d, "lineitem"), F.col("l_returnflag")
    names_of = F.array(*map(F.lit, ("piano", "drums", "bass", "strings", "wind", "voice", "organ")))
    method = F.when((F.col("l_suppkey") % 3 == 0) & (flag == "A"), "midi-ddsp").when(flag == "N", "slakh").when(flag == "R", "basic")
    return lines.select((F.col("l_suppkey") % 97).alias("recipe"), F.get(names_of, F.col("l_linenumber") - 1).alias("category"), method.alias("method"), F.when(F.col("l_suppkey") % 5 == 0, F.col("l_linestatus") == "F").alias("realify"))


@named(f"""
WITH {_RECIPES_SQL}, p AS (SELECT recipe, category, CASE WHEN method = 'midi-ddsp' THEN 'ddsp' ELSE 'fluidsynth' END AS pass FROM r WHERE method IS NOT NULL
  UNION SELECT recipe, category, 'realify' FROM r WHERE realify)
SELECT recipe, pass, string_agg(category, ',' ORDER BY category) AS categories FROM p WHERE category IS NOT NULL GROUP BY ALL
""")
def recipe_passes(spark: SparkSession, d: str) -> DataFrame:
    return routing.passes(_recipes(spark, d), "recipe").select("recipe", "pass", F.array_join("categories", ",").alias("categories"))


@named(f"""
WITH {_RECIPES_SQL}, u AS (SELECT recipe, bool_or(method = 'midi-ddsp' AND category = 'piano') AS piano, bool_or(method = 'midi-ddsp') AS neural, bool_or(realify) AS real FROM r GROUP BY 1)
SELECT recipe, concat_ws(',', 'layout', 'fluidsynth', CASE WHEN piano THEN 'ddsp_piano' END, CASE WHEN neural THEN 'midi_ddsp' END, CASE WHEN real THEN 'realify' END, 'mix') AS passes FROM u
""")
def recipe_sequence(spark: SparkSession, d: str) -> DataFrame:
    return routing.pass_sequence(_recipes(spark, d), "recipe").select("recipe", F.array_join("passes", ",").alias("passes"))


@named(f"""
WITH {_TRACKS_SQL}, i AS (SELECT track, CASE WHEN is_drum THEN 'drums' WHEN coalesce(trim(name), '') <> '' THEN lower(trim(name)) ELSE 'midi program ' || program END AS own FROM t)
SELECT track, 'solo ' || own || ', realistic studio recording, expressive performance' AS minimal,
  '{programs.PRESERVATION} Realistic recorded ' || own || '.. format: solo | instruments: ' || own AS preservation,
  '{programs.ADHERENCE}. format: solo | instruments: ' || own AS adherence, '{programs.CURRENT}' AS current FROM i
""")
def caption_forms(spark: SparkSession, d: str) -> DataFrame:
    args = {}, F.col("program"), F.col("is_drum"), F.col("name"), F.lit("s")
    return _tracks(spark, d).select("track", *(programs.caption_in_form(f, *args, hint=f != "current").alias(f) for f in programs.FORMS))


@named(r"""
SELECT p_partkey, p_size, 'noise' || CASE WHEN p_size % 100 = 0 THEN (p_size / 100)::INT::VARCHAR ELSE regexp_replace(printf('%.2f', p_size / 100.0), '0+$', '') END AS id, p_size / 100.0::DOUBLE AS level,
  (p_size / 100.0)::DECIMAL(10,2)::DOUBLE AS back FROM part
""")
def level_ids(spark: SparkSession, d: str) -> DataFrame:
    level = F.col("p_size") / 100.0
    made = names.level_id(level, "noise")
    return table(spark, d, "part").select("p_partkey", "p_size", made.alias("id"), level.alias("level"), names.level_of(made, "noise").alias("back"))


@named(r"""
SELECT page_id, CASE WHEN s = '' THEN 'anonymous' ELSE s END AS safe, list_transform(list_filter(string_split(cell, '-'), lambda x: trim(x) <> ''), lambda x: x::INT) AS numbers,
  CASE WHEN page_id % 3 = 0 THEN page_id::INT END AS stem FROM (
  SELECT page_id, regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s, page_id || '-' || page_id % 7 || '- -3' AS cell FROM pages)
""")
def id_functions(spark: SparkSession, d: str) -> DataFrame:
    page = F.col("page_id").cast("string")
    cell = F.concat(page, F.lit("-"), (F.col("page_id") % 7).cast("string"), F.lit("- -3"))
    file = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("stem_"), page, F.lit(".flac"))).otherwise(F.concat(page, F.lit("x.flac")))
    return table(spark, d, "pages").select("page_id", names.safe_id(F.col("url")).alias("safe"), names.int_list(cell).alias("numbers"), names.stem_index(file).alias("stem"))
