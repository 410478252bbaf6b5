"""Which renderer takes a track: categories by name and class, routes with reasons, plans.

Decisions are single CASE columns over name, program and drum flag.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavework.functions.names import is_plucked, stripped
from stavework.operators.rules import program_class

# What backends are called; so are the reasons that ``route`` gives.
SOUNDFONT, PIANO, NEURAL = "soundfont", "ddsp_piano", "midi_ddsp"

# Words of categories in the order in which they are tried, and the class
# of programs that stands for a category.
CATEGORY_WORDS = (
    ("piano", ("piano",)),
    ("organ", ("organ",)),
    ("mallet", ("marimba", "vibraphone", "xylophone", "glockenspiel")),
    ("voice", ("voice", "soprano", "baritone", "choir", "vocal")),
    ("strings", ("violin", "viola", "cello", "contrabass", "string")),
    ("guitar", ("guitar", "gitar", "luit")),
    ("brass", ("trumpet", "trombone", "horn", "tuba", "brass", "cornet", "flugelhorn")),
    ("wind", ("flute", "clarinet", "sax", "oboe", "bassoon", "piccolo")),
)
CATEGORY_OF_CLASS = (
    ("piano", "piano"), ("guitar", "guitar"), ("brass", "brass"), ("reed", "wind"), ("pipe", "wind"),
    ("strings", "strings"), ("chromatic", "mallet"), ("organ", "organ"), ("ensemble", "voice"),
)

# The instruments that the neural renderer knows, with their programs, and
# the words of names for them in the order in which they are tried.
INSTRUMENT_PROGRAMS = (
    ("violin", 40), ("viola", 41), ("cello", 42), ("double bass", 43), ("flute", 73), ("oboe", 68), ("clarinet", 71),
    ("saxophone", 66), ("bassoon", 70), ("trumpet", 56), ("horn", 60), ("trombone", 57), ("tuba", 58),
)
INSTRUMENT_WORDS = (
    ("double bass", ("contrabass", "double bass", "doublebass")),
    ("cello", ("cello",)), ("viola", ("viola",)), ("violin", ("violin", "fiddle")), ("flute", ("flute",)), ("oboe", ("oboe",)),
    ("clarinet", ("clarinet",)), ("bassoon", ("bassoon",)),
    ("saxophone", ("sassofono", "saksofon", "saksafon", "szaxofon", "sax")),
    ("trumpet", ("trumpet", "cornet")), ("trombone", ("trombone",)), ("tuba", ("tuba",)), ("horn", ("horn",)),
)
NOT_INSTRUMENTS = ("piccolo", "english horn", "englishhorn", "cor anglais", "coranglais", "pan flute", "panflute", "recorder", "muted trumpet", "mute trumpet")
NOT_PIANOS = (
    "harpsichord", "cembalo", "clavinet", "clavi", "electric piano", "epiano", "e-piano", "e piano", "rhodes",
    "wurlitzer", "wurli", "dx7", "dx piano", "toy piano", "synth piano", "digital piano",
)
VOICES, VOICE_PARTS = ("voice", "vocal", "choir", "bass singer"), ("soprano", "alto", "tenor", "baritone")
NOT_VOICE_PARTS = (
    "sax", "sassofono", "saksafon", "saksofon", "trumpet", "cornet", "trombone", "tuba", "clarinet", "oboe", "bassoon", "flute", "piccolo",
    "violin", "viola", "cello", "guitar", "piano", "organ", "harp", "horn", "recorder",
)
SAX_PROGRAMS, BASS_PROGRAMS, GUITAR_PROGRAMS, CHOIR_PROGRAMS = (64, 67), (32, 39), (24, 31), (52, 54)
ACOUSTIC_PIANOS, MUTED_TRUMPET = (0, 1, 3), 59


def has_any(name: Column, words: Sequence[str]) -> Column:
    return name.rlike("|".join(map(re.escape, words)))


def _plain(name: Column) -> Column:
    return F.lower(stripped(F.coalesce(name, F.lit(""))))


def category(name: Column, program: Column, drum: Column) -> Column:
    """The listening category: drums, then words of the name, then the program's class, else polyphonic."""
    name, kind = _plain(name), program_class(program, F.lit(False))
    out = F.when(F.coalesce(drum, F.lit(False)), "drums")
    for known, words in CATEGORY_WORDS:
        out = out.when(has_any(name, words), known)
    for of, known in CATEGORY_OF_CLASS:
        out = out.when(kind == of, known)
    return out.otherwise("polyphonic")


def is_voice(name: Column, program: Column) -> Column:
    """Sung parts; of saxophones only those whose name says so."""
    name = _plain(name)
    part = has_any(name, VOICE_PARTS) & ~has_any(name, NOT_VOICE_PARTS)
    return has_any(name, VOICES) | (~program.between(*SAX_PROGRAMS) & (part | program.between(*CHOIR_PROGRAMS)))


def is_piano(name: Column, program: Column) -> Column:
    """Hammered acoustic pianos."""
    name, acoustic = _plain(name), program.isin(*ACOUSTIC_PIANOS)
    named = F.contains(name, F.lit("piano")) & ~F.contains(name, F.lit("guitar"))
    return ~has_any(name, NOT_PIANOS) & (acoustic | (named & ~program.between(0, 7)))


def instrument_by_name(name: Column, program: Column) -> Column:
    """The first instrument that a name has a word of; null for denied names and muted trumpets."""
    name = _plain(name)
    out = F.when(has_any(name, NOT_INSTRUMENTS), F.lit(None).cast("string"))
    for instrument, words in INSTRUMENT_WORDS:
        own = F.lit(instrument) if instrument != "trumpet" else F.when(program != MUTED_TRUMPET, instrument)
        out = out.when(has_any(name, words), own)
    return out


def instrument_by_program(program: Column) -> Column:
    out = F.when(program.between(*SAX_PROGRAMS), "saxophone")
    for instrument, number in INSTRUMENT_PROGRAMS:
        out = out.when(program == number, instrument)
    return out


def route(name: Column, program: Column, drum: Column, notes: Column | None = None, monophonic: Column | None = None) -> Column:
    """struct(backend, instrument, reason) of a track.

    notes: how many it has, if known; monophonic: whether it is, if that is to count
    (null: it is). Null programs are 0, null drum flags no.
    """
    program, drum = F.coalesce(program, F.lit(0)), F.coalesce(drum, F.lit(False))
    to = lambda backend, reason, instrument=None: F.struct(
        F.lit(backend).alias("backend"), (F.lit(None).cast("string") if instrument is None else instrument).alias("instrument"), F.lit(reason).alias("reason")
    )
    instrument = F.coalesce(instrument_by_name(name, program), instrument_by_program(program))
    empty = F.lit(False) if notes is None else F.coalesce(notes == 0, F.lit(False))
    many = F.lit(False) if monophonic is None else ~F.coalesce(monophonic, F.lit(True))
    return (
        F.when(drum, to(SOUNDFONT, "soundfont_drum"))
        .when(empty, to(SOUNDFONT, "empty_track"))
        .when(is_voice(name, program), to(SOUNDFONT, "soundfont_vocal"))
        .when(is_piano(name, program), to(PIANO, "piano", F.lit("piano")))
        .when(is_plucked(name), to(SOUNDFONT, "soundfont_guitar"))
        .when(program.between(*BASS_PROGRAMS), to(SOUNDFONT, "soundfont_bass_guitar"))
        .when(program.between(*GUITAR_PROGRAMS), to(SOUNDFONT, "soundfont_guitar"))
        .when(instrument.isNull(), to(SOUNDFONT, "soundfont_unsupported"))
        .when(many, to(SOUNDFONT, "soundfont_polyphonic", instrument))
        .otherwise(to(NEURAL, "midi_ddsp_eligible", instrument))
    )


def plan(tracks: DataFrame, recipe: DataFrame) -> DataFrame:
    """Tracks with their category's recipe, the backend and the pass that owns them.

    tracks: ``name``, ``program``, ``is_drum``, and ``notes``, ``monophonic`` where known;
    recipe: one row for each ``category`` with ``method``, ``fallback``, ``realify``. A
    category without a row is an error. Adds ``category``, the recipe's columns,
    ``neural_ok``, ``use_slakh``, ``route``, ``backend`` and ``pass``. Only tracks of a
    neural category take a neural backend; the pass is told without listening to the
    notes, and pianos have one of their own only if the recipe's piano is neural.
    """
    name, program, drum = (F.col(c) for c in ("name", "program", "is_drum"))
    known = lambda c: F.col(c) if c in tracks.columns else None
    marked = tracks.withColumn("category", category(name, program, drum))
    pianos = recipe.agg(F.coalesce(F.bool_or((F.col("category") == "piano") & (F.col("method") == "midi-ddsp")), F.lit(False)).alias("piano_pass"))
    joined = marked.join(recipe.withColumn("has_recipe", F.lit(True)), "category", "left").join(F.broadcast(pianos))
    must = F.when(F.col("has_recipe"), F.col("method")).otherwise(F.raise_error(F.concat(F.lit("no recipe for category "), F.col("category"))))
    planned = joined.withColumn("method", must).withColumn("neural_ok", F.col("method") == "midi-ddsp")
    planned = planned.withColumn("use_slakh", (F.col("method") == "slakh") | F.coalesce(F.col("fallback") == "slakh", F.lit(False)))
    other = F.struct(F.lit(SOUNDFONT).alias("backend"), F.lit(None).cast("string").alias("instrument"), F.lit("category_soundfont").alias("reason"))
    by_notes = F.when(F.col("neural_ok"), route(name, program, drum, known("notes"), known("monophonic"))).otherwise(other)
    unheard = route(name, program, drum).backend
    owner = F.when(~F.col("neural_ok"), "fluidsynth").when(unheard == PIANO, F.when(F.col("piano_pass"), PIANO).otherwise("fluidsynth"))
    planned = planned.withColumn("route", by_notes).withColumn("pass", owner.when(unheard == NEURAL, NEURAL).otherwise("fluidsynth"))
    backend = F.when(F.col("route.backend").isin(NEURAL, PIANO), F.col("route.backend")).otherwise("fluidsynth")
    return planned.withColumn("backend", backend).drop("has_recipe", "piano_pass")


def passes(recipe: DataFrame, *keys: str) -> DataFrame:
    """(keys, ``pass``, ``categories``) of recipes: those rendered plainly, neurally, and made realistic."""
    marks = F.array_compact(F.array(
        F.when(F.col("method").isin("basic", "slakh"), "fluidsynth"), F.when(F.col("method") == "midi-ddsp", "ddsp"), F.when(F.coalesce("realify", F.lit(False)), "realify")
    ))
    return recipe.select(*keys, "category", F.explode(marks).alias("pass")).groupBy(*keys, "pass").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def pass_sequence(recipe: DataFrame, *keys: str) -> DataFrame:
    """(keys, ``passes``): what recipes go through, in order; the neural passes and realism only where a category asks for them."""
    neural, real = F.col("method") == "midi-ddsp", F.coalesce("realify", F.lit(False))
    asked = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    steps = (
        F.lit("layout"), F.lit("fluidsynth"), F.when(asked(neural & (F.col("category") == "piano")), "ddsp_piano"),
        F.when(asked(neural), "midi_ddsp"), F.when(asked(real), "realify"), F.lit("mix"),
    )
    return recipe.groupBy(*keys).agg(F.array_compact(F.array(*steps)).alias("passes"))


#: Conditions whose audio is a donor's if a track's backend is a soundfont.
EQUIVALENT = (("ddsp_basic", "basic"), ("ddsp_slakh", "slakh"), ("ddsp_basic_realify", "basic_realify"), ("ddsp_slakh_realify", "slakh_realify"))


def equivalences(routes: DataFrame, *keys: str) -> DataFrame:
    """(keys, ``duplicate``, ``donor``) for every track whose ``backend`` is the soundfont."""
    pairs = F.array(*(F.struct(F.lit(a).alias("duplicate"), F.lit(b).alias("donor")) for a, b in EQUIVALENT))
    return routes.where(F.col("backend") == SOUNDFONT).select(*keys, F.inline(pairs))


def backend_shares(routes: DataFrame, notes: str) -> DataFrame:
    """By backend and reason: tracks, notes, and their percentages of all."""
    kinds = routes.groupBy("backend", "reason").agg(F.count("*").alias("tracks"), F.coalesce(F.sum(notes), F.lit(0)).alias("notes"))
    total = kinds.agg(F.sum("tracks").alias("t"), F.sum("notes").alias("n"))
    share = lambda n, of: F.coalesce(F.round(100.0 * F.col(n) / F.nullif(F.col(of), F.lit(0)), 4), F.lit(0.0)).cast("double")
    return kinds.join(F.broadcast(total)).select("backend", "reason", "tracks", "notes", share("tracks", "t").alias("track_share"), share("notes", "n").alias("note_share"))
