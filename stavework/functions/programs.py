"""Names and labels of the 128 programs of General MIDI."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRUMS = 128

#: The standard's program names, from 0, eight of a family in a line.
PROGRAM_NAMES = (
    "Acoustic Grand Piano", "Bright Acoustic Piano", "Electric Grand Piano", "Honky-tonk Piano", "Electric Piano 1", "Electric Piano 2", "Harpsichord", "Clavinet",
    "Celesta", "Glockenspiel", "Music Box", "Vibraphone", "Marimba", "Xylophone", "Tubular Bells", "Dulcimer",
    "Drawbar Organ", "Percussive Organ", "Rock Organ", "Church Organ", "Reed Organ", "Accordion", "Harmonica", "Tango Accordion",
    "Acoustic Guitar (nylon)", "Acoustic Guitar (steel)", "Electric Guitar (jazz)", "Electric Guitar (clean)", "Electric Guitar (muted)", "Overdriven Guitar", "Distortion Guitar", "Guitar Harmonics",
    "Acoustic Bass", "Electric Bass (finger)", "Electric Bass (pick)", "Fretless Bass", "Slap Bass 1", "Slap Bass 2", "Synth Bass 1", "Synth Bass 2",
    "Violin", "Viola", "Cello", "Contrabass", "Tremolo Strings", "Pizzicato Strings", "Orchestral Harp", "Timpani",
    "String Ensemble 1", "String Ensemble 2", "Synth Strings 1", "Synth Strings 2", "Choir Aahs", "Voice Oohs", "Synth Voice", "Orchestra Hit",
    "Trumpet", "Trombone", "Tuba", "Muted Trumpet", "French Horn", "Brass Section", "Synth Brass 1", "Synth Brass 2",
    "Soprano Sax", "Alto Sax", "Tenor Sax", "Baritone Sax", "Oboe", "English Horn", "Bassoon", "Clarinet",
    "Piccolo", "Flute", "Recorder", "Pan Flute", "Blown Bottle", "Shakuhachi", "Whistle", "Ocarina",
    "Lead 1 (square)", "Lead 2 (sawtooth)", "Lead 3 (calliope)", "Lead 4 (chiff)", "Lead 5 (charang)", "Lead 6 (voice)", "Lead 7 (fifths)", "Lead 8 (bass + lead)",
    "Pad 1 (new age)", "Pad 2 (warm)", "Pad 3 (polysynth)", "Pad 4 (choir)", "Pad 5 (bowed)", "Pad 6 (metallic)", "Pad 7 (halo)", "Pad 8 (sweep)",
    "FX 1 (rain)", "FX 2 (soundtrack)", "FX 3 (crystal)", "FX 4 (atmosphere)", "FX 5 (brightness)", "FX 6 (goblins)", "FX 7 (echoes)", "FX 8 (sci-fi)",
    "Sitar", "Banjo", "Shamisen", "Koto", "Kalimba", "Bagpipe", "Fiddle", "Shanai",
    "Tinkle Bell", "Agogo", "Steel Drums", "Woodblock", "Taiko Drum", "Melodic Tom", "Synth Drum", "Reverse Cymbal",
    "Guitar Fret Noise", "Breath Noise", "Seashore", "Bird Tweet", "Telephone Ring", "Helicopter", "Applause", "Gunshot",
)


def quoted(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values) -> Column:
    """An array of string literals."""
    return F.expr(f"array({', '.join(map(quoted, values))})")


def program_name(program: Column) -> Column:
    known = F.get(strings(PROGRAM_NAMES), F.when(program >= 0, program).cast("int"))
    return F.coalesce(known, F.concat(F.lit("Unknown program "), program.cast("string")))


def program_label(program: Column) -> Column:
    """``number: name``; drums say their channel, unknown numbers say so."""
    known = F.get(strings(PROGRAM_NAMES), F.when(program >= 0, program).cast("int"))
    name = F.when(program == DRUMS, "Drums (channel 10)").otherwise(F.coalesce(known, F.lit("Unknown")))
    return F.concat(program.cast("string"), F.lit(": "), name)


def short_label(program: Column) -> Column:
    """``name (number)``; drums without a number."""
    return F.when(program == DRUMS, "Drums").otherwise(F.concat(program_name(program), F.lit(" ("), program.cast("string"), F.lit(")")))


def instrument(program: Column, drum: Column, name: Column) -> Column:
    """What a caption calls a track: drums, its name, or its program's number."""
    own = F.lower(F.trim(name))
    return F.when(drum, "drums").when(F.coalesce(own, F.lit("")) != "", own).otherwise(F.concat(F.lit("midi program "), program.cast("string")))


#: How a caption begins, by its form.
CURRENT = "TrackType: Instrument. Preserve the exact melody and rhythm. Same performance and timing. Realistic recorded sound, expressive performance."
PRESERVATION = "Preserve the exact melody, rhythm, and timing. Same notes and phrasing."
ADHERENCE = (
    "Adhere to the original content. Same melody, rhythm, timing, and phrasing. "
    "Make it sound more realistic, as if it were being performed and recorded."
)
#: Fixed value: what a caption of the adherence form asks to be left out.
ADHERENCE_WITHOUT = "added notes, changed melody, improvisation, new rhythmic content, hallucinated performance"
FORMS = ("current", "minimal", "preservation", "adherence")


def caption_in_form(form: str, fields: dict[str, Column], program: Column, drum: Column, name: Column, order: Column, hint: bool = True) -> Column:
    """A track's caption in one of FORMS; only ``current`` has the fields. hint: whether the instrument is named at the end."""
    if form not in FORMS:
        raise ValueError(f"unknown form {form}, expected one of {', '.join(FORMS)}")
    own = instrument(program, drum, name)
    if form == "minimal":
        return F.concat(F.lit("solo "), own, F.lit(", realistic studio recording, expressive performance"))
    if form == "current":
        whole = caption(CURRENT, fields, program, drum, name, order)
        return whole if hint else F.substring_index(whole, ". format: solo | instruments: ", 1)
    begin = F.lit(ADHERENCE) if form == "adherence" else F.concat(F.lit(f"{PRESERVATION} Realistic recorded "), own, F.lit("."))
    return F.concat(begin, F.lit(". format: solo | instruments: "), own) if hint else begin


def caption(anchor: str, fields: dict[str, Column], program: Column, drum: Column, name: Column, order: Column) -> Column:
    """An anchor, the fields that aren't null as ``key: value`` in a hashed order, and the instrument.

    order: what the order of fields is taken from, with each field's key.
    """
    pairs = [F.struct(F.md5(F.concat_ws("|", order, F.lit(k))).alias("at"), F.concat(F.lit(f"{k}: "), v.cast("string")).alias("text")) for k, v in fields.items()]
    kept = F.transform(F.array_sort(F.filter(F.array(*pairs), lambda p: p.text.isNotNull())), lambda p: p.text) if pairs else F.expr("cast(array() as array<string>)")
    hint = F.concat(F.lit("format: solo | instruments: "), instrument(program, drum, name))
    return F.concat_ws(". ", F.lit(anchor), F.nullif(F.array_join(kept, ", "), F.lit("")), hint)
