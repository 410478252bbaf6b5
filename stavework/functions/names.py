"""Column expressions for track names, ids and paths."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Needles shorter than this only match whole words.
SHORT_NEEDLE = 5
UNNAMED = "(unnamed)"


#: White space at the ends of a name, of any script, and the separators FS to US.
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def stripped(name: Column) -> Column:
    return F.regexp_replace(name, _ENDS, "")


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def folded(name: Column) -> Column:
    """Lower case without accents: compatibility decomposition, ligatures and fractions too, without combining marks.

    An Arrow function, since columns have no decomposition; each distinct name of a batch once.
    """

    @F.arrow_udf("string")
    def by_batch(names: pa.Array) -> pa.Array:
        coded = names.dictionary_encode()
        return pa.array([fold(n) for n in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)

    return by_batch(name)


def sanitized(name: Column) -> Column:
    """NUL removed, commas as spaces, white space collapsed; null if nothing is left."""
    plain = F.trim(F.regexp_replace(F.translate(name, ",\x00", " "), r"(?U)\s+", " "))
    return F.when(plain != "", plain)


def normalized(name: Column) -> Column:
    """Trimmed and lower-cased; null and empty become the unnamed marker."""
    low = F.lower(stripped(name))
    return F.when(F.coalesce(low, F.lit("")) == "", F.lit(UNNAMED)).otherwise(low)


def is_generic(name: Column, labels: Sequence[str] = ()) -> Column:
    """Names that say nothing of an instrument: listed or numbered labels, digits, converter marks, none at all."""
    low = F.lower(stripped(F.coalesce(name, F.lit(""))))
    known = low.isin("", UNNAMED, *labels)
    return known | low.rlike(r"^(track|part|staff|channel)[\s_-]*\d+$") | low.rlike(r"^\d+$") | low.contains("musicxml")


def is_plucked(name: Column) -> Column:
    """Guitars anywhere in a name, lutes as whole words."""
    return F.coalesce(F.lower(name).rlike(r"guitar|gitar|\blute\b|\bluit\b"), F.lit(False))


def level_of(variant: Column, prefix: str) -> Column:
    """The number in an id of ``prefix`` and a number; null for any other id."""
    return F.regexp_extract(variant, rf"^{prefix}([0-9]+(?:\.[0-9]+)?)$", 1).try_cast("double")


def level_id(level: Column, prefix: str) -> Column:
    """The id of a level: two decimals at most, without trailing zeros."""
    return F.concat(F.lit(prefix), F.regexp_replace(F.format_string("%.2f", level.cast("double")), r"\.?0+$", ""))


def needle_in(name: Column, needle: Column) -> Column:
    """Whether a needle is in a name; short ones need other characters around them."""
    word = F.concat(F.lit("(^|[^a-z0-9])"), F.regexp_replace(needle, r"([^A-Za-z0-9 ])", r"\\$1"), F.lit("([^a-z0-9]|$)"))
    return F.when(F.length(needle) < SHORT_NEEDLE, F.regexp_like(name, word)).otherwise(F.contains(name, needle))


def slug(name: Column, default: str = "item") -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(plain, F.lit("")) == "", F.lit(default)).otherwise(plain)


def keywords(name: Column) -> Column:
    """The first three words of three or more letters, else the whole name."""
    low = F.lower(stripped(name))
    words = F.slice(F.filter(F.split(low, r"[\s_/\-]+"), lambda w: F.length(w) >= 3), 1, 3)
    return F.when(F.size(words) > 0, words).otherwise(F.array(low))


def path_id(path: Column) -> Column:
    """A path without its leading dots and slashes, first folder and suffix."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^[./]+", ""), r"^[^/]+/", ""), r"\.[A-Za-z0-9]+$", "")


def stem_index(name: Column) -> Column:
    """N of ``N.ext`` or ``stem_N.ext``, else null."""
    return F.regexp_extract(name, r"^(?:stem_)?([0-9]+)\.[A-Za-z0-9]+$", 1).try_cast("int")


def int_list(cell: Column) -> Column:
    """``0-40-41`` as an array of ints; null if any part that isn't blank is no int."""
    parts = F.filter(F.split(cell, "-"), lambda p: F.trim(p) != "")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("int"))
    return F.when(F.forall(numbers, lambda n: n.isNotNull()), numbers)


def safe_id(name: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.trim(name), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(plain, F.lit("")) == "", F.lit("anonymous")).otherwise(plain)


def _slashed(path: Column) -> Column:
    """Forward slashes, without dots and slashes in front."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def after_marker(path: Column, folder: str) -> Column:
    """What comes after the first folder of a name, anywhere in a path; null if it isn't there."""
    return F.nullif(F.regexp_extract(F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/"))), rf"^.*?/\Q{folder}\E/(.*)$", 1), F.lit(""))


def midi_rest(path: Column) -> Column:
    """A MIDI file's path below ``mid``, or without dots and slashes in front."""
    return F.coalesce(after_marker(path, "mid"), _slashed(path))


def midi_id(path: Column) -> Column:
    """The song id of a MIDI file's path: what is below ``mid``, without the suffix."""
    return F.regexp_replace(midi_rest(path), r"\.mid$", "")


def midi_path(rest: Column, root: str) -> Column:
    """Where a MIDI file is below a root; a slash in front is the root's."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(rest, "^/", ""))


def record_id(path: Column) -> Column:
    """The song id of a record's path: without a leading ``data`` folder and the JSON suffix."""
    return F.regexp_replace(F.regexp_replace(_slashed(path), "^data/", ""), r"\.json$", "")


def song_id(path: Column) -> Column:
    """The song id of a record's or MIDI file's path: without a leading ``data`` folder and the last suffix of its name."""
    return F.regexp_replace(F.regexp_replace(_slashed(path), "^data/", ""), r"(?<=[^/])\.[^./]+$", "")


def id_below_data(path: Column) -> Column:
    """What is below the first folder named ``data``; a path without one is an error, a null path null."""
    below = F.regexp_extract(path, "(?:^|/)data(?:/+|$)(.*)$", 1)
    say = F.raise_error(F.concat(F.lit("no data folder in "), path)).cast("string")
    return F.when(path.rlike("(^|/)data(/|$)"), F.regexp_replace(F.regexp_replace(below, "/+", "/"), "/$", "")).when(path.isNotNull(), say)


def output_folder(path: Column, original: str, output: str, tree: str = "data") -> Column:
    """The folder of a song's files: its record's path below the original data set, moved to ``output``, without its suffix.

    With another ``tree`` the first ``data`` folder in it is called that.
    """
    rest = F.substring(path, len(original) + 1, 1 << 30)
    bare = F.when(F.contains(rest, F.lit(".")), F.regexp_replace(rest, r"(?s)\.[^.]*$", "")).otherwise("")
    at = F.instr(bare, "/data/")
    moved = F.concat(F.substring(bare, F.lit(1), at), F.lit(f"{tree}/"), F.substring(bare, at + len("/data/"), F.lit(1 << 30)))
    return F.concat(F.lit(output), F.when((at > 0) & F.lit(tree != "data"), moved).otherwise(bare))


def record_path(midi_path: Column) -> Column:
    """The record that belongs to a MIDI file."""
    return F.concat(F.lit("./data/"), midi_id(midi_path), F.lit(".json"))


def audio_id(path: Column) -> Column:
    """The song id of a rendered folder: what is below ``audio`` (without slashes at the ends), else the last name."""
    return F.coalesce(F.trim(after_marker(path, "audio"), F.lit("/")), F.regexp_extract(path, "([^/]+)/*$", 1))
