"""Programs corrected by track names: three tiers of needles, and what was corrected.

All of a track's decision is one struct column, so a table is corrected in a projection:
no join and no shuffle. Needles are looked up in an index by an Arrow function, and
everything else is columns.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavework.functions.names import SHORT_NEEDLE, folded, is_generic, needle_in, sanitized, stripped
from stavework.functions.programs import PROGRAM_NAMES, program_name, quoted, strings
from stavework.operators.rules import program_class

KEEP, CORRECTED = "keep", "corrected"
DRUM, UNNAMED, GENERIC, AMBIGUOUS, NO_MATCH = "skipped_drum", "skipped_unnamed", "skipped_generic", "skipped_ambiguous", "skipped_no_match"
#: Words of program names that name no instrument.
STOPWORDS = frozenset("a an the and or of 1 2 3 4 5 6 7 8 new age music lead pad synth fx square warm".split())


def name_words(label: str) -> list[str]:
    """The telling words of a program's name."""
    plain = label.lower().translate(str.maketrans("()+,/", "     "))
    return [w for w in plain.split() if len(w) >= 4 and w not in STOPWORDS]


def program_needles(labels: Sequence[str] = PROGRAM_NAMES) -> list[tuple[str, int]]:
    """Names and telling words that belong to one program only."""
    of: dict[str, set[int]] = {}
    for program, label in enumerate(labels):
        whole = " ".join(label.lower().translate(str.maketrans("()+,/", "     ")).split())
        for needle in {w for w in [whole, *name_words(label)] if len(w) >= 4}:
            of.setdefault(needle, set()).add(program)
    return [(needle, min(programs)) for needle, programs in of.items() if len(programs) == 1]


class NeedleIndex:
    """Needles by the characters that they begin with, or as whole words if they are short."""

    def __init__(self, needles: Sequence[tuple[str, int]]):
        self.by_gram: dict[str, list[tuple[str, int]]] = {}
        self.by_word: dict[str, list[tuple[str, int]]] = {}
        self.odd: list[tuple[re.Pattern, tuple[str, int]]] = []
        for row in sorted(set(needles)):
            needle = row[0]
            if len(needle) >= SHORT_NEEDLE:
                self.by_gram.setdefault(needle[:SHORT_NEEDLE], []).append(row)
            elif needle.isascii() and needle.isalnum():
                self.by_word.setdefault(needle, []).append(row)
            elif needle:
                self.odd.append((re.compile(f"(?:^|[^a-z0-9]){re.escape(needle)}(?:[^a-z0-9]|$)"), row))

    def longest(self, name: str) -> dict | None:
        """The first, by name and program, of a name's longest needles, and whether they disagree on the program."""
        hits = [row for i in range(len(name) - SHORT_NEEDLE + 1) for row in self.by_gram.get(name[i : i + SHORT_NEEDLE], ()) if name.startswith(row[0], i)]
        if not hits and self.by_word:
            hits = [row for word in _WORD.findall(name) for row in self.by_word.get(word, ())]
        if not hits or max(len(n) for n, _ in hits) < SHORT_NEEDLE:
            hits += [row for pattern, row in self.odd if pattern.search(name)]
        if not hits:
            return None
        size = max(len(n) for n, _ in hits)
        top = sorted({row for row in hits if len(row[0]) == size})
        return {"needle": top[0][0], "program": top[0][1], "ambiguous": len({p for _, p in top}) > 1}


_WORD = re.compile("[a-z0-9]+")
_HIT = pa.struct([("needle", pa.string()), ("program", pa.int32()), ("ambiguous", pa.bool_())])


def longest_needles(name: Column, **tiers: Sequence[tuple[str, int]]) -> Column:
    """A struct of struct(needle, program, ambiguous) for each tier: a name's longest needles there; null if it has none.

    Of needles of one length the first by name and program is given; it is ambiguous if
    they disagree on the program. Short needles only match whole words. A name costs a
    look-up for each of its characters, however many needles there are, and a name that
    stands in a batch many times is looked up once.
    """
    if not all(tiers.values()):
        raise ValueError("a tier needs needles")
    indexes = {tier: NeedleIndex(needles) for tier, needles in tiers.items()}
    kind = "struct<needle: string, program: int, ambiguous: boolean>"

    @F.arrow_udf("struct<" + ", ".join(f"{tier}: {kind}" for tier in tiers) + ">")
    def find(names: pa.Array) -> pa.Array:
        coded = names.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        columns = [pa.array([index.longest(n) for n in distinct], _HIT).take(coded.indices) for index in indexes.values()]
        return pa.StructArray.from_arrays(columns, names=list(indexes))

    return find(name)


def agrees(name: Column, program: Column) -> Column:
    """Whether a name already fits its program's name: one holds the other, or a telling word."""
    at = F.when(program >= 0, program).cast("int")
    label = F.lower(program_name(program))
    per_program = F.expr("array(" + ", ".join(f"array({', '.join(map(quoted, name_words(x)))})" if name_words(x) else "cast(array() as array<string>)" for x in PROGRAM_NAMES) + ")")
    words = F.coalesce(F.get(per_program, at), strings(["unknown", "program"]))
    return F.contains(name, label) | F.contains(label, name) | F.exists(words, lambda w: needle_in(name, w))


def corrected(
    name: Column, program: Column, drum: Column, aliases: Sequence[tuple[str, int]], families: Sequence[tuple[str, int, str]], generic: Sequence[str] = ()
) -> Column:
    """struct(program, status, match_key) of a track.

    In order: drums, tracks without a name and generic names are left; a name that fits
    the program keeps it; then aliases, then families (which keep a program of their
    class), then program names decide by their longest needle. Null programs are 0, null
    drum flags no.
    """
    program, drum = F.coalesce(program, F.lit(0)), F.coalesce(drum, F.lit(False))
    plain = folded(stripped(F.coalesce(sanitized(name), F.lit(""))))
    outcome = lambda p, status, key=None: F.struct(p.cast("int").alias("program"), F.lit(status).alias("status"), F.lit(key).cast("string").alias("match_key") if key is None else key.alias("match_key"))

    def judged(hit: Column, kept: Column | None = None) -> Column:
        same = hit.program == program if kept is None else (hit.program == program) | kept
        return F.when(hit.ambiguous, outcome(program, AMBIGUOUS, hit.needle)).when(same, outcome(program, KEEP, hit.needle)).otherwise(outcome(hit.program, CORRECTED, hit.needle))

    classes = F.expr("map(" + ", ".join(f"{quoted(n)}, {quoted(c)}" for n, c in {n: c for n, _, c in families}.items()) + ")")

    def decide(s: Column) -> Column:
        in_class = F.coalesce(F.try_element_at(classes, s.by_family.needle) == program_class(program, F.lit(False)), F.lit(False))
        return (
            F.when(drum, outcome(program, DRUM))
            .when(s.plain == "", outcome(program, UNNAMED))
            .when(is_generic(s.plain, generic), outcome(program, GENERIC))
            .when(agrees(s.plain, program), outcome(program, KEEP))
            .when(s.by_alias.isNotNull(), judged(s.by_alias))
            .when(s.by_family.isNotNull(), judged(s.by_family, in_class))
            .when(s.by_label.isNotNull(), judged(s.by_label))
            .otherwise(outcome(program, NO_MATCH))
        )

    found = longest_needles(plain, by_alias=aliases, by_family=[(needle, p) for needle, p, _ in families], by_label=program_needles())
    rows = F.array(F.struct(plain.alias("plain"), *(found[t].alias(t) for t in ("by_alias", "by_family", "by_label"))))
    return F.get(F.transform(rows, decide), 0)


def is_eligible(drum: Column, status: Column) -> Column:
    """Tracks with a telling name that aren't drums."""
    return ~F.coalesce(drum, F.lit(False)) & ~status.isin(UNNAMED, GENERIC)


def register_summary(register: DataFrame) -> DataFrame:
    """One row: tracks, corrected and fine ones, eligible ones, with percentages (0 of nothing).

    register: ``is_drum``, ``status``.
    """
    eligible = is_eligible(F.col("is_drum"), F.col("status"))
    hit = F.col("status") == CORRECTED
    counts = register.agg(
        F.count("*").alias("n_tracks"), F.count_if(hit).alias("n_corrected"), F.count_if(eligible).alias("n_eligible"), F.count_if(eligible & hit).alias("n_corrected_eligible")
    )
    share = lambda n, of: F.coalesce(F.round(100.0 * F.col(n) / F.nullif(F.col(of), F.lit(0)), 2), F.lit(0.0)).cast("double")
    return counts.withColumn("n_fine", F.col("n_tracks") - F.col("n_corrected")).withColumns({
        "pct_corrected": share("n_corrected", "n_tracks"),
        "pct_fine": share("n_fine", "n_tracks"),
        "pct_corrected_eligible": share("n_corrected_eligible", "n_eligible"),
    })


def top_corrections(register: DataFrame, top: int) -> DataFrame:
    """The ``top`` most frequent corrections with their share of all, ties by program.

    register: ``program_original``, ``program_corrected``, ``status``. Nothing corrected
    gives no rows.
    """
    pairs = register.where(F.col("status") == CORRECTED).groupBy("program_original", "program_corrected").agg(F.count("*").alias("count"))
    total = pairs.agg(F.sum("count").alias("total"))
    names = {c: program_name(F.col(f"program_{c}")) for c in ("original", "corrected")}
    label = F.concat_ws(" ", F.col("program_original").cast("string"), names["original"], F.lit("→"), F.col("program_corrected").cast("string"), names["corrected"])
    best = pairs.orderBy(F.desc("count"), "program_original", "program_corrected").limit(top).join(F.broadcast(total))
    return best.select(
        "program_original", "program_corrected", "count", F.round(100.0 * F.col("count") / F.col("total"), 2).cast("double").alias("share"), label.alias("label")
    )
