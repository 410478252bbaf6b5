"""Ordered rules and needle tables for track names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavework.functions.names import SHORT_NEEDLE, needle_in


@dataclass(frozen=True)
class Rule:
    """Matches drums, or a program (and the drum flag if given), or any keyword."""

    category: str
    drums: bool = False
    program: int | None = None
    is_drum: bool | None = None
    keywords: tuple[str, ...] = ()

    def column(self, name: Column, program: Column, drum: Column) -> Column:
        out = F.lit(False)
        if self.drums:
            out = out | drum
        if self.program is not None:
            same = program == self.program
            out = out | (same if self.is_drum is None else same & (drum == self.is_drum))
        for word in self.keywords:
            out = out | F.contains(name, F.lit(word))
        return F.coalesce(out, F.lit(False))


def route(rules: Sequence[Rule], name: Column, program: Column, drum: Column, default: str) -> Column:
    """The first matching rule's category, as one CASE; null names are empty, null programs 0."""
    name, program, drum = F.lower(F.coalesce(name, F.lit(""))), F.coalesce(program, F.lit(0)), F.coalesce(drum, F.lit(False))
    out = F.lit(default)
    for rule in reversed(rules):
        out = F.when(rule.column(name, program, drum), rule.category).otherwise(out)
    return out


def grams(name: Column) -> Column:
    """What needles of a lower-case name can begin with: every SHORT_NEEDLE characters, and fewer where a word begins."""
    size = F.length(name)
    every = F.transform(F.sequence(F.lit(1), size - SHORT_NEEDLE + 1), lambda i: F.substring(name, i, F.lit(SHORT_NEEDLE)))
    long = F.when(size >= SHORT_NEEDLE, every).otherwise(F.expr("cast(array() as array<string>)"))
    begins = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: (i == 1) | ~F.rlike(F.substring(name, i - 1, F.lit(1)), F.lit("[a-z0-9]")))
    lengths = F.array(*map(F.lit, range(1, SHORT_NEEDLE)))
    short = F.flatten(F.transform(begins, lambda i: F.transform(lengths, lambda n: F.substring(name, i, n))))
    return F.array_distinct(F.concat(long, short))


def longest_needle(names: DataFrame, needles: DataFrame, name: str) -> DataFrame:
    """The program of each distinct name's longest needles, if they agree on one.

    needles: ``needle``, ``program``, in any number; an empty needle is in no name. Names
    meet the needles that begin with one of their grams by an equi-join, and only those
    are compared. Returns ``name``, ``program`` and ``status`` (``matched``,
    ``ambiguous``, ``none``).
    """
    distinct = names.select(F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct()
    asked = distinct.select("name", F.explode(grams(F.lower("name"))).alias("gram"))
    index = needles.select("needle", "program", F.substring("needle", 1, SHORT_NEEDLE).alias("gram")).where("needle <> ''")
    hits = asked.join(index, "gram").where(needle_in(F.lower("name"), F.col("needle")))
    longest = hits.groupBy("name", F.length("needle").alias("size")).agg(F.countDistinct("program").alias("programs"), F.min("program").alias("program"))
    best = longest.groupBy("name").agg(F.max(F.struct("size", "programs", "program")).alias("best"))
    one = F.col("best.programs") == 1
    return distinct.join(best, "name", "left").select(
        "name",
        F.when(one, F.col("best.program")).alias("program"),
        F.when(F.col("best").isNull(), "none").when(one, "matched").otherwise("ambiguous").alias("status"),
    )


#: Names of the families of eight programs each, in program order.
FAMILIES = (
    "piano", "chromatic", "organ", "guitar", "bass", "strings", "ensemble", "brass",
    "reed", "pipe", "lead", "pad", "effects", "ethnic", "percussive", "sounds",
)


def program_class(program: Column, drum: Column) -> Column:
    """drums, or the family of eight programs, or the last one for anything else."""
    at = F.floor(program / 8).cast("int")
    inside = (program >= 0) & (program < 8 * len(FAMILIES))
    return F.when(drum, "drums").when(inside, F.get(F.array(*map(F.lit, FAMILIES)), at)).otherwise(FAMILIES[-1])
