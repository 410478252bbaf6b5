"""Verification documents: winners, bypassed categories, errors.

Entries have ``category``, ``approved`` (array<string>), ``winner_variant_id``,
``bypass_realify`` and ``stems`` (array of structs with ``bypass_realify``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.functions.names import keywords, stripped


def entries(documents: DataFrame, document: str) -> DataFrame:
    """One row for each entry of ``categories``; ``position`` is its place there."""
    rows = documents.select(document, F.posexplode("categories").alias("position", "_e"))
    return rows.select(document, "position", "_e.*")


def last_of_category(found: DataFrame, document: str) -> DataFrame:
    """Of entries for the same category the last; entries without a category go."""
    named = found.where(F.coalesce(F.col("category"), F.lit("")) != "")
    last = named.groupBy(document, "category").agg(F.max_by(F.struct(*found.columns), "position").alias("_e"))
    return last.select("_e.*")


def shortlists(found: DataFrame, document: str) -> DataFrame:
    """Approved variants of categories that have some."""
    kept = last_of_category(found.where(F.size(F.coalesce("approved", F.array())) > 0), document)
    return kept.select(document, "category", "approved")


def winners(found: DataFrame, document: str) -> DataFrame:
    """The winner of each category that has one and isn't bypassed."""
    has = (F.coalesce(F.col("winner_variant_id"), F.lit("")) != "") & ~F.coalesce("bypass_realify", F.lit(False))
    return last_of_category(found.where(has), document).select(document, "category", "winner_variant_id")


def bypass(found: DataFrame, document: str) -> DataFrame:
    """``bypassed`` of each category: all, part or none.

    Stems decide where there are any, else the entry's own flag.
    """
    n = F.size(F.coalesce("stems", F.array()))
    hit = F.size(F.filter("stems", lambda s: F.coalesce(s["bypass_realify"], F.lit(False))))
    whole = F.when(n > 0, hit == n).otherwise(F.coalesce("bypass_realify", F.lit(False)))
    label = F.when(whole, "all").when((n > 0) & (hit > 0), "part").otherwise("none")
    return last_of_category(found, document).select(document, "category", label.alias("bypassed"))


def bypass_rules(found: DataFrame, document: str) -> DataFrame:
    """One rule for each bypassed stem of an entry with some, but not all, of its stems bypassed.

    stems: ``bypass_realify``, ``track_name``, ``note``, ``program``, ``is_drum``. A rule goes
    by the name's ``keywords``, or without a name by ``program`` and, of drums,
    ``is_drum``. Equal rules of a document count once, at the first ``place``.
    """
    hit = lambda s: F.coalesce(s["bypass_realify"], F.lit(False))
    stems, n = F.coalesce("stems", F.array()), F.size(F.coalesce("stems", F.array()))
    some = F.filter(stems, hit)
    part = found.where((F.coalesce("category", F.lit("")) != "") & (F.size(some) > 0) & (F.size(some) < n))
    rows = part.select(document, "category", "position", F.posexplode(some).alias("at", "s"))
    blank = lambda c: F.nullif(stripped(c), F.lit(""))
    name = F.coalesce(blank(F.col("s.track_name")), blank(F.col("s.note")))
    program, drum = F.coalesce("s.program", F.lit(0)), F.when(F.coalesce("s.is_drum", F.lit(False)), True)
    rules = rows.select(
        document, "category", F.struct("position", "at").alias("place"), F.when(name.isNotNull(), keywords(name)).alias("keywords"),
        F.when(name.isNull(), program).alias("program"), F.when(name.isNull(), drum).alias("is_drum"),
    )
    return rules.groupBy(document, "category", "keywords", "program", "is_drum").agg(F.min("place").alias("place"))


def errors(found: DataFrame, document: str, shortlist_only: bool = False, presets: bool = False) -> DataFrame:
    """(document, position, ``error``) for every rule that an entry breaks."""
    category = F.coalesce(F.col("category"), F.lit(""))
    none_kept = F.size(F.coalesce("approved", F.array())) == 0
    winner = F.coalesce(F.col("winner_variant_id"), F.lit(""))
    say = lambda broken, text: F.when(broken, F.concat(category, F.lit(f": {text}")))
    if shortlist_only:
        checks = F.array(say(none_kept, "keep at least one soundfont"))
    elif presets:
        checks = F.array(F.lit(None).cast("string"))
    else:
        listed = F.coalesce(F.array_contains("approved", winner), F.lit(False))
        checks = F.array(
            say(none_kept, "approve at least one variant"),
            say(winner == "", "pick a winner"),
            say((winner != "") & ~listed, "winner must be among approved variants"),
        )
        checks = F.when(F.coalesce("bypass_realify", F.lit(False)), F.expr("cast(array() as array<string>)")).otherwise(checks)
    checks = F.when(category == "", F.array(F.lit("missing category"))).otherwise(F.array_compact(checks))
    return found.select(document, "position", F.explode(checks).alias("error"))


def approved_by_votes(votes: DataFrame, shortlist: DataFrame, *order: str) -> DataFrame:
    """``approved`` of each category: listed variants whose last vote is a strong accept.

    shortlist: ``category``, ``variant_id``, ``place``; votes: ``category``,
    ``variant_id``, ``tier`` and the order columns. Categories without one get an empty
    list.
    """
    last = votes.groupBy("category", "variant_id").agg(F.max_by("tier", F.struct(*order)).alias("_tier"))
    joined = shortlist.join(last, ["category", "variant_id"], "left")
    yes = F.when(F.col("_tier") == "strong_accept", F.struct("place", "variant_id"))
    return joined.groupBy("category").agg(F.array_sort(F.collect_list(yes)).alias("_a")).select("category", F.col("_a.variant_id").alias("approved"))
