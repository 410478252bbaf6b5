"""Condition ids and recipes as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Condition ids without the realify suffix, with method and fallback.
CONDITIONS = (("basic", "basic", "basic"), ("slakh", "slakh", "slakh"), ("ddsp_basic", "midi-ddsp", "basic"), ("ddsp_slakh", "midi-ddsp", "slakh"))
SUFFIX = "_realify"


def condition_parts(condition: Column) -> Column:
    """struct(method, realify, fallback) of a condition id; null for an unknown one."""
    name = F.trim(condition)
    realify = name.endswith(SUFFIX)
    base = F.regexp_replace(name, f"{SUFFIX}$", "")
    out = F.lit(None)
    for known, method, fallback in CONDITIONS:
        out = F.when(base == known, F.struct(F.lit(method).alias("method"), realify.alias("realify"), F.lit(fallback).alias("fallback"))).otherwise(out)
    return out


def spec_parts(method: Column, realify: Column, fallback: Column) -> Column:
    """The same struct for an expanded entry; null for an unknown method or fallback.

    A method with a fallback of its own overrides the entry's; without one it is basic.
    """
    plain = F.lower(F.trim(method))
    plain = F.when(plain == "midi_ddsp", "midi-ddsp").when(plain.isin("basic", "slakh", "midi-ddsp"), plain)
    given = F.coalesce(F.lower(F.trim(fallback)), F.when(plain == "slakh", "slakh").otherwise("basic"))
    known = plain.isNotNull() & given.isin("basic", "slakh")
    settled = F.when(plain.isin("basic", "slakh"), plain).otherwise(given)
    return F.when(known, F.struct(plain.alias("method"), F.coalesce(realify, F.lit(False)).alias("realify"), settled.alias("fallback")))


def category_problems(recipe: DataFrame, categories: Sequence[str]) -> DataFrame:
    """(``category``, ``problem``): needed categories that are missing, and unknown ones."""
    needed = recipe.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    own = recipe.select("category").distinct()
    missing = needed.join(own, "category", "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(own.join(needed, "category", "left_anti").withColumn("problem", F.lit("unknown")))


def reused_label(mode: Column) -> Column:
    return F.concat(F.lit("reused:"), mode)


def reused_mode(source: Column, modes: Sequence[str]) -> Column:
    """The donor mode of a label; null for other sources and unknown modes."""
    mode = F.when(source.startswith("reused:"), F.substr(source, F.lit(8)))
    return F.when(mode.isin(*modes), mode)
