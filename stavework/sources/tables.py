"""Readers with fixed schemas and the missing-value rules of delimited files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands for a missing value in delimited files.
MISSING = "NA"

STEMS = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("track", T.IntegerType()), T.StructField("original_track", T.IntegerType()),
    T.StructField("program", T.IntegerType()), T.StructField("is_drum", T.BooleanType()), T.StructField("name", T.StringType()),
    T.StructField("has_lyrics", T.BooleanType()), T.StructField("max_velocity", T.IntegerType()), T.StructField("velocity_scale", T.DoubleType()),
])
RECIPES = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("track", T.IntegerType()), T.StructField("category", T.StringType()),
    T.StructField("method", T.StringType()), T.StructField("fallback", T.StringType()), T.StructField("backend", T.StringType()), T.StructField("realify", T.BooleanType()),
])
RATING_DOCUMENT = T.StructType([
    T.StructField("listener_id", T.StringType()), T.StructField("complete", T.BooleanType()),
    T.StructField("ratings", T.ArrayType(T.StructType([
        T.StructField("stem_id", T.StringType()), T.StructField("category", T.StringType()),
        T.StructField("samples", T.ArrayType(T.StructType([
            T.StructField("variant_id", T.StringType()), T.StructField("content", T.DoubleType()), T.StructField("realism", T.DoubleType()),
        ]))),
    ]))),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A delimited file with a header; NA, empty and nan cells are null, bad numbers too."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(text).option("header", True).option("nullValue", MISSING).csv(path)
    empty = lambda c: F.when(~F.lower(F.trim(c)).isin("", "nan"), c)
    return raw.select(*(empty(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) for f in schema))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", MISSING).csv(path)


def with_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's columns in order; absent ones are typed nulls."""
    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def documents(spark: SparkSession, paths: str | Sequence[str], seen: Observation | None = None) -> DataFrame:
    """(``file``, ``document``, ``problem``) of JSON files, one document each, whatever their fields are.

    document: a variant, null if the file isn't JSON. problem: ``unreadable``; ``unfinished``
    by the file's name; ``incomplete`` by its field ``complete``; null if it has none.
    With ``seen``, files, each kind of problem and the names of unreadable files are
    counted on the way, in the pass that reads them. A file without a byte is not seen:
    Spark reads none.
    """
    raw = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("document"))
    unfinished = F.contains("file", F.lit("in_progress"))
    complete = F.coalesce(F.try_variant_get("document", "$.complete", "boolean"), F.lit(True))
    problem = F.when(unfinished, "unfinished").when(F.col("document").isNull(), "unreadable").when(~complete, "incomplete")
    read = raw.withColumn("problem", problem)
    if seen is None:
        return read
    of = lambda p: F.count_if(F.col("problem") == p).alias(p)
    names = F.array_sort(F.collect_list(F.when(F.col("problem") == "unreadable", F.col("file")))).alias("unreadable_files")
    return read.observe(seen, F.count("*").alias("files"), *map(of, ("unfinished", "unreadable", "incomplete")), names)


def fields(table: DataFrame, document: str, depth: int) -> DataFrame:
    """A row for each field of a variant down to ``depth`` levels: the other columns, ``path`` and ``value``.

    Paths are like ``$.a[0].b``. What lies deeper stays a variant; objects and arrays
    without anything in them, and null documents, have no row.
    """
    others = [c for c in table.columns if c != document]

    def inside(value: Column, path: Column) -> Column:
        at = lambda name, v: F.struct(F.concat(path, name).alias("path"), v.alias("value"))
        pairs = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e: at(F.concat(F.lit("."), e.key), e.value))
        items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v, i: at(F.concat(F.lit("["), i.cast("string"), F.lit("]")), v))
        return F.coalesce(pairs, items, F.array(F.struct(path.alias("path"), value.alias("value"))))

    out = table.where(F.col(document).isNotNull()).select(*others, F.lit("$").alias("path"), F.col(document).alias("value"))
    for _ in range(depth):
        out = out.select(*others, F.inline(inside(F.col("value"), F.col("path"))))
    return out


def complete_documents(spark: SparkSession, paths: str | Sequence[str], seen: Observation | None = None) -> DataFrame:
    """Rating documents that are complete: unparsable and unfinished files are left out, and counted by ``seen``."""
    whole = documents(spark, paths, seen).where("problem is null")
    typed = F.from_json(F.to_json("document"), RATING_DOCUMENT)
    return whole.select(typed.alias("d")).select("d.*")


def ratings_of(documents: DataFrame) -> DataFrame:
    """Rating documents as rows."""
    trials = documents.select("listener_id", F.explode("ratings").alias("r"))
    samples = trials.select("listener_id", "r.stem_id", "r.category", F.explode("r.samples").alias("s"))
    return samples.select("listener_id", "stem_id", "category", "s.variant_id", "s.content", "s.realism")
