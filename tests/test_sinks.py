"""Delimited tables without rows, and upserts of whole groups."""

from stavework.operators import tables
from stavework.sources import files
from stavework.sources.tables import STEMS, read_csv, write_csv


def test_an_empty_table_keeps_its_header(spark, tmp_path):
    for name, df in (("made", spark.createDataFrame([], STEMS)), ("left", spark.range(3).selectExpr("cast(id as string) as path").where("path = 'x'"))):
        write_csv(df, str(tmp_path / name))
        assert files.header(spark, str(tmp_path / name)) == df.columns
        assert read_csv(spark, str(tmp_path / name), df.schema).count() == 0


def test_an_upsert_replaces_a_whole_group(spark):
    old = spark.createDataFrame([("a", 0, "x"), ("a", 1, "x"), ("b", 0, "x")], "song string, track int, v string")
    new = spark.createDataFrame([("a", 5, "y"), ("c", 0, "y"), ("c", 0, "y")], old.schema)
    assert sorted(tuple(r) for r in tables.upsert(old, new, ["song"]).collect()) == [("a", 5, "y"), ("b", 0, "x"), ("c", 0, "y"), ("c", 0, "y")]
