"""Every query with SQL against DuckDB, and the ones without against plain Python."""

import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from stavework.operators import sequences
from stavework.plans import catalog, catalog_files, catalog_manifest, catalog_names, catalog_tables  # noqa: F401  (they register their queries)
from stavework.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE_SQL[name])


def test_entry_is_there(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_monophony_is_a_fold_over_open_notes(spark):
    rng = random.Random(3)
    rows = [(g, seq, rng.random() < 0.5, rng.randrange(3)) for g in range(60) for seq in range(rng.randrange(1, 7))]
    found = sequences.monophony(spark.createDataFrame(rows, "g int, seq long, on boolean, note long").orderBy(F.rand(1)), ["g"])
    for g, ok in found.collect():
        open_notes, expected = set(), True
        for _, _, on, note in sorted(r for r in rows if r[0] == g):
            if on:
                expected &= not open_notes
                open_notes.add(note)
            else:
                open_notes.discard(note)
        assert ok == expected


def test_samples_have_their_sizes_and_repeat(spark):
    first, again = (QUERIES["deterministic_sample"](spark, SMALL).collect() for _ in range(2))
    assert len(first) == 100 and first == again
    labels = QUERIES["blinded_order"](spark, SMALL).collect()
    for nation in {r.s_nationkey for r in labels}:
        own = sorted(r.position for r in labels if r.s_nationkey == nation)
        assert own == list(range(len(own)))
    chosen = QUERIES["diverse_selection"](spark, SMALL).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("songs")).collect()
    assert all(r.n == 5 and r.songs == 5 for r in chosen)
