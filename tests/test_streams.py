"""Streams and tables with several writers: restarts, races, replays."""

import datetime
import random
import threading

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from stavework.operators import tables, votes
from stavework.sources import tables as sources
from stavework.streaming import sessions, shard_merge

ROWS = "k int, n int, v string"


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_two_writers_lose_no_row(spark, tmp_path):
    target, schema = str(tmp_path / "target"), spark.createDataFrame([], ROWS).schema
    rng = random.Random(4)
    parts = [[(rng.randrange(60), rng.randrange(1000), f"{w}-{b}-{i}") for i in range(30)] for w in range(3) for b in range(3)]
    problems = []

    def write(w):
        try:
            for b in range(3):
                shard_merge.upsert(spark, target, spark.createDataFrame(parts[3 * w + b], ROWS), ["k"], "n", f"w{w}", b, buckets=4)
        except Exception as problem:  # noqa: BLE001
            problems.append(problem)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not problems
    every = spark.createDataFrame([r for p in parts for r in p], ROWS)
    assert values(shard_merge.latest(spark, target, schema), "k", "n", "v") == values(tables.last_of_each(every, ["k"], "n"), "k", "n", "v")
    log = shard_merge.Log(spark, target)
    assert log.numbers() == list(range(1, 10)) and log.newest().writers == {f"w{w}": 2 for w in range(3)}
    # a batch that comes again is left out, and a number that is taken can't be claimed
    again = shard_merge.upsert(spark, target, spark.createDataFrame([(1, 10_000, "again")], ROWS), ["k"], "n", "w0", 2, buckets=4)
    assert again.number == 9 and not log.claim(shard_merge.Entry(9)) and log.claim(shard_merge.Entry(10, log.newest().buckets))
    before = values(shard_merge.latest(spark, target, schema), "k", "n", "v")
    assert shard_merge.drop_outdated(spark, target) and log.numbers() == [10]
    assert values(shard_merge.latest(spark, target, schema), "k", "n", "v") == before
    assert not [p for p in (tmp_path / "target" / "_log").iterdir() if "draft" in p.name and not p.name.endswith(".crc")]


VOTED = "session string, card string, variant string, clip string, tier string, at timestamp, seq long"


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)


@pytest.mark.parametrize("restart", [False, True])
def test_sessions_survive_a_restart_and_end_as_the_batch(spark, tmp_path, restart):
    rng = random.Random(7)
    rows = []
    for minute in range(40):
        for s in "ab":
            card = f"v{rng.randrange(5)}|c{rng.randrange(3)}"
            variant, clip = card.split("|")
            rows.append((s, rng.choice([card, None, ""]), variant, clip, rng.choice(votes.TIERS), at(minute), len(rows)))
    rows.append(("a", None, None, "c1", "weak_accept", at(3), 900))
    folder, seen, out = (str(tmp_path / x) for x in ("votes", "seen", "out"))
    later = [("z", "v|c", "v", "c", "weak_accept", at(m), m) for m in (500, 900)]  # event time goes on
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in ([rows[:45], rows[45:], later[:1], later[1:]] if restart else [rows, later[:1], later[1:]]):
            spark.createDataFrame(part, VOTED).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(VOTED).option("maxFilesPerTrigger", 1).parquet(folder)
            ended = sessions.ended_sessions(stream, "30 minutes", "0 minutes")
            ended.writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = spark.read.parquet(out).where("session <> 'z'")
    batch = spark.createDataFrame(rows, VOTED)
    for s in "ab":
        own = batch.where(F.col("session") == s).withColumn("at", F.struct("at", "seq"))
        want = votes.merged(own.where("false"), own).select("card", "variant", "clip", "tier")
        got = found.where(F.col("session") == s)
        assert values(got, "card", "variant", "clip", "tier") == values(want, "card", "variant", "clip", "tier")
        order = list(dict.fromkeys(r[1] or f"{r[2]}|{r[3]}" for r in rows if r[0] == s and r[2]))
        assert [r.card for r in got.orderBy("place").collect()] == order


def test_losses_are_counted_on_the_way(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"listener_id": "a", "extra": {"deep": [1, {"er": "x"}]}, "ratings": [{"stem_id": "s", "category": "c", "samples": [{"variant_id": "v", "content": 4, "realism": 3}]}]}')
    (tmp_path / "b.json").write_text('{"listener_id": "b", "complete": false, "ratings": []}')
    (tmp_path / "in_progress_c.json").write_text('{"listener_id": "c", "ratings": []}')
    (tmp_path / "d.json").write_text("{oops")
    (tmp_path / "e.json").write_text(" ")
    (tmp_path / "f.json").write_text("")
    seen = Observation()
    got = sources.ratings_of(sources.complete_documents(spark, str(tmp_path), seen)).collect()
    assert [tuple(r) for r in got] == [("a", "s", "c", "v", 4.0, 3.0)]
    assert seen.get == {"files": 5, "unfinished": 1, "unreadable": 2, "incomplete": 1, "unreadable_files": ["d.json", "e.json"]}
    read = sources.documents(spark, str(tmp_path)).where("problem is null").select("file", "document")
    found = {r.path: r.v for r in sources.fields(read, "document", 9).select("path", F.try_variant_get("value", "$", "string").alias("v")).collect()}
    assert found == {
        "$.listener_id": "a", "$.extra.deep[0]": "1", "$.extra.deep[1].er": "x", "$.ratings[0].stem_id": "s", "$.ratings[0].category": "c",
        "$.ratings[0].samples[0].variant_id": "v", "$.ratings[0].samples[0].content": "4", "$.ratings[0].samples[0].realism": "3",
    }
    shallow = {r.path for r in sources.fields(read, "document", 1).collect()}
    assert shallow == {"$.listener_id", "$.extra", "$.ratings"}
    cast = spark.createDataFrame([(1, "v1", None), (2, "v1", "v2|c"), (3, "v9", None), (4, "v9", "v1|c"), (5, "v1", "v1|c")], "i int, variant string, cascaded_from string")
    seen = Observation()
    kept, gone = votes.sanitised(cast, spark.createDataFrame([("v1",)], "variant string"), seen)
    assert values(kept, "i") == [(1,), (5,)] and seen.get == {"votes": 5, "crossed": 2, "unknown": 1}
    assert tuple(gone.first()) == (2, 1)
