"""Queries of the readers and sinks of files: given tables are written in their formats and read again.

Files go to a new folder of the session's shared one. What is written as one file each
(documents, reports, settings) comes from tables with a bounded number of rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stavework.plans.registry import named
from stavework.sources import files, tables
from stavework.sources.tables import table, write_csv
from stavework.streaming import sessions, shard_merge

PARTS = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_size", T.IntegerType()), T.StructField("p_retailprice", T.DoubleType())])


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts with cells that are missing, in the schema's order."""
    odd = table(spark, d, "part").withColumns({"p_name": F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")), "p_size": F.when(F.col("p_partkey") % 4 > 0, F.col("p_size"))})
    return odd.select(*PARTS.names)


_PARTS_SQL = "p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS p_name, CASE WHEN p_partkey % 4 > 0 THEN p_size END AS p_size, p_retailprice FROM part)"


@named(f"WITH {_PARTS_SQL} SELECT p_size AS size, p_partkey AS key, NULL::VARCHAR AS note FROM p")
def csv_projection(spark: SparkSession, d: str) -> DataFrame:
    write_csv(_parts(spark, d), folder := files.scratch(spark))
    wanted = T.StructType([T.StructField("p_size", T.IntegerType()), T.StructField("p_partkey", T.LongType()), T.StructField("note", T.StringType())])
    return tables.with_columns(tables.read_csv(spark, folder, PARTS), wanted).toDF("size", "key", "note")


@named(f"WITH {_PARTS_SQL} SELECT p_partkey::VARCHAR AS p_partkey, p_retailprice::VARCHAR AS p_retailprice FROM p WHERE p_partkey % 5 = 0")
def csv_without_columns(spark: SparkSession, d: str) -> DataFrame:
    write_csv(_parts(spark, d).withColumn("usable", F.when(F.col("p_partkey") % 5 == 0, True).when(F.col("p_partkey") % 5 == 1, False)), folder := files.scratch(spark))
    return files.read_csv_except(spark, folder, ["p_name", "p_size"], "usable")


@named(f"WITH {_PARTS_SQL} SELECT p_partkey, p_name, p_size, NULL::DOUBLE AS p_retailprice, 'p_partkey,p_name,p_size' AS header FROM p")
def csv_missing_or_narrow(spark: SparkSession, d: str) -> DataFrame:
    folder = files.scratch(spark)
    write_csv(_parts(spark, d).drop("p_retailprice"), f"{folder}/narrow")
    files.write_text(spark, f"{folder}/empty", "")
    read = [files.read_csv_or_empty(spark, f"{folder}/{name}", PARTS) for name in ("narrow", "none", "empty")]
    return read[0].unionByName(read[1]).unionByName(read[2]).withColumn("header", F.lit(",".join(files.header(spark, f"{folder}/narrow"))))


@named("""
SELECT 'a/' || l_orderkey AS song_id, l_linenumber AS track, NULL::INT AS original_track, CASE WHEN l_suppkey % 2 = 0 THEN (l_suppkey % 128)::INT ELSE 0 END AS program, coalesce(l_linestatus = 'F' AND l_suppkey % 3 > 0, false) AS is_drum, l_returnflag AS name
FROM lineitem WHERE l_linenumber > 1
""")
def track_map_versions(spark: SparkSession, d: str) -> DataFrame:
    folder, supplier = files.scratch(spark), F.col("l_suppkey")
    old = table(spark, d, "lineitem").select(
        F.concat(F.lit("./mid/a/"), "l_orderkey", F.lit(".mid")).alias("mid"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("track"),
        F.when(supplier % 2 == 0, (supplier % 128).cast("int")).alias("program"), F.when(supplier % 3 > 0, F.col("l_linestatus") == "F").alias("is_drum"), F.col("l_returnflag").alias("name"),
    )
    write_csv(old, f"{folder}/old")
    return files.read_track_map(spark, [f"{folder}/new", f"{folder}/old"])


@named("SELECT 'responses_' || lpad(n_nationkey::VARCHAR, 2, '0') || '.json' AS name, length(n_name) + 2 AS size, (row_number() OVER (ORDER BY n_nationkey DESC) - 1)::INT AS place FROM nation WHERE n_nationkey % 7 > 0")
def response_listing(spark: SparkSession, d: str) -> DataFrame:
    folder = files.scratch(spark)
    for r in files.small_rows(table(spark, d, "nation")):
        name = f"responses_{r.n_nationkey:02d}" if r.n_nationkey % 7 else f"in_progress_{r.n_nationkey}"
        files.write_text(spark, f"{folder}/{name}.json", json.dumps(r.n_name))
    found = files.listing(spark, folder, "*.json").select("name", "size")
    # of a folder's names
    return found.select("name", "size", (F.row_number().over(Window.orderBy(F.desc("name"))) - 1).alias("place"))


@named("""
SELECT 'l' || n_nationkey AS listener_id, 's' || s_suppkey AS stem_id, 'r' || n_regionkey AS category, 'v' || (s_suppkey % 3) AS variant_id, s_acctbal AS content, NULL::DOUBLE AS realism
FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 5 NOT IN (1, 2, 3)
""")
def rating_documents(spark: SparkSession, d: str) -> DataFrame:
    folder = files.scratch(spark)
    samples = F.array(F.struct(F.concat(F.lit("v"), F.col("s_suppkey") % 3).alias("variant_id"), F.col("s_acctbal").alias("content")))
    rating = F.struct(F.concat(F.lit("s"), "s_suppkey").alias("stem_id"), F.concat(F.lit("r"), "n_regionkey").alias("category"), samples.alias("samples"))
    joined = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    documents = joined.groupBy("n_nationkey").agg(F.collect_list(rating).alias("ratings"))
    whole = F.to_json(F.struct(F.concat(F.lit("l"), "n_nationkey").alias("listener_id"), (F.col("n_nationkey") % 5 != 2).alias("complete"), "ratings"))
    for r in files.small_rows(documents.select("n_nationkey", whole.alias("text"))):  # one file for each nation
        name = f"in_progress_{r.n_nationkey}" if r.n_nationkey % 5 == 1 else f"responses_{r.n_nationkey}"
        files.write_text(spark, f"{folder}/{name}.json", r.text[: len(r.text) // 2] if r.n_nationkey % 5 == 3 else r.text)
    return tables.ratings_of(tables.complete_documents(spark, files.document_paths(spark, [folder, folder])))


@named("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS position, n_name AS name, n_regionkey::VARCHAR AS region, NULL::VARCHAR AS note FROM nation")
def settings_entries(spark: SparkSession, d: str) -> DataFrame:
    path = f"{files.scratch(spark)}/settings.json"
    rows = sorted(files.small_rows(table(spark, d, "nation")), key=lambda r: r.n_nationkey)
    files.write_text(spark, path, json.dumps({r.n_name: {"region": str(r.n_regionkey)} for r in rows}))
    text = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "region", "note")])
    return files.settings_table(spark, files.settings(spark, path), text)


@named("SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 0")
def newest_sweep(spark: SparkSession, d: str) -> DataFrame:
    folder, rows = files.scratch(spark), table(spark, d, "region")
    write_csv(rows, f"{folder}/a/old.csv")
    write_csv(rows.where("r_regionkey > 0"), f"{folder}/b/manifest.csv")
    kinds = T.StructType([T.StructField("r_regionkey", T.IntegerType()), T.StructField("r_name", T.StringType())])
    return tables.read_csv(spark, f"{files.newest_folder(spark, folder, 'manifest.csv')}/manifest.csv", kinds)


@named(f"WITH {_PARTS_SQL} SELECT p_partkey, p_name, p_size, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS p_retailprice FROM p")
def appended_rows(spark: SparkSession, d: str) -> DataFrame:
    folder, rows = files.scratch(spark), _parts(spark, d)
    files.append_rows(rows.where("p_partkey % 2 = 0").withColumn("more", F.lit(1)), folder, PARTS)
    files.append_rows(rows.where("p_partkey % 2 = 1").drop("p_retailprice"), folder, PARTS)
    return tables.read_csv(spark, folder, PARTS)


@named("SELECT 'new/' || s_suppkey AS path, s_nationkey AS track, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'else/' || s_suppkey, s_nationkey, s_name FROM supplier WHERE s_suppkey % 2 = 1")
def copied_tables(spark: SparkSession, d: str) -> DataFrame:
    root, key = files.scratch(spark), F.col("s_suppkey")
    where = F.when(key % 2 == 0, F.concat(F.lit(f"{root}/old/"), key)).otherwise(F.concat(F.lit("else/"), key))
    write_csv(table(spark, d, "supplier").select(where.alias("path"), F.col("s_nationkey").alias("track"), F.col("s_name").alias("name")), f"{root}/old/stems")
    kinds = T.StructType([T.StructField("path", T.StringType()), T.StructField("track", T.IntegerType()), T.StructField("name", T.StringType())])
    files.copy_tables(spark, f"{root}/old", f"{root}/new", {"stems": kinds, "none": kinds})
    moved = tables.read_csv(spark, f"{root}/new/stems", kinds)
    return moved.withColumn("path", F.regexp_replace("path", "^.*/new/", "new/"))


@named("""
SELECT o_orderpriority AS priority, count(*) AS n, (SELECT count(*) FROM orders) AS all_orders, NULL::DOUBLE AS nothing FROM orders GROUP BY 1
""")
def order_report(spark: SparkSession, d: str) -> DataFrame:
    folder, orders = files.scratch(spark), table(spark, d, "orders")
    by = orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    summary = orders.agg(F.count("*").alias("all_orders"), F.lit(float("nan")).alias("nothing"))
    files.write_report(spark, folder, "report", summary, {"by_priority": by})
    totals = spark.read.option("multiLine", True).schema("all_orders long, nothing double").json(f"{folder}/report.json")
    kinds = T.StructType([T.StructField("priority", T.StringType()), T.StructField("n", T.LongType())])
    return tables.read_csv(spark, f"{folder}/by_priority", kinds).join(F.broadcast(totals))  # one row


@named("SELECT n_name AS name, n_regionkey AS region, true AS stamped FROM nation")
def stamped_documents(spark: SparkSession, d: str) -> DataFrame:
    folder = files.scratch(spark)
    for r in files.small_rows(table(spark, d, "nation")):
        files.write_document(spark, f"{folder}/{r.n_nationkey}.json", {"name": r.n_name, "region": r.n_regionkey})
    read = spark.read.option("multiLine", True).schema("generated_at timestamp, name string, region int").json(folder)
    return read.select("name", "region", F.col("generated_at").isNotNull().alias("stamped"))


@named("SELECT r_regionkey, r_name, 'merged' AS gone, false AS still FROM region")
def shards_without_derived(spark: SparkSession, d: str) -> DataFrame:
    folder, rows = files.scratch(spark), table(spark, d, "region")
    for name in ("merged", "shard_0"):
        write_csv(rows, f"{folder}/{name}")
    gone, still = files.drop_derived(spark, folder, ["merged", "other"]), files.exists(spark, f"{folder}/merged")
    kinds = T.StructType([T.StructField("r_regionkey", T.IntegerType()), T.StructField("r_name", T.StringType())])
    return tables.read_csv(spark, f"{folder}/shard_0", kinds).withColumns({"gone": F.lit(",".join(gone)), "still": F.lit(still)})


@named("SELECT r_regionkey, true AS fresh, false AS older, false AS lacking, false AS of_old_engine FROM region")
def cache_decision(spark: SparkSession, d: str) -> DataFrame:
    folder, rows = files.scratch(spark), table(spark, d, "region")
    write_csv(rows, f"{folder}/source")
    write_csv(rows.withColumn("old_engine", F.lit(1)), f"{folder}/cache")
    ask = lambda *more: F.lit(files.is_current(spark, *more))
    found = {
        "fresh": ask(f"{folder}/cache", [f"{folder}/source"], ["r_name"]), "older": ask(f"{folder}/none", [f"{folder}/source"]),
        "lacking": ask(f"{folder}/cache", [f"{folder}/source"], ["else"]), "of_old_engine": ask(f"{folder}/cache", [], [], ["old_engine"]),
    }
    return rows.select("r_regionkey").withColumns(found)


_KEYS = ["l_orderkey", "l_linenumber"]
_LAST_SQL = """
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey DESC, l_quantity DESC, l_returnflag DESC) = 1
"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*_KEYS, "l_suppkey", "l_quantity", "l_returnflag")


@named(_LAST_SQL)
def streamed_shards(spark: SparkSession, d: str) -> DataFrame:
    folder, lines = files.scratch(spark), _lines(spark, d)
    for k in range(2):
        lines.where(F.col("l_suppkey") % 2 == k).write.mode("append").parquet(f"{folder}/shards")
        shard_merge.merge_shards(spark, f"{folder}/shards", f"{folder}/table", lines.schema, _KEYS, "l_suppkey", f"{folder}/seen", buckets=4).awaitTermination()
    return shard_merge.latest(spark, f"{folder}/table", lines.schema)


@named(_LAST_SQL)
def writers_of_one_table(spark: SparkSession, d: str) -> DataFrame:
    folder, lines = files.scratch(spark), _lines(spark, d)
    for k in (1, 0, 1):  # the second of a writer's equal numbers is left out
        shard_merge.upsert(spark, folder, lines.where(F.col("l_suppkey") % 2 == k), _KEYS, "l_suppkey", f"writer {k}", 7, buckets=4)
    return shard_merge.latest(spark, folder, lines.schema)


@named("""
WITH v AS (SELECT 's' || (user_id % 9) AS session, (event_id % 4) || '|' || (user_id % 3) AS card, event_type AS tier, event_id AS seq FROM events WHERE event_id % 11 > 0),
f AS (SELECT session, card, min(seq) AS first FROM v GROUP BY ALL)
SELECT session, (row_number() OVER (PARTITION BY session ORDER BY first) - 1)::BIGINT AS place, card, arg_max(tier, seq) AS tier FROM v JOIN f USING (session, card) GROUP BY session, card, first
""")
def session_votes(spark: SparkSession, d: str) -> DataFrame:
    folder = files.scratch(spark)
    given = table(spark, d, "events").where("event_id % 11 > 0").select(
        F.concat(F.lit("s"), F.col("user_id") % 9).alias("session"), F.lit("").alias("card"), (F.col("event_id") % 4).cast("string").alias("variant"),
        (F.col("user_id") % 3).cast("string").alias("clip"), F.col("event_type").alias("tier"), F.timestamp_seconds(F.floor(F.col("event_id") / 1_000) + 1_700_000_000).alias("at"), F.col("event_id").alias("seq"),
    )
    given.write.parquet(f"{folder}/votes")
    # event time goes on by a vote of another session, long after
    last = given.agg(F.max("at").alias("at")).select(F.lit("z").alias("session"), F.lit("z").alias("card"), F.lit("z").alias("variant"), F.lit("z").alias("clip"), F.lit("z").alias("tier"), (F.col("at") + F.expr("interval 30 days")).alias("at"), F.lit(0).cast("long").alias("seq"))
    name, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, rocks)  # keyed state of several columns needs it
    try:
        for more in (None, last, last.withColumn("at", F.col("at") + F.expr("interval 30 days"))):
            if more is not None:
                more.write.mode("append").parquet(f"{folder}/votes")
            stream = spark.readStream.schema(given.schema).parquet(f"{folder}/votes")
            ended = sessions.ended_sessions(stream, "1 day", "0 seconds").writeStream.format("parquet").option("path", f"{folder}/ended").option("checkpointLocation", f"{folder}/seen")
            ended.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(sessions.VOTES).parquet(f"{folder}/ended").where("session <> 'z'").select("session", "place", "card", "tier")
