"""Named queries of joins, settings, windows, orders and incremental work, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.functions import arrays, recipe, scale
from stavework.operators import profile, samples, sampling, selection, sequences, tables, votes
from stavework.plans.registry import named
from stavework.sources.tables import table

# ---- filters and settings


@named("SELECT p_partkey FROM part WHERE p_size > 10 AND p_partkey % 3 <> 0 AND p_brand NOT IN ('Brand#11', 'Brand#12') AND p_size BETWEEN 12 AND 30")
def named_subset(spark: SparkSession, d: str) -> DataFrame:
    flagged = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.when(F.col("p_size") > 10, True).alias("all_valid"), (F.col("p_partkey") % 3 != 0).alias("rated_deduplicated"))
    kept = tables.subset(flagged, "rated_deduplicated").where(~F.col("p_brand").isin("Brand#11", "Brand#12"))
    return kept.where(F.col("p_size").between(12, 30)).select("p_partkey")


@named("""
SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_quantity > 10 THEN l_quantity END, 0.0) AS quantity, coalesce(CASE WHEN l_tax > 0.03 THEN l_returnflag END, '') AS flag,
  coalesce(CASE WHEN l_tax > 0.03 THEN l_linestatus = 'O' END, false) AS open FROM lineitem
""")
def fill_and_cast(spark: SparkSession, d: str) -> DataFrame:
    taxed = F.col("l_tax") > 0.03
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("quantity"),
        F.when(taxed, F.col("l_returnflag")).alias("flag"), F.when(taxed, F.col("l_linestatus") == "O").alias("open"),
    )
    return tables.filled(rows, {"quantity": 0, "flag": "", "open": False})


@named("""
WITH t AS (SELECT p_partkey, list_filter([CASE WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'rose') THEN 'warm' END, CASE WHEN contains(lower(p_name), 'blue') THEN 'cold' END,
  CASE WHEN contains(lower(p_name), 'box') THEN 'box' END], lambda x: x IS NOT NULL) AS tags FROM part), u AS (SELECT p_partkey, CASE WHEN len(tags) = 0 THEN ['general'] ELSE tags END AS tags FROM t)
SELECT p_partkey, array_to_string(tags, '+') AS tags FROM u WHERE list_has_any(tags, ['warm', 'general']) ORDER BY p_partkey LIMIT 90
""")
def tags_and_candidates(spark: SparkSession, d: str) -> DataFrame:
    hints = (("warm", ("red", "rose")), ("cold", ("blue",)), ("box", ("box",)))
    parts = table(spark, d, "part").select("p_partkey", tables.tagged(F.col("p_name"), hints).alias("tags"))
    found = tables.candidates(parts, "p_partkey", "tags", "p_partkey", wanted_tags=["warm", "general"], limit=90)
    return found.select("p_partkey", F.array_join("tags", "+").alias("tags"))


@named("""
WITH b AS (SELECT p_partkey AS k, p_brand AS x, p_size AS y FROM part WHERE p_partkey % 3 <> 0), o AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS x, 7 AS y FROM part WHERE p_partkey % 2 = 0)
SELECT k, x, y FROM o UNION ALL SELECT k, x, y FROM b ANTI JOIN o USING (k)
""")
def merged_settings(spark: SparkSession, d: str) -> DataFrame:
    part, key = table(spark, d, "part"), F.col("p_partkey")
    base = part.where(key % 3 != 0).select(key.alias("k"), F.col("p_brand").alias("x"), F.col("p_size").alias("y"))
    override = part.where(key % 2 == 0).select(key.alias("k"), F.when(key % 4 == 0, F.col("p_type")).alias("x"), F.lit(7).alias("y"))
    return tables.merge_settings(base, override, "k", ["x", "y"])


@named("""
WITH s AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 END AS own, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 5 END AS won FROM orders)
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'O' THEN own WHEN o_orderstatus > 'O' THEN won END, 9) AS level FROM s
""")
def phase_setting(spark: SparkSession, d: str) -> DataFrame:
    some = lambda n: F.when(F.col("o_custkey") % n > 0, F.col("o_custkey") % n)
    level = selection.resolved_setting(some(3), F.col("o_orderstatus"), "O", some(5), F.lit(9))
    return table(spark, d, "orders").select("o_orderkey", level.alias("level"))


@named("""
WITH r AS (SELECT o_custkey, o_orderkey, ['one', 'two', 'three', 'four'][(o_orderkey % 4 + 1)::INT] AS phase FROM orders), k AS (SELECT *, CASE phase WHEN 'one' THEN 1 WHEN 'three' THEN 2 WHEN 'four' THEN 3 END AS p FROM r)
SELECT o_custkey, o_orderkey, phase FROM k WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY p DESC, o_orderkey DESC) = 1
""")
def latest_phase(spark: SparkSession, d: str) -> DataFrame:
    phase = F.get(F.array(*map(F.lit, ("one", "two", "three", "four"))), (F.col("o_orderkey") % 4).cast("int"))
    return selection.latest_phase(table(spark, d, "orders").select("o_custkey", "o_orderkey", phase.alias("phase")), "o_custkey", ["one", "three", "four"])


# ---- joins


@named("""
SELECT l.l_orderkey AS k, l.l_linenumber, l.l_quantity AS v_stem, o.o_totalprice AS v_song FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND o.o_orderstatus = 'F'
""")
def suffixed_join(spark: SparkSession, d: str) -> DataFrame:
    stems = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_quantity").alias("v"))
    songs = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return tables.inner_join(stems, songs, ["k"], ("_stem", "_song"))


@named("""
SELECT a.l_partkey AS part, a.l_suppkey AS supp, a.l_orderkey AS o, b.l_orderkey AS o_human FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey
WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A'
""")
def composite_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_orderkey").alias("o"), "l_returnflag")
    one, two = (rows.where(F.col("l_returnflag") == f).drop("l_returnflag") for f in "RA")
    return tables.inner_join(one, two, ["part", "supp"], ("", "_human"))


@named("""
SELECT l_orderkey, l_linenumber, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS priority FROM lineitem
LEFT JOIN (SELECT o_custkey, o_orderdate, o_orderpriority FROM orders) ON o_custkey = l_orderkey % 300 GROUP BY ALL
""".replace("arg_max(o_orderpriority, (o_orderdate, o_orderpriority))", "coalesce(arg_max(o_orderpriority, (o_orderdate, o_orderpriority)), 'none')"))
def lookup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 300).alias("o_custkey"))
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", F.col("o_orderpriority").alias("priority"))
    return tables.lookup(lines.distinct(), orders, ["o_custkey"], "priority", F.lit("none"), "o_orderdate").drop("o_custkey")


@named("""
SELECT DISTINCT o_orderkey, f.c_mktsegment AS segment FROM orders JOIN (SELECT c_custkey, c_mktsegment FROM customer) f ON f.c_custkey = o_custkey
""")
def must_lookup(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return tables.must_lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey").distinct(), customers, ["o_custkey"], "segment").drop("o_custkey")


@named("""
WITH t AS (SELECT 'n' || n_nationkey AS key, n_name AS value FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT 'r' || r_regionkey, r_name FROM region),
a AS (SELECT s_suppkey, unnest([s_nationkey % 30, s_nationkey % 7, 99]) AS n, unnest([1, 2, 3]) AS turn, unnest(['n', 'r', 'r']) AS kind FROM supplier)
SELECT s_suppkey, arg_min(value, turn) AS value FROM a LEFT JOIN t ON key = kind || n GROUP BY 1
""".replace("arg_min(value, turn)", "arg_min(value, turn) FILTER (value IS NOT NULL)"))
def first_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.col("n_name").alias("value"))
    known = known.unionByName(table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.col("r_name").alias("value")))
    asked = [F.concat(F.lit("n"), F.col("s_nationkey") % 30), F.concat(F.lit("r"), F.col("s_nationkey") % 7), F.lit("r99")]
    return tables.first_key_lookup(table(spark, d, "supplier"), known, "s_suppkey", asked, "key", "value")


@named("""
WITH s AS (SELECT l_orderkey AS song, l_linenumber AS track, CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber + 2 END AS original_track FROM lineitem),
q AS (SELECT DISTINCT l_orderkey AS song, (l_orderkey % 9)::INT AS original, 2 AS fallback FROM lineitem WHERE l_orderkey % 2 = 0)
SELECT q.*, coalesce((SELECT min(track) FROM s WHERE s.song = q.song AND coalesce(original_track, track) = original),
  (SELECT min(track) FROM s WHERE s.song = q.song AND track = original), fallback) AS file_track FROM q
""")
def fallback_track(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("l_linenumber")
    stems = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("song"), number.alias("track"), F.when(number % 3 != 0, number + 2).alias("original_track"))
    asked = stems.where("song % 2 = 0").select("song", (F.col("song") % 9).cast("int").alias("original"), F.lit(2).alias("fallback"))
    return tables.fallback_track(asked, stems, "song")


@named("""
WITH t AS (SELECT o_orderkey AS k, o_orderstatus AS fingerprint, o_custkey % 2 = 0 AS fallback, CASE WHEN o_custkey % 7 > 0 THEN o_custkey % 3 > 0 END AS enabled FROM orders)
SELECT k, fingerprint, fallback, enabled, CASE WHEN k % 5 = 0 AND fingerprint = 'F' THEN 'skip' WHEN fallback AND k % 3 = 0 THEN 'copy' WHEN NOT coalesce(enabled, true) THEN 'pass' ELSE 'render' END AS action FROM t
""")
def reuse_decision(spark: SparkSession, d: str) -> DataFrame:
    orders, key, customer = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    tasks = orders.select(key.alias("k"), F.col("o_orderstatus").alias("fingerprint"), (customer % 2 == 0).alias("fallback"), F.when(customer % 7 > 0, customer % 3 > 0).alias("enabled"))
    outputs = orders.where(key % 5 == 0).select(key.alias("k"), F.lit("F").alias("fingerprint"))
    return tables.reuse(tasks, outputs, orders.where(key % 3 == 0).select(key.alias("k")), ["k"])


@named("""
WITH w AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_quantity > 49), a AS (SELECT count(*) AS in_first FROM w WHERE p % 2 = 0 AND p IN (SELECT p_partkey FROM part)),
b AS (SELECT count(*) AS in_second FROM w WHERE p % 2 = 1 AND p IN (SELECT p_partkey FROM part))
SELECT in_first, in_second, CASE WHEN in_first > 0 AND in_first >= in_second THEN 'first' WHEN in_second > 0 THEN 'second' ELSE 'first' END AS chosen FROM a, b
""")
def larger_overlap(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p"))
    first, second = (table(spark, d, "part").where(F.col("p_partkey") % 2 == k).select(F.col("p_partkey").alias("p")) for k in (0, 1))
    return tables.larger_overlap(wanted, first, second, "p")


@named("""
WITH e AS (SELECT l_orderkey, max(l_linenumber) AS expected FROM lineitem GROUP BY 1), f AS (SELECT l.l_orderkey, count(DISTINCT l_linenumber - 1) AS found FROM lineitem l WHERE l_tax > 0.01 GROUP BY 1)
SELECT e.l_orderkey, e.expected, coalesce(found, 0)::BIGINT AS found FROM e LEFT JOIN f USING (l_orderkey) WHERE coalesce(found, 0) < e.expected
""")
def songs_not_covered(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    songs = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("expected"))
    routing = lines.where("l_tax > 0.01").select("l_orderkey", (F.col("l_linenumber") - 1).alias("track"))
    return tables.songs_not_covered(routing, songs, "l_orderkey", "track", "expected")


@named("""
WITH e AS (SELECT l_orderkey, max(l_linenumber) AS expected FROM lineitem GROUP BY 1), f AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS found FROM lineitem WHERE l_tax > 0.01 GROUP BY 1),
u AS (SELECT count(*) AS uncovered FROM e LEFT JOIN f USING (l_orderkey) WHERE coalesce(found, 0) < expected)
SELECT (SELECT count(*) FROM e) AS songs, uncovered, (SELECT count(*) FROM e) >= 100 AND uncovered = 0 AS ready FROM u
""")
def completeness_gate(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    songs = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("expected"))
    routing = lines.where("l_tax > 0.01").select("l_orderkey", (F.col("l_linenumber") - 1).alias("track"))
    return tables.ready(songs, routing, "l_orderkey", "track", "expected", 100)


@named("""
WITH a AS (SELECT 0 AS side, user_id % 50 AS k, event_id AS place, event_type AS v FROM events WHERE event_id % 2 = 0), b AS (SELECT 1 AS side, user_id % 70 AS k, event_id AS place, event_type AS v FROM events WHERE event_id % 2 = 1),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b), f AS (SELECT k, arg_min(place, (side, place)) AS place FROM u GROUP BY 1)
SELECT u.k, f.place, u.v FROM u JOIN f ON f.k = u.k QUALIFY row_number() OVER (PARTITION BY u.k ORDER BY side DESC, u.place DESC) = 1
""")
def keyed_union(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    one, two = (events.where(F.col("event_id") % 2 == k).select((F.col("user_id") % n).alias("k"), F.col("event_id").alias("place"), F.col("event_type").alias("v")) for k, n in ((0, 50), (1, 70)))
    return tables.keyed_union(one, two, ["k"], "place")


@named("SELECT event_type, user_id % 5 AS bucket, min(event_id) AS at FROM events GROUP BY ALL")
def distinct_in_order(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("bucket"), F.col("event_id").alias("at"))
    return tables.distinct_in_order(rules, ["event_type", "bucket"], "at")


@named("""
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0)::BIGINT AS a, coalesce(b.n, 0)::BIGINT AS b FROM (SELECT l_returnflag || l_linestatus AS k, count(*) AS n FROM lineitem WHERE l_tax > 0.07 GROUP BY 1) a
FULL JOIN (SELECT l_returnflag || 'F' AS k, count(*) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k
""")
def union_of_keys(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    one = lines.where("l_tax > 0.07").groupBy(F.concat("l_returnflag", "l_linestatus").alias("k")).agg(F.count("*").alias("a"))
    two = lines.groupBy(F.concat("l_returnflag", F.lit("F")).alias("k")).agg(F.count("*").alias("b"))
    return tables.filled(one.join(two, "k", "full_outer"), {"a": 0, "b": 0})


# ---- profiles and votes


@named("""
WITH t AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS k FROM t),
last AS (SELECT p_brand FROM r ORDER BY k DESC LIMIT 1)
SELECT p_brand, n FROM r WHERE p_brand = (SELECT min(p_brand) FROM part) OR k <= CASE WHEN (SELECT k FROM r WHERE p_brand = (SELECT min(p_brand) FROM part)) <= 6 THEN 6 ELSE 5 END
""")
def top_keeping_one(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return profile.top_keeping(part, "p_brand", 6, part.agg(F.min("p_brand")).first()[0])


@named("""
WITH a AS (SELECT p_brand, 100.0 * count(*) / sum(count(*)) OVER () AS s FROM part WHERE p_size > 25 GROUP BY 1), b AS (SELECT p_brand, 100.0 * count(*) / sum(count(*)) OVER () AS s FROM part WHERE p_size <= 30 GROUP BY 1)
SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, coalesce(a.s, 0.0)::DOUBLE AS share_a, coalesce(b.s, 0.0)::DOUBLE AS share_b FROM a FULL JOIN b ON a.p_brand = b.p_brand ORDER BY share_b DESC, 1 LIMIT 5
""")
def share_compare_top(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    out = profile.share_compare(part.where("p_size > 25"), part.where("p_size <= 30"), "p_brand", 5, "share_b")
    return out.select("p_brand", *(F.col(c).cast("double").alias(c) for c in ("share_a", "share_b")))


@named("""
WITH v AS (SELECT count(*) FILTER (l_quantity <= 20) * 100.0 / count(*) AS a, count(*) FILTER (l_quantity <= 40) * 100.0 / count(*) AS b FROM lineitem)
SELECT CASE WHEN a >= 60 THEN 'small' ELSE 'medium' END AS model, CASE WHEN a >= 60 THEN printf('%.2f%% of values are at most 20', a) ELSE printf('%.2f%% of values are at most 40', b) END AS reason FROM v
""")
def fitting_model(spark: SparkSession, d: str) -> DataFrame:
    return profile.fitting_model(table(spark, d, "lineitem"), F.col("l_quantity"), (("small", 20.0), ("medium", 40.0)), 60.0)


@named("""
WITH t AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS name FROM orders)
SELECT count(name) AS named, count(*) - count(name) AS unnamed, count(DISTINCT name) AS names, count(DISTINCT o_custkey) AS songs, count(name) / count(DISTINCT o_custkey) AS per_song FROM t
""")
def named_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("name"))
    return profile.named_profile(rows, "o_custkey", "name")


_CAST_SQL = """
v AS (SELECT event_id, 'v' || (user_id % 9) AS variant, CASE WHEN event_id % 4 = 0 THEN 'v' || (event_id % 9) || '|x' END AS cascaded_from,
  ['strong_reject', 'weak_reject', 'weak_accept', 'strong_accept', 'other'][length(event_type) % 5 + 1] AS tier FROM events), known AS (SELECT DISTINCT 'v' || (user_id % 6) AS variant FROM events)
"""


def _cast(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    tier = F.get(F.array(*map(F.lit, (*votes.TIERS, "other"))), F.length("event_type") % 5)
    given = events.select(
        "event_id", F.concat(F.lit("v"), F.col("user_id") % 9).alias("variant"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("v"), F.col("event_id") % 9, F.lit("|x"))).alias("cascaded_from"), tier.alias("tier"),
    )
    return given, events.select(F.concat(F.lit("v"), F.col("user_id") % 6).alias("variant"))


@named(f"WITH {_CAST_SQL} SELECT event_id, variant, cascaded_from, tier FROM v SEMI JOIN known USING (variant) WHERE cascaded_from IS NULL OR split_part(cascaded_from, '|', 1) = variant")
def sanitised_votes(spark: SparkSession, d: str) -> DataFrame:
    return votes.sanitised(*_cast(spark, d))[0]


@named(f"""
WITH {_CAST_SQL} SELECT count(*) FILTER (split_part(cascaded_from, '|', 1) <> variant) AS crossed,
  count(*) FILTER (coalesce(split_part(cascaded_from, '|', 1) = variant, true) AND variant NOT IN (FROM known)) AS unknown FROM v
""")
def dropped_votes(spark: SparkSession, d: str) -> DataFrame:
    return votes.sanitised(*_cast(spark, d))[1]


@named(f"""
WITH {_CAST_SQL}, s AS (SELECT DISTINCT 'c' || (event_id % 3) AS category, variant, tier FROM v WHERE tier <> 'other')
SELECT category, variant, string_agg(tier, ',' ORDER BY CASE tier WHEN 'strong_reject' THEN 0 WHEN 'weak_reject' THEN 1 WHEN 'weak_accept' THEN 2 ELSE 3 END) AS tiers FROM s GROUP BY ALL
""")
def tiers_seen(spark: SparkSession, d: str) -> DataFrame:
    given = _cast(spark, d)[0].withColumn("category", F.concat(F.lit("c"), F.col("event_id") % 3))
    return votes.tiers_seen(given).select("category", "variant", F.array_join("tiers", ",").alias("tiers"))


@named("""
SELECT p_partkey, CASE WHEN s >= 80 THEN 90 WHEN s >= 60 THEN 70 WHEN s >= 40 THEN 50 WHEN s >= 20 THEN 30 ELSE 10 END AS midpoint, CASE WHEN s >= 80 THEN 5 WHEN s >= 60 THEN 4 WHEN s >= 40 THEN 3 WHEN s >= 20 THEN 2 ELSE 1 END AS likert,
  CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN s >= 80 THEN 'Very realistic' WHEN s >= 60 THEN 'Realistic' WHEN s >= 40 THEN 'Mixed' WHEN s >= 20 THEN 'Synthetic' ELSE 'Very synthetic' END
    ELSE CASE WHEN s >= 80 THEN 'Identical' WHEN s >= 60 THEN 'Same' WHEN s >= 40 THEN 'Mostly same' WHEN s >= 20 THEN 'Different' ELSE 'Very different' END END AS label
FROM (SELECT p_partkey, least(greatest(round_even(p_size * 2.5, 0), 0), 100) AS s FROM part)
""")
def rating_scale(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("p_size") * 2.5
    return table(spark, d, "part").select("p_partkey", scale.midpoint(score).alias("midpoint"), scale.likert(score).alias("likert"), scale.label(score, F.when(F.col("p_partkey") % 2 == 0, "realism").otherwise("content")).alias("label"))


@named("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'reused:' || o_orderstatus ELSE o_orderstatus END AS source, CASE WHEN o_custkey % 2 = 0 AND o_orderstatus <> 'P' THEN o_orderstatus END AS mode FROM orders")
def reuse_labels(spark: SparkSession, d: str) -> DataFrame:
    source = F.when(F.col("o_custkey") % 2 == 0, recipe.reused_label(F.col("o_orderstatus"))).otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", source.alias("source"), recipe.reused_mode(source, ["F", "O"]).alias("mode"))


# ---- orders and choices


@named("""
SELECT s_suppkey, s_nationkey, (row_number() OVER (ORDER BY coalesce(list_position([7, 3, 11], s_nationkey), 4), s_suppkey))::INT AS place FROM supplier QUALIFY place <= 40
""")
def list_order(spark: SparkSession, d: str) -> DataFrame:
    first = tables.by_list(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", [7, 3, 11], "s_suppkey").limit(40)
    place = F.array_position(F.array(F.lit(7), F.lit(3), F.lit(11)), F.col("s_nationkey"))
    # the forty rows are numbered again by the same rule
    return sequences.dense_index(first.withColumn("p", F.when(place > 0, place).otherwise(4)).withColumn("g", F.lit(0)), "g", "p", "s_suppkey").select(
        "s_suppkey", "s_nationkey", (F.col("index") + 1).alias("place")
    )


@named("""
SELECT s_suppkey, md5('5|' || s_suppkey) AS shuffled, md5('5|' || s_nationkey) || '|' || md5('5|' || s_suppkey) AS grouped, printf('%020d', s_suppkey) AS plain FROM supplier
""")
def card_orders(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    for mode, name in (("shuffle", "shuffled"), ("group", "grouped"), ("sequential", "plain")):
        cards = sampling.card_order(cards, mode, 5, "s_suppkey", "s_suppkey", "s_nationkey").withColumnRenamed("turn", name)
    return cards.drop("s_nationkey")


@named("""
SELECT o_orderkey, ['a', 'b', 'c', 'd', 'e'][('0x' || substr(md5(concat_ws('|', '11', o_orderpriority, o_custkey)), 1, 12))::BIGINT % 5 + 1] AS choice FROM orders
""")
def seeded_choice(spark: SparkSession, d: str) -> DataFrame:
    choices = F.array(*map(F.lit, "abcde"))
    return table(spark, d, "orders").select("o_orderkey", sampling.seeded_choice(choices, 11, "o_orderpriority", "o_custkey").alias("choice"))


@named("""
SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY (p_type <> 'PROMO')::INT, md5('3|' || p_partkey), p_partkey))::INT AS rank FROM part WHERE p_size > 20 QUALIFY rank <= 4
""")
def preferred_then_random(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_type") == "PROMO").alias("liked"), (F.col("p_size") > 20).alias("usable"))
    return sampling.preferred_first(parts, "p_brand", "liked", "usable", 4, 3, "p_partkey").select("p_brand", "p_partkey", "rank")


@named("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS key, o_totalprice > 250000 AS alone FROM orders),
w AS (SELECT *, row_number() OVER w AS rn, lag(key) OVER w AS pk, coalesce(lag(alone) OVER w, false) AS pa FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
i AS (SELECT *, sum((rn = 1 OR key IS DISTINCT FROM pk OR alone OR pa)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM w),
p AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey, island ORDER BY o_orderkey) - 1) % 3 = 0 AS opens FROM i)
SELECT o_orderkey, o_custkey, (sum(opens::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::BIGINT AS batch FROM p
""")
def batches_with_long_tasks(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    out = sequences.run_batches(tasks, "o_custkey", "o_orderpriority", 3, "o_orderkey", alone=F.col("o_totalprice") > 250_000)
    return out.select("o_orderkey", "o_custkey", "batch")


@named("""
SELECT p_size AS level, coalesce(lag(p_size) OVER (ORDER BY p_size), p_size) AS lower, coalesce(lead(p_size) OVER (ORDER BY p_size), p_size) AS higher FROM (SELECT DISTINCT p_size FROM part)
""")
def nearest_levels(spark: SparkSession, d: str) -> DataFrame:
    return sequences.nearest_levels(table(spark, d, "part").select(F.col("p_size").alias("level")), "level")


# ---- windows and samples


def _hops(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("hop", "v"))
    return x.select("vec_id", "hop", (F.floor(F.abs(F.col("v").cast("double")) * 1000) / 1000).alias("energy"))


_HOPS_SQL = "h AS (SELECT vec_id, unnest(range(64))::INT AS hop, floor(abs(unnest(embedding)::DOUBLE) * 1000) / 1000 AS energy FROM embeddings)"


@named(f"""
WITH {_HOPS_SQL}, w AS (SELECT a.vec_id, a.hop, sqrt(sum(b.energy::DECIMAL(18,3))::DOUBLE / 8) AS rms, sum((sqrt(b.energy) >= 0.28)::INT) / 8 AS active, count(*) AS held
  FROM h a JOIN h b ON b.vec_id = a.vec_id AND b.hop BETWEEN a.hop AND a.hop + 7 WHERE a.hop >= 2 AND (a.hop - 2) % 3 = 0 GROUP BY a.vec_id, a.hop),
ok AS (SELECT * FROM w WHERE held = 8 AND rms >= 0.28 AND active >= 0.5)
SELECT vec_id, min(hop) AS first, arg_max(hop, (active, -hop)) AS densest FROM ok GROUP BY 1
""")
def audible_clip_start(spark: SparkSession, d: str) -> DataFrame:
    exact = _hops(spark, d).withColumn("energy", F.col("energy").cast("decimal(18,3)"))
    windows = selection.audible_windows(exact, "vec_id", 8, 3, 0.28, 0.5, first=2)
    first, densest = (selection.clip_start(windows, "vec_id", dense) for dense in (False, True))
    return first.withColumnRenamed("hop", "first").join(densest.withColumnRenamed("hop", "densest"), "vec_id")


@named("""
WITH s AS (SELECT event_id, value / 100 AS rms, (user_id % 10) / 10 AS active, event_id % 4 AS onsets, (event_id % 60)::DOUBLE AS start, 90.0::DOUBLE AS duration FROM events)
SELECT event_id, round(CASE WHEN rms >= 0.05 THEN 2 * rms + active + 0.25 * onsets / 10 - CASE WHEN start < 10 THEN 0.35 * (1 - start / 10) ELSE 0 END
  - CASE WHEN start + 10 > 80 THEN 0.35 * (1 - greatest(80 - start, 0) / 10) ELSE 0 END END, 9) AS score FROM s
""")
def clip_window_scores(spark: SparkSession, d: str) -> DataFrame:
    event = F.col("event_id")
    score = selection.window_score(F.col("value") / 100, (F.col("user_id") % 10) / 10, event % 4, (event % 60).cast("double"), 10.0, F.lit(90.0), 0.05)
    return table(spark, d, "events").select("event_id", F.round(score, 9).alias("score"))


@named("""
SELECT vec_id, list_transform(range(1, 33), lambda i: (embedding[i]::DOUBLE + embedding[i + 32]::DOUBLE) / 2) AS mono,
  CASE WHEN len(embedding) > 0 THEN 20 * log10(list_max(list_transform(embedding[1:40], lambda x: abs(x::DOUBLE))) + 1e-10) END AS db, list_transform(range(1, 49), lambda i: CASE WHEN i <= 40 THEN embedding[i]::DOUBLE ELSE 0.0 END) AS padded FROM embeddings
""")
def waveform_arrays(spark: SparkSession, d: str) -> DataFrame:
    x, some = F.col("embedding"), F.slice("embedding", 1, 40)
    return table(spark, d, "embeddings").select(
        "vec_id", arrays.mono(F.slice(x, 1, 32), F.slice(x, 33, 32)).alias("mono"), arrays.peak_db(some).alias("db"), arrays.padded(some, F.lit(48)).alias("padded")
    )


@named("""
SELECT vec_id, len(list_filter([0.1, 0.35, 2.0, -1.0], lambda t: abs(embedding[least(greatest(round_even(t * 50, 0), 0), 63)::INT + 1]::DOUBLE) >= 0.1)) AS n FROM embeddings
""")
def active_onsets(spark: SparkSession, d: str) -> DataFrame:
    active = F.transform("embedding", lambda v: F.abs(v.cast("double")) >= 0.1)
    onsets = F.array(*map(F.lit, (0.1, 0.35, 2.0, -1.0)))
    return table(spark, d, "embeddings").select("vec_id", F.size(arrays.active_onsets(onsets, active, 50)).cast("long").alias("n"))


@named("""
WITH y AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT *, pos % 3 = 0 AS silent FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY vec_id) AS n FROM m WHERE silent)
SELECT vec_id, max(n) AS samples, max(n) / 8 AS seconds, max(20 * log10(abs(v) + 1e-10)) FILTER ((k - 1) % greatest(n // 100, 1) = 0) AS max_db, false AS passes FROM r GROUP BY 1
""")
def silence_scores(spark: SparkSession, d: str) -> DataFrame:
    waves = table(spark, d, "embeddings")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.size("embedding") - F.lit(1).cast("long"), F.lit(3).cast("long")))
    silent = waves.select("vec_id", every.alias("start")).withColumn("end", F.col("start") + 1)
    return samples.silence_score(samples.blocks(waves, "vec_id", "embedding", block=20), silent, "vec_id", "embedding", 8, 20)


@named("""
WITH x AS (SELECT label, vec_id, unnest(range(64))::INT AS pos, unnest(embedding)::DECIMAL(18,6) AS v FROM embeddings), s AS (SELECT label, pos, sum(v) AS s FROM x GROUP BY ALL),
g AS (SELECT label, CASE WHEN max(abs(s)) > 1 THEN 1.0::DOUBLE / max(abs(s))::DOUBLE ELSE 1.0 END AS gain FROM s GROUP BY 1)
SELECT label, vec_id, max(abs(v))::DOUBLE * max(gain) AS peak FROM x JOIN g USING (label) GROUP BY ALL
""")
def stems_with_mixture_gain(spark: SparkSession, d: str) -> DataFrame:
    waves = table(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda v: v.cast("decimal(18,6)")))
    named = waves.select(F.struct("label", "vec_id").alias("stem"), "embedding")
    stems = samples.blocks(named, "stem", "embedding", block=24).select("stem.label", "stem.vec_id", "block", "embedding")
    louder = samples.with_gain(stems, samples.mixture_gain(stems, "label", "embedding"), "label", "embedding")
    return louder.groupBy("label", "vec_id").agg(F.max(F.array_max(F.transform("embedding", F.abs))).alias("peak"))


# ---- catalogs


@named("""
SELECT l_orderkey, string_agg(c, ',' ORDER BY p) AS categories FROM (SELECT DISTINCT l_orderkey, l_shipmode AS c, list_position(['R', 'A'], l_shipmode) AS p
  FROM (SELECT l_orderkey, l_returnflag AS l_shipmode FROM lineitem) WHERE l_shipmode IN ('R', 'A')) GROUP BY 1
""")
def categories_in_order(spark: SparkSession, d: str) -> DataFrame:
    out = tables.ordered_categories(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["R", "A"])
    return out.select("l_orderkey", F.array_join("categories", ",").alias("categories"))


@named("""
SELECT p_partkey AS id, 'late' AS source, p_brand FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'core', p_brand FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0
""")
def catalog_union(spark: SparkSession, d: str) -> DataFrame:
    part, key = table(spark, d, "part"), F.col("p_partkey")
    core, late = (part.where(key % n == 0).select(key.alias("id"), F.lit(s).alias("source"), "p_brand") for n, s in ((2, "core"), (3, "late")))
    return tables.catalog_union(core, late, "id")


@named("""
SELECT page_id, c.unnest AS condition, c.unnest || CASE WHEN contains(url, '/') THEN substr(url, strpos(url, '/')) ELSE '' END AS url FROM pages, unnest(['basic', 'slakh']) c
""")
def condition_fan_out(spark: SparkSession, d: str) -> DataFrame:
    return tables.fan_out(table(spark, d, "pages").select("page_id", "url"), ["basic", "slakh"], "url").select("page_id", "condition", "url")


@named("SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS items FROM lineitem WHERE l_tax > 0.02 GROUP BY 1")
def category_coverage(spark: SparkSession, d: str) -> DataFrame:
    return tables.coverage(table(spark, d, "lineitem").withColumn("active", F.col("l_tax") > 0.02), "l_returnflag", "l_suppkey", "active")


@named("""
WITH o AS (SELECT o_orderpriority, o_custkey % 4 AS n, o_orderkey % 2 = 0 AS ok FROM orders)
SELECT o_orderpriority, sum(n)::BIGINT AS attempts, count(*) FILTER (ok AND n > 0) AS passed, sum(n)::BIGINT - count(*) FILTER (ok AND n > 0) AS failed, count(*) FILTER (n = 0) AS passed_through FROM o GROUP BY 1
""")
def attempt_counts(spark: SparkSession, d: str) -> DataFrame:
    n, ok = (F.col("o_custkey") % 4).cast("int"), F.col("o_orderkey") % 2 == 0
    tried = F.when(n > 0, F.concat(F.array_repeat(F.lit(False), n - 1), F.array(ok)))
    return tables.attempt_counts(table(spark, d, "orders").select("o_orderpriority", tried.alias("tried")), "o_orderpriority", "tried")


@named("""
SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'b' ELSE 'a' END AS winner, CASE WHEN o_custkey % 3 > 0 THEN 'yes' END AS done, CASE WHEN o_custkey % 2 = 0 THEN 'now' END AS stamp FROM orders
""")
def recorded_winners(spark: SparkSession, d: str) -> DataFrame:
    customer = F.col("o_custkey")
    old = F.map_filter(F.create_map(F.lit("winner"), F.lit("a"), F.lit("done"), F.when(customer % 3 > 0, F.lit("yes"))), lambda _, v: v.isNotNull())
    new = F.when(customer % 2 == 0, F.create_map(F.lit("winner"), F.lit("b"), F.lit("stamp"), F.lit("now")))
    done = table(spark, d, "orders").select("o_orderkey", tables.recorded(old, new).alias("m"))
    return done.select("o_orderkey", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("winner", "done", "stamp")))
