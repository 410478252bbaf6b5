"""Named queries of manifests, probes, payloads and updates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.functions import names
from stavework.operators import manifest, ratings, sampling, tables, verification, votes
from stavework.plans.registry import named
from stavework.sources import files
from stavework.sources.tables import table


def _variants(spark: SparkSession, d: str) -> DataFrame:
    """Lines as a manifest: parts are stems, suppliers variants, and a line's number its place."""
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("stem_id"), F.col("l_suppkey").alias("variant_id"), F.col("l_returnflag").alias("category"), place.alias("place"), "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_shipdate"
    )


@named("""
WITH s AS (SELECT 'p' || (p_partkey % 150) AS id, CASE WHEN p_partkey % 11 > 0 THEN p_brand END AS category, p_type AS song_id, p_size % 7 AS track, p_size % 5 = 0 AS legacy,
  CASE WHEN p_partkey % 3 = 0 THEN 'odd' ELSE 'fit' END AS gm_class FROM part), live AS (SELECT * FROM s WHERE NOT legacy),
n AS (SELECT c AS needed, k.n FROM (SELECT unnest(['Brand#11', 'Brand#12', 'Brand#13', 'none']) AS c) LEFT JOIN (SELECT category, count(*) AS n FROM live GROUP BY 1) k ON k.category = c)
SELECT needed AS subject, 'missing category' AS problem FROM n WHERE n IS NULL UNION ALL SELECT needed, 'too few' FROM n WHERE n < 8 UNION ALL SELECT needed, 'too many' FROM n WHERE n > 8
UNION ALL SELECT id, 'repeated id' FROM s GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT song_id || '/' || track, 'repeated stem' FROM live WHERE category IS NOT NULL GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT DISTINCT song_id || '/' || track, 'legacy stem in use' FROM s WHERE legacy AND song_id || '/' || track IN (SELECT song_id || '/' || track FROM live)
UNION ALL SELECT id, 'incomplete' FROM s WHERE category IS NULL
UNION ALL SELECT id, 'class not allowed' FROM live WHERE category IS NOT NULL AND (gm_class <> 'fit' OR category NOT IN ('Brand#11', 'Brand#12', 'Brand#13', 'none'))
""")
def probe_problems(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    stems = table(spark, d, "part").select(
        F.concat(F.lit("p"), key % 150).alias("id"), F.when(key % 11 > 0, F.col("p_brand")).alias("category"), F.col("p_type").alias("song_id"), (F.col("p_size") % 7).alias("track"),
        (F.col("p_size") % 5 == 0).alias("legacy"), F.when(key % 3 == 0, "odd").otherwise("fit").alias("gm_class"),
    )
    return manifest.probe_problems(stems, dict.fromkeys(("Brand#11", "Brand#12", "Brand#13", "none"), ["fit"]), 8)


@named("SELECT DISTINCT p_brand AS id FROM part WHERE p_size > 45")
def legacy_ids(spark: SparkSession, d: str) -> DataFrame:
    return manifest.legacy_ids(table(spark, d, "part").select(F.col("p_brand").alias("id"), (F.col("p_size") > 45).alias("legacy")))


@named("""
WITH s AS (SELECT s_suppkey AS position, (s_suppkey % 3)::INT AS category, 'n' || s_nationkey AS song_id, s_suppkey AS track, s_suppkey % 4 = 0 AS usable, CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey * 0.5 END AS later FROM supplier),
c AS (SELECT DISTINCT (p_partkey % 3)::INT AS category, 'n' || (p_partkey % 25) AS song_id, p_partkey AS track FROM part), f AS (SELECT * FROM c ANTI JOIN s USING (song_id, track)),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('5|' || song_id || '|' || track)) AS rank FROM f), n AS (SELECT position, category, row_number() OVER (PARTITION BY category ORDER BY position) AS rank FROM s WHERE NOT usable AND later IS NULL)
SELECT position, category, song_id, track, CASE WHEN NOT usable THEN later END::DOUBLE AS clip_start, CASE WHEN usable THEN 'keep' ELSE 'clip' END AS action FROM s WHERE usable OR later IS NOT NULL
UNION ALL SELECT position, category, song_id, track, NULL, 'replace' FROM n JOIN r USING (category, rank)
""")
def replaced_picks(spark: SparkSession, d: str) -> DataFrame:
    key, part = F.col("s_suppkey"), F.col("p_partkey")
    stems = table(spark, d, "supplier").select(
        key.alias("position"), (key % 3).cast("int").alias("category"), F.concat(F.lit("n"), "s_nationkey").alias("song_id"), key.alias("track"), (key % 4 == 0).alias("usable"),
        F.when(key % 4 == 1, key * F.lit(0.5)).alias("later_start"),
    )
    pool = table(spark, d, "part").select((part % 3).cast("int").alias("category"), F.concat(F.lit("n"), part % 25).alias("song_id"), part.alias("track"))
    return manifest.replaced_picks(stems, pool, 5)


@named("""
WITH m AS (SELECT DISTINCT l_orderkey AS song_id, l_returnflag AS condition FROM lineitem), w AS (SELECT song_id FROM m GROUP BY 1 HAVING count(*) = 3), f AS (SELECT o_orderkey AS song_id FROM orders WHERE o_totalprice > 1000 AND o_orderkey IN (SELECT song_id FROM w)),
r AS (SELECT song_id, row_number() OVER (ORDER BY md5('43|' || song_id)) AS n FROM f) SELECT printf('mix_%02d', n) AS id, song_id FROM r WHERE n <= 12
""")
def mixture_trials(spark: SparkSession, d: str) -> DataFrame:
    songs = table(spark, d, "orders").select(F.col("o_orderkey").alias("song_id"), (F.col("o_totalprice") > 1000).alias("audible"))
    mixtures = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("song_id"), F.col("l_returnflag").alias("condition"))
    return manifest.mixture_trials(songs, mixtures, ["A", "N", "R"], 12, 43)


@named("""
SELECT l_suppkey AS variant_id, l_partkey AS stem_id, l_quantity, i::INT AS index, printf('%d/%d_clip%02d', l_suppkey, l_partkey, i) AS clip_path
FROM lineitem JOIN (SELECT p_partkey, unnest([1, 2]) AS i FROM part WHERE p_size > 20) ON l_partkey = p_partkey
""")
def manifest_clips(spark: SparkSession, d: str) -> DataFrame:
    clips = table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("stem_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("index"))
    return manifest.manifest_clips(_variants(spark, d).select("variant_id", "stem_id", "l_quantity"), clips)


@named("""
WITH s AS (SELECT l_orderkey AS o, l_linenumber AS track, CASE WHEN l_tax > 0.04 THEN 'drums' WHEN l_tax > 0.02 THEN ' ' END AS category, CASE WHEN l_discount > 0.05 THEN 'midi_ddsp' END AS backend FROM lineitem WHERE l_orderkey % 3 > 0
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, category DESC NULLS LAST, backend DESC NULLS LAST) = 1),
t AS (SELECT l_orderkey AS o, l_linenumber AS track FROM lineitem), j AS (SELECT t.o, t.track, coalesce(nullif(trim(category), ''), CASE WHEN t.track = 1 THEN 'drums' ELSE 'piano' END) AS category, coalesce(backend, 'fluidsynth') AS backend FROM t LEFT JOIN s USING (o, track))
SELECT 'new/' || o AS path, track, category, CASE category WHEN 'drums' THEN 'slakh' ELSE 'basic' END AS ablation, CASE category WHEN 'drums' THEN 'slakh' ELSE 'basic' END AS method, 'basic' AS fallback, backend, category = 'drums' AS realify FROM j
""")
def synced_sidecar(spark: SparkSession, d: str) -> DataFrame:
    lines, number = table(spark, d, "lineitem"), F.col("l_linenumber")
    stems = lines.select(F.concat(F.lit("new/"), "l_orderkey").alias("path"), number.alias("track"), F.lit("Piano").alias("name"), F.lit(0).alias("program"), (number == 1).alias("is_drum"))
    source = lines.where("l_orderkey % 3 > 0").select(
        F.concat(F.lit("old/"), "l_orderkey").alias("path"), number.alias("track"), F.when(F.col("l_tax") > 0.04, "drums").when(F.col("l_tax") > 0.02, " ").alias("category"),
        F.when(F.col("l_discount") > 0.05, "midi_ddsp").alias("backend"), "l_quantity",
    )
    recipe = spark.createDataFrame([("drums", "slakh", "slakh", "basic", True), ("piano", "basic", "basic", "basic", False)], "category string, ablation string, method string, fallback string, realify boolean")
    return manifest.synced_sidecar(stems, source, recipe, "old/", "new/", "l_quantity")


@named("""
WITH s AS (SELECT l_partkey AS song_id, l_linenumber AS track, l_orderkey AS at, CASE WHEN l_tax > 0.03 THEN ' ' || l_returnflag ELSE ' ' END AS name, CASE WHEN l_tax > 0.01 THEN l_suppkey END AS program, CASE WHEN l_tax > 0.05 THEN true END AS is_drum FROM lineitem WHERE l_partkey % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey DESC, name DESC, program DESC NULLS LAST, is_drum DESC NULLS LAST) = 1)
SELECT p_partkey AS song_id, r.track, nullif(trim(name), '') AS track_name, coalesce(program, 0) AS program, coalesce(is_drum, false) AS is_drum FROM (SELECT p_partkey, unnest([1, 2, 9]) AS track FROM part) r LEFT JOIN s ON s.song_id = p_partkey AND s.track = r.track
""")
def stem_metadata(spark: SparkSession, d: str) -> DataFrame:
    tax, rows = F.col("l_tax"), table(spark, d, "part").select(F.col("p_partkey").alias("song_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(9))).alias("track"))
    stems = table(spark, d, "lineitem").where("l_partkey % 2 = 0").select(
        F.col("l_partkey").alias("song_id"), F.col("l_linenumber").alias("track"), F.when(tax > 0.03, F.concat(F.lit(" "), "l_returnflag")).otherwise(" ").alias("name"), F.when(tax > 0.01, F.col("l_suppkey")).alias("program"),
        F.when(tax > 0.05, True).alias("is_drum"), F.col("l_orderkey").alias("at"),
    )
    return manifest.stem_metadata(rows, stems, "at")


@named("""
WITH c AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS track FROM lineitem WHERE l_tax > 0.02),
s AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS track FROM lineitem), n AS (SELECT o, count(*) AS n FROM c GROUP BY 1)
SELECT o_orderkey AS song_id, o_orderstatus AS title, count(s.track) AS n_stems, coalesce(max(n.n), 0)::BIGINT AS n_with_cells, min(s.track)::INT AS first_track FROM orders LEFT JOIN s ON s.o = o_orderkey LEFT JOIN n ON n.o = o_orderkey GROUP BY 1, 2
""")
def song_details(spark: SparkSession, d: str) -> DataFrame:
    lines, song = table(spark, d, "lineitem"), F.col("l_orderkey").alias("song_id")
    cells = lines.where("l_tax > 0.02").select(song, F.col("l_linenumber").alias("track"), F.col("l_quantity").cast("int").alias("q"), F.posexplode(F.array(F.lit("a"), F.lit("b"))).alias("place", "condition")).distinct()
    cells = cells.where("q % (place + 1) = 0").withColumns({"path": F.concat_ws("/", "condition", "song_id"), "caption": F.concat(F.lit("at "), "q")})
    stems = lines.select(song, F.col("l_linenumber").alias("track"), F.lit(None).cast("string").alias("name")).distinct()
    rows = manifest.song_details(table(spark, d, "orders").select(F.col("o_orderkey").alias("song_id"), F.col("o_orderstatus").alias("title")), stems, cells)
    with_cells = F.size(F.filter("stems", lambda s: s.conditions.isNotNull()))
    return rows.select(
        "song_id", "title", F.coalesce(F.size("stems"), F.lit(0)).cast("long").alias("n_stems"), F.coalesce(with_cells, F.lit(0)).cast("long").alias("n_with_cells"), F.get("stems", F.lit(0)).track.alias("first_track")
    )


@named("""
WITH f AS (SELECT l_partkey AS stem_id, arg_min(struct_pack(c := CASE WHEN l_linenumber > 2 THEN l_returnflag END, o := l_orderkey, t := l_linenumber), (l_orderkey * 10 + l_linenumber, l_returnflag)) AS r FROM lineitem GROUP BY 1)
SELECT stem_id, coalesce(r.c, p_brand) AS category, r.o AS song_id, r.t AS track, p_type AS note FROM f LEFT JOIN part ON p_partkey = stem_id AND p_size > 10
""")
def stem_list(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("l_linenumber") > 2, F.col("category"))
    rows = _variants(spark, d).select("stem_id", own.alias("category"), F.col("l_orderkey").alias("song_id"), F.col("l_linenumber").alias("track"), F.struct("place", "category").alias("place"))
    probes = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), F.col("p_type").alias("note"))
    return manifest.stem_list(rows, probes, "place")


@named("""
WITH o AS (SELECT DISTINCT l_partkey AS stem_id, l_suppkey AS v FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY stem_id ORDER BY md5('42|' || stem_id || '|' || v)) - 1 AS n FROM o)
SELECT stem_id, string_agg(CASE WHEN n > 25 THEN chr((64 + n // 26)::INT) ELSE '' END || chr((65 + n % 26)::INT) || ':' || v, ' ' ORDER BY n) AS samples FROM r GROUP BY 1
""")
def stem_tests(spark: SparkSession, d: str) -> DataFrame:
    shown = manifest.stem_tests(_variants(spark, d).withColumn("out_path", F.concat_ws("/", "variant_id", "stem_id")), 42)
    return shown.select("stem_id", F.array_join(F.transform("samples", lambda s: F.concat_ws(":", s.blind_label, s.variant_id)), " ").alias("samples"))


@named("""
WITH s AS (SELECT l_returnflag AS category, l_suppkey AS v, avg(l_quantity) AS c, avg(l_linenumber) AS r, min(l_quantity) AS least, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1, 2), e AS (SELECT * FROM s WHERE c > 25),
w AS (SELECT category, arg_max(v, (r, c)) AS won FROM e GROUP BY 1), o AS (SELECT s.*, won, row_number() OVER (PARTITION BY category ORDER BY r DESC, c DESC, s.v) - 1 AS "at" FROM s LEFT JOIN w USING (category))
SELECT category, won AS auto_winner_variant_id, "at", v AS variant_id, c > 25 AS passed_filter, coalesce(v = won, false) AS is_auto_winner, round(c::DECIMAL(28, 9), 2)::DOUBLE AS mean_content, round(r::DECIMAL(28, 9), 2)::DOUBLE AS mean_realism, n AS n_stems,
  CASE WHEN v % 2 = 0 THEN 'level' || v END AS setting FROM o
""")
def verification_meta(spark: SparkSession, d: str) -> DataFrame:
    stats = _variants(spark, d).groupBy("category", "variant_id").agg(
        F.avg("l_quantity").alias("mean_content"), F.avg("l_linenumber").alias("mean_realism"), F.min("l_quantity").alias("min_content"), F.countDistinct("stem_id").alias("n_stems")
    )
    eligible = stats.where("mean_content > 25")
    winners = eligible.groupBy("category").agg(F.max_by("variant_id", F.struct("mean_realism", "mean_content")).alias("variant_id"))
    configs = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("variant_id"), F.create_map(F.lit("setting"), F.concat(F.lit("level"), "s_suppkey")).alias("config"))
    rows = manifest.verification_meta(stats, eligible, winners, configs).select("category", "auto_winner_variant_id", F.posexplode("variants").alias("at", "e"))
    return rows.select("category", "auto_winner_variant_id", F.col("at").cast("long").alias("at"), "e.variant_id", "e.passed_filter", "e.is_auto_winner", "e.stats.mean_content", "e.stats.mean_realism", "e.stats.n_stems", F.col("e.config")["setting"].alias("setting"))


@named("""
WITH f AS (SELECT l_suppkey AS v, arg_min(struct_pack(q := l_quantity::INT, t := CASE WHEN l_linenumber > 1 THEN l_returnflag ELSE '' END, x := CASE WHEN l_tax > 0.02 THEN l_linestatus END), (l_orderkey * 10 + l_linenumber, l_returnflag, l_quantity, l_linestatus, l_tax)) AS r FROM lineitem GROUP BY 1)
SELECT s_nationkey AS category, s_suppkey AS variant_id, concat_ws(', ', 'level: ' || r.q, CASE WHEN r.t <> '' THEN 'prompt: ' || r.t END, 'steps: ' || r.x) AS suggestion FROM supplier JOIN f ON v = s_suppkey
""")
def setting_suggestions(spark: SparkSession, d: str) -> DataFrame:
    place = F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_returnflag", "l_quantity", "l_linestatus", "l_tax")
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("variant_id"), place.alias("place"), F.col("l_quantity").cast("int").alias("level"), F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).otherwise("").alias("prompt"),
        F.when(F.col("l_tax") > 0.02, F.col("l_linestatus")).alias("steps"),
    )
    winners = table(spark, d, "supplier").select(F.col("s_nationkey").alias("category"), F.col("s_suppkey").alias("variant_id"))
    return manifest.suggestions(winners, rows, "place", ["level", "prompt", "steps"], ", ")


@named("SELECT l_returnflag, l_shipdate, l_orderkey, l_linenumber FROM lineitem")
def batch_order(spark: SparkSession, d: str) -> DataFrame:
    return manifest.batch_order(table(spark, d, "lineitem").select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber"), "l_returnflag", "l_orderkey", "l_linenumber")


@named("""
WITH t AS (SELECT p_partkey AS k, (p_size % 10) / 20.0 + 0.3 AS start FROM part), a AS (SELECT k, unnest(range(0, 4)) AS turn, start FROM t), l AS (SELECT k, turn, round(start - 0.1 * turn, 6) AS level FROM a WHERE turn = 0 OR start - 0.1 * turn >= 0.25 - 1e-9),
r AS (SELECT *, CASE WHEN k % 5 > turn THEN (k + turn) % 4 = 0 END AS passed FROM l), b AS (SELECT k, min(turn) FILTER (passed) AS hit, count(passed) AS tried, count(*) AS due FROM r GROUP BY 1)
SELECT b.k, coalesce(hit + 1, tried) AS attempts, l.level::DOUBLE AS level, CASE WHEN hit IS NOT NULL THEN 'passed' WHEN tried = due THEN 'reference' ELSE 'open' END AS outcome FROM b LEFT JOIN l ON l.k = b.k AND l.turn = hit
""")
def backed_off(spark: SparkSession, d: str) -> DataFrame:
    start = F.bround(F.col("p_size") % 10 / 20.0 + 0.3, 6)
    tasks = table(spark, d, "part").select(F.col("p_partkey").alias("k"), start.alias("start"))
    tried = tasks.select("k", F.posexplode(manifest.backoff_levels(F.col("start"), 0.1, 0.25, 4)).alias("turn", "level")).where("k % 5 > turn").select("k", "level", ((F.col("k") + F.col("turn")) % 4 == 0).alias("passed"))
    return manifest.backed_off(tasks, tried, "k", 0.1, 0.25, 4)


@named("""
WITH u AS (SELECT o_custkey AS c, arg_max(struct_pack(v := CASE WHEN o_orderkey % 3 > 0 THEN 'to/' || o_orderkey END), o_orderkey) AS r FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN u.c IS NOT NULL THEN r.v END AS original_path, CASE WHEN starts_with(c_name, 'Customer#') THEN 'moved/' || substr(c_name, 10) ELSE c_name END AS path FROM customer LEFT JOIN u ON u.c = c_custkey
""")
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    updates = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(key % 3 > 0, F.concat(F.lit("to/"), key)).alias("original_path"), key.alias("at"))
    rows = table(spark, d, "customer").select("c_custkey", manifest.prefix_remapped(F.col("c_name"), "Customer#", "moved/").alias("path"))
    return manifest.partial_update(rows, updates, ["c_custkey"], "original_path", "at")


@named("""
SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS level, CASE WHEN event_id % 2 > 0 THEN value END AS inner_level FROM events
""")
def json_safe(spark: SparkSession, d: str) -> DataFrame:
    nan, key = F.lit(float("nan")), F.col("event_id")
    level = lambda n: F.when(key % n > 0, F.col("value")).otherwise(nan)
    safe = files.json_safe(table(spark, d, "events").select("event_id", level(3).alias("level"), F.array(F.struct(level(2).alias("v"))).alias("inner")))
    return safe.select("event_id", "level", F.col("inner")[0].v.alias("inner_level"))


# ---- rules, votes and work


@named(r"""
SELECT p_partkey, 'a/b/' || p_partkey AS mid, 'x/' || p_partkey AS rec, './data/a/b/' || p_partkey || '.json' AS rec_path, CASE WHEN p_partkey % 2 = 0 THEN 'song/' || p_partkey ELSE 'last' || p_partkey END AS audio,
  'a/b/' || p_partkey || CASE WHEN p_partkey % 3 < 2 THEN '.mid' ELSE '' END AS rest, '/set/mid/' || p_partkey AS midi, 'x/' || p_partkey || '.v1' AS song, 'x/' || p_partkey || '.v1.json' AS below, '/out/audio/x/' || p_partkey || '.v1' AS folder FROM part
""")
def path_ids(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    text = lambda before, after="": F.concat(F.lit(before), key, F.lit(after))
    midi = F.when(key % 3 == 0, text("./mid/a/b/", ".mid")).when(key % 3 == 1, text("/root/set/mid/a/b/", ".mid")).otherwise(text("mid\\a\\b\\"))
    audio = F.when(key % 2 == 0, text("out/audio/song/", "/")).otherwise(text("out/last"))
    record, versioned = text(".//data/x/", ".json"), text("/root/data/x/", ".v1.json")
    return table(spark, d, "part").select(
        "p_partkey", names.midi_id(midi).alias("mid"), names.record_id(record).alias("rec"), names.record_path(midi).alias("rec_path"), names.audio_id(audio).alias("audio"),
        names.midi_rest(midi).alias("rest"), names.midi_path(F.when(key % 2 == 0, text("/mid/")).otherwise(text("mid/")), "/set").alias("midi"), names.song_id(text("./data/x/", ".v1.json")).alias("song"),
        names.id_below_data(versioned).alias("below"), names.output_folder(versioned, "/root", "/out", "audio").alias("folder"),
    )


@named("""
WITH s AS (SELECT l_orderkey AS doc, l_returnflag AS category, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_tax) AS at, l_tax > 0.04 AS hit,
  CASE WHEN l_partkey % 2 = 0 THEN l_linestatus || ' Lead_line' END AS name, l_partkey % 5 AS program, l_partkey % 3 = 0 AS drum FROM lineitem),
g AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (hit) OVER w AS hits FROM s WINDOW w AS (PARTITION BY doc, category))
SELECT doc, category, CASE WHEN name IS NOT NULL THEN 'lead,line' END AS keywords, CASE WHEN name IS NULL THEN program END AS program, CASE WHEN name IS NULL AND drum THEN true END AS is_drum FROM g WHERE hit AND hits < n GROUP BY ALL
""")
def bypass_rules(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("l_partkey")
    stem = F.struct(
        "l_linenumber", "l_suppkey", (F.col("l_tax") > 0.04).alias("bypass_realify"), F.when(part % 2 == 0, F.concat("l_linestatus", F.lit(" Lead_line"))).alias("track_name"), F.lit(" ").alias("note"),
        (part % 5).alias("program"), (part % 3 == 0).alias("is_drum"),
    )
    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("category")).agg(F.array_sort(F.collect_list(stem)).alias("stems"))
    rules = verification.bypass_rules(found.withColumn("position", F.ascii("category")), "doc")
    return rules.select("doc", "category", F.array_join("keywords", ",").alias("keywords"), "program", "is_drum")


@named("""
WITH o AS (SELECT p_brand AS b, CASE WHEN p_size > 10 THEN p_size % 4 END AS s, p_partkey AS at FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_brand AS b, CASE WHEN p_size > 10 THEN p_size % 6 END AS s, min(p_partkey) AS at FROM part WHERE p_partkey % 2 = 1 GROUP BY 1, 2)
SELECT b, s, "at", false AS is_new FROM o UNION ALL SELECT b, s, "at", true FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.b = n.b AND o.s IS NOT DISTINCT FROM n.s)
""")
def merged_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = lambda odd, n: table(spark, d, "part").where(F.col("p_partkey") % 2 == odd).select(F.col("p_brand").alias("b"), F.when(F.col("p_size") > 10, F.col("p_size") % n).alias("s"), F.col("p_partkey").alias("at"))
    phases = spark.createDataFrame([("one", True), ("two", True), ("three", False)], "phase string, completed boolean")
    return tables.when_complete(tables.merge_rules(rules(0, 4), rules(1, 6), ["b", "s"], "at"), phases, ["one", "two"])


@named("""
WITH v AS (SELECT event_id % 2 AS side, CASE WHEN user_id % 3 = 0 THEN 'c' || (user_id % 40) ELSE (user_id % 40) || '|' || (event_id % 3) END AS card, user_id % 40 AS variant, event_id % 3 AS clip, event_type AS tier, event_id AS at FROM events),
f AS (SELECT card, arg_min("at", (side, "at")) AS "at" FROM v GROUP BY 1) SELECT card, variant::VARCHAR AS variant, clip::VARCHAR AS clip, tier, f."at" FROM v JOIN f USING (card) QUALIFY row_number() OVER (PARTITION BY card ORDER BY side DESC, v."at" DESC) = 1
""")
def merged_votes(spark: SparkSession, d: str) -> DataFrame:
    user, event = F.col("user_id"), F.col("event_id")
    found = table(spark, d, "events").select(
        F.when(user % 3 == 0, F.concat(F.lit("c"), user % 40)).otherwise("").alias("card"), (user % 40).cast("string").alias("variant"), (event % 3).cast("string").alias("clip"), F.col("event_type").alias("tier"), event.alias("at"), (event % 2).alias("side")
    )
    return votes.merged(*(found.where(F.col("side") == k).drop("side") for k in (0, 1)))


@named("""
WITH f AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS found FROM lineitem WHERE l_orderkey % 5 > 0 AND l_tax > 0.01 GROUP BY 1), t AS (SELECT o_orderkey AS k, (o_custkey % 5)::BIGINT AS expected, coalesce(found, 0) AS found FROM orders LEFT JOIN f ON k = o_orderkey)
SELECT * FROM (SELECT *, CASE WHEN found = 0 AND expected > 0 THEN 'missing' WHEN found < expected THEN 'incomplete' WHEN k % 7 = 0 THEN 'outdated' END AS reason FROM t) WHERE reason IS NOT NULL
""")
def selected_work(spark: SparkSession, d: str) -> DataFrame:
    songs = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 5).alias("expected"))
    found = table(spark, d, "lineitem").where("l_orderkey % 5 > 0 and l_tax > 0.01").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    return tables.selected_work(songs, found, songs.where("k % 7 = 0"), "k", "l_linenumber", "expected")


@named("""
WITH c AS (SELECT DISTINCT l_orderkey AS song, l_returnflag AS model FROM lineitem), w AS (SELECT song FROM c GROUP BY 1 HAVING count(*) = 3)
SELECT song, model, row_number() OVER (PARTITION BY song ORDER BY md5('9|' || song || '|' || model)) - 1 AS position FROM c WHERE song IN (SELECT song FROM w)
""")
def model_trials(spark: SparkSession, d: str) -> DataFrame:
    clips = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("song"), F.col("l_returnflag").alias("model")).distinct()
    whole = clips.join(tables.has_all(clips, "song", "model", ["A", "N", "R"]), "song", "left_semi")
    return sampling.blinded(whole, "song", "model", 9).select("song", "model", F.col("position").cast("long").alias("position"))


@named("""
WITH c AS (SELECT DISTINCT l_orderkey AS song, l_returnflag AS model FROM lineitem), w AS (SELECT song FROM c GROUP BY 1 HAVING count(*) = 3),
t AS (SELECT song, model, chr((64 + row_number() OVER (PARTITION BY song ORDER BY md5('9|' || song || '|' || model)))::INT) AS label FROM c WHERE song IN (SELECT song FROM w)),
r AS (SELECT l_orderkey AS song, l_suppkey AS listener, chr(64 + l_linenumber) AS label, l_quantity::DECIMAL(18,2) AS realism FROM lineitem),
u AS (SELECT model, listener, (sum(realism)::DOUBLE / count(*))::DECIMAL(18,6) AS m FROM r JOIN t USING (song, label) GROUP BY ALL)
SELECT model, round(sum(m)::DOUBLE / count(*), 6) AS mean, count(*) AS n FROM u GROUP BY 1
""")
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    clips = lines.select(F.col("l_orderkey").alias("song"), F.col("l_returnflag").alias("model")).distinct()
    trials = sampling.blinded(clips.join(tables.has_all(clips, "song", "model", ["A", "N", "R"]), "song", "left_semi"), "song", "model", 9)
    rated = lines.select(F.col("l_orderkey").alias("song"), F.col("l_suppkey").alias("listener"), F.char(64 + F.col("l_linenumber")).alias("label"), F.col("l_quantity").cast("decimal(18,2)").alias("realism"))
    seen = sampling.unblinded(rated, trials, "song", "model").select(F.lit("all").alias("category"), F.col("model").alias("variant"), "listener", "realism")
    return ratings.metric_stats(seen, "realism").select(F.col("variant").alias("model"), F.round("mean", 6).alias("mean"), "n")
