"""The cases of the correction, routing and rating families, one by one."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from stavework.functions import programs
from stavework.functions.names import folded, is_generic, is_plucked, level_id, level_of, normalized
from stavework.operators import correction, profile, ratings, routing, samples, sampling, sequences, tables, votes

ALIASES = (("harpsichord", 6), ("soprano", 52), ("satb", 52), ("tenor", 52), ("flote", 73), ("alto sax", 65), ("chor", 52))
FAMILIES = (("brass", 61, "brass"), ("strings", 48, "ensemble"))


def test_corrections_by_branch(spark):
    cases = [
        ("Harpsichord", 0, False, (6, "corrected", "harpsichord")),
        ("Piano", 0, False, (0, "keep", None)),
        ("SATB", 0, False, (52, "corrected", "satb")),
        ("Alto Sax", 0, False, (65, "corrected", "alto sax")),
        ("bass", 0, False, (0, "skipped_no_match", None)),
        ("Soprano", 0, True, (0, "skipped_drum", None)),
        ("  ", 3, False, (3, "skipped_unnamed", None)),
        (None, 3, None, (3, "skipped_unnamed", None)),
        ("Track 12", 3, False, (3, "skipped_generic", None)),
        ("score", 3, False, (3, "skipped_generic", None)),
        ("Brass", 57, False, (57, "keep", "brass")),
        ("Brass", 0, False, (61, "corrected", "brass")),
        ("Ténor", 0, False, (52, "corrected", "tenor")),
        ("Flöte", 0, False, (73, "corrected", "flote")),
        ("nyckelchorda", 0, False, (0, "skipped_no_match", None)),
        ("vibraphone solo", 0, False, (11, "corrected", "vibraphone")),
        ("brass soprano", None, False, (52, "corrected", "soprano")),
    ]
    rows = spark.createDataFrame([(i, n, p, d) for i, (n, p, d, _) in enumerate(cases)], "i int, name string, program int, drum boolean")
    done = correction.corrected(F.col("name"), F.col("program"), F.col("drum"), ALIASES, FAMILIES, ["score"])
    for r in rows.select("i", "name", done.alias("c")).collect():
        assert tuple(r.c) == cases[r.i][3], r


def test_register_of_three_tracks(spark):
    rows = [(0, 6, False, "corrected"), (0, 0, False, "keep"), (0, 52, False, "corrected")]
    register = spark.createDataFrame(rows, "program_original int, program_corrected int, is_drum boolean, status string")
    r = correction.register_summary(register).first()
    assert (r.n_tracks, r.n_corrected, r.n_fine, r.pct_corrected) == (3, 2, 1, 66.67)
    assert [tuple(x) for x in correction.top_corrections(register, 1).collect()] == [(0, 6, 1, 50.0, "0 Acoustic Grand Piano → 6 Harpsichord")]
    nothing = register.where("false")
    assert correction.register_summary(nothing).first().pct_corrected == 0 and correction.top_corrections(nothing, 5).count() == 0


def test_routes_by_branch(spark):
    cases = [
        ("x", 0, True, 4, True, ("soundfont", None, "soundfont_drum")),
        ("violin", 40, False, 0, True, ("soundfont", None, "empty_track")),
        ("Alto", 0, False, 4, True, ("soundfont", None, "soundfont_vocal")),
        ("Alto Sax", 65, False, 4, True, ("midi_ddsp", "saxophone", "midi_ddsp_eligible")),
        ("Piano", 0, False, 4, False, ("ddsp_piano", "piano", "piano")),
        ("Rhodes", 0, False, 4, False, ("soundfont", None, "soundfont_unsupported")),
        ("Lute", 105, False, 4, True, ("soundfont", None, "soundfont_guitar")),
        (None, 33, False, 4, True, ("soundfont", None, "soundfont_bass_guitar")),
        (None, 26, False, 4, True, ("soundfont", None, "soundfont_guitar")),
        ("Trumpet", 59, False, 4, True, ("soundfont", None, "soundfont_unsupported")),
        ("Violin", 40, None, 4, False, ("soundfont", "violin", "soundfont_polyphonic")),
        ("contrabass", 43, False, None, None, ("midi_ddsp", "double bass", "midi_ddsp_eligible")),
        ("English Horn", 69, False, 4, True, ("soundfont", None, "soundfont_unsupported")),
    ]
    rows = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, name string, program int, drum boolean, notes int, mono boolean")
    found = rows.select("i", routing.route(*(F.col(c) for c in ("name", "program", "drum", "notes", "mono"))).alias("r"))
    for r in found.collect():
        assert tuple(r.r) == cases[r.i][5], cases[r.i]


def test_a_category_without_recipe_is_an_error(spark):
    tracks = spark.createDataFrame([("organ", 16, False)], "name string, program int, is_drum boolean")
    recipe = spark.createDataFrame([("piano", "basic", None, False)], "category string, method string, fallback string, realify boolean")
    with pytest.raises(Exception, match="no recipe for category organ"):
        routing.plan(tracks, recipe).collect()


def test_names_of_all_scripts(spark):
    rows = spark.createDataFrame([(" Ténor\t\n",), ("ÅNGSTRÖM",), ("é",), ("ﬁ",), (None,), ("Absolute",), ("a LUTE.",)], "n string")
    got = rows.select(folded("n"), normalized(F.col("n")), is_plucked(F.col("n"))).collect()
    assert [r[0] for r in got][1:5] == ["angstrom", "e", "fi", None]
    odd = spark.createDataFrame([(n,) for n in ("½ ﬂöte", "한", "हिन्दी", "𝐂𝐞𝐥𝐥𝐨", "Ⅳ", "İ", "ſ", "")], "n string")
    assert [r[0] for r in odd.select(folded("n")).collect()] == ["1⁄2 flote", unicodedata.normalize("NFKD", "한"), "".join(c for c in "हिन्दी" if not unicodedata.combining(c)), "cello", "iv", "i", "s", ""]
    assert got[0][1] == "ténor" and got[4][1] == "(unnamed)" and [r[2] for r in got][5:] == [False, True]
    assert [r[0] for r in rows.select(is_generic(F.col("n"), ["absolute"])).collect()] == [False, False, False, False, True, True, False]
    ids = spark.createDataFrame([(0.5,), (1.0,), (0.25,), (10.0,)], "x double").select(level_id(F.col("x"), "noise").alias("id"))
    assert [tuple(r) for r in ids.select("id", level_of(F.col("id"), "noise")).collect()] == [("noise0.5", 0.5), ("noise1", 1.0), ("noise0.25", 0.25), ("noise10", 10.0)]
    assert ids.select(level_of(F.col("id"), "steps")).first()[0] is None


def test_captions(spark):
    rows = spark.createDataFrame([(42, False, None), (42, False, " "), (0, True, "x"), (3, False, " Cello ")], "p int, d boolean, n string")
    text = programs.caption("A", {}, F.col("p"), F.col("d"), F.col("n"), F.lit("s"))
    hint = "A. format: solo | instruments: "
    assert [r[0] for r in rows.select(text).collect()] == [hint + x for x in ("midi program 42", "midi program 42", "drums", "cello")]


def test_forms_of_captions(spark):
    one = spark.createDataFrame([(0, False, "Oboe", None)], "p int, d boolean, n string, g string")
    forms = [programs.caption_in_form(f, {"genre": F.col("g")}, F.col("p"), F.col("d"), F.col("n"), F.lit("s"), hint) for f in programs.FORMS for hint in (True, False)]
    end = ". format: solo | instruments: oboe"
    short = "solo oboe, realistic studio recording, expressive performance"
    kept = f"{programs.PRESERVATION} Realistic recorded oboe."
    assert list(one.select(*forms).first()) == [programs.CURRENT + end, programs.CURRENT, short, short, kept + end, kept, programs.ADHERENCE + end, programs.ADHERENCE]
    with pytest.raises(ValueError, match="unknown form"):
        programs.caption_in_form("long", {}, F.col("p"), F.col("d"), F.col("n"), F.lit("s"))


def test_passes_of_recipes_in_order(spark):
    rows = [(1, "piano", "midi-ddsp", None), (1, "bass", "basic", True), (2, "bass", "midi-ddsp", False), (3, "drums", None, None)]
    found = routing.pass_sequence(spark.createDataFrame(rows, "k int, category string, method string, realify boolean"), "k").collect()
    assert {r.k: r.passes for r in found} == {1: ["layout", "fluidsynth", "ddsp_piano", "midi_ddsp", "realify", "mix"], 2: ["layout", "fluidsynth", "midi_ddsp", "mix"], 3: ["layout", "fluidsynth", "mix"]}


def test_labels_go_on(spark):
    at = spark.createDataFrame([(x,) for x in (0, 25, 26, 701, 702, 18277, 18278)], "x long")
    assert [r[0] for r in at.select(sampling.label(F.col("x"))).collect()] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA"]


def test_one_listener_is_not_averaged_first(spark):
    rows = [("a", "p", "v", 1.0), ("a", "p", "v", 3.0), ("a", "q", "v", 1.0), ("b", "q", "v", 3.0), ("b", "q", "v", 5.0)]
    stats = ratings.metric_stats(spark.createDataFrame(rows, "listener string, category string, variant string, content double"), "content", ["v", "w"])
    got = {(r.category, r.variant): (r["mean"], r["sem"], r.n) for r in stats.collect()}
    assert got[("p", "v")] == pytest.approx((2.0, 1.0, 2)) and got[("q", "v")] == pytest.approx((2.5, 1.5, 2))
    assert got[("p", "w")] == got[("q", "w")] == (None, None, None) and len(got) == 4


def test_pools_without_accepts(spark):
    rows = [("c", "b", "weak_reject"), ("c", "a", "weak_reject"), ("c", "a", "weak_reject"), ("c", "d", "strong_reject"), ("e", "x", "strong_reject")]
    given = spark.createDataFrame(rows, "category string, variant string, tier string")
    assert [(r.category, r.variant, r.pool) for r in votes.tier_pools(given).orderBy("category", "rank").collect()] == [("c", "a", 2), ("c", "b", 2), ("e", "x", 3)]
    assert votes.tier_pools(given, most=1).count() == 2
    with pytest.raises(Exception, match="no accepts"):
        votes.tier_pools(given, strict=True).collect()


def test_diverse_selection_that_is_short(spark):
    rows = spark.createDataFrame([("c", 1, 1), ("c", 1, 2)], "category string, song int, k int")
    assert sampling.distinct_songs_first(rows, "category", "song", 3, 1, "k").count() == 2
    with pytest.raises(Exception, match="c: fewer than 3 rows"):
        sampling.distinct_songs_first(rows, "category", "song", 3, 1, "k", strict=True).collect()


def test_lookups_that_miss_and_repeat(spark):
    table = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, None, 1)], "k int, v string, at int")
    rows = spark.createDataFrame([(1, "x"), (3, "x")], "k int, found_v string")
    got = {r.k: (r.v, r.found_v) for r in tables.lookup(rows, table, ["k"], "v", F.lit("none"), "at").collect()}
    assert got == {1: ("new", "x"), 3: ("none", "x")}
    assert tables.must_lookup(rows.where("k = 1"), table, ["k"], "v", "at").first().v == "old"
    with pytest.raises(Exception, match="no v for 3"):
        tables.must_lookup(rows, table, ["k"], "v", "at").collect()


def test_covered_songs_may_have_more_tracks(spark):
    tracks = spark.createDataFrame([("a", 0), ("a", 5), ("b", 0), ("b", 1), ("b", 7)], "song string, track int")
    songs = spark.createDataFrame([("a", 2), ("b", 2), ("c", 0), ("d", 1)], "song string, n int")
    assert sorted(r.song for r in tables.songs_not_covered(tracks, songs, "song", "track", "n").collect()) == ["a", "d"]


def test_null_keys_drift_too(spark):
    wanted, was = (spark.createDataFrame(rows, "k int, v int") for rows in ([(None, 1), (1, 1)], [(None, 1), (1, 2)]))
    assert [(r.k, r.conflict) for r in tables.drift(wanted, was, ["k"], ["v"]).collect()] == [(1, "changed")]


def test_unknown_names_are_errors(spark):
    rows = spark.createDataFrame([(True,)], "all_valid boolean")
    with pytest.raises(ValueError, match="unknown subset"):
        tables.subset(rows, "best")
    with pytest.raises(ValueError, match="unknown order"):
        sampling.card_order(rows, "best", 1, "all_valid", "all_valid")


def test_quantiles_and_places_in_one_plan_without_a_group_in_one_task(spark):
    rows = spark.range(10_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 9_973).cast("double").alias("v"))
    found = {r.g: list(r.q) for r in profile.quantiles(rows, ["g"], "v", [0.0, 0.1, 0.5, 1.0]).collect()}
    for r in rows.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.1, 0.5, 1.0)))).alias("q")).collect():
        assert found[r.g] == pytest.approx(list(r.q))
    plan = profile.quantiles(rows, ["g"], "v", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "range" in plan and "scalar-subquery" in plan
    assert profile.quantiles(rows.where("false"), [], "v", [0.5]).collect()[0].q in ([None], None)
    shards = sequences.contiguous_shards(spark.range(17).select(F.lit("x").alias("g"), "id"), "g", 5, "id")
    assert [r.shard for r in shards.orderBy("id").collect()] == [k for k, n in enumerate((4, 4, 3, 3, 3)) for _ in range(n)]
