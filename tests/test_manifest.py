"""Manifests, tolerant readers, listings and sinks on small tables and files."""

import json
import math
import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from stavework.functions import names
from stavework.operators import manifest, tables, verification, votes
from stavework.sources import files
from stavework.sources.tables import RECIPES, STEMS


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()] if columns else [tuple(r) for r in df.collect()]


# ---- readers


def test_a_missing_and_an_empty_file_are_empty_tables(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    for name in ("there_is_no.csv", "none.csv"):
        found = files.read_csv_or_empty(spark, str(tmp_path / name), STEMS)
        assert found.count() == 0 and found.schema == STEMS
    (tmp_path / "some.csv").write_text("track,path,extra\n3,a,x\nNA,b,y\nbad,,z\n")
    found = files.read_csv_or_empty(spark, str(tmp_path / "some.csv"), STEMS)
    assert rows(found, "path", "track", "name") == [("a", 3, None), ("b", None, None), (None, None, None)]
    assert files.header(spark, str(tmp_path / "some.csv")) == ["track", "path", "extra"]


def test_columns_can_be_left_out(spark, tmp_path):
    path = tmp_path / "songs.csv"
    path.write_text("path,subset:all_valid,pdf,n\na,True,x,1\nb,False,y,2\nc,NA,z,3\n")
    assert rows(files.read_csv_except(spark, str(path), ["pdf", "mxl"], "subset:all_valid")) == [("a", "1")]
    assert files.read_csv_except(spark, str(path), ["pdf"]).columns == ["path", "subset:all_valid", "n"]
    with pytest.raises(ValueError, match="no column"):
        files.read_csv_except(spark, str(path), [], "subset:none")


def test_every_version_of_the_track_map(spark, tmp_path):
    texts = {"one.csv": "song_id,track,original_track,program,is_drum,name\na/b/1,0,4,,True,Drums\n", "two.csv": "path,track,original_track\n./data/a/b/2.json,1,1\n", "three.csv": "mid,track,original_track\n./mid/a/b/3.mid,2,2\n,NA,1\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    read = lambda *names: rows(files.read_track_map(spark, [str(tmp_path / n) for n in names]))
    assert read("none.csv", "one.csv", "two.csv") == [("a/b/1", 0, 4, 0, True, "Drums")]
    assert read("two.csv") == [("a/b/2", 1, 1, 0, False, None)]
    assert read("three.csv") == [("a/b/3", 2, 2, 0, False, None)]
    with pytest.raises(FileNotFoundError):
        read("none.csv")
    (tmp_path / "four.csv").write_text("x,track\n1,2\n")
    with pytest.raises(ValueError, match="none of"):
        read("four.csv")


def test_settings_keep_their_order(spark, tmp_path):
    schema = files.T.StructType([files.T.StructField("name", files.T.StringType()), files.T.StructField("level", files.T.DoubleType())])
    (tmp_path / "s.json").write_text(json.dumps({"piano": {"level": 0.5}, "drums": 0.25}))
    assert rows(files.settings_table(spark, files.settings(spark, str(tmp_path / "s.json")), schema)) == [(0, "piano", 0.5), (1, "drums", 0.25)]
    assert rows(files.settings_table(spark, ["b", "a"], schema)) == [(0, "b", None), (1, "a", None)]
    assert files.settings_table(spark, None, schema).count() == 0
    with pytest.raises(ValueError, match="unknown fields"):
        files.settings_table(spark, [{"other": 1}], schema)


# ---- listings


def test_listing_is_the_last_name_first_and_stays_in_its_folder(spark, tmp_path):
    for name in ("responses_1.json", "responses_2.json", "responses_in_progress.json", "other.json"):
        (tmp_path / name).write_text("{}")
    assert rows(files.listing(spark, str(tmp_path), "responses_*.json"), "name", "size") == [("responses_2.json", 2), ("responses_1.json", 2)]
    assert files.listing(spark, str(tmp_path / "none"), "*").count() == 0
    assert files.file_in(spark, str(tmp_path), "other.json") == f"{tmp_path}/other.json"
    for name in ("../x", "a/b", ".hidden", "", "none.json", "a\\b"):
        assert files.file_in(spark, str(tmp_path), name) is None


def test_the_newest_folder_with_a_manifest(spark, tmp_path):
    root = str(tmp_path)
    assert files.newest_folder(spark, root, "m.csv") == root
    for i, name in enumerate(("b", "a", "c")):
        (tmp_path / name).mkdir()
        if name != "c":
            (tmp_path / name / "m.csv").write_text("x\n")
        os.utime(tmp_path / name, (1_000_000 + i, 1_000_000 + i))
    assert files.newest_folder(spark, root, "m.csv") == f"{root}/a"
    (tmp_path / "m.csv").write_text("x\n")
    assert files.newest_folder(spark, root, "m.csv") == root


def test_a_cache_is_current_or_not(spark, tmp_path):
    cache, source = tmp_path / "index.csv", tmp_path / "map.csv"
    current = lambda **more: files.is_current(spark, str(cache), [str(source), str(tmp_path / "none")], ["song_id"], **more)
    source.write_text("x\n")
    assert not current()
    cache.write_text("song_id,n_old\na,0\nb,2\n")
    os.utime(source, (2_000_000, 2_000_000))
    assert current() and not current(unused=["n_old"]) and current(unused=["n_other"])
    os.utime(cache, (1_000_000, 1_000_000))
    assert not current()
    os.utime(cache, (3_000_000, 3_000_000))
    assert not files.is_current(spark, str(cache), [], ["song_id", "mid"])


# ---- sinks


def test_rows_are_appended_without_a_read(spark, tmp_path):
    path = str(tmp_path / "stems")
    for track in (0, 1):
        files.append_rows(spark.createDataFrame([("a", track, 9)], "path string, track int, unknown int"), path, STEMS)
    assert sorted(rows(files.read_csv_or_empty(spark, path, STEMS), "path", "track", "name")) == [("a", 0, None), ("a", 1, None)]


def test_tables_are_copied_to_another_root_and_derived_ones_deleted(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    stems = spark.createDataFrame([(f"{old}/a", 0), ("elsewhere/a", 1), (None, 2)], "path string, track int")
    files.append_rows(stems, f"{old}/stems", STEMS)
    assert files.copy_tables(spark, old, new, {"stems": STEMS, "recipes": RECIPES}) == ["stems"]
    assert sorted(rows(files.read_csv_or_empty(spark, f"{new}/stems", STEMS), "track", "path")) == [(0, f"{new}/a"), (1, "elsewhere/a"), (2, None)]
    files.append_rows(stems, f"{new}/stems_shard_1", STEMS)
    assert files.drop_derived(spark, new, ["stems", "songs"]) == ["stems"]
    assert sorted(os.listdir(new)) == ["stems_shard_1"]
    with pytest.raises(ValueError, match="not a table"):
        files.drop_derived(spark, new, ["../old"])


def test_json_has_no_nan_at_any_depth(spark):
    nan, inf = math.nan, math.inf
    df = spark.createDataFrame([(nan, [1.0, nan], {"a": inf, "b": 2.0}, (nan, "x")), (1.0, None, None, None)], "v double, l array<double>, m map<string, double>, s struct<v: double, t: string>")
    first, second = files.json_safe(df).orderBy(F.col("v").asc_nulls_first()).collect()
    assert (first.v, first.l, first.m, tuple(first.s)) == (None, [1.0, None], {"a": None, "b": 2.0}, (None, "x"))
    assert tuple(second) == (1.0, None, None, None)


def test_reports_and_documents(spark, tmp_path):
    summary = spark.createDataFrame([(3, math.nan)], "songs int, share double")
    table = spark.createDataFrame([("a|b", 0.5), (None, None)], "name string, share double").coalesce(1)
    files.write_report(spark, str(tmp_path), "register", summary, {"top": table})
    assert json.loads((tmp_path / "register.json").read_text()) == {"songs": 3, "share": None}
    text = (tmp_path / "register.md").read_text()
    assert text == "# register\n\n- songs: 3\n- share: None\n\n## top\n\n| name | share |\n| --- | --- |\n| a\\|b | 0.50 |\n| - | - |\n"
    assert rows(spark.read.option("header", True).option("nullValue", "NA").csv(str(tmp_path / "top"))) == [("a|b", "0.5"), (None, None)]
    with pytest.raises(ValueError, match="over"):
        files.small_rows(spark.range(files.LARGEST_REPORT + 1))
    files.write_document(spark, str(tmp_path / "w.json"), {"winners": ["é"]}, datetime(2026, 1, 2, tzinfo=UTC))
    assert json.loads((tmp_path / "w.json").read_text()) == {"generated_at": "2026-01-02T00:00:00+00:00", "winners": ["é"]}


# ---- manifests


def test_replacements_run_out_with_an_error(spark):
    stems = spark.createDataFrame([(0, "p", "a", 0, True, None), (1, "p", "b", 0, False, None), (2, "p", "c", 0, None, None), (3, "d", "e", 1, False, 2.5)], "position int, category string, song_id string, track int, usable boolean, later_start double")
    pool = [("p", "a", 0), ("p", "x", 0), ("p", "y", 0), ("p", "y", 0), ("d", "z", 1)]
    found = sorted(rows(manifest.replaced_picks(stems, spark.createDataFrame(pool, "category string, song_id string, track int"), 1)))
    assert {(r[0], r[5]) for r in found} == {(0, "keep"), (1, "replace"), (2, "replace"), (3, "clip")}
    assert {r[2] for r in found if r[5] == "replace"} == {"x", "y"} and found[3][4] == 2.5
    with pytest.raises(Exception, match="no replacement left for p"):
        manifest.replaced_picks(stems, spark.createDataFrame(pool[:2], "category string, song_id string, track int"), 1).collect()
    none = manifest.replaced_picks(stems.where("usable"), spark.createDataFrame([], "category string, song_id string, track int"), 1)
    assert rows(none, "position", "action") == [(0, "keep")]


def test_too_few_trials_are_an_error(spark):
    songs = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "song_id string, audible boolean")
    mixtures = spark.createDataFrame([(s, c) for s in "abc" for c in "xy"] + [("d", "x")], "song_id string, condition string")
    assert {r[1] for r in rows(manifest.mixture_trials(songs, mixtures, ["x", "y"], 2, 1))} == {"a", "c"}
    with pytest.raises(Exception, match="3 trials needed, there are 2"):
        manifest.mixture_trials(songs, mixtures, ["x", "y"], 3, 1).collect()


def test_manifest_scores_against_the_first_reference(spark):
    onsets = [("out/1", [1.0, 2.0]), ("out/2", [1.0]), ("out/3", None), ("clips/s1.flac", [1.0, 2.0]), ("clips/s1.mp3", [9.0]), ("song/2.wav", [1.0, 5.0])]
    known = spark.createDataFrame(onsets, "path string, onsets array<double>")
    table = spark.createDataFrame([("s1", "1", "out/1"), ("s2", "2", "out/2"), ("s2", "2", "out/3"), ("s3", "3", "out/none")], "stem_id string, track string, out_path string")
    wanted = [F.concat(F.lit("clips/"), "stem_id", F.lit(".flac")), F.concat(F.lit("clips/"), "stem_id", F.lit(".mp3")), F.concat(F.lit("song/"), "track", F.lit(".wav"))]
    found = manifest.scored_manifest(table, known, wanted, 0.05, 0.8).orderBy("out_path")
    assert rows(found, "out_path", "reference_path", "matched", "extra", "missing", "passed") == [("out/1", "clips/s1.flac", 2, 0, 0, True), ("out/2", "song/2.wav", 1, 0, 1, False), ("out/3", "song/2.wav", 0, 0, 2, False)]
    with pytest.raises(Exception, match="no reference for out/1"):
        manifest.scored_manifest(table, known, wanted[2:], 0.05, 0.8).collect()


def test_backing_off(spark):
    tasks = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.2), (4, 0.9)], "k int, start double")
    results = spark.createDataFrame([(1, 0.5, False), (1, 0.4, True), (1, 0.3, True), (2, 0.5, False), (3, 0.2, False), (4, 0.9, False), (4, 0.8, None), (4, 0.7, False), (4, 0.6, False)], "k int, level double, passed boolean")
    found = rows(manifest.backed_off(tasks, results, "k", 0.1, 0.25, 4).orderBy("k"))
    assert found == [(1, 2, 0.4, "passed"), (2, 1, None, "open"), (3, 1, None, "reference"), (4, 4, None, "reference")]


def test_batches_lie_together(spark):
    tasks = spark.createDataFrame([("b", 2, "x"), ("a", None, "y"), (None, 1, "z"), ("a", 3, "w"), ("b", 1, "v")], "category string, length int, path string")
    assert [r.path for r in manifest.batch_order(tasks, "category", "length", "path").collect()] == list("zywvx")


def test_updates_of_a_new_column_and_of_an_empty_table(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1)], "path string, track int")
    updates = spark.createDataFrame([("a", 0, "x", 1), ("a", 0, None, 2), ("b", 1, "y", 1), ("c", 1, "z", 1)], "path string, track int, original string, at int")
    assert sorted(rows(manifest.partial_update(df, updates, ["path", "track"], "original", "at"))) == [("a", 0, None), ("b", 1, "y")]
    assert sorted(rows(manifest.partial_update(df, updates.where("false"), ["path", "track"], "original", "at"))) == [("a", 0, None), ("b", 1, None)]


def test_probes_in_order_have_no_problem(spark):
    good = [(f"{c}{i}", c, f"s{i}", ord(c), "fit", None) for c in "pd" for i in range(2)]
    schema = "id string, category string, song_id string, track int, gm_class string, legacy boolean"
    assert manifest.probe_problems(spark.createDataFrame(good, schema), {"p": ["fit"], "d": ["fit", "other"]}, 2).count() == 0
    assert {r.problem for r in manifest.probe_problems(spark.createDataFrame([], schema), {"p": ["fit"]}, 2).collect()} == {"missing category"}
    odd = [(None, "p", "s9", 1, "fit", False), ("p1", "p", "s0", ord("p"), "bad", False)]
    found = {tuple(r) for r in manifest.probe_problems(spark.createDataFrame(good + odd, schema), {"p": ["fit"], "d": ["fit"]}, 2).collect()}
    assert found == {("p", "too many"), ("p1", "repeated id"), ("s0/112", "repeated stem"), ("?", "incomplete"), ("p1", "class not allowed")}


# ---- ids, rules, votes and work


def test_ids_of_paths(spark):
    cases = [("./mid/a/b/Q.mid", "a/b/Q"), ("/root/mid/x/mid/Q.mid", "x/mid/Q"), ("mid\\a\\Q.mid", "a/Q"), ("..//a/Q", "a/Q"), (None, None)]
    df = spark.createDataFrame(cases, "path string, expected string")
    assert all(r.found == r.expected for r in df.select("expected", names.midi_id(F.col("path")).alias("found")).collect())
    one = spark.createDataFrame([("./mid/a/Q.mid", "./data/a/Q.json", "x/audio//a/Q/", "x/y/")], "m string, r string, a string, b string")
    found = one.select(names.record_path(F.col("m")), names.record_id(F.col("r")), names.audio_id(F.col("a")), names.audio_id(F.col("b")))
    assert tuple(found.first()) == ("./data/a/Q.json", "a/Q", "a/Q", "y")
    paths = spark.createDataFrame([("./data/7/Q.v1.json",), ("x/data/data/Q/",), ("data",), (".hidden",), (None,)], "p string")
    assert [r[0] for r in paths.select(names.song_id(F.col("p"))).collect()] == ["7/Q.v1", "x/data/data/Q/", "data", "hidden", None]
    assert [r[0] for r in paths.where("p is null or p like '%data%'").select(names.id_below_data(F.col("p"))).collect()] == ["7/Q.v1.json", "data/Q", "", None]
    with pytest.raises(Exception, match="no data folder in .hidden"):
        paths.select(names.id_below_data(F.col("p"))).collect()
    song = F.lit("/set/data/7/data/Q.json")
    found = spark.range(1).select(names.output_folder(song, "/set", "/out"), names.output_folder(song, "/set", "/out", "audio"), names.output_folder(F.lit("/set/x"), "/set", "/out"), names.midi_path(F.lit("/a.mid"), "r/"), names.midi_path(F.lit("a.mid"), "r"))
    assert tuple(found.first()) == ("/out/data/7/data/Q", "/out/audio/7/data/Q", "/out", "r/a.mid", "r/a.mid")


def test_response_paths_are_listed_once(spark, tmp_path):
    for name in ("responses_b.json", "responses_a.json", "responses_in_progress.json", "x.json"):
        (tmp_path / name).write_text("{}")
    found = files.document_paths(spark, [str(tmp_path / "x.json"), str(tmp_path), str(tmp_path / "responses_a.json")])
    assert [p.rsplit("/", 1)[1] for p in found] == ["x.json", "responses_a.json", "responses_b.json"]


def test_rules_of_bypassed_stems(spark):
    stem = "struct<bypass_realify: boolean, track_name: string, note: string, program: int, is_drum: boolean>"
    lead, low = (True, "Lead Guitar 1", None, 5, False), (True, " ", "Bs", 7, None)
    docs = [
        (1, 0, "p", [lead, lead, low, (None, "x", None, 0, None)]), (1, 1, "d", [(True, None, "", None, True), (False, None, None, None, None)]),
        (1, 2, "b", [lead]), (1, 3, "s", []), (1, 4, None, [lead, (False, "x", None, 0, None)]), (1, 5, "p", [lead, (False, None, None, 0, None)]), (1, 6, "n", None),
    ]
    found = verification.bypass_rules(spark.createDataFrame(docs, f"doc int, position int, category string, stems array<{stem}>"), "doc").orderBy("place")
    assert rows(found, "category", "keywords", "program", "is_drum", "place.position", "place.at") == [
        ("p", ["lead", "guitar"], None, None, 0, 0), ("p", ["bs"], None, None, 0, 2), ("d", None, 0, True, 1, 0),
    ]


def test_rules_wait_for_their_phases(spark):
    phases = spark.createDataFrame([("one", True), ("two", None)], "phase string, completed boolean")
    assert tables.when_complete(spark.range(2), phases, ["one"]).count() == 2
    with pytest.raises(Exception, match="not complete: two, three"):
        tables.when_complete(spark.range(0), phases, ["one", "two", "three"])


def test_votes_of_a_session_are_merged(spark):
    schema = "card string, variant string, clip string, tier string, at int"
    old = spark.createDataFrame([("a", None, None, "weak_accept", 0), ("", "v", "c", "strong_reject", 1), (None, "v", None, "strong_reject", 2)], schema)
    new = spark.createDataFrame([("v|c", None, None, "weak_reject", 0), ("b", None, None, "x", 1), ("b", None, None, "y", 2)], schema)
    assert sorted(rows(votes.merged(old, new), "card", "tier", "at")) == [("a", "weak_accept", 0), ("b", "y", 1), ("v|c", "weak_reject", 1)]
    assert votes.merged(old.where("false"), new.where("false")).count() == 0
