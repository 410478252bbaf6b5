"""Rules on small tables: nulls, ties, fallbacks, empty tables."""

import random
import re
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stavework.functions import arrays, names, scale
from stavework.operators import correction, profile, ratings, rules, tables, votes
from stavework.sources import tables as sources
from stavework.streaming import shard_merge

STATS = "category string, variant string, level double, mean_content double, mean_realism double, min_content double"


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_bands_begin_at_their_edge(spark):
    rows = spark.createDataFrame([(x,) for x in (-5.0, 0.0, 19.0, 19.5, 20.0, 39.4, 40.0, 79.0, 80.0, 100.0, 120.0, None)], "s double")
    assert [r[0] for r in rows.select(scale.band(F.col("s"))).collect()] == [0, 0, 0, 1, 1, 1, 2, 3, 4, 4, 4, None]
    named = rows.where("s in (40.0, 80.0)").select(scale.label(F.col("s"), "realism"), scale.label(F.col("s"), "content"), scale.label(F.col("s"), F.lit("other"))).collect()
    assert sorted(map(tuple, named)) == [("Mixed", "Mostly same", "Mostly same"), ("Very realistic", "Identical", "Identical")]
    assert [r[0] for r in rows.select(scale.likert(F.col("s"))).collect()][-1] is None


def test_name_expressions(spark):
    rows = spark.createDataFrame([(" Lead,\tGuitar ",), ("",), (None,), ("Track 12",), ("a-b",)], "n string")
    got = rows.select(names.sanitized(F.col("n")), names.normalized(F.col("n")), names.is_generic(F.col("n")), names.keywords(F.col("n"))).collect()
    assert got[0][0] == "Lead Guitar" and got[1][0] is None
    assert got[1][1] == got[2][1] == names.UNNAMED
    assert got[3][2] is True and got[0][2] is False
    assert got[4][3] == ["a-b"]
    cells = spark.createDataFrame([("0-40-41",), ("1-x",), ("7--8",)], "c string")
    assert [r[0] for r in cells.select(names.int_list(F.col("c"))).collect()] == [[0, 40, 41], None, [7, 8]]


def test_longest_needle_wins_and_programs_decide_ambiguity(spark):
    needles = spark.createDataFrame([("bass", 33), ("double bass", 43), ("contrabass", 43), ("horn", 60), ("trump", 56), ("frump", 57)], "needle string, program int")
    rows = spark.createDataFrame([("Double Bass",), ("bassoon",), ("Horn x",), ("trump frump",), (None,), ("zz",)], "name string")
    got = {r.name: (r.program, r.status) for r in rules.longest_needle(rows, needles, "name").collect()}
    assert got == {"Double Bass": (43, "matched"), "bassoon": (None, "none"), "Horn x": (60, "matched"), "trump frump": (None, "ambiguous"), "zz": (None, "none")}


def plain_needle_in(name, needle):
    if len(needle) < 5:
        return re.search(f"(^|[^a-z0-9]){re.escape(needle)}([^a-z0-9]|$)", name) is not None
    return needle in name


@pytest.mark.parametrize("seed", range(8))
def test_needles_by_their_grams_are_those_of_every_comparison(spark, seed):
    rng = random.Random(seed)
    text = lambda low, high: "".join(rng.choices("abc1- é.", k=rng.randrange(low, high)))
    names = sorted({text(0, 25) for _ in range(150)})
    needles = sorted({(text(1, rng.choice([3, 5, 9])), rng.randrange(4)) for _ in range(80)})
    found = {r.name: (r.program, r.status) for r in rules.longest_needle(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(needles, "needle string, program int"), "name").collect()}
    index = correction.NeedleIndex(needles)
    for name in names:
        hits = [n for n in needles if plain_needle_in(name, n[0])]
        best = sorted(n for n in hits if len(n[0]) == max(len(x) for x, _ in hits))
        programs = {p for _, p in best}
        assert found[name] == (min(programs) if len(programs) == 1 else None, "none" if not hits else "matched" if len(programs) == 1 else "ambiguous")
        assert index.longest(name) == ({"needle": best[0][0], "program": best[0][1], "ambiguous": len(programs) > 1} if hits else None)


def test_two_hundred_thousand_needles_cost_no_more_a_name():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(5, 14))) for _ in range(200_000)]
    few, many = (correction.NeedleIndex([(w, k % 128) for k, w in enumerate(words[:n])]) for n in (2_000, 200_000))
    names = [" ".join(rng.sample(words, 2)) for _ in range(4_000)]
    seconds = []
    for index in (few, many):
        began = time.perf_counter()
        hits = [index.longest(n) for n in names]
        seconds.append(time.perf_counter() - began)
    assert all(hits) and seconds[1] < 12 * seconds[0] + 0.5


def test_fallbacks_differ(spark):
    rows = [("a", "v1", 0.1, 5.0, 2.0, 5.0), ("a", "v2", 0.2, 2.0, 9.0, 2.0), ("b", "v1", 0.1, 1.0, 3.0, 1.0), ("b", "v2", 0.2, 1.0, 3.0, 1.0)]
    stats = spark.createDataFrame(rows, STATS)
    assert values(ratings.winner_global_fallback(stats), "category", "variant") == [("a", "v1")]
    assert values(ratings.winner_group_fallback(stats, 4.5), "category", "variant") == [("a", "v1"), ("b", "v2")]
    assert values(ratings.shortlist(stats, 8.0, 9.0), "category", "variant") == [("a", "v2"), ("b", "v1")]
    assert ratings.winner_global_fallback(stats.where("false")).count() == 0


def test_audit_ties_go_to_the_lower_level(spark):
    stats = spark.createDataFrame([("a", "v1", 0.1, 5.0, 4.0, 5.0), ("a", "v2", 0.2, 5.0, 4.0, 5.0), ("a", "v3", 0.3, 5.0, 3.0, 5.0)], STATS)
    winners = ratings.winner_group_fallback(stats, 4.5)
    assert values(winners, "variant") == [("v2",)]
    assert values(ratings.audit_winner(stats, winners, 4.5), "chosen", "revised") == [(0.1, True)]


def test_cascades_reject_first_and_accept_into_gaps(spark):
    cards = spark.createDataFrame([(f"c{i}", "k", "v" if i < 3 else "w", i) for i in range(6)], "card string, category string, variant string, place int")
    cast = spark.createDataFrame(
        [("c0", "strong_accept", 1), ("c1", "weak_accept", 2), ("c1", "strong_reject", 3), ("c3", "strong_accept", 4), ("c4", "weak_reject", 5), ("c5", "odd", 6)],
        "card string, tier string, at int",
    )
    got = {r.card: (r.tier, r.source) for r in votes.cascade(cards, votes.last_votes(cast), "place").collect()}
    assert got["c0"] == got["c2"] == ("strong_reject", "c1") and got["c1"] == ("strong_reject", None)
    assert got["c4"] == ("weak_reject", None) and got["c5"] == ("strong_accept", "c3")


def plain_cascade(cards, tiers, overwrite):
    """Cards in their order, each spreading to its siblings: rejects, then accepts."""
    now = {c: (t, None) for c, t in tiers.items()}
    for tier in ("strong_reject", "strong_accept"):
        for card, *group in cards:
            if now.get(card, (None,))[0] != tier:
                continue
            for other, *its in cards:
                if other == card or its != group or now.get(other, (None,))[0] == tier:
                    continue
                if other in now and (tier == "strong_accept" or not overwrite):
                    continue
                now[other] = (tier, card)
    return {c: now.get(c, (None, None)) for c, *_ in cards}


@pytest.mark.parametrize("overwrite", [True, False])
def test_cascades_go_by_the_order_of_cards(spark, overwrite):
    rng = random.Random(overwrite)
    cards, tiers = [], {}
    for g in range(60):
        for card in rng.sample([f"{g}|{k}" for k in (2, 10, 3, 33, 1)], rng.randrange(1, 6)):
            cards.append((card, f"c{g % 3}", f"v{g}"))
            if rng.random() < 0.6:
                tiers[card] = rng.choice(votes.TIERS)
    table = spark.createDataFrame([(*c, k) for k, c in enumerate(cards)], "card string, category string, variant string, place int").repartition(3)
    cast = spark.createDataFrame(list(tiers.items()), "card string, tier string")
    got = {r.card: (r.tier, r.source) for r in votes.cascade(table, cast, "place", overwrite).collect()}
    assert got == plain_cascade(cards, tiers, overwrite)
    two_ten = spark.createDataFrame([("2", "c", "v", 0), ("10", "c", "v", 1), ("3", "c", "v", 2)], table.schema)
    accepted = spark.createDataFrame([("2", "strong_accept"), ("10", "strong_accept")], "card string, tier string")
    assert {r.card: r.source for r in votes.cascade(two_ten, accepted, "place").collect()} == {"2": None, "10": None, "3": "2"}


RATED = "listener int, stem int, category string, variant string, place int, content decimal(18,2), realism decimal(18,2)"


def test_differences_take_the_first_base_row(spark):
    rows = [(1, 1, "k", "a", 2, 9, 1), (1, 1, "k", "a", 1, 4, 1), (1, 1, "k", "b", 3, 7, 1), (1, 2, "k", "b", 4, 7, 1), (1, 3, "k", "a", 5, None, 1), (1, 3, "k", "a", 6, 5, 1), (1, 3, "k", "b", 7, 7, 1), (1, 4, "k", "c", 8, None, 1), (None, 5, "k", "a", 9, 2, 1), (None, 5, "k", "b", 10, 3, 1)]
    rated = spark.createDataFrame([(*r[:5], None if r[5] is None else Decimal(r[5]), Decimal(r[6])) for r in rows], RATED)
    found = {r.place: r.difference for r in ratings.content_difference(rated, {"b": "a"}, "place").collect()}
    assert found == {2: 0.0, 1: 0.0, 3: 3.0, 4: None, 5: None, 6: 0.0, 7: None, 8: None, 9: 0.0, 10: 1.0}


def test_stems_are_grouped_in_many_parts_and_once(spark):
    rows = [(s, c, v, x, r) for s, c, v, x, r in [(1, "p", "a", 10, 20), (1, "p", "a", 30, None), (2, "p", "a", 50, 60), (None, "p", "a", 80, 10), (1, None, "a", None, 5), (1, "q", None, 7, 8), (1, "q", None, 9, 8)]]
    rated = spark.createDataFrame([(*r[:3], *(None if x is None else Decimal(x) for x in r[3:])) for r in rows], "stem long, category string, variant string, content decimal(18,2), realism decimal(18,2)")
    stats = ratings.two_level_stats(rated)
    got = {(r.category, r.variant): (r.mean_content, r.mean_realism, r.min_content, r.stems) for r in stats.collect()}
    assert got == {("p", "a"): (50.0, 30.0, 20.0, 2), (None, "a"): (None, 5.0, None, 1), ("q", None): (8.0, 8.0, 8.0, 1)}
    plan = stats._jdf.queryExecution().executedPlan().toString()
    last = plan[plan.index("Initial Plan") :]
    # the tables of a task: of stems as they come and as they are whole; none where rows are read, none of distinct stems
    assert len(re.findall(r"Aggregate\(keys=\[[^]]*stem", last)) == 2 and re.search(r"hashpartitioning\(stem\S+ category\S+ variant\S+ 200\), REPARTITION", last)
    assert "Aggregate" not in last[last.index("REPARTITION") :]


def plain_winners(rows, base_of, hidden, prefix, labels):
    first, found = {}, {}
    for listener, stem, _, variant, _, content, _ in sorted(rows, key=lambda r: r[4]):
        if variant not in base_of:
            first.setdefault((listener, stem, variant), content)

    def difference(listener, stem, variant, content):
        if variant not in base_of:
            return None if content is None else 0
        base = first.get((listener, stem, base_of[variant]))
        return None if base is None or content is None else content - base

    def mean(values):
        return sum(values) / len(values) if values else None

    for category in sorted({r[2] for r in rows}):
        own = [r for r in rows if r[2] == category]
        means = {}
        for variant in {r[3] for r in own} - {v for c, v in hidden if c == category}:
            for k, value in enumerate((lambda r: r[6], lambda r: r[5], lambda r: difference(r[0], r[1], r[3], r[5]))):
                rated = [(r[0], r[3], value(r)) for r in own if value(r) is not None]
                mine = [(who, v) for who, what, v in rated if what == variant]
                if len({who for who, _, _ in rated}) > 1:
                    m = mean([mean([v for w, v in mine if w == who]) for who in sorted({w for w, _ in mine})])
                else:
                    m = mean([v for _, v in mine])
                means.setdefault(variant, []).append(m)
        order = sorted((v for v, m in means.items() if m[0] is not None), key=lambda v: (-means[v][0], -means[v][1] if means[v][1] is not None else 1e9, v))
        if not order:
            continue
        best = means[order[0]][0]
        won = [v for v in order if abs(means[v][0] - best) <= 1e-9]
        rest = [v for v in order if v not in won]
        copies = [v[len(prefix) :] for v in won if v.startswith(prefix)]
        donor = best - means[copies[0]][0] if copies and copies[0] in order else None
        two = lambda x: None if x is None else pytest.approx(x, abs=0.00501)
        found[category] = (",".join(won), ",".join(labels.get(v, v) for v in won), two(means[won[0]][1]), two(means[won[0]][2]), two(best), two(best - means[rest[0]][0] if rest else None), two(donor))
    return found


@pytest.mark.parametrize("seed", range(6))
def test_winners_of_categories_by_plain_python(spark, seed):
    rng = random.Random(seed)
    variants = ["a", "b", "x_a", "x_b", "c"]
    rows = []
    for k in range(260):
        category = rng.choice("pqr")
        listener = 1 if category == "r" else rng.randrange(3)
        rows.append((listener, rng.randrange(6), category, rng.choice(variants), k, rng.choice([None, *range(0, 101, 10)]), rng.choice([50, 50, 60])))
    rows += [(1, 9, "s", v, 900 + k, None, 50) for k, v in enumerate(("c", "x_a", "a"))]
    rated = spark.createDataFrame([(*r[:5], None if r[5] is None else Decimal(r[5]), Decimal(r[6])) for r in rows], RATED).repartition(4)
    hidden = [("p", "b")]
    found = ratings.category_winners(rated, {"x_a": "a", "c": "b"}, "place", spark.createDataFrame(hidden, "category string, variant string"), "x_", {"c": "Cee"})
    got = {r.category: (r.winner, r.winner_label, r.content, r.content_diff, r.realism, r.margin, r.donor_margin) for r in found.collect()}
    assert got == plain_winners(rows, {"x_a": "a", "c": "b"}, hidden, "x_", {"c": "Cee"})


@pytest.mark.parametrize("seed", range(3))
def test_winners_read_ratings_once(spark, seed):
    rng = random.Random(seed)
    some = lambda *values: rng.choice([None, *values])
    rows = [(some(1, 2, 3), rng.randrange(4), some("p", "q"), some("a", "b", "x_a"), k, some(*range(0, 90, 7)), some(50, 60)) for k in range(150)]
    rows += [(some(1), 7, "s", v, 900 + k, None if v == "a" else 10 * k, 50 + 10 * k) for k, v in enumerate("aabbb")]  # one listener, or none
    rated = spark.createDataFrame([(*r[:5], *(None if x is None else Decimal(x) for x in r[5:])) for r in rows], RATED).repartition(3)
    apart = ratings.content_difference(rated, {"x_a": "a"}, "place")
    means = {(r.category, r.variant): (r.content, r.realism, r.difference) for r in ratings._means_of(apart, ["content", "realism", "difference"]).collect()}
    for k, metric in enumerate(("content", "realism", "difference")):
        of = ratings.metric_stats(apart.withColumn("difference", F.col("difference").cast(ratings.SCALE)), metric)
        assert {key: m[k] for key, m in means.items() if m[k] is not None} == pytest.approx({(r.category, r.variant): r["mean"] for r in of.collect()}, abs=1e-12)
    winners = ratings.category_winners(rated, {"x_a": "a"}, "place", None, "x_")
    for table in (apart, winners):
        plan = table._jdf.queryExecution().executedPlan().toString()
        last = plan[plan.rindex("Initial Plan") if "Initial Plan" in plan else 0 :]
        assert last.count("Scan ExistingRDD") == 1 and "Join" not in last


def test_upsert_replaces_keys_and_keeps_siblings(spark):
    old = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "path string, track int, name string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 0, "w")], "path string, track int, name string")
    assert values(tables.upsert(old, new, ["path", "track"]), "path", "track", "name") == [("a", 0, "x"), ("a", 1, "z"), ("b", 0, "w")]


def test_division_and_drift_see_nulls(spark):
    songs = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "song string, n int")
    tracks = spark.createDataFrame([("a", 0), ("a", 0), ("a", 5)], "song string, track int")
    assert values(tables.missing_tracks(tracks, songs, "song", "track", "n"), "song", "track") == [("a", 1), ("c", 0)]
    want = spark.createDataFrame([(1, None), (2, "m"), (3, "m")], "k int, v string")
    have = spark.createDataFrame([(1, None), (2, None)], "k int, v string")
    assert values(tables.drift(want, have, ["k"], ["v"]), "k", "conflict") == [(2, "changed"), (3, "missing")]


def test_profiles_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, v string")
    assert profile.length_profile(empty, profile.as_number(F.col("v")), (1.0,)).first().n == 0
    assert profile.frequency_share(empty, "k").count() == 0 and profile.top_and_other(empty, "k", 3).count() == 0
    bad = spark.createDataFrame([("x", "nan"), ("x", "oops"), ("y", "3"), (None, "9")], "k string, v string")
    row = profile.length_profile(bad, profile.as_number(F.col("v"), 5.0), (4.0,)).first()
    assert (row.n, row.p50, row.above_0) == (2, 4.0, 1)


def test_array_levels_and_spans(spark):
    rows = spark.createDataFrame([([3.0, -4.0],), ([],), (None,)], "x array<double>")
    got = rows.select(arrays.rms(F.col("x")), arrays.peak(F.col("x"))).collect()
    assert got[0] == (12.5**0.5, 4.0) and got[1] == got[2] == (0.0, 0.0)
    spans = spark.range(1).select(F.inline(arrays.chunk_spans(F.lit(25), 10, 2))).collect()
    assert [tuple(s) for s in spans] == [(0, 10), (8, 18), (16, 25)]
    with pytest.raises(ValueError):
        arrays.chunk_spans(F.lit(5), 3, 3)


def test_delimited_files_keep_missing_values_apart(spark, tmp_path):
    path = str(tmp_path / "stems")
    rows = spark.createDataFrame([("p", 1, None, 5, True, None, None, 3, float("nan")), ("q", None, 2, None, False, "n", True, None, 0.5)], sources.STEMS)
    sources.write_csv(rows, path)
    back = sources.read_csv(spark, path, sources.STEMS).orderBy("path").collect()
    assert back[0].velocity_scale is None and back[0].name is None and back[1].program is None and back[1].velocity_scale == 0.5


def test_unfinished_documents_are_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"listener_id": "a", "ratings": [{"stem_id": "s", "category": "c", "samples": [{"variant_id": "v", "content": 4, "realism": 3}]}]}')
    (tmp_path / "b.json").write_text('{"listener_id": "b", "complete": false, "ratings": []}')
    (tmp_path / "in_progress_c.json").write_text('{"listener_id": "c", "ratings": []}')
    (tmp_path / "d.json").write_text("{oops")
    got = sources.ratings_of(sources.complete_documents(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in got] == [("a", "s", "c", "v", 4.0, 3.0)]


def test_streamed_shards_end_as_the_batch_merge(spark, tmp_path):
    rows = spark.createDataFrame([(k, n, f"{k}-{n}") for n in range(4) for k in range(n, 6)], "k int, n int, v string")
    shards, target, seen = (str(tmp_path / x) for x in ("shards", "target", "seen"))
    for half in ("n < 2", "n >= 2"):
        rows.where(half).repartition(2).write.mode("append").parquet(shards)
        shard_merge.merge_shards(spark, shards, target, rows.schema, ["k"], "n", seen).awaitTermination()
    merged = shard_merge.latest(spark, target, rows.schema)
    assert values(merged, "k", "v") == values(tables.one_of_each(rows, ["k"], F.desc("n")), "k", "v")


def test_a_batch_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    shards, target, seen = (str(tmp_path / x) for x in ("shards", "target", "seen"))
    schema = "k int, n int, v string, bucket int"
    batches = [[(k, 0, "a", 7) for k in range(40)] + [(None, 0, "a", 7)], [(3, 1, "b", 8), (99, 1, "b", 8), (None, 1, "b", 8)], [(3, 0, "late", 9)], [(3, 2, "c", 9)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(shards)
        shard_merge.merge_shards(spark, shards, target, spark.createDataFrame([], schema).schema, ["k"], "n", seen, buckets=16).awaitTermination()
    merged = {r.k: (r.n, r.v, r.bucket) for r in shard_merge.latest(spark, target, spark.createDataFrame([], schema).schema).collect()}
    assert merged == {k: (0, "a", 7) for k in range(40)} | {3: (2, "c", 9), 99: (1, "b", 8), None: (1, "b", 8)}
    written = [len(list(p.glob("bucket_=*"))) for p in (tmp_path / "target" / "data").iterdir()]
    assert sorted(written)[:2] == [1, 1] and len(written) == 4
    assert shard_merge.drop_outdated(spark, target)
    assert {r.k for r in shard_merge.latest(spark, target, spark.createDataFrame([], schema).schema).collect()} == set(merged)
