"""Selections, sample masks and documents against plain Python on small tables."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stavework.functions import arrays, recipe
from stavework.operators import samples, selection, verification
from stavework.operators.sampling import seeded_key


def plain_quotas(rows, order, categories, quota, most):
    counts, kept = dict.fromkeys(categories, 0), []
    there = {c for _, c in rows} & set(categories)
    for song in order:
        if len(kept) >= most or (there and all(counts[c] >= quota for c in there)):
            break
        own = [c for s, c in rows if s == song]
        if kept and not any(c in counts and counts[c] < quota for c in own):
            continue
        kept.append(song)
        for c in own:
            if c in counts:
                counts[c] += 1
    return kept


@pytest.mark.parametrize(("quota", "most"), [(3, 100), (8, 100), (8, 5), (1, 100), (100, 1000)])
def test_quotas_are_filled_as_one_song_after_another_would(spark, quota, most):
    rng = random.Random(quota)
    rows = [(s, rng.choice("aaaaaabbbcx")) for s in range(80) for _ in range(rng.randrange(1, 4))]
    df = spark.createDataFrame(rows, "song long, category string")
    order = [r.song for r in df.select("song").distinct().orderBy(seeded_key(7, "song"), "song").collect()]
    found = selection.fill_quotas(df, "song", "category", "abcd", quota, most, 7)
    kept = [r.song for r in found.select("song", "position").distinct().orderBy("position").collect()]
    assert kept == plain_quotas(rows, order, "abcd", quota, most)
    assert found.count() == sum(s in kept for s, _ in rows)


def test_quotas_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "song long, category string")
    assert selection.fill_quotas(empty, "song", "category", "ab", 2, 5, 1).count() == 0


def test_best_windows_keep_their_distance(spark):
    rng = random.Random(2)
    rows = [(g, float(s), rng.choice([None, 1.0, 2.0, rng.random()])) for g in (1, 2, None) for s in range(20)] + [(4, 1.0, None)]
    found = selection.best_apart(spark.createDataFrame(rows, "g int, s double, v double"), "g", "s", "v", 3, 5.0)
    for g in (1, 2, None, 4):
        picks = []
        for _, s, _ in sorted((r for r in rows if r[0] == g and r[2] is not None), key=lambda r: (-r[2], r[1])):
            if len(picks) < 3 and all(abs(s - p) >= 5 for p in picks):
                picks.append(s)
        assert [r.s for r in sorted(found.collect(), key=lambda r: r["index"]) if r.g == g] == sorted(picks)


def plain_matches(reference, rendered, tolerance):
    left, n = sorted(rendered), 0
    for x in sorted(reference):
        near = min(left, key=lambda c: (abs(c - x), c), default=None)
        if near is not None and abs(near - x) <= tolerance:
            left.remove(near)
            n += 1
    return n


@pytest.mark.parametrize("seed", range(60))
def test_matches_are_those_of_a_scan_of_all_candidates(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(rng.choice([5, 60, 400])) / 8 for _ in range(rng.randrange(80))] for _ in range(2))
    tolerance = rng.choice([0, 0.125, 0.5, 3.0, 100.0])
    assert arrays.match_count(np.sort(np.array(a, float)), np.sort(np.array(b, float)), tolerance) == plain_matches(a, b, tolerance)


@pytest.mark.parametrize("spread", [1e-9, 1.0, 1e6])
def test_fifty_thousand_onsets_take_seconds(spark, spread):
    rng = np.random.default_rng(1)
    a, b = (np.sort(rng.random(50_000) * spread) for _ in range(2))
    began = time.perf_counter()
    found = arrays.match_count(a, b, 0.05)
    assert time.perf_counter() - began < 2 and 0 < found <= 50_000
    df = spark.createDataFrame([(a[:5_000].tolist(), b[:5_000].tolist())] * 3, "a array<double>, b array<double>")
    assert {r.n for r in df.select(arrays.matched_onsets(F.col("a"), F.col("b"), 0.05).alias("n")).collect()} == {arrays.match_count(a[:5_000], b[:5_000], 0.05)}


@pytest.mark.parametrize("seed", range(8))
def test_windows_apart_are_the_greedy_ones(spark, seed):
    rng = random.Random(seed)
    n, apart = rng.choice([1, 2, 5, 12]), rng.choice([1.0, 3.5, 10.0])
    kinds = {0: lambda s: rng.randrange(6), 1: lambda s: s, 2: lambda s: -s, 3: lambda s: rng.random()}  # ties, chains, none
    rows = [(g, float(rng.randrange(120)) / rng.choice([1, 2]), float(kinds[g % 4](k))) for g in range(8) for k in range(rng.choice([3, 60, 400]))]
    df = spark.createDataFrame(rows, "g int, s double, v double").repartition(5)
    found = {}
    for r in selection.best_apart(df, "g", "s", "v", n, apart).collect():
        found.setdefault(r.g, {})[r["index"]] = r.s
    for g in range(8):
        picks = []
        for _, s, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if len(picks) < n and all(abs(s - p) >= apart for p in picks):
                picks.append(s)
        assert found[g] == dict(enumerate(sorted(picks)))


def test_a_hundred_thousand_windows_are_read_twice(spark):
    df = spark.range(200_000).selectExpr("id % 3 as g", "id div 3 as s", "cast(id * 7919 % 100003 as double) as v")
    found = selection.best_apart(df, "g", "s", "v", 20, 1_000)
    assert found.groupBy("g").count().where("count = 20").count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Range (0") == 2


def test_onsets_match_one_to_one(spark):
    cases = [([1.0, 1.04], [1.03], 1), ([1.0, 1.04], [1.02, 1.06], 2), ([], [1.0], 0), ([1.0], None, 0), ([1.0, 1.0], [1.0, 1.0], 2), ([0.0, 1.0], [0.2, 1.05], 1)]
    df = spark.createDataFrame(cases, "a array<double>, b array<double>, n int")
    for r in df.select("n", arrays.matched_onsets(F.col("a"), F.col("b"), 0.0501).alias("found")).collect():
        assert r.found == r.n
    odd = spark.createDataFrame([([1.0, None, float("nan")], [float("nan"), 1.0, None]), (None, None)], "a array<double>, b array<float>")
    assert [r.n for r in odd.select(arrays.matched_onsets(F.col("a"), F.col("b"), 9.0).alias("n")).collect()] == [1, 0]
    f1 = spark.range(1).select(*(arrays.f1(*map(F.lit, t)) for t in ((0, 0, 0), (0, 3, 0), (2, 4, 2)))).first()
    assert f1[0] == 1.0 and f1[1] == 0.0 and f1[2] == pytest.approx(2 / 3)
    mask = F.array(F.lit(True), F.lit(False), F.lit(True))
    onsets = F.array(*(F.lit(t) for t in (-1.0, 0.05, 0.1, 0.15, 9.0)))
    assert spark.range(1).select(arrays.active_onsets(onsets, mask, 10)).first()[0] == [-1.0, 0.05, 0.15, 9.0]


@pytest.mark.parametrize("block", [1 << 13, 9])
@pytest.mark.parametrize(("chunk", "overlap", "margin", "fade"), [(8, 4, 2, 3), (10, 0, 0, 1), (7, 5, 40, 4), (100, 10, 3, 6), (5, 1, 1, 0), (6, 0, 0, 12)])
def test_silence_masks_and_ramps(spark, chunk, overlap, margin, fade, block):
    rng = np.random.default_rng(chunk)
    waves = []
    for g in range(12):
        n = int(rng.integers(1, 60))
        dry, wet = rng.random(n) * (rng.random(n) < 0.1), rng.random(n + 3) * (rng.random(n + 3) < 0.4)
        waves.append((g, dry.tolist(), wet.tolist()))
    df = spark.createDataFrame(waves, "g int, dry array<double>, wet array<double>")
    cut = samples.blocks(df, "g", "dry", "wet", block=block)
    silent = samples.hallucinated(cut, "g", "dry", "wet", chunk, overlap, -20.0, margin, block)
    done = samples.enforce_silence(cut, silent, "g", "wet", fade, block).orderBy("g", "block").collect()
    scores = {r.g: r for r in samples.silence_score(cut, silent, "g", "wet", 10, block).collect()}
    for g, dry, wet in waves:
        n = len(dry)
        active = np.abs(dry) >= 0.1
        raw = np.zeros(n, dtype=bool)
        for start in range(0, n, chunk - overlap):
            end = min(start + chunk, n)
            if 20 * np.log10(np.abs(wet[start:end]).max() + 1e-10) >= -20:
                raw[start:end] |= ~active[start:end]
            if end >= n:
                break
        near = np.array([active[max(0, i - margin) : i + margin + 1].any() for i in range(n)])
        if margin and 2 * margin + 1 >= n:
            near[:] = active.any()
        mask = raw & ~near
        value = np.where(mask, 0.0, wet[:n])
        before = np.r_[False, mask[:-1]]
        for edges, ramp in ((mask & ~before, lambda t: 1 - t), (~mask & before, lambda t: t)):
            for i in np.flatnonzero(edges):
                for k in range(min(fade, n - i)):
                    value[i + k] = wet[i + k] * ramp((k + 1) / fade)
        own = [r for r in done if r.g == g]
        assert [x for r in own for x in r.silent] == mask.tolist()
        assert [x for r in own for x in r.value] == pytest.approx(value.tolist())
        hit = np.flatnonzero(mask)
        loudest = max((20 * np.log10(abs(wet[i]) + 1e-10) for i in hit[:: max(1, len(hit) // 100)]), default=-np.inf)
        assert (scores[g].samples, scores[g].seconds, scores[g].max_db, scores[g].passes) == (len(hit), len(hit) / 10, pytest.approx(loudest), not len(hit))


def test_half_an_hour_is_some_thousand_intervals(spark):
    rng = np.random.default_rng(8)
    n = 4_000_000
    dry, wet = np.zeros(n, dtype=np.float32), (rng.random(n) * 0.5).astype(np.float32)
    for at in rng.integers(0, n, 300):
        dry[at : at + 2_000] = 0.5
    waves = spark.createDataFrame(pa.table({"g": [1], "dry": [dry], "wet": [wet]}))
    cut = samples.blocks(waves, "g", "dry", "wet")
    silent = samples.hallucinated(cut, "g", "dry", "wet", 4_410, 2_205, -40.0, 2_205).toPandas()
    assert 100 < len(silent) < 2_000
    active = np.flatnonzero(dry >= 0.01)
    near = np.zeros(n + 1)
    np.add.at(near, np.maximum(active - 2_205, 0), 1)
    np.add.at(near, np.minimum(active + 2_206, n), -1)
    mask = np.zeros(n, dtype=bool)
    for a, b in zip(silent.start, silent.end, strict=True):
        mask[a:b] = True
    assert (mask == (np.cumsum(near)[:-1] == 0)).all()


@pytest.mark.parametrize("seed", range(4))
def test_stitched_blocks_are_the_plain_sum(spark, seed):
    rng = np.random.default_rng(seed)
    chunks, want = [], {}
    for g in range(5):
        total, size, overlap = int(rng.integers(1, 90)), int(rng.integers(6, 30)), 5
        spans = [(0, min(size, total))]
        while spans[-1][1] < total:
            start = spans[-1][0] + size - overlap
            spans.append((start, min(start + size, total)))
        sums, weights = np.zeros(total), np.zeros(total)
        for k, (a, b) in enumerate(spans):
            x = rng.random(b - a - int(rng.integers(0, 2)))
            chunks.append((g, k, k == len(spans) - 1, a, b, x.tolist()))
            length = b - a
            fade = min(overlap, length)
            weight = np.ones(length)
            if k:
                weight[:fade] = np.minimum(weight[:fade], np.linspace(0, 1, fade) if fade > 1 else 0)
            if k < len(spans) - 1:
                weight[-fade:] = np.minimum(weight[-fade:], np.linspace(1, 0, fade) if fade > 1 else 1)
            sums[a:b] += np.r_[x, np.zeros(length - len(x))] * weight
            weights[a:b] += weight
        want[g] = sums / np.maximum(weights, 1e-8)
    df = spark.createDataFrame(chunks, "g int, chunk int, last boolean, start int, end int, samples array<double>").repartition(3)
    for block in (1 << 13, 7):
        for g in range(5):
            got = [x for r in samples.stitch(df.where(F.col("g") == g), "g", 5, block).orderBy("block").collect() for x in r.value]
            assert got == pytest.approx(want[g].tolist())


def test_sums_of_stems_of_any_length(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), [rng.randrange(-900, 900) / 1000 for _ in range(rng.randrange(1, 40))]) for _ in range(60)]
    stems = samples.blocks(spark.createDataFrame(rows, "g string, x array<double>").repartition(4), "g", "x", block=8)
    for g, peak, gain in samples.mixture_gain(stems, "g", "x").collect():
        sums = [sum(round(x[i] * 1000) for h, x in rows if h == g and i < len(x)) for i in range(40)]
        top = max(map(abs, sums)) / 1000
        assert peak == top and gain == pytest.approx(min(1.0, 1.0 / top))
    louder = samples.with_gain(stems, samples.mixture_gain(stems, "g", "x"), "g", "x")
    assert louder.count() == stems.count() and samples.mixture_gain(louder, "g", "x").where("peak > 1.0001").count() == 0


def test_chunks_of_one_and_of_none(spark):
    rows = [(1, 0, True, 0, 4, [1.0, 2.0]), (2, 0, True, 0, 0, [1.0]), (3, 0, False, 0, 3, [1.0] * 3), (3, 1, True, 2, 4, [3.0] * 2)]
    found = samples.stitch(spark.createDataFrame(rows, "g int, chunk int, last boolean, start int, end int, samples array<double>"), "g", 1).orderBy("g").collect()
    assert [(r.g, r.block, r.value) for r in found] == [(1, 0, [1.0, 2.0, 0.0, 0.0]), (3, 0, [1.0, 1.0, 1.0, 3.0])]


def test_verification_rules(spark):
    stems = "array<struct<bypass_realify: boolean>>"
    rows = [
        (1, 0, "piano", ["a", "b"], "a", False, [(True,), (False,)]),
        (1, 1, "drums", [], None, True, []),
        (1, 2, "bass", ["a"], "c", None, [(True,), (True,)]),
        (1, 3, None, ["a"], "a", None, None),
        (1, 4, "piano", None, "b", None, None),
    ]
    found = spark.createDataFrame(rows, f"doc int, position int, category string, approved array<string>, winner_variant_id string, bypass_realify boolean, stems {stems}")
    assert {(r.category, r.winner_variant_id) for r in verification.winners(found, "doc").collect()} == {("piano", "b"), ("bass", "c")}
    assert {(r.category, *r.approved) for r in verification.shortlists(found, "doc").collect()} == {("piano", "a", "b"), ("bass", "a")}
    assert {(r.category, r.bypassed) for r in verification.bypass(found, "doc").collect()} == {("piano", "none"), ("drums", "all"), ("bass", "all")}
    assert {(r.position, r.error) for r in verification.errors(found, "doc").collect()} == {
        (2, "bass: winner must be among approved variants"), (3, "missing category"), (4, "piano: approve at least one variant"), (4, "piano: winner must be among approved variants"),
    }
    assert [r.position for r in verification.errors(found, "doc", shortlist_only=True).orderBy("position").collect()] == [1, 3, 4]
    votes = spark.createDataFrame([("piano", "a", "weak_accept", 1), ("piano", "a", "strong_accept", 2), ("piano", "b", "strong_accept", 3), ("piano", "b", "weak_reject", 4)], "category string, variant_id string, tier string, at int")
    listed = spark.createDataFrame([("piano", "b", 0), ("piano", "a", 1), ("bass", "a", 0)], "category string, variant_id string, place int")
    assert {(r.category, *r.approved) for r in verification.approved_by_votes(votes, listed, "at").collect()} == {("piano", "a"), ("bass",)}


def test_recipes(spark):
    rows = [("MIDI_DDSP ", True, None), ("slakh", None, "basic"), ("x", True, None), ("basic", False, "other"), (None, True, "basic")]
    df = spark.createDataFrame(rows, "m string, r boolean, f string")
    found = [r.p and tuple(r.p) for r in df.select(recipe.spec_parts(F.col("m"), F.col("r"), F.col("f")).alias("p")).collect()]
    assert found == [("midi-ddsp", True, "basic"), ("slakh", False, "slakh"), None, None, None]
    problems = recipe.category_problems(spark.createDataFrame([("piano",), ("zither",)], "category string"), ["piano", "drums"])
    assert {tuple(r) for r in problems.collect()} == {("drums", "missing"), ("zither", "unknown")}
    label = recipe.reused_label(F.lit("basic"))
    assert tuple(spark.range(1).select(label, recipe.reused_mode(label, ["basic"]), recipe.reused_mode(label, ["slakh"])).first()) == ("reused:basic", "basic", None)
