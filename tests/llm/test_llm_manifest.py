"""Manifest, clustering and exact groups against plain Python, with odd rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stavework.llm import centroid_clustering as cc
from stavework.llm import exact_dedup as ed
from stavework.llm import merkle_manifest as mm

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves, fanout):
    """Levels of a tree, from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def plain_way(levels, i, fanout):
    found = []
    for level in levels[:-1]:
        first = i // fanout * fanout
        found.append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
        i //= fanout
    return found


def plain_manifest(rows, fanout=2):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = plain_tree([x[2] for x in groups[g]], fanout)
    top = plain_tree([trees[g][-1][0] for g in names], fanout)
    found = []
    for k, g in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(groups[g]):
            way = plain_way(trees[g], i, fanout) + plain_way(top, k, fanout)
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                node = plain_leaf((*row[:3], None if row[3] is None else row[3] + 1, row[4]))
            for a, b in way:
                node = sha(a + node + b)
            found.append((row[0], leaf, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in way)), node, node == top[-1][0]))
    return found, trees, top


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def keyed(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def odd_documents(n, seed, langs=("en", "de", None, "é", "", "z" * 50)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "en" if rng.random() < 0.5 else rng.choice(langs)
        rows.append((rng.choice([None, i, i, i, i // 3, -i]), rng.choice([None, "web", "b:k"]), lang, rng.choice([None, i, 0]), rng.choice([None, "", "a\nb", "naïve " * 50])))
    return rows + rows[: n // 10]


@pytest.mark.parametrize(("fanout", "run_rows", "merge_rows"), [(2, 1 << 17, 1 << 18), (2, 20, 60), (3, 15, 1 << 18), (5, 7, 1 << 18)])
def test_manifest_is_the_plain_one(spark, fanout, run_rows, merge_rows):
    rows = odd_documents(700, fanout + run_rows)
    docs = spark.createDataFrame(rows, DOCS).withColumn("grp", F.lit("x")).withColumn("pid", F.lit(1)).repartition(5)
    expected, trees, top = plain_manifest(rows, fanout)
    found = mm.verify(docs, fanout, run_rows, merge_rows).select(*COLUMNS).collect()
    assert keyed(map(tuple, found)) == keyed(expected)
    if merge_rows > 1000:
        nodes = mm.manifest(docs, fanout, run_rows, merge_rows).collect()
        want = [("group", g, k, j, h) for g, t in trees.items() for k, level in enumerate(t) for j, h in enumerate(level)]
        want += [("dataset", None, k, j, h) for k, level in enumerate(top) if k for j, h in enumerate(level)]
        assert keyed(map(tuple, nodes)) == keyed(want)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 3, "abc")], [(7, None, None, None, None)] * 40, [(i, "s", f"l{i}", i, "t") for i in range(90)]])
def test_manifest_of_small_and_equal_tables(spark, rows):
    found = mm.verify(spark.createDataFrame(rows, DOCS), run_rows=16).select(*COLUMNS).collect()
    assert keyed(map(tuple, found)) == keyed(plain_manifest(rows)[0] if rows else [])


@pytest.mark.parametrize("fanout", [2, 3, 4])
def test_runs_of_any_place_have_the_nodes_of_the_whole_tree(fanout):
    rng = random.Random(fanout)
    for n in [1, 2, 3, 7, 8, 9, 26, 27, 28, 65]:
        leaves = [sha(str(i)) for i in range(n)]
        tree = plain_tree(leaves, fanout)
        for _ in range(20):
            start = rng.randrange(n)
            end = rng.randrange(start, n) + 1
            around = {(k, j): tree[k][j].encode() for k, j in mm.wanted_outside(start, end - start, n, fanout)}
            assert len(around) <= 2 * fanout * len(tree)
            run = mm.Run([x.encode() for x in leaves[start:end]], start, n, fanout, around)
            for k in range(end - start):
                assert [(a.decode(), b.decode()) for a, b in run.path(k)] == plain_way(tree, start + k, fanout)


def plain_clusters(rows, k, rounds, components=4):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and abs(x) < cc.LIMIT for x in v)]
    order = sorted(usable, key=lambda r: (r[0] is None, sha(f"2:{r[0]}"), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in usable:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if own[j] else c for j, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in usable]
    inertia = defaultdict(int)
    for _, c, d in found:
        inertia[c] += d
    return [(i, c, d, inertia[c], sum(inertia.values()), sha(",".join(map(str, centroids[c])))) for i, c, d in found]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_are_the_plain_ones(spark, kind):
    rng = random.Random(5)
    grid = lambda: [rng.randrange(-8, 9) / 256 for _ in range(4)]  # noqa: E731  many equal distances
    rows = [(i, grid()) for i in range(400)] + [(i, grid()) for i in range(30)] + [(None, grid()) for _ in range(3)] + [(900 + i, [0.0, 0.0, 0.0, 0.0]) for i in range(150)]
    rows += [(700, None), (701, []), (702, [1.0, None, 0.0, 0.0]), (703, [math.nan, 0.0, 0.0, 0.0]), (704, [math.inf, 0.0, 0.0, 0.0]), (705, [0.0] * 5), (706, [-600000.0, 0.0, 0.0, 0.0]), (707, [-524287.0, 3.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("cluster", F.lit("x")).repartition(3)
    for k, rounds in ((9, 3), (600, 1)):
        found = cc.cluster(vectors, k, rounds, components=4).collect()
        assert keyed(map(tuple, found)) == keyed(plain_clusters(rows, k, rounds))
    none = spark.createDataFrame([], f"vec_id long, embedding array<{kind}>")
    assert cc.cluster(none).collect() == [] and cc.cluster(none).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_ring_leaves_out_far_centroids_and_keeps_the_edge():
    rng = np.random.default_rng(3)
    centroids = np.vstack([rng.integers(-9, 9, (20, 3)), [[100, 0, 0], [0, 100, 0], [-100, 0, 0]]])
    vectors = np.vstack([rng.integers(-9, 9, (200, 3)), [[0, 0, 0], [50, 0, 0], [100, 1, 0]]])
    ring = cc.Ring(centroids)
    first, end = ring.candidates(vectors)
    assert (end - first).mean() < 0.8 * len(centroids)
    number, distance = ring.nearest(vectors)
    every = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()


def plain_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    found = []
    for i, text in rows:
        own = groups[text or ""]
        keep = max((x for x in own if x is not None), default=None)
        found.append((i, keep, len(own), i == keep, sha(text or "")))
    return found


@pytest.mark.parametrize("table_bytes", [ed.TABLE_BYTES, 2000])
def test_exact_groups_are_the_plain_ones(spark, table_bytes):
    rng = random.Random(table_bytes)
    texts = [None, "", " ", "a", "A", "é", "é", "x" * 300_000, "x" * 299_999 + "y"] + ["t" * rng.randrange(90) + str(i) for i in range(300)]
    rows = [(rng.choice([None, i, i, i, i // 2]), "hot" if rng.random() < 0.4 else rng.choice(texts)) for i in range(1500)]
    rows += rows[:50]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sha", F.lit("x")).withColumn("keep_id", F.lit(0)).repartition(7)
    found = ed.exact_groups(docs, table_bytes).collect()
    assert keyed(map(tuple, found)) == keyed(plain_groups(rows))
    kept = ed.deduplicate(docs, table_bytes)
    assert kept.columns == docs.columns
    assert keyed((r.doc_id, r.text or "") for r in kept.collect()) == keyed((i, t or "") for (i, t), g in zip(rows, plain_groups(rows), strict=True) if g[3])
    named = ed.exact_groups(spark.createDataFrame([("b", "x"), ("a", "x"), ("c", None)], "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.keep_id) for r in named) == [("a", "b"), ("b", "b"), ("c", "c")]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ed.exact_groups(none).collect() == [] and ed.deduplicate(none).collect() == []


def test_tables_spill_by_digits_and_compare_content(tmp_path):
    rng = random.Random(9)
    for same_hash in (False, True):
        contents = [bytes([65 + i % 7]) * rng.randrange(1, 40) + str(i).encode() for i in range(500)]
        records = [(7 if same_hash and c[0] < 68 else int.from_bytes(hashlib.sha256(c).digest()[:8], "big", signed=True), c, rng.choice([None, i]), 1 + i % 3) for i, c in enumerate(rng.choices(contents, k=4000))]
        want = {}
        for _, c, i, n in records:
            old = want.get(c, (None, 0))
            want[c] = (max((x for x in (old[0], i) if x is not None), default=None), old[1] + n)
        spilled = []
        real = ed.SpillFile.close
        try:
            ed.SpillFile.close = lambda self: (spilled.append(self.path), real(self))[1]
            found = list(ed.resolve(iter(records), pa.int64(), tmp_path, table_bytes=2000))
        finally:
            ed.SpillFile.close = real
        assert {c: (i, n) for _, c, i, n in found} == want and len(found) == len(want)
        assert len(spilled) > 16 and not list(tmp_path.iterdir())
