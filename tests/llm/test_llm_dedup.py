"""Line, near and substring de-duplication and decontamination against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stavework.llm import decontamination, line_dedup, queries, simhash, substring_dedup
from stavework.llm.components import components

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLE_SQL[name])


def roots(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(150, 150), (151, 152), (152, 151)]
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    rng.shuffle(edges)
    expected = roots(300, edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: expected[x] for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_the_definition():
    for text in ("", "one", "Two Words", "a B\tc\x0bd\x1ce É x", "x " * 500 + "y", "tie tie tie tie"):
        assert simhash.fingerprint_of(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("small_block", [1, 24])
def test_near_duplicates_link_as_all_pairs_do(spark, small_block):
    rng = random.Random(7)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(250):  # chains and families around a few of them
        f = rng.choice(prints[:6] + prints[-10:])
        for _ in range(rng.randrange(1, 4)):
            f ^= 1 << rng.randrange(64)
        prints.append(f)
    prints = list(dict.fromkeys(prints))
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in prints], "fp long"), small_block).collect()
    number = {signed(x): i for i, x in enumerate(prints)}
    assert roots(len(prints), [(number[e.a], number[e.b]) for e in edges]) == roots(len(prints), near)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(5, "a b c d"), (3, "A  b\nC d"), (9, None), (8, ""), (8, ""), (7, "other words here now"), (None, "a b c d")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, _gone string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (8, 8), (7, 7), (None, 3)], key=str)
    assert sorted(r.doc_id for r in simhash.keep_one(docs.where("doc_id is not null")).collect()) == [3, 7, 8, 8]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def plain_lines(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(r for r in rows if r[0] is not None):
        lines = (text or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            window = tuple(x.strip(" ") for x in lines[i : i + 3])
            if any(window):
                if window in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(window)
        out[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_lines_by_brute_force(spark):
    rng = random.Random(2)
    pool = ["alpha", "beta", "", "gamma", " gamma ", "δelta"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    rows += [(100, ""), (101, "x\nx\nx\nx\nx"), (102, "\n" * 50), (103, "x\n" * 3000)]
    docs = spark.createDataFrame([(*r, "keep", 4) for r in rows] + [(200, None, "keep", 4), (None, rows[0][1], "keep", 4)], "doc_id long, text string, lines string, _gone int")
    got = line_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    found = {r.doc_id: r for r in got.collect()}
    assert all(r["lines"] == "keep" and r["_gone"] == 4 for r in found.values())
    assert {k: r.text for k, r in found.items() if k is not None and k != 200} == plain_lines(rows)
    assert found[200].text is None and found[None].text == rows[0][1]
    assert line_dedup.deduplicate(docs.where("false")).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    shared, other = "a\nb\nc", "d\ne\nf"
    rows = [(1, "x\ny\n" + shared), (1, "p\nq\nr\ns\nt"), (1, shared), (2, shared + "\n" + other), (2, other), (2, other), (3, other)]
    found = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # rows of one id keep what they share; a later id loses it; no other line goes
    assert sorted(map(tuple, found)) == sorted([rows[0], rows[1], rows[2], (2, other), (2, other), (2, other), (3, "")])


def test_a_hot_window_is_split(spark):
    """The join of windows with their first documents has two plain shuffles below it and is dealt anew above it."""
    hot = "the same line\nand the next\nand one more\n"
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, F.lit(hot)).otherwise(F.lit("")), F.lit("u\nv\n"), F.col("id").cast("string")).alias("text"))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    kept = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        found = line_dedup.repeats(docs)
        assert found.count() == 9_999
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plain_substrings(rows, window):
    first, out = {}, {}
    texts = {d: (t or "").encode().split() for d, t in sorted(rows)}
    for d, words in texts.items():
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), (d, i))
    for d, words in texts.items():
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] != (d, i):
                gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[d] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard_runs", [1, 2_000])
def test_substrings_by_brute_force(spark, shard_runs):
    rng = random.Random(11)
    passages = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(n)) for n in (20, 35, 80, 21, 19)]
    rows = [(i, " ".join(rng.choice([*passages, "x y", "lone", f"w{i}"]) for _ in range(rng.randrange(0, 7)))) for i in range(50)]
    rows += [(60, "same " * 90), (61, "same " * 45), (62, None), (63, ""), (64, "tab\tand  nbsp " * 15), (65, "p q " * 2000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, anchor string, runs int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicate(docs, 20, shard_runs).collect()}
    assert got == plain_substrings(rows, 20)
    assert substring_dedup.deduplicate(docs.where("false")).count() == 0


@pytest.mark.parametrize("window", [6, 20, 33, 48, 62])
def test_first_windows_of_any_length_by_brute_force(window):
    rng = random.Random(window)
    # few words, and windows that differ in one late word
    base = [rng.choice("ab") for _ in range(70)]
    segments = []
    for k in range(120):
        words = list(base)
        words[rng.randrange(30, 70)] = rng.choice("abc")
        segments.append((" ".join(words[rng.randrange(0, 5) :]).encode()[: 2 * min(window + 10, 65) - 1], k, 0))
    seen, want = set(), {}
    for content, doc_id, _ in segments:
        words = content.split()
        for i in range(len(words) - window + 1):
            if (w := tuple(words[i : i + window])) not in seen:
                seen.add(w)
                want[doc_id] = want.get(doc_id, 0) | 1 << i
    assert {d: bits for d, _, bits in substring_dedup.shard_firsts(segments, window)} == want


@pytest.mark.parametrize(("most", "letters"), [(1, "ab"), (5, "ab"), (20, "ab"), (20, "abcdefghijklmnop"), (40, "a")])
def test_matching_statistics_by_brute_force(most, letters):
    rng = random.Random(most)
    contents = [" ".join(rng.choice(letters) for _ in range(rng.randrange(most, most + 40))).encode() for _ in range(25)]
    contents += contents[:3]
    symbols, starts = substring_dedup.numbered(contents)
    text = symbols.tolist()
    ends = np.array([e for a, b in zip(starts, starts[1:], strict=False) for e in range(a + most - 1, b - 1)])
    index = substring_dedup.FMIndex(symbols, most)
    length, name = index.matches(symbols, ends, most)
    names = {}
    for e, n, k in zip(ends.tolist(), length.tolist(), name.tolist(), strict=True):
        best = 0
        while best < most and sum(text[i - best : i + 1] == text[e - best : e + 1] for i in range(best, len(text))) > 1:
            best += 1
        assert n == best
        if n == most:
            assert names.setdefault(k, text[e - most + 1 : e + 1]) == text[e - most + 1 : e + 1]
    assert len({tuple(v) for v in names.values()}) == len(names)


def test_words_as_numbers():
    symbols, starts = substring_dedup.numbered([b"a b a", b"c", b"b b"])
    assert symbols.tolist() == [1, 2, 1, 0, 3, 0, 2, 2, 0] and starts.tolist() == [0, 4, 6, 9]


def test_substrings_of_rows_that_share_an_id(spark):
    p, q = (" ".join(f"{x}{i}" for i in range(30)) for x in "pq")
    rows = [(1, p), (2, f"{p} c"), (2, f"{q} d"), (2, f"{q} d"), (3, q), (None, p), (5, p), (5, p), (5, None)]
    found = substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in found)
    # q stays in both equal rows of 2, which lose nothing for each other, and goes from 3 only
    assert got == sorted([("1", 30, 0), ("2", 31, 30), ("2", 31, 0), ("2", 31, 0), ("3", 30, 30), ("None", 30, 0), ("5", 30, 30), ("5", 30, 30), ("5", 0, 0)])
    assert {r.kept for r in found if r.n_removed} == {"c", ""}


def test_an_index_is_small():
    rng = random.Random(3)
    contents = [" ".join(f"w{min(rng.randrange(1, 40_000), rng.randrange(1, 40_000))}" for _ in range(30)).encode() for _ in range(6_500)]
    rows = [(c, i, 0) for i, c in enumerate(contents)] + [(c, i + 10_000, 0) for i, c in enumerate(contents[:500])]
    tracemalloc.start()
    assert len(substring_dedup.shard_firsts(rows, 20)) == len(set(contents))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    symbols, _ = substring_dedup.numbered(contents)
    assert substring_dedup.FMIndex(symbols, 20).nbytes < 3 << 20 and peak < 60 << 20, peak


def test_a_window_of_all_segments_comes_to_its_shard_once(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    hot = spark.createDataFrame([(7, f"l{i} {passage}".encode(), i, 3) for i in range(1_000)], "anchor long, content binary, doc_id long, start long")
    dealt = substring_dedup.split_hot(hot, 20, 10)
    sizes = {r.shard: r["count"] for r in dealt.groupBy("shard").count().collect()}
    assert len(sizes) > 90 and max(sizes.values()) < 50
    found = substring_dedup.hot_firsts(substring_dedup.firsts(dealt, 20)).collect()
    bits = {}
    for r in found:
        assert r.start == 3 and not bits.get(r.doc_id, 0) & r.bits
        bits[r.doc_id] = bits.get(r.doc_id, 0) | r.bits
    assert bits == {i: 3 if i == 0 else 1 for i in range(1_000)}


@pytest.mark.parametrize("shard_runs", [3, 20])
def test_shared_passages_after_different_texts(spark, shard_runs):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    other = lambda n: " ".join(f"x{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, f"{other(rng.randrange(1, 30))} {passage} {other(rng.randrange(0, 30))}" + f" {passage}" * (i % 9 == 0)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicate(docs, 20, shard_runs).collect()}
    assert got == plain_substrings(rows, 20)


def test_decontamination_in_blocks_is_decontamination_in_one(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (decontamination.find(docs, items, block_bytes=b).drop("hit_spans") for b in (1 << 24, 2_000))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


@pytest.mark.parametrize("block_bytes", [1 << 24, 40])
def test_every_row_is_judged_by_its_own_text(spark, block_bytes):
    items = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i}") for i in range(6)], "item_id long, text string")
    hit, both = "x alpha1 beta1 gamma1", "alpha2 beta2 gamma2 y alpha4 beta4 gamma4"
    rows = [(None, hit), (None, "clean"), (None, None), (1, hit), (1, "clean text"), (1, both), (1, both), (2, "clean")]
    docs = spark.createDataFrame([(*r, k, "t") for k, r in enumerate(rows)], "doc_id long, text string, row_key int, Items string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.find(docs, items, block_bytes=block_bytes).collect()]
    want = [(None, 4, 3, 1, True), (None, 1, 0, 0, False), (None, 0, 0, 0, False), (1, 4, 3, 1, True), (1, 2, 0, 0, False), (1, 7, 6, 2, True), (1, 7, 6, 2, True), (2, 1, 0, 0, False)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = decontamination.remove(docs, items, block_bytes=block_bytes)
    assert kept.columns == docs.columns and sorted(r.row_key for r in kept.collect()) == [1, 2, 4, 7]


def test_an_item_larger_than_a_block_is_cut(spark):
    rng = random.Random(21)
    long = [f"w{rng.randrange(400)}" for _ in range(3_000)]
    items = spark.createDataFrame([(1, " ".join(long)), (2, "some short words"), (3, " ".join(long[500:700]))], "item_id long, text string")
    most = 8_000
    blocks = decontamination.blocks_of(items, 13, most)
    sizes = [decontamination.Block([(r.id, r.text.encode()) for r in b.collect()], 13).nbytes for b in blocks]
    assert len(blocks) > 10 and max(sizes) < 3 * most
    rows = [(i, " ".join(long[i * 9 : i * 9 + rng.randrange(5, 60)])) for i in range(330)] + [(900, " ".join(long)), (901, "no"), (902, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (decontamination.find(docs, items, block_bytes=b).collect() for b in (1 << 26, most))
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
    assert next(r.n_hit for r in many if r.doc_id == 900) == 3_000


def test_pieces_have_every_window():
    rng = random.Random(22)
    for most in (1, 60, 300, 10_000):
        words = [b"x" * rng.randrange(1, 30) + str(i).encode() for i in range(rng.randrange(0, 60))]
        parts = [p.split() for p in decontamination.pieces_of(words, 4, most)]
        windows = [tuple(p[i : i + 4]) for p in parts for i in range(max(1, len(p) - 3))]
        assert windows == [tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3) if words else 0)]


def test_short_items_nulls_and_removal(spark):
    items = spark.createDataFrame([(10, "Just Five small-words here"), (2, None), (None, "a b"), (3, "!!"), (2, "q w")], "item_id long, text string")
    rows = [(1, "x just five SMALL words here y"), (2, None), (3, ""), (4, "clean " * 90 + "q, w"), (5, "q w"), (5, "q w"), (6, "a b")]
    docs = spark.createDataFrame([(*r, "k", "z") for r in rows], "doc_id long, text string, item_id string, _bad_id string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.find(docs, items).collect()}
    assert got == {1: (7, 5, 1, True), 2: (0, 0, 0, False), 3: (0, 0, 0, False), 4: (92, 2, 1, False), 5: (2, 2, 1, True), 6: (2, 0, 0, False)}
    kept = decontamination.remove(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(docs, items).collect()}
    assert cut[1].split() == ["x", "y"] and cut[6] == "a b"
    extra = docs.unionByName(spark.createDataFrame([(7, "Just, five SMALL words; q w q just five small words here.", "k", "z")], docs.schema))
    for block_bytes in (1 << 24, 40):
        found = decontamination.remove_spans(extra, items, block_bytes=block_bytes)
        assert found.columns == docs.columns
        by_id = {r.doc_id: r.text for r in found.collect()}
        assert by_id[2] is None and by_id[3] == "" and by_id[7].split() == ["Just,", "five", "SMALL", "words;", "q", "."]
    assert decontamination.find(docs, items.where("false")).where("n_hit > 0").count() == 0
    assert decontamination.find(docs.where("false"), items).count() == 0
    assert decontamination.find(docs, items).agg(F.count("*")).first()[0] == len(rows)


def test_a_block_s_windows_by_brute_force():
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n)).encode()
    items = [(str(i % 9), text(rng.choice([1, 2, 4, 9]))) for i in range(14)]
    block = decontamination.Block(items, 4)
    for _ in range(200):
        words = decontamination.Words(text(rng.randrange(0, 30)))
        parts, covered, found = words.line.split(), set(), set()
        for item, own in items:
            own = own.split()
            n = min(4, len(own))
            for i in range(len(own) - n + 1):
                at = [j for j in range(len(parts) - n + 1) if parts[j : j + n] == own[i : i + n]]
                covered |= {j + k for j in at for k in range(n)}
                found |= {item} if at else set()
        spans, got = block.hits(words)
        assert {k for a, b in spans.tolist() for k in range(a, b)} == covered and got == sorted(found)
        assert all(b < c for (_, b), (c, _) in zip(spans.tolist(), spans.tolist()[1:], strict=False))


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontamination.Words, "hashes", lambda self, k: np.full(max(len(self) - k + 1, 0), 5 << 60, dtype=np.uint64))
    block = decontamination.Block([("1", b"a b c"), ("2", b"b c d"), ("3", b"a b c")], 3)
    assert block.hits(decontamination.Words(b"x a b c d"))[1] == ["1", "2", "3"]
    assert block.hits(decontamination.Words(b"x b c d"))[1] == ["2"] and block.hits(decontamination.Words(b"b c"))[1] == []


def test_a_block_keeps_to_its_bytes():
    rng = random.Random(12)
    items = [(str(i), " ".join(rng.choice(["a", "bc", "word", "longer"]) + str(rng.randrange(999)) for _ in range(200)).encode()) for i in range(500)]
    words = sum(len(t.split()) for _, t in items)
    assert decontamination.Block(items, 13).nbytes <= sum(len(t) + len(i) for i, t in items) + decontamination.WINDOW_BYTES * words
