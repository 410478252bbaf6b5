"""Quality and language models: held-out figures, odd rows; and the whole pipeline."""

import re
import unicodedata
import zlib
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_llm_dedup import plain_fingerprint, plain_lines, roots

import corpus_pipeline
from stavework.llm import language_id, quality, sentencepiece_bpe

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}


def test_quality_on_the_held_out_fold(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = quality.query(spark, LARGER).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    fold = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = ([s for s, y in fold if y == v] for v in (1, 0))
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.85, area


def test_compiled_rules_are_the_fitted_ones(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.NAMES)))
    y = ((x[:, 2] > 0.5) & (x[:, 4] <= 0.6)).astype(float)
    model = quality.fit(x, y)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in quality.NAMES))
    got = np.array([r[0] for r in rows.select(model.score()).collect()])
    total = model.bias + sum(w * quality.holds(r, x) for r, w in zip(model.rules, model.weights, strict=True))
    assert np.allclose(np.sort(got), np.sort(1 / (1 + np.exp(-total))))
    assert ((got >= 0.5) == (y > 0)).mean() > 0.95 and len(model.rules) < 80


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1, "s"), (2, "", 2, "s"), (2, "", 2, "s"), (None, "some words here", 3, "s"), (4, "x" * 300_000, 4, "s")], "doc_id long, text string, words int, _text string")
    labels = spark.createDataFrame([(4, 1), (2, 0), (None, 1), (1, None)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality.score(docs, quality.train(docs, labels.where("false"))).count() == 5
    assert quality.score(docs.where("false"), quality.train(docs.where("false"), labels)).count() == 0


def test_language_on_the_held_out_fold(spark, documents):
    rows = language_id.query(spark, LARGER).collect()
    assert len(rows) == len(documents)
    has_letter = {d: any(unicodedata.category(c).startswith("L") for c in r.text or "") for d, r in documents.items()}
    fold = [r for r in rows if r.held_out and documents[r.doc_id].lang and has_letter[r.doc_id]]
    assert np.mean([r.lang_pred == documents[r.doc_id].lang for r in fold]) > 0.9
    assert all((r.lang_pred == "und") == (not has_letter[r.doc_id]) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    learn = spark.createDataFrame([(i, t, la, 1) for i, (t, la) in enumerate([("the cat and the dog", "a"), ("der hund und die katze", "b")] * 20)], "doc_id long, text string, lang string, key int")
    model = language_id.train(learn)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the dog"), (4, "the dog"), (6, "² ½ ① Ⅷ ٣"), (7, None), (None, "und der hund"), (5, "die katze " * 40_000)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "a", 6: "und", 7: "und", None: "b", 5: "b"}
    assert language_id.train(learn.where("false")) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(docs.where("false"), model).count() == 0


def plain_ngrams(text):
    """Buckets and counts of one to three characters, one after another."""
    points = [ord(c) if ord(c) >= 128 or chr(ord(c)).isalpha() else 0x20 for c in f" {text.lower()} "]
    found = {}
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            key = 0
            for k in range(n):
                key = ((key ^ (points[i + k] * int(language_id._MIX[k]) & 0xFFFFFFFF)) * 0x27D4EB2F) & 0xFFFFFFFF
            bucket = (key ^ (key >> 15)) & (language_id.BUCKETS - 1)
            found[bucket] = found.get(bucket, 0) + 1
    return found


@pytest.mark.parametrize("text", ["", "a", "Übung macht den Meister 12", "日本語 text, and more", "ab" * 40_000])
def test_ngrams_by_brute_force(text):
    at, counts = language_id.ngram_counts(text)
    assert dict(zip(at.tolist(), counts.tolist(), strict=True)) == plain_ngrams(text)


def test_tf_idf_and_training_by_plain_python(spark):
    texts = [("the cat sat on the mat", "a"), ("der hund und die katze", "b"), ("the dog and the cat", "a"), ("die maus im haus", "b")] * 3
    learn = spark.createDataFrame([(i, t, la) for i, (t, la) in enumerate(texts)], "doc_id long, text string, lang string")
    frequency, n = language_id.document_frequencies(learn)
    assert n == len(texts)
    plain = [plain_ngrams(t) for t, _ in texts]
    for bucket in set().union(*plain):
        assert frequency[bucket] == sum(bucket in p for p in plain)
    assert frequency.sum() == sum(map(len, plain))
    # one step of the leader by its formulas, entry by entry
    at, x = np.array([3, 7], dtype=np.int32), np.array([0.6, 0.8], dtype=np.float32)
    epochs, language_id.EPOCHS = language_id.EPOCHS, 1
    try:
        weights, bias = language_id.follow_the_leader([(0, at, x)], 2)
    finally:
        language_id.EPOCHS = epochs
    for k, value in ((3, 0.6), (7, 0.8)):
        for c in range(2):
            g = value * (0.5 - (c == 0))  # from equal probabilities
            z, squares = g, g * g
            expected = 0.0 if abs(z) <= language_id.L1 else (np.sign(z) * language_id.L1 - z) / ((language_id.BETA + squares**0.5) / language_id.ALPHA + language_id.L2)
            assert abs(weights[k, c] - expected) < 1e-6
    assert bias[0] > 0 > bias[1] and not weights[[0, 1, 2, 4]].any()


def test_all_ngrams_of_a_sampled_text_are_learnt(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(map(chr, rng.integers(0x100, 0x2000, 6_000))) for _ in range(3)]
    learn = spark.createDataFrame([(i, t, f"l{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    keys = learn.select("lang", language_id.key_of_row())
    found = {lang: dict(zip(at.tolist(), n.tolist(), strict=True)) for lang, at, n in language_id.sample(learn, keys, 5)}
    assert found == {f"l{i}": plain_ngrams(t) for i, t in enumerate(texts)} and min(map(len, found.values())) > 2_048
    with pytest.raises(ValueError, match="more than 2"):
        language_id.train(learn, most_languages=2)
    assert language_id.train(learn, most_languages=3).languages == ["l0", "l1", "l2"]


def test_a_rare_language_is_learnt(spark):
    rows = [(i, f"the cat and the dog number {i}", "a") for i in range(3_000)] + [(i, f"der hund und die katze {i}", "b") for i in range(3_000, 3_006)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100)
    assert model.languages == ["a", "b"]
    docs = spark.createDataFrame([(1, "die katze und der hund"), (2, "a dog and a cat")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()} == {1: "b", 2: "a"}


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars, n = len(text), len(words)
    share = lambda a, b: a / b if b else 0.0
    category = [unicodedata.category(c) for c in text]
    of = lambda test: share(sum(map(test, text, category)), chars)
    space = " \t\n\x0b\f\r"
    return (
        float(chars), float(n), share(chars, n), of(lambda c, k: k == "Lu"),
        of(lambda c, k: k[0] not in "LN" and c not in space and c not in ".,"), of(lambda c, k: c in "0123456789"), of(lambda c, k: c in ".,"),
        share(len(set(words)), n), share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n), n / (text.count("\n") + 1),
    )


def test_statistics_by_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "A a a\t\n b.\u00a0,"), (-4, "1 2 2 2"), (-5, "Ⅷ Éa")], "doc_id long, text string")
    every = docs.unionByName(odd)
    found = {r.doc_id: tuple(r)[1:] for r in quality.statistics(every, "doc_id").collect()}
    for r in every.collect():
        assert np.allclose(found[r.doc_id], plain_statistics(r.text)), (r.doc_id, found[r.doc_id], plain_statistics(r.text))


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "tokens"]
    at, states = docs, []
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SMALL)
        states.append({r.doc_id: r for r in at.collect()})
        at = spark.createDataFrame(list(states[-1].values()), at.schema)
    for state in states[:-1]:
        assert set(next(iter(state.values())).asDict()) == set(docs.columns)
    good = {r.doc_id for r in quality.query(spark, SMALL).collect() if r.predicted}
    assert set(states[0]) == good
    lines = plain_lines([(d, r.text) for d, r in states[0].items() if r.text is not None])
    assert {d: r.text for d, r in states[1].items() if r.text is not None} == lines
    assert all(r.n_chars == len(r.text or "") for r in states[1].values())
    ids = sorted(states[1])
    prints = [plain_fingerprint(states[1][d].text) for d in ids]
    near = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert set(states[2]) == {ids[r] for r in roots(len(ids), near)}
    assert set(states[3]) <= set(states[2])
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    assert {d: r.ids for d, r in states[4].items()} == {d: library.encode(r.text or "", add_eos=True) for d, r in states[3].items()}
    whole = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id: r.ids for r in whole.collect()} == {d: r.ids for d, r in states[4].items()}
    assert whole.agg(F.min("n_tokens")).first()[0] >= 1


def test_stages_of_odd_rows(spark):
    lines = "one line of words\nanother line here\nand a third line"
    rows = [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, lines, "en", "s", 55), (4, lines, "en", "s", 55), (4, lines, "en", "s", 55), (4, "only here, of an id that is there twice", None, None, 0),
        (None, lines, "en", "s", 55), (None, None, None, None, None), (5, "long words " * 40_000, "en", "s", 440_000), (6, "\n" * 3_000, "en", "s", 3_000),
    ]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row_key string, lines string")
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.where("false")):
            found = stage(spark, some, SMALL)
            kept = found.collect()
            if name != "tokens":
                assert found.columns == docs.columns, name
            assert len(kept) <= some.count()
        if name == "lines":
            assert sorted((str(r.doc_id), r.text or "") for r in stage(spark, docs, SMALL).collect() if r.doc_id in (3, 4, None)) == sorted(
                [("3", lines), ("4", ""), ("4", ""), ("4", rows[5][1]), ("None", lines), ("None", "")]
            )
        if name == "near_duplicates":  # equal texts of 3, 4 and null; 1, 2 and 6 have no words
            assert sorted(str(r.doc_id) for r in stage(spark, docs, SMALL).collect()) == ["1", "3", "4", "5", "None", "None"]


def test_a_run_leaves_only_its_last_stage(spark):
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.iterdir())
    found = corpus_pipeline.run(spark, SMALL)
    assert len(set(folder.iterdir()) - before) == 1 and found.count() > 0
