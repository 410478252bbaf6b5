"""Fingerprints, HTML, tokens: exact checks on small inputs."""

import datetime
import hashlib
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stavework.llm import html_text, phrase_fingerprint, sentencepiece_bpe

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())


def test_tokens_of_whole_documents_are_the_library_s(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in sentencepiece_bpe.query(spark, SMALL).collect():
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


ODD = ["", " ", "  a  ", "▁", "a▁b", "é̂ñ", "日本語テキスト🙂", "\n\t\r\n", "aaaaaaaaa" * 99, "the " * 40, "=" * 401 + "-" * 900, "<s></s><unk>", "x\u0000y", "​　 z", "ab" * 600]


@pytest.mark.parametrize("text", ODD)
def test_tokens_of_odd_texts(library, text):
    own = sentencepiece_bpe.encoder(sentencepiece_bpe.default_model())
    ids = [int(x) for x in next(own.encode_texts([text])).split()]
    assert ids == library.encode(text)
    assert own.decode([*ids, own.voc.end]) == library.decode([*ids, own.voc.end])
    assert sentencepiece_bpe.decode_string(own, " ".join(map(str, [*ids, own.voc.end]))) == library.decode(ids)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abest hn.\n▁", max_size=200)))
def test_tokens_of_any_text(text):
    import sentencepiece

    model = sentencepiece_bpe.default_model()
    own, library = sentencepiece_bpe.encoder(model), sentencepiece.SentencePieceProcessor(model_file=model)
    assert [int(x) for x in next(own.encode_texts([text])).split()] == library.encode(text)


def test_encode_and_decode_tables(spark, library):
    rows = [(1, "plain text"), (2, None), (3, ""), (3, ""), (4, "naïve 日本 🙂"), (None, "x y " * 50_000)]
    docs = spark.createDataFrame([(*r, 1, "i") for r in rows], "doc_id long, text string, n_tokens int, ids string")
    tokens = sentencepiece_bpe.encode(docs)
    assert sorted((str(r.doc_id), r.ids) for r in tokens.collect()) == sorted((str(d), library.encode(t or "", add_eos=True)) for d, t in rows)
    back = sentencepiece_bpe.decode(tokens).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), library.decode(library.encode(t or ""))) for d, t in rows)
    assert sentencepiece_bpe.encode(docs.where("false")).count() == 0


def test_edits_and_followers_by_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    follows = dict(zip(order, order[1:] + order[:1], strict=True))
    rows = {r.doc_id: r for r in phrase_fingerprint.query(spark, SMALL).collect()}
    assert set(rows) == set(texts)
    near, far, prints = [], [], {}
    for d, r in rows.items():
        changed = phrase_fingerprint.edited(texts[d], texts[follows[d]])
        assert r.n_chars == len(texts[d]) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(texts[d], r.fingerprint) == r.fingerprint
        alone = phrase_fingerprint.sketches([texts[d], changed, texts[follows[d]]])
        assert phrase_fingerprint.as_text(alone)[:2] == [r.fingerprint, r.edited_fingerprint]
        assert r.near_next == pytest.approx(float(phrase_fingerprint.likeness(alone[:1], alone[2:])[0]))
        assert 0 <= r.near_edited <= 1
        if texts[d] != texts[follows[d]]:
            near.append(r.near_edited)
            far.append(r.near_next)
    assert np.mean(near) > 0.35 and np.mean(far) < 0.2


def test_equal_substrings_share_phrases_at_any_offset():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    body = " ".join(word() for _ in range(400))
    for lead in ("", "x", "some words before ", "aaaa aaaa "):
        a, b = phrase_fingerprint.sketches([body, lead + body])
        assert phrase_fingerprint.likeness(a[None], b[None])[0] > 0.85


def test_fingerprints_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "aaaaaaaaaaaaaaaaaaaaaaaa"), (5, "é🙂" * 20_000), (5, "é🙂" * 20_000), (None, "b")]
    docs = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, bucket int, key string")
    got = phrase_fingerprint.fingerprints(docs).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r.fingerprint for r in got}
    assert found[1] == found[2] != found[3]
    assert len(phrase_fingerprint.edit_resistance(docs).collect()) == len(rows)
    assert phrase_fingerprint.edit_resistance(docs.where("doc_id = 3")).first().near_next == 1.0
    assert phrase_fingerprint.edit_resistance(docs.where("false")).count() == 0


def plain_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def plain_sketch(text):
    """One text, symbol by symbol: (name, span) pairs on each level, then minima by bin."""
    power = [0x9E3779B97F4A7C15]
    for _ in range(63):
        power.append(power[-1] * power[0] % 2**64)
    symbols = [((ord(c) + 1) * power[0] % 2**64, 1) for c in text]
    phrases = []
    while symbols:
        runs = [list(g) for _, g in itertools.groupby(symbols, key=lambda s: s[0])]
        symbols = [(plain_mix((g[0][0] + len(g) * power[1]) % 2**64) if len(g) > 1 else g[0][0], sum(n for _, n in g)) for g in runs]
        if len(symbols) == 1:
            phrases += [s for s in symbols if s[1] >= phrase_fingerprint.SPAN or not phrases]
            break
        labels, bits = [name for name, _ in symbols], 64
        for _ in range(phrase_fingerprint.TOSSES):
            left = [labels[0] ^ (2**bits - 1), *labels[:-1]]
            place = [((a ^ b) & -(a ^ b)).bit_length() - 1 for a, b in zip(labels, left, strict=True)]
            labels, bits = [2 * k + (a >> k & 1) for k, a in zip(place, labels, strict=True)], 8
        top = [k for k in range(2, len(labels) - 1) if labels[k - 1] < labels[k] > labels[k + 1]]
        cuts = [0, *top, len(symbols)]
        cut = [symbols[a:b] for a, b in itertools.pairwise(cuts)]
        symbols = [(plain_mix(sum(name * power[min(k, 63)] for k, (name, _) in enumerate(g)) % 2**64), sum(n for _, n in g)) for g in cut]
        phrases += [s for s in symbols if s[1] >= phrase_fingerprint.SPAN]
    bins = [0xFFFF] * phrase_fingerprint.BINS
    for name, _ in phrases:
        name = plain_mix(name ^ 0x5851F42D4C957F2D)
        bins[name >> 58] = min(bins[name >> 58], (name & 0xFFFF) % 0xFFFF)
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_sketches_are_those_of_a_plain_parse(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("aab c\né🙂", k=rng.choice([0, 1, 2, 3, 9, 60, 700]))) for _ in range(8)] + ["a" * 50, "ab" * 40]
    found = phrase_fingerprint.sketches(texts)
    assert found.tolist() == [plain_sketch(t) for t in texts]
    a, b = found[:-1], found[1:]
    for x, y, share in zip(a.tolist(), b.tolist(), phrase_fingerprint.likeness(a, b).tolist(), strict=True):
        used = [(p, q) for p, q in zip(x, y, strict=True) if min(p, q) < 0xFFFF]
        assert share == pytest.approx(sum(p == q for p, q in used) / len(used) if used else 1.0)


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_followers_by_ids_of_any_type(spark, kind):
    rng = random.Random(1)
    numbers = [rng.randrange(40) for _ in range(150)]
    ids = [None if n == 7 else n if kind == "long" else f"é{n}" if kind == "string" else datetime.date(2000, 1, 1 + n % 28) for n in numbers]
    rows = [(i, f"text {k} " + "x" * k) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(4)
    found = phrase_fingerprint.edit_resistance(docs)
    assert dict(found.dtypes)["doc_id"] == dict(docs.dtypes)["doc_id"]
    order = docs.orderBy(F.desc("doc_id"), F.desc(F.xxhash64("text"))).collect()
    assert [r.doc_id is None for r in order] == sorted(r.doc_id is None for r in order)
    want = [(a.doc_id, hashlib.sha256(phrase_fingerprint.edited(a.text, b.text).encode()).hexdigest()) for a, b in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(map(str, ((r.doc_id, r.edited_sha256) for r in found.collect()))) == sorted(map(str, want))


PAGES = [
    ("", ""),
    ("just text &amp; more", "just text & more"),
    ("<p>one<p>two <b>bold</b>word", "one\n\ntwo boldword"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
    ("<ol start=3><li>x</li><li>y</li></ol>", "3. x\n4. y"),
    ("<table><tr><th>k<th>value<tr><td>long one<td>1</table>", "k         value\nlong one  1"),
    ("<div>a</div><div style='display:none'>b</div><div hidden>c</div><span style=\"visibility: hidden\">d</span>e", "a\ne"),
    ("<head><title>t</title><style>p{}</style></head><body>x<script>if (a<b) {}</script>y<!-- c --></body>", "xy"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("a<br>b<hr>c", "a\nb\n\nc"),
    ("<p>unclosed <a href='x>y", "unclosed <a href='x>y"),
    ("a < b and c > d", "a < b and c > d"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_pages(html, text):
    assert html_text.visible_text(html) == text


SHOWN = [
    'title="a hidden gem in town"',
    'class="hidden lg:block"',
    'style="overflow: hidden !important"',
    """onclick="x.style='display:none'" """,
    'style="--display:none; content: \'; display:none\'"',
    'style="display:none; display:block"',
    'data-hidden=1 alt=hidden',
]
NOT_SHOWN = ["hidden", "HIDDEN=''", "class=x hidden", "class='x'hidden", "style=display:none", 'style="color:red; Display : NONE !important; display:block"', "style='visibility:collapse'", "style='display:&#110;one'"]


@pytest.mark.parametrize("attributes", SHOWN + NOT_SHOWN)
def test_only_hidden_and_style_hide(attributes):
    shown = html_text.visible_text(f"<div>a</div><div {attributes}>b<p>c</p></div>")
    assert shown == ("a\nb\n\nc" if attributes in SHOWN else "a")
    if attributes == "style='visibility:collapse'":  # but what is visible again inside
        assert html_text.visible_text(f"<div {attributes}>b<p style='visibility:visible'>c</p></div>") == "c"


@pytest.mark.parametrize("depth", [10, 199, 200, 300, 20_000])
@pytest.mark.parametrize("lead", ["<div>", "<font>"])
def test_depth_changes_nothing(depth, lead):
    inner = "<p hidden>no <b>no</b></p>yes<ul><li>a<li>b</ul><table><tr><td>long<td>1<tr><td>k<td>2</table>"
    page = lead * depth + inner + "<div>in</div>" + lead.replace("<", "</") * (depth - 1) + "<p>out"
    assert html_text.visible_text(page) == "yes\n\n- a\n- b\n\nlong  1\nk     2\n\nin\n\nout"


def test_deep_tables_and_lists():
    assert html_text.visible_text("<table><tr><td>x" * 1_000) == "\n\n".join("x" * 1_000)
    assert html_text.visible_text("<ul><li>x" * 300) == "\n".join("  " * k + "- x" for k in range(300))
    assert html_text.visible_text("<b><i>" * 50_000 + "x" + "</b>" * 50_000 + "<p>y") == "x\n\ny"


TABLES = [
    ("<tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e", "a  b\n   c\nd  e"),
    ("<tbody><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>c<tbody><tr><td>d<td>e", "a  b\n   c\n   c\nd  e"),
    ("<thead><tr><td rowspan=9>a<td>b<tbody><tr><td>d<td>e", "a  b\nd  e"),
    ("<tr><td>q<td rowspan=2 colspan=2>a<td>b<tr><td>c<td>d<tr><td>e<td>f<td>g<td>h", "q  a     b\nc        d\ne  f  g  h"),
    ("<tr><td rowspan=2>a<td>b<td rowspan=2>c<tr><td>d<td>e", "a  b  c\n   d     e"),
    ("<tr><td colspan=200>a<td>z<tr>" + "<td>b" * 200 + "<td>y", "a" + " " * 599 + "z\n" + "b  " * 200 + "y"),
    ("<tr><td colspan=99999999>a<td>b", "a  b"),
]


@pytest.mark.parametrize(("table", "text"), TABLES)
def test_spanning_cells_keep_their_columns(table, text):
    assert html_text.visible_text(f"<table>{table}</table>") == text


def test_pages_of_any_shape_end(spark):
    rows = [(1, None), (2, "<div>" * 5_000 + "deep"), (3, "<" * 20_000), (4, "<table>" * 300 + "x"), (4, "<td>" * 50), (None, "<p>n")]
    got = html_text.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, html string, text string")).collect()
    assert len(got) == len(rows)
    assert next(r.text for r in got if r.page_id == 2) == "deep" and next(r.text for r in got if r.page_id is None) == "n"
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_every_visible_word_of_the_pages_is_there(spark):
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").limit(100).collect():
        assert "<script" not in html_text.visible_text(r.html) and html_text.visible_text(r.html).strip()
