"""Substring de-duplication with an FM-index for each shard.

A word goes if a window of 20 words over it also starts earlier: in a document with a
smaller id, or earlier in the same one.

Searching every document in an index of every other shard would be quadratic, so the
shards are made by content. Each window has an anchor: the least hash among the six-word
sequences in it. Equal windows have equal anchors, and neighbouring windows mostly share
theirs, so a document is cut into runs of windows with one anchor, about one run for
eight words.

1. Count anchors (a hash and a count, with map-side partials). Windows of an anchor that
   occurs once are unique.
2. Runs of repeated anchors are cut out of their documents as segments of words.
3. Segments go to shards by anchor. A shard builds compressed FM-indexes of its distinct
   segments in order of their first places and streams them through backward search over
   the wavelet matrix: the matching statistics, the length of the longest sequence ending
   at each word that occurs twice, up to the window's. Where they reach the window's
   length, the ranges of the search tell equal windows, and their first places are kept.
4. In each document, repeated runs' windows that are no first ones are intervals to
   remove; they are merged.

An anchor with very many occurrences is reduced to distinct segments before (a ``min``
of places by content), and if these are still many, its windows are dealt to several
shards by the windows' own hashes. Equal windows still meet. A shard gets only the words
of its own windows, reduced to distinct ones once more, so a window that all segments
share comes to its shard about once and not with every segment.

An index of ``INDEX_WORDS`` words takes about 1 MB, building it and searching it about
50 MB at most in a worker; the order of suffixes is dropped once the transform is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.llm.common import cut_table, table, text_chunks, texts_of
from stavework.llm.fm_index import SEPARATOR, FMIndex
from stavework.llm.words import HASH_WORDS, Words

WINDOW = 20
GRAM = 6
#: Words of one FM-index; only one anchor's segments can make it larger.
INDEX_WORDS = 200_000
#: Occurrences of an anchor that one shard takes as they are.
SHARD_RUNS = 2_000


def anchor_runs(words: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor) of the runs of windows that share an anchor."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = min(GRAM, window)
    h = words.hashes(gram)
    span = window - gram + 1
    at = np.concatenate([
        np.lib.stride_tricks.sliding_window_view(h[lo : lo + HASH_WORDS + span - 1], span).argmin(axis=1) + np.arange(lo, min(lo + HASH_WORDS, len(h) - span + 1))
        for lo in range(0, len(h) - span + 1, HASH_WORDS)
    ])
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return starts, np.diff(np.r_[starts, len(at)]), h[at[starts]].view(np.int64)


def runs(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id``, ``place`` (first window * 64 + windows), ``anchor`` of all runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            found = [anchor_runs(Words(t), window) for t in texts_of(batch)]
            rows = np.repeat(np.arange(batch.num_rows), [len(f[0]) for f in found])
            place = np.concatenate([f[0] * 64 + f[1] for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(place), pa.array(np.concatenate([f[2] for f in found]))], names=["doc_id", "place", "anchor"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, place long, anchor long")


def marked(docs: DataFrame, window: int) -> DataFrame:
    """Documents with their runs of repeated anchors.

    ``doc_id``, ``n_words``, ``whole_sha256``, and for documents with such runs also
    ``line`` (the words) and ``runs`` (array of struct<place, anchor, n>).
    """
    every = cut_table(runs(docs, window))
    # a table of its own: a join of two plain scans is one that can be split where it is skewed
    counts = cut_table(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    own = every.join(counts, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("place", "anchor", "n")).alias("runs"))
    joined = docs.join(own, "doc_id", "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            words = [b" ".join(t.split()) for t in texts_of(batch)]
            has = batch.column(2).is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([w.count(b" ") + 1 if w else 0 for w in words], pa.int64()),
                    pa.array([hashlib.sha256(w).hexdigest() for w in words]),
                    pa.array([w if h else None for w, h in zip(words, has, strict=True)], pa.binary()),
                    batch.column(2),
                ],
                names=["doc_id", "n_words", "whole_sha256", "line", "runs"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return cut_table(
        joined.mapInArrow(run, f"doc_id {kind}, n_words long, whole_sha256 string, line binary, runs array<struct<place: long, anchor: long, n: long>>")
    )


def segments(documents: DataFrame, window: int) -> DataFrame:
    """``anchor``, ``n``, ``content``, ``doc_id``, ``start``: repeated runs' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "line"):
            lists = batch.column(2)
            flat, bounds = lists.flatten(), np.cumsum(np.r_[0, lists.value_lengths().to_numpy(zero_copy_only=False)])
            place, anchor, n = (flat.field(k) for k in range(3))
            at = place.to_numpy(zero_copy_only=False)
            contents: list[bytes] = []
            for k, line in enumerate(batch.column(1).to_pylist()):
                words = Words(line, clean=True)
                own = at[bounds[k] : bounds[k + 1]]
                first = words.starts[own >> 6].tolist()
                last = words.ends[(own >> 6) + (own & 63) + window - 2].tolist()
                contents.extend(line[s:e] for s, e in zip(first, last, strict=True))
            rows = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            yield pa.RecordBatch.from_arrays([anchor, n, pa.array(contents, pa.binary()), batch.column(0).take(pa.array(rows)), pa.array(at >> 6)], names=["anchor", "n", "content", "doc_id", "start"])

    return documents.select("doc_id", "line", "runs").mapInArrow(run, f"anchor long, n long, content binary, doc_id {dict(documents.dtypes)['doc_id']}, start long")


def shard_firsts(rows: list[tuple[bytes, object, int]], window: int) -> list[tuple[object, int, int]]:
    """First windows among segments.

    rows: (content, doc_id, start). Returns (doc_id, start, first windows as bits) of each
    distinct content's first place.
    """
    places: dict[bytes, tuple[object, int]] = {}
    for content, doc_id, start in rows:
        now = (doc_id, start)
        if (old := places.get(content)) is None or now < old:
            places[content] = now
    order = sorted(places.items(), key=lambda x: x[1])
    symbols, starts = numbered([content for content, _ in order])
    windows = np.diff(starts) - window  # separators follow the contents
    offset = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    asked = np.repeat(starts[:-1], windows) + offset
    length, name = FMIndex(symbols, window).matches(symbols, asked + window - 1, window)
    is_first = np.ones(len(asked), dtype=bool)
    again = np.flatnonzero(length == window)
    again = again[np.argsort(name[again], kind="stable")]  # equal windows together, by place
    is_first[again[1:]] = name[again[1:]] != name[again[:-1]]
    bits = np.where(is_first, np.int64(1) << offset, 0)
    masks = np.bitwise_or.reduceat(bits, np.cumsum(windows) - windows)
    return [(*where, mask) for (_, where), mask in zip(order, masks.tolist(), strict=True) if mask]


def numbered(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all contents as numbers from 1, SEPARATOR behind each content; and where each begins (and the end)."""
    parts = b" \n ".join([*contents, b""]).split(b" ")[:-1]
    number: dict[bytes, int] = {b"\n": SEPARATOR}  # no word has a newline
    symbols = np.fromiter((number.setdefault(w, len(number)) for w in parts), dtype=np.int64, count=len(parts))
    return symbols, np.r_[0, np.flatnonzero(symbols == SEPARATOR) + 1]


def firsts(dealt: DataFrame, window: int) -> DataFrame:
    """``doc_id``, ``start``, ``bits`` of first windows.

    dealt: ``shard``, ``content``, ``doc_id``, ``start``; rows of one shard are judged
    together.
    """
    kind = dict(dealt.dtypes)["doc_id"]
    is_struct = kind.startswith("struct")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(rows: list) -> pa.RecordBatch:
            found = shard_firsts(rows, window)
            ids, starts, bits = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(starts, pa.int64()), pa.array(bits, pa.int64())], names=["doc_id", "start", "bits"])

        held: list[tuple[bytes, object, int]] = []
        size, shard = 0, None
        for batch in text_chunks(batches, "content"):
            id_type = batch.schema.field(2).type
            docs = batch.column(2).to_pylist()
            if is_struct:
                docs = [tuple(d.values()) for d in docs]
            for own, content, doc, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), docs, batch.column(3).to_pylist(), strict=True):
                if own != shard and size >= INDEX_WORDS:
                    yield judged(held)
                    held, size = [], 0
                shard = own
                held.append((content, doc, start))
                size += content.count(b" ") + 1
        if held:
            yield judged(held)

    return (
        dealt.select("shard", "content", "doc_id", "start")
        .repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(run, f"doc_id {kind}, start long, bits long")
    )


def split_hot(hot: DataFrame, window: int, shard_runs: int) -> DataFrame:
    """Segments of frequent anchors for ``firsts``: distinct ones, in bounded shards.

    ``shard``, ``content``, ``doc_id``, ``start``. The start is a place: the first word * 64
    + the windows of the segment before it; ``hot_firsts`` goes back to segments.
    """
    distinct = cut_table(hot.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "start")).alias("at")))
    # a table of its own, as in ``marked``
    parts = cut_table(distinct.groupBy("anchor").agg(F.ceil(F.count("*") / shard_runs).cast("long").alias("parts")))
    rows = distinct.join(parts, "anchor").select("anchor", "content", "parts", F.col("at.doc_id").alias("doc_id"), F.col("at.start").alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "content"):
            at, shards, contents, places = [], [], [], []
            for k, (anchor, content, parts, start) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True)):
                words = Words(content, clean=True)
                part = words.hashes(window) % np.uint64(parts)
                # neighbours of one part stay together
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                last = np.r_[first[1:], len(part)] + window - 2
                at.extend([k] * len(first))
                shards.extend(f"{anchor}/{p}" for p in part[first].tolist())
                contents.extend(content[s:e] for s, e in zip(words.starts[first].tolist(), words.ends[last].tolist(), strict=True))
                places.extend(((start + first) * 64 + first).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.string()), pa.array(contents, pa.binary()), batch.column(3).take(pa.array(at, pa.int64())), pa.array(places, pa.int64())],
                names=["shard", "content", "doc_id", "start"],
            )

    pieces = rows.where("parts > 1").mapInArrow(run, f"shard string, content binary, doc_id {dict(hot.dtypes)['doc_id']}, start long")
    reduced = pieces.groupBy("shard", "content").agg(F.min(F.struct("doc_id", "start")).alias("at")).select("shard", "content", "at.doc_id", "at.start")
    whole = rows.where("parts = 1").select(F.concat(F.col("anchor").cast("string"), F.lit("/0")).alias("shard"), "content", "doc_id", (F.col("start") * 64).alias("start"))
    return whole.unionByName(reduced)


def hot_firsts(found: DataFrame) -> DataFrame:
    """``firsts`` of ``split_hot``'s pieces, by the segments that they were cut from."""
    before = F.col("start").bitwiseAND(63).cast("int")
    return found.select("doc_id", (F.shiftright("start", 6) - before).alias("start"), F.call_function("shiftleft", "bits", before).alias("bits"))


def covered(n_words: np.ndarray, runs: tuple[np.ndarray, np.ndarray], first: tuple[np.ndarray, np.ndarray, np.ndarray], window: int) -> np.ndarray:
    """Which words of some documents a repeated window covers, all documents in a row.

    runs: (document, place); first: (document, start, first windows as bits). A document
    has one more flag than words, which is never set.
    """
    doc, place = runs
    base = np.r_[0, np.cumsum(n_words + 1)]
    start, n = place >> 6, place & 63
    key = base[first[0]] + first[1]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    bits = np.r_[np.bitwise_or.reduceat(first[2][order], new) if len(key) else np.zeros(0, dtype=np.int64), 0]
    key = np.r_[key[new], -1]
    at = np.searchsorted(key[:-1], base[doc] + start)
    own = np.where(key[at] == base[doc] + start, bits[at], 0)
    run = np.repeat(np.arange(len(doc)), n)
    i = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    at = (base[doc] + start)[run] + i
    at = at[(own[run] >> i & 1 == 0) & (start[run] + i + window <= n_words[doc[run]])]
    edges = np.bincount(at, minlength=base[-1] + 1) - np.bincount(at + window, minlength=base[-1] + 1)
    return np.cumsum(edges[:-1]) > 0


def deduplicate(docs: DataFrame, window: int = WINDOW, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """Remove every word that a window which starts earlier covers.

    docs: ``doc_id``, ``text``; other columns are not read. Returns one row for each row
    of docs: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept`` (the
    words that stay, joined by one space, of documents that lost words; null if none
    did).

    window: 6 to 62 words. Null and empty texts have no words; texts shorter than the
    window lose none. Rows with a null id have no place in the order: they lose nothing
    and no one loses for them. Different texts that share an id are documents of their
    own, in the order of a hash of the text. Equal rows are one document: they lose the
    same words, and none for each other.
    """
    if not GRAM <= window <= 62:
        raise ValueError(f"window: {GRAM} to 62 words")
    texts = docs.select("doc_id", "text")
    placed, others = texts.where("doc_id is not null"), _without_place(texts.where("doc_id is null"))
    if not placed.groupBy("doc_id").count().where("count > 1").take(1):
        return _deduplicated(placed, window, shard_runs).unionByName(others)
    row = F.xxhash64(F.coalesce("text", F.lit("")))
    distinct = cut_table(placed.groupBy("doc_id", row.alias("row")).agg(F.first("text").alias("text")))
    done = cut_table(_deduplicated(distinct.select(F.struct("doc_id", "row").alias("doc_id"), "text"), window, shard_runs))
    of = done.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.row").alias("row"), "n_words", "n_removed", "kept_sha256", "kept")
    return placed.select("doc_id", row.alias("row")).join(of, ["doc_id", "row"]).drop("row").unionByName(others)


def _deduplicated(texts: DataFrame, window: int, shard_runs: int) -> DataFrame:
    """``deduplicate`` for rows with an id of their own."""
    documents = marked(texts, window)
    repeated = documents.where("runs is not null")
    cut_out = segments(repeated, window)
    plain = cut_out.where(F.col("n") <= shard_runs)
    dealt = plain.select(F.col("anchor").cast("string").alias("shard"), "content", "doc_id", "start")
    hot = split_hot(cut_out.where(F.col("n") > shard_runs), window, shard_runs)
    found = firsts(dealt, window).unionByName(hot_firsts(firsts(hot, window)))
    by_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "bits")).alias("firsts"))
    places = repeated.select("doc_id", "n_words", "line", F.col("runs.place").alias("places"))
    judged = places.join(by_doc, "doc_id", "left").select("doc_id", "n_words", "line", "places", "firsts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "line"):
            n_words = batch.column(1).to_numpy(zero_copy_only=False)
            each = np.arange(batch.num_rows)
            lists = [batch.column(c) for c in (3, 4)]
            of = [np.repeat(each, x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) for x in lists]
            place, first = lists[0].flatten().to_numpy(zero_copy_only=False), lists[1].flatten()
            gone = covered(n_words, (of[0], place), (of[1], *(first.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))), window)
            ends = np.cumsum(n_words + 1)
            counts, digests, texts = np.zeros(batch.num_rows, dtype=np.int64), [], []
            for k, line in enumerate(batch.column(2).to_pylist()):
                own = gone[ends[k] - n_words[k] - 1 : ends[k] - 1]
                counts[k] = own.sum()
                kept = line
                if counts[k]:
                    words = Words(line, clean=True)
                    kept = np.frombuffer(line + b" ", dtype=np.uint8)[np.repeat(~own, words.ends - words.starts + 1)].tobytes()[:-1]
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if counts[k] else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    kind = dict(texts.dtypes)["doc_id"]
    done = judged.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    return done.unionByName(_whole(documents.where("runs is null")))


def _whole(documents: DataFrame) -> DataFrame:
    """Documents that lose nothing."""
    return documents.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole_sha256").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))


def _without_place(docs: DataFrame) -> DataFrame:
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return _whole(docs.select("doc_id", F.size(words).cast("long").alias("n_words"), F.sha2(F.array_join(words, " ").cast("binary"), 256).alias("whole_sha256")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("kept")


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20)
), ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS rn FROM windows
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps
  FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM ranked WHERE rn > 1) GROUP BY doc_id
), placed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words
), gone_words AS (
  SELECT doc_id, unnest(ps) AS p FROM gone
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM placed ANTI JOIN gone_words USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(g.ps), 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN gone g USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
