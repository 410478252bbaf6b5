"""Benchmark decontamination: n-gram windows of a test set looked up in training texts.

A benchmark's normalised windows become a broadcast set of hashes: sorted 64-bit numbers,
with the windows' places in the benchmark's own text and the items that have them. Each
task streams its documents, hashes their windows, and compares the words of every window
whose hash is in the set, so a hit is verified when found.

The broadcast is bounded: a benchmark whose set needs more than ``block_bytes`` of memory
is handled in blocks, one pass over the documents for each, and the hits of the passes are
merged by row: the documents are written once with a key for each row. Items are first cut
into pieces, each an eighth of a block at most, that share n - 1 words with the next and so
have all windows between them: a block holds pieces, and a long item may lie in several.
Only a window larger than that is in a piece of its own size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.llm.common import cut_table, table, text_chunks, texts_of
from stavework.llm.words import Words

WINDOW = 13
#: Memory of one broadcast block, about: WINDOW_BYTES for each window, and the text.
BLOCK_BYTES = 64 << 20
WINDOW_BYTES = 32
#: A block has the room of so many pieces of items.
PIECES = 8
#: Contaminated: hit, and at least one word in this many is hit.
SHARE = 20

#: Bytes of words: digits, letters (capitals lower-cased), everything outside ASCII.
_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """The text's words; both tables are cut by this one rule."""
    return text.translate(_WORD_BYTES).split()


class Windows:
    """The windows of one length of a block of benchmark items, by hash.

    Distinct windows with one hash stand next to each other. The sieve has a bit for each
    value of a hash's upper bits and turns most other windows away.
    """

    def __init__(self, line: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: np.ndarray):
        """A row for each place of a window: hash, its place in ``line``, number of its item."""
        order = np.lexsort((items, hashes))
        hashes, starts, ends, items = hashes[order], starts[order], ends[order], items[order]
        number = np.cumsum(np.r_[0, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, dtype=np.int64)
        number = self._apart(line, number, starts, ends)
        order = np.lexsort((items, number))  # in the order of hashes too
        number, hashes, starts, ends, items = number[order], hashes[order], starts[order], ends[order], items[order]
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, dtype=np.int64)
        self.hashes, self.starts, self.ends = hashes[first], starts[first].astype(np.uint32), ends[first].astype(np.uint32)
        new = np.r_[True, (number[1:] != number[:-1]) | (items[1:] != items[:-1])] if len(number) else np.zeros(0, dtype=bool)
        self.items = items[new].astype(np.int32)
        self.bounds = np.searchsorted(number[new], np.arange(len(first) + 1)).astype(np.int32)
        self.shift = 64 - max(8, (8 * len(first)).bit_length())
        bits = np.zeros(1 << (64 - self.shift), dtype=bool)
        bits[self.hashes >> np.uint64(self.shift)] = True
        self.sieve = np.packbits(bits, bitorder="little")

    @staticmethod
    def _apart(line: bytes, number: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of hashes made into numbers of windows, should windows share a hash."""
        again = np.flatnonzero(np.diff(number) == 0) + 1
        texts = lambda at: [line[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        if texts(again) == texts(again - 1):
            return number
        every = texts(np.arange(len(number)))
        found: dict[tuple[int, bytes], int] = {}
        return np.array([found.setdefault(key, len(found)) for key in zip(number.tolist(), every, strict=True)])

    def hits(self, line: bytes, words: Words, size: int) -> tuple[list[int], list[int]]:
        """Places of hit windows in words, and the numbers of the windows hit."""
        hashes = words.hashes(size)
        top = hashes >> np.uint64(self.shift)
        some = np.flatnonzero(self.sieve[top >> np.uint64(3)] >> (top & np.uint64(7)).astype(np.uint8) & 1)
        low = np.searchsorted(self.hashes, hashes[some])
        equal = self.hashes[np.minimum(low, len(self.hashes) - 1)] == hashes[some]
        at, which = [], []
        for i, k in zip(some[equal].tolist(), low[equal].tolist(), strict=True):
            own = words.slice(i, size)
            while k < len(self.hashes) and self.hashes[k] == hashes[i]:
                if line[self.starts[k] : self.ends[k]] == own:
                    at.append(i)
                    which.append(k)
                    break
                k += 1
        return at, which


class Block:
    """The windows of a block of items; items of fewer than n words are one window."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.ids = sorted({item_id for item_id, _ in items})
        number = {item_id: k for k, item_id in enumerate(self.ids)}
        lines, rows, at = [], {}, 0
        for item_id, text in items:
            words = Words(b" ".join(words_of(text)), clean=True)
            if not len(words):
                continue
            size = min(n, len(words))
            hashes = words.hashes(size)
            own = (hashes, words.starts[: len(hashes)] + at, words.ends[size - 1 :] + at, np.full(len(hashes), number[item_id], dtype=np.int32))
            rows.setdefault(size, []).append(own)
            lines.append(words.line)
            at += len(words.line) + 1
        self.line = b"\n".join(lines)
        self.sizes = {size: Windows(self.line, *map(np.concatenate, zip(*own, strict=True))) for size, own in rows.items()}

    def hits(self, words: Words) -> tuple[np.ndarray, list[str]]:
        """(start, end) of merged runs of hit words, and the items that occur, in order."""
        spans, items = [], []
        for size, windows in self.sizes.items():
            at, which = windows.hits(self.line, words, size)
            if at:
                starts = np.array(at, dtype=np.int64)
                spans.append(np.stack([starts, starts + size], axis=1))
                items.extend(windows.items[windows.bounds[k] : windows.bounds[k + 1]] for k in set(which))
        if not spans:
            return np.zeros((0, 2), dtype=np.int64), []
        return merged(np.concatenate(spans)), [self.ids[k] for k in np.unique(np.concatenate(items)).tolist()]

    @property
    def nbytes(self) -> int:
        arrays = sum(getattr(w, c).nbytes for w in self.sizes.values() for c in ("hashes", "starts", "ends", "items", "bounds", "sieve"))
        return len(self.line) + arrays + sum(map(len, self.ids))


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans joined."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.stack([spans[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]], axis=1)


def pieces_of(words: list[bytes], n: int, most: int) -> Iterator[bytes]:
    """An item's words in pieces that have every window of n between them, of about ``most`` bytes."""
    start, size = 0, 0
    for k, word in enumerate(words):
        cost = len(word) + 1 + WINDOW_BYTES
        if size + cost > most and k - start >= n:
            yield b" ".join(words[start:k])
            start = k - n + 1
            size = sum(len(w) + 1 + WINDOW_BYTES for w in words[start:k])
        size += cost
    if words:
        yield b" ".join(words[start:])


def blocks_of(benchmark: DataFrame, n: int, block_bytes: int) -> list[DataFrame]:
    """The benchmark's items in parts (``id``, ``text``) whose sets need at most about ``block_bytes``.

    Items are cut into pieces of normalised words, which are written and dealt by a hash,
    in as many blocks as their bytes and words ask for. An item without id or text has no
    windows.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text")).where("id is not null and text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            for item_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                words = words_of(text)
                per_word = WINDOW_BYTES * len(words)
                if len(text) + per_word <= block_bytes // PIECES:
                    parts = [b" ".join(words)]
                else:
                    parts = list(pieces_of(words, n, block_bytes // PIECES))
                size = [len(p) + len(item_id.encode()) + WINDOW_BYTES * (p.count(b" ") + 1) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(parts)), pa.array(parts, pa.binary()).cast(pa.string()), pa.array(size, pa.int64())], names=["id", "text", "size"])

    pieces = cut_table(items.mapInArrow(cut, "id string, text string, size long"))
    total = pieces.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    if blocks == 1:
        return [pieces]
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    return [pieces.where(block == k) for k in range(blocks)]


def shared_windows(block: DataFrame, n: int) -> Broadcast[Block]:
    """A block's windows, built once and sent to the tasks."""
    return block.sparkSession.sparkContext.broadcast(Block([(r.id, r.text.encode()) for r in block.toLocalIterator()], n))


def hits_of(docs: DataFrame, key: str, block: DataFrame, n: int, all_rows: bool = True) -> DataFrame:
    """``key``, ``n_words``, ``hit_spans``, ``items`` of the rows of docs (or those with hits)."""
    shared = shared_windows(block, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            counts, spans, found = [], [], []
            for text in texts_of(batch):
                words = Words(b" ".join(words_of(text)), clean=True)
                own, items = shared.value.hits(words)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in own.tolist()])
                found.append(items)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(found, pa.list_(pa.string()))],
                names=[key, "n_words", "hit_spans", "items"],
            )
            yield out if all_rows else out.filter(pa.array([bool(f) for f in found], pa.bool_()))

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, n_words long, hit_spans array<struct<start: long, end: long>>, items array<string>")


def hit_words() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def find(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Benchmark hits in every document.

    docs: ``doc_id``, ``text``; benchmark: ``item_id``, ``text``; other columns are not
    read. Returns one row for each row of docs: ``doc_id``, ``n_words``, ``n_hit``,
    ``n_items``, ``items_sha256``, ``contaminated`` and ``hit_spans`` (array of
    struct<start, end> in words, end exclusive).

    A null or empty text has no words and no hits; an item of fewer than ``n`` words is
    one window; an item without words, id or text has none; items that share an id
    count once. With an empty benchmark nothing is hit. Repeated documents and documents
    that share an id give a row each, with the hits of its own text.
    """
    docs = docs.select("doc_id", "text")
    blocks = blocks_of(benchmark, n, block_bytes)
    if len(blocks) == 1:
        hits = hits_of(docs, "doc_id", blocks[0], n)
    else:
        rows, key = keyed(docs)
        hits = rows.drop("text").join(hits_by_row(rows, key, blocks, n), key)
    return hits.select("doc_id", "n_words", "hit_spans", "items", hit_words().alias("n_hit")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        "hit_spans",
    )


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as a written table, and the name of its new column that numbers the rows."""
    key = "row_key"
    while key in map(str.lower, docs.columns):
        key += "_"
    return cut_table(docs.withColumn(key, F.monotonically_increasing_id())), key


def hits_by_row(rows: DataFrame, key: str, blocks: list[DataFrame], n: int) -> DataFrame:
    """Hits of several blocks by row: spans merged, items joined."""
    every = cut_table(hits_of(rows, key, blocks[0], n))
    for block in blocks[1:]:
        every = every.unionByName(cut_table(hits_of(rows, key, block, n, all_rows=False)))
    together = every.groupBy(key).agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("hit_spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    @F.arrow_udf("array<struct<start: long, end: long>>")
    def joined(spans: pa.Array) -> pa.Array:
        flat = spans.flatten()
        ends, at, out = np.cumsum(pc.list_value_length(spans).to_numpy(zero_copy_only=False)), 0, []
        starts = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in range(2)], axis=1)
        for end in ends.tolist():
            out.append([{"start": a, "end": b} for a, b in merged(starts[at:end]).tolist()])
            at = end
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    return together.withColumn("hit_spans", joined("spans")).drop("spans")


def remove(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that are not contaminated, as they are; all columns of docs stay.

    Every row goes or stays by its own text, whatever its id.
    """
    blocks = blocks_of(benchmark, n, block_bytes)
    if len(blocks) > 1:
        rows, key = keyed(docs)
        bad = hits_by_row(rows, key, blocks, n).where(is_contaminated(hit_words(), F.col("n_words"))).select(key)
        return rows.join(bad, key, "left_anti").select(docs.columns)
    shared = shared_windows(blocks[0], n)

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in texts:
            found = []
            for text in some.cast(pa.binary()):
                words = Words(b" ".join(words_of(text.as_py() or b"")), clean=True)
                spans, _ = shared.value.hits(words)
                hit = int((spans[:, 1] - spans[:, 0]).sum())
                found.append(not (hit > 0 and SHARE * hit >= len(words)))
            yield pa.array(found, pa.bool_())

    return docs.where(clean("text"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the words of every benchmark window cut out of ``text``.

    The text between words stays; only hit words go. All other columns stay, and so do
    null and empty texts. Windows are judged on the texts as they come, so the number of
    blocks changes nothing.
    """
    rows, key = keyed(docs)
    blocks = blocks_of(benchmark, n, block_bytes)
    hit = hits_by_row(rows, key, blocks, n) if len(blocks) > 1 else hits_of(rows, key, blocks[0], n)
    spans = hit.where(F.size("items") > 0).select(F.col(key).alias(f"{key}_of"), F.col("hit_spans").alias(f"{key}_spans"))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.cast(pa.binary()), spans.to_pylist(), strict=True):
            raw = text.as_py()
            out.append(raw if not own or raw is None else cut_words(raw, raw.translate(_WORD_BYTES), [(s["start"], s["end"]) for s in own]))
        return pa.array(out, pa.binary()).cast(pa.string())

    joined = rows.join(spans, F.col(key) == F.col(f"{key}_of"), "left")
    return joined.withColumn("text", cut("text", f"{key}_spans")).select(docs.columns)


def cut_words(text: bytes, plain: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of the spans; plain is text with other bytes as spaces."""
    is_word = np.frombuffer(plain, dtype=np.uint8) != 0x20
    edges = np.diff(np.r_[False, is_word, False].astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    keep = np.ones(len(text), dtype=bool)
    for a, b in spans:
        for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True):
            keep[s:e] = False
    return np.frombuffer(text, dtype=np.uint8)[keep].tobytes()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("hit_spans")


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT cast(item_id AS varchar) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM item_windows
), doc_windows AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM words CROSS JOIN sizes WHERE len(w) >= n)
), hits AS (
  SELECT DISTINCT d.doc_id, d.s, d.n FROM doc_windows d SEMI JOIN item_windows i ON d.n = i.n AND d.win = i.win
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), doc_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT d.doc_id, i.item FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.win = i.win)
  GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN hit_words USING (doc_id) LEFT JOIN doc_items USING (doc_id)
"""
