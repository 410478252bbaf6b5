"""SimHash near-duplicate groups through pigeonhole blocks.

A document's fingerprint has a bit set where more than half of its three-word shingles'
hashes have it. Fingerprints are linked at two or fewer differing bits, and a group is a
connected component of links.

Fingerprints are cut into five pieces. Two that differ in at most two bits agree on at
least three of the pieces, so they meet in at least one of the ten blocks made of three
pieces (38 bits or more, which few unrelated fingerprints share). Equal fingerprints are
one row from the start. A small block compares its pairs. A block with more than
``small_block`` fingerprints, as a large family of near copies makes, is not paired:
two fingerprints at distance two or less have a neighbour at distance one or less in
common, so its members are grouped by those 65 neighbours, which at most 65
fingerprints can share. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.llm.common import cut_table, table, text_chunks, texts_of
from stavework.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: (lowest bit, bits) of the five pieces.
PIECES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Blocks of up to this many fingerprints are compared pair by pair.
SMALL_BLOCK = 24
#: Shingles whose bits are counted at a time.
COUNT_ROWS = 1 << 15


def fingerprint_of(text: bytes, words_in_shingle: int = SHINGLE) -> int:
    """A text's fingerprint as an unsigned number; a text without words has zero."""
    words = text.lower().split()  # of bytes: only A-Z, and the six ASCII white spaces
    n = len(words)
    if not n:
        return 0
    k = min(words_in_shingle, n)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    votes, shingles = np.zeros(64, dtype=np.int64), n - k + 1
    for lo in range(0, shingles, COUNT_ROWS):
        hi = min(lo + COUNT_ROWS, shingles)
        hashes = [digest(line[s:e], SEED) for s, e in zip(starts[lo:hi].tolist(), ends[lo + k - 1 : hi + k - 1].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    on = 2 * votes > shingles
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a long) and ``row`` (a hash of the text) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            values = np.array([fingerprint_of(t) for t in texts_of(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), batch.column(2)], names=["doc_id", "fp", "row"])

    return docs.select("doc_id", "text", text_hash()).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long, row long")


def text_hash() -> Column:
    """Tells rows that share an id apart."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("row")


def blocks(prints: DataFrame) -> DataFrame:
    """Each fingerprint ``fp`` with its ten blocks (``k``, ``block``)."""

    def mask(pieces: tuple[tuple[int, int], ...]) -> int:
        whole = sum(((1 << bits) - 1) << low for low, bits in pieces)
        return whole - (1 << 64) if whole >> 63 else whole

    keep = len(PIECES) - DISTANCE
    every = [
        F.struct(F.lit(i).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(mask(some))).alias("block"))
        for i, some in enumerate(combinations(PIECES, keep))
    ]
    return prints.select("fp", F.inline(F.array(*every)))


def links(prints: DataFrame, small_block: int = SMALL_BLOCK) -> DataFrame:
    """Edges (``a``, ``b``) whose components are those of all links.

    prints: distinct ``fp``. Links inside large blocks are given through a common
    neighbour's smallest member, all others directly.
    """
    dealt = blocks(prints)
    # written first: a join of two plain scans is one that can be split where it is skewed
    sizes = cut_table(dealt.groupBy("k", "block").agg(F.count("*").alias("n")).where("n > 1"))
    shared = cut_table(dealt.join(sizes, ["k", "block"]))
    small, large = shared.where(F.col("n") <= small_block), shared.where(F.col("n") > small_block)
    one, two = (small.select("k", "block", F.col("fp").alias(c)) for c in ("a", "b"))
    pairs = (
        one.join(two, ["k", "block"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    )
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("long") for i in range(64)))
    near = large.select("fp").distinct().select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("neighbour"))
    # a neighbour is at distance one or less from each of its members: at most 65
    groups = near.groupBy("neighbour").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    stars = groups.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, small_block: int = SMALL_BLOCK) -> DataFrame:
    """Fingerprint and group of every document.

    docs: ``doc_id``, ``text``; other columns are not read. Returns ``doc_id``, ``row`` (a
    hash of the text), ``fp``, ``component_id``: the smallest ``doc_id`` that links reach, the document's own
    included. Null and empty texts have the fingerprint zero and are linked like any
    other; repeated rows give repeated rows; an empty table gives an empty one; null
    ids get a component by their text but never name one unless all ids in it are null.
    """
    prints = cut_table(fingerprints(docs))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints.select("fp").distinct(), small_block))
    joined = cut_table(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    named = cut_table(joined.groupBy("root").agg(F.min("first").alias("component_id")))
    by_print = joined.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "row", "fp", "component_id")


def keep_one(docs: DataFrame, small_block: int = SMALL_BLOCK) -> DataFrame:
    """docs with one document of each group: the one with the smallest id.

    All columns stay. Of rows that share an id only those go whose own text has a group
    with a smaller id; rows that share the smallest id and rows with a null id all stay.
    """
    found = near_duplicates(docs, small_block).where("component_id < doc_id")
    # without the fingerprint, so that rows are dealt anew and a frequent one can be split
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (text_hash_of(docs) == gone["gone_row"]), "left_anti")


def text_hash_of(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
