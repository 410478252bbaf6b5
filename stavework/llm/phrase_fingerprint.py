"""Document fingerprints by locally consistent parsing.

A text is parsed into a hierarchy of phrases. On each level, runs of one symbol become
a symbol; deterministic coin tossing against the left neighbour shrinks the symbols'
names to a handful of labels in which neighbours differ; and a phrase begins at every
local maximum of the labels. A phrase's name is a hash of its symbols' names. Whether a
phrase begins at a place depends on a few symbols around it, so equal substrings get
equal phrases inside, wherever they stand.

The names of all phrases of at least ``SPAN`` characters are sketched by one-permutation
minima in ``BINS`` bins; the share of equal bins is the likeness of two texts. Texts
without such a phrase are sketched by the name of the whole text.

All texts of a batch are parsed together, as flat arrays with a text number for each
symbol.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.llm.common import cut_table, table, text_chunks, texts_of

BINS = 64
SPAN = 8
#: Rounds of coin tossing on a level: 64-bit names to labels under 128, 14 and 8.
TOSSES = 3
#: Characters that are parsed at a time, where texts are short enough.
PARSE_CHARS = 1 << 16
EMPTY_BIN = 0xFFFF
#: Keys that are sampled for each range of ids.
SAMPLE_KEYS = 16

_U = np.uint64
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels by the lowest bit in which a symbol differs from its left neighbour.

    first: symbols that begin a text; their neighbour is their complement.
    """
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[first] = ~label[first]
    differ = label ^ left
    low = differ & (~differ + label.dtype.type(1))
    place = np.bitwise_count(low - label.dtype.type(1))
    return (place << np.uint8(1)) | ((label & low) != 0).astype(np.uint8)


def parse(points: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(names, owners, spans in characters, last) of each level's phrases.

    points: all texts' code points in a row; owner: their text numbers, ascending. A text
    that has become one symbol is given with ``last`` and takes no part in further
    levels, so that its phrases don't depend on the texts around it.
    """
    names, spans = (points.astype(np.uint64) + _U(1)) * _POWERS[0], np.ones(len(points), dtype=np.int64)
    while len(names):
        # runs of one symbol
        new = np.empty(len(names), dtype=bool)
        new[0] = True
        new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
        if not new.all():
            at = np.flatnonzero(new)
            count = np.diff(np.r_[at, len(names)])
            spans = np.add.reduceat(spans, at)
            names = np.where(count > 1, mix(names[at] + count.astype(np.uint64) * _POWERS[1]), names[at])
            owner = owner[at]
        first = np.empty(len(names), dtype=bool)
        first[0] = True
        first[1:] = owner[1:] != owner[:-1]
        alone = first.copy()
        alone[:-1] &= first[1:]
        if alone.any():
            yield names[alone], owner[alone], spans[alone], True
            names, owner, spans, first = (x[~alone] for x in (names, owner, spans, first))
            if not len(names):
                return
        begins = np.flatnonzero(first)
        label = toss(names, begins)
        for _ in range(TOSSES - 1):
            label = toss(label, begins)
        up = np.ones(len(label), dtype=bool)
        up[1:] = label[1:] > label[:-1]
        down = np.ones(len(label), dtype=bool)
        down[:-1] = label[:-1] > label[1:]
        down[:-1] &= ~first[1:]  # the last symbol of a text joins the phrase before it
        down[-1] = False
        cut = up & down
        cut[1:] &= ~first[:-1]  # so does the first symbol the phrase after it
        cut |= first
        at = np.flatnonzero(cut)
        place = np.arange(len(names)) - np.repeat(at, np.diff(np.r_[at, len(names)]))
        names = mix(np.add.reduceat(names * _POWERS[np.minimum(place, 63)], at))
        owner, spans = owner[at], np.add.reduceat(spans, at)
        yield names, owner, spans, False


def sketches(texts: list[str]) -> np.ndarray:
    """One row of BINS 16-bit minima for each text; an empty text has EMPTY_BIN only."""
    out = np.full((len(texts), BINS), EMPTY_BIN, dtype=np.uint16)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    start = 0
    while start < len(texts):  # bounded work arrays
        stop = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:]), PARSE_CHARS, side="right")) + start)
        points = np.frombuffer("".join(texts[start:stop]).encode("utf-32-le"), dtype=np.uint32)
        flat = out[start:stop].reshape(-1)
        owner = np.repeat(np.arange(stop - start), sizes[start:stop])
        done = np.zeros(stop - start, dtype=bool)
        for names, own, spans, last in parse(points, owner):
            wide = spans >= SPAN
            if last:  # one name for each text that has none
                wide |= ~done[own]
            _add(flat, names[wide], own[wide])
            done[own[wide]] = True
        start = stop
    return out


def _add(flat: np.ndarray, names: np.ndarray, own: np.ndarray) -> None:
    """Lower the bins of ``flat`` by the names' values."""
    names = mix(names ^ _U(0x5851F42D4C957F2D))
    bins = own * BINS + (names >> _U(64 - (BINS.bit_length() - 1))).astype(np.int64)
    np.minimum.at(flat, bins, (names & _U(0xFFFF)).astype(np.uint16) % np.uint16(EMPTY_BIN))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows' shares of equal bins among those that either has; 1 for two empty rows."""
    used = (a != EMPTY_BIN) | (b != EMPTY_BIN)
    n = used.sum(axis=1)
    return np.where(n > 0, ((a == b) & used).sum(axis=1) / np.maximum(n, 1), 1.0)


def as_text(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (64 bins of four hex digits) of every row of docs.

    Equal texts have equal fingerprints. Null texts are empty ones. Texts of any length
    are parsed whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            rows = sketches([t.decode() for t in texts_of(batch)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(as_text(rows))], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (``bucket``, ``guest``, ``doc_id``, ``text``) dealt out so that each document is
    followed by the next one in descending order of id.

    The order is that of (id, hash of the text), so rows that share an id, or have none
    and come last, can be in several ranges. Ranges are cut at quantiles of a sample of
    SAMPLE_KEYS keys for each of the session's shuffle partitions; where the cuts lie changes
    no result. The largest key of each range is also sent, as a guest, to the range above
    (the largest of all to the lowest range), where it follows the last document. The
    driver gets the sample and one key for each range.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).alias("key")
    keys = cut_table(docs.select(key))
    some = keys.orderBy(F.xxhash64("key")).limit(SAMPLE_KEYS * ranges).orderBy("key").collect()
    cuts = list(dict.fromkeys((r.key.id, r.key.h) for r in (some[k * len(some) // ranges] for k in range(1, ranges) if some)))
    among = _literals(cuts, kind)
    # cuts below the key, by a search in halves
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length())))).cast("array<int>")
    below = lambda place: (place <= len(cuts)) & (F.get(among, place - 1) < F.col("key"))
    bucket = F.aggregate(steps, F.lit(0), lambda low, step: F.when(below(low + step), low + step).otherwise(low)).alias("bucket")
    tops = keys.select("key", bucket).groupBy("bucket").agg(F.max("key").alias("top")).orderBy("bucket").collect()
    top_of = {r.bucket: (r.top.id, r.top.h) for r in tops}
    above = dict(zip(top_of, [*list(top_of)[1:], *list(top_of)[:1]], strict=True))
    every = range(len(cuts) + 1)
    top = F.get(_literals([top_of.get(b) for b in every], kind), F.col("bucket"))
    to = F.get(F.array(*(F.lit(above.get(b)) for b in every)).cast("array<int>"), F.col("bucket"))
    home, visit = F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.struct(to.alias("bucket"), F.lit(True).alias("guest"))
    places = F.when(top.eqNullSafe(F.col("key")), F.array(home, visit)).otherwise(F.array(home))
    dealt = docs.select("doc_id", "text", key).select("doc_id", "text", "key", bucket)
    spread = dealt.select("doc_id", "text", "key", F.inline(places))
    placed = spread.repartitionById(len(every), F.col("bucket")).sortWithinPartitions("bucket", "guest", F.desc("key"))
    return placed.select("bucket", "guest", "doc_id", "text")


def _literals(keys: list[tuple | None], kind: str) -> Column:
    """An array of keys (or nulls)."""
    shape = f"struct<id: {kind}, h: bigint>"
    one = lambda k: F.lit(None).cast(shape) if k is None else F.struct(F.lit(k[0]).cast(kind).alias("id"), F.lit(k[1]).cast("long").alias("h"))
    return F.array(*map(one, keys)).cast(f"array<{shape}>")


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as much of the start of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def edit_resistance(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    Returns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``, one row for each row of
    docs, whose ids are of any ordered type and come back as they are. Rows that share an
    id follow each other by their texts' hashes, rows without one come last. With a
    single document the next one is itself. Null texts are empty; an empty table gives
    an empty one.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def compare(rows: list[tuple[int, bool, object, str]], id_type: pa.DataType) -> pa.RecordBatch:
        """Rows but the last, each with its follower; a bucket's own rows come first."""
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1]]
        own = [a[3] for a, _ in pairs]
        after = [edited(a[3], b[3]) for a, b in pairs]
        prints = sketches([r[3] for r in rows])
        at = [i for i in range(len(rows) - 1) if not rows[i][1]]
        now, following, changed = prints[at], prints[[i + 1 for i in at]], sketches(after)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([a[2] for a, _ in pairs], id_type),
                pa.array([len(t) for t in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in after], pa.string()),
                pa.array(as_text(now), pa.string()),
                pa.array(as_text(changed), pa.string()),
                pa.array(likeness(now, changed), pa.float64()),
                pa.array(likeness(now, following), pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[tuple[int, bool, object, str]] = []
        for batch in text_chunks(batches):
            columns = [batch.column(k).to_pylist() for k in range(3)]
            rows = carried + [(*r, t.decode()) for *r, t in zip(*columns, texts_of(batch), strict=True)]
            yield compare(rows, batch.schema.field("doc_id").type)
            carried = rows[-1:]

    schema = (
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return with_next(docs).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_resistance(table(spark, sf_dir, "documents"))
