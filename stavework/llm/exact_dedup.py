"""Exact de-duplication by Grace hashing with tables that compare complete content.

Every task first merges its own equal texts in an open-addressing table of bounded
memory, which is emptied into the shuffle whenever it is full: a text that a third of all
rows share leaves each task about once. The shuffle deals these records by hash; its
partitions are rebalanced ones, so adaptive execution may split one that a frequent long
text makes large. A task then fills a table with distinct contents. When its bytes are
used up, records equal to one in it are still merged, all others are partitioned by the
next digits of their hash to spill files, and every file is resolved in the same way with
a table of its own until it fits. A table keeps what it has taken, so even records of one
hash come to an end.

Spill files are scratch of one task, beside Spark's own in its local folders, and go with
it; another executor that runs the task again writes its own. What is left of every
distinct text is one narrow row (or one for each part of a split partition, merged by
the text's SHA-256), which is written and joined with the documents. That join has plain
scans below it and none of its rows need stay together, so a hot text can be split.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.llm.common import CHUNK_BYTES, cut_table, sha256_of, table, text_chunks

#: Bytes of distinct content that a table holds.
TABLE_BYTES = 64 << 20
#: Spill files of one level, and the bits of the hash that choose one.
FANOUT_BITS = 4
#: Bytes that wait for a spill file before they are written.
SPILL_BYTES = 1 << 20
#: What an entry counts for besides its content.
ENTRY_BYTES = 64


class ContentTable:
    """Distinct contents with open addressing and linear probing, at most half full.

    ``hashes``, ``contents``, ``ids`` (the largest, or None) and ``counts`` are parallel.
    """

    def __init__(self, slots: int = 64):
        self.slots, self.mask, self.bytes = [-1] * slots, slots - 1, 0
        self.hashes, self.contents, self.ids, self.counts = [], [], [], []

    def __len__(self) -> int:
        return len(self.contents)

    def find(self, h: int, content: bytes) -> int:
        """The entry of the content, or -1 less the slot where it would go."""
        slots, mask, at = self.slots, self.mask, h & self.mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        return -1 - at

    def merge(self, entry: int, doc_id, count: int) -> None:
        self.counts[entry] += count
        if doc_id is not None and (self.ids[entry] is None or doc_id > self.ids[entry]):
            self.ids[entry] = doc_id

    def put(self, slot: int, h: int, content: bytes, doc_id, count: int) -> None:
        """Take a content that ``find`` didn't find; ``slot`` is the one that it gave."""
        self.slots[slot] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.ids.append(doc_id)
        self.counts.append(count)
        self.bytes += len(content) + ENTRY_BYTES
        if 2 * len(self.contents) > self.mask:
            self._grow()

    def _grow(self) -> None:
        self.slots, self.mask = [-1] * (2 * len(self.slots)), 2 * len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = entry


Record = tuple  # (hash, content, largest id or None, count)


class SpillFile:
    """Records in an Arrow stream file, written in pieces of about SPILL_BYTES."""

    def __init__(self, path: Path, id_type: pa.DataType):
        self.path, self.rows, self.bytes = path, [], 0
        self.schema = pa.schema([("h", pa.int64()), ("text", pa.large_binary()), ("id", id_type), ("n", pa.int64())])
        self.sink = pa.OSFile(str(path), "wb")
        self.writer = pa.ipc.new_stream(self.sink, self.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))

    def write(self, record: Record) -> None:
        self.rows.append(record)
        self.bytes += len(record[1]) + ENTRY_BYTES
        if self.bytes >= SPILL_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
            self.writer.write_batch(pa.record_batch(columns, schema=self.schema))
        self.rows, self.bytes = [], 0

    def close(self) -> None:
        self._flush()
        self.writer.close()
        self.sink.close()

    def records(self) -> Iterator[Record]:
        """Everything written, once; the file goes when its end is reached."""
        with pa.OSFile(str(self.path), "rb") as source, pa.ipc.open_stream(source) as batches:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
        self.path.unlink()


def resolve(records: Iterable[Record], id_type: pa.DataType, folder: Path, table_bytes: int = TABLE_BYTES, depth: int = 0) -> Iterator[Record]:
    """One record for every distinct content of the records, with the largest id and the sum of counts."""
    held, spills = ContentTable(), {}
    for h, content, doc_id, count in records:
        entry = held.find(h, content)
        if entry >= 0:
            held.merge(entry, doc_id, count)
        elif not len(held) or held.bytes + len(content) <= table_bytes:
            held.put(-1 - entry, h, content, doc_id, count)
        else:
            digit = (h >> max(0, 64 - FANOUT_BITS * (depth + 1))) & ((1 << FANOUT_BITS) - 1)
            if digit not in spills:
                fd, path = tempfile.mkstemp(dir=folder)
                os.close(fd)
                spills[digit] = SpillFile(Path(path), id_type)
            spills[digit].write((h, content, doc_id, count))
    yield from zip(held.hashes, held.contents, held.ids, held.counts, strict=True)
    del held
    for spill in spills.values():
        spill.close()
    for spill in spills.values():
        yield from resolve(spill.records(), id_type, folder, table_bytes, depth + 1)


def _in_pieces(records: Iterable[Record], schema: pa.Schema, row) -> Iterator[pa.RecordBatch]:
    """Batches of row(record), of about CHUNK_BYTES of content each."""
    rows, size = [], 0
    for record in records:
        rows.append(row(record))
        size += len(record[1]) + ENTRY_BYTES
        if size >= CHUNK_BYTES:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def merged_by_task(texts: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``h``, ``text``, ``keep_id``, ``n``: equal texts of a task merged while its table has room.

    texts: ``h`` (a long), ``text`` (binary), ``doc_id``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = ContentTable(), None
        for batch in text_chunks(batches):
            schema = pa.schema([("h", pa.int64()), ("text", pa.binary()), ("keep_id", batch.schema.field("doc_id").type), ("n", pa.int64())])
            for h, content, doc_id in zip(*(batch.column(c).to_pylist() for c in ("h", "text", "doc_id")), strict=True):
                entry = held.find(h, content)
                if entry >= 0:
                    held.merge(entry, doc_id, 1)
                    continue
                if len(held) and held.bytes + len(content) > table_bytes:
                    yield from _in_pieces(zip(held.hashes, held.contents, held.ids, held.counts, strict=True), schema, tuple)
                    held = ContentTable()
                    entry = held.find(h, content)
                held.put(-1 - entry, h, content, doc_id, 1)
        if schema is not None:
            yield from _in_pieces(zip(held.hashes, held.contents, held.ids, held.counts, strict=True), schema, tuple)

    return texts.mapInArrow(run, f"h long, text binary, keep_id {dict(texts.dtypes)['doc_id']}, n long")


def classes(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``sha``, ``keep_id`` and ``n`` of every distinct text."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    records = merged_by_task(docs.select(F.xxhash64(text).alias("h"), text.alias("text"), "doc_id"), table_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        id_type = first.schema.field("keep_id").type

        def every() -> Iterator[Record]:
            yield from zip(*(c.to_pylist() for c in first.columns), strict=True)
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        # Spark's own scratch folders, as its Python side uses them; the first is one of this executor
        scratch = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        schema = pa.schema([("sha", pa.string()), ("keep_id", id_type), ("n", pa.int64())])
        with tempfile.TemporaryDirectory(dir=scratch, prefix="grace-") as folder:
            yield from _in_pieces(resolve(every(), id_type, Path(folder), table_bytes), schema, lambda r: (hashlib.sha256(r[1]).hexdigest(), r[2], r[3]))

    parts = records.hint("rebalance", "h").mapInArrow(run, f"sha string, keep_id {dict(docs.dtypes)['doc_id']}, n long")
    return parts.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def _sha(docs: DataFrame) -> Column:
    return sha256_of(F.coalesce(docs["text"], F.lit("")))


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` of every row of docs.

    docs: ``doc_id`` (of any ordered type) and ``text``; other columns, whatever their
    names, are not read. A null text is an empty one. The largest id of a group stays;
    rows without an id are never it while another of their texts has one. Rows that share
    text and largest id (or have no id, as all of their text) are all kept, since nothing
    tells them apart. Long texts are compared whole, and one larger than a table has a
    table of its own. An empty table gives an empty one.
    """
    found = cut_table(classes(docs, table_bytes))
    rows = docs.select(docs["doc_id"], _sha(docs).alias("text_sha256"))
    joined = rows.join(found, rows["text_sha256"] == found["sha"])
    return joined.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs that ``exact_groups`` keeps, with all their columns."""
    found = exact_groups(docs, table_bytes).where("not kept")
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (_sha(docs) == gone["gone_sha"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  coalesce(doc_id = max(doc_id) OVER same, max(doc_id) OVER same IS NULL) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
