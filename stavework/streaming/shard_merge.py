"""Tables kept merged by key, from streams of shards and by several writers at a time.

A table is cut into buckets by a hash of its keys. Its log has a numbered entry for every
change, which names the folder of each bucket and the last batch of each writer, so the
newest entry is the whole state. A writer merges its rows with the buckets that they
touch, writes those as a new folder, and then claims the next number, by a step that fails
if the number is taken. A writer that comes second deletes its folder, reads the newest
entry and merges again. Nothing is locked: a writer that dies leaves at most a folder that
no entry names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stavework.operators.tables import last_of_each, spare

#: How many parts a merged table has by its keys; only parts with a key of the batch are written anew.
BUCKETS = 256
LOG, DATA = "_log", "data"


@dataclass
class Entry:
    """A state of a table: folders by bucket (below ``target``), and the last batch of each writer."""

    number: int = 0
    buckets: dict[int, str] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)

    def as_text(self) -> str:
        return json.dumps({"buckets": self.buckets, "writers": self.writers})


class Log:
    """The entries of a table, in files that are never changed."""

    def __init__(self, spark: SparkSession, target: str):
        self.jvm, self.target = spark._jvm, target
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self.path().getFileSystem(self.conf)

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.target, *parts)))

    def numbers(self) -> list[int]:
        folder = self.path(LOG)
        names = [s.getPath().getName() for s in self.files.listStatus(folder)] if self.files.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, number: int) -> Entry:
        stream = self.files.open(self.path(LOG, f"{number:012d}"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Entry(number, {int(b): f for b, f in found["buckets"].items()}, found["writers"])

    def newest(self) -> Entry:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else Entry()

    def claim(self, entry: Entry) -> bool:
        """Add an entry, whole or not at all; False if its number is taken."""
        draft, final = self.path(LOG, f".draft-{uuid.uuid4().hex}"), self.path(LOG, f"{entry.number:012d}")
        self.files.mkdirs(self.path(LOG))
        stream = self.files.create(draft, False)
        try:
            stream.write(bytearray(entry.as_text().encode()))
        finally:
            stream.close()
        try:
            if self.files.getUri().getScheme() == "file":  # whose rename may replace; a link never does
                of = lambda p: self.jvm.java.nio.file.Path.of(p.toUri().getPath(), self._strings())
                self.jvm.java.nio.file.Files.createLink(of(final), of(draft))
            else:
                option = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self._array(self.jvm.org.apache.hadoop.fs.Options.Rename, option)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self.conf).rename(draft, final, options)
        except Exception as problem:
            if "AlreadyExists" not in str(problem):
                raise
            return False
        finally:
            self.files.delete(draft, False)
        return True

    def _strings(self):
        return self._array(self.jvm.java.lang.String)

    def _array(self, kind, *items):
        array = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName(kind._fqn), len(items))
        for k, item in enumerate(items):
            array[k] = item
        return array


def upsert(spark: SparkSession, target: str, batch: DataFrame, keys: Sequence[str], order: str, writer: str | None = None, number: int = 0, buckets: int = BUCKETS) -> Entry:
    """Merge rows into ``target``; of rows with the same key the last by ``order`` wins. Returns the entry that has them.

    Any number of writers may do so at a time. Of rows with the same key and order the one
    with the largest other columns wins, so the order of writers changes nothing. With
    ``writer``, a batch whose number isn't above the writer's last is in the table already
    and left out. ``buckets`` must stay the same for a table.
    """
    log, name = Log(spark, target), spare(batch, "bucket")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    touched = [r[0] for r in batch.select(bucket.alias(name)).distinct().collect()]  # at most ``buckets`` numbers
    while True:
        base = log.newest()
        if writer is not None and number <= base.writers.get(writer, -1):
            return base
        folder = f"{DATA}/{uuid.uuid4().hex}"
        made: dict[int, str] = {}
        if touched:
            merged = last_of_each(_read(spark, target, batch.schema, base, touched).unionByName(batch), keys, order)
            merged.withColumn(name, bucket).write.partitionBy(name).parquet(f"{target}/{folder}")
            made = {b: f"{folder}/{name}={b}" for b in touched}
        writers = base.writers | ({writer: number} if writer is not None else {})
        entry = Entry(base.number + 1, base.buckets | made, writers)
        if log.claim(entry):
            return entry
        log.files.delete(log.path(folder), True)


def merge_shards(spark: SparkSession, shards: str, target: str, schema: StructType, keys: Sequence[str], order: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep ``target`` merged with every Parquet shard that appears in a folder.

    Each micro-batch is one ``upsert``, under the checkpoint's name as the writer's: a
    batch that is run again after a failure is in the table once. Further streams and
    other writers may work on the same table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        upsert(batch.sparkSession, target, batch, keys, order, checkpoint, number, buckets)

    stream = spark.readStream.schema(schema).parquet(shards)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, target: str, schema: StructType, entry: Entry, buckets: Sequence[int] | None = None) -> DataFrame:
    paths = [f"{target}/{p}" for b, p in sorted(entry.buckets.items()) if buckets is None or b in set(buckets)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def latest(spark: SparkSession, target: str, schema: StructType, buckets: Sequence[int] | None = None) -> DataFrame:
    """A merged table as of its newest entry, or an empty one; all of it or some buckets."""
    return _read(spark, target, schema, Log(spark, target).newest(), buckets)


def drop_outdated(spark: SparkSession, target: str) -> list[str]:
    """Delete older entries and the folders of buckets that the newest doesn't name, once nobody reads or writes them. Returns the folders."""
    log = Log(spark, target)
    kept, gone = set(log.newest().buckets.values()), []
    inside = lambda *at: [s.getPath().getName() for s in log.files.listStatus(log.path(*at)) if s.isDirectory()] if log.files.exists(log.path(*at)) else []
    for folder in inside(DATA):
        own = inside(DATA, folder)
        for bucket in own:
            if f"{DATA}/{folder}/{bucket}" not in kept:
                log.files.delete(log.path(DATA, folder, bucket), True)
                gone.append(f"{target}/{DATA}/{folder}/{bucket}")
        if not any(f"{DATA}/{folder}/{b}" in kept for b in own):
            log.files.delete(log.path(DATA, folder), True)
    for number in log.numbers()[:-1]:
        log.files.delete(log.path(LOG, f"{number:012d}"), False)
    return sorted(gone)
