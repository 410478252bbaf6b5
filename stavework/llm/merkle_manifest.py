"""Merkle manifests of a dataset: a tree for each group of rows, a tree of their roots, and proofs.

Rows are leaves, in order within their group. They are dealt to partitions by range, so
every partition holds a run of consecutive leaves of one or several groups, and a sum
over the runs of a group gives each run its first index. A partition goes through its
runs with a stack of completed nodes, a mountain range: as a counter in base ``fanout``
carries, the last ``fanout`` peaks of one level become a peak of the next. A group's last
nodes close with fewer children, without padding. What stays on the stack at the end of
a run are peaks whose siblings lie in other partitions, a few for each level; these are
dealt by range and merged by the same stack, in as many rounds as it takes until few
enough are left for one task. The roots of the groups then go through the same steps.

A proof needs the siblings on a leaf's way up. Those inside its run are computed from the
run's leaves; those outside are peaks or merged nodes, of which a run asks for at most
2 * fanout on each level. No task holds more than the leaves of its partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.llm.common import cut_table, table

FANOUT = 2
#: Leaves of a partition, about.
RUN_ROWS = 1 << 17
#: Peaks that one task merges.
MERGE_ROWS = 1 << 18
#: Rows of an Arrow batch that a step returns.
OUT_ROWS = 4096

NODE = "grp string, level int, j long, digest string, n long, start long, peak boolean, top boolean"


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def hash_of(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def level_sizes(n: int, fanout: int) -> list[int]:
    """The number of nodes on every level over n leaves, the last of them 1."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // fanout))
    return sizes


class Mountains:
    """Completed nodes of a run of a group with n leaves, by a stack of peaks."""

    def __init__(self, n: int, fanout: int):
        self.sizes, self.fanout = level_sizes(n, fanout), fanout
        self.stack: list[tuple[int, int, bytes]] = []

    def push(self, level: int, j: int, digest: bytes) -> list[tuple[int, int, bytes]]:
        """Take the next node of the run; returns those that are now below others."""
        stack, fanout, sizes, below = self.stack, self.fanout, self.sizes, []
        stack.append((level, j, digest))
        while level + 1 < len(sizes):
            at = j % fanout
            if at < fanout - 1 and j + 1 < sizes[level]:
                break
            if len(stack) <= at or stack[-1 - at][:2] != (level, j - at):
                break
            children = stack[-1 - at :]
            del stack[-1 - at :]
            below += children
            level, j = level + 1, j // fanout
            stack.append((level, j, hash_of(*(c[2] for c in children))))
        return below


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _out(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == OUT_ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


_NODE_SCHEMA = pa.schema([("grp", pa.string()), ("level", pa.int32()), ("j", pa.int64()), ("digest", pa.string()), ("n", pa.int64()), ("start", pa.int64()), ("peak", pa.bool_()), ("top", pa.bool_())])


def _climbed(runs: Iterator[tuple[str | None, int, Iterator[tuple[int, int, str]]]], fanout: int) -> Iterator[tuple]:
    """Node records of runs (group, its n, nodes in order): all but leaves that aren't peaks."""
    for grp, n, nodes in runs:
        range_ = Mountains(n, fanout)
        top = len(range_.sizes) - 1
        for level, j, digest in nodes:
            for below in range_.push(level, j, digest.encode()):
                if below[0]:
                    yield grp, below[0], below[1], below[2].decode(), n, below[1] * fanout ** below[0], False, False
        for level, j, digest in range_.stack:
            yield grp, level, j, digest.decode(), n, j * fanout**level, True, level == top


@dataclass
class Forest:
    """The trees of all groups.

    leaves: ``pid``, ``grp``, ``pos``, ``id``, ``leaf``, ``other``; runs: ``pid``,
    ``grp``, ``start`` (index of the first leaf), ``first`` (its ``pos``), ``m`` (leaves
    of the run), ``n`` (of the group); tables: node records, those of the runs first and
    then those of every round of merging; parts: partitions of the leaves.
    """

    leaves: DataFrame
    runs: DataFrame
    tables: list[DataFrame]
    fanout: int
    parts: int

    def nodes(self) -> DataFrame:
        """``grp``, ``level``, ``j``, ``digest`` of every node over the leaves."""
        # a peak is named again in the round that puts it below another
        return reduce(DataFrame.unionByName, self.tables).where("level > 0 and (not peak or top)").select("grp", "level", "j", "digest")

    def roots(self) -> DataFrame:
        """``grp`` and ``root``, one row for each group."""
        return reduce(DataFrame.unionByName, self.tables).where("top").select("grp", F.col("digest").alias("root"))

    def outside(self) -> DataFrame:
        """Nodes whose parents lie in no single run."""
        return reduce(DataFrame.unionByName, self.tables[1:], self.tables[0].where("peak")).select("grp", "level", "j", "digest").distinct()


def forest(leaves: DataFrame, fanout: int = FANOUT, run_rows: int = RUN_ROWS, merge_rows: int = MERGE_ROWS) -> Forest:
    """Trees over ``leaves``: ``grp`` (a string), ``id`` (of any ordered type), ``leaf``, ``other``.

    Leaves of a group go by ``id`` and then by ``leaf``; nulls come first.
    """
    spark = leaves.sparkSession
    n = leaves.count()
    # as many partitions as tasks run at a time, if they are worth it
    parts = max(1, -(-n // run_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1024))
    # equal leaves may stand in any order, so a tie may be dealt to several partitions
    order = ["grp", "id", "leaf", "tie"]
    dealt = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = dealt.select(at.alias("at"), "grp", "id", "leaf", "other")
    placed = cut_table(placed.select(F.shiftright("at", 33).cast("int").alias("pid"), "grp", F.col("at").bitwiseAND((1 << 33) - 1).alias("pos"), "id", "leaf", "other"))
    counted = placed.groupBy("pid", "grp").agg(F.count("*").alias("m"), F.min("pos").alias("first"))
    # a row for each partition and each further group in it
    runs = cut_table(counted.selectExpr("pid", "grp", "sum(m) OVER (PARTITION BY grp ORDER BY pid) - m AS start", "first", "m", "sum(m) OVER (PARTITION BY grp) AS n"))

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def by_run() -> Iterator[tuple]:
            rows = (r for b in batches for r in _columns(b))
            head = next(rows, None)
            while head is not None:
                following: list[tuple] = []

                def own(start: int, following: list = following) -> Iterator[tuple[int, int, str]]:
                    for k, row in enumerate(rows):
                        if row[2] < 0:
                            following.append(row)
                            return
                        yield 0, start + k, row[5]

                yield head[1], head[4], own(head[3])
                head = following[0] if following else None

        yield from _out(_climbed(by_run(), fanout), _NODE_SCHEMA)

    heads = runs.select("pid", "grp", F.lit(-1).cast("long").alias("pos"), "start", "n", F.lit(None).cast("string").alias("leaf"))
    below = placed.select("pid", "grp", "pos", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("n"), "leaf")
    both = heads.unionByName(below).repartition(parts, "pid").sortWithinPartitions("pid", "grp", "pos")
    tables = [cut_table(both.mapInArrow(climb, NODE))]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def by_group() -> Iterator[tuple]:
            rows = (r for b in batches for r in _columns(b))
            row = next(rows, None)
            while row is not None:
                following: list[tuple] = []

                def own(first: tuple, following: list = following) -> Iterator[tuple[int, int, str]]:
                    yield first[1:4]
                    for other in rows:
                        if other[0] != first[0]:
                            following.append(other)
                            return
                        yield other[1:4]

                yield row[0], row[4], own(row)
                row = following[0] if following else None

        yield from _out(_climbed(by_group(), fanout), _NODE_SCHEMA)

    while open_ := (peaks := tables[-1].where("peak and not top")).count():
        spread = peaks.select("grp", "level", "j", "digest", "n", "start")
        some = -(-open_ // merge_rows)
        spread = spread.repartitionByRange(some, "grp", "start") if some > 1 else spread.repartition(1)
        tables.append(cut_table(spread.sortWithinPartitions("grp", "start").select("grp", "level", "j", "digest", "n").mapInArrow(merge, NODE)))
    return Forest(placed, runs, tables, fanout, parts)


class Run:
    """The nodes over leaves start, start + 1, ... of a group with n leaves, with ``around``: those outside."""

    def __init__(self, leaves: list[bytes], start: int, n: int, fanout: int, around: dict[tuple[int, int], bytes]):
        self.start, self.fanout = start, fanout
        self.sides: list[tuple[int, list[tuple[bytes, bytes]]]] = []
        own, first = leaves, start
        lo, hi = start, start + len(leaves) - 1
        for level, size in enumerate(level_sizes(n, fanout)[:-1]):
            node = lambda j: own[j - first] if first <= j < first + len(own) else around[level, j]  # noqa: B023, E731
            sides = []
            for parent in range(lo // fanout, hi // fanout + 1):
                family = range(parent * fanout, min((parent + 1) * fanout, size))
                for j in family:
                    if lo <= j <= hi:
                        sides.append((b"".join(node(x) for x in family if x < j), b"".join(node(x) for x in family if x > j)))
            self.sides.append((lo, sides))
            # parents all of whose children are here
            above = -(-first // fanout)
            end = first + len(own)
            last = -(-end // fanout) if end == size else end // fanout
            own = [hash_of(*own[p * fanout - first : (p + 1) * fanout - first]) for p in range(above, last)]
            first, lo, hi = above, lo // fanout, hi // fanout

    def path(self, k: int) -> list[tuple[bytes, bytes]]:
        """Siblings to the left and to the right of the k-th leaf's way, level by level."""
        j, found = self.start + k, []
        for lo, sides in self.sides:
            found.append(sides[j - lo])
            j //= self.fanout
        return found


def wanted_outside(start: int, m: int, n: int, fanout: int) -> Iterator[tuple[int, int]]:
    """(level, j) of the nodes that ``Run`` takes from outside a run of m leaves."""
    lo, hi, width = start, start + m - 1, 1
    for level, size in enumerate(level_sizes(n, fanout)[:-1]):
        for parent in sorted({lo // fanout, hi // fanout}):
            for j in range(parent * fanout, min((parent + 1) * fanout, size)):
                if j * width < start or min((j + 1) * width, n) > start + m:
                    yield level, j
        lo, hi, width = lo // fanout, hi // fanout, width * fanout


def _joined(f: Forest, upper: DataFrame | None) -> DataFrame:
    """Rows of every partition in order: for each run its head, the nodes around it, its leaves."""
    fanout = f.fanout

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((pid, grp, level, j) for b in batches for pid, grp, start, m, n in _columns(b) if m < n for level, j in wanted_outside(start, m, n, fanout))
        yield from _out(rows, pa.schema([("pid", pa.int32()), ("of", pa.string()), ("at", pa.int32()), ("place", pa.int64())]))

    asked = f.runs.select("pid", "grp", "start", "m", "n").mapInArrow(ask, "pid int, of string, at int, place long")
    outside = f.outside()
    around = asked.join(outside, F.col("of").eqNullSafe(F.col("grp")) & (F.col("at") == F.col("level")) & (F.col("place") == F.col("j")))
    roots = f.roots().select(F.col("grp").alias("of"), F.col("root").alias("subroot"))
    none = F.lit(None)
    if upper is None:
        ends = roots.select("of", "subroot", F.col("subroot").alias("root"), F.array().cast("array<string>").alias("left"), F.array().cast("array<string>").alias("right"))
    else:
        ends = roots.join(upper, F.col("of").eqNullSafe(F.col("id"))).select("of", "subroot", "root", "left", "right")
    heads = f.runs.join(ends, F.col("of").eqNullSafe(F.col("grp")))
    kind = dict(f.leaves.dtypes)["id"]
    shape = [("pid", "int"), ("grp", "string"), ("pos", "long"), ("a", "long"), ("b", "long"), ("digest", "string"), ("other", "string"), ("id", kind), ("subroot", "string"), ("left", "array<string>"), ("right", "array<string>")]

    def shaped(df: DataFrame, **given: Column) -> DataFrame:
        return df.select(*(given.get(c, none).cast(t).alias(c) for c, t in shape))

    col = F.col
    return (
        shaped(heads, pid=col("pid"), grp=col("grp"), pos=F.lit(-2), a=col("start"), b=col("n"), digest=col("root"), subroot=col("subroot"), left=col("left"), right=col("right"))
        .unionByName(shaped(around, pid=col("pid"), grp=col("of"), pos=F.lit(-1), a=col("level"), b=col("j"), digest=col("digest")))
        .unionByName(shaped(f.leaves, pid=col("pid"), grp=col("grp"), pos=col("pos"), digest=col("leaf"), other=col("other"), id=col("id")))
    )


def _runs_of(batches: Iterator[pa.RecordBatch], fanout: int) -> Iterator[tuple[tuple, Run, list[tuple]]]:
    """Head, nodes and leaf rows of every run of a partition of ``_joined``."""
    head, around, leaves = None, {}, []

    def run() -> tuple:
        return head, Run([r[5].encode() for r in leaves], head[3], head[4], fanout, around), leaves

    for batch in batches:
        for row in _columns(batch):
            if row[2] == -2:
                if head is not None:
                    yield run()
                head, around, leaves = row, {}, []
            elif row[2] == -1:
                around[row[3], row[4]] = row[5].encode()
            else:
                leaves.append(row)
    if head is not None:
        yield run()


def _in_order(f: Forest, upper: DataFrame | None) -> DataFrame:
    return _joined(f, upper).repartition(f.parts, "pid").sortWithinPartitions("pid", "grp", "pos", "a", "b")


def group_paths(f: Forest) -> DataFrame:
    """``id``, ``root`` and the siblings on every leaf's way, ``left`` and ``right`` by level."""
    fanout = f.fanout
    kind = dict(f.leaves.dtypes)["id"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for head, run, leaves in _runs_of(batches, fanout):
                for k, leaf in enumerate(leaves):
                    path = run.path(k)
                    yield leaf[7], head[5], [a.decode() for a, _ in path], [b.decode() for _, b in path]

        strings = pa.list_(pa.string())
        yield from _out(rows(), pa.schema([("id", pa.string()), ("root", pa.string()), ("left", strings), ("right", strings)]))

    if kind != "string":
        raise TypeError("ids of groups are strings")
    return _in_order(f, None).mapInArrow(walk, "id string, root string, left array<string>, right array<string>")


def proofs(f: Forest, upper: DataFrame) -> DataFrame:
    """``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified`` of every leaf.

    ``folded_root`` goes up from ``other`` where it isn't null, else from the leaf.
    """
    fanout = f.fanout

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        id_type = first.schema.field("id").type

        def every() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        def rows() -> Iterator[tuple]:
            sha = hashlib.sha256
            for head, run, leaves in _runs_of(every(), fanout):
                root, subroot = head[5], head[8]
                above = [(a.encode(), b.encode()) for a, b in zip(head[9], head[10], strict=True)]
                for k, leaf in enumerate(leaves):
                    path, node = run.path(k) + above, (leaf[6] or leaf[5]).encode()
                    for a, b in path:
                        node = sha(a + node + b).hexdigest().encode()
                    folded = node.decode()
                    yield leaf[7], leaf[5], subroot, root, sha(b"".join(x for pair in path for x in pair)).hexdigest(), folded, folded == root

        strings = [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
        yield from _out(rows(), pa.schema([("id", id_type), *strings, ("verified", pa.bool_())]))

    strings = ", ".join(f"{c} string" for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))
    return _in_order(f, upper).mapInArrow(walk, f"id {dict(f.leaves.dtypes)['id']}, {strings}, verified boolean")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame) -> DataFrame:
    """``grp`` (the language), ``id``, ``leaf`` and ``other``: the leaf of a row tampered with, for every seventh by hash."""
    cols = {c: docs[c] for c in FIELDS}
    more = cols | {"n_chars": F.try_add(cols["n_chars"], F.lit(1))}
    picked = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    other = F.when(picked, row_digest(*more.values()))
    return docs.select(docs["lang"].cast("string").alias("grp"), docs["doc_id"].alias("id"), row_digest(*cols.values()).alias("leaf"), other.alias("other"))


def dataset_forests(leaves: DataFrame, fanout: int = FANOUT, run_rows: int = RUN_ROWS, merge_rows: int = MERGE_ROWS) -> tuple[Forest, Forest]:
    """The trees of the groups of ``leaves``, and the one tree of their roots."""
    own = forest(cut_table(leaves), fanout, run_rows, merge_rows)
    roots = own.roots().select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("other"))
    return own, forest(cut_table(roots), fanout, run_rows, merge_rows)


def manifest(docs: DataFrame, fanout: int = FANOUT, run_rows: int = RUN_ROWS, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """Node records of the whole dataset: ``of`` (``group`` or ``dataset``), ``grp``, ``level``, ``j``, ``digest``.

    Level 0 of ``group`` are the leaves. docs as in ``verify``.
    """
    own, top = dataset_forests(document_leaves(docs), fanout, run_rows, merge_rows)
    runs = own.runs.select(F.col("pid").alias("in"), F.col("grp").alias("run_of"), (F.col("start") - F.col("first")).alias("shift"))
    placed = own.leaves.join(runs, (F.col("pid") == F.col("in")) & F.col("grp").eqNullSafe(F.col("run_of")))
    low = placed.select(F.lit("group").alias("of"), "grp", F.lit(0).alias("level"), (F.col("pos") + F.col("shift")).alias("j"), F.col("leaf").alias("digest"))
    inner = own.nodes().select(F.lit("group").alias("of"), "grp", "level", "j", "digest")
    upper = top.nodes().select(F.lit("dataset").alias("of"), "grp", "level", "j", "digest")
    return low.unionByName(inner).unionByName(upper)


def verify(docs: DataFrame, fanout: int = FANOUT, run_rows: int = RUN_ROWS, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified`` of every row.

    docs: ``doc_id``, ``source``, ``lang``, ``n_chars``, ``text``; other columns, whatever
    their names, are not read. Null values are leaves' fields like any other; null
    languages are a group, the first; null ids come first in their group and are never
    tampered with. Rows that share language and id go by their leaves, and rows equal in
    all five fields are leaves of their own. An empty table gives an empty one.
    """
    own, top = dataset_forests(document_leaves(docs), fanout, run_rows, merge_rows)
    found = proofs(own, cut_table(group_paths(top)))
    return found.withColumnRenamed("id", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, head, text_field,
    sha256(head || chars || text_field) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND is_picked THEN sha256(head || more || text_field) ELSE sha256(head || chars || text_field) END AS used
  FROM (
    SELECT doc_id, lang,
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
      coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS chars, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS more,
      coalesce(strlen(text) || ':' || text, '-') AS text_field, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, unused: xor(x >> 1, 3988292384 * (x & 1)))
      )) % 7 = 0 AS is_picked
    FROM documents
  )
), tree AS (
  SELECT lang, 0 AS level, i AS j, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, j // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY j)) FROM tree WHERE n > 1 GROUP BY lang, level, j // 2, n
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, i AS j, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, j // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY j)) FROM top WHERE n > 1 GROUP BY level, j // 2, n
), ways AS (
  SELECT l.lang, l.i, t.level, max(CASE WHEN t.j < (l.i >> t.level) THEN t.h END) AS a, max(CASE WHEN t.j > (l.i >> t.level) THEN t.h END) AS b
  FROM leaves l JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.n > 1 AND t.j // 2 = (l.i >> (t.level + 1)) GROUP BY ALL
  UNION ALL
  SELECT l.lang, l.i, 100 + t.level, max(CASE WHEN t.j < (s.i >> t.level) THEN t.h END), max(CASE WHEN t.j > (s.i >> t.level) THEN t.h END)
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN top t ON t.n > 1 AND t.j // 2 = (s.i >> (t.level + 1)) GROUP BY ALL
), steps AS (
  SELECT lang, i, coalesce(a, '') AS a, coalesce(b, '') AS b, row_number() OVER (PARTITION BY lang, i ORDER BY level) AS step FROM ways
), fold AS (
  SELECT lang, i, used AS h, 1 AS step FROM leaves
  UNION ALL
  SELECT f.lang, f.i, sha256(s.a || f.h || s.b), f.step + 1 FROM fold f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.i = f.i AND s.step = f.step
)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(coalesce(p.together, '')) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT h FROM top WHERE n = 1) r
LEFT JOIN (SELECT lang, i, string_agg(a || b, '' ORDER BY step) AS together FROM steps GROUP BY lang, i) p ON p.lang IS NOT DISTINCT FROM l.lang AND p.i = l.i
JOIN (SELECT lang, i, arg_max(h, step) AS h FROM fold GROUP BY lang, i) e ON e.lang IS NOT DISTINCT FROM l.lang AND e.i = l.i
"""
