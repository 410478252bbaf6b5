"""Line de-duplication with overlapping windows of three lines.

A document's lines are the pieces between newlines. Every three consecutive lines are a
window, compared without spaces at the lines' ends; a window without any other
character does not count. A window that starts earlier (a smaller doc_id, or a smaller
line of the same document) makes a later equal one a repeat. All lines that a repeat
covers are removed, so a repeated passage of three or more lines goes everywhere but at
its first place, and single common lines stay.

A document looks for its own repeats in its row. What is left are windows of 128 bits of
hash, each once a row, whose first documents are a ``min`` with map-side partials, so a
window that a third of all documents hold is one row for each task. The repeated ones
are written before the windows are joined with them: a join of two plain scans whose
result is dealt anew by document is one that adaptive execution splits at a hot window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.llm.common import cut_table, sha256_of, table

WINDOW = 3


def window_hashes(text: Column, n: int) -> Column:
    """array<struct<h1, h2, line>> of a text's windows, by hash and then by line (from 0)."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.trim(line))
    none = F.expr("cast(array() as array<string>)")
    at = lambda x: F.sequence(F.lit(0), F.size(x) - n)
    joined = lambda x: F.transform(at(x), lambda i: F.array_join(F.slice(x, i + 1, n), "\n"))
    strings = F.get(F.transform(F.array(lines), lambda x: F.when(F.size(x) >= n, joined(x)).otherwise(none)), 0)
    hashed = F.transform(strings, lambda w, i: F.struct(F.xxhash64(w).alias("h1"), F.xxhash64(F.lit(n), w).alias("h2"), i.alias("line"), w.alias("w")))
    some = F.filter(hashed, lambda x: F.length(F.translate(x.w, "\n", "")) > 0)
    return F.array_sort(F.transform(some, lambda x: F.struct(x.h1.alias("h1"), x.h2.alias("h2"), x.line.alias("line"))))


def _text_hash(text: Column) -> Column:
    """Tells rows that share an id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def windows(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """``doc_id``, ``row`` (the text's hash), ``line``, ``h1``, ``h2`` of every window, and ``again``:
    whether it occurs earlier in the same row."""
    own = docs.select("doc_id", _text_hash(F.col("text")).alias("row"), window_hashes(F.col("text"), n).alias("w"))

    def with_again(w: Column, k: Column) -> Column:
        before = F.get("w", k - 1)
        again = F.coalesce((w.h1 == before.h1) & (w.h2 == before.h2), F.lit(False))
        return F.struct(w.line.alias("line"), w.h1.alias("h1"), w.h2.alias("h2"), again.alias("again"))

    return own.select("doc_id", "row", F.inline(F.transform("w", with_again)))


def repeats(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """``doc_id``, ``row`` and ``starts``: the lines at which windows begin that occur earlier."""
    every = cut_table(windows(docs.where("doc_id is not null"), n))
    own = every.where("not again").drop("again")
    firsts = cut_table(own.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = own.join(firsts, ["h1", "h2"]).where("doc_id > first_doc")
    starts = later.select("doc_id", "row", "line").unionByName(every.where("again").select("doc_id", "row", "line"))
    return starts.groupBy("doc_id", "row").agg(F.collect_set("line").alias("starts"))


def _covered(starts: Column, n: int) -> Column:
    return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + n - 1))))


def _with_lines(docs: DataFrame, n: int) -> tuple[DataFrame, list[Column]]:
    """docs' columns under other names, with ``lines``, ``gone`` and ``kept``; and how to get docs' columns from it."""
    own = [f"doc_{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, own, strict=True))
    found = repeats(docs.select("doc_id", "text"), n).withColumnsRenamed({"doc_id": "id", "row": "id_row"})
    doc_id, text = F.col(of["doc_id"]), F.col(of["text"])
    marked = docs.toDF(*own).withColumn("row", _text_hash(text))
    joined = marked.join(found, (doc_id == F.col("id")) & (F.col("row") == F.col("id_row")), "left")
    joined = joined.withColumn("lines", F.split(text, "\n")).withColumn("gone", _covered(F.col("starts"), n))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    text = F.when(F.col("gone").isNull(), text).otherwise(kept)
    return joined, [(text if c == "text" else F.col(of[c])).alias(c) for c in docs.columns]


def deduplicate(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs with repeated lines removed from ``text``; all other columns as they are.

    Columns of any name may stand beside ``doc_id`` and ``text``. A null text stays
    null, and texts of fewer than ``n`` lines never change. Rows with a null ``doc_id``
    have no place in the order and stay as they are. Rows that share an id have one place:
    they lose nothing for each other, and each loses its own lines only, so equal rows
    stay equal. An empty table gives an empty one.
    """
    joined, columns = _with_lines(docs, n)
    return joined.select(*columns)


def report(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """``doc_id``, ``text`` (what stays), ``n_lines``, ``n_removed`` of every row of docs.

    A null text has no lines, an empty one has one; all else is as in ``deduplicate``.
    """
    joined, columns = _with_lines(docs.select("doc_id", "text"), n)
    return joined.select(
        *columns,
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = report(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", sha256_of(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents
), windows AS (
  SELECT doc_id, i, trim(line, ' ') AS a, lead(trim(line, ' '), 1) OVER w AS b, lead(trim(line, ' '), 2) OVER w AS c
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS rn
  FROM windows WHERE c IS NOT NULL AND a || b || c <> ''
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM ranked, (VALUES (0), (1), (2)) AS t(k) WHERE rn > 1
)
SELECT d.doc_id, (CASE WHEN d.text IS NULL THEN 0 ELSE count(l.i) END)::BIGINT AS n_lines, count(g.i)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
FROM documents d JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
GROUP BY d.doc_id, d.text
"""
