"""Tolerant readers, listings and table sinks over any file system that Spark can reach."""

from __future__ import annotations

import fnmatch
import json
import tempfile
import uuid
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stavework.functions import names
from stavework.operators.manifest import prefix_remapped
from stavework.sources.tables import MISSING, read_csv, with_columns, write_csv

#: Settings and reports pass the driver; larger ones are an error.
LARGEST_DOCUMENT = 4 << 20
LARGEST_REPORT = 10_000
TRACK_MAP = T.StructType([
    T.StructField("song_id", T.StringType()), T.StructField("track", T.IntegerType()), T.StructField("original_track", T.IntegerType()),
    T.StructField("program", T.IntegerType()), T.StructField("is_drum", T.BooleanType()), T.StructField("name", T.StringType()),
])


def _at(spark: SparkSession, path: str):
    """The file system and path object of a path."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    files, there = _at(spark, path)
    return files.exists(there)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first of some paths that exists, else the first."""
    return next((p for p in paths if exists(spark, p)), paths[0])


def scratch(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``, which all executors share; a session on this machine alone has a temporary one without it."""
    root = spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="stavework-scratch-")
    return f"{root}/{uuid.uuid4().hex}"


# ---- readers


def header(spark: SparkSession, path: str) -> list[str]:
    """The columns of a delimited file by its first line."""
    return spark.read.option("header", True).csv(path).columns


def read_csv_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A delimited file, or no rows where there is none or one of no bytes. Columns that the file lacks are null."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    own = set(header(spark, path))
    held = T.StructType([f for f in schema if f.name in own])
    if not len(held):
        return spark.createDataFrame([], schema)
    raw = spark.read.option("header", True).option("nullValue", MISSING).csv(path).select(*(f"`{f.name}`" for f in held))
    cell = lambda f: F.when(~F.lower(F.trim(F.col(f"`{f.name}`"))).isin("", "nan"), F.col(f"`{f.name}`"))
    return with_columns(raw.select(*(cell(f).try_cast(f.dataType).alias(f.name) for f in held)), schema)


def read_csv_except(spark: SparkSession, path: str, without: Sequence[str], flag: str | None = None) -> DataFrame:
    """All columns of a delimited file as text but some; only rows whose flag is true, without the flag, if one is named."""
    rows = spark.read.option("header", True).option("nullValue", MISSING).csv(path)
    if flag is not None:
        if flag not in rows.columns:
            raise ValueError(f"no column {flag!r}")
        rows = rows.where(F.coalesce(F.col(f"`{flag}`").try_cast("boolean"), F.lit(False)))
    return rows.select(*(f"`{c}`" for c in rows.columns if c not in {*without, flag}))


def read_track_map(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The track map of the first path that exists, of any of its versions.

    The song is ``song_id``, or else made of ``path``, or else of ``mid``. Rows without a
    track go; a missing program is 0, a missing drum flag false.
    """
    path = first_existing(spark, paths)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    own = header(spark, path)
    key = next((c for c in ("song_id", "path", "mid") if c in own), None)
    if key is None:
        raise ValueError(f"{path}: none of song_id, path, mid")
    schema = T.StructType([T.StructField(key, T.StringType()), *(f for f in TRACK_MAP if f.name != "song_id")])
    rows = read_csv_or_empty(spark, path, schema)
    song = F.col(key) if key == "song_id" else names.path_id(F.col(key))
    return rows.where("track is not null").select(
        song.alias("song_id"), "track", "original_track", F.coalesce("program", F.lit(0)).alias("program"), F.coalesce("is_drum", F.lit(False)).alias("is_drum"), "name"
    )


def settings(spark: SparkSession, path: str) -> object:
    """A settings document (JSON, or YAML where a parser is installed) of bounded size."""
    files, there = _at(spark, path)
    if files.getFileStatus(there).getLen() > LARGEST_DOCUMENT:
        raise ValueError(f"{path}: over {LARGEST_DOCUMENT} bytes")
    text = spark.read.text(path, wholetext=True).first()
    text = text.value if text else ""
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text) if text.strip() else None


def settings_table(spark: SparkSession, entries: object, schema: T.StructType, key: str = "name") -> DataFrame:
    """A list of entries, or a mapping of names to entries, as rows in order (``position``).

    A mapping's name goes to the key's column; an entry that is no mapping fills the
    schema's first other column. Unknown fields are an error.
    """
    fields, rows = [f.name for f in schema], []
    pairs = entries.items() if isinstance(entries, dict) else ((None, e) for e in entries or ())
    for position, (name, entry) in enumerate(pairs):
        row = dict(entry) if isinstance(entry, dict) else {next(f for f in fields if f != key or name is None): entry}
        if name is not None:
            row[key] = name
        if unknown := set(row) - set(fields):
            raise ValueError(f"entry {position}: unknown fields {sorted(unknown)}")
        rows.append((position, *(row.get(f) for f in fields)))
    return spark.createDataFrame(rows, T.StructType([T.StructField("position", T.IntegerType()), *schema]))


# ---- listings


def listing(spark: SparkSession, folder: str, pattern: str, without: str = "*in_progress*") -> DataFrame:
    """``name``, ``path``, ``size``, ``modified`` of a folder's files that fit a pattern, the last name first."""
    schema = "name string, path string, size long, modified timestamp"
    files, there = _at(spark, folder)
    if not files.exists(there):
        return spark.createDataFrame([], schema)
    found = [(s.getPath().getName(), s.getPath().toString(), s.getLen(), datetime.fromtimestamp(s.getModificationTime() / 1000)) for s in files.listStatus(there) if s.isFile()]
    kept = [f for f in found if fnmatch.fnmatchcase(f[0], pattern) and not fnmatch.fnmatchcase(f[0], without)]
    return spark.createDataFrame(kept, schema).orderBy(F.desc("name"))


def file_in(spark: SparkSession, folder: str, name: str) -> str | None:
    """The path of a file by its plain name; null for names with folders in them, hidden ones and files that aren't there."""
    if not name or "/" in name or "\\" in name or name.startswith("."):
        return None
    files, there = _at(spark, f"{folder}/{name}")
    return f"{folder}/{name}" if files.exists(there) and files.getFileStatus(there).isFile() else None


def document_paths(spark: SparkSession, paths: Sequence[str], pattern: str = "responses_*.json") -> list[str]:
    """Files and the fitting files of folders, by name, each once and in order; unfinished ones are left out."""
    found = []
    for path in paths:
        files, there = _at(spark, path)
        if files.exists(there) and files.getFileStatus(there).isDirectory():
            found += sorted(s.getPath().toString() for s in files.listStatus(there) if s.isFile() and fnmatch.fnmatchcase(s.getPath().getName(), pattern))
        else:
            found.append(there.makeQualified(files.getUri(), files.getWorkingDirectory()).toString())
    return [p for p in dict.fromkeys(found) if "in_progress" not in p.rsplit("/", 1)[-1]]


def newest_folder(spark: SparkSession, root: str, manifest: str) -> str:
    """The root if it has the manifest, else the folder in it with one that was changed last, else the root."""
    if exists(spark, f"{root}/{manifest}"):
        return root
    files, there = _at(spark, root)
    inner = [s for s in files.listStatus(there) if s.isDirectory()] if files.exists(there) else []
    found = [(s.getModificationTime(), s.getPath().getName()) for s in inner if exists(spark, f"{root}/{s.getPath().getName()}/{manifest}")]
    return f"{root}/{max(found)[1]}" if found else root


def is_current(spark: SparkSession, cache: str, sources: Sequence[str], columns: Sequence[str] = (), unused: Sequence[str] = ()) -> bool:
    """Whether a written delimited table may be used again.

    It must exist, be no older than any source that exists and have the columns; the sums
    of ``unused`` columns (work of engines that are no longer in use) must be 0 where it has them.
    """
    if not exists(spark, cache):
        return False
    time = lambda p: _at(spark, p)[0].getFileStatus(_at(spark, p)[1]).getModificationTime()
    if any(exists(spark, s) and time(cache) < time(s) for s in sources):
        return False
    own = header(spark, cache)
    if not set(columns) <= set(own):
        return False
    counted = [c for c in unused if c in own]
    if not counted:
        return True
    sums = spark.read.option("header", True).csv(cache).agg(*(F.sum(F.col(f"`{c}`").try_cast("double")).alias(c) for c in counted)).first()
    return not any((v or 0) > 0 for v in sums)


# ---- sinks


def append_rows(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Add rows to a delimited table without reading it: the schema's columns, others are left out, absent ones missing."""
    with_columns(df, schema).write.mode("append").option("header", True).option("nullValue", MISSING).option("emptyValue", "").csv(path)


def copy_tables(spark: SparkSession, source: str, target: str, tables: dict[str, T.StructType], columns: Sequence[str] = ("path",)) -> list[str]:
    """Copy delimited tables that exist; paths in some columns move from the source to the target. Returns the copied names."""
    done = []
    for name, schema in tables.items():
        if exists(spark, f"{source}/{name}"):
            rows = read_csv(spark, f"{source}/{name}", schema)
            moved = {c: prefix_remapped(F.col(c), source, target) for c in columns if c in rows.columns}
            write_csv(rows.withColumns(moved), f"{target}/{name}")
            done.append(name)
    return done


def drop_derived(spark: SparkSession, folder: str, derived: Sequence[str]) -> list[str]:
    """Delete merged tables of a folder by name, never shards. Returns what was deleted."""
    gone = []
    for name in derived:
        if "/" in name or name.startswith("."):
            raise ValueError(f"not a table's name: {name!r}")
        files, there = _at(spark, f"{folder}/{name}")
        if files.exists(there) and files.delete(there, True):
            gone.append(name)
    return gone


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as nulls, at any depth of structs, arrays and maps."""
    return df.select(*(_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def _safe(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda v: _safe(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _safe(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_safe(c.getField(f.name), f.dataType).alias(f.name) for f in kind)))
    return c


def write_text(spark: SparkSession, path: str, text: str) -> None:
    files, there = _at(spark, path)
    out = files.create(there, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_document(spark: SparkSession, path: str, document: dict, now: datetime | None = None) -> dict:
    """A document as JSON (which YAML readers take too) with ``generated_at``; returns what was written."""
    stamped = {"generated_at": (now or datetime.now(UTC)).isoformat(timespec="seconds"), **document}
    write_text(spark, path, json.dumps(stamped, indent=2, ensure_ascii=False) + "\n")
    return stamped


def small_rows(df: DataFrame) -> list:
    """Rows of a report; more than a report may have are an error."""
    rows = df.limit(LARGEST_REPORT + 1).collect()
    if len(rows) > LARGEST_REPORT:
        raise ValueError(f"over {LARGEST_REPORT} rows")
    return rows


def markdown(df: DataFrame) -> str:
    """A small table as Markdown, nulls as dashes."""
    cell = lambda v: "-" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in small_rows(df))]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def write_report(spark: SparkSession, folder: str, name: str, summary: DataFrame, tables: dict[str, DataFrame]) -> None:
    """``name.json`` (the one-row summary), ``name.md`` (its lines and the small tables) and each table as delimited files."""
    safe = json_safe(summary)
    totals = json.loads(safe.select(F.to_json(F.struct(*safe.columns), {"ignoreNullFields": "false"})).first()[0])
    write_text(spark, f"{folder}/{name}.json", json.dumps(totals, indent=2, ensure_ascii=False) + "\n")
    parts = ["\n".join(f"- {k}: {v}" for k, v in totals.items()), *(f"## {title}\n\n{markdown(rows)}" for title, rows in tables.items())]
    write_text(spark, f"{folder}/{name}.md", "\n\n".join([f"# {name}", *parts]) + "\n")
    for title, rows in tables.items():
        write_csv(rows, f"{folder}/{title}")
