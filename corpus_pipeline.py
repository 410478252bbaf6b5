"""From raw documents to token ids: five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its
result is written and read again as the next one's docs. All stages but the last return
the columns of ``documents`` (and any others that docs has, whatever their names);
``n_chars`` follows the text. An empty table gives an empty one in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.llm import decontamination, line_dedup, quality, sentencepiece_bpe, simhash
from stavework.llm.common import collected_tables, cut_table, drop_tables, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts are scored like any other, as texts without characters; every
    row is judged by its own text, whatever its id, and equal rows go or stay together.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of three-line windows that occur earlier.

    No row goes. A null text stays null with 0 characters; rows without an id stay as they
    are, and rows that share one lose nothing for each other.
    """
    done = line_dedup.deduplicate(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return done.select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Texts without words, null ones among them, are one group. Of rows that share the
    smallest id all stay, as do rows without an id.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than a twentieth.

    Every row is judged by its own text; null and empty texts stay.
    """
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids`` (closed by the end id), ``n_tokens``, for every row.

    A null or empty text has the end id only.
    """
    return sentencepiece_bpe.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", keep_good),
    ("lines", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("tokens", to_tokens),
]

#: SQL can't express the trained classifier, the fingerprints or the tokenizer; the
#: stages are tested against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of sf_dir; tables of earlier stages are deleted once the next is written."""
    docs, made = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with collected_tables() as written:
            docs = cut_table(stage(spark, docs, sf_dir))
        drop_tables(spark, [*made, *written[:-1]])
        made = written[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
