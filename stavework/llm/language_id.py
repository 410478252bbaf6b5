"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (one to three characters, lower-cased, runs of
other ASCII characters seen as spaces), weighted by log tf and idf and scaled to length
one. Document frequencies are counted over all training documents. The weights are
trained with follow-the-regularised-leader (elastic-net penalty) on a bounded sample of
each language, part of which is set aside to calibrate the softmax temperature. All
n-grams of a sampled document count; they take 6 bytes for each of its buckets, so the
driver's share is bounded by the number of sampled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stavework.llm.common import cut_table, held_out, table, text_chunks, texts_of

UNKNOWN = "und"
BUCKETS = 1 << 15
#: Bound of the sample that the weights are fitted on, in documents: every language has an
#: equal part of it, and LEAST_DOCS at least.
SAMPLE_DOCS = 3_200
LEAST_DOCS = 20
#: With more languages than this there is an error and no model, unless ``train`` is given
#: another number. Each takes 16 bytes a bucket while training, 4 in the model.
MOST_LANGUAGES = 1_000
#: One of so many sampled documents sets the temperature instead.
CALIBRATION = 5
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-4

_ASCII = np.array([c if chr(c).isalpha() else 0x20 for c in range(128)], dtype=np.uint32)
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def has_letter(text: str) -> bool:
    """Whether any character is a letter (Unicode category L)."""
    return any(map(str.isalpha, text))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the text's hashed n-grams in order, and how often each occurs."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32)
    points = np.where(points < 128, _ASCII[points & 127], points)
    grams, key = [], np.zeros(len(points), dtype=np.uint32)
    for n in range(3):
        if len(points) <= n:
            break
        key = (key[: len(points) - n] ^ (points[n:] * _MIX[n])) * np.uint32(0x27D4EB2F)
        grams.append((key ^ (key >> np.uint32(15))) & np.uint32(BUCKETS - 1))
    every = np.concatenate(grams)
    if len(every) < BUCKETS:
        at, counts = np.unique(every, return_counts=True)
        return at.astype(np.int32), counts
    counts = np.bincount(every, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language, times idf
    idf: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        at, counts = ngram_counts(text)
        tf = np.log1p(counts).astype(np.float32)
        norm = float(np.linalg.norm(tf * self.idf[at])) or 1.0
        return softmax((tf @ self.weights[at] / norm + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of docs each bucket occurs, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in text_chunks(batches):
            for text in texts_of(batch):
                total[ngram_counts(text.decode())[0]] += 1
                n += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[found, -1].astype(np.int32)), pa.array(np.r_[total[found], n])], names=["bucket", "n"])

    counts = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for r in counts.collect():  # at most BUCKETS + 1 rows
        if r.bucket < 0:
            n = r.n
        else:
            out[r.bucket] = r.n
    return out, n


def key_of_row() -> Column:
    return F.xxhash64("doc_id", "text").alias("key")


def sample(docs: DataFrame, keys: DataFrame, size: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, counts) of at most ``size`` documents of each language.

    They are those whose ids and texts hash lowest; equal rows are one. keys: ``lang`` and
    ``key`` of every row of docs.
    """
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))  # limited before the shuffle too
    last = keys.withColumn("rank", rank).where(F.col("rank") <= size).groupBy("lang").agg(F.max("key").alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            at, counts = [], []
            for text in texts_of(batch):
                own, n = ngram_counts(text.decode())
                at.append(own.astype(np.uint16).tobytes())
                counts.append(n.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(counts, pa.binary())], names=["key", "lang", "at", "n"])

    numbered = docs.select("lang", key_of_row(), "text")
    some = numbered.join(F.broadcast(last), "lang").where(F.col("key") <= F.col("last")).select("key", "lang", "text").dropDuplicates(["key", "lang"])
    rows = some.mapInArrow(run, "key long, lang string, at binary, n binary").orderBy("key", "lang").collect()
    return [(r.lang, np.frombuffer(bytes(r["at"]), np.uint16).astype(np.int32), np.frombuffer(bytes(r["n"]), np.int32)) for r in rows]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """A model of ``text`` and ``lang``; rows without a language or a letter don't count.

    None without any such row. Every language of the other rows is learnt, from its part
    of ``sample_docs``; more than ``most_languages`` are an error. Deterministic:
    documents are taken by a hash of id and text. Texts are read three times: for their
    hashes, which are written with the languages, for the frequencies, and for the sample.
    """
    learn = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keys = cut_table(learn.select("lang", key_of_row()))
    known = keys.select("lang").distinct().limit(most_languages + 1).count()
    if known > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    rows = sample(learn, keys, max(sample_docs // max(known, 1), LEAST_DOCS))
    if not rows:
        return None
    frequency, n = document_frequencies(learn)
    idf = (np.log((1 + n) / (1 + frequency)) + 1).astype(np.float32)
    languages = sorted({lang for lang, _, _ in rows})
    number = {lang: k for k, lang in enumerate(languages)}
    vectors = []
    for lang, at, count in rows:
        x = np.log1p(count).astype(np.float32) * idf[at]
        vectors.append((number[lang], at, x / (np.linalg.norm(x) or 1.0)))
    fit = [v for i, v in enumerate(vectors) if i % CALIBRATION] or vectors
    weights, bias = follow_the_leader(fit, len(languages))
    check = [v for i, v in enumerate(vectors) if i % CALIBRATION == 0]
    scores = np.array([x @ weights[at] + bias for _, at, x in check])
    temperature = calibrate(scores, np.array([y for y, _, _ in check]))
    return Model(languages, weights * idf[:, None], idf, bias, temperature)


def follow_the_leader(vectors: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with L1 and L2; the last row of the state is the bias, without L1."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def solved(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == BUCKETS, 0.0, L1)[:, None]
        return np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for y, at, x in vectors:
            at, x = np.r_[at, BUCKETS], np.r_[x, 1.0]
            w = solved(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = solved(np.arange(BUCKETS + 1)).astype(np.float32)
    return w[:-1], w[-1]


def calibrate(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of the least log loss, over a geometric grid."""
    grid = np.geomspace(0.02, 5.0, 80)
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (the language's calibrated probability).

    A text that is null, empty or without any letter gets ``und`` and 0, as every text
    does without a model. Repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_chunks(batches):
            names, scores = [], []
            for raw in texts_of(batch):
                text = raw.decode()
                if own is None or not has_letter(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = own.probabilities(text)
                best = int(np.argmax(p))
                names.append(own.languages[best])
                scores.append(min(1.0, float(p[best])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
