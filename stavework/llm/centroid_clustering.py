"""Lloyd's clustering in whole numbers, with an annulus search for the nearest centroid.

Centroids are sorted by norm. A vector's distance to the centroids beside its own norm
is an upper bound u of its least distance; since a centroid's norm differs from the
vector's by no more than their distance, only those with norms in [norm - u, norm + u]
can be as near, and two binary searches find them. These are compared exactly, in 64-bit
whole numbers, and the least (distance, number) wins. Norms and bounds are rounded
outward, so a candidate on the edge is compared too.

A round is one scan. Each task keeps a sum and a count for each centroid, so what is
shuffled has one row for each centroid and task, whatever the clusters' sizes; the
driver holds the centroids only, ``k`` vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.llm.common import cut_table, table

COMPONENTS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
#: Components must be smaller than this, so that squared distances are exact in 64 bits.
LIMIT = 1 << 19
#: Vectors that one numpy step works on.
STEP = 4096


def kept(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id`` and ``embedding`` of vectors that can be clustered."""
    v = F.col("embedding")
    # NaN is greater than any other number in Spark, so the bound excludes it as it does the infinities
    sound = F.forall(v, lambda x: F.coalesce(F.abs(x) < LIMIT, F.lit(False)))
    return vectors.select("vec_id", "embedding").where((F.size(v) == components) & sound)


def whole(batch: pa.RecordBatch, components: int = COMPONENTS, scale: int = SCALE) -> np.ndarray:
    """The vectors of a batch as rows of whole numbers."""
    flat = batch.column(batch.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.astype(np.float64) * scale).astype(np.int64).reshape(-1, components)


@dataclass
class Ring:
    """Centroids in the order of their norms."""

    centroids: np.ndarray

    def __post_init__(self):
        norms = np.sqrt((self.centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def candidates(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the first and the end place, by norm, of centroids that can be nearest."""
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        above = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        below = np.maximum(above - 1, 0)
        bound = np.sqrt(np.minimum(*(self._distances(vectors, self.order[p]) for p in (below, above))).astype(np.float64))
        slack = 1e-9 * (1 + norms + bound)
        return np.searchsorted(self.norms, norms - bound - slack), np.searchsorted(self.norms, norms + bound + slack, side="right")

    def _distances(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return ((vectors - self.centroids[numbers]) ** 2).sum(axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid; of equally near ones the smallest."""
        first, end = self.candidates(vectors)
        best = np.full(len(vectors), np.iinfo(np.int64).max)
        number = np.full(len(vectors), len(self.order))
        for place in range(int(first.min(initial=0)), int(end.max(initial=0))):
            rows, c = np.flatnonzero((first <= place) & (place < end)), self.order[place]
            d = self._distances(vectors[rows], c)
            better = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
            best[rows[better]], number[rows[better]] = d[better], c
        return number, best


def assigned(vectors: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance`` of every vector of ``kept``."""
    ring, components = Ring(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                number, distance = ring.nearest(whole(part, components, scale))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, cluster int, distance long")


def moved(vectors: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The centroids after one round; one without vectors stays."""
    ring, (k, components) = Ring(centroids), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, components), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                rows = whole(batch.slice(lo, STEP), components, scale)
                number, _ = ring.nearest(rows)
                order = np.argsort(number, kind="stable")
                own, starts, n = np.unique(number[order], return_index=True, return_counts=True)
                if len(own):
                    sums[own] += np.add.reduceat(rows[order], starts, axis=0)
                    counts[own] += n
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = vectors.mapInArrow(run, "cluster int, n long, sums array<long>")
    totals = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(components)]
    after = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():  # at most k rows
        after[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(components)]
    return after


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, salt: str = "2:", scale: int = SCALE) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in their order."""
    by = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = vectors.orderBy(by.asc_nulls_last(), "embedding").limit(k).select("embedding").collect()
    return np.floor(np.array([r[0] for r in chosen], dtype=np.float64) * scale).astype(np.int64)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, salt: str = "2:") -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of every kept vector.

    vectors: ``vec_id`` and ``embedding``; other columns, whatever their names, are not
    read. Left out are rows whose embedding is null, has another length, or holds a
    null, NaN, an infinity or a component of 2**19 or more, whose distances 64 bits
    couldn't hold. Rows that share an id are vectors of their own, of which the smaller
    embedding is the earlier centroid; ids that are null come last among the first
    centroids. Fewer than k vectors make as many centroids; none give an empty table.
    """
    usable = kept(vectors, components)
    centroids = first_centroids(usable, k, salt, scale)
    if not len(centroids):
        empty = usable.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")))
        return empty.withColumn("centroid_sha256", F.lit("")).where("false")
    for _ in range(rounds):
        centroids = moved(usable, centroids, scale)
    rows = cut_table(assigned(usable, centroids, scale))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # at most k rows
    inertia, of = sum(r["cluster_inertia"] for r in sums), {r["cluster"]: r["cluster_inertia"] for r in sums}

    def looked_up(values: list) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("cluster"))

    return rows.select(
        "vec_id",
        "cluster",
        "distance",
        looked_up([of.get(c, 0) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(inertia).cast("long").alias("inertia"),
        looked_up(digests).alias("centroid_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle_sql() -> str:
    start = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = {COMPONENTS}
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INT AS c, x FROM v ORDER BY sha256('2:' || vec_id) LIMIT {CENTROIDS}
)"""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    near = lambda i: f"""
, a{i} AS MATERIALIZED (
  SELECT vec_id, x, best.c AS c, best.d AS d FROM (
    SELECT v.vec_id, any_value(v.x) AS x, min({{'d': {distance}, 'c': c.c}}) AS best FROM v, c{i} c GROUP BY v.vec_id
  )
)"""  # noqa: E731
    mean = lambda i: f"""
, m{i} AS (
  SELECT c, list(floor_of ORDER BY i) AS x FROM (
    SELECT c, i, ((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_of
    FROM (SELECT c, unnest(x) AS y, unnest(range(1, {COMPONENTS + 1})) AS i FROM a{i}) GROUP BY c, i
  ) GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)"""  # noqa: E731
    return (
        start
        + "".join(near(i) + mean(i) for i in range(ROUNDS))
        + near(ROUNDS)
        + f"""
SELECT a.vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.c
"""
    )


ORACLE_SQL = _oracle_sql()
