"""Centroid clustering of integer vectors with a Walsh-Hadamard progressive search.

Every vector and centroid is transformed once by the integer Walsh-Hadamard transform, its
coefficients in order of sequency (sign changes), coarse to fine.  The transform keeps squared
distances up to the factor SIZE, exactly, in integers.  The search first finishes, for each vector,
the centroid nearest by the coarse coefficients; its whole distance is the bound.  Squared
differences of the next coefficients are then added block by block, and a centroid whose sum
already exceeds the bound strictly is out; what is left is compared over all SIZE coefficients, so
ties go to the smaller number exactly.

A round is one pass over the staged vectors: each task adds up its vectors by cluster, and Spark
sums these few rows.  Only the centroids, at most ``k`` rows, come to the driver.

Defined results: null, short, long vectors and those with a null, NaN or infinite component are
left out; repeated rows are vectors of their own; a null vec_id is kept and starts no cluster
unless too few others are there; equal ids start clusters in the order of their components; fewer
vectors than ``k`` give fewer centroids; an empty table gives an empty result; extra columns are
ignored.  A component beyond LIMIT after scaling has no distance in a long: ValueError.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricesieve.llm.common import staged

SIZE = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Largest magnitude of a scaled component: transformed squared differences then stay in 63 bits.
LIMIT = 1 << 24
#: Coefficients 0, 1, 2-3, 4-7, ...: each block is twice as fine as all before it.
BLOCKS = [(0, 1)] + [(1 << i, 2 << i) for i in range(6)]

VECTORS = "vec_id long, v array<long>, h array<long>"
PARTS = "cluster int, n long, sums array<decimal(38,0)>, inertia decimal(38,0)"
ASSIGNED = "vec_id long, cluster int, distance long"


def walsh_matrix(size: int = SIZE) -> np.ndarray:
    """Rows of the Walsh-Hadamard matrix by number of sign changes."""
    m = np.ones((1, 1), dtype=np.int64)
    while len(m) < size:
        m = np.block([[m, m], [m, -m]])
    return m[np.argsort((np.diff(m, axis=1) != 0).sum(axis=1), kind="stable")]


def transform(v: np.ndarray) -> np.ndarray:
    return v @ walsh_matrix().T


def nearest(h: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (least number among equals) and squared distance, for
    transformed vectors ``h`` and transformed ``centres``."""
    n, k = len(h), len(centres)
    first, last = BLOCKS[0][0], BLOCKS[2][1]
    coarse = ((h[:, None, first:last] - centres[None, :, first:last]) ** 2).sum(axis=2)
    guess = coarse.argmin(axis=1)
    bound = ((h - centres[guess]) ** 2).sum(axis=1)
    row, col = np.nonzero(coarse <= bound[:, None])
    sums = coarse[row, col]
    for lo, hi in BLOCKS[3:]:
        sums = sums + ((h[row, lo:hi] - centres[col, lo:hi]) ** 2).sum(axis=1)
        left = sums <= bound[row]
        row, col, sums = row[left], col[left], sums[left]
    # rows come in ascending (vector, centroid) order: the first of the least sum wins
    order = np.lexsort((col, sums, row))
    row, col, sums = row[order], col[order], sums[order]
    start = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, dtype=bool)
    return col[start].astype(np.int32), sums[start] // SIZE


def _lists(m: np.ndarray, type_: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1] if m.ndim > 1 else 1), pa.int32()),
                                    pa.array(m.ravel(), type_ or pa.int64()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = _matrix(b.column("x")).astype(np.float64)
        with np.errstate(over="ignore"):
            scaled = np.floor(x * SCALE)
        if np.abs(scaled).max(initial=0) > LIMIT:
            raise ValueError(f"a component times {SCALE} exceeds {LIMIT}: its squared distance has no exact long")
        v = scaled.astype(np.int64)
        yield pa.record_batch([b.column("vec_id"), _lists(v), _lists(transform(v))], ["vec_id", "v", "h"])


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, integer components ``v`` and coefficients ``h`` of the usable rows."""
    x = F.col("embedding")
    usable = x.isNotNull() & (F.size(x) == SIZE) & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.coalesce(usable, F.lit(False)))
    return staged(rows.mapInArrow(_prepare, VECTORS), "vectors")


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors with the least sha256 of '1:<vec_id>'."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64).reshape(-1, SIZE)


def _search(centres: np.ndarray):
    """(cluster, distance, vectors) of each batch."""
    def run(batches):
        h = transform(centres)
        for b in batches:
            if b.num_rows:
                yield (*nearest(_matrix(b.column("h")), h), b)
    return run


def _partial_sums(centres: np.ndarray):
    search = _search(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centres)
        n, sums, inertia = [0] * k, [[0] * SIZE for _ in range(k)], [0] * k
        for cluster, distance, b in search(batches):
            v = _matrix(b.column("v"))
            for c in np.unique(cluster).tolist():
                own = cluster == c
                n[c] += int(own.sum())
                sums[c] = [a + s for a, s in zip(sums[c], v[own].sum(axis=0).tolist())]
                inertia[c] += sum(distance[own].tolist())
        used = [c for c in range(k) if n[c]]
        d = pa.decimal128(38, 0)
        if used:
            yield pa.record_batch([
                pa.array(used, pa.int32()), pa.array([n[c] for c in used], pa.int64()),
                pa.array([sums[c] for c in used], pa.list_(pa.int64())).cast(pa.list_(d)),
                pa.array([inertia[c] for c in used], pa.int64()).cast(d)], ["cluster", "n", "sums", "inertia"])
    return run


def moved(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centroids after one assignment: floor of the mean of each cluster, empty ones stay."""
    parts = vectors.mapInArrow(_partial_sums(centres), PARTS)
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(SIZE)]
    out = centres.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(SIZE)]
    return out


def _assign(centres: np.ndarray):
    search = _search(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cluster, distance, b in search(batches):
            yield pa.record_batch([b.column("vec_id"), pa.array(cluster), pa.array(distance)],
                                  ["vec_id", "cluster", "distance"])
    return run


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance (squared), inertia of the cluster and of all, and the sha256 of
    the cluster's centroid, for every usable vector."""
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings)
    centres = first_centroids(vectors, k)
    for _ in range(rounds if len(centres) else 0):
        centres = moved(vectors, centres)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    assigned = staged(vectors.mapInArrow(_assign(centres), ASSIGNED), "assigned")
    inertia = dict(assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    facts = [(c, int(d), int(sum(inertia.values())), names[c]) for c, d in inertia.items()]
    # at most k rows, so the broadcast has a fixed bound
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(i: int, rounds: int) -> str:
    """CTEs of one assignment, and of the centroids after it unless it is the last."""
    text = f"""
d{i} AS (SELECT r, k, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{i} c USING (i) GROUP BY r, k),
a{i} AS (SELECT r, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)"""
    if i < rounds:
        text += f""",
m{i} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM a{i} JOIN v USING (r) GROUP BY k, i),
c{i + 1} AS (SELECT c.k, c.i, CAST(CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS x
  FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k AND m.i = c.i)"""
    return text


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of :func:`cluster`: plain distances over all components."""
    return f"""
WITH rows AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
v AS (SELECT r, unnest(range({SIZE})) AS i, CAST(floor({SCALE} * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x FROM rows),
starts AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS k FROM rows
  ORDER BY k LIMIT {k}),
c0 AS (SELECT k, i, x FROM starts JOIN v USING (r)),{','.join(_round(i, rounds) for i in range(rounds + 1))},
names AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN rows USING (r) JOIN names USING (k)"""
