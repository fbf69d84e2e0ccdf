"""Operator 11: centroid clustering by Walsh-Hadamard progressive search.

Every vector is scaled to whole numbers and kept as its Walsh-Hadamard
coefficients, coarse ones (few sign changes) first. The transform keeps squared
distances up to the factor ``dim``, so the search for the nearest centroid adds
up squared differences of coefficients from coarse to fine. After 1, 2, 4, ...
coefficients, with ``rv`` and ``rm`` the energies left in vector and centroid,
the rest of a distance lies between ``(sqrt(rv) - sqrt(rm))^2`` and
``(sqrt(rv) + sqrt(rm))^2``. A centroid whose least distance is above another's
largest is strictly worse and goes; the others are finished with every
coefficient. All sums are whole numbers, so assignments, ties (smaller number)
and centroids (floor of the mean) are exact and do not depend on the partitions.

A round is one pass over the written coefficients: every task adds up its
vectors by cluster, and ``k * dim`` sums reach the driver, whatever the rows.

Rules: vectors of another length, null, or with a null or non-finite component
take no part. Rows that repeat are vectors of their own. Rows with a null id
are clustered but never start a centroid. Fewer than ``k`` vectors: as many
centroids as vectors; no vector with an id: no centroids, null results. Equal
hashes start in order of the coefficients. An empty cluster keeps its centroid.
Scaled components beyond 2^27 raise an error, as distances would leave 64 bits;
a sum of distances beyond 64 bits is null. Empty table: no rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upshelf.llm.common import forget, written

#: Largest scaled component: its squared distances fit 64 bits.
LARGEST = 1 << 27

#: Vectors compared at a time: bounds the memory of a task.
BLOCK = 4096


def sequency(dim: int) -> np.ndarray:
    """Rows of the Hadamard matrix by their number of sign changes."""
    h = np.ones((1, 1), dtype=np.int8)
    while len(h) < dim:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")


def _butterflies(x: np.ndarray) -> np.ndarray:
    n, dim = x.shape
    half = 1
    while half < dim:
        y = x.reshape(n, dim // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, dim)
        half *= 2
    return x


def transform(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whole-number rows -> their coefficients, coarse first."""
    return _butterflies(x)[:, order]


def inverse(c: np.ndarray, order: np.ndarray) -> np.ndarray:
    x = np.empty_like(c)
    x[:, order] = c
    return _butterflies(x) // c.shape[1]


def assign(v: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of every row of coefficients ``v`` among the rows of ``m``."""
    dim = v.shape[1]
    top = int(np.abs(v).max(initial=0)) + int(np.abs(m).max(initial=0))
    if top * top * dim >= 1 << 62:                      # beyond 64 bits: Python's whole numbers
        v, m = v.astype(object), m.astype(object)
    part = np.zeros((len(v), len(m)), dtype=v.dtype)
    alive = np.ones(part.shape, dtype=bool)
    rv, rm = (v * v).sum(axis=1), (m * m).sum(axis=1)
    done, step = 0, 1
    while done < dim:
        i, j = np.nonzero(alive)
        a, b = v[:, done:step], m[:, done:step]
        d = a[i] - b[j]
        part[i, j] += (d * d).sum(axis=1)
        rv, rm = rv - (a * a).sum(axis=1), rm - (b * b).sum(axis=1)
        done, step = step, 2 * step
        if done < dim:
            x, y = np.sqrt(rv.astype(np.float64))[:, None], np.sqrt(rm.astype(np.float64))[None, :]
            known = part.astype(np.float64)
            most = known + (x + y) ** 2
            slack = 1e-9 * most + 1                     # far above the rounding of these bounds
            best = np.where(alive, most + slack, np.inf).min(axis=1)
            alive &= known + (x - y) ** 2 - slack <= best[:, None]
    far = part.max(initial=0) + 1
    near = np.where(alive, part, far).argmin(axis=1)
    return near, part[np.arange(len(v)), near] // dim


def _rows(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), dim)


def coefficients(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, c): the coefficients of every kept vector."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = v.where(F.size("v") == dim).where(~bad)
    order = sequency(dim)

    def run(batches):
        for b in batches:
            x = np.floor(_rows(b.column(1), dim) * scale)
            if np.abs(x).max(initial=0) > LARGEST:
                raise ValueError(f"a scaled component is beyond {LARGEST}: its distances do not fit 64 bits")
            c = transform(x.astype(np.int64), order)
            at = np.arange(0, c.size + 1, dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, c.ravel())], ["vec_id", "c"])

    return kept.mapInArrow(run, "vec_id long, c array<long>")


def _means(kept: DataFrame, m: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The coefficients of the next centroids."""
    k, dim = m.shape

    def run(batches):
        total, count = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b in batches:
            c = _rows(b.column(0), dim)
            for a in range(0, len(c), BLOCK):
                near, _ = assign(c[a:a + BLOCK], m)
                np.add.at(total, near, c[a:a + BLOCK])
                count += np.bincount(near, minlength=k)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at]), pa.array(list(total[at]), pa.list_(pa.int64()))],
                                         ["cluster", "n", "total"])

    sums = (kept.select("c").mapInArrow(run, "cluster int, n long, total array<long>")
            .select("cluster", "n", F.posexplode("total").alias("at", "x"))
            .groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")))
    total, count = np.zeros((k, dim), dtype=object), [0] * k
    for r in sums.collect():                            # at most k * dim rows
        total[r.cluster, r["at"]], count[r.cluster] = int(r.x), r.n
    means = inverse(total, order)
    for j in range(k):
        if count[j]:
            m[j] = transform((means[j:j + 1] // count[j]).astype(np.int64), order)[0]
    return m


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, salt: str = "1:",
            id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), the final centroids in whole numbers). ``dim`` is a power of two."""
    if dim < 1 or dim & (dim - 1):
        raise ValueError("the transform needs a length that is a power of two")
    order = sequency(dim)
    kept = written(coefficients(vectors, id_col, vec_col, dim, scale), "walsh-vectors")
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").select(digest.alias("h"), "c").orderBy("h", "c").limit(k).collect()    # k rows
    m = np.array([r.c for r in first], dtype=np.int64).reshape(-1, dim)
    for _ in range(rounds if len(m) else 0):
        m = _means(kept, m, order)

    def run(batches):
        for b in batches:
            c = _rows(b.column(1), dim)
            if not len(m):
                none = pa.nulls(len(c))
                yield pa.RecordBatch.from_arrays([b.column(0), none.cast(pa.int32()), none.cast(pa.int64())], ["vec_id", "cluster", "distance"])
                continue
            found = [assign(c[a:a + BLOCK], m) for a in range(0, len(c), BLOCK)]
            near, far = (np.concatenate([f[i] for f in found] or [np.zeros(0)]).astype(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    out = written(kept.mapInArrow(run, "vec_id long, cluster int, distance long"), "walsh-out")
    forget(kept)
    return out, inverse(m, order)


def digests(vectors: DataFrame, **options) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    out, centroids = cluster(vectors, **options)
    total = F.expr("try_cast(sum(cast(distance as decimal(38,0))) as long)")
    whole = out.agg(total.alias("x")).first().x
    by = {r.cluster: r.x for r in out.where("cluster is not null").groupBy("cluster").agg(total.alias("x")).collect()}   # at most k rows
    rows = [(j, by.get(j), hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()) for j, c in enumerate(centroids)]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    return (out.join(F.broadcast(named), "cluster", "left")          # k rows
            .select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), "centroid_sha256"))


def oracle(k: int = 16, rounds: int = 3) -> str:
    """The same clustering in plain distances, for tables of unique ids."""
    near = """
a{i} AS MATERIALIZED (
  SELECT vec_id, x, c, d FROM (
    SELECT v.vec_id, v.x, c, d, row_number() OVER (PARTITION BY v.vec_id ORDER BY d, c) AS r
    FROM (SELECT v.vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
          FROM v, c{i}) v) WHERE r = 1
)"""
    mean = """
s{i} AS (SELECT c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i),
c{j} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(w.m, c{i}.m) AS m
  FROM c{i} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{i} GROUP BY c) w ON w.c = c{i}.c
)"""
    steps = [near.format(i=0)]
    for r in range(rounds):
        steps += [mean.format(i=r, j=r + 1), near.format(i=r + 1)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x AS m FROM v QUALIFY c < {k}
),{','.join(steps)}
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""
