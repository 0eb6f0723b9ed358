"""Clustering of integer vectors around centroids by sort-means.

Each round, every centroid orders the other ones by their distance from it. A vector starts from the centroid it had
before, at distance d, and goes through the others in that order; the first one strictly beyond 2d from the start cannot
be nearer, nor can any after it, so the scan stops there. All distances are squared and exact integers.

Spark holds the vectors and their last cluster as a table that each round writes anew (the former one is removed, as
nothing needs it any more). The driver holds k centroids and k * k gaps; component sums come from tasks as k * dims rows
each and are summed on the map side, so that a cluster with a third of all vectors is no hot key.

Edge cases: a vector of another length, or with a component that is null or not finite, is left out, as is one with a
component whose integer does not fit in 62 bits. Fewer kept vectors than k give as many centroids as there are, none an
empty table. A null vec_id counts as empty in the hash. Vectors of one hash (repeated ids) go by their components.
Equal centroids are told apart by their number; repeated rows repeat. A distance or a sum beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, released, removed, scratch_dir

#: Below this magnitude four times a squared distance of up to 8,192 components fits in 64 bits; beyond it Python integers
#: count.
NARROW = 2**22
WIDEST, LONGEST = 2.0**62, 2**63 - 1


def integer_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, x: floor(scale * component) of the kept vectors)."""
    fits = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * scale) < WIDEST)
    whole = (F.size("embedding") == dims) & F.forall("embedding", fits)
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * scale).cast("bigint"))
    return vectors.where(F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to ``y``."""
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap) if gap.dtype != object else (gap * gap).sum(axis=1)


class Centroids:
    """k centroids, and for each one the others by distance from it."""

    def __init__(self, at: list[list[int]]):
        self.at = np.array(at, dtype=object)
        self.narrow = all(abs(v) < NARROW for row in at for v in row)
        table = self.at.astype(np.int64) if self.narrow else self.at
        self.order, self.gaps = [], []
        for c, y in enumerate(table):
            gaps = squared(table, y)
            by = sorted((j for j in range(len(at)) if j != c), key=lambda j: (gaps[j], j))
            self.order.append(by)
            self.gaps.append([int(gaps[j]) for j in by])

    def assign(self, x: np.ndarray, was: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and squared distance of each row of ``x`` (64-bit integers), given the former centroids, and the
        number of distances that were taken."""
        narrow = self.narrow and (not x.size or max(-int(x.min()), int(x.max())) < NARROW)
        x, table = (x, self.at.astype(np.int64)) if narrow else (x.astype(object), self.at)
        cluster, distance, taken = was.copy(), np.zeros(len(x), x.dtype), 0
        for start in np.unique(was).tolist():
            rows = np.flatnonzero(was == start)
            own = squared(x[rows], table[start])
            by = np.argsort(-own, kind="stable")
            rows, own = rows[by], own[by]
            reach = -4 * own  # ascending: the rows that a gap concerns are a prefix
            best, at = own.copy(), np.full(len(rows), start)
            taken += len(rows)
            for c, gap in zip(self.order[start], self.gaps[start], strict=True):
                n = int(np.searchsorted(reach, -gap, side="right"))
                if not n:
                    break
                d = squared(x[rows[:n]], table[c])
                nearer = (d < best[:n]) | ((d == best[:n]) & (c < at[:n]))
                best[:n], at[:n] = np.where(nearer, d, best[:n]), np.where(nearer, c, at[:n])
                taken += n
            cluster[rows], distance[rows] = at, best
        return cluster, distance, taken


def components_of(column: pa.Array, n: int) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(n, -1)


def assigned(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """``vectors`` (vec_id, x, cluster) with the nearest centroid as cluster, and its distance."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cluster, distance, _ = centroids.assign(components_of(batch.column(1), batch.num_rows), np.asarray(batch.column(2)))
        far = [int(d) if d <= LONGEST else None for d in distance.tolist()]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "x", "cluster", "distance"])

    return map_batches(vectors.select("vec_id", "x", "cluster"), "vec_id bigint, x array<bigint>, cluster int, distance bigint", run)


def recentred(vectors: DataFrame, former: Centroids) -> Centroids:
    """The exact floor of each cluster's mean; an empty cluster keeps its centroid."""
    k, dims = former.at.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, cluster = components_of(batch.column(0), batch.num_rows), np.asarray(batch.column(1))
            n += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                high[c] += (own >> 32).sum(axis=0)
                low[c] += (own & 0xFFFFFFFF).sum(axis=0)
        found = np.flatnonzero(n).tolist()
        total = [(int(high[c, d]) << 32) + int(low[c, d]) for c in found for d in range(dims)]
        cols = [pa.array(np.repeat(found, dims), pa.int32()), pa.array(list(range(dims)) * len(found), pa.int32())]
        yield pa.record_batch([*cols, pa.array(total, pa.decimal128(38, 0)), pa.array(np.repeat(n[found], dims), pa.int64())], ["cluster", "d", "s", "n"])

    rows = vectors.select("x", "cluster").mapInArrow(lambda b: released(sums(b)), "cluster int, d int, s decimal(38,0), n bigint")
    at = former.at.tolist()
    for r in rows.groupBy("cluster", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        at[r["cluster"]][r["d"]] = int(r["s"]) // r["n"]
    return Centroids(at)


def cluster_vectors(vectors: DataFrame, k: int, dims: int, scale: int, rounds: int, seed: int) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_dir(spark, "sort-means")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    rows, path = written(integer_vectors(vectors, dims, scale).withColumn("cluster", F.lit(0)))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select("x", key.alias("h")).orderBy("h", "x").limit(k).collect()
    centroids = Centroids([list(r["x"]) for r in first]) if first else Centroids([[0] * dims])
    for last in [False] * rounds + [True]:
        moved, was = assigned(rows, centroids), path
        rows, path = written(moved)
        removed(spark, was)
        centroids = centroids if last else recentred(rows, centroids)

    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()
    of = {r["cluster"]: None if r["lost"] else int(r["s"]) for r in sums}  # at most k rows
    total = None if None in of.values() else sum(of.values())
    fitting = lambda n: n if n is not None and n <= LONGEST else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids.at[c])).encode()).hexdigest()
    per = [(c, fitting(n), fitting(total), digest(c)) for c, n in of.items()]
    about = spark.createDataFrame(per, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, dims=64, scale=256, rounds=5, seed=2)


def _rounds_sql(rounds: int) -> str:
    """The same clustering by all distances, for a second engine."""
    parts = [
        """kept AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = 64)""",
        "long AS (SELECT r, vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM kept)",
        "c0 AS (SELECT k AS c, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM (SELECT x, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), x) - 1 AS k FROM kept) WHERE k < 40)",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS (SELECT r, min(far) AS far, arg_min(c, (far, c)) AS c FROM (SELECT l.r, k.c, sum((l.v - k.v) * (l.v - k.v)) AS far FROM long l JOIN c{n} k ON l.d = k.d GROUP BY l.r, k.c) GROUP BY r)")
        if n < rounds:
            mean = "CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END"
            parts.append(f"""m{n} AS (SELECT c, d, {mean} AS v FROM (SELECT a.c, l.d, CAST(sum(l.v) AS BIGINT) AS s, count(*) AS n FROM long l JOIN a{n} a ON l.r = a.r GROUP BY a.c, l.d)),
c{n + 1} AS (SELECT k.c, coalesce(m.v, k.v) AS v, k.d FROM c{n} k LEFT JOIN m{n} m ON m.c = k.c AND m.d = k.d)""")
    parts.append(f"sha AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)")
    last = f"a{rounds}"
    return f"""WITH {", ".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)} SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.far AS BIGINT) AS distance,
CAST(sum(a.far) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.far) OVER () AS BIGINT) AS inertia, sha.h AS centroid_sha256
FROM {last} a JOIN kept k ON k.r = a.r JOIN sha ON sha.c = a.c"""


OP11_SQL = _rounds_sql(5)
