"""Lloyd's clustering of quantised vectors, on distinct vectors with weights.

Equal quantised vectors are folded into one row with its multiplicity before anything else: the fold combines in each task
before it shuffles, so a vector that a third of all rows hold is a row from each task. All rounds run on the distinct rows,
with sums of integers times weights, which no order of addition changes. At the end the distinct rows' clusters are joined
back to the vectors' ids; what many rows share is dealt to several tasks there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, dropped, released, spread_join, written

#: Components are held within this, so that a squared distance of 64 components fits a long.
LARGEST = 1 << 27

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def quantised(vectors: DataFrame, size: int = 64, scale: int = 64) -> DataFrame:
    """vec_id and q, the integers floor(scale * x) of all vectors with exactly ``size`` finite components.

    Components are taken as doubles. Vectors that are null, of another size, or with a null or non-finite component are left
    out; those beyond LARGEST in size count as LARGEST. Repeated rows and null ids stay.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.size("embedding") == size
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    q = F.transform(x, lambda v: F.greatest(F.least(F.floor(v * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    kept = vectors.where(F.coalesce(whole & finite, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))


def first_centroids(rows: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The k vectors with the smallest digest of seed and id, in that order: fewer if there are fewer.

    Rows without an id start none. Of several rows with one id each may start a centroid; the smaller vector comes first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    best = rows.where("vec_id is not null").select(digest.alias("h"), "q").orderBy("h", "q").limit(k)
    return [list(r.q) for r in best.collect()]


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("q"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the nearest centroid (ties: the smaller number) and its squared distance."""
    best, cluster = None, np.zeros(len(x), np.int32)
    for i, c in enumerate(centroids):
        d = x - c
        d = np.einsum("ij,ij->i", d, d)
        if best is None:
            best = d
        else:
            closer = d < best
            cluster[closer], best = i, np.where(closer, d, best)
    return cluster, best


def _sums(centroids: np.ndarray) -> Step:
    """Weighted sums of a task's vectors by centroid: a row for each centroid that has any."""
    k, size = centroids.shape

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, w = _matrix(batch, size), batch.column(batch.schema.get_field_index("weight")).to_numpy()
            cluster, _ = nearest(x, centroids)
            order = np.argsort(cluster, kind="stable")
            edges = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            if len(edges):
                own = cluster[order][edges]
                sums[own] += np.add.reduceat(x[order] * w[order, None], edges, axis=0)
                counts[own] += np.add.reduceat(w[order], edges)
        some = np.flatnonzero(counts)
        made = [pa.array(some, pa.int32()), pa.array(counts[some], pa.int64()), pa.array(sums[some].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(made, ["cluster", "n", "sums"])

    return lambda batches: released(of(batches))


def moved(distinct: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every centroid that has vectors becomes the floor of their mean; the others stay.

    Sums of sums are decimals, so that no number of tasks overflows them; k times ``size`` of them come to the driver.
    """
    parts = distinct.mapInArrow(_sums(np.array(centroids, np.int64)), "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x"))
    total = each.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    out = [list(c) for c in centroids]
    for r in total.collect():
        out[r.cluster][r["at"]] = int(r.x) // r.n
    return out


def _assigned(centroids: np.ndarray) -> Step:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(_matrix(batch, centroids.shape[1]), centroids)
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("q", "weight")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["q", "weight", "cluster", "distance"])

    return lambda batches: released(of(batches))


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """Of each kept vector vec_id, cluster, distance (squared), cluster_inertia and inertia; and the last centroids.

    See ``quantised`` for what is kept and ``first_centroids`` for the start. Repeated rows each have a row and count each
    time; ids may be null; other columns are dropped. Without a kept vector that has an id there is no centroid, and no row.
    """
    rows = quantised(vectors, size, scale)
    distinct = written(rows.groupBy("q").agg(F.count("*").alias("weight")))
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return rows.where("false").select("vec_id", *(F.lit(0).cast(t).alias(n) for n, t in _ASSIGNED.items())), centroids
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    kind = "q array<int>, weight long, cluster int, distance long"
    judged = written(distinct.mapInArrow(_assigned(np.array(centroids, np.int64)), kind))
    spread = F.col("distance").cast("decimal(38,0)") * F.col("weight")
    inertia = judged.groupBy("cluster").agg(F.sum(spread).cast("long").alias("cluster_inertia"))
    inertia = inertia.crossJoin(F.broadcast(judged.agg(F.sum(spread).cast("long").alias("inertia"))))  # a row beside at most k rows
    hot = judged.where(F.col("weight") > HOT_ROWS).select("q", F.col("weight").alias("__n"))
    back = spread_join(rows, judged.select("q", "cluster", "distance"), "q", counts=hot)
    dropped(distinct)
    return back.join(F.broadcast(inertia), "cluster").select("vec_id", *_ASSIGNED), centroids


_ASSIGNED = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long"}


def report(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """``clustered`` with a digest of the components of each vector's centroid."""
    rows, centroids = clustered(vectors, k, rounds, size, scale, seed)
    return rows.withColumn("centroid_sha256", F.sha2(_listed(centroids), 256))


def _listed(centroids: list[list[int]]) -> Column:
    """The components of the row's centroid, joined by commas."""
    every = [F.lit(",".join(map(str, c))) for c in centroids]
    return F.element_at(F.array(*every), F.col("cluster") + 1) if every else F.lit(None).cast("string")


def sql(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same in DuckDB's SQL over embeddings."""
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    nearest = lambda i: f"""r{i} AS (SELECT rid, q, vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
 SELECT rid, vec_id, v.q, c.cluster, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i} c) GROUP BY 1, 2, 3)"""  # noqa: E731
    move = lambda i: f"""m{i} AS (SELECT cluster, list(x ORDER BY pos) AS q FROM (SELECT cluster, pos, {floor} AS x FROM (
 SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range({size})) AS pos FROM r{i}) GROUP BY 1, 2)) GROUP BY 1),
c{i + 1} AS (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m USING (cluster))"""  # noqa: E731
    steps = ",\n".join(f"{nearest(i)},\n{move(i)}" for i in range(rounds))
    return f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(x, lambda y: CAST(floor(y * {scale}) AS BIGINT)) AS q FROM e
 WHERE len(x) = {size} AND len(list_filter(x, lambda y: y IS NOT NULL AND isfinite(y))) = {size}),
c0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS cluster, q FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT {k})),
{steps},
{nearest(rounds)},
t AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM r{rounds} GROUP BY 1)
SELECT vec_id, CAST(r.cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM t) AS BIGINT) AS inertia,
 sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM r{rounds} r JOIN t USING (cluster) JOIN c{rounds} c USING (cluster)"""
