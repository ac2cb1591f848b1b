"""K-means with an annulus search for the nearest centroid.

Centroids are sorted by norm. A vector's distance to the centroid whose norm is next to its own is an upper bound, and by
the triangle inequality no centroid is closer whose norm differs from the vector's by more than it. Two binary searches
give the centroids with norms in that annulus, boundary ties included, and only these are compared, in exact integers.

A round is one pass over the vectors: tasks add up their own vectors by centroid, the sums meet in an aggregation by
(centroid, component), and as many rows as centroids have components come to the driver. Nothing is carried from round to
round but the centroids, so a lost executor costs its tasks of one round."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import saved

#: Vectors compared at once.
ROWS = 8192
#: A bound is widened by this share of what was added up in floating point.
SLACK = 1e-9
_SUMS = "cluster int, n long, sums array<decimal(38,0)>"


def whole(vectors: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, integers): which vectors have exactly ``dims`` finite components, and their floor(scale * x)."""
    if not isinstance(vectors, (pa.ListArray, pa.LargeListArray)):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    sizes = vectors.value_lengths().fill_null(-1).to_numpy()
    right = np.flatnonzero(sizes == dims)
    own = vectors.take(pa.array(right)).flatten()
    values = own.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(right), dims)
    with np.errstate(over="ignore", invalid="ignore"):
        fine = np.isfinite(values).all(axis=1)
        scaled = np.floor(scale * values[fine])
    if scaled.size and not np.abs(scaled).max() < 2.0**62:
        raise OverflowError("components are too large for distances of 64 bits")
    return right[fine], scaled.astype(np.int64)


class Centroids:
    """Integer centroids, ready for exact nearest-neighbour search."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.largest = int(np.abs(points).max(initial=0))
        self.squares = np.array([sum(int(c) ** 2 for c in p) for p in points], dtype=object)
        norms = np.sqrt(self.squares.astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance) of each vector, ties to the smaller number, and how many were compared."""
        n, dims = vectors.shape
        top = max(self.largest, int(np.abs(vectors).max(initial=0)))
        # sums of squares below 2^53 are exact as doubles, those below 2^63 as integers, others as Python's own
        kind = np.float64 if dims * (2 * top) ** 2 < 2**53 else np.int64 if dims * (2 * top) ** 2 < 2**63 else object
        x, points, c_squares = vectors.astype(kind), self.points.astype(kind), self.squares.astype(kind)
        x_squares = (x * x).sum(axis=1)
        norms = np.sqrt(x_squares.astype(np.float64))

        # a centroid of about the same norm bounds the distance
        near = np.searchsorted(self.norms, norms)
        near = np.clip(np.where((near > 0) & ((near == len(self.norms)) | (np.abs(self.norms[near - 1] - norms) <= np.abs(self.norms[np.minimum(near, len(self.norms) - 1)] - norms))), near - 1, near), 0, len(self.norms) - 1)
        cluster = self.order[near]
        distance = ((x - points[cluster]) ** 2).sum(axis=1)
        reach = np.sqrt(distance.astype(np.float64))
        reach = reach + SLACK * (reach + norms + self.norms[-1]) + SLACK
        low, high = np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")

        compared = n
        for place in range(int(low.min(initial=0)), int(high.max(initial=0))):
            number = self.order[place]
            rows = np.flatnonzero((low <= place) & (place < high) & (near != place))
            if not len(rows):
                continue
            compared += len(rows)
            d = x_squares[rows] - 2 * (x[rows] @ points[number]) + c_squares[number]
            better = (d < distance[rows]) | ((d == distance[rows]) & (number < cluster[rows]))
            cluster[rows[better]], distance[rows[better]] = number, d[better]
        if kind is object and n and max(distance) >= 2**63:
            raise OverflowError("a distance has more than 64 bits")
        return cluster.astype(np.int32), distance.astype(np.int64), compared


def _rows(batches: Iterator[pa.RecordBatch], dims: int, scale: float) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integers) of runs of kept vectors."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            places, values = whole(part.column("v"), dims, scale)
            if len(places):
                yield part.column("id").take(pa.array(places)), values


def _summed(batches: Iterator[pa.RecordBatch], centroids: Centroids, dims: int, scale: float) -> Iterator[pa.RecordBatch]:
    """The count and componentwise sums of a task's vectors by nearest centroid."""
    k = len(centroids.points)
    counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=object)
    for _, values in _rows(batches, dims, scale):
        cluster, _, _ = centroids.nearest(values)
        small = int(np.abs(values).max(initial=0)) < 2**62 // ROWS
        for c in np.unique(cluster):
            own = values[cluster == c]
            counts[c] += len(own)
            sums[c] += own.sum(axis=0) if small else own.astype(object).sum(axis=0)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array([[Decimal(int(x)) for x in sums[c]] for c in some], pa.list_(pa.decimal128(38, 0)))], ["cluster", "n", "sums"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: Centroids, dims: int, scale: float) -> Iterator[pa.RecordBatch]:
    for ids, values in _rows(batches, dims, scale):
        cluster, distance, _ = centroids.nearest(values)
        yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector.

    Kept are vectors with exactly ``dims`` components, none null, NaN or infinite; a component x counts as the integer
    floor(scale * x). Centroids start as the ``k`` vectors with the smallest sha-256 of ``seed:id`` (all, if fewer; of
    rows that repeat an id the least vectors first; a null id as an empty one), and each round replaces every centroid
    that has vectors by the floor of their mean. distance: squared, to the nearest centroid, ties to the smaller number;
    the inertias are its sums. Repeated rows and null ids are vectors like others; an empty table, or one without kept
    vectors, gives an empty result; other columns are not read. A distance of more than 64 bits raises OverflowError.

    ``vectors`` is read rounds + 2 times; k * dims numbers a round come to the driver, and k centroids go to each task."""
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = source.schema["id"].dataType.simpleString()
    finite = F.forall("v", lambda x: F.coalesce((x == x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    kept = source.where((F.size("v") == dims) & finite)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.select(digest.alias("h"), F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("w"), "v").orderBy("h", "w").limit(k).select("v").toArrow()
    _, points = whole(first.column("v").combine_chunks(), dims, scale)
    if not len(points):
        return spark.createDataFrame([], f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    for _ in range(rounds):
        own = spark.sparkContext.broadcast(Centroids(points))  # k centroids
        sums = kept.mapInArrow(lambda batches, own=own: _summed(batches, own.value, dims, scale), _SUMS)
        each = sums.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        points = points.copy()
        for r in each.collect():  # k * dims rows
            points[r.cluster, r.at] = int(r.s) // r.n

    own = spark.sparkContext.broadcast(Centroids(points))
    last = saved(kept.mapInArrow(lambda batches: _assigned(batches, own.value, dims, scale), f"id {kind}, cluster int, distance long"))
    inertia = {r.cluster: int(r.s) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    total = sum(inertia.values())
    said = [(c, s, total, hashlib.sha256(",".join(map(str, points[c].tolist())).encode()).hexdigest()) for c, s in sorted(inertia.items())]
    known = spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(rounds: int) -> str:
    """The rounds as common table expressions a0 (assignment), c1, a1, ..."""
    assign = """a{r} AS MATERIALIZED (
  SELECT id, row, v, number, distance FROM (
    SELECT v.id, v.row, v.v, c.number, list_sum(list_transform(generate_series(1, 64), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i]))) AS distance,
      row_number() OVER (PARTITION BY v.row ORDER BY distance, c.number) AS place
    FROM v CROSS JOIN c{r} c) WHERE place = 1
)"""
    move = """c{n} AS MATERIALIZED (
  SELECT c.number, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT number, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT number, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, generate_series(1, 64) g(i) GROUP BY number, i)
    GROUP BY number) m USING (number)
)"""
    parts = []
    for r in range(rounds):
        parts += [assign.format(r=r), move.format(r=r, n=r + 1)]
    return ",\n".join([*parts, assign.format(r=rounds)])


#: The same for DuckDB.
CLUSTER_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id AS id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS number, v FROM (
    SELECT sha256('1:' || coalesce(CAST(id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT 16)
), {_rounds_sql(3)}
SELECT id AS vec_id, CAST(number AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY number) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(list_aggregate(list_transform(c.v, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256
FROM a3 JOIN c3 c USING (number)
"""
