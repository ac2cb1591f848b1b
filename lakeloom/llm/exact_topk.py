"""Exact top-k by inner product: branch and bound over columnar blocks.

Candidates and queries are packed into blocks of bounded size in vertical layout (a row for each dimension). A query
meets a candidate block dimension block by dimension block: partial inner products accumulate, and a candidate stays
only while its partial sum plus the largest the remaining dimensions can add (the product of the two vectors'
remaining norms) can still reach the query's k-th best score so far. Survivors are compacted after every dimension
block, so later dimensions are read for few candidates. First thresholds come from a seed of ``SEED`` candidates; a
threshold is always the k-th best of real candidates, so nothing that belongs to the result is lost.

Blocks are dealt to groups of about ``GROUP_BYTES``, and each pair of a query group and a candidate group meets in one
cell: a candidate is copied once for each query group and a query once for each candidate group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import saved

QUERY_ROWS, CANDIDATE_ROWS = 512, 4096
SEED = 4096
#: Values of a group's blocks, which one task holds with those of another group.
GROUP_BYTES = 1 << 25
#: Dimensions added between two compactions.
DIMS = 16

_BLOCK = "dim int, block long, ids binary, columns binary"


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``rows`` vectors of one dimension, values int64, a row of the matrix for each dimension."""
    from pyspark import TaskContext

    held: dict[int, list[tuple[int, np.ndarray]]] = {}
    task, made = TaskContext.get().partitionId() << 33, 0

    def close(dim: int) -> pa.RecordBatch:
        nonlocal made
        own = held.pop(dim)
        ids = np.array([i for i, _ in own], dtype="<i8")
        columns = np.ascontiguousarray(np.stack([v for _, v in own]).T.astype("<i8")) if dim else np.zeros((0, len(own)), dtype="<i8")
        made += 1
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([task + made], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([columns.tobytes()], pa.binary())], ["dim", "block", "ids", "columns"])

    for b in batches:
        vectors = b.column("v")
        values, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(vectors.value_lengths().to_numpy())
        whole = np.floor(1024.0 * values.astype(np.float64))
        if len(whole) and np.abs(whole).max() >= 2**63:
            raise OverflowError("components are too large for scores of 64 bits")
        whole = whole.astype(np.int64)
        for i, v in zip(b.column("id").to_pylist(), np.split(whole, ends[:-1]), strict=True):
            own = held.setdefault(len(v), [])
            own.append((i, v))
            if len(own) == rows:
                yield close(len(v))
    for dim in list(held):
        yield close(dim)


def _matrix(ids: pa.Scalar, columns: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids.as_buffer(), dtype="<i8")
    return i, np.frombuffer(columns.as_buffer(), dtype="<i8").reshape(-1, len(i))


def _rest(m: np.ndarray) -> np.ndarray:
    """For each dimension block, the norm of what comes after it, by vector."""
    squares = m.astype(np.float64) ** 2
    cuts = range(DIMS, len(m) + DIMS, DIMS)
    return np.stack([np.sqrt(squares[c:].sum(axis=0)) for c in cuts]) if len(m) else np.zeros((1, m.shape[1]))


class _Best:
    """The k best (score, id) of each query of a block; ties to smaller ids."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.ids, self.floor, self.k = ids, floor.copy(), k
        self.score = [np.zeros(0, dtype=np.int64) for _ in ids]
        self.of = [np.zeros(0, dtype=np.int64) for _ in ids]

    def add(self, q: int, score: np.ndarray, of: np.ndarray) -> None:
        s, i = np.concatenate([self.score[q], score]), np.concatenate([self.of[q], of])
        order = np.lexsort((i, -s))[: self.k]
        self.score[q], self.of[q] = s[order], i[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], float(s[order[-1]]))

    def rows(self) -> pa.RecordBatch:
        n = [len(s) for s in self.score]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate(self.of)), pa.array(np.concatenate(self.score))], ["query_id", "vec_id", "score"])


def search(best: _Best, queries: np.ndarray, q_rest: np.ndarray, ids: np.ndarray, columns: np.ndarray) -> None:
    """Adds a candidate block's survivors to each query's best."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(columns).max(initial=0)) * max(len(columns), 1)
    if top >= 2**63:
        raise OverflowError("components are too large for scores of 64 bits")
    kind = np.float64 if top < 2**52 else np.int64  # sums of products below 2^53 are exact as doubles
    q, c = queries.astype(kind), columns.astype(kind)
    c_rest = _rest(columns)
    first = q[:DIMS].T @ c[:DIMS]
    for k, own in enumerate(best.ids):
        floor = best.floor[k]
        partial, live = first[k], None
        for step, at in enumerate(range(DIMS, len(c) + DIMS, DIMS)):
            reach = partial + q_rest[step, k] * (c_rest[step] if live is None else c_rest[step][live])
            stay = np.flatnonzero(reach * (1 + 1e-12 * np.sign(reach)) + 1e-3 >= floor)
            live = stay if live is None else live[stay]
            partial = partial[stay]
            if at >= len(c) or not len(live):
                break
            partial = partial + q[at : at + DIMS, k] @ c[at : at + DIMS, live]
        if live is None:
            live = np.arange(len(ids))
        other = ids[live] != own
        if other.any():
            best.add(k, partial[other].astype(np.int64), ids[live][other])


def _seeded(batches: Iterator[pa.RecordBatch], seed: dict, k: int) -> Iterator[pa.RecordBatch]:
    """Query blocks with first thresholds."""
    for b in batches:
        floors = []
        for row in range(b.num_rows):
            ids, q = _matrix(b.column("ids")[row], b.column("columns")[row])
            best = _Best(ids, np.full(len(ids), -np.inf), k)
            if (found := seed.get(len(q))) is not None:
                search(best, q, _rest(q), *found)
            floors.append(best.floor.astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("dim", "block", "ids", "columns")), pa.array(floors, pa.binary())], ["dim", "block", "ids", "columns", "floor"])


def _met(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The best of the candidate blocks ``right`` for each query of the blocks ``left``."""
    out = []
    for row in range(left.num_rows if right.num_rows else 0):
        ids, q = _matrix(left.column("ids")[row], left.column("columns")[row])
        best, q_rest = _Best(ids, np.frombuffer(left.column("floor")[row].as_buffer(), dtype="<f8"), k), _rest(q)
        for other in range(right.num_rows):
            search(best, q, q_rest, *_matrix(right.column("ids")[other], right.column("columns")[other]))
        out.append(best.rows())
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    return pa.Table.from_batches(out, schema=schema)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of ``vectors`` with the highest score, ties to the
    smaller id; all of them, if there are fewer.

    Components are floor(1024 * x); the score is their inner product, which must fit 64 bits (else OverflowError). A row with the query's
    own id is no candidate. Vectors that are null or hold null, NaN or infinite components, and rows with a null id,
    take no part. Vectors meet only vectors of their own length. Of query rows that repeat an id the least vector
    asks; candidate rows that repeat an id all count. Empty tables give an empty result; other columns are not read."""
    spark = vectors.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
        finite = F.forall("v", lambda x: F.coalesce((x == x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
        return rows.where(finite)

    candidates = valid(vectors)
    seeds: dict[int, list] = {}
    for r in candidates.limit(SEED).collect():
        seeds.setdefault(len(r.v), []).append((r.id, np.floor(1024.0 * np.array(r.v, dtype=np.float64)).astype(np.int64)))
    seed = {d: (np.array([i for i, _ in own], dtype=np.int64), np.stack([v for _, v in own]).T) for d, own in seeds.items()}
    shared = spark.sparkContext.broadcast(seed)  # SEED vectors at most
    asked = valid(queries).groupBy("id").agg(F.min("v").alias("v"))
    query_blocks = saved(asked.mapInArrow(lambda batches: _blocks(batches, QUERY_ROWS), _BLOCK).mapInArrow(lambda batches: _seeded(batches, shared.value, k), _BLOCK + ", floor binary"))
    candidate_blocks = saved(candidates.mapInArrow(lambda batches: _blocks(batches, CANDIDATE_ROWS), _BLOCK))

    def groups(blocks: DataFrame, name: str) -> DataFrame:
        return blocks.groupBy("dim").agg(F.ceil((F.sum(F.octet_length("columns")) + 1) / GROUP_BYTES).cast("int").alias(name))

    # every query group meets every candidate group of its dimension in a cell of a grid
    sizes = groups(query_blocks, "nq").join(groups(candidate_blocks, "nc"), "dim")  # a row a dimension
    of = lambda n: F.pmod(F.xxhash64("block"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = query_blocks.join(sizes, "dim").select("dim", of("nq").alias("qg"), each("nc").alias("cg"), "ids", "columns", "floor")
    right = candidate_blocks.join(sizes, "dim").select("dim", each("nq").alias("qg"), of("nc").alias("cg"), "ids", "columns")
    cell = ["dim", "qg", "cg"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(lambda x, y: _met(x, y, k), "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same for DuckDB.
TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
