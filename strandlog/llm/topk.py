"""Exact top-k search by inner product over vectors sorted by length (operator 7).

Components are turned into integers floor(scale * x).  Vectors are sorted by descending length and
packed into blocks.  A query's score with a vector is bounded by |q| |c| (Cauchy-Schwarz), so a block
whose longest vector cannot reach the query's k-th best score so far is skipped as a whole.  Within
a block both sides are rotated by the right singular vectors of a sample; the inner product of the
leading rotated components plus the product of the lengths of the rests bounds each score, first for
``HEAD`` components and, for pairs that these leave open, for four times as many; only pairs whose
bounds reach the threshold are scored exactly, in integers.  The threshold of a query starts as its
k-th best score in the blocks of the longest vectors and rises as a task finds better ones.

Queries are taken in chunks of at most ``CHUNK`` bytes.  A chunk is broadcast and every task goes through its
own blocks of vectors in the order of their length, so vectors are never shuffled again; a task hands
on at most k rows a query.  The work still grows with queries times the vectors that no bound excludes.

The rotation is fitted on at most ``sample`` vectors; it changes which pairs are pruned, never the
result.  Bounds carry a slack above the rounding error of floating point.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.common import own_folder, staged

BLOCK = 2048
CHUNK = 64 << 20  #: bytes of queries that are collected and broadcast together
LEAD = 4  #: blocks of the longest vectors that set the first thresholds
HEAD = 16  #: leading rotated components
EXACT = float(1 << 52)  #: integers whose sums of products stay below are exact as doubles


def _ints(values, scale: float) -> np.ndarray | None:
    if values is None or any(v is None for v in values):
        return None
    x = np.asarray(values, dtype=np.float64)
    return np.floor(scale * x) if np.isfinite(x).all() and np.isfinite(scale * x).all() else None


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, dim, norm, vec): vec holds the integers as doubles; unusable vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, norms, vecs = [], [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = _ints(v, scale)
                if x is not None and i is not None:
                    ids.append(i)
                    dims.append(len(x))
                    norms.append(float(np.linalg.norm(x)))
                    vecs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(vecs, pa.binary())], ["vec_id", "dim", "norm", "vec"])

    return df.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, "vec_id long, dim int, norm double, vec binary")


def blocks(vectors: DataFrame) -> DataFrame:
    """Packs the rows of each partition, in their order, into blocks of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, place = [], TaskContext.get().partitionId() << 32

        def out():
            nonlocal place
            ids = np.array([r[0] for r in held], dtype=np.int64)
            row = [place, held[0][1], max(r[2] for r in held), ids.tobytes(), b"".join(r[3] for r in held)]
            held.clear()
            place += 1
            return pa.RecordBatch.from_arrays([pa.array([x]) if not isinstance(x, int) else pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), None, None, None))], ["block", "dim", "norm", "ids", "vecs"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) == BLOCK or held[0][1] != r[1]):
                    yield out()
                held.append(r)
        if held:
            yield out()

    return vectors.select("vec_id", "dim", "norm", "vec").mapInArrow(run, "block long, dim int, norm double, ids binary, vecs binary")


def rotation(vectors: DataFrame, sample: int) -> dict[int, np.ndarray]:
    """Right singular vectors by dimension, from at most ``sample`` vectors."""
    by: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("dim", "vec").collect():
        by.setdefault(r[0], []).append(np.frombuffer(r[1]))
    return {d: np.linalg.svd(np.array(v[:4096]), full_matrices=False)[2] if len(v) >= d > 0 else np.eye(d) for d, v in by.items()}


def best_in_block(q_ids, q, c_ids, c, thresholds, k, basis):
    """(query index, vector ids, scores) of what may belong to a query's top k, by score and id."""
    q_norm, c_norm = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    slack = 1 + 1e-9 * q_norm * c_norm.max(initial=0)
    live = np.flatnonzero(q_norm * c_norm.max(initial=0) + slack >= thresholds)
    if not len(live):
        return
    q, q_norm, slack, thresholds, q_ids = q[live], q_norm[live], slack[live], thresholds[live], q_ids[live]
    may = np.ones((len(q), len(c)), dtype=bool)
    if np.isfinite(thresholds).any() and len(basis) > HEAD:
        qr, cr = q @ basis.T, c @ basis.T
        rest = lambda full, head: np.sqrt(np.maximum(full**2 - (head**2).sum(1), 0))
        bound = qr[:, :HEAD] @ cr[:, :HEAD].T + np.outer(rest(q_norm, qr[:, :HEAD]), rest(c_norm, cr[:, :HEAD])) * (1 + 1e-9)
        may = bound + slack[:, None] >= thresholds[:, None]
        if len(basis) > 4 * HEAD:
            i, j = np.nonzero(may)
            q_rest, c_rest = rest(q_norm, qr[:, : 4 * HEAD]), rest(c_norm, cr[:, : 4 * HEAD])
            for some in (slice(x, x + (1 << 16)) for x in range(0, len(i), 1 << 16)):
                at, to = i[some], j[some]
                bound = (qr[at, : 4 * HEAD] * cr[to, : 4 * HEAD]).sum(1) + q_rest[at] * c_rest[to] * (1 + 1e-9)
                may[at, to] = bound + slack[at] >= thresholds[at]
    exact = (q_norm.max() * c_norm.max(initial=0)) < EXACT
    for i in range(len(q)):
        at = np.flatnonzero(may[i] & (c_ids != q_ids[i]))
        if not len(at):
            continue
        if exact:
            scores = (c[at] @ q[i]).astype(np.int64)
        else:  # Python integers, held to the range of a long
            own = [int(x) for x in q[i]]
            scores = np.array([max(-(1 << 63), min((1 << 63) - 1, sum(a * int(b) for a, b in zip(own, row)))) for row in c[at]], dtype=np.int64)
        some = scores >= thresholds[i] if exact else np.ones(len(at), dtype=bool)
        at, scores = at[some], scores[some]
        if len(at) > 4 * k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            at, scores = at[scores >= least], scores[scores >= least]
        order = np.lexsort((c_ids[at], -scores))[:k]
        yield int(live[i]), c_ids[at[order]], scores[order]


class Best:
    """The k best of each query of a block among the vectors that a task has met."""

    def __init__(self, q_ids, q, least, k):
        self.q_ids, self.q, self.least, self.k = q_ids, q, least.copy(), k
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def meet(self, c_ids, c, basis) -> None:
        for i, ids, scores in best_in_block(self.q_ids, self.q, c_ids, c, self.least, self.k, basis):
            if i in self.found:
                ids, scores = np.concatenate([self.found[i][0], ids]), np.concatenate([self.found[i][1], scores])
                order = np.lexsort((ids, -scores))[: self.k]
                ids, scores = ids[order], scores[order]
            self.found[i] = ids, scores
            if len(scores) == self.k:
                self.least[i] = max(self.least[i], float(scores[-1]) - abs(float(scores[-1])) * 1e-15)

    def rows(self) -> Iterator[pa.RecordBatch]:
        some = sorted(self.found)
        if some:
            who = np.repeat(self.q_ids[some], [len(self.found[i][0]) for i in some])
            yield pa.RecordBatch.from_arrays([pa.array(who), *(pa.array(np.concatenate([self.found[i][n] for i in some])) for n in (0, 1))], ["query_id", "vec_id", "score"])


def top_k(df: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, every: int = 20, sample: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row with id % every = 0.

    Ties go to the smaller id.  Vectors that are null, or hold a null or a number that is not
    finite, and rows without an id take no part; vectors meet vectors of their own dimension only;
    identical rows count once; a query is never its own candidate.  No rows, no result.  Ids are whole numbers.
    """
    spark = df.sparkSession
    vectors = staged(integer_vectors(df, id_col, vector_col, scale).distinct(), "vectors")
    basis = spark.sparkContext.broadcast(rotation(vectors, sample))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = staged(blocks(vectors.repartitionByRange(n, "dim", F.desc("norm"), "vec_id").sortWithinPartitions("dim", F.desc("norm"), "vec_id")), "blocks")
    of_length = Window.partitionBy("dim").orderBy(F.desc("norm"), "block")
    lead = packed.withColumn("r", F.row_number().over(of_length)).filter(F.col("r") <= LEAD).select("dim", F.col("ids").alias("c_ids"), F.col("vecs").alias("c_vecs"))
    asked = vectors.filter(F.col("vec_id") % every == 0)
    size = asked.agg(F.sum(F.octet_length("vec") + 8).alias("size"), F.max(F.octet_length("vec") + 8).alias("row")).first()
    if not size["size"]:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    per_chunk = max(1, CHUNK // (BLOCK * size["row"]))  # blocks in a chunk
    parts = -(-size["size"] // CHUNK)
    asked = blocks(asked.repartition(parts, "vec_id").sortWithinPartitions("dim", "vec_id"))
    # A chunk: neighbouring blocks of one partition, so its size has a bound.
    chunk = F.shiftright("block", 32) * (1 << 20) + F.floor(F.col("block").bitwiseAND((1 << 32) - 1) / per_chunk)
    asked = asked.select(chunk.alias("chunk"), "dim", F.col("norm").alias("q_norm"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))

    def arrays(dim, ids, vecs):
        own = np.frombuffer(ids, dtype=np.int64)
        return own, np.frombuffer(vecs).reshape(len(own), dim) if dim else np.zeros((len(own), 0))

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for j in range(batch.num_rows) for r in batch.slice(j, 1).to_pylist()):
            q_ids, q = arrays(row["dim"], row["q_ids"], row["q_vecs"])
            best = Best(q_ids, q, np.full(len(q_ids), -np.inf), k)
            for x in row["lead"]:
                best.meet(*arrays(row["dim"], x["c_ids"], x["c_vecs"]), basis.value.get(row["dim"], np.eye(row["dim"])))
            out = {**{n: row[n] for n in ("chunk", "dim", "q_norm", "q_ids", "q_vecs")}, "least": best.least.tobytes(), "floor": float(best.least.min())}
            yield pa.RecordBatch.from_pylist([out], schema=pa.schema([("chunk", pa.int64()), ("dim", pa.int32()), ("q_norm", pa.float64()), ("q_ids", pa.binary()), ("q_vecs", pa.binary()), ("least", pa.binary()), ("floor", pa.float64())]))

    lead = lead.groupBy("dim").agg(F.collect_list(F.struct("c_ids", "c_vecs")).alias("lead"))  # at most LEAD blocks
    ready = staged(asked.join(lead, "dim").mapInArrow(thresholds, "chunk long, dim int, q_norm double, q_ids binary, q_vecs binary, least binary, floor double"), "queries")

    def search(blocks_met: Iterator[pa.RecordBatch], asked_now) -> Iterator[pa.RecordBatch]:
        best = [(r["dim"], r["q_norm"], Best(*arrays(r["dim"], r["q_ids"], r["q_vecs"]), np.frombuffer(r["least"]), k)) for r in asked_now]
        for batch in blocks_met:
            for dim, norm, ids, vecs in zip(*(batch.column(c) for c in ("dim", "norm", "ids", "vecs"))):
                c_ids, c = arrays(dim.as_py(), ids.as_py(), vecs.as_py())
                for q_dim, q_norm, own in best:
                    if q_dim == dim.as_py() and q_norm * norm.as_py() * (1 + 1e-9) + 1 >= own.least.min():
                        own.meet(c_ids, c, basis.value.get(q_dim, np.eye(q_dim)))
        for _, _, own in best:
            yield from own.rows()

    path = f"{own_folder(spark)}/found-{uuid.uuid4().hex}"
    for number in sorted(r[0] for r in ready.select("chunk").distinct().collect()):
        rows = ready.filter(F.col("chunk") == number).collect()  # CHUNK bytes, or one block
        shared = spark.sparkContext.broadcast([r.asDict() for r in rows])
        reach = [(F.col("dim") == d) & (F.col("norm") * max(r["q_norm"] for r in rows if r["dim"] == d) * (1 + 1e-9) + 1 >= min(r["floor"] for r in rows if r["dim"] == d)) for d in sorted({r["dim"] for r in rows})]
        near = packed.filter(reduce(lambda x, y: x | y, reach))
        near.select("dim", "norm", "ids", "vecs").mapInArrow(lambda it, q=shared: search(it, q.value), "query_id long, vec_id long, score long").write.mode("append").parquet(path)
        shared.unpersist()
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
