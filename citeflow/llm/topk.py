"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are cut into buckets of similar length. A query's k-th best score among the longest vectors is a lower bound
of its final one; divided by both lengths it becomes a cosine threshold for each bucket. Where the threshold is high,
vectors outside the feasible range of the query's largest coordinates are pruned; where it is low, short vectors are.
Exact products of what remains decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions

K, BUCKET, QUERIES, SCALE = 5, 4096, 256, 256.0
#: Cosine threshold from which coordinates are looked at, and how many of them.
HIGH, FOCUS = 0.6, 4


def _quantised(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.floor(scale * np.array(v, np.float64)) for v in batch.column(1).to_pylist()]
            if any(np.abs(r).max(initial=0) >= 2.0**63 for r in rows):
                raise OverflowError("a scaled component does not fit 64 bits: scale the vectors down")
            rows = [r.astype(np.int64) for r in rows]
            norm = [float(np.sqrt((r.astype(np.float64) ** 2).sum())) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(norm, pa.float64()), pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary())], ["vec_id", "norm", "q"])

    return run


def _packed(size: int):
    """Rows of a task to blocks of at most ``size`` vectors: ids, lengths, and a matrix padded with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            for at in range(0, table.num_rows if last else table.num_rows - table.num_rows % size, size):
                part = table.slice(at, size)
                rows = [np.frombuffer(b, "<i8") for b in part.column("q").to_pylist()]
                dim = max(len(r) for r in rows)
                m = np.zeros((len(rows), dim), "<i8")
                for i, r in enumerate(rows):
                    m[i, : len(r)] = r
                ids, norm = part.column("vec_id").to_numpy(), part.column("norm").to_numpy()
                cols = [pa.array([x], pa.binary()) for x in (ids.astype("<i8").tobytes(), norm.astype("<f8").tobytes(), m.tobytes())]
                cols += [pa.array([dim], pa.int32()), pa.array([float(norm.max())], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, ["ids", "norms", "m", "dim", "longest"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                table = pa.Table.from_batches(held)
                yield from blocks(table, False)
                held = table.slice(table.num_rows - table.num_rows % size).to_batches()
        if sum(b.num_rows for b in held):
            yield from blocks(pa.Table.from_batches(held), True)

    return run


def _block(ids: bytes, norms: bytes, m: bytes, dim: int):
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(norms, "<f8"), np.frombuffer(m, "<i8").reshape(len(i), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: in floating point where no sum can pass 2 ** 53, else in 64-bit integers."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dim
    if most >= 2**63:
        raise OverflowError("a score may not fit 64 bits: scale the vectors down")
    return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 2**53 else a @ b.T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


class Bucket:
    """A bucket's vectors with their directions, decoded once for all query blocks that meet it."""

    def __init__(self, ids: bytes, norms: bytes, m: bytes, dim: int):
        self.ids, self.norms, self.m = _block(ids, norms, m, dim)
        self.longest = float(self.norms.max(initial=0.0))
        self.unit = self.m / np.maximum(self.norms, 1e-300)[:, None]


def _near_direction(q: np.ndarray, t: float, unit: np.ndarray) -> np.ndarray:
    """Coordinate pruning: which directions may have a cosine of ``t`` with q, by its largest coordinates."""
    t = min(1.0, t) - 1e-7
    keep = np.ones(len(unit), bool)
    for c in np.argsort(-np.abs(q))[:FOCUS]:
        if c < unit.shape[1]:
            room = np.sqrt(max(0.0, (1 - q[c] * q[c]) * (1 - t * t))) + 1e-7
            keep &= (unit[:, c] >= q[c] * t - room) if q[c] > 0 else (unit[:, c] <= q[c] * t + room)
    return keep


def retrieve(qids: np.ndarray, qnorms: np.ndarray, qm: np.ndarray, floors: np.ndarray, b: Bucket, k: int) -> list[tuple[np.ndarray, ...]]:
    """(query ids, ids, scores) of the bucket's vectors that may be among a query's k best: all with a score of at
    least the query's floor that the bucket's own k best don't exceed. Each query's local cosine threshold chooses how
    the bucket is pruned for it; products of all queries that prune by length are one matrix product."""
    reach = qnorms * b.longest
    open_ = floors <= reach * (1 + 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(reach > 0, floors / reach, -1.0)
    out = []

    def settle(i: int, at: np.ndarray, scores: np.ndarray) -> None:
        enough = (scores >= floors[i]) & (b.ids[at] != qids[i])
        at, scores = at[enough], scores[enough]
        if len(at):
            best = _best(b.ids[at], scores, k)
            out.append((np.full(len(best), qids[i]), b.ids[at][best], scores[best]))

    for i in np.flatnonzero(open_ & (t >= HIGH)):
        at = np.flatnonzero(_near_direction(qm[i] / qnorms[i], t[i], b.unit))
        if len(at):
            settle(i, at, products(qm[i][None], b.m[at])[0])
    low = np.flatnonzero(open_ & (t < HIGH))
    if len(low):
        with np.errstate(divide="ignore", invalid="ignore"):
            short = np.where(floors[low] > 0, floors[low] / (qnorms[low] * (1 + 1e-9)), -1.0)
        at = np.flatnonzero(b.norms >= short.min())
        scores = products(qm[low], b.m[at])
        for j, i in enumerate(low):
            settle(i, at, scores[j])
    return out


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != last:
                    last, bucket = r["bucket"], Bucket(r["ids"], r["norms"], r["m"], r["dim"])
                qids, qnorms, qm = _block(r["q_ids"], r["q_norms"], r["q_m"], r["q_dim"])
                out = retrieve(qids, qnorms, qm, np.frombuffer(r["floors"], "<f8"), bucket, k)
                cols = [pa.array(np.concatenate(c).astype(np.int64) if out else np.zeros(0, np.int64), pa.int64()) for c in (zip(*out) if out else ((), (), ()))]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "vec_id", "score"])

    return run


def _floors(longest: tuple[np.ndarray, np.ndarray], k: int):
    """Adds each query's k-th best score among the longest vectors, which no final score is below, and the length
    that a vector needs to reach any query's of the block."""
    ids, m = longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = []
            for r in batch.to_pylist():
                qids, _, qm = _block(r["ids"], r["norms"], r["m"], r["dim"])
                f = np.full(len(qids), -np.inf)
                if len(ids):
                    s = products(qm, m).astype(np.float64)
                    s[qids[:, None] == ids[None]] = -np.inf
                    if s.shape[1] >= k:
                        f = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                floors.append(f)
            need = [float((f / np.maximum(np.frombuffer(n, "<f8"), 1e-300)).min()) for f, n in zip(floors, batch.column("norms").to_pylist())]
            cols = [*batch.columns, pa.array([f.astype("<f8").tobytes() for f in floors], pa.binary()), pa.array(need, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "floors", "need"])

    return run


BLOCK = "ids binary, norms binary, m binary, dim int"


def top_k(vectors: DataFrame, is_query, k: int = K, scale: float = SCALE, bucket: int = BUCKET) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest integer inner products over all other rows.

    Components become ``floor(scale * x)``; queries are the rows that fulfil ``is_query``. Ties go to the smaller
    vec_id; a query with fewer candidates gets all. Rows with a null id or vector, or with null or non-finite
    components, take no part. Shorter vectors count as padded with zeros. Rows that repeat a vec_id are candidates of
    their own, except for the query of that id, which is taken once. An empty table gives no rows.

    Queries meet candidates in blocks: a query block (``QUERIES`` rows) and a bucket (``bucket`` rows) are one row of
    a join, unless the bucket's vectors are too short for every query of the block, which the join leaves out. At most
    ``k`` results of each query leave a row. The ``bucket`` longest vectors, of bounded size, go to all tasks first. A scaled component or a score that does not fit
    64 bits is an error.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").where(fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = scratch.keep(rows.mapInArrow(_quantised(scale), "vec_id long, norm double, q binary"), "rows")
    top = rows.orderBy(F.desc("norm"), "vec_id").limit(bucket).select("vec_id", "q").collect()
    own = [np.frombuffer(r["q"], "<i8") for r in top]
    m = np.zeros((len(own), max((len(r) for r in own), default=0)), np.int64)
    for i, r in enumerate(own):
        m[i, : len(r)] = r
    longest = (np.array([r["vec_id"] for r in top], np.int64), m)

    n = max(1, -(-rows.count() // bucket))
    buckets = rows.repartitionByRange(n, F.desc("norm"), "vec_id").mapInArrow(_packed(bucket), f"{BLOCK}, longest double")
    buckets = scratch.keep(buckets.withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q"), F.min_by("norm", "q").alias("norm")).select("vec_id", "norm", "q")
    blocks = asked.mapInArrow(_packed(QUERIES), f"{BLOCK}, longest double").mapInArrow(_floors(longest, k), f"{BLOCK}, longest double, floors binary, need double")
    blocks = blocks.select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "norms", "m", "dim")], "floors", "need")
    slots = shuffle_partitions(spark)  # every slot has some buckets and all query blocks
    placed = buckets.withColumn("slot", F.pmod(F.xxhash64("bucket"), F.lit(slots)))
    spread = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    reaches = F.col("longest") * (1 + 1e-9) >= F.col("need")
    pairs = placed.join(spread, (placed.slot == spread.slot) & reaches).drop("slot", "longest", "need")  # a bucket's pairs in a row
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
