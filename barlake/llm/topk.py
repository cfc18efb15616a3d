"""Exact top-k by inner product: candidates in buckets of like length, each pruned by length or by coordinates, then verified."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.common import table

SCALE, EVERY, K = 256, 50, 5
#: Queries that a task holds at once, candidates of one bucket.
QUERY_BLOCK, BUCKET = 4096, 1024
#: A bucket whose local cosine thresholds are this high on average is pruned by coordinates, else by length.
COSINE = 0.4
#: Share of the coordinates that coordinate pruning looks at first.
FOCUS = 0.25
#: Up to here products and sums are exact in doubles, and in 64 bits.
EXACT, WHOLE = 2.0**53, 2.0**62
#: Scores are limited to 64 bits; LOW marks a place that is free.
HIGHEST, LOW = 2**63 - 1, -(2**63)


def quantized(docs: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, q, length): components floor(scale * x) of vectors that have an id and only finite components; others take no part.

    Components are whole numbers in doubles, which are exact at any size.
    """
    x = F.col(f"`{vector}`")
    scaled = lambda v: v.cast("double") * scale
    value = lambda v: F.when(F.abs(scaled(v)) < EXACT, F.floor(scaled(v)).cast("double")).otherwise(scaled(v))  # noqa: E731  larger doubles are whole
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = docs.filter(F.col(f"`{key}`").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(x, value).alias("q"))
    return rows.withColumn("length", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, v: a + v * v)))


class _Block:
    """A block of queries of one dimension, with the best candidates so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, lengths: np.ndarray, k: int):
        self.ids, self.q, self.lengths, self.k = ids, q, lengths, k
        self.score = np.full((len(ids), k), LOW)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.many = np.zeros(len(ids), np.int64)  # candidates found, up to k
        self.largest = float(np.abs(q).max(initial=0))
        self.verified = 0

    def _products(self, rows: np.ndarray, cands: np.ndarray) -> np.ndarray:
        q = self.q[rows]
        most = self.largest * float(np.abs(cands).max(initial=0)) * q.shape[1]
        if most < EXACT:
            return (q @ cands.T).astype(np.int64)
        if most < WHOLE:
            return q.astype(np.int64) @ cands.astype(np.int64).T
        exact = np.frompyfunc(int, 1, 1)
        return np.clip(exact(q) @ exact(cands).T, LOW + 1, HIGHEST).astype(np.int64)

    def bucket(self, ids: np.ndarray, cands: np.ndarray, lengths: np.ndarray) -> None:
        """Candidates by falling length."""
        top, low = float(lengths[0]), float(lengths[-1])
        full = self.many == self.k
        bar = np.where(full & (self.score[:, -1] > LOW + 1), self.score[:, -1].astype(float), -np.inf)  # what a candidate has to reach
        reach = self.lengths * top * (1 + 1e-9)
        live = np.flatnonzero(reach >= bar)  # the whole bucket is too short for the others
        if not len(live):
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(self.lengths[live] * top > 0, bar[live] / (self.lengths[live] * top), -1.0)
        known = np.isfinite(cosine)
        if known.all() and cosine.mean() >= COSINE and low > 0:
            keep = self._by_coordinates(live, cands, lengths, bar)
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(np.isfinite(bar[live]) & (self.lengths[live] > 0), bar[live] / self.lengths[live] * (1 - 1e-9), -np.inf)
            keep = lengths[None, :] >= least[:, None]  # a run from the longest on
        rows, some = np.flatnonzero(keep.any(axis=1)), np.flatnonzero(keep.any(axis=0))
        if len(rows) and len(some):
            self._take(live[rows], ids[some], cands[some], keep[np.ix_(rows, some)])

    def _by_coordinates(self, live: np.ndarray, cands: np.ndarray, lengths: np.ndarray, bar: np.ndarray) -> np.ndarray:
        """Candidates whose product on the bucket's strongest coordinates, with the most that the others can add, reaches the bar."""
        q, c = self.q[live], cands
        focus = np.argsort(-np.abs(q).sum(axis=0), kind="stable")[: max(1, math.ceil(FOCUS * q.shape[1]))]
        part = q[:, focus] @ c[:, focus].T
        rest_q = np.sqrt(np.maximum(self.lengths[live] ** 2 - (q[:, focus] ** 2).sum(axis=1), 0))
        rest_c = np.sqrt(np.maximum(lengths**2 - (c[:, focus] ** 2).sum(axis=1), 0))
        slack = 1e-9 * (1 + np.outer(self.lengths[live], lengths))
        return part + np.outer(rest_q, rest_c) + slack >= bar[live][:, None]

    def _take(self, rows: np.ndarray, ids: np.ndarray, cands: np.ndarray, keep: np.ndarray) -> None:
        """Verify by whole products and merge with the best so far."""
        got = self._products(rows, cands)
        self.verified += int(keep.sum())
        ok = keep & (ids[None, :] != self.ids[rows][:, None])
        score = np.where(ok, got, LOW)
        # an id with several vectors counts with its best one
        by_id = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.r_[True, ids[by_id][1:] != ids[by_id][:-1]])
        score, ids = np.maximum.reduceat(score[:, by_id], first, axis=1), ids[by_id][first]
        k = min(self.k, len(ids))
        # the k best of each row, ties to the smaller id
        if len(ids) > 4 * self.k:
            kth = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
            some = np.flatnonzero((score >= kth[:, None]).any(axis=0))
            score, ids = score[:, some], ids[some]
        none = np.iinfo(np.int64).max
        score = np.concatenate([self.score[rows], score], axis=1)
        who = np.concatenate([self.who[rows], np.where(score[:, self.k :] > LOW, ids[None, :], none)], axis=1)
        order = np.lexsort((-score.clip(min=LOW + 1), who), axis=1)
        score, who = np.take_along_axis(score, order, 1), np.take_along_axis(who, order, 1)
        again = np.zeros(who.shape, bool)
        again[:, 1:] = who[:, 1:] == who[:, :-1]
        score, who = np.where(again, LOW, score), np.where(again, none, who)
        order = np.lexsort((who, -score.clip(min=LOW + 1)), axis=1)[:, : self.k]
        self.score[rows], self.who[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(who, order, 1)
        self.many[rows] = (self.who[rows] != none).sum(axis=1)

    def rows(self) -> pa.RecordBatch:
        has = self.who != np.iinfo(np.int64).max
        at = np.nonzero(has)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[at[0]]), pa.array(self.who[at]), pa.array(self.score[at])], names=["query_id", "vec_id", "score"])


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _once(ids: np.ndarray, q: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows, which stand together, once."""
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (q[1:] != q[:-1]).any(axis=1)
    return ids[fresh], q[fresh], lengths[fresh]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Rows by group, in a group queries before candidates, candidates by falling length."""
        group, block, waiting, held = None, None, [], []

        def flush() -> None:
            nonlocal held
            if held and block is not None:
                ids, q, lengths = _once(*(np.concatenate(x) for x in zip(*held)))
                for lo in range(0, len(ids), BUCKET):
                    block.bucket(ids[lo : lo + BUCKET], q[lo : lo + BUCKET], lengths[lo : lo + BUCKET])
            held = []

        def begun() -> None:
            nonlocal block, waiting
            if block is None and waiting:
                block = _Block(*_once(*(np.concatenate(x) for x in zip(*waiting))), k)
                waiting = []

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]  # dim, block, shard, side
            change = np.flatnonzero((np.diff(np.stack(keys), axis=1) != 0).any(axis=0)) + 1
            for lo, hi in zip([0, *change], [*change, batch.num_rows]):
                dim, *rest, side = (int(x[lo]) for x in keys)
                if (dim, *rest) != group:
                    flush()
                    if block is not None:
                        yield block.rows()
                    group, block, waiting = (dim, *rest), None, []
                part = batch.slice(lo, hi - lo)
                one = part.column(4).to_numpy(zero_copy_only=False), _matrix(part.column(5), dim), part.column(6).to_numpy(zero_copy_only=False)
                if side == 0:
                    waiting.append(one)
                else:
                    begun()
                    if block is not None:
                        held.append(one)
                        if sum(len(h[0]) for h in held) >= 8 * BUCKET:
                            flush()
        begun()
        flush()
        if block is not None:
            yield block.rows()

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, shards: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer products of every query over all candidates but its own id.

    Both sides are `quantized` frames. Ties go to the smaller id; a query with fewer candidates has fewer rows; vectors of another dimension do
    not meet. Rows equal in id and vector count once; of an id with several vectors, as query or candidate, the best product counts. Products
    are exact; a score beyond 64 bits is shown, and compared, as the nearest 64-bit number. Queries are dealt into blocks of about QUERY_BLOCK by their id, candidates into shards; each pair of block and shard is
    one group that meets once, longest candidates first, so that the bar of a query rises early and later, shorter buckets
    fall to it. Each group returns k rows a query, which are ranked once more. No frame is broadcast; a group holds its
    block of queries and one stretch of candidates at a time, whatever the number of either.
    """
    spark = candidates.sparkSession
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    if shards is None:
        shards = max(1, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / blocks))
    hashed = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.size("q").alias("dim"), hashed(blocks, 1).alias("block"), every(shards).alias("shard"), F.lit(0).alias("side"), "id", "q", "length")
    given = candidates.select(F.size("q").alias("dim"), every(blocks).alias("block"), hashed(shards, 2).alias("shard"), F.lit(1).alias("side"), "id", "q", "length")
    spread = asked.unionByName(given).repartition("dim", "block", "shard").sortWithinPartitions("dim", "block", "shard", "side", F.desc("length"), "id", "q")
    found = spread.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    # the best k per query out of k rows per shard; Spark drops rows beyond the k-th before it shuffles them
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.selectExpr("query_id", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank", "vec_id", "score")
    return ranked.filter(F.col("rank") <= k)


def op4_norm_buckets(spark: SparkSession, folder: str) -> DataFrame:
    vectors = quantized(table(spark, folder, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("id") % EVERY == 0))


def check_op4() -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(max(list_inner_product(a.q, b.q)) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
