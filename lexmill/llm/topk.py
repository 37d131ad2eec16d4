"""Exact top-k search by a three-phase uniform threshold.

The components are split into `lists` groups; a list holds the partial inner products of its group, and a score is the sum
over the lists. Phase 1: each task looks for the k highest entries of each of its lists, resolves the scores of what enters
them, and gathers for each query the k highest of these scores; the k-th of all that is gathered is the cutoff, which k
candidates reach, so it is safe. Phase 2: the cutoff is broadcast; a candidate that reaches it has an entry of at least
cutoff / lists in some list, so each task tests one list after another and collects the candidates with such an entry
alone. Phase 3: the scores of these alone are resolved from their entries, and of what reaches the cutoff each task returns the k best of a
query (ties to the smaller id), whichever number ties. `resolved` counts, in two accumulators, the scores that either phase
made of entries, to be held against all pairs.

Queries are taken in passes of at most `block` queries, chosen by a hash of their id; a pass broadcasts that block (at
most block * width * 8 bytes) and its cutoffs. The table is read in splits and never shuffled; what is shuffled is k rows
for each query and task.

Components x become floor(64 * x). Products are single floats while no sum can reach 2**24, doubles below 2**53, else Python
integers (scores beyond a long are clipped to its range), so all are exact. Null ids, null vectors and vectors with null or
non-finite components take no part. Shorter vectors count as filled up with zeros. A query is not held against rows of its
own id. Rows that repeat an id are candidates one by one; a query id that repeats is a query for each of its rows. Empty
tables give empty tables; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import Best, best_of_each, matrix, widened

SCALE = 64
LONG = -(2**63), 2**63 - 1


def exact_kind(x: np.ndarray, q: np.ndarray):
    """The number type in which all products of rows of x and q are exact."""
    with np.errstate(over="ignore"):
        most = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def converted(x: np.ndarray, kind) -> np.ndarray:
    if kind is not object:
        return x.astype(kind)
    return np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object)


def product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.dot(x, q.T) if x.shape[1] else np.zeros((len(x), len(q)), x.dtype)


class Scores:
    """Slices of a task's rows against a block of queries."""

    def __init__(self, block: tuple[np.ndarray, np.ndarray], lists: int):
        self.qid, self.q, self.lists, self.resolved = *block, lists, 0

    def slices(self, batches, key: str, vec: str):
        """(ids, rows, queries, groups of components) in exact numbers."""
        step = max(16, min(2048, (1 << 21) // max(1, len(self.qid))))
        for b in batches:
            for lo in range(0, b.num_rows, step):
                ids, x = matrix(b.slice(lo, step), key, vec, self.q.shape[1])
                if len(ids) and len(self.qid):
                    x, q = np.floor(SCALE * x), widened(self.q, x.shape[1])
                    kind = exact_kind(x, q)
                    cuts = [x.shape[1] * g // self.lists for g in range(self.lists + 1)]
                    yield ids, converted(x, kind), converted(q, kind), list(zip(cuts[:-1], cuts[1:], strict=True))

    def score(self, x, q, rows, cols) -> np.ndarray:
        """Whole scores of the pairs (rows, cols)."""
        self.resolved += len(rows)
        out = [(x[rows[i : i + 65536]] * q[cols[i : i + 65536]]).sum(1) for i in range(0, len(rows), 65536)]
        return clipped(np.concatenate(out)) if out else np.zeros(0)

    def gather(self, batches, key: str, vec: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Phase 1: (query, score), k scores of a query, among the candidates that its lists' k highest entries show."""
        found = Best(k)
        tops: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in range(self.lists)]
        least = [np.full(len(self.qid), -np.inf) for _ in range(self.lists)]
        for ids, x, q, groups in self.slices(batches, key, vec):
            own = ids[:, None] == self.qid[None, :]
            shown = np.zeros(own.shape, bool)
            for j, (a, b) in enumerate(groups):
                p = product(x[:, a:b], q[:, a:b])
                enter = (p > least[j]).astype(bool) & ~own
                if p.dtype != object and len(ids) > 2 * k:  # of the first slices only their own highest
                    enter &= p >= np.partition(p, len(ids) - k - 1, axis=0)[len(ids) - k - 1]
                rows, cols = np.nonzero(enter)
                shown[rows, cols] = True
                col, value = np.concatenate([tops[j][0], cols]), np.concatenate([tops[j][1], p[rows, cols]])
                at = best_of_each(col, value, k)
                tops[j] = col[at], value[at]
                full = np.bincount(tops[j][0], minlength=len(self.qid)) >= k
                lowest = np.full(len(self.qid), np.inf, object if value.dtype == object else float)
                np.minimum.at(lowest, tops[j][0], tops[j][1])
                least[j] = np.where(full, lowest, -np.inf)
            rows, cols = np.nonzero(shown)
            found.add(cols, self.score(x, q, rows, cols), ids[rows])
        col, score, _ = found.all()
        return col, score

    def resolve(self, batches, key: str, vec: str, k: int, cutoff: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phases 2 and 3: (query, score, id), k of a query at most, of this task's candidates that reach the cutoff."""
        found = Best(k)
        big = any(c is not None and abs(c) >= 2**53 for c in cutoff)
        least = np.array([-np.inf if c is None else c for c in cutoff], dtype=object if big else np.float64)
        for ids, x, q, groups in self.slices(batches, key, vec):
            enough, exact = np.zeros((len(ids), len(self.qid)), bool), big or x.dtype == object
            share = None if exact else np.nextafter((least / self.lists).astype(x.dtype), x.dtype.type(-np.inf))
            parts = []
            for a, b in groups:
                parts.append(p := product(x[:, a:b], q[:, a:b]))
                enough |= (p * self.lists >= least).astype(bool) if exact else p >= share
            enough &= ids[:, None] != self.qid[None, :]
            rows, cols = np.nonzero(enough)
            self.resolved += len(rows)
            score = clipped(sum((p[rows, cols] for p in parts[1:]), parts[0][rows, cols]))
            at = np.nonzero((score >= least[cols]).astype(bool))[0]
            found.add(cols[at], score[at], ids[rows[at]])
        return found.all()


def clipped(score: np.ndarray) -> np.ndarray:
    if score.dtype != object:
        return score.astype(np.float64)
    return np.vectorize(lambda v: min(max(v, LONG[0]), LONG[1]), otypes=[object])(score) if score.size else score


def longs(score: np.ndarray) -> pa.Array:
    return pa.array([int(v) for v in score], pa.int64()) if score.dtype == object else pa.array(score.astype(np.int64))


def top_k(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vec: str = "embedding", k: int = 20, lists: int = 4, block: int = 32_768, resolved: tuple | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k highest scores among rows. Both have key and vec."""
    spark = rows.sparkSession
    rows, queries = (d.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vec}`").alias("v")) for d in (rows, queries))
    passes = max(1, -(-queries.count() // block))
    first, last = resolved or (None, None)
    out = None
    for p in range(passes):
        mine = queries.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p)
        got = mine.toArrow()
        qid, q = matrix(got.combine_chunks().to_batches()[0] if got.num_rows else pa.RecordBatch.from_pylist([], got.schema), "id", "v")
        shared = spark.sparkContext.broadcast((qid, np.floor(SCALE * q)))

        def phase1(batches, shared=shared):
            scores = Scores(shared.value, lists)
            col, score = scores.gather(batches, "id", "v", k)
            for i in range(0, len(col), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(col[i : i + (1 << 16)]), longs(score[i : i + (1 << 16)])], ["q", "score"])
            if first is not None:
                first.add(scores.resolved)

        best_k = Window.partitionBy("q").orderBy(F.desc("score"))
        gathered = rows.mapInArrow(phase1, "q long, score long").withColumn("n", F.row_number().over(best_k)).where(F.col("n") == k)
        cutoff: list = [None] * len(qid)
        for r in gathered.select("q", "score").collect():  # a row for each query of the block
            cutoff[r[0]] = r[1]
        cut = spark.sparkContext.broadcast(cutoff)

        def phase3(batches, shared=shared, cut=cut):
            scores = Scores(shared.value, lists)
            col, score, ids = scores.resolve(batches, "id", "v", k, cut.value)
            for i in range(0, len(col), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(col[s]), pa.array(shared.value[0][col[s]]), pa.array(ids[s]), longs(score[s])], ["q", "query_id", "vec_id", "score"])
            if last is not None:
                last.add(scores.resolved)

        hits = rows.mapInArrow(phase3, "q long, query_id long, vec_id long, score long")
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        ranked = ranked.select("query_id", "rank", "vec_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out
