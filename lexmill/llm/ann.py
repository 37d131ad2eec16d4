"""Approximate nearest neighbours by cosine: an inverted file with product-quantised residuals.

Fit, on the driver, from a bounded sample (at most `sample` rows, those of smallest id hash): coarse centroids by k-means,
`spread` times the root of the row count, but not more than `sample` / 24 of them (2,730, reached at some 116,000 rows), as a
centroid needs rows to be fitted on: up to there lists stay short as the table grows, beyond it they grow with it; above FLAT of them in two levels
(groups of centroids, then the centroids of a group), which fit and assignment go down. Then a codebook of up to 256 words
for each of `parts` groups of components, on the residuals.

Index: every row gets its list, its code and the length of what the code leaves out. Rows are dealt by (list, salt), where
long lists are salted by their counts, and written to the shared folder, sorted by list; the original vector lies beside the
code.

Probes: up to `measured` of the queries themselves, those of smallest id hash (all, if there are no more), are held against
every row of the index by brute force. The number of lists that a query probes is the smallest whose lists hold their k
nearest but for a fifth of the loss that `recall` admits. (The fit's own guess, from a third of its sample, holds only where
no query takes part.) A query whose lists hold fewer than k other rows probes on until they do.

Search: the query block (at most `block` queries a pass) is broadcast with its probes. For a run of rows, the asymmetric
distance tables (query parts against code words, made once a pass) give approximate cosines to the queries that probe their
lists. The `rerank` best of the run get exact double-precision cosines of the original vectors first; then all others whose
approximate cosine and left-out length, its largest error, reach the query's k-th best so far. So codes rule out what can't
be among the k and lose nothing: within the probed lists the search is exact, also among near copies, which codes can't
tell apart. Each task keeps k of a query. Of rows with equal vectors a run keeps only as many as can be among the k, those
of smallest id, so a crowd of equal vectors crowds nothing out.

Null ids, null vectors, zero vectors and vectors with null or non-finite components take no part. A query isn't held
against rows of its own id; rows that repeat an id are candidates one by one. Shorter vectors count as filled with zeros.
Empty tables give empty tables; other columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .vectors import Best, best_of_each, matrix, widened

FLAT = 2048
CELLS = 1 << 22  # rows by queries that a task scores at once


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows scaled to length 1, which rows aren't zero); scaled by their largest component first, against overflow."""
    high = np.abs(x).max(1, initial=0)
    ok = high > 0
    y = x / np.where(ok, high, 1)[:, None]
    return y / np.where(ok, np.sqrt((y * y).sum(1)), 1)[:, None], ok


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, CELLS // max(1, len(c)))
    c = c.astype(x.dtype, copy=False)
    size = (c * c).sum(1)[None, :]
    return np.concatenate([np.argmin(size - 2 * x[i : i + step] @ c.T, axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return x.copy()
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = nearest(x, c)
        order = np.argsort(at, kind="stable")
        n = np.bincount(at, minlength=k)
        some = np.nonzero(n)[0]
        c = c.copy()
        c[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some], axis=0) / n[some, None]
    return c


class Quantiser:
    def __init__(self, x: np.ndarray, lists: int, parts: int, k: int, recall: float, rounds: int = 8):
        self.width = x.shape[1]
        x = x.astype(np.float32)
        whole = x
        apart = x[::3] if len(x) >= 3 * 512 else x  # whoever was fitted has a closer centroid than others have
        x = x[np.arange(len(x)) % 3 > 0] if len(x) >= 3 * 512 else x
        self.groups = self.starts = None
        if not len(x):
            self.coarse = np.zeros((1, self.width), np.float32)
        elif lists <= FLAT:
            self.coarse = kmeans(x, min(lists, len(x)), rounds, 3)
        else:
            self.groups = kmeans(x, math.ceil(math.sqrt(lists)), rounds, 3)
            at = nearest(x, self.groups)
            of = [kmeans(own, max(1, round(lists * len(own) / len(x))), rounds, 3) if len(own := x[at == g]) else self.groups[g : g + 1] for g in range(len(self.groups))]
            self.starts = np.cumsum([0, *map(len, of)])
            self.coarse = np.concatenate(of)
        self.cuts = [self.width * i // parts for i in range(parts + 1)]
        some = x[: 1 << 13]
        rest = some - self.coarse[self.lists(some)]
        self.books = [kmeans(rest[:, a:b], 256, rounds, 5) if len(x) else np.zeros((1, b - a), np.float32) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.probes = self._probes(apart, k, recall if apart is not whole else 1 - (1 - recall) / 3)

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The list of each row, in double precision: single can't tell the centroids of near copies apart."""
        x = x.astype(np.float64)
        if self.groups is None:
            return nearest(x, self.coarse)
        out, group = np.zeros(len(x), np.int64), nearest(x, self.groups)
        for g in np.unique(group):
            own = np.nonzero(group == g)[0]
            out[own] = self.starts[g] + nearest(x[own], self.coarse[self.starts[g] : self.starts[g + 1]])
        return out

    def _probes(self, x: np.ndarray, k: int, recall: float) -> int:
        """The least number of lists that hold that share of the k nearest of some of these rows among them."""
        if len(x) < 2:
            return len(self.coarse)
        step = max(1, len(x) // 512)
        some = x[::step]
        sims = some @ x.T
        sims[np.arange(len(some)), np.arange(0, len(x), step)] = -2
        near = np.argpartition(-sims, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
        rank = np.argsort(np.argsort(self.distances(some), axis=1), axis=1)  # of each list for each query
        need = np.sort(rank[np.arange(len(some))[:, None], self.lists(x)[near]].ravel())
        return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1

    def distances(self, q: np.ndarray) -> np.ndarray:
        c = self.coarse.astype(np.float64)
        return (c * c).sum(1)[None, :] - 2 * q.astype(np.float64) @ c.T

    def encode(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code, and length of what the code leaves out, of each row of length 1."""
        x = u[:, : self.width]
        lists = self.lists(x)
        left = u.copy()
        left[:, : self.width] -= self.coarse[lists]
        codes = np.empty((len(u), len(self.books)), np.uint8)
        for j, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            codes[:, j] = nearest(left[:, a:b].astype(np.float32), book)
            left[:, a:b] -= book[codes[:, j]]
        return lists, codes, np.sqrt((left * left).sum(1))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(parts, words, queries): products of query parts and code words."""
        q = q.astype(np.float32)
        return np.stack([np.vstack([book @ q[:, a:b].T, np.zeros((256 - len(book), len(q)), np.float32)]) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)])

    def probed(self, u: np.ndarray, counts: np.ndarray, least: np.ndarray) -> np.ndarray:
        """(queries, lists): which lists a query probes, so many at least that they hold `least` rows."""
        order = np.argsort(self.distances(u[:, : self.width]), axis=1, kind="stable")
        held = np.cumsum(counts[order], axis=1)
        need = np.minimum((held < least[:, None]).sum(1) + 1, order.shape[1])
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, np.arange(order.shape[1])[None, :] < np.maximum(self.probes, need)[:, None], axis=1)
        return out


def fit(rows: DataFrame, spread: float, parts: int, sample: int, k: int, recall: float) -> Quantiser:
    n = rows.count()
    lists = max(1, round(spread * math.sqrt(n)))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(min(sample, max(12_288, 24 * lists))).toArrow().combine_chunks()
    _, x = matrix(some.to_batches()[0] if some.num_rows else pa.RecordBatch.from_pylist([], some.schema), "id", "v")
    x, ok = unit(x)
    return Quantiser(x[ok], min(lists, max(1, sample // 24)), parts, k, recall)


def build_index(rows: DataFrame, quantiser: Quantiser, run: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """The inverted file (list, id, code, left, v), written, dealt by list and salt, sorted by list; and the rows of each list."""
    shared = rows.sparkSession.sparkContext.broadcast(quantiser)

    def encode(batches):
        qz = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                ids, x = matrix(b.slice(lo, 4096), "id", "v", qz.width)
                u, ok = unit(x)
                if not ok.any():
                    continue
                ids, x, u = ids[ok], x[ok], u[ok]
                lists, codes, left = qz.encode(u)
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(ids), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left), pa.array(list(x), pa.list_(pa.float64()))], ["list", "id", "code", "left", "v"])

    coded = stash(rows.mapInArrow(encode, "list int, id long, code binary, left double, v array<double>"), "coded")
    counts = np.zeros(len(quantiser.coarse), np.int64)
    for x, n in coded.groupBy("list").count().collect():  # a row for each list
        counts[x] = n
    least = max(64, run // 8)
    salts = F.element_at(F.array(*(F.lit(int(-(-n // least)) or 1) for n in counts)), F.col("list") + 1) if len(counts) <= 512 else F.lit(None)
    if len(counts) > 512:
        few = rows.sparkSession.createDataFrame([(int(x), int(-(-counts[x] // least))) for x in np.nonzero(counts > least)[0]], "list int, salts long")
        coded = coded.join(F.broadcast(few), "list", "left")  # one row for each long list
        salts = F.coalesce("salts", F.lit(1))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // run))
    return stash(coded.repartition(parts, "list", F.pmod(F.xxhash64("id"), salts)).sortWithinPartitions("list", "id").select("list", "id", "code", "left", "v"), "index"), counts


def measured_probes(index: DataFrame, queries: DataFrame, quantiser: Quantiser, k: int, recall: float, measured: int) -> int:
    """The least number of lists that hold that share of the true k nearest of these queries, or of `measured` of them."""
    some = queries.orderBy(F.xxhash64("id"), "id").limit(measured).toArrow().combine_chunks()
    qid, q = matrix(some.to_batches()[0] if some.num_rows else pa.RecordBatch.from_pylist([], some.schema), "id", "v", quantiser.width)
    u, ok = unit(q)
    qid, u = qid[ok], u[ok]
    if not len(qid):
        return quantiser.probes
    shared = index.sparkSession.sparkContext.broadcast((qid, u))

    def scan(batches):
        qid, u = shared.value
        step = max(64, min(4096, CELLS // len(qid)))
        for b in batches:
            for part in (b.slice(i, step) for i in range(0, b.num_rows, step)):
                ids, x = matrix(part, "id", "v", u.shape[1])
                near = unit(x)[0] @ widened(u, x.shape[1]).T
                near[ids[:, None] == qid[None, :]] = -np.inf
                n = min(k, len(ids))
                at = np.argpartition(-near, n - 1, axis=0)[:n]
                rows, cols = at.ravel(), np.tile(np.arange(len(qid)), n)
                score = near[rows, cols]
                ok = score > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(cols[ok]), pa.array(part.column("list").to_numpy()[rows[ok]]), pa.array(ids[rows[ok]]), pa.array(score[ok])], ["q", "list", "id", "score"])

    hits = index.mapInArrow(scan, "q long, list int, id long, score double")
    nearest_ = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    true = np.array([tuple(r) for r in nearest_.select("q", "list").collect()], np.int64).reshape(-1, 2)  # k rows for each measured query
    if not len(true):
        return quantiser.probes
    place = np.argsort(np.argsort(quantiser.distances(u[:, : quantiser.width]), axis=1, kind="stable"), axis=1)  # of each list for each query
    need = np.sort(place[true[:, 0], true[:, 1]])
    return int(need[max(0, math.ceil(recall * len(need)) - 1)]) + 1


def kept_equals(x: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows without those that have `most` equal rows of smaller id."""
    _, same = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}").ravel(), return_inverse=True)
    if not len(same) or np.bincount(same).max() <= most:
        return np.arange(len(x))
    order = np.lexsort((ids, same))
    s = same[order]
    place = np.arange(len(s))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]]), place, 0))
    return np.sort(order[place - first < most])


def raised(held: np.ndarray, cols: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The k best scores of each query (k, queries), ascending, when these come to those held."""
    at = best_of_each(cols, score, len(held))
    c, place = cols[at], np.arange(len(at))
    more = np.full(held.shape, -np.inf)
    more[place - np.searchsorted(c, c), c] = score[at]
    return np.sort(np.concatenate([held, more]), axis=0)[len(held) :]


def search(index: DataFrame, counts: np.ndarray, queries: DataFrame, quantiser: Quantiser, k: int, rerank: int = 48, block: int = 16_384) -> DataFrame:
    spark = index.sparkSession
    passes = max(1, -(-queries.count() // block))
    out = None
    for p in range(passes):
        mine = queries.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p)
        got = mine.toArrow().combine_chunks()
        qid, q = matrix(got.to_batches()[0] if got.num_rows else pa.RecordBatch.from_pylist([], got.schema), "id", "v", quantiser.width)
        u, ok = unit(q)
        qid, q, u = qid[ok], q[ok], u[ok]
        own = dict(index.join(F.broadcast(mine.select("id").distinct()), "id", "left_semi").groupBy("id").count().collect())  # the block's ids
        own = np.array([own.get(int(i), 0) for i in qid], np.int64)
        shared = spark.sparkContext.broadcast((quantiser, qid, q, u, quantiser.probed(u, counts, own + k), int(own.max(initial=0)) + k))

        def scan(batches, shared=shared):
            qz, qid, q, u, probed, most = shared.value
            if not len(qid):
                return
            tables, base = qz.tables(u[:, : qz.width]), (u[:, : qz.width] @ qz.coarse.T).astype(np.float32)
            long_, found = np.sqrt((q * q).sum(1)), Best(k)
            held = np.full((k, len(qid)), -np.inf)  # the k best scores of each query so far, ascending
            slack = 3e-7 * (len(tables) + 4)  # what sums of single precision may be off by
            step = max(64, min(4096, CELLS // len(qid)))
            for b in batches:
                for part in (b.slice(i, step) for i in range(0, b.num_rows, step)):
                    ids, x = matrix(part, "id", "v", q.shape[1])
                    rows = kept_equals(x, ids, most)
                    ids, x, lists = ids[rows], x[rows], part.column("list").to_numpy()[rows]
                    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1)[rows]
                    left = part.column("left").to_numpy()[rows]
                    near = np.full((len(ids), len(qid)), -np.inf, np.float32)
                    cuts = [0, *(np.nonzero(np.diff(lists))[0] + 1).tolist(), len(lists)]
                    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                        who = np.nonzero(probed[:, lists[lo]])[0]
                        if len(who):
                            score = np.broadcast_to(base[who, lists[lo]], (hi - lo, len(who))).copy()
                            for j in range(codes.shape[1]):
                                score += tables[j][codes[lo:hi, j, None], who[None, :]]
                            near[lo:hi, who] = score
                    near[ids[:, None] == qid[None, :]] = -np.inf
                    qq, size = widened(q, x.shape[1]), np.sqrt((x * x).sum(1))

                    def exact(rows, cols, ids=ids, x=x, qq=qq, size=size):
                        nonlocal held
                        score = np.concatenate([(x[rows[i : i + 65536]] * qq[cols[i : i + 65536]]).sum(1) for i in range(0, len(rows), 65536)] or [np.zeros(0)]) / (size[rows] * long_[cols])
                        found.add(cols, score, ids[rows])
                        held = raised(held, cols, score)

                    n = min(rerank, len(ids))
                    at = np.argpartition(-near, n - 1, axis=0)[:n]
                    rows, cols = at.ravel(), np.tile(np.arange(len(qid)), n)
                    ok = near[rows, cols] > -np.inf
                    exact(rows[ok], cols[ok])
                    near[rows, cols] = -np.inf
                    able = near + (left[:, None] + slack).astype(np.float32) >= held[0][None, :]
                    able &= near > -np.inf
                    who, some = np.nonzero(able.any(0))[0], np.nonzero(able.any(1))[0]
                    if len(who):  # whole products first, the few that reach the k-th best exactly
                        able = able[np.ix_(some, who)] & ((x[some] / size[some, None]) @ (qq[who] / long_[who, None]).T >= held[0][who] - 1e-12)
                        rows, cols = np.nonzero(able)
                        exact(some[rows], who[cols])
            col, score, ids = found.all()
            for i in range(0, len(col), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(col[s]), pa.array(qid[col[s]]), pa.array(ids[s]), pa.array(score[s])], ["q", "query_id", "vec_id", "score"])

        hits = index.mapInArrow(scan, "q long, query_id long, vec_id long, score double")
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def nearest_neighbours(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vec: str = "embedding", k: int = 5, spread: float = 8.0, parts: int = 16, sample: int = 65_536, recall: float = 0.9, rerank: int = 48, measured: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score (cosine)."""
    rows, queries = (d.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vec}`").alias("v")) for d in (rows, queries))
    quantiser = fit(rows, spread, parts, sample, k, recall)
    index, counts = build_index(rows, quantiser)
    quantiser.probes = measured_probes(index, queries, quantiser, k, 1 - (1 - recall) / 5, measured)
    return search(index, counts, queries, quantiser, k, rerank)
