"""SimHash near-dedup with vantage-point trees.

Fingerprint: 64 bits; a bit is set if it is set in over half of the XXH64 hashes (seed 42) of a text's word shingles,
repeats included. Texts link if their fingerprints differ in at most `radius` bits; a component is what links reach.

Search works on distinct fingerprints. A fingerprint is two 32-bit halves, and of two fingerprints within r bits, one
half is within floor(r / 2) bits: so there is one vantage-point tree for each half, with that smaller radius, which
leaves far fewer branches open than one tree over 64 bits would. Each tree is built on the driver from a sample that grows
with the number of shards (at most `sample`, 2**20 fingerprints). Its nodes hold a vantage point and a median distance; its
leaves are the shards. A fingerprint lives in one shard of each tree. As a query it goes, by the triangle bounds
|d - median| <= radius, to each shard that its ball overlaps; there it is held against the shard's fingerprints with the
exact 64-bit distance. In a shard the residents are in memory and the queries stream past in sorted order. A shard of more
than twice `leaf` residents, as where fingerprints crowd in one ball, or where the sample can't part them any further, is
cut into slices of about `leaf` residents by hash, which go to tasks of their own; its queries go to each slice.

A shard returns no pairs but a spanning forest of what it linked: at most one link for each resident and query, however
dense a group is. Connected components are then found by alternating large-star and small-star rounds, joins and
aggregations over links alone, written to the shared folder each round. Nothing but the sample reaches the driver.

Null and wordless texts have fingerprint zero and link as any other. Texts under k words are one shingle. Rows that
repeat a doc_id are one document with the links of all its rows. Rows with a null doc_id have the component of the rows
that share or link to their fingerprint; if none of those has an id, it is null. Empty tables give empty tables.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, stash, text_slices

SEED = 42
PIECE = 1 << 16


def fingerprint(text: bytes | None, k: int = 3) -> int:
    words = (text or b"").lower().split()  # bytes: A-Z alone are lower-cased, and the blanks are x20 and x09-x0D
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - k + 1)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[: n - 1]]
    digest = xxhash.xxh64_intdigest
    ends = ends[len(words) - n :]
    over = np.zeros(64, np.int64)
    for i in range(0, n, PIECE):
        h = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[i : i + PIECE], ends[i : i + PIECE], strict=True)], dtype="<u8")
        over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(over * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """(doc_id, fp), the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, k) for _, t in text_slices(b, "__t")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(f"`{id_}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("__t")).mapInArrow(run, "doc_id long, fp long")


def _half(fp: np.ndarray, tree: int) -> np.ndarray:
    return (fp.view(np.uint64) >> np.uint64(32 * tree)).astype(np.uint32)


class VantageTree:
    """A complete binary tree over 32-bit halves; node i has the children 2i + 1 (within the median) and 2i + 2."""

    def __init__(self, sample: np.ndarray, levels: int, radius: int, tries: int = 24):
        self.levels, self.radius = levels, radius
        self.points = np.zeros(2**levels - 1, np.uint32)
        self.medians = np.full(2**levels - 1, 16, np.int16)
        rng = np.random.default_rng(7)
        held: dict[int, np.ndarray] = {0: sample}
        for i in range(len(self.points)):
            own, few = held.pop(i), max(4, tries - (i + 1).bit_length())
            if len(own):
                best = (2.0, 0, 16)
                for v in own[rng.integers(0, len(own), min(few, len(own)))]:
                    d = np.bitwise_count(own ^ v)
                    m = int(np.sort(d)[(len(d) - 1) // 2])
                    # the share of queries in both branches, and how far from even the residents are
                    bad = float(np.mean((d >= m - radius + 1) & (d <= m + radius)) + 2 * abs(np.mean(d <= m) - 0.5))
                    best = min(best, (bad, int(v), m))
                self.points[i], self.medians[i] = best[1], best[2]
            near = np.bitwise_count(own ^ self.points[i]) <= self.medians[i]
            held[2 * i + 1], held[2 * i + 2] = own[near], own[~near]

    def home(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.levels):
            at = 2 * at + 1 + (np.bitwise_count(x ^ self.points[at]) > self.medians[at])
        return at - len(self.points)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in x, leaves) for each leaf that the ball round x[place] overlaps."""
        who, at = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.levels):
            d = np.bitwise_count(x[who] ^ self.points[at]).astype(np.int16)
            near, far = d - self.radius <= self.medians[at], d + self.radius > self.medians[at]
            who, at = np.concatenate([who[near], who[far]]), np.concatenate([2 * at[near] + 1, 2 * at[far] + 2])
        return who, at - len(self.points)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads each bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Forest:
    """Union-find over the residents of a shard."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def roots(self) -> np.ndarray:
        while not np.array_equal(above := self.up[self.up], self.up):
            self.up = above
        return self.up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        roots = self.roots()
        a, b = roots[a], roots[b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        for pair in np.unique((low * len(roots) + high)[low != high]):
            x, y = self.find(int(pair // len(roots))), self.find(int(pair % len(roots)))
            self.up[max(x, y)] = min(x, y)


class Shard:
    def __init__(self, residents: np.ndarray, radius: int):
        self.fp, self.radius, self.forest = residents, radius, Forest(len(residents))

    def query(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links (query, resident), at most one for each query; further residents that it meets become one tree."""
        out = []
        step = max(1, (1 << 21) // max(1, len(self.fp)))
        for i in range(0, len(q), step):
            part = q[i : i + step]
            near = np.bitwise_count(part[:, None].view(np.uint64) ^ self.fp[None, :].view(np.uint64)) <= self.radius
            rows, cols = np.nonzero(near)
            first = np.zeros(len(part), np.int64)
            first[rows[::-1]] = cols[::-1]
            self.forest.join(cols, first[rows])
            hit = np.unique(rows)
            out.append((part[hit], self.fp[first[hit]]))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        roots = self.forest.roots()
        odd = np.nonzero(roots != np.arange(len(roots)))[0]
        return self.fp[odd], self.fp[roots[odd]]


def crowded_shards(distinct: DataFrame, shared, leaf: int) -> dict[int, int]:
    """The slices of each shard with more than twice `leaf` residents."""

    def count(batches):
        total: dict[int, int] = {}
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            for t, tree in enumerate(shared.value):
                for at, n in zip(*np.unique(tree.home(_half(fp, t)), return_counts=True), strict=True):
                    total[int(at) * 2 + t] = total.get(int(at) * 2 + t, 0) + int(n)
        keys = list(total)
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)], pa.int64()), pa.array([total[k] for k in keys[i : i + (1 << 16)]], pa.int64())], ["shard", "n"])

    big = distinct.select("fp").mapInArrow(count, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * leaf)
    return {r["shard"]: -(-r["n"] // leaf) for r in big.collect()}  # at most a row for each 2 * leaf fingerprints


SLICES = 20  # bits of a shard's key that number its slices


def similar_links(distinct: DataFrame, radius: int = 3, leaf: int = 4096, sample: int = 1 << 20) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), enough to connect all that differ in <= radius bits."""
    spark, n = distinct.sparkSession, distinct.count()
    levels = max(0, math.ceil(math.log2(max(1, n) / leaf)))
    levels = min(levels, int(math.log2(sample)) - 3)  # eight of the sample to a leaf; slices do the rest
    size = min(sample, max(8192, 8 << levels))
    few = distinct.where(F.xxhash64("fp") < int(min(1.0, 1.5 * size / max(1, n) + 1e-9) * 2**64) - 2**63) if n > 2 * size else distinct
    some = few.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(size).toArrow().column("fp").to_numpy()
    trees = [VantageTree(_half(some, t), levels, radius // 2) for t in range(2)]
    shared = spark.sparkContext.broadcast(trees)
    crowded = spark.sparkContext.broadcast(crowded_shards(distinct, shared, leaf))

    def route(batches):
        slices = crowded.value
        many = np.array(sorted(slices), np.int64)
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            own = mixed(fp.view(np.uint64))
            for t, tree in enumerate(shared.value):
                half = _half(fp, t)
                home = tree.home(half)
                who, at = tree.visits(half)
                shard, guest = at * 2 + t, home[who] != at
                out = [(shard << SLICES, guest, who)]
                if len(many):
                    split = np.isin(shard, many)
                    out = [tuple(x[~split] for x in out[0])]
                    for s in np.unique(shard[split]):
                        k, here = slices[int(s)], np.nonzero(shard == s)[0]
                        lives = np.where(guest[here], -1, (own[who[here]] % np.uint64(k)).astype(np.int64))
                        for piece in range(k):
                            out.append((np.full(len(here), (int(s) << SLICES) | piece), lives != piece, who[here]))
                for keys, g, w in out:
                    for i in range(0, len(w), 1 << 16):
                        c = slice(i, i + (1 << 16))
                        yield pa.RecordBatch.from_arrays([pa.array(keys[c]), pa.array(g[c].astype(np.int8)), pa.array(fp[w[c]])], ["shard", "guest", "fp"])

    def search(batches):
        """A partition holds whole shards one after another, each with its residents first."""
        now, own, shard = None, [], None

        def flush():
            nonlocal own, shard
            if shard is None and own:
                shard = Shard(np.concatenate(own), radius)
                own = []
                yield from emit(shard.query(shard.fp))

        def emit(pair):
            keep = pair[0] != pair[1]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(pair[0][keep]), pa.array(pair[1][keep])], ["a", "b"])

        for b in batches:
            ids, guest, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "guest", "fp"))
            cuts = [0, *(np.nonzero(np.diff(ids))[0] + 1), len(ids)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if ids[lo] != now:
                    yield from flush()
                    if shard is not None:
                        yield from emit(shard.links())
                    now, own, shard = ids[lo], [], None
                g = guest[lo:hi] == 1
                if not g.all():
                    own.append(fp[lo:hi][~g])
                if g.any():
                    yield from flush()
                    if shard is not None:
                        yield from emit(shard.query(fp[lo:hi][g]))
        yield from flush()
        if shard is not None:
            yield from emit(shard.links())

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 16, 2 ** (levels + 1) + sum(crowded.value.values())))
    routed = distinct.select("fp").mapInArrow(route, "shard long, guest tinyint, fp long")
    return routed.repartition(parts, "shard").sortWithinPartitions("shard", "guest").mapInArrow(search, "a long, b long")


def stars(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for each node of a link but the roots themselves; a root is the smallest node of its component.
    Large-star and small-star rounds alternate until nothing changes. Each is an aggregation (map-side combined) and a
    join over links, which AQE splits at hubs; no list of neighbours is ever collected."""
    e = stash(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stash(small_.unionByName(low.withColumnRenamed("m", "v")).distinct(), "links")
        n, total = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (n, total)
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def components(docs: DataFrame, id_: str = "doc_id", text: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row."""
    fps = stash(fingerprints(docs, id_, text, k), "fingerprints")
    reps = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    star = stars(similar_links(reps.select("fp"), radius))
    linked = stash(star.unionByName(star.select(F.col("root").alias("node"), "root").distinct()), "linked")
    lowest = linked.join(reps, linked["node"] == reps["fp"]).groupBy("root").agg(F.min("rep").alias("low"))
    names = linked.join(lowest, "root").select(F.col("node").alias("fp"), "low")
    # repeated fingerprints that link to no other are named by their own smallest doc_id
    named = stash(reps.join(names, "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id")), "names")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", k: int = 3, radius: int = 3, broadcast_rows: int = 4_000_000) -> DataFrame:
    """docs with one document, the one of smallest doc_id, of each component."""
    gone = components(docs, id_, text, k, radius).where("doc_id <> component_id").select("doc_id").distinct()
    gone = bounded(stash(gone, "duplicates"), broadcast_rows)
    return docs.join(gone, docs[id_].cast("long") == gone["doc_id"], "left_anti")
