"""Near copies: SimHash near-dedup for documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words are those of `simhash`: A-Z lower-cased, parted by ASCII blanks. Texts under k words are one shingle; null and
wordless texts have the empty set and are copies of one another. A shingle is a 64-bit hash.

Documents of equal sets link to the one of smallest doc_id, which alone goes on. Candidates come from two searches. The
vantage-point trees of `simhash` find fingerprints (of k-word shingles) within `radius` bits. At a similarity of 0.8 these
differ in some ten of 64 bits, beyond what trees can prune, so MinHash finds the rest: pairs that agree in all ROWS MinHash
values of one of BANDS bands; a pair of similarity s is missed with a chance of (1 - s**4)**32, which is 5e-8 at 0.8.

A candidate pair goes on if enough of one byte each of all 128 MinHash values are equal (`least_equal`; under 1e-5 of pairs of
similarity 0.8 fail that, hardly any below 0.55 pass) and if its parity maps allow it: a map has a bit for each of 4,096
residues, set if an odd number of shingles has it, so bits in which two maps differ are at most the shingles in which two
sets do, and too many of them rule a link out for certain. It links if its exact similarity is high enough. Candidates are
taken in three turns, each without the pairs that earlier ones connected: what the trees found, and each document with the
smallest doc_id of all its buckets; each document with the smallest doc_id of each bucket; pairs of different components
within a bucket. There both tests are part of the join, so that a dense bucket makes no row for each pair, the component that
most of a bucket belongs to isn't compared with itself, and a bucket of more than CELL documents is dealt to several tasks.
Components are those of `simhash.stars`.

Bands and tests hold for similarities of 0.75 and more (a miss of 5e-6 at 0.75); a lower `least` is refused.

Rows that repeat a doc_id are one document with the links of all its rows. Rows with a null doc_id stay. Empty tables give
empty tables; columns of any name pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, stash, text_slices
from .simhash import fingerprint, mixed, similar_links, stars

BANDS, ROWS = 32, 4
_rng = np.random.default_rng(11)
TURNS, ADDS = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64) | np.uint64(1), _rng.integers(0, 2**63, BANDS * ROWS, np.uint64)
PIECE = 1 << 10
STEP = 256  # rows that leave a Python worker at once
LONGS = BANDS * ROWS // 8
PARITY = 1 << 12  # bits of a parity map
LOWEST = 0.75
CELL = 2048


def shingles(text: bytes | None, k: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n, span = max(1, len(h) - k + 1), min(k, len(h))
    out = np.full(n, span, np.uint64)  # a short text is no prefix of a longer shingle
    for i in range(span):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def minima(s: np.ndarray) -> np.ndarray:
    """The MinHash values of a set."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(s), PIECE):
        x = s[i : i + PIECE, None] * TURNS
        x += ADDS
        np.minimum(low, x.min(0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """One hash for each band of MinHash values."""
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + low[r::ROWS])
    return out


def parity(s: np.ndarray) -> np.ndarray:
    """The parity map of a set, as longs."""
    odd = np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def least_equal(least: float) -> int:
    """Of 128 bytes, how many are equal at the similarity `least`, less 4.5 standard deviations."""
    p = least + (1 - least) / 256
    return int(128 * p - 4.5 * (128 * p * (1 - p)) ** 0.5)


def alike(a: str, b: str, least: float) -> Column:
    """Whether enough bytes of two signatures (arrays of longs) are equal: of a byte's bits some is set in the exclusive or if
    they differ."""
    equal = F.lit(0)
    for i in range(LONGS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for n in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, n))
        equal = equal + 8 - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return equal >= least_equal(least)


def allowed(a: str, b: str, na: str, nb: str, least: float) -> Column:
    """Whether the parity maps of two sets of so many shingles allow a similarity of `least`: sets of similarity s differ in
    (1 - s) / (1 + s) of all their shingles, counted in each."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n)
    return differ * (1 + least) <= (F.col(na) + F.col(nb)) * (1 - least) + 1e-3


def _steps(batches):
    for b in batches:
        for i in range(0, b.num_rows, STEP):
            yield b.slice(i, STEP)


def _texts(docs: DataFrame, id_: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id_}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("__t")).where("doc_id IS NOT NULL")


def signatures(docs: DataFrame, id_: str, text: str, k: int) -> DataFrame:
    """doc_id, key (of the whole set), fp (fingerprint), size, bands, sig and map (none for an empty set)."""

    def run(batches):
        for b in _steps(batches):
            texts = [t for _, t in text_slices(b, "__t")]
            sets = [shingles(t, k) for t in texts]
            lows = [minima(s) if len(s) else None for s in sets]
            keys = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())
            fps = np.fromiter((fingerprint(t, k) for t in texts), np.uint64, len(texts)).view(np.int64)
            of = lambda f: pa.array([[] if x is None else f(x).view(np.int64) for x in lows], pa.list_(pa.int64()))
            maps = pa.array([parity(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), keys, pa.array(fps), sizes, of(bands), of(lambda x: mixed(x).astype(np.uint8)), maps], ["doc_id", "key", "fp", "size", "bands", "sig", "map"])

    return _texts(docs, id_, text).mapInArrow(run, "doc_id long, key binary, fp long, size long, bands array<long>, sig array<long>, map array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, id_: str, text: str, k: int, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least `least`."""

    def sets(batches):
        for b in _steps(batches):
            found = [shingles(t, k).tobytes() for _, t in text_slices(b, "__t")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(xxhash.xxh128_digest, found), pa.binary()), pa.array(found, pa.binary())], ["doc_id", "key", "s"])

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("s"), b.column("t"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    own = _texts(docs, id_, text).join(ids, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, key binary, s binary")
    own = stash(own.repartition("doc_id").dropDuplicates(["doc_id", "key"]).drop("key"), "shingles")
    both = pairs.join(own.withColumnRenamed("doc_id", "a"), "a").join(own.select(F.col("doc_id").alias("b"), F.col("s").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(compare, "a long, b long")


def near_links(docs: DataFrame, id_: str = "doc_id", text: str = "text", k: int = 5, least: float = 0.8, radius: int = 3) -> DataFrame:
    """Links (a, b) between doc_ids, enough to connect all near copies."""
    if not LOWEST <= least <= 1:
        raise ValueError(f"least is {least}; it must be from {LOWEST} to 1")
    signed = stash(signatures(docs, id_, text, k), "signatures")
    reps = signed.groupBy("key").agg(F.min("doc_id").alias("rep"))
    same = signed.select("doc_id", "key").join(reps, "key").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    first = stash(signed.join(reps, (signed["key"] == reps["key"]) & (signed["doc_id"] == reps["rep"]), "left_semi").where("size(bands) > 0").dropDuplicates(["doc_id", "key"]), "first")
    sigs = first.select("doc_id", "sig", "map", "size")
    named_by = lambda df, d: df.select(F.col("doc_id").alias(d), *(F.col(c).alias(c[0] + d) for c in df.columns if c != "doc_id"))
    passes = alike("sa", "sb", least) & allowed("ma", "mb", "na", "nb", least)

    def tested(pairs: DataFrame) -> DataFrame:
        """The pairs that pass both tests, confirmed."""
        own = sigs.withColumnRenamed("size", "n")
        both = pairs.join(named_by(own, "a"), "a").join(named_by(own, "b"), "b")
        passed = stash(both.where(passes).select("a", "b").distinct(), "pairs")
        return stash(confirmed(passed, docs, id_, text, k, least), "near")

    def joined(d: DataFrame, of: str, root: str, roots: DataFrame) -> DataFrame:
        """d with the root of column `of`; itself where it has no links."""
        return d.join(roots.withColumnRenamed("root", "__r"), d[of] == roots["node"], "left").withColumn(root, F.coalesce("__r", of)).drop("node", "__r")

    prints = stash(first.groupBy("fp").agg(F.min("doc_id").alias("rep")), "prints")
    crowd = first.select("doc_id", "fp").join(prints, "fp").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    trees = stash(similar_links(prints.select("fp"), radius), "trees")
    trees = trees.join(prints.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))

    entries = first.select("doc_id", F.explode("bands").alias("h")).distinct()
    lows = entries.groupBy("h").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    held = stash(entries.join(lows.drop("n"), "h"), "buckets")
    lowest = held.groupBy("doc_id").agg(F.min("low").alias("b")).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    one = tested(crowd.unionByName(trees).unionByName(lowest).where("a <> b").distinct())
    roots = stars(one)

    rest = joined(joined(held.where("doc_id <> low"), "doc_id", "ra", roots), "low", "rb", roots).where("ra <> rb")
    two = tested(rest.select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct())
    roots = stars(one.unionByName(two))

    named = joined(held, "doc_id", "root", roots)
    shares = named.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"))
    open_ = shares.groupBy("h").agg(F.max(F.struct("c", "root"))["root"].alias("major"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("roots")).where("roots > 1 AND all > 2")
    cells = F.ceil(F.col("all") / CELL).cast("int")
    named = stash(named.join(open_.select("h", "major", cells.alias("cells")), "h").join(sigs.withColumnRenamed("size", "n"), "doc_id"), "open")
    of = lambda d: [F.col("doc_id").alias(d), *(F.col(c).alias(c[0] + d) for c in ("root", "low", "sig", "map", "n"))]
    x = named.where("root <> major").select(F.col("h").alias("hx"), F.pmod(F.xxhash64("doc_id"), "cells").cast("int").alias("cx"), "major", *of("a"))
    y = named.select(F.col("h").alias("hy"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cy"), *of("b"))
    # each pair of two small components from its larger doc_id; pairs with the lowest document were tested before
    once = ((F.col("rb") == F.col("major")) | (F.col("a") > F.col("b"))) & (F.col("ra") != F.col("rb")) & (F.col("a") != F.col("la")) & (F.col("b") != F.col("lb"))
    found = x.join(y, (F.col("hx") == F.col("hy")) & (F.col("cx") == F.col("cy")) & once & passes)
    rest = stash(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    three = stash(confirmed(rest, docs, id_, text, k, least), "near")
    return one.unionByName(two).unionByName(three).unionByName(same)


def drop_near_copies(docs: DataFrame, id_: str = "doc_id", text: str = "text", k: int = 5, least: float = 0.8, radius: int = 3, broadcast_rows: int = 4_000_000) -> DataFrame:
    """docs with one document, the one of smallest doc_id, of each component."""
    gone = stars(near_links(docs, id_, text, k, least, radius)).select(F.col("node").alias("__gone")).distinct()
    gone = bounded(stash(gone, "duplicates"), broadcast_rows)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    left = inner.join(gone, F.col(names[id_]).cast("long") == F.col("__gone"), "left_anti")
    return left.select(*(F.col(n).alias(c) for c, n in names.items()))
