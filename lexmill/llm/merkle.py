"""Merkle manifest of a dataset, built and verified by message passing in supersteps.

Each document is a leaf of its source's tree: leaves ascend by doc_id (nulls first, then by digest), and runs of three are
hashed to their parent until one node is left; those nodes, ordered by source, are the leaves of a last tree whose top is the
dataset's root. The trees are grown as in Pregel, on RDDs keyed by (tree, place): in a superstep every node that isn't the
top of its tree sends its digest to its parent, a parent that has heard from all its children hashes them, and is itself a
child in the next superstep. What the parents have heard is the manifest, a table of `nodes`. Verification takes the
supersteps back down: the top sends each child the digests of its siblings, a child passes on what it got together with its
children's siblings, and what reaches a leaf is its proof: all digests that it takes to compute the root from the leaf alone.

Nodes are dealt to tasks by blocks: the 243 nodes, at most, under one node five levels up. Within a block five supersteps pass
their messages without a shuffle, then the block's top goes to the next block. So no source, however large, meets in one task,
and rows that are equal are told apart by where they stood. A document's place is that in a sort by ranges: partitions are counted,
and a place is the count of what stands before. One pass over the texts hashes them (twice where a tampered
text differs); the rest moves digests. Leaves, places and nodes are written tables, where a lost executor's work resumes.

Nulls in any column have a digest of their own (`-`); a null source is a source, a null doc_id a leaf that isn't tampered
with. Rows that repeat are leaves each. Empty tables have no leaves and no root: no rows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, stash

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Levels between two shuffles: a block holds the nodes under one node so many levels up, 243 at most.
STRIDE = 5
#: The tree whose leaves are the tops of all others.
TOP_TREE = -1
NODES = "tree long, level int, idx long, size long, digest binary, children array<binary>"


def digest_of(parts: list[bytes]) -> bytes:
    """Of digests, which enter as hex text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def framed(c: Column) -> Column:
    """A value with its length, so that no two rows of values run together alike."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, changed, at: the digest of each row, and the one after tampering, which deletes line feeds
    of the text where `tampered` holds (null where nothing changes). at: where the row stood."""
    cols = [F.col(f"`{c}`") for c in FIELDS]
    text = cols[-1]
    leaf = lambda t: F.unhex(F.sha2(F.concat(*map(framed, [*cols[:-1], t])), 256))
    changed = F.when(tampered & (F.instr(text, "\n") > 0), leaf(F.replace(text, F.lit("\n"), F.lit("")))) if tampered is not None else F.lit(None).cast("binary")
    return docs.select(cols[0].alias("doc_id"), cols[1].alias("source"), leaf(text).alias("leaf"), changed.alias("changed"), F.monotonically_increasing_id().alias("at"))


def ranked(rows: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """rows with idx, the place within the group by `order`, and size, the group's rows. Sorted by ranges; then only a row
    for each group and partition is counted up."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(group) if group else F.lit(0)
    sort = [*[group] * bool(group), *order]
    placed = stash(rows.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__key", key)
    own = Window.partitionBy("__key")
    counts = placed.groupBy("__key", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    counts = counts.select(F.col("__key").alias("__k"), F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(own).alias("size"))
    counts = bounded(stash(counts, "counts"), 200_000)
    joined = placed.join(counts, (F.col("__part") == F.col("__p")) & F.col("__key").eqNullSafe(F.col("__k")))
    return joined.select(*rows.columns, (F.col("__before") + F.col("__at") - F.col("__first")).alias("idx"), "size")


def complete(parent: int, sent: list[tuple[int, int, bytes]]) -> tuple[int, bytes, list[bytes]]:
    """A parent that has heard from its children, each with its place in the run, its level's size and its digest: the size
    of its own level, its digest, and theirs."""
    sent = sorted(sent)
    below = sent[0][1]
    if [s[0] for s in sent] != list(range(min(ARITY, below - ARITY * parent))):
        raise ValueError(f"node {parent} has heard from {len(sent)} children only")
    children = [s[2] for s in sent]
    return -(-below // ARITY), digest_of(children), children


def height(size: int) -> int:
    n = 0
    while size > 1:
        size, n = -(-size // ARITY), n + 1
    return n


def partitions(leaves_: int, level: int, most: int) -> int:
    """Levels shrink, and so do their partitions: 4,000 nodes each."""
    return max(1, min(most, leaves_ // ARITY**level // 4000))


def up_steps(block, base: int):
    """The supersteps of one block: nodes (tree, level, idx, size, digest, children) above those of level `base`."""
    (tree, _), sent = block
    now = {idx: (size, digest) for idx, size, digest in sent}
    for level in range(base + 1, base + STRIDE + 1):
        messages: dict[int, list] = {}
        for idx, (size, digest) in now.items():
            if size > 1:
                messages.setdefault(idx // ARITY, []).append((idx % ARITY, size, digest))
        now = {}
        for parent, got in messages.items():
            size, digest, children = complete(parent, got)
            now[parent] = size, digest
            yield tree, level, parent, size, digest, children


def grow(level: RDD, largest: int, total: int, most: int) -> list[RDD]:
    """The supersteps upward. level: (tree, idx, size, digest) of leaves; rows of nodes, STRIDE levels in each RDD."""
    out = []
    for base in range(0, height(largest), STRIDE):
        blocks = level.filter(lambda v: v[2] > 1).map(lambda v: ((v[0], v[1] // ARITY**STRIDE), v[1:])).groupByKey(partitions(total, base, most))
        done = blocks.flatMap(lambda b, base=base: up_steps(b, base))
        level = done.filter(lambda v, top=base + STRIDE: v[1] == top).map(lambda v: (v[0], v[2], v[3], v[4]))
        out.append(done)
    return out


def nodes_table(level: RDD, largest: int, total: int, spark) -> DataFrame:
    """The manifest of trees: tree, level, idx, size of the level, digest, children's digests; written out. The supersteps
    are one job, whose shuffles are what a lost executor's work restarts from."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = grow(level, largest, total, most)
    return stash(spark.createDataFrame(spark.sparkContext.union(rows) if rows else spark.sparkContext.emptyRDD(), NODES, verifySchema=False), "nodes")


def down_steps(block, base: int):
    """The reverse supersteps of one block: ((tree, idx), (top, path)) of its nodes of level `base`. A parent tells each child
    its place, its siblings and the parent's own path."""
    (tree, _), (nodes, arrived) = block
    children = {(level, idx): [bytes(c) for c in below] for level, idx, below in nodes}
    for level, idx, top, path in arrived:
        now = {idx: path}
        for at in range(level, base, -1):
            told = {}
            for parent, above in now.items():
                run = children[at, parent]
                for s in range(len(run)):
                    told[ARITY * parent + s] = bytes((s, len(run) - 1)) + b"".join(run[:s] + run[s + 1 :]) + above
            now = told
        for leaf, own in now.items():
            yield (tree, leaf), (top, own)


def send_down(nodes: DataFrame, starts: RDD, largest: int, total: int, most: int) -> RDD:
    """The supersteps downward. starts: ((tree, 0), (height, top, path)); ((tree, idx), (top, path)) of the leaves."""
    got = None
    for base in reversed(range(0, height(largest), STRIDE)):
        own = nodes.where((F.col("level") > base) & (F.col("level") <= base + STRIDE)).select("tree", "level", "idx", "children")
        own = own.rdd.map(lambda r, base=base: ((r[0], r[2] // ARITY ** (base + STRIDE - r[1])), (r[1], r[2], r[3])))
        here = starts.filter(lambda v, base=base: base < v[1][0] <= base + STRIDE).map(lambda v: (v[0], (v[1][0], 0, *v[1][1:])))
        if got is not None:
            here = here.union(got.map(lambda v, base=base: (v[0], (base + STRIDE, v[0][1], *v[1]))))
        got = own.cogroup(here, numPartitions=partitions(total, base, most)).flatMap(lambda b, base=base: down_steps(b, base))
    alone = starts.filter(lambda v: v[1][0] == 0).map(lambda v: (v[0], v[1][1:]))
    return alone if got is None else alone.union(got)


def climb(digest: bytes, path: bytes) -> tuple[bytes, bytes]:
    """(the root that a leaf and its path give, the digest of the path's digests)."""
    at, all_ = 0, []
    while at < len(path):
        slot, n = path[at], path[at + 1]
        siblings = [path[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]
        digest = digest_of([*siblings[:slot], digest, *siblings[slot:]])
        all_ += siblings
        at += 2 + 32 * n
    return digest, digest_of(all_)


class Manifest:
    """leaves: doc_id, source, leaf, changed, tree, idx, size. sources: tree, source, size, subroot. nodes and top_nodes: the
    trees of sources and the one above. root: hex, or None for an empty table."""

    def __init__(self, docs: DataFrame, tampered: Column | None = None):
        self.spark = spark = docs.sparkSession
        placed = ranked(stash(leaves(docs, tampered), "leaves"), "source", ["doc_id", "leaf", "at"]).drop("at")
        placed = stash(placed, "placed")
        sources = stash(ranked(placed.groupBy("source").agg(F.max("size").alias("n")), None, ["source"]).select(F.col("idx").alias("tree"), F.col("source").alias("__s"), "n", F.col("size").alias("n_sources")), "sources")
        self.leaves = placed.join(bounded(sources.select("tree", "__s"), 200_000), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
        self.total, self.largest, self.n_sources = sources.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
        vertices = self.leaves.select("tree", "idx", "size", "leaf").rdd.map(lambda r: (r[0], r[1], r[2], bytes(r[3])))
        self.nodes = nodes_table(vertices, self.largest, self.total, spark)
        tops = self.nodes.where("size = 1").select("tree", "digest").union(self.leaves.where("size = 1").select("tree", "leaf"))
        self.sources = stash(sources.join(tops.withColumnRenamed("tree", "__t").withColumnRenamed("digest", "subroot"), F.col("tree") == F.col("__t")).select("tree", F.col("__s").alias("source"), F.col("n").alias("size"), "subroot"), "tops")
        n = self.n_sources
        above = self.sources.select("tree", "subroot").rdd.map(lambda r: (TOP_TREE, r[0], n, bytes(r[1])))
        self.top_nodes = nodes_table(above, n, n, spark)
        root = self.top_nodes.where("size = 1").select("digest").union(self.sources.where(F.lit(n) == 1).select("subroot")).first()
        self.root = root and bytes(root[0]).hex()

    def proofs(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each leaf against the root, by its proof."""
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        if self.root is None:
            return self.spark.createDataFrame([], schema)
        n, root = self.n_sources, self.root
        start = self.spark.sparkContext.parallelize([((TOP_TREE, 0), (height(n), b"", b""))], 1)
        above = send_down(self.top_nodes, start, n, n, most).map(lambda v: (v[0][1], v[1][1]))
        tops = self.sources.select("tree", "size", "subroot").rdd.map(lambda r: (r[0], (r[1], bytes(r[2])))).join(above, partitions(n, 0, most))
        starts = tops.map(lambda v: ((v[0], 0), (height(v[1][0][0]), v[1][0][1], v[1][1])))
        paths = send_down(self.nodes, starts, self.largest, self.total, most)
        own = self.leaves.select("tree", "idx", "doc_id", "leaf", "changed").rdd.map(lambda r: ((r[0], r[1]), (r[2], bytes(r[3]), r[4] and bytes(r[4]))))

        def verify(v):
            (doc, leaf, changed), (top, path) = v[1]
            folded, proof = climb(changed or leaf, path)
            return doc, leaf.hex(), top.hex(), root, proof.hex(), folded.hex(), folded.hex() == root

        return self.spark.createDataFrame(own.join(paths, partitions(self.total, 0, most)).map(verify), schema, verifySchema=False)


def even_crc(c: Column) -> Column:
    """Where tampering is tried: ids whose decimal digits have an even checksum; never a null id."""
    return F.coalesce(F.crc32(c.cast("string")) % 2 == 0, F.lit(False))
