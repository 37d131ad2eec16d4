"""Mixing sources to target weights with hash-threshold histograms.

Each source has a budget in words. Whole copies come first: a budget of c times the source's size and a rest takes every
document c times, and some documents once more, until their sizes sum to the rest. Which ones is a matter of a 60-bit
hash of the document and a threshold for each source, so a larger budget takes a superset of a smaller one's
documents (nested thresholds), reruns agree, and nothing is sorted. The threshold is found by histograms: sizes are
summed by source and top hash bits; the bucket in which the running sum passes the rest is the boundary; only documents
in boundary buckets go on to the next histogram, with the next bits, `levels` times. In the end the boundary bucket is
taken whole if that is nearer to the rest than leaving it.

Text is read once, for sizes and hashes, which are written to the shared folder. Aggregations are map-side combined, so a
source that holds a third of all rows is 2**bits rows; the running sums work on at most 2**bits rows for each source. The
budgets need one row for each source.

Null texts have size 0. A null source is a source, last in order. Rows that repeat a document fall on the same side of
the threshold; so do all rows of a source with a null doc_id, which hash alike. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, stash

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
HASH_BITS = 60
#: Tables with a row for each source are broadcast up to this many rows, else joined by a shuffle.
MOST_SOURCES = 200_000


def n_words(text: str):
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(id_: str):
    """The first 60 bits of the MD5 of the id's text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{id_}`").cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, source_size, target from (source, source_size): shares of the total by weight, cut at `most` times a source's
    size, the excess shared anew by weight. That is target = min(level * weight, most * size) with the one level that
    makes targets sum to the total; sources are capped in the order of size / weight."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    every = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(every)).withColumn("w_all", F.sum("w").over(every))
    rows = rows.withColumn("level", (F.col("total") - F.col("capped_before")) / (F.col("w_all") - F.col("w_before")))
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(every)
    rows = rows.withColumn("the_level", level)
    return rows.select("source", "source_size", F.when(F.col("the_level").isNull() | (F.col("the_level") * F.col("w") > F.col("cap")), F.col("cap")).otherwise(F.col("the_level") * F.col("w")).alias("target"))


def thresholds(docs: DataFrame, plan: DataFrame, bits: int = 12, levels: int = 3) -> DataFrame:
    """source, source_size, target, copies, below: documents whose hash is under `below` are taken once more."""
    s = F.col("source_size")
    plan = plan.withColumn("copies", F.when(s > 0, F.floor(F.col("target") / s)).otherwise(F.lit(0)).cast("long"))
    state = plan.select("source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * s).alias("rest"), F.lit(0).cast("long").alias("low"))
    for level in range(levels):
        shift = HASH_BITS - bits * (level + 1)
        mine = docs.join(bounded(state.select(F.col("source").alias("s"), "low"), MOST_SOURCES), F.col("source").eqNullSafe(F.col("s")))
        if level:
            mine = mine.where(F.shiftright("hash", shift + bits) == F.shiftright("low", shift + bits))
        hist = mine.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("words").over(run)).join(bounded(state.select(F.col("source").alias("s"), "rest"), MOST_SOURCES), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        # the first bucket in which the running sum passes the rest; none if all buckets fit
        edge = hist.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", "upto", "words")).alias("e"))
        state = stash(
            state.join(edge.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "copies",
                F.when(F.col("e").isNull(), F.col("rest")).otherwise(F.col("rest") - (F.col("e.upto") - F.col("e.words"))).alias("rest"),
                F.when(F.col("e").isNull(), F.lit(1 << HASH_BITS)).otherwise(F.shiftleft("e.bucket", shift)).cast("long").alias("low"),
                F.coalesce("e.words", F.lit(0)).cast("long").alias("edge_words"),
            ),
            "thresholds",
        )
    step = 1 << (HASH_BITS - bits * levels)
    nearer = F.col("edge_words") - F.col("rest") < F.col("rest")
    whole = F.col("copies") * F.col("source_size") >= F.col("target")  # nothing is wanted beyond whole copies, not even empty texts
    return state.select("source", "source_size", "target", "copies", F.when(whole, F.lit(0).cast("long")).when(nearer, F.col("low") + step).otherwise(F.col("low")).alias("below"))


def mix(docs: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most: float = 3.0, bits: int = 12, levels: int = 3) -> DataFrame:
    """doc_id, source, size, hash, source_size, target, times, taken for each row."""
    rows = stash(docs.select(F.col(f"`{id_}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), n_words(text).alias("size"), doc_hash(id_).alias("hash")), "sizes")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    found = stash(thresholds(rows, stash(plan, "targets"), bits, levels).withColumnRenamed("source", "s"), "found")
    times = F.col("copies") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)
    return rows.join(bounded(found, MOST_SOURCES), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "hash", "source_size", "target", times.cast("long").alias("times"), (times * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most: float = 3.0, bits: int = 12, levels: int = 3) -> DataFrame:
    """docs, each as many times as the mix takes it, without a shuffle of texts: the thresholds alone are joined."""
    rows = stash(docs.select(F.col(f"`{source}`").alias("source"), n_words(text).alias("size"), doc_hash(id_).alias("hash")), "sizes")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    found = stash(thresholds(rows, stash(plan, "targets"), bits, levels).select(F.col("source").alias("__s"), F.col("copies").alias("__copies"), F.col("below").alias("__below")), "found")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names that can't clash with those used here
    times = F.col("__copies") + F.when(F.col("__hash") < F.col("__below"), 1).otherwise(0)
    out = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), doc_hash(id_).alias("__hash"))
    out = out.join(bounded(found, MOST_SOURCES), F.col(names[source]).eqNullSafe(F.col("__s"))).withColumn("__n", times)
    return out.where("__n > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*(F.col(n).alias(c) for c, n in names.items()))
