"""Quotes brought back to the sentences they come from. A quote is a pointer (`[S-3]`), a sentence, a part of one, or most of
its words; what it snaps to is a sentence of its document's pool (doc_id, sid, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A pointer at the beginning of a quote or sentence; the least length of a part; the least share of words.
LEAD = r"(?i)^\s*\[?\bS-\d+\b\]?\s*"
POINTER = r"(?i)\bS-(\d+)\b"
LEAST_PART, LEAST_SHARE = 15, 0.75
TOKEN = r"([\p{L}\p{N}_]{3,})"


def bare(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), LEAD, ""))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(TOKEN), 1))


def snap(quotes: DataFrame, pool: DataFrame) -> DataFrame:
    """quotes (doc_id, quote_id, quote) with sid, rule and sentence: 1 the sentence a pointer names, 2 the sentence that the
    quote is but for case, 3 that it is a part of (15 characters and more, dots of omission left out), 4 that has three
    quarters and more of its words of three letters; of several the first, by rule 4 the one with most. Null where there is
    none, and for null and empty quotes. quote_id tells quotes of a document apart; rows that repeat it are taken together.

    One join by document; the best sentence of a quote is a minimum, combined map-side, so sentences are shuffled once. A
    sentence with three quarters of k words has one of any k - ceil(0.75 k) + 1 of them: the longest so many are seeds, and
    the words of a sentence that has none as a substring aren't looked at."""
    p = pool.select(F.col("doc_id").alias("d"), "sid", bare(F.col("text")).alias("sentence"))
    q = quotes.select("doc_id", "quote_id", F.trim("quote").alias("raw")).where("raw <> ''").dropDuplicates(["doc_id", "quote_id"])
    q = q.select("doc_id", "quote_id", F.regexp_extract("raw", POINTER, 1).try_cast("long").alias("no"), F.lower(bare(F.col("raw"))).alias("clean"))
    q = q.withColumn("part", F.trim(F.regexp_replace("clean", r"\.{3,}|…", ""))).withColumn("ts", tokens(F.col("part")))
    n = F.size("ts")
    by_length = F.transform(F.array_sort(F.transform("ts", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    q = q.withColumn("seeds", F.slice(by_length, 1, F.when(n > 0, n - F.ceil(n * LEAST_SHARE).cast("int") + 1).otherwise(0)))
    low = F.lower("sentence")
    early = F.when(F.col("no") == F.col("sid"), 1).when(F.col("clean") == low, 2).when((F.length("part") >= LEAST_PART) & F.contains(low, F.col("part")), 3)
    seeded = F.exists("seeds", lambda w: F.contains(low, w))
    share = F.when(F.col("early").isNull() & seeded, F.size(F.array_intersect("ts", tokens(low))) / n)
    pairs = q.join(p, F.col("doc_id") == F.col("d")).withColumn("early", early).withColumn("share", share).where((F.col("share") >= LEAST_SHARE) | F.col("early").isNotNull())
    pairs = pairs.select("doc_id", "quote_id", F.struct(F.coalesce("early", F.lit(4)).alias("rule"), (-F.coalesce("share", F.lit(0.0))).alias("less")).alias("r"), "sid", "sentence")
    got = pairs.groupBy(F.col("doc_id").alias("d"), F.col("quote_id").alias("i")).agg(F.min(F.struct("r", "sid", "sentence")).alias("best"))
    out = quotes.join(got, (quotes["doc_id"] == F.col("d")) & (quotes["quote_id"] == F.col("i")), "left")
    return out.select(quotes["*"], F.col("best.sid").alias("sid"), F.col("best.r.rule").alias("rule"), F.col("best.sentence").alias("sentence"))
