"""Double keys: candidates that would be right answers as well as the target. Keys of several kinds (family, spelling,
relation, head and tail of a phrase) name the pairs, by joins on the key; the kinds that a pair shares are ranked, and the
first one is its collision. Words that share no key make no pair, and a shared preposition alone names none, as it would
pair all words that take it; it is looked up for pairs that another key has named."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.forms import one_spelling

#: Prepositions that relate a phrase to its object, and particles that make another verb of one.
RELATING = ("to", "with", "into", "from", "of", "upon", "on", "for", "at", "by", "about", "as", "against", "between", "among", "towards", "toward", "in", "over")
#: Kinds, the first that holds counts; the last ones are no collision.
KINDS = ("double_key_family", "double_key_prep", "double_key_collocation", "double_key_slot", "frame_only", "none")


def collisions(words: DataFrame, family: DataFrame, near: DataFrame, preps: DataFrame, partners: DataFrame, others: DataFrame) -> DataFrame:
    """target, candidate, hit, kind of all pairs that share a key, both ways round.

    words: w. family: w, family. near: a, b (near-synonyms, either way round). preps: w, prep (that it governs). partners: w,
    partner (words it collocates with). others: a, b, pairs that a generator proposes besides.
    Words of one family or one spelling collide as family; near-synonyms that govern one preposition as prep, that share a
    partner as collocation, else as slot; proposed pairs that govern one preposition share a frame only. Of phrases of word
    and preposition, those with one head and two relating prepositions collide as prep, and so do those with one preposition
    and heads that are near-synonyms, or as family if the heads are of one family. Nulls and repeats do no harm."""
    w = words.select("w").where("w IS NOT NULL").distinct()
    two = lambda df: df.select("a", "b").union(df.select("b", "a")).where("a <> b").distinct()
    fam = w.join(family.select("w", "family"), "w")
    spelt = w.select("w", one_spelling(F.col("w")).alias("family"))
    same = None
    for keyed in (fam, spelt):
        pairs = keyed.select(F.col("w").alias("a"), "family").join(keyed.select(F.col("w").alias("b"), "family"), "family").where("a <> b").select("a", "b")
        same = pairs if same is None else same.union(pairs)
    inside = lambda df: df.join(w.withColumnRenamed("w", "a"), "a", "left_semi").join(w.withColumnRenamed("w", "b"), "b", "left_semi").select("a", "b")
    named = (
        same.distinct().withColumn("by", F.lit(0)).unionByName(inside(two(near)).withColumn("by", F.lit(1))).unionByName(inside(two(others)).withColumn("by", F.lit(2)))
        .groupBy("a", "b").agg(F.min("by").alias("by"))
    )
    p, c = preps.select("w", "prep").distinct(), partners.select("w", "partner").distinct()

    def shares(pairs: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
        """pairs with whether both have a key; keys are joined from both sides and counted, so no key's words meet."""
        both = pairs.select("a", "b").join(keys.select(F.col("w").alias("a"), key), "a").join(keys.select(F.col("w").alias("b"), key), ["b", key]).select("a", "b", F.lit(True).alias(flag)).distinct()
        return pairs.join(both, ["a", "b"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))

    j = shares(shares(named, p, "prep", "sp"), c, "partner", "sc")
    kind = F.when(F.col("by") == 0, KINDS[0]).when((F.col("by") == 1) & F.col("sp"), KINDS[1]).when((F.col("by") == 1) & F.col("sc"), KINDS[2]).when(F.col("by") == 1, KINDS[3]).when(F.col("sp"), KINDS[4]).otherwise(KINDS[5])
    single = j.select(F.col("a").alias("target"), F.col("b").alias("candidate"), kind.alias("kind"))

    of = p.join(w, "w", "left_semi")
    rel = of.where(F.col("prep").isin(*RELATING))
    phrase = lambda x, y: F.concat_ws(" ", x, y)
    heads = rel.select("w", F.col("prep").alias("p")).join(rel.select("w", F.col("prep").alias("q")), "w").where("p <> q").select(phrase("w", "p").alias("target"), phrase("w", "q").alias("candidate"), F.lit(KINDS[1]).alias("kind"))
    tails = named.where("by < 2").join(of.select(F.col("w").alias("a"), "prep"), "a").join(of.select(F.col("w").alias("b"), "prep"), ["b", "prep"])
    tails = tails.select(phrase("a", "prep").alias("target"), phrase("b", "prep").alias("candidate"), F.when(F.col("by") == 0, KINDS[0]).otherwise(KINDS[1]).alias("kind"))
    return single.unionByName(heads).unionByName(tails).select("target", "candidate", (~F.col("kind").isin(*KINDS[4:])).alias("hit"), "kind").distinct()
