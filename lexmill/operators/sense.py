"""Sense evidence: cue scores, cue peers, the best senses of an item with their margin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import inflected_variants

#: What makes a choice certain.
SURE_SCORE, SURE_MARGIN = 8, 3


def cue_scores(items: DataFrame, cue: DataFrame) -> DataFrame:
    """item, host_word, sense_idx, score: summed weights of a host's cues among an item's tokens. Tokens under three letters
    and forms of the host itself are no cues. items: item, host_word, tokens (array)."""
    t = items.select("item", "host_word", F.explode(F.array_distinct(F.filter("tokens", lambda w: F.length(w) >= 3))).alias("cue_word"))
    hit = t.join(cue.where("sense_idx >= 0"), ["host_word", "cue_word"]).where(~F.array_contains(inflected_variants(F.col("host_word")), F.col("cue_word")))
    return hit.groupBy("item", "host_word", "sense_idx").agg(F.sum("weight").alias("score"))


def cue_peers(cue: DataFrame, least: int = 2, limit: int = 35, few: int = 8) -> DataFrame:
    """host_word, peer, n_cues, weight, place: hosts that share at least `least` distinct cues of their first sense, the
    most cues first, then weight, then word. Peers with blanks or hyphens are left out.

    A frequent cue is a cue of most hosts, so hosts aren't paired by cue. Each set of `least` cues and more of a host has a
    list of the `limit` + 1 first hosts that hold it, by their weight on that set, then by word: whoever is among the first
    peers of a host, and shares just that set with it, is in that list, as those before it share as much or more. So a host
    meets at most that many hosts for each of its sets. Hosts with over `few` cues have too many sets; tables that have
    such hosts are paired by cue."""
    c = cue.where("sense_idx = 0").groupBy("host_word", "cue_word").agg(F.sum("weight").alias("weight"))
    order = Window.partitionBy("host_word").orderBy(F.desc("n_cues"), F.desc("weight"), "peer")
    most = c.groupBy("host_word").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    if most > few:
        peer = c.where(~F.col("host_word").rlike("[ -]")).select(F.col("host_word").alias("peer"), "cue_word", F.col("weight").alias("pw"))
        pairs = c.select("host_word", "cue_word").join(peer, "cue_word").where("host_word <> peer")
        g = pairs.groupBy("host_word", "peer").agg(F.count_distinct("cue_word").alias("n_cues"), F.sum("pw").alias("weight")).where(F.col("n_cues") >= least)
        return g.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    own = c.groupBy("host_word").agg(F.sort_array(F.collect_list(F.struct("cue_word", "weight"))).alias("cues")).where(F.size("cues") >= least)
    # a number whose bits choose cues, for each set
    sets = own.withColumn("m", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2.0), F.size("cues")).cast("int") - 1))).where(F.bit_count("m") >= least)
    part = F.filter("cues", lambda x, i: F.call_function("shiftright", F.col("m"), i).bitwiseAND(F.lit(1)) == 1)
    sets = sets.select("host_word", part.alias("part")).select("host_word", F.col("part.cue_word").alias("shared"), F.aggregate("part.weight", F.lit(0).cast("long"), lambda a, x: a + x).alias("weight"))
    first = sets.where(~F.col("host_word").rlike("[ -]")).select(F.col("host_word").alias("peer"), "shared", "weight")
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("shared").orderBy(F.desc("weight"), "peer"))).where(F.col("n") <= limit + 1)
    met = sets.select("host_word", "shared").join(first, "shared").where("host_word <> peer")
    g = met.groupBy("host_word", "peer").agg(F.max(F.struct(F.size("shared").cast("long").alias("n_cues"), "weight")).alias("b")).select("host_word", "peer", "b.n_cues", "b.weight")
    return g.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def overlap(a: Column, b: Column) -> Column:
    """Number of distinct tokens that both arrays hold."""
    return F.size(F.array_intersect(a, b))


def overlap_ratio(a: Column, b: Column, stop: Column) -> Column:
    """Shared content tokens over the smaller set; stop words count where nothing else remains."""

    def content(x: Column) -> Column:
        kept = F.array_except(x, stop)
        return F.when(F.size(kept) > 0, kept).otherwise(F.array_distinct(x))

    x, y = content(a), content(b)
    return F.when(F.least(F.size(x), F.size(y)) > 0, F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))).otherwise(0.0)


def lock(features: DataFrame, k: int = 1, weights: dict[str, float] | None = None) -> DataFrame:
    """The k best senses of an item: features are summed by weight, an earlier sense is worth half a point more, the first
    of equal ones wins. margin: lead over the next; sure: the only sense, or a score from 8 with a margin from 3.
    features: item, sense_idx and a column for each feature."""
    cols = weights or {c: 1.0 for c in features.columns if c not in ("item", "sense_idx")}
    score = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in cols.items()), F.lit(0.0)) - F.col("sense_idx") * 0.5
    order = Window.partitionBy("item").orderBy(F.desc("score"), "sense_idx")
    s = features.select("item", "sense_idx", score.alias("score"))
    s = s.withColumns({"place": F.row_number().over(order), "next": F.lead("score").over(order), "n": F.count(F.lit(1)).over(Window.partitionBy("item"))})
    margin = F.col("score") - F.col("next")
    sure = (F.col("n") == 1) | ((F.col("score") >= SURE_SCORE) & (F.coalesce(margin, F.lit(0.0)) >= SURE_MARGIN))
    return s.where(F.col("place") <= k).select("item", "sense_idx", "score", "place", margin.alias("margin"), sure.alias("sure"))
