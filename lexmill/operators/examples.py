"""Example sentences for words and phrases, by an inverted index with positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut

#: Words that spoil an example, its ends, and the lengths that suit one best.
GRITTY = r"(?i)\b(?:sleazy|corpse|murder|sex|sexy|bastard|damn|hell|suicide|prostitute|whore|bitch|shit|fuck|piss|rape|cocaine|heroin)\b"
ENDS = r"[.!\"']$"
SHORT, LONG, IDEAL = 40, 135, 85
LEAST = 8
WORD = r"([a-z0-9_-]{2,})"
#: A word's postings are dealt to so many parts, as some words are in every other sentence; hits up to so many are broadcast.
SALTS = 16
MOST_HITS = 200_000
#: Texts are dealt to so many buckets by hash, to find how good the best `limit` of them are.
BUCKETS = 64


def index(pool: DataFrame) -> DataFrame:
    """w, doc_id, sid, places: the words of two characters and more of each sentence (doc_id, sid, text) longer than LEAST
    characters, with the places at which they stand, found where the sentence is. Dealt and sorted by word, so that a table
    made of it answers a word from one of its parts; one shuffle."""
    ws = F.regexp_extract_all(F.lower("text"), F.lit(WORD), 1)
    by_word = lambda ws: F.transform(F.array_distinct(ws), lambda w: F.struct(w.alias("w"), F.filter(F.transform(ws, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()).alias("places")))
    made = F.element_at(F.transform(F.array(ws), by_word), 1)
    rows = pool.where(F.length("text") > LEAST).select("doc_id", "sid", F.explode(made).alias("x")).select("x.w", "doc_id", "sid", "x.places")
    return rows.repartition("w", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).sortWithinPartitions("w", "doc_id", "sid")


def rank(text: Column, exact: Column) -> Column:
    """The lower the better: the phrase as it stands, nothing gritty, a statement, a middling length."""
    n = F.length(text)
    return F.struct((~exact).cast("int").alias("a"), text.rlike(GRITTY).cast("int").alias("b"), (~text.rlike(ENDS)).cast("int").alias("c"), F.when(n.between(SHORT, LONG), 0).otherwise(F.abs(n - IDEAL)).alias("d"))


def search(queries: DataFrame, idx: DataFrame, pool: DataFrame, limit: int = 3) -> DataFrame:
    """query_id, place, doc_id, sid, exact, text: the best `limit` sentences for each query (query_id, query), those with
    all its words; exact if they stand one after another. Ties go to the smaller doc_id, then sid; of equal texts the first counts. A query's rarest word
    names the candidates, which the postings of its other words then narrow by joins on word and sentence; the texts are
    read for what is left alone. Null queries and those without a word find nothing; a word asked for twice must stand twice
    only in an exact match."""
    q = queries.select("query_id", F.regexp_extract_all(F.lower("query"), F.lit(WORD), 1).alias("ws")).where("size(ws) > 0").dropDuplicates(["query_id"])
    tok = q.select("query_id", F.size("ws").alias("n"), F.size(F.array_distinct("ws")).alias("kinds"), F.posexplode("ws").alias("k", "w"))
    wanted = idx.join(tok.select("w").distinct(), "w", "left_semi")
    df = wanted.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    tok = tok.join(df, "w", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = tok.groupBy("query_id").agg(F.min(F.struct("df", "w"))["w"].alias("w"))
    start = rare.join(wanted.select("w", "doc_id", "sid"), "w").select("query_id", "doc_id", "sid")
    hit = start.join(tok.select("query_id", "n", "kinds", "k", "w"), "query_id").join(wanted, ["w", "doc_id", "sid"])
    # where the phrase would begin, for each of its words
    at = hit.withColumn("begins", F.transform("places", lambda p: p - F.col("k")))
    whole = at.groupBy("query_id", "doc_id", "sid", "n", "kinds").agg(F.countDistinct("w").alias("some"), F.collect_list(F.struct("k", "begins")).alias("b")).where("some = kinds")
    common = F.aggregate("b", F.element_at("b", 1)["begins"], lambda a, x: F.array_intersect(a, x["begins"]))
    hits = cut(whole.select("query_id", "doc_id", "sid", (F.size(common) > 0).alias("exact")))
    hits = F.broadcast(hits) if hits.limit(MOST_HITS + 1).count() <= MOST_HITS else hits
    found = pool.select("doc_id", "sid", "text").join(hits, ["doc_id", "sid"])
    found = found.groupBy("query_id", "text", "exact").agg(F.min(F.struct("doc_id", "sid")).alias("s")).select("query_id", "text", "exact", "s.doc_id", "s.sid")
    order = Window.partitionBy("query_id").orderBy(rank(F.col("text"), F.col("exact")), "doc_id", "sid")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query_id", "place", "doc_id", "sid", "exact", "text")


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_HITS + 1).count() <= MOST_HITS else df


def search_once(queries: DataFrame, pool: DataFrame, limit: int = 3) -> DataFrame:
    """What `search` finds, for queries that are asked once: no index is made, and sentences are tried where they are. A
    query is tried on the sentences that have its rarest word. Then a first look finds the best hit in each of BUCKETS
    buckets of texts: equal texts share a bucket, so the `limit`-th best of these is a bound that as many texts keep. The
    second look brings the texts of what keeps it, and no other hit leaves its task."""
    q = queries.select("query_id", F.regexp_extract_all(F.lower("query"), F.lit(WORD), 1).alias("qs")).where("size(qs) > 0").dropDuplicates(["query_id"])
    q = cut(q)
    tok = q.select("query_id", F.explode(F.array_distinct("qs")).alias("w"))
    # what a sentence is worth is found once, and not for each query
    s = pool.where(F.length("text") > LEAST).select("doc_id", "sid", "text", F.regexp_extract_all(F.lower("text"), F.lit(WORD), 1).alias("ws"), rank(F.col("text"), F.lit(True)).alias("worth"))
    df = s.select(F.explode(F.array_distinct("ws")).alias("w")).join(small(tok.select("w").distinct()), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rare = tok.join(df, "w", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))["w"].alias("w"))
    rare = small(cut(rare.join(q, "query_id")))
    hits = s.select("*", F.explode(F.array_distinct("ws")).alias("w")).join(rare, "w").where(F.size(F.array_except("qs", "ws")) == 0)
    line = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    exact = (F.size("qs") == 1) | F.contains(line("ws"), line("qs"))
    hits = hits.select("query_id", "doc_id", "sid", "text", exact.alias("exact"), "worth")
    key = F.struct((~F.col("exact")).cast("int").alias("loose"), "worth", "doc_id", "sid")
    lows = hits.groupBy("query_id", F.pmod(F.xxhash64("text"), F.lit(BUCKETS)).alias("bucket")).agg(F.min(key).alias("low"))
    bound = lows.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("low"))).where(F.col("k") == limit).select("query_id", "low")
    kept = hits.join(small(cut(bound)), "query_id", "left").where(F.col("low").isNull() | (key <= F.col("low")))
    found = kept.groupBy("query_id", "text", "exact").agg(F.min(F.struct("doc_id", "sid")).alias("s")).select("query_id", "text", "exact", "s.doc_id", "s.sid")
    order = Window.partitionBy("query_id").orderBy(rank(F.col("text"), F.col("exact")), "doc_id", "sid")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query_id", "place", "doc_id", "sid", "exact", "text")
