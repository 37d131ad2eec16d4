"""Difficulty of texts from the levels of their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import ladder, text_band

#: Closed-class words that say nothing about difficulty.
FUNCTION_WORDS = tuple(
    "a an the this that these those my your his her its our their mine yours hers ours theirs i you he she it we they me him us them myself yourself himself herself itself ourselves themselves "
    "who whom whose which what where when why how be am is are was were been being have has had having do does did doing done will would shall should can cannot could may might must ought "
    "in on at to for of with by from up down out off over under into onto upon about above below between among through during before after since until till around along across behind beyond "
    "within without against toward towards near and but or nor so yet if because as than then while whilst although though whether unless not no yes very too also just only even still already "
    "always never often sometimes usually again here there now well much many more most some any all both each every other another such same own one ones two three four five six seven eight "
    "nine ten first second third".split()
)
#: Units and initialisms.
NOISE = tuple("cm mm km kg mg ml bc ad am pm uv led cfl ioc dna uk us tv pc id ok mr mrs ms dr st etc".split())
#: Markers of academic syntax.
MARKERS = (
    r"(?i)\b(?:whilst|whereas|whereby|wherein|in\s+which|on\s+which|to\s+which|by\s+which|for\s+which|prior\s+to|so\s+as\s+to|not\s+only|in\s+this\s+respect|provided\s+that|as\s+well\s+as|"
    r"despite\s+this|rather\s+than|accompanied\s+by|confronted\s+with|facilitated\s+by|classified\s+under|characterized\s+by|attributed\s+to|associated\s+with|regardless\s+of|notwithstanding|"
    r"subsequent\s+to|albeit|thereby|moreover|furthermore|nevertheless|nonetheless|consequently|on\s+the\s+other\s+hand|in\s+particular)\b"
)
#: Highest means of the bands A1 to C1 for texts of no content type, and of under eight.
NO_TYPES, FEW_TYPES = (1.60, 2.10, 2.75, 3.50, 4.35), (1.80, 2.25, 2.85, 3.60, 4.50)
SENTENCE_END = r"[.!?]+(?:\s+|$)"


def complexity(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_sents, avg_len, long_share, marks, markers, bonus: 0 to 0.35 by sentence length, share of sentences from
    22 words on, clause punctuation and academic markers. Sentences of four words and more count; under three: 0."""
    body = F.split(F.col(text), r"(?i)\n#+\s*(?:Word\s*List|Vocabulary|New\s*Words)", 2)[0]
    counts = F.transform(F.split("b", SENTENCE_END), lambda s: F.struct(F.regexp_count(s, F.lit("[A-Za-z]+")).alias("n"), F.regexp_count(s, F.lit(r"[,;:()—–-]")).alias("p")))
    # a text's sentences are counted where the text is, without a shuffle
    s = docs.select("doc_id", body.alias("b")).select("doc_id", F.regexp_count("b", F.lit(MARKERS)).alias("m"), F.filter(counts, lambda x: x["n"] >= 4).alias("s"))
    total = lambda f: F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + f(x).cast("long"))
    s = s.select("doc_id", "m", F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("n_sents"), total(lambda x: x["n"]).alias("n"), total(lambda x: x["n"] >= 22).alias("long"), total(lambda x: x["p"]).alias("p"))
    n_sents = F.when(F.col("n_sents") > 0, F.col("n_sents"))
    j = s.select("doc_id", "n_sents", *(F.coalesce(x / n_sents, F.lit(0.0)).alias(k) for k, x in (("avg_len", F.col("n")), ("long_share", F.col("long")), ("marks", F.col("p")), ("markers", F.col("m") * 10.0))))

    def part(c: str, least: float, base: float, slope: float, most: float) -> Column:
        return F.when(F.col(c) >= least, F.least(F.lit(most), (F.col(c) - base) * slope)).otherwise(0.0)

    bonus = part("avg_len", 18.0, 18.0, 0.015, 0.10) + part("long_share", 0.25, 0.25, 0.25, 0.08) + part("markers", 0.8, 0.5, 0.04, 0.12) + part("marks", 1.25, 1.20, 0.06, 0.05)
    return j.withColumn("bonus", F.when(F.col("n_sents") < 3, 0.0).otherwise(bonus))


def text_levels(docs: DataFrame, levels: DataFrame, text: str = "text", default: str = "B1") -> DataFrame:
    """doc_id, n_types, typ_avg, p80, p90, band. levels: word, level. Content types are words of three letters and more that
    are neither function words nor noise nor capitalised within a sentence; their levels are averaged over types, and
    percentiles are taken by index, not interpolated. Texts without types fall back on all known words, then on `default`."""
    tok = docs.select("doc_id", F.explode(F.regexp_extract_all(F.concat(F.lit(". "), F.col(text)), F.lit(r"(?s)(.{0,4}?)((?<![A-Za-z])[A-Za-z]+(?:['’][A-Za-z]+)*)"), 0)).alias("t"))
    raw = F.regexp_replace(F.regexp_extract("t", r"([A-Za-z]+(?:['’][A-Za-z]+)*)$", 1), r"(?i)['’]s$", "")
    begins = F.regexp_extract("t", r"(?s)^(.*?)[A-Za-z]+(?:['’][A-Za-z]+)*$", 1).rlike(r"[.!?:\n\r\"'“‘(\[]\s*$")
    tok = tok.select("doc_id", raw.alias("raw"), begins.alias("begins")).where("raw <> '' AND NOT raw RLIKE '[\\'’]'")
    w = F.lower("raw")
    content = (F.length("raw") > 2) & ~w.isin(*FUNCTION_WORDS) & ~w.isin(*NOISE) & (F.col("begins") | ~F.col("raw").rlike("^[A-Z]"))
    known = tok.select("doc_id", w.alias("word"), content.alias("content")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"), F.max("content").alias("content")).join(levels.select("word", "level"), "word")
    g = known.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("content"), F.col("level")))).alias("v"), (F.sum(F.col("level") * F.col("n")) / F.sum("n")).alias("all_avg"))
    n = F.size("v")
    avg = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / n

    def share(least: float) -> Column:
        return F.size(F.filter("v", lambda x: x >= least)) / n

    def index(q: float) -> Column:
        return F.try_element_at("v", F.floor(n * q).cast("int") + 1)

    g = g.select("doc_id", n.cast("long").alias("n_types"), F.when(n > 0, avg).alias("typ_avg"), index(0.80).alias("p80"), index(0.90).alias("p90"), F.when(n > 0, share(3.5)).alias("b2"), F.when(n > 0, share(4.5)).alias("c1"), F.size(F.filter("v", lambda x: x >= 5.3)).alias("c2n"), F.when(n > 0, share(5.3)).alias("c2"), "all_avg")
    j = complexity(docs, text).select("doc_id", "bonus").join(g, "doc_id", "left")
    full = text_band(F.col("typ_avg"), F.col("bonus"), F.col("p80"), F.col("p90"), F.col("b2"), F.col("c1"), F.col("c2n"), F.col("c2"))
    n = F.coalesce("n_types", F.lit(0))
    band = F.when(F.col("all_avg").isNull(), default).when(n == 0, ladder(F.col("all_avg"), NO_TYPES)).when(n < 8, ladder(F.col("typ_avg"), FEW_TYPES)).otherwise(full)
    return j.select("doc_id", n.alias("n_types"), "typ_avg", "p80", "p90", band.alias("band"))


def over_ceiling(docs: DataFrame, levels: DataFrame, passage_rank: int, text: str = "text", min_len: int = 4) -> DataFrame:
    """doc_id, word, rank: distinct words above the ceiling rank, but for function words and words that stand there
    capitalised alone (names)."""
    t = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col(text), F.lit("([A-Za-z]+)"), 1)).alias("t"))
    t = t.groupBy("doc_id", F.lower("t").alias("word")).agg(F.min(F.col("t").rlike("^[A-Z]")).alias("name")).where((F.length("word") >= min_len) & ~F.col("name") & ~F.col("word").isin(*FUNCTION_WORDS))
    rank = F.least(F.lit(6), F.greatest(F.lit(1), F.floor("level"))).cast("int")
    return t.join(levels.select("word", rank.alias("rank")), "word").where(F.col("rank") > passage_rank).select("doc_id", "word", "rank")
