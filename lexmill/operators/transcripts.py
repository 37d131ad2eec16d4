"""Transcripts: timed lines into whole sentences, each with the time of its first word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import timestamp_seconds

LINE = r"^\s*\[(\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?)\]\s*(.+)$"
#: Words with a dot that end no sentence, the length from which a comma ends one, and the speed of speech.
ABBREVIATIONS = ("mr.", "mrs.", "ms.", "dr.", "prof.", "st.", "jr.", "sr.", "vs.", "etc.", "e.g.", "i.e.", "u.s.", "u.k.", "a.m.", "p.m.")
LONG = 42
LAST_GAP, LEAST_GAP, LEAST_CAP, PER_CHAR, BASE = 4.0, 0.8, 2.5, 0.09, 1.2
ALIGNED_LINES, ALIGNED_SHARE = 3, 0.85


def ends_sentence(word: Column) -> Column:
    """A word that closes with . ? or !, quotes and brackets aside, and is neither an abbreviation nor an initial."""
    w = F.regexp_replace(word, r"[\"'”’)\]]+$", "")
    return w.rlike("[.?!]$") & ~F.lower(w).isin(*ABBREVIATIONS) & ~F.lower(w).rlike(r"^[a-z]\.$")


def segments(lines: DataFrame) -> DataFrame:
    """transcript_id, seg, sec, txt, ws. lines: transcript_id, n, line. A line without a time goes on with the one before;
    those ahead of the first time are left out, as are lines without text."""
    order = Window.partitionBy("transcript_id").orderBy("n")
    at = F.regexp_extract("line", LINE, 1)
    rows = lines.select("transcript_id", "n", at.alias("at"), F.trim(F.when(at != "", F.regexp_extract("line", LINE, 2)).otherwise(F.col("line"))).alias("t"))
    rows = rows.withColumn("seg", F.sum(F.when(F.col("at") != "", 1).otherwise(0)).over(order)).where("seg > 0 AND t <> ''")
    txt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), " ")
    out = rows.groupBy("transcript_id", "seg").agg(F.max(F.when(F.col("at") != "", timestamp_seconds(F.col("at")))).alias("sec"), txt.alias("txt"))
    return out.where("sec IS NOT NULL").withColumn("ws", F.filter(F.split("txt", r"\s+"), lambda w: w != ""))


def _pieces(ws: Column) -> Column:
    """The words of a sentence in parts that end at the first comma, colon, semicolon or dash from LONG words on."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.array(F.lit(0)).alias("cuts"))

    def step(s: Column, w: Column) -> Column:
        cut = (s["n"] + 1 >= LONG) & w["w"].rlike("[,;:—-]$")
        return F.struct(F.when(cut, 0).otherwise(s["n"] + 1).alias("n"), (s["i"] + 1).alias("i"), F.when(cut, F.concat(s["cuts"], F.array(s["i"] + 1))).otherwise(s["cuts"]).alias("cuts"))

    cuts = F.filter(F.aggregate(ws, start, step)["cuts"], lambda c: c < F.size(ws))
    ends = F.concat(F.slice(cuts, F.lit(2), F.size(cuts)), F.array(F.size(ws)))
    return F.zip_with(cuts, ends, lambda a, b: F.slice(ws, a + 1, b - a))


def sentences(lines: DataFrame) -> DataFrame:
    """transcript_id, place, sec, sentence. Words get times within their line by their lengths, longer at punctuation; a line
    lasts until the next one, but no longer than its text takes to say. Transcripts that already stand in sentences, at
    least ALIGNED_LINES lines of which ALIGNED_SHARE end one and none has one inside, keep their lines. All is windows by
    transcript and array functions; no group of rows goes to Python."""
    s = segments(lines)
    last, inner = F.element_at("ws", -1), F.slice("ws", F.lit(1), F.size("ws") - 1)
    flags = s.groupBy("transcript_id").agg(
        ((F.count(F.lit(1)) >= ALIGNED_LINES) & (F.avg(ends_sentence(last).cast("int")) >= ALIGNED_SHARE) & ~F.bool_or(F.exists(inner, ends_sentence))).alias("aligned")
    )
    s = s.withColumn("next", F.lead("sec").over(Window.partitionBy("transcript_id").orderBy("seg"))).join(flags, "transcript_id")
    as_is = s.where("aligned").select("transcript_id", F.col("seg").alias("a"), F.lit(0).alias("b"), "sec", F.col("txt").alias("sentence"))

    gap = F.greatest(F.lit(LEAST_GAP), F.coalesce(F.col("next"), F.col("sec") + LAST_GAP) - F.col("sec"))
    dur = F.least(gap, F.greatest(F.lit(LEAST_CAP), F.length("txt") * PER_CHAR + BASE))
    w = s.where("NOT aligned").select("transcript_id", "seg", "sec", dur.alias("dur"), F.posexplode("ws").alias("pos", "w"))
    weight = F.length("w") + F.when(F.col("w").rlike("[.?!]$"), 3.0).when(F.col("w").rlike("[,;:]$"), 1.5).otherwise(0.0)
    line = Window.partitionBy("transcript_id", "seg")
    before = F.coalesce(F.sum("weight").over(line.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    w = w.withColumn("weight", weight).withColumn("at", F.col("sec") + F.col("dur") * before / F.sum("weight").over(line))
    upto = Window.partitionBy("transcript_id").orderBy("seg", "pos").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("a", F.coalesce(F.sum(ends_sentence(F.col("w")).cast("int")).over(upto), F.lit(0)))
    whole = w.groupBy("transcript_id", "a").agg(F.array_sort(F.collect_list(F.struct("seg", "pos", "at", "w"))).alias("ws"))
    parts = whole.select("transcript_id", "a", F.posexplode(_pieces(F.col("ws"))).alias("b", "p"))
    made = parts.select("transcript_id", "a", "b", F.element_at("p", 1)["at"].alias("sec"), F.array_join(F.transform("p", lambda x: x["w"]), " ").alias("sentence"))
    place = F.row_number().over(Window.partitionBy("transcript_id").orderBy("a", "b"))
    return as_is.unionByName(made).select("transcript_id", place.alias("place"), "sec", "sentence")
