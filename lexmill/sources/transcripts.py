"""Subtitle files, WebVTT and SubRip, as tables of timed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed

#: Fixed value: how many lines back a rolling caption is taken for a repetition.
RECENT = 8


def _blocks(files: DataFrame, text: str) -> DataFrame:
    cut = F.transform(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"\n\s*\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    return files.select("file", F.posexplode(cut).alias("n", "block")).where("block <> ''").withColumn("parts", F.split("block", "\n"))


def _seconds(line: Column, pattern: str) -> Column:
    h, m, s, ms = (F.regexp_extract(line, pattern, i) for i in range(1, 5))
    number = lambda c: F.when(c == "", 0).otherwise(F.try_to_number(c, F.lit("999")).cast("int"))
    return F.when(line.rlike(pattern), number(h) * 3600 + number(m) * 60 + number(s) + number(ms) / 1000.0)


def parse_srt(files: DataFrame, text: str = "text") -> DataFrame:
    """file, n, sec, text: the blocks of SubRip files (file, text): number, times, lines. Blocks of fewer lines, without times
    or text are left out."""
    b = _blocks(files, text).where(F.size("parts") >= 3)
    words = F.trim(F.array_join(F.slice("parts", 3, F.size("parts")), " "))
    sec = _seconds(F.col("parts")[1], r"(\d{2}):(\d{2}):(\d{2})[.,](\d{3})")
    return b.select("file", "n", sec.alias("sec"), words.alias("text")).where("sec IS NOT NULL AND text <> ''")


def parse_vtt(files: DataFrame, text: str = "text", recent: int = RECENT) -> DataFrame:
    """file, n, sec, text: the cues of WebVTT files without tags. Rolling captions show a line again in the cues that follow:
    a line that is among the last `recent` lines that were kept is left out. Which were kept depends on what was kept
    before, so the lines of one file are folded in order, which keeps no more than the last few."""
    b = _blocks(files, text).where(F.contains("block", F.lit("-->")))
    second = ~F.contains(F.col("parts")[0], F.lit("-->")) & (F.size("parts") > 1)
    time = F.when(second, F.try_element_at("parts", F.lit(2))).otherwise(F.col("parts")[0])
    lines = F.slice("parts", F.when(second, 3).otherwise(2), F.size("parts"))
    clean = F.filter(F.transform(lines, lambda x: squeezed(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != "")
    sec = _seconds(time, r"(?:(\d{2}):)?(\d{2}):(\d{2})[.,](\d{3})")
    cues = b.select("file", "n", sec.alias("sec"), clean.alias("lines")).where("sec IS NOT NULL")
    flat = cues.select("file", "n", "sec", F.posexplode("lines").alias("i", "line"))
    every = flat.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("n", "i", "sec", "line"))).alias("all"))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.filter("all", lambda x: F.lit(False)).alias("kept"))

    def fold(s: Column, x: Column) -> Column:
        old = F.array_contains(s["seen"], x["line"])
        seen = F.concat(s["seen"], F.array(x["line"]))
        last = F.slice(seen, F.greatest(F.size(seen) - recent + 1, F.lit(1)), recent)
        return F.struct(F.when(old, s["seen"]).otherwise(last).alias("seen"), F.when(old, s["kept"]).otherwise(F.concat(s["kept"], F.array(x))).alias("kept"))

    kept = every.select("file", F.explode(F.aggregate("all", start, fold, lambda s: s["kept"])).alias("x")).select("file", "x.n", "x.i", "x.sec", "x.line")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), " ")
    return kept.groupBy("file", "n", "sec").agg(joined.alias("text")).select("file", "n", "sec", "text")


def stamped(lines: DataFrame) -> DataFrame:
    """transcript_id, n, line: timed lines as the transcript operators read them, `[MM:SS.ss] text`."""
    from ..functions.text import format_timestamp

    order = F.row_number().over(Window.partitionBy("file").orderBy("n")) - 1
    return lines.select(F.col("file").alias("transcript_id"), order.cast("int").alias("n"), F.concat(format_timestamp(F.col("sec")), F.lit(" "), "text").alias("line"))
