"""Integrity gates: a boolean column for each gate over a table of items, and the list of those that an item fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams

BLANK = "_{2,}"


def defects(**gates: Column) -> Column:
    """Names of the gates that are true, in order; null counts as false."""
    return F.array_compact(F.array(*(F.when(F.coalesce(g, F.lit(False)), F.lit(k)) for k, g in gates.items())))


def distinct_options(options: Column) -> Column:
    clean = F.transform(options, lambda o: F.lower(F.trim(o)))
    return F.size(F.array_distinct(clean)) == F.size(clean)


def relative_spread(options: Column) -> Column:
    """Population standard deviation of the options' word counts over their mean."""
    n = F.transform(options, lambda o: F.size(F.filter(F.split(F.trim(o), r"\s+"), lambda w: w != "")).cast("double"))
    mean = F.aggregate(n, F.lit(0.0), lambda a, x: a + x) / F.size(n)
    var = F.aggregate(n, F.lit(0.0), lambda a, x: a + x * x) / F.size(n) - mean * mean
    return F.when(mean > 0, F.sqrt(F.greatest(var, F.lit(0.0))) / mean).otherwise(0.0)


def leakage(key: Column, anchor: Column) -> Column:
    """Share of the key's distinct word 3-grams that the anchor has; 0 if either has none."""

    def grams(c: Column) -> Column:
        return F.array_distinct(ngrams(F.regexp_extract_all(F.lower(c), F.lit(r"\b([a-z]{2,})\b"), 1), 3))

    a, b = grams(key), grams(anchor)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def reading_items(items: DataFrame) -> DataFrame:
    """item_id, leakage, spread, defects, score, valid. items: item_id, options, correct (from 0), anchor, ceiling (true if
    an option is above the ceiling). 100 less 40, 30, 25, 10 and 10 for a wrong number of options, equal options, leakage
    over 35 %, spread over 25 % and the ceiling; valid from 80 on."""
    key = F.try_element_at(F.transform("options", lambda o: F.trim(o)), F.col("correct") + 1)
    i = items.withColumns({"leakage": F.when(F.col("correct") >= 0, F.coalesce(leakage(key, F.col("anchor")), F.lit(0.0))).otherwise(0.0), "spread": relative_spread(F.col("options"))})
    gates = {"cardinality": (F.size("options") != 4, 40), "duplicates": (F.size(F.array_distinct(F.transform("options", lambda o: F.trim(o)))) != F.size("options"), 30), "leakage": (F.col("leakage") > 0.35, 25), "spread": (F.col("spread") > 0.25, 10), "ceiling": (F.coalesce("ceiling", F.lit(False)), 10)}
    cost = sum((F.when(g, float(c)).otherwise(0.0) for g, c in gates.values()), F.lit(0.0))
    score = F.greatest(F.lit(0.0), 100.0 - cost)
    return i.select("item_id", "leakage", "spread", defects(**{k: g for k, (g, _) in gates.items()}).alias("defects"), score.alias("score"), (100.0 - cost >= 80).alias("valid"))


def cloze_items(items: DataFrame, passages: DataFrame) -> DataFrame:
    """quiz_id, position, defects. items: quiz_id, position (from 1), target, accepted (array), question, blank_index;
    passages: quiz_id, passage. A target counts as used from its first position on."""
    t = F.lower(F.trim(F.coalesce("target", F.lit(""))))
    again = F.row_number().over(Window.partitionBy("quiz_id", t).orderBy("position")) > 1
    accepted = F.filter(F.transform("accepted", lambda a: F.lower(F.trim(a))), lambda a: a != "")
    i = items.withColumn("again", again).join(passages, "quiz_id", "left")
    none = F.coalesce(F.size(accepted) == 0, F.lit(True))
    return i.select(
        "quiz_id", "position",
        defects(
            missing_target=t == "",
            duplicate_target=(t != "") & F.col("again"),
            no_accepted=none,
            target_not_accepted=~none & (t != "") & ~F.array_contains(accepted, t),
            no_marker=(F.coalesce("question", F.lit("")) != "") & ~F.contains("question", F.concat(F.lit("["), F.col("blank_index").cast("string"), F.lit("]"))),
            not_in_passage=(F.coalesce("passage", F.lit("")) != "") & (t != "") & ~F.contains(F.lower("passage"), t),
        ).alias("defects"),
    )


def vocabulary_items(items: DataFrame) -> DataFrame:
    """quiz_id, position, defects. items: quiz_id, position, target, question, options, correct, banned (array of source
    sentences)."""
    t = F.lower(F.trim(F.coalesce("target", F.lit(""))))
    again = F.row_number().over(Window.partitionBy("quiz_id", t).orderBy("position")) > 1
    blanks = F.regexp_count("question", F.lit(BLANK))
    open_ = F.regexp_replace("question", BLANK, " ")
    cut = r"(?:ed|ing|s|es|ly|tion|ment)$"
    root = F.regexp_replace(t, cut, "")
    words = F.regexp_extract_all(F.lower(open_), F.lit("([a-z]+)"), 1)
    leak = F.exists(words, lambda w: (w == t) | ((F.length(root) >= 4) & (F.regexp_replace(w, cut, "") == root)))
    grams = ngrams(F.filter(F.split(F.lower(open_), r"\s+"), lambda w: w != ""), 7)
    sources = F.flatten(F.transform("banned", lambda s: ngrams(F.filter(F.split(F.lower(s), r"\s+"), lambda w: w != ""), 7)))
    i = items.withColumns({"again": again, "grams": grams, "sources": sources})
    return i.select(
        "quiz_id", "position",
        defects(
            duplicate_target=(t != "") & F.col("again"), missing_blank=blanks == 0, many_blanks=blanks > 1, target_leak=(t != "") & leak,
            copied_stem=F.arrays_overlap("grams", "sources"), wrong_options=F.size("options") != 4, equal_options=~distinct_options(F.col("options")),
            key_mismatch=~F.lower(F.trim(F.try_element_at("options", F.col("correct") + 1))).eqNullSafe(t),
        ).alias("defects"),
    )


def quiz_summary(checked: DataFrame) -> DataFrame:
    """quiz_id, n_items, n_flagged, flagged (sorted positions) of checked items."""
    bad = F.size("defects") > 0
    return checked.groupBy("quiz_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(bad).alias("n_flagged"), F.array_sort(F.collect_list(F.when(bad, F.col("position")))).alias("flagged"))
