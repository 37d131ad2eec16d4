"""Repair tickets from the flags of an audit: which field a flag is about, which item it names, what to hide of the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHOLE = "@array"
FATAL = "❌"
#: Parts of flags and the field they are about, in the order in which they are tried.
FIELDS = (
    (("prescribed options altered",), "options"),
    (("prescribed answer index altered",), "correct_answer_index"),
    (("inflection discordance",), "target_word"),
    (("stem verbatim from", "cross-target leakage", "target word leaks verbatim", "indefinite article", "multiple blanks", "fill-in-the-blank slot", "blank slot pos mismatch", "anchor missing in question stem"), "question"),
    (("explanation anchor not grounded",), "explanation"),
    (("selection clustering",), "correct_answer_index"),
    (("does not appear in quoted sentence", "non-verbatim quote", "ungrounded in quote", "hallucinated quote"), "quoted_sentence"),
    (("not a recognized english word",), "word"),
    (("copy-pasted definition",), "definition"),
    (("degenerate formula slot",), "formula_slot"),
    (("deviates from the pre-extracted skeleton", "matches none"), "pattern_name"),
    (("duplicates the source quote",), "imitation_example"),
    (("invalid_schema", "invalid_item_type", "insufficient_items", "empty object", "invalid or missing json", "distractors recycled repeatedly", "word-family collisions", "redundant headwords", "duplicate item"), WHOLE),
    (("in-list distractor recycling",), "options"),
    (("not found in supplied word list",), "word"),
    (("missing quote/quoted_sentence", "prompt instruction leakage in quote"), "quoted_sentence"),
    (("incomplete target coverage", "incomplete_coverage"), WHOLE),
    (("pure tail/head padding", "stacked preposition + to-infinitive", "minimal-pair contract violation"), "flawed_translation"),
    (("post-comma adjunct must use a passive past participle",), "idiomatic_translation"),
)
#: Flags that no repair mends, and the field of all other flags.
HOPELESS, OTHER = ("distractor slot illegality", "blueprint self-conflict"), "question"
#: How a flag names an item, and what it quotes.
NAMED = r"""(?:Quiz item|Item|item|target word|target|word|Headword|headword)\s+['"‘]((?:[^'"’]|['’][a-zA-Z])+)['"’]?"""
QUOTED = r"""['‘"]([^'’"]{4,})['’"]"""
HIDDEN = "<source text redacted>"


def has_any(c: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def field_of(flag: Column) -> Column:
    """The field that a flag is about; WHOLE for the array of items."""
    low = F.lower(flag)
    return F.coalesce(*(F.when(has_any(low, needles), field) for needles, field in FIELDS), F.lit(OTHER))


def repairable_flag(flag: Column) -> Column:
    return F.contains(flag, F.lit(FATAL)) & ~has_any(F.lower(flag), HOPELESS)


def item_name(flag: Column) -> Column:
    """The headword that a flag names; null if there is none."""
    name = F.trim(F.regexp_extract(flag, NAMED, 1))
    return F.when(name != "", name)


def source_like(span: Column) -> Column:
    """A quoted span that is rather a sentence than a label: four words or 20 characters and more."""
    s = F.trim(span)
    return (F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 4) | (F.length(s) >= 20)


def redacted(flag: Column) -> Column:
    """A flag without the sentences it quotes. It is taken as quoted spans and single characters, in order."""
    parts = F.regexp_extract_all(flag, F.lit(rf"(?s)({QUOTED.replace('(', '(?:')}|.)"), 1)
    hidden = F.transform(parts, lambda p: F.when((F.length(p) >= 6) & source_like(F.substring(p, F.lit(2), F.length(p) - 2)), F.lit(HIDDEN)).otherwise(p))
    return F.trim(F.array_join(hidden, ""))


def snippet(flag: Column) -> Column:
    """The longest quoted span of several words and eight characters, lower-cased, without closing dots; the first of
    equally long ones; null if there is none."""
    spans = F.transform(F.regexp_extract_all(flag, F.lit(QUOTED), 1), lambda s: F.struct((-F.length(s)).alias("n"), F.lower(F.regexp_replace(F.trim(s), r"[.… ]+\z", "")).alias("s")))
    spans = F.transform(spans, lambda x, i: F.struct(x["n"].alias("n"), i.alias("i"), x["s"].alias("s")))
    return F.try_element_at(F.array_sort(F.filter(spans, lambda x: (F.length(x["s"]) >= 8) & F.contains(x["s"], F.lit(" ")))), F.lit(1))["s"]


def located(flag: Column, items: Column) -> Column:
    """The place from 0 of the item that a flag is about, null if none is found. items: array of struct<names, contents>, both
    arrays of strings. A name counts before one with the same four first letters, and this before quoted contents."""
    name, part = F.lower(item_name(flag)), snippet(flag)

    def place(hit) -> Column:
        at = F.array_position(F.transform(items, lambda x: F.coalesce(hit(x), F.lit(False))), True)
        return F.when(at > 0, at - 1)

    by_name = place(lambda x: F.exists(x["names"], lambda n: F.lower(F.trim(n)) == name))
    by_stem = place(lambda x: F.exists(x["names"], lambda n: F.substring(F.lower(F.trim(n)), 1, 4) == F.substring(name, 1, 4)))
    by_text = place(lambda x: F.exists(x["contents"], lambda c: F.contains(F.lower(c), part) | ((F.length(part) >= 15) & F.contains(F.lower(c), F.substring(part, 1, 15)))))
    return F.coalesce(by_name, by_stem, by_text)


def repair_tickets(flags: DataFrame, quizzes: DataFrame, array_key: str = "items", most: int = 5) -> DataFrame:
    """quiz_id, ticket (from 1), field, error: at most `most` tickets for a quiz, in the order of its flags. Flags that aren't
    fatal, that no repair mends or that are about no item go; equal tickets count once. flags: quiz_id, n, flag; quizzes:
    quiz_id, items (as `located` takes them; no items for quizzes that aren't there)."""
    f = flags.where(repairable_flag(F.col("flag"))).withColumn("name", field_of(F.col("flag")))
    none = F.array().cast(quizzes.schema["items"].dataType)
    j = f.join(quizzes.select("quiz_id", "items"), "quiz_id", "left").withColumn("items", F.coalesce("items", none))
    j = j.withColumn("at", located(F.col("flag"), F.col("items"))).where((F.col("name") == WHOLE) | F.col("at").isNotNull())
    path = F.when(F.col("name") == WHOLE, F.lit(array_key)).otherwise(F.concat(F.lit(f"{array_key}["), F.col("at").cast("string"), F.lit("]."), "name"))
    t = j.select("quiz_id", "n", path.alias("field"), redacted(F.col("flag")).alias("error")).groupBy("quiz_id", "field", "error").agg(F.min("n").alias("n"))
    t = t.withColumn("ticket", F.row_number().over(Window.partitionBy("quiz_id").orderBy("n", "field", "error")))
    return t.where(F.col("ticket") <= most).select("quiz_id", "ticket", "field", "error")


def mandates(tickets: DataFrame) -> DataFrame:
    """quiz_id, fields: the fields that the tickets of a quiz allow to change, each once, in order, parted by commas."""
    first = tickets.groupBy("quiz_id", "field").agg(F.min("ticket").alias("t"))
    return first.groupBy("quiz_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "field"))), lambda x: x["field"]), ", ").alias("fields"))
