"""Logs of model calls as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends the parts of a log, besides its end.
SECTIONS = {
    "system_prompt": ("SYSTEM PROMPT", ("--- USER PROMPT ---", "--- RAW RESPONSE ---", "=== END OF LOG ===")),
    "user_prompt": ("USER PROMPT", ("--- CONSOLIDATED ITEM", "--- RAW RESPONSE ---", "=== END OF LOG ===")),
    "raw_response": ("RAW RESPONSE", ("=== END OF LOG ===",)),
}


def header(text: Column, name: str) -> Column:
    """The value of `=== NAME: value ===`; null without such a line."""
    value = F.trim(F.regexp_extract(text, rf"=== {name}:\s*([^\n]+?)\s*===", 1))
    return F.when(value != "", value)


def section(text: Column, title: str, ends: tuple[str, ...]) -> Column:
    """What stands between `--- TITLE ---` and the first of the ends; empty if there is no such part."""
    rest = F.concat(F.lit("\n"), F.element_at(F.split(text, rf"--- {title} ---\n", 2), -1))
    for e in ends:
        rest = F.substring_index(rest, f"\n{e}", 1)
    return F.when(F.contains(text, F.lit(f"--- {title} ---\n")), F.regexp_replace(rest, r"^\s+|\s+$", "")).otherwise("")


def json_text(response: Column) -> Column:
    """The JSON of a response: the whole of it, a fenced block, or what stands between the outermost braces or brackets;
    null if none of them is valid. Reasoning blocks are left out."""
    c = F.regexp_replace(F.regexp_replace(response, r"(?s)<think>.*?</think>", ""), r"^\s+|\s+$", "")
    fenced = F.regexp_extract(c, r"(?s)```json\s*\n(.*?)\n```", 1)
    braces, brackets = F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    return F.coalesce(*(F.when((x != "") & F.try_parse_json(x).isNotNull(), x) for x in (c, fenced, braces, brackets)))


def parse_logs(files: DataFrame, text: str = "text") -> DataFrame:
    """log_name, task, model, timestamp, status, failure_category, pre_cure_score, post_cure_score, the three parts, and
    response_json, of log files (log_name, text). Files without a task or a model are left out."""
    t = F.regexp_replace(F.col(text), "\r\n", "\n")

    def percent(name: str) -> Column:
        return F.regexp_extract(t, rf"=== {name}:\s*([\d.]+)%\s*===", 1).try_cast("double")

    parts = {k: section(t, *v) for k, v in SECTIONS.items()}
    rows = files.select(
        "log_name", header(t, "TASK").alias("task"), header(t, "MODEL").alias("model"), F.coalesce(header(t, "TIMESTAMP"), F.lit("")).alias("timestamp"), F.coalesce(header(t, "STATUS"), F.lit("SUCCESS")).alias("status"),
        header(t, "FAILURE_CATEGORY").alias("failure_category"), percent("PRE_CURE_SCORE").alias("pre_cure_score"), percent("POST_CURE_SCORE").alias("post_cure_score"), *(v.alias(k) for k, v in parts.items()),
    )
    return rows.where("task IS NOT NULL AND model IS NOT NULL").withColumn("response_json", json_text(F.col("raw_response")))
