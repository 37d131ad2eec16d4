"""Prompts and responses of model calls as Column expressions: the source in a prompt, its word list, the kind of a task, the
score of a response's form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a prompt's source begins, the surest first, and what ends it.
STARTS = (r"(?is)(?:###\s*(?:PASSAGE[^\n#]*|SOURCE\s*TEXT)\s*###|CONTENT:)\s*\n(.*)", r"(?is)(?:#+\s*(?:Source Material|Input Content|Text Context|Transcript))\s*\n(.*)", r"(?s)(?:^|\n)(?:---\s*\n.*?\n---\s*\n)?(?:#{1,3}\s+[^\n]+\n+)(.*)")
ENDS = r"(?is)\n\s*###+\s*(?:TARGET\s+VOCABULARY|TARGET\s+EXPRESSIONS|TARGET\s+GRAMMAR|DETERMINISTIC\s+TARGET|🚨|\[QUALITY AUDIT REVIEW|VOCABULARY DRAFT|GRAMMAR PATTERNS DRAFT|QUIZ DRAFT|DRAFT).*$"
FRONT = r"(?s)^\s*---\s*\n.*?\n---\s*\n?"
ORDERS = r"(?i)(?:You are an expert|###\s*(?:OUTPUT|INSTRUCTIONS|TASK|SCHEMA)|JSON\s+SCHEMA|Return\s+ONLY\s+valid\s+JSON)"
LEAST_WORDS = 20
#: Headings that are no headwords.
NUMBERED, TITLES = r"(?i)^(?:Item|Question|Task|Section|Part|Unit|Text|Passage)\s+\d+", r"(?i)^(?:Vocabulary\s*List|Comprehension|Assessment|Questions|Overview)"
#: Parts of task names and the kind they stand for, the first that holds counting; before and after a look at the
#: response's keys.
BY_NAME_FIRST = ((("turn1_prose", "prose_draft"), "intermediate_prose"), (("extract_wsd", "wsd_arbitration", "chat_text_mode"), "wsd_arbitration"), (("expert_audit", "quality_audit", "_audit_"), "expert_audit"))
BY_KEY = (("questions", "quiz"), ("grammar_patterns", "grammar"), ("expressions", "expressions"), ("vocabulary", "vocabulary"), ("concepts", "summary"), ("branches", "mindmap"))
BY_NAME_LAST = ((("extract_grammar",), "grammar"), (("extract_expressions",), "expressions"), (("quiz",), "quiz"), (("summary",), "summary"), (("mindmap",), "mindmap"), (("vocabulary",), "vocabulary"))
#: The array that a kind of response must have, and its least number of objects; points for the form.
ARRAYS = {"mindmap": ("branches", 3), "vocabulary": ("vocabulary", 1), "expressions": ("expressions", 1), "grammar": ("grammar_patterns", 1), "summary": ("concepts", 1), "quiz": ("questions", 1)}
FORM, UNCLOSED, NO_LIST, ODD_ITEMS, FEW_ITEMS = 25.0, 5.0, 15.0, 15.0, 10.0


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def source_content(prompt: Column) -> Column:
    """The source text in a prompt: after a marker, after a heading, or the prompt itself if it is plain text of some length;
    without the blocks that follow it. Empty if there is none; null for null."""
    bare = trimmed(F.regexp_replace(prompt, FRONT, ""))
    plain = (F.size(F.filter(F.split(bare, r"\s+"), lambda w: w != "")) >= LEAST_WORDS) & ~bare.rlike(ORDERS)
    found = F.coalesce(*(F.when(prompt.rlike(p), trimmed(F.regexp_extract(prompt, p, 1))) for p in STARTS), F.when(plain, bare), F.lit(""))
    return F.when(prompt.isNotNull(), trimmed(F.regexp_replace(found, ENDS, "")))


def wordlist(source: Column) -> Column:
    """The headwords of a word list, `## [[word]]`; where there are none, all `## headings` that aren't titles or numbers."""
    linked = F.regexp_extract_all(source, F.lit(r"(?m)^##\s*\[\[(.*?)\]\]\s*$"), 1)
    loose = F.regexp_extract_all(source, F.lit(r"(?m)^##\s*\[\[([^\]]+)\]\]"), 1)
    headed = F.filter(F.transform(F.regexp_extract_all(source, F.lit(r"(?m)^##\s+(.+?)\s*$"), 1), lambda h: F.trim(h)), lambda h: ~h.rlike(NUMBERED) & ~h.rlike(TITLES))
    found = F.when(F.size(linked) > 0, linked).when(F.size(loose) > 0, loose).otherwise(headed)
    return F.filter(F.transform(found, lambda w: F.trim(w)), lambda w: w != "")


def _is_list(response: Column, key: str) -> Column:
    return F.coalesce(F.startswith(F.get_json_object(response, f"$.{key}"), F.lit("[")), F.lit(False)) & F.coalesce(F.json_array_length(F.get_json_object(response, f"$.{key}")).isNotNull(), F.lit(False))


def task_kind(task: Column, response: Column) -> Column:
    """The kind of a task by its name, then by the arrays of its response, then by its name again."""
    t = F.lower(F.coalesce(task, F.lit("")))

    def named(rules) -> list[Column]:
        out = []
        for parts, kind in rules:
            hit = F.lit(False)
            for p in parts:
                hit = hit | F.contains(t, F.lit(p))
            out.append(F.when(hit | (F.lit(kind == "expert_audit") & (F.endswith(t, F.lit("_audit")) | F.startswith(t, F.lit("audit_")))), kind))
        return out

    def has(key: str) -> Column:
        return F.get_json_object(response, f"$.{key}").isNotNull()

    audit = F.when((has("pass_audit") & has("blind_solve_accuracy")) | (has("summary_verdict") & _is_list(response, "questions")), "expert_audit")
    return F.coalesce(*named(BY_NAME_FIRST), audit, *(F.when(_is_list(response, k), v) for k, v in BY_KEY), *named(BY_NAME_LAST), F.lit("unknown"))


def form_score(kind: Column, response: Column, raw: Column) -> Column:
    """0 to 25 points for the form of a response: none without a JSON object that has keys; less for a raw response with
    unclosed braces, for a kind whose array is missing, holds others than objects, or too few."""
    keys = F.json_object_keys(response)
    lost = F.when((F.regexp_count(raw, F.lit(r"\{")) > F.regexp_count(raw, F.lit(r"\}"))) | (F.regexp_count(raw, F.lit(r"\[")) > F.regexp_count(raw, F.lit(r"\]"))), UNCLOSED).otherwise(0.0)
    for k, (key, least) in ARRAYS.items():
        items = F.from_json(F.get_json_object(response, f"$.{key}"), "array<variant>")
        objects = F.size(F.filter(items, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))))
        array = F.when(~_is_list(response, key), NO_LIST).otherwise(F.when(objects < F.size(items), ODD_ITEMS).otherwise(0.0) + F.when(objects < least, FEW_ITEMS).otherwise(0.0))
        lost = lost + F.when(kind == k, array).otherwise(0.0)
    return F.when(F.coalesce(F.size(keys), F.lit(0)) <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), FORM - lost))
