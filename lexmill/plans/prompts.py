"""Queries of prompts and responses, made of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as P
from .registry import query, table

HEADS = ("### SOURCE TEXT ###\n", "CONTENT: \n", "intro\n## Transcript\n", "---\na: b\n---\n# Title\n\n", "", "You are an expert. ", "x\n### PASSAGE One ###\n")
TAILS = ("", "\n\n### TARGET VOCABULARY LIST ###\n- a", "\n## [[pay]]\n##  [[give [x] up]] \n## [[pay]] more", "\n## Item 3\n## Overview here\n## plain word ")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LISTED = lambda xs: "[" + ", ".join(map(q, xs)) + "]"
MADE = f"p AS (SELECT conv_id, turn, {LISTED(HEADS)}[(turn % {len(HEADS)})::INT + 1] || text || {LISTED(TAILS)}[((turn + conv_id) % {len(TAILS)})::INT + 1] AS p FROM conversations)"
TRIM = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
BARE = TRIM.format(c=f"regexp_replace(p, '{P.FRONT}', '')")
SOURCE = TRIM.format(c="regexp_replace(CASE " + " ".join(f"WHEN regexp_matches(p, '{s}') THEN {TRIM.format(c=f'''regexp_extract(p, '{s}', 1)''')}" for s in P.STARTS) + rf" WHEN len(list_filter(string_split_regex({BARE}, '\s+'), lambda w: w <> '')) >= {P.LEAST_WORDS} AND NOT regexp_matches({BARE}, '{P.ORDERS}') THEN {BARE} ELSE '' END, '{P.ENDS}', '')")
LINKED, LOOSE = r"regexp_extract_all(s, '(?m)^##\s*\[\[(.*?)\]\]\s*$', 1)", r"regexp_extract_all(s, '(?m)^##\s*\[\[([^\]]+)\]\]', 1)"
HEADED = rf"list_filter(list_transform(regexp_extract_all(s, '(?m)^##\s+(.+?)\s*$', 1), lambda h: trim(h)), lambda h: NOT regexp_matches(h, '{P.NUMBERED}') AND NOT regexp_matches(h, '{P.TITLES}'))"


def prompts(spark, sf_dir):
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    p = F.concat(pick(HEADS, F.col("turn")), "text", pick(TAILS, F.col("turn") + F.col("conv_id")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", p.alias("p"))


@query(f"WITH {MADE} SELECT conv_id, turn, length(s) AS n, md5(s) AS source, array_to_string(list_filter(list_transform(CASE WHEN len({LINKED}) > 0 THEN {LINKED} WHEN len({LOOSE}) > 0 THEN {LOOSE} ELSE {HEADED} END, lambda w: trim(w)), lambda w: w <> ''), '|') AS words FROM (SELECT conv_id, turn, {SOURCE} AS s FROM p)")
def prompt_sources(spark, sf_dir):
    s = prompts(spark, sf_dir).select("conv_id", "turn", P.source_content(F.col("p")).alias("s"))
    return s.select("conv_id", "turn", F.length("s").cast("long").alias("n"), F.md5("s").alias("source"), F.array_join(P.wordlist(F.col("s")), "|").alias("words"))


TASKS = ("extract_vocabulary", "Quiz_cloze", "x_audit", "extract_grammar_2", "turn1_prose_draft", "mindmap", "other", "extract_summary")
ANSWERS = (
    '{"vocabulary": [{"word": "a"}, {"word": "b"}]}', '{"questions": [{"question": "x"}, "{}"], "n": 1}', '{"branches": [{"b": 1}]}', "{}", '{"vocabulary": {"word": "a"}}', "not json {", '{"concepts": []}',
    '{"pass_audit": true, "blind_solve_accuracy": 0.5}', '{"grammar_patterns": [1, 2]}', '[{"word": "a"}]', '{"expressions": [{"word": "x"}], "open": "[{"}',
)
CALLS = f"c AS (SELECT event_id, {LISTED(TASKS)}[(event_id % {len(TASKS)})::INT + 1] AS task, {LISTED(ANSWERS)}[(event_id // 3 % {len(ANSWERS)})::INT + 1] AS raw FROM events), j AS (SELECT *, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM c)"


def is_list(k: str) -> str:
    return f"coalesce(json_type(j, '$.{k}') = 'ARRAY', false)"


def named(rules) -> str:
    return " ".join("WHEN " + " OR ".join([*(f"contains(lower(task), '{p}')" for p in parts), *(["lower(task) LIKE '%\\_audit' ESCAPE '\\'", "lower(task) LIKE 'audit\\_%' ESCAPE '\\'"] if kind == "expert_audit" else [])]) + f" THEN '{kind}'" for parts, kind in rules)


HAS = lambda k: f"json_type(j, '$.{k}') IS NOT NULL"
KIND = f"CASE {named(P.BY_NAME_FIRST)} WHEN ({HAS('pass_audit')} AND {HAS('blind_solve_accuracy')}) OR ({HAS('summary_verdict')} AND {is_list('questions')}) THEN 'expert_audit' " + " ".join(f"WHEN {is_list(k)} THEN '{v}'" for k, v in P.BY_KEY) + f" {named(P.BY_NAME_LAST)} ELSE 'unknown' END"
COUNT = "len(regexp_extract_all(raw, '{}'))"
LOST = f"CASE WHEN {COUNT.format('[{]')} > {COUNT.format('[}]')} OR {COUNT.format(chr(92) + '[')} > {COUNT.format(chr(92) + ']')} THEN {P.UNCLOSED} ELSE 0 END"
for _kind, (_key, _least) in P.ARRAYS.items():
    _objects = f"len(list_filter(json_extract(j, '$.{_key}[*]'), lambda x: json_type(x) = 'OBJECT'))"
    LOST += f" + CASE WHEN kind <> '{_kind}' THEN 0 WHEN NOT {is_list(_key)} THEN {P.NO_LIST} ELSE CASE WHEN {_objects} < json_array_length(j, '$.{_key}') THEN {P.ODD_ITEMS} ELSE 0 END + CASE WHEN {_objects} < {_least} THEN {P.FEW_ITEMS} ELSE 0 END END"


@query(f"WITH {CALLS}, k AS (SELECT *, {KIND} AS kind FROM j) SELECT event_id, kind, (CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' OR len(json_keys(j)) = 0 THEN 0 ELSE greatest(0, {P.FORM} - ({LOST})) END)::DOUBLE AS form FROM k")
def schema_scores(spark, sf_dir):
    """Kinds and scores of responses: every combination of eight task names and eleven answers, over the events."""
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    c = table(spark, sf_dir, "events").select("event_id", pick(TASKS, F.col("event_id")).alias("task"), pick(ANSWERS, F.floor(F.col("event_id") / 3)).alias("raw"))
    c = c.withColumn("response", F.when(F.try_parse_json("raw").isNotNull(), F.col("raw"))).withColumn("kind", P.task_kind(F.col("task"), F.col("response")))
    return c.select("event_id", "kind", P.form_score(F.col("kind"), F.col("response"), F.col("raw")).alias("form"))
