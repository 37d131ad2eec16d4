"""Queries of broken and ill-shaped answers, made of whole conversation texts. What comes out is known from what was put in,
so the SQL takes it from the texts themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import schema as S
from ..sources import repair
from .registry import query, table

#: Kinds of damage: none, cut anywhere, commas lost, commas and remarks too many, prose around it, a closing mark of another kind.
KINDS = 6


def answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("kind", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(KINDS)).cast("int"))
    return c.withColumn("raw", F.to_json(F.struct("role", "text", F.struct(F.col("turn").alias("n"), F.array("role", "role").alias("l")).alias("more"))))


@query(f"SELECT conv_id, turn, ((conv_id + turn) % {KINDS})::INT AS kind, true AS parses, CASE WHEN (conv_id + turn) % {KINDS} = 0 THEN true END AS same, CASE WHEN (conv_id + turn) % {KINDS} <> 1 THEN md5(text) END AS text_md5, CASE WHEN (conv_id + turn) % {KINDS} <> 1 THEN turn END AS n, true AS begins FROM conversations WHERE text IS NOT NULL")
def healed_responses(spark, sf_dir):
    """Damaged answers, mended: each parses, whole ones stay as they were, cut ones hold the beginning of their text."""
    a = answers(spark, sf_dir).where("text IS NOT NULL")
    k, raw = F.col("kind"), F.col("raw")
    place = F.pmod(F.xxhash64("conv_id", "turn"), F.length(raw)).cast("int")
    broken = (
        F.when(k == 1, F.substring(raw, F.lit(1), place))
        .when(k == 2, F.regexp_replace(raw, r'","more":\{', '"\n"more":{'))
        .when(k == 3, F.concat(F.lit("{"), F.regexp_replace(F.substring(raw, F.lit(2), F.length(raw)), r',"l":\[', ',, (so to "say", it\'s a list) "l":['), F.lit(", ,")))
        .when(k == 4, F.concat(F.lit("<think>{}</think>Sure, here it is:\n```json\n"), raw, F.lit("\n```\nAnything {else}?")))
        .when(k == 5, F.concat(F.regexp_extract(raw, r"(?s)^(.*)\]\}\}$", 1), F.lit("}}")))
        .otherwise(raw)
    )
    h = a.select("conv_id", "turn", "kind", "raw", "text", repair.heal(broken).alias("h")).withColumn("v", F.try_parse_json("h"))
    got = F.try_variant_get("v", "$.text", "string")
    return h.select("conv_id", "turn", "kind", F.col("v").isNotNull().alias("parses"), F.when(k == 0, F.col("h") == raw).alias("same"), F.when(k != 1, F.md5(got)).alias("text_md5"), F.when(k != 1, F.try_variant_get("v", "$.more.n", "bigint")).alias("n"), F.coalesce(F.startswith("text", got), F.lit(True)).alias("begins"))


SHAPE = {
    "type": "object",
    "properties": {
        "role": {"type": "string", "enum": ["system", "user", "assistant"]},
        "text": {"type": "string"},
        "n": {"type": "integer"},
        "done": {"type": "boolean"},
        "words": {"type": "array", "maxItems": 1000, "items": {"type": "object", "properties": {"w": {"type": "string"}, "at": {"type": "integer"}}}},
    },
}


@query(r"""WITH c AS (SELECT conv_id, turn, role, text, (conv_id + turn) % 5 AS k, regexp_extract_all(coalesce(text, ''), '[^ ]+') AS ws FROM conversations)
    SELECT conv_id, turn, role, md5(coalesce(text, '')) AS text_md5, turn AS n, k = 2 AS done, least(len(ws), 1000)::BIGINT AS n_words, md5(array_to_string(ws[1:1000], '|')) AS words_md5, list_sum(range(least(len(ws), 1000)))::BIGINT AS places,
    array_to_string(list_sort(list_filter(['$.note dropped', CASE WHEN k <> 2 THEN '$.done missing' END, CASE WHEN k = 1 THEN '$.n converted' END, CASE WHEN k = 3 THEN '$.role converted' END, CASE WHEN text IS NULL THEN '$.text missing' END, '$.words[] dropped', CASE WHEN len(ws) > 0 THEN '$.words[].x dropped' END, CASE WHEN len(ws) > 0 AND k = 4 THEN '$.words[].at converted' END, CASE WHEN len(ws) > 1000 THEN '$.words shortened' END], lambda x: x IS NOT NULL)), ', ') AS changes FROM c""")
def pruned_responses(spark, sf_dir):
    """Answers with fields too many, in other types, in a wrapper, with elements of another kind, brought to SHAPE."""
    c = table(spark, sf_dir, "conversations").withColumn("k", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)))
    k, words = F.col("k"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([^ ]+)"), 1)
    role = F.when(k == 3, F.concat(F.upper("role"), F.lit("s (now)."))).otherwise(F.col("role"))
    elements = F.transform(words, lambda w, i: F.concat(F.lit('{"w":'), F.to_json(F.array(w)).substr(F.lit(2), F.length(F.to_json(F.array(w))) - 2), F.lit(',"x":[{}],"at":'), F.when(k == 4, F.concat(F.lit('"'), i.cast("string"), F.lit('"'))).otherwise(i.cast("string")), F.lit("}")))
    text = F.coalesce(F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit("null"))
    body = F.concat(
        F.lit('{"note":{"a":1},"role":"'), role, F.lit('","text":'), text, F.lit(',"n":'), F.when(k == 1, F.concat(F.lit('"'), F.col("turn"), F.lit('"'))).otherwise(F.col("turn").cast("string")),
        F.when(k == 2, F.lit(',"done":true')).otherwise(""), F.lit(',"words":["odd",3'), F.when(F.size(words) > 0, ",").otherwise(""), F.array_join(elements, ","), F.lit("]}"),
    )
    v = F.try_parse_json(F.when(k == 0, F.concat(F.lit('{"result":'), body, F.lit("}"))).otherwise(body))
    a = c.select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", S.unwrapped(SHAPE, F.col("v")).alias("v"))
    r = a.select("conv_id", "turn", S.shaped(SHAPE, F.col("v")).alias("s"), F.array_join(S.changes(SHAPE, F.col("v")), ", ").alias("changes"))
    ws = F.transform("s.words", lambda x: x["w"])
    total = F.when(F.size(ws) > 0, F.aggregate("s.words", F.lit(0).cast("long"), lambda t, x: t + x["at"]))
    return r.select("conv_id", "turn", "s.role", F.md5("s.text").alias("text_md5"), "s.n", "s.done", F.size(ws).cast("long").alias("n_words"), F.md5(F.array_join(ws, "|")).alias("words_md5"), total.alias("places"), "changes")
