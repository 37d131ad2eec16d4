"""Queries of word forms over the words of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import forms as V
from ..functions import irregular as R
from .lexicon import LEVELS, levels
from .registry import query


def listed(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


IN_Y = "(regexp_matches(b, '[^aeiou]y$') AND length(b) > 2)"
DOUBLES = f"((regexp_matches(b, '{V.DOUBLING}') AND length(b) BETWEEN 3 AND 8) OR b IN {listed(R.DOUBLED)})"
PAST = f"CASE WHEN b LIKE '%ie' THEN b[:-3] || 'ied' WHEN {IN_Y} THEN b[:-2] || 'ied' WHEN b LIKE '%e' THEN b || 'd' WHEN {DOUBLES} THEN b || b[-1] || 'ed' ELSE b || 'ed' END"
ING = f"CASE WHEN b LIKE '%ie' THEN b[:-3] || 'ying' WHEN regexp_matches(b, '(ee|oe|ye)$') THEN b || 'ing' WHEN b LIKE '%e' AND length(b) > 2 THEN b[:-2] || 'ing' WHEN {DOUBLES} THEN b || b[-1] || 'ing' ELSE b || 'ing' END"
THIRD = f"CASE WHEN regexp_matches(b, '(s|x|z|ch|sh)$') OR b IN {listed(V.VERBS_OES)} THEN b || 'es' WHEN {IN_Y} THEN b[:-2] || 'ies' ELSE b || 's' END"
#: Irregular verbs as a table, their surfaces, and the verbs with a prefix before one; then bases with their four forms.
VERB_SQL = f"""irr(b, vbd, vbn, vbg, vbz) AS (VALUES {", ".join(f"('{b}', {', '.join(map(repr, fs))})" for b, fs in R.IRREGULAR.items())}),
    surf AS (SELECT s, arg_min(b, n) AS b FROM (SELECT b, unnest([vbd, vbn, vbg, vbz]) AS s, row_number() OVER () AS n FROM irr) WHERE s NOT IN (SELECT b FROM irr) AND s NOT IN {listed(R.BASES)} GROUP BY s),
    pre AS (SELECT unnest({list(R.PREFIXES)}) AS p, unnest(range({len(R.PREFIXES)})) AS n), bw AS (SELECT w, coalesce(surf.b, w) AS b FROM ex LEFT JOIN surf ON surf.s = w),
    px AS (SELECT x.b AS b, arg_min(p || irr.vbd, n) AS vbd, arg_min(p || irr.vbn, n) AS vbn, arg_min(p || irr.vbg, n) AS vbg, arg_min(p || irr.vbz, n) AS vbz FROM (SELECT DISTINCT b FROM bw) x JOIN pre ON starts_with(x.b, p) AND length(x.b) > length(p) + 2 JOIN irr ON irr.b = x.b[length(p) + 1:] GROUP BY x.b),
    vf AS (SELECT w, b, coalesce(irr.vbd, px.vbd, {PAST}) AS vbd, coalesce(irr.vbn, px.vbn, {PAST}) AS vbn, coalesce(irr.vbg, px.vbg, {ING}) AS vbg, coalesce(irr.vbz, px.vbz, {THIRD}) AS vbz FROM bw LEFT JOIN irr USING (b) LEFT JOIN px USING (b))"""
#: The corpus' words, and words that rules single out.
EXTRA = ("die", "stop", "lean", "carry", "agree", "go", "box", "tie", "colour", "organise", "analyse", "travelled", "centre", "catalogue", "defence", "hotter", "happiest", "nicer", "larger", "better", "child", "leaf", "wife", "series", "hero", "four", "fulfil", "programme", "filled", "skilful", "break", "went", "taken", "prefer", "admit", "quiz", "overtake", "withdraw", "rebuild", "found", "saw", "visit", "lay", "control", "led", "mistake")
POOL = f"{LEVELS}, ex AS (SELECT word AS w FROM levels UNION SELECT unnest([{', '.join(repr(x) for x in EXTRA)}]))"


def words(spark, sf_dir):
    extra = spark.createDataFrame([(x,) for x in EXTRA], "w string")
    return levels(spark, sf_dir).select(F.col("word").alias("w")).unionByName(extra).distinct()


@query(f"WITH {POOL}, {VERB_SQL} SELECT w, vbd, vbn, vbg, vbz FROM vf")
def verb_forms(spark, sf_dir):
    made = words(spark, sf_dir).select("w", V.verb_forms(F.col("w")).alias("f"))
    return made.select("w", *(F.col("f")[i].alias(t) for i, t in enumerate(("vbd", "vbn", "vbg", "vbz"))))


OWN = "CASE " + " ".join(f"WHEN w = '{k}' THEN '{v}'" for k, v in V.PLURALS.items()) + f" WHEN w IN {listed([*V.SAME, *V.PLURALS.values()])} THEN w"


@query(f"WITH {POOL} SELECT w, {OWN} WHEN regexp_matches(w, '(s|sh|ch|x|z)$') OR w IN {listed(V.NOUNS_OES)} THEN w || 'es' WHEN regexp_matches(w, '[^aeiou]y$') THEN w[:-2] || 'ies' WHEN w IN {listed(V.NOUNS_VES)} THEN regexp_replace(w, 'fe?$', 'ves') ELSE w || 's' END AS plural FROM ex")
def noun_plurals(spark, sf_dir):
    return words(spark, sf_dir).select("w", V.plural(F.col("w")).alias("plural"))


def twin(a: int) -> str:
    return f"(w[-{a}:-{a}] = w[-{a + 1}:-{a + 1}] AND contains('bdfgklmnprstz', w[-{a}:-{a}]))"


STEMS = f"[CASE WHEN w LIKE '%iest' AND length(w) >= 5 THEN w[:-5] || 'y' END, CASE WHEN w LIKE '%ier' THEN w[:-4] || 'y' END, CASE WHEN w LIKE '%est' AND length(w) >= 5 AND {twin(4)} THEN w[:-5] END, CASE WHEN w LIKE '%est' THEN w[:-4] END, CASE WHEN w LIKE '%est' THEN w[:-3] END, CASE WHEN w LIKE '%er' AND {twin(3)} THEN w[:-4] END, CASE WHEN w LIKE '%er' THEN w[:-3] END, CASE WHEN w LIKE '%er' THEN w[:-2] END]"


@query(f"WITH {POOL} SELECT w, CASE WHEN length(w) < 4 THEN '' " + " ".join(f"WHEN w = '{k}' THEN '{v}'" for k, v in V.COMPARED.items()) + f" ELSE array_to_string(list_filter({STEMS}, lambda s: length(s) >= 3), ' ') END AS stems FROM ex")
def compared_words(spark, sf_dir):
    return words(spark, sf_dir).select("w", F.array_join(V.compared_stems(F.col("w")), " ").alias("stems"))


def chain(c: str, rules) -> str:
    for a, b in rules:
        c = f"regexp_replace({c}, '{a}', '{b.replace('$', chr(92))}')"
    return c


SPELT = f"""s1 AS (SELECT w, {chain('w', V.SPELLINGS)} AS x FROM ex), s2 AS (SELECT w, {chain("CASE WHEN " + " OR ".join(f"starts_with(x, '{k}')" for k in V.KEEP_OUR) + f" THEN x ELSE {chain('x', [V.OUR])} END", V.ISE)} AS x FROM s1),
    s3 AS (SELECT w, CASE WHEN length(x) >= 6 THEN {chain('x', V.SIX)} ELSE x END AS x FROM s2), spelt AS (SELECT w, CASE WHEN length(w) < 4 THEN w WHEN length(x) >= 7 AND regexp_matches(x, '{V.LL}') AND regexp_extract(x, '{V.LL}', 1) || 'l' NOT IN {listed(V.NATIVE_LL)} THEN regexp_replace(x, '{V.LL}', '\\1\\2') ELSE x END AS x FROM s3)"""


@query(f"WITH {POOL}, {SPELT} SELECT w, x AS spelling FROM spelt")
def one_spellings(spark, sf_dir):
    return words(spark, sf_dir).select("w", V.one_spelling(F.col("w")).alias("spelling"))


@query(f"WITH {POOL}, {SPELT} SELECT a.w AS a, b.w AS b FROM spelt a JOIN spelt b ON a.x = b.x AND a.w < b.w")
def spelling_pairs(spark, sf_dir):
    """Words of the corpus that are spellings of one another: a join on the one spelling."""
    s = words(spark, sf_dir).select("w", V.one_spelling(F.col("w")).alias("x"))
    return s.select(F.col("w").alias("a"), "x").join(s.select(F.col("w").alias("b"), "x"), "x").where("a < b").select("a", "b")
