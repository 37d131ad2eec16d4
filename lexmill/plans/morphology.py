"""Queries of lemmas, word families and collisions over the words of the English documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.irregular import IRREGULAR
from ..operators import collisions as C
from ..operators import difficulty, sense
from ..operators import morphology as M
from ..operators.iterate import cut
from .forms import SPELT, listed
from .lexicon import CUE, LEVELS, cues, english, levels
from .registry import query

CANDS = r"""[CASE WHEN regexp_matches(w, '(ies|ied)$') AND length(w) > 4 THEN w[:-4] || 'y' END, CASE WHEN regexp_matches(w, '(ses|xes|ches|shes|zes|oes)$') AND length(w) >= 4 THEN w[:-3] END, CASE WHEN regexp_matches(w, 's$') AND NOT regexp_matches(w, '(ss|us|is|as)$') THEN w[:-2] END,
    CASE WHEN regexp_matches(w, 'ing$') AND length(w) >= 5 THEN w[:-4] END, CASE WHEN regexp_matches(w, 'ing$') AND length(w) >= 5 THEN w[:-4] || 'e' END, CASE WHEN regexp_matches(w, 'ing$') AND length(w) > 5 AND w[-4:-4] = w[-5:-5] THEN w[:-5] END,
    CASE WHEN regexp_matches(w, 'ed$') AND length(w) >= 4 THEN w[:-3] END, CASE WHEN regexp_matches(w, 'ed$') AND length(w) >= 4 THEN w[:-3] || 'e' END, CASE WHEN regexp_matches(w, 'ed$') AND length(w) > 4 AND w[-3:-3] = w[-4:-4] THEN w[:-4] END]"""
LAST = {f: b for b, fs in IRREGULAR.items() for f in fs}
LEMMAS = f"""{LEVELS}, ws AS (SELECT word AS w, level AS wl FROM levels), exc(s, base) AS (VALUES {", ".join(f"('{s}', '{b}')" for s, b in LAST.items())}),
    tried AS (SELECT w, unnest({CANDS}) AS c, unnest(range(9)) AS n FROM ws), rated AS (SELECT w, n, c, CASE WHEN c IN {listed(difficulty.FUNCTION_WORDS)} THEN -1.0 ELSE level END AS k FROM tried LEFT JOIN levels ON word = c WHERE length(c) >= 3),
    bs AS (SELECT w, arg_min(c, (k, n)) AS c, min(k) AS k FROM rated WHERE k IS NOT NULL GROUP BY w),
    ok AS (SELECT ws.w, wl, base, c, k, coalesce(k < 0 OR k <= wl OR (ws.w LIKE '%s' AND NOT regexp_matches(ws.w, '{M.NO_PLURAL}') AND k <= 5.95), false) AS taken FROM ws LEFT JOIN exc ON s = ws.w LEFT JOIN bs ON bs.w = ws.w),
    le AS (SELECT w, CASE WHEN base IS NOT NULL THEN base WHEN taken THEN c ELSE w END AS lemma, base IS NULL AND (k IS NULL OR k >= 0) AS free, CASE WHEN base IS NOT NULL THEN (SELECT level FROM levels WHERE word = base) WHEN taken THEN CASE WHEN k < 0 THEN 1.0 ELSE k END ELSE wl END AS level FROM ok),
    pf AS (SELECT w, lemma, level, lemma[length(p) + 1:] AS stem, n FROM le, (SELECT unnest({list(M.HARDER)}) AS p, unnest(range({len(M.HARDER)})) AS n) WHERE free AND starts_with(lemma, p) AND length(lemma) - length(p) >= 6),
    pb AS (SELECT pf.*, coalesce(a.level, b.level) AS b FROM pf LEFT JOIN levels a ON a.word = stem LEFT JOIN levels b ON a.word IS NULL AND stem LIKE '%ing' AND b.word = stem[:-4]),
    ra AS (SELECT w, arg_min(least(5.3, greatest(coalesce(level, 4.0), b + CASE WHEN regexp_matches(stem, '{M.FORMAL}') THEN 1.5 ELSE 1.0 END)), n) AS raised FROM pb WHERE b <= 5.5 AND ((level IS NULL AND b >= 1.5) OR (b >= 3.0 AND level <= b)) GROUP BY w),
    lemma AS (SELECT le.w, lemma, coalesce(raised, level)::DOUBLE AS level FROM le LEFT JOIN ra USING (w))"""


@query(f"WITH {LEMMAS} SELECT w, lemma, round(level, 6) AS level FROM lemma")
def lemmas(spark, sf_dir):
    lv = cut(levels(spark, sf_dir))  # read several times
    return M.lemmas(lv.select(F.col("word").alias("w")), lv).withColumn("level", F.round("level", 6))


SUFFIXED = f"(SELECT unnest({list(M.SUFFIXES)}) AS s)"
STEPS = f"""ex AS (SELECT word AS w FROM levels), {SPELT}, dv AS (SELECT w AS a, unnest([CASE WHEN length(w) - length(s) >= 5 THEN w[: length(w) - length(s)] END, CASE WHEN length(w) - length(s) - 1 >= 5 AND w[length(w) - length(s)] = w[length(w) - length(s) - 1] THEN w[: length(w) - length(s) - 1] END,
        CASE WHEN regexp_matches(s, '^[aeiou]') AND length(w) - length(s) + 1 >= 5 THEN w[: length(w) - length(s)] || 'e' END]) AS b FROM ex, {SUFFIXED} WHERE ends_with(w, s)),
    px AS (SELECT w AS a, w[length(p) + 1:] AS b FROM ex, (SELECT unnest({list(M.PREFIXES)}) AS p) WHERE starts_with(w, p) AND length(w) - length(p) >= 4),
    st AS (SELECT a, b FROM dv WHERE b IN (SELECT w FROM ex) UNION SELECT w, lemma FROM lemma WHERE w <> lemma AND lemma IN (SELECT w FROM ex) UNION SELECT p.w, q.w FROM spelt p JOIN spelt q ON p.x = q.x AND p.w <> q.w)"""


def reach(name: str, steps: str) -> str:
    return f"{name}_e AS ({steps}), {name}(w, r) AS (SELECT w, w FROM ex UNION SELECT {name}.w, e.b FROM {name} JOIN {name}_e e ON e.a = {name}.r)"


TWO_WAYS = "SELECT a, b FROM {0} UNION SELECT b, a FROM {0}"


@query(f"""WITH RECURSIVE {LEMMAS}, {STEPS}, sp AS (SELECT a, b FROM st UNION SELECT a, b FROM px WHERE b IN (SELECT w FROM ex)), {reach('fam', TWO_WAYS.format('st'))}, {reach('rt', TWO_WAYS.format('sp'))}
    SELECT w, family, root FROM (SELECT w, min(r) AS family FROM fam GROUP BY w) JOIN (SELECT w, min(r) AS root FROM rt GROUP BY w) USING (w)""")
def word_families(spark, sf_dir):
    """Families by lemma, suffix and spelling, and roots for which prefixes are cut off as well."""
    lv = cut(levels(spark, sf_dir))  # read several times
    w = lv.select(F.col("word").alias("w"))
    lemma = M.lemmas(w, lv)
    return M.word_families(w, lemma).join(M.word_families(w, lemma, prefixes=True).withColumnRenamed("family", "root"), "w")


PREPS = "(" + ", ".join(f"'{p}'" for p in C.RELATING) + ")"
#: Near-synonyms: a word's five best cue peers; the peers after them are proposed besides. Prepositions and partners: what
#: follows a word three times and more.
KEYS = f"""{CUE}, c0 AS (SELECT DISTINCT host_word, cue_word FROM cue WHERE sense_idx = 0), pg AS (SELECT c0.host_word, p.host_word AS peer, count(DISTINCT p.cue_word) AS n_cues, sum(p.weight)::BIGINT AS weight FROM c0 JOIN cue p ON p.cue_word = c0.cue_word AND p.sense_idx = 0 WHERE c0.host_word <> p.host_word GROUP BY ALL HAVING count(DISTINCT p.cue_word) >= 2),
    peers AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host_word ORDER BY n_cues DESC, weight DESC, peer) AS place FROM pg) WHERE place <= 35),
    preps AS (SELECT host_word AS w, cue_word AS prep FROM (SELECT host_word, cue_word, count(*) AS n FROM bg WHERE length(host_word) >= 4 AND cue_word IN {PREPS} GROUP BY ALL) WHERE n >= 3), partners AS (SELECT host_word AS w, cue_word AS partner FROM cc WHERE n >= 3 AND length(cue_word) >= 4)"""


@query(f"""WITH RECURSIVE {LEMMAS}, {STEPS}, {reach('fam', TWO_WAYS.format('st'))}, family AS (SELECT w, min(r) AS family FROM fam GROUP BY w), {KEYS},
    same AS (SELECT p.w AS a, q.w AS b FROM family p JOIN family q USING (family) WHERE p.w <> q.w UNION SELECT p.w, q.w FROM spelt p JOIN spelt q ON p.x = q.x AND p.w <> q.w),
    nm AS (SELECT a, b, min(k) AS k FROM (SELECT a, b, 0 AS k FROM same UNION ALL SELECT host_word, peer, CASE WHEN place <= 5 THEN 1 ELSE 2 END FROM peers UNION ALL SELECT peer, host_word, CASE WHEN place <= 5 THEN 1 ELSE 2 END FROM peers) GROUP BY a, b),
    fl AS (SELECT a, b, k, EXISTS (SELECT 1 FROM preps p JOIN preps q USING (prep) WHERE p.w = a AND q.w = b) AS sp, EXISTS (SELECT 1 FROM partners p JOIN partners q USING (partner) WHERE p.w = a AND q.w = b) AS sc FROM nm),
    al AS (SELECT a AS target, b AS candidate, CASE WHEN k = 0 THEN 'double_key_family' WHEN k = 1 AND sp THEN 'double_key_prep' WHEN k = 1 AND sc THEN 'double_key_collocation' WHEN k = 1 THEN 'double_key_slot' WHEN sp THEN 'frame_only' ELSE 'none' END AS kind FROM fl
        UNION SELECT p.w || ' ' || p.prep, q.w || ' ' || q.prep, 'double_key_prep' FROM preps p JOIN preps q ON p.w = q.w AND p.prep <> q.prep
        UNION SELECT a || ' ' || p.prep, b || ' ' || p.prep, CASE WHEN k = 0 THEN 'double_key_family' ELSE 'double_key_prep' END FROM nm JOIN preps p ON p.w = a JOIN preps q ON q.w = b AND p.prep = q.prep WHERE k < 2)
    SELECT target, candidate, kind NOT IN ('frame_only', 'none') AS hit, kind FROM al""")
def collisions(spark, sf_dir):
    lv = cut(levels(spark, sf_dir))
    w = lv.select(F.col("word").alias("w"))
    cue = cut(cues(spark, sf_dir))
    peers = cut(sense.cue_peers(cue).select(F.col("host_word").alias("a"), F.col("peer").alias("b"), "place"))
    ws = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    pairs = english(spark, sf_dir).select(ws.alias("ws")).select(F.explode(F.arrays_zip(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))).alias("w"), F.slice("ws", 2, F.size("ws")).alias("x"))).alias("p")).select("p.w", "p.x")
    n = cut(pairs.where("length(w) >= 4 AND length(x) >= 2").groupBy("w", "x").agg(F.count(F.lit(1)).alias("n")).where("n >= 3"))
    return C.collisions(w, M.word_families(w, M.lemmas(w, lv)), peers.where("place <= 5"), n.where(F.col("x").isin(*C.RELATING)).select("w", F.col("x").alias("prep")), n.where("length(x) >= 4").select("w", F.col("x").alias("partner")), peers.where("place > 5"))
