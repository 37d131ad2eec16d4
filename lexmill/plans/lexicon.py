"""Lexicon queries. The lexicon is derived from the English documents, as the tables of a real one aren't at hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import difficulty, lexicon, sense
from ..functions import scale
from .registry import query, table
from .text import forms_sql

DF = "df AS (SELECT w AS word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE lang = 'en') WHERE length(w) >= 2 GROUP BY w)"
LEVELS = DF + """, byf AS (SELECT df, count(*) AS n FROM df GROUP BY df), rk AS (SELECT df, coalesce(sum(n) OVER (ORDER BY df DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS a FROM byf),
    levels AS (SELECT word, df.df, round(greatest(1.0::DOUBLE, least(6.0::DOUBLE, 6.0 + log10((b + 1) / a) * 1.25)), 2) AS level FROM df JOIN rk USING (df))"""


def english(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'")


def levels(spark, sf_dir):
    return lexicon.corpus_levels(english(spark, sf_dir))


@query(f"WITH {LEVELS} SELECT * FROM levels")
def corpus_levels(spark, sf_dir):
    return levels(spark, sf_dir)


#: Entries: words of three documents and more; -s forms are aliases, -ed and -ly forms derived, where the base is an entry.
ENTRY = LEVELS + """, e0 AS (SELECT word, df, level FROM levels WHERE df >= 3), entry AS (SELECT e.word, e.df, e.level, CASE WHEN s.word IS NOT NULL THEN 'alias' WHEN d.word IS NOT NULL THEN 'derived' ELSE 'article' END AS kind, coalesce(s.word, d.word) AS base_word
    FROM e0 e LEFT JOIN e0 s ON e.word = s.word || 's' LEFT JOIN e0 d ON e.word = d.word || 'ed')"""


def entries(spark, sf_dir):
    e = levels(spark, sf_dir).where("df >= 3")
    s = e.select(F.concat("word", F.lit("s")).alias("word"), F.col("word").alias("s"))
    d = e.select(F.concat("word", F.lit("ed")).alias("word"), F.col("word").alias("d"))
    kind = F.when(F.col("s").isNotNull(), "alias").when(F.col("d").isNotNull(), "derived").otherwise("article")
    return e.join(s, "word", "left").join(d, "word", "left").select("word", "df", "level", kind.alias("kind"), F.coalesce("s", "d").alias("base_word"), F.create_map(F.lit("collocations"), F.array(F.concat(F.lit("c-"), "word"))).alias("assets"))


@query(f"""WITH {ENTRY}, q AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS s FROM benchmark),
    c AS (SELECT s, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) AS n, unnest([s, CASE WHEN (s LIKE '%ies' OR s LIKE '%ied') AND length(s) > 4 THEN s[:-4] || 'y' END, CASE WHEN regexp_matches(s, '(ses|xes|ches|shes|zes|oes)$') AND length(s) >= 4 THEN s[:-3] END,
        CASE WHEN s LIKE '%s' AND NOT regexp_matches(s, '(ss|us|is|as)$') THEN s[:-2] END, CASE WHEN s LIKE '%ing' AND length(s) >= 5 THEN s[:-4] END, CASE WHEN s LIKE '%ing' AND length(s) >= 5 THEN s[:-4] || 'e' END,
        CASE WHEN s LIKE '%ing' AND length(s) > 5 AND s[-4:-4] = s[-5:-5] THEN s[:-5] END, CASE WHEN s LIKE '%ed' AND length(s) >= 4 THEN s[:-3] END, CASE WHEN s LIKE '%ed' AND length(s) >= 4 THEN s[:-3] || 'e' END, CASE WHEN s LIKE '%ed' AND length(s) > 4 AND s[-3:-3] = s[-4:-4] THEN s[:-4] END]) AS c FROM q)
    SELECT q.s AS surface, (SELECT arg_min(c.c, c.n) FROM c JOIN e0 ON e0.word = c.c WHERE c.s = q.s) AS found FROM q""")
def headword_lookup(spark, sf_dir):
    needles = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("t")).select(F.lower("t").alias("surface")).distinct()
    return lexicon.lookup(needles, entries(spark, sf_dir))


@query(f"""WITH RECURSIVE {ENTRY}, hop AS (SELECT word, word AS content_word, kind, base_word, 0 AS n FROM entry
    UNION ALL SELECT h.word, e.word, e.kind, e.base_word, n + 1 FROM hop h JOIN entry e ON e.word = h.base_word WHERE h.kind = 'alias' AND n < 3),
    last AS (SELECT word, arg_max(content_word, n) AS content_word FROM hop GROUP BY word)
    SELECT e.word, e.kind, content_word, CASE WHEN e.kind = 'alias' THEN e.base_word END AS alias_of FROM entry e JOIN last USING (word)""")
def alias_hops(spark, sf_dir):
    return lexicon.resolve(entries(spark, sf_dir)).drop("assets")


BANDED = "least(6, greatest(1, floor(level)))::INT"


@query(f"WITH {LEVELS} SELECT word, ['A1', 'A2', 'B1', 'B2', 'C1', 'C2'][{BANDED}] AS band, [3, 3, 4, 5, 6, 6][{BANDED}] AS support, [4, 4, 5, 6, 6, 6][{BANDED}] AS in_text FROM levels")
def word_bands(spark, sf_dir):
    r = F.least(F.lit(6), F.greatest(F.lit(1), F.floor("level"))).cast("int")
    return levels(spark, sf_dir).select("word", scale.band(r).alias("band"), scale.ceiling_rank(r).alias("support"), scale.ceiling_rank(r, "text").alias("in_text"))


COMPLEX = r"""b AS (SELECT doc_id, regexp_split_to_array(text, '(?i)\n#+\s*(Word\s*List|Vocabulary|New\s*Words)')[1] AS body FROM documents WHERE lang = 'en'),
    st AS (SELECT doc_id, unnest(regexp_split_to_array(body, '[.!?]+(\s+|$)')) AS s FROM b), sn AS (SELECT doc_id, len(regexp_extract_all(s, '[A-Za-z]+')) AS n, len(regexp_extract_all(s, '[,;:()—–-]')) AS p FROM st),
    sg AS (SELECT doc_id, count(*) AS n_sents, avg(n) AS avg_len, avg((n >= 22)::INT) AS long_share, avg(p) AS marks FROM sn WHERE n >= 4 GROUP BY doc_id),
    cx AS (SELECT b.doc_id, coalesce(n_sents, 0) AS n_sents, coalesce(avg_len, 0) AS avg_len, coalesce(long_share, 0) AS long_share, coalesce(marks, 0) AS marks, coalesce(len(regexp_extract_all(body, '{markers}')) / n_sents * 10.0, 0) AS markers FROM b LEFT JOIN sg USING (doc_id)),
    bonus AS (SELECT *, CASE WHEN n_sents < 3 THEN 0.0 ELSE CASE WHEN avg_len >= 18.0 THEN least(0.10::DOUBLE, (avg_len - 18.0) * 0.015) ELSE 0 END + CASE WHEN long_share >= 0.25 THEN least(0.08::DOUBLE, (long_share - 0.25) * 0.25) ELSE 0 END
        + CASE WHEN markers >= 0.8 THEN least(0.12::DOUBLE, (markers - 0.5) * 0.04) ELSE 0 END + CASE WHEN marks >= 1.25 THEN least(0.05::DOUBLE, (marks - 1.20) * 0.06) ELSE 0 END END AS bonus FROM cx)""".replace("{markers}", difficulty.MARKERS)


@query(f"WITH {COMPLEX} SELECT doc_id, n_sents, round(avg_len, 6) AS avg_len, round(long_share, 6) AS long_share, round(marks, 6) AS marks, round(markers, 6) AS markers, round(bonus, 6) AS bonus FROM bonus")
def complexity_bonus(spark, sf_dir):
    return difficulty.complexity(english(spark, sf_dir)).select("doc_id", "n_sents", *(F.round(c, 6).alias(c) for c in ("avg_len", "long_share", "marks", "markers", "bonus")))


@query(f"""WITH {LEVELS}, t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t FROM documents WHERE lang = 'en'), g AS (SELECT doc_id, lower(t) AS word, bool_and(regexp_matches(t, '^[A-Z]')) AS name FROM t GROUP BY ALL)
    SELECT doc_id, g.word, {BANDED} AS rank FROM g JOIN levels USING (word) WHERE length(g.word) >= 4 AND NOT name AND {BANDED} > 4 AND g.word NOT IN ({", ".join(f"'{w}'" for w in difficulty.FUNCTION_WORDS)})""")
def over_ceiling_words(spark, sf_dir):
    return difficulty.over_ceiling(english(spark, sf_dir), levels(spark, sf_dir), 4)


#: Cues: what follows a word of four letters and more, its twelve most frequent followers (as the weights have four ranks
#: for each of three senses).
CUE = """tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents WHERE lang = 'en'),
    bg AS (SELECT ws[i] AS host_word, ws[i + 1] AS cue_word FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM tk)), cc AS (SELECT host_word, cue_word, count(*) AS n FROM bg WHERE length(host_word) >= 4 AND length(cue_word) >= 3 GROUP BY ALL),
    cr AS (SELECT *, row_number() OVER (PARTITION BY host_word ORDER BY n DESC, cue_word) AS r FROM cc), cue AS (SELECT host_word, cue_word, (r - 1) % 3 AS sense_idx, [30, 25, 20, 15][((r - 1) // 3 + 1)::INT] AS weight FROM cr WHERE r <= 12)"""


def cues(spark, sf_dir):
    ws = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    pairs = english(spark, sf_dir).select(ws.alias("ws")).select(F.explode(F.arrays_zip(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))).alias("host_word"), F.slice("ws", 2, F.size("ws")).alias("cue_word"))).alias("p")).select("p.host_word", "p.cue_word")
    n = pairs.where((F.length("host_word") >= 4) & (F.length("cue_word") >= 3)).groupBy("host_word", "cue_word").agg(F.count(F.lit(1)).alias("n"))
    r = n.withColumn("r", F.row_number().over(Window.partitionBy("host_word").orderBy(F.desc("n"), "cue_word"))).where("r <= 12")
    return r.select("host_word", "cue_word", ((F.col("r") - 1) % 3).cast("long").alias("sense_idx"), F.element_at(F.array(*map(F.lit, lexicon.CUE_WEIGHTS)), (F.floor((F.col("r") - 1) / 3) + 1).cast("int")).alias("weight"))


ITEMS = "it AS (SELECT item_id AS item, regexp_extract_all(lower(text), '[a-z]+') AS tokens FROM benchmark), ih AS (SELECT DISTINCT item, tokens, unnest(tokens) AS host_word FROM it)"


def items(spark, sf_dir):
    it = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1).alias("tokens"))
    return it.withColumn("host_word", F.explode(F.array_distinct("tokens")))


FORMS = f"list_contains({forms_sql('host_word')}, cue_word)"
SCORES = f"tok AS (SELECT DISTINCT item, host_word, unnest(tokens) AS cue_word FROM ih), cs AS (SELECT item, host_word, sense_idx, sum(weight)::BIGINT AS score FROM tok JOIN cue USING (host_word, cue_word) WHERE length(cue_word) >= 3 AND NOT ({FORMS}) GROUP BY ALL)"


@query(f"WITH {CUE}, {ITEMS}, {SCORES} SELECT * FROM cs")
def sense_cue_scores(spark, sf_dir):
    return sense.cue_scores(items(spark, sf_dir), cues(spark, sf_dir))


@query(f"""WITH {CUE}, c AS (SELECT DISTINCT host_word, cue_word FROM cue WHERE sense_idx = 0), g AS (SELECT c.host_word, p.host_word AS peer, count(DISTINCT p.cue_word) AS n_cues, sum(p.weight)::BIGINT AS weight FROM c JOIN cue p ON p.cue_word = c.cue_word AND p.sense_idx = 0 WHERE c.host_word <> p.host_word GROUP BY ALL HAVING count(DISTINCT p.cue_word) >= 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host_word ORDER BY n_cues DESC, weight DESC, peer)::INT AS place FROM g) WHERE place <= 35""")
def cue_peers(spark, sf_dir):
    return sense.cue_peers(cues(spark, sf_dir))


@query(f"""WITH {CUE}, {ITEMS}, {SCORES}, f AS (SELECT item || ':' || host_word AS item, sense_idx, score - sense_idx * 0.5::DOUBLE AS score FROM cs),
    r AS (SELECT *, row_number() OVER o AS place, lead(score) OVER o AS nx, count(*) OVER (PARTITION BY item) AS n FROM f WINDOW o AS (PARTITION BY item ORDER BY score DESC, sense_idx))
    SELECT item, sense_idx, score, place::INT AS place, score - nx AS margin, n = 1 OR (score >= 8 AND coalesce(score - nx, 0) >= 3) AS sure FROM r WHERE place <= 16""")
def best_senses(spark, sf_dir):
    s = sense.cue_scores(items(spark, sf_dir), cues(spark, sf_dir))
    return sense.lock(s.select(F.concat_ws(":", "item", "host_word").alias("item"), "sense_idx", "score"), k=16)


#: Constructions: a word belongs to a group by its length and to one by its first letter.
CXN = LEVELS + """, cxn AS (SELECT 'g' || (length(word) % 5) AS subcat_group, word, log10(df) AS zipf FROM levels WHERE df >= 2 UNION ALL SELECT 'h' || (ascii(word) % 4), word, log10(df) FROM levels WHERE df >= 2)"""


def constructions(spark, sf_dir):
    w = levels(spark, sf_dir).where("df >= 2")
    z = F.log10("df").alias("zipf")
    g = w.select(F.concat(F.lit("g"), F.length("word") % 5).alias("subcat_group"), "word", z)
    return g.unionByName(w.select(F.concat(F.lit("h"), F.ascii("word") % 4).alias("subcat_group"), "word", z))


NEEDLES = [(1, ["g1", "g2"], ["h1"], ["the"]), (2, ["g0"], [], []), (3, ["h2", "h3"], ["g3", "g4", "that"], ["and", "for"])]
NEEDLE_SQL = "n(id, contrast, ban, exclude) AS (VALUES " + ", ".join(f"({i}::BIGINT, {c}::VARCHAR[], {b}::VARCHAR[], {x}::VARCHAR[])" for i, c, b, x in NEEDLES) + ")"


def needles(spark):
    return spark.createDataFrame(NEEDLES, "id long, contrast array<string>, ban array<string>, exclude array<string>")


@query(f"""WITH {CXN}, {NEEDLE_SQL}, w AS (SELECT id, word, max(zipf) AS zipf, any_value(exclude) AS ex FROM n JOIN cxn ON list_contains(contrast, subcat_group) GROUP BY id, word), b AS (SELECT DISTINCT id, word FROM n JOIN cxn ON list_contains(ban, subcat_group)),
    k AS (SELECT id, w.word, zipf FROM w ANTI JOIN b USING (id, word) WHERE NOT list_contains(ex, w.word))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY zipf DESC, word)::INT AS place FROM k) WHERE place <= 12""")
def contrast_minus_ban(spark, sf_dir):
    return lexicon.contrast_words(needles(spark), constructions(spark, sf_dir))


@query(f"WITH {CXN}, {NEEDLE_SQL} SELECT id, word FROM n JOIN cxn ON list_contains(ban, subcat_group) UNION SELECT id, g FROM (SELECT id, unnest(ban) AS g FROM n) WHERE regexp_matches(g, '^[a-z]+$')")
def banned_words(spark, sf_dir):
    return lexicon.banned_words(needles(spark), constructions(spark, sf_dir))
