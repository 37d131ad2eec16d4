"""Similarity queries over the words of the English documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..operators import candidates, lexicon
from .lexicon import LEVELS, english, levels
from .registry import query

SKEL = "w"
for _a, _b in (("^kn", "n"), ("^wr", "r"), ("^ps", "s"), ("^wh", "w"), ("ph", "f"), ("qu", "kw"), ("x", "ks"), ("ck", "k"), ("dg", "j"), ("c([eiy])", r"s\1"), ("c", "k"), ("gh([aeiouy]|$)", r"\1"), ("[aeiouy]+", ""), *((f"{x}+", x) for x in "bdfghjklmnpqrstvwz")):
    SKEL = f"regexp_replace({SKEL}, '{_a}', '{_b}', 'g')"
MUTE = "CASE WHEN w LIKE '%e' AND NOT regexp_matches(w, '(le|ee|ie|oe|ue)$') AND length(w) > 3 THEN w[:-2] ELSE w END"
SAID = "CASE " + " ".join(f"WHEN w LIKE '%{a}' THEN w[:-{len(a) + 1}] || '{b}'" for a, b in S.ENDINGS) + " ELSE w END"
SOUND = f"""snd AS (SELECT w AS word, {SKEL} AS skel, greatest(1, len(regexp_extract_all({MUTE}, '[aeiouy]+')))::INT AS syl, {SAID} AS said, regexp_extract_all({SAID}, '[aeiouy]+[^aeiouy]*') AS gr FROM (SELECT word AS w FROM pool)),
    sound AS (SELECT word, skel, syl, CASE WHEN length(word) < 3 THEN word WHEN len(gr) = 0 THEN said[greatest(length(said) - 2, 1):] ELSE replace(replace(regexp_replace(CASE WHEN len(gr) >= 2 AND ((said LIKE '%e' AND length(gr[-1]) <= 2) OR length(gr[-1]) <= 3) THEN gr[-2] || gr[-1] ELSE gr[-1] END, 'c([eiy])', 's\\1', 'g'), 'c', 'k'), 'ph', 'f') END AS rhyme FROM snd)"""


@query(f"WITH {LEVELS}, pool AS (SELECT word FROM levels), {SOUND} SELECT * FROM sound")
def word_sounds(spark, sf_dir):
    return candidates.sounded(levels(spark, sf_dir).select("word"))


POOL = LEVELS + ", pool AS (SELECT word FROM levels WHERE df >= 12 AND length(word) >= 4)"
TARGETS = "tg AS (SELECT word FROM pool WHERE length(word) >= 6)"
PREF = "len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[1:i] = b[1:i]))"
SUFF = PREF.replace("a[", "reverse(a)[").replace("b[", "reverse(b)[")
DIST = "CASE WHEN levenshtein(a, b) > 2 THEN 99 ELSE levenshtein(a, b) END"


def pool(spark, sf_dir):
    """Without the levels, as the pool takes none. The word isn't nullable, or each join would put its own filter for nulls
    before the counting, and the documents would be read again for each."""
    df = lexicon.document_frequencies(english(spark, sf_dir))
    return df.where((F.col("df") >= 12) & (F.length("word") >= 4)).select(F.coalesce("word", F.lit("")).alias("word"))


@query(f"WITH {POOL}, {TARGETS}, p AS (SELECT tg.word AS a, pool.word AS b FROM tg JOIN pool ON tg.word <> pool.word AND tg.word[1:3] = pool.word[1:3]) SELECT a AS target, b AS word, {PREF} AS pref, {SUFF} AS suff, {DIST} AS dist FROM p")
def pair_distances(spark, sf_dir):
    w = pool(spark, sf_dir)
    p = candidates.pair_distances(w.where(F.length("word") >= 6), w)
    return p.select("target", "word", *(F.col(c).cast("long").alias(c) for c in ("pref", "suff", "dist")))


def _block(own: bool) -> str:
    """The blocks of a word in SQL: those it is in (own) or those it asks."""
    near = "[length(word)]" if own else "range(length(word) - 3, length(word) + 4)"
    names = [f"CASE WHEN word LIKE '%{x}' AND length(word) >= {len(x) + 2} THEN 'a:{x}' END" for x in candidates.SCHOLARLY]
    return f"list_concat([CASE WHEN length(skel) >= 3 THEN 'k:' || skel END, CASE WHEN length(rhyme) >= 3 THEN 'r:' || rhyme END, CASE WHEN length(word) >= 6 THEN 'e:' || word[-4:] END, {', '.join(names)}], list_transform({near}, lambda k: '1:' || word[1:3] || ':' || k), list_transform({near}, lambda k: '2:' || word[2:4] || ':' || k))"


SCH = "(" + " OR ".join(f"(a LIKE '%{x}' AND b LIKE '%{x}')" for x in candidates.SCHOLARLY) + ") AND abs(asy - bsy) <= 2"


@query(f"""WITH {POOL}, {TARGETS}, {SOUND}, t AS (SELECT s.*, unnest({_block(False)}) AS block FROM sound s JOIN tg USING (word)), c AS (SELECT *, unnest({_block(True)}) AS block FROM sound),
    p AS (SELECT DISTINCT t.word AS a, c.word AS b, t.skel AS ask, c.skel AS bsk, t.rhyme AS arh, c.rhyme AS brh, t.syl AS asy, c.syl AS bsy FROM t JOIN c USING (block) WHERE t.word <> c.word),
    f AS (SELECT *, abs(length(a) - length(b)) AS gap, {PREF} AS pref, {SUFF} AS suff, {DIST} AS d, ask <> '' AND ask = bsk AND abs(length(a) - length(b)) <= 2 AS sk,
        least(length(a), length(b)) >= 5 AND abs(length(a) - length(b)) <= 3 AND (ends_with(a, b) OR ends_with(b, a)) AND arh = brh AS ct, {SCH} AS sch FROM p),
    g AS (SELECT *, (length(arh) >= 3 AND arh = brh AND d <= 2) OR ct AS rh FROM f),
    s AS (SELECT a AS target, b AS word, (CASE d WHEN 1 THEN 45 WHEN 2 THEN 26 ELSE 0 END + pref * 4 + suff * 2 - CASE WHEN sch THEN 0 ELSE gap * 2 END + CASE WHEN sk AND d <= 2 THEN 18 WHEN sk AND asy = bsy THEN 14 ELSE 0 END + CASE WHEN rh AND asy = bsy THEN 12 ELSE 0 END + CASE WHEN ct THEN 30 ELSE 0 END
        + CASE WHEN sch THEN 44 + CASE WHEN abs(asy - bsy) <= 1 THEN 4 ELSE 0 END ELSE 0 END)::INT AS score FROM g WHERE (d <= 2 OR sk OR rh OR sch OR (pref >= 4 AND length(a) >= 6 AND gap <= 3) OR (pref >= 3 AND suff >= 2)) AND gap <= CASE WHEN sch THEN 4 ELSE 3 END)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, word)::INT AS place FROM s) WHERE place <= 3""")
def lookalike_words(spark, sf_dir):
    w = pool(spark, sf_dir)
    return candidates.lookalikes(w.where(F.length("word") >= 6), w)


@query()
def pool_walk(spark, sf_dir):
    """Seeded by crc32, which DuckDB lacks; tests/test_operators.py compares it with a walk word by word."""
    w = levels(spark, sf_dir).where((F.col("df") >= 3) & (F.length("word") >= 4))
    p = w.select(F.when(F.col("level") <= 3, "tier1").otherwise("tier2").alias("bucket"), "word")
    return candidates.pool_walk(p.select(F.col("word").alias("target"), "bucket"), p)


@query(f"""WITH {POOL}, e AS (SELECT a.word AS target, b.word, CASE WHEN b.word = a.word || 's' OR a.word = b.word || 's' THEN 0 WHEN a.word[1:5] = b.word[1:5] THEN 1 ELSE 2 END AS tier, abs(length(a.word) - length(b.word)) AS ord FROM pool a JOIN pool b ON a.word[1:3] = b.word[1:3] AND a.word <> b.word),
    k AS (SELECT * FROM e WHERE tier > 0) SELECT target, word, tier::INT AS tier, place FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY tier, ord, word)::INT AS place FROM k) WHERE place <= 3""")
def tiered_alternatives(spark, sf_dir):
    """Tiers: same five letters, same three letters; plural forms are banned."""
    w = pool(spark, sf_dir)
    b = w.select(F.col("word").alias("target"))
    # three places, the target, its two forms, and in the second tier the words that the first one has: two, or there is no need
    near = lambda letters: candidates.nearest_by_prefix(b, w, letters, most=3 + 1 + 2 + 2)
    s = F.lit("s")
    forms = b.select("target", F.concat("target", s).alias("word")).unionByName(b.select(F.concat("target", s).alias("target"), F.col("target").alias("word")))
    return candidates.ranked_union([near(99).limit(0), near(5), near(3)], forms)
