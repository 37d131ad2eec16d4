"""Lemmas and word families over a lexicon of words and levels (word, level): exceptions first, then rules whose results
the lexicon must know. Null and empty words are left out; words that repeat count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.forms import one_spelling
from ..functions.irregular import IRREGULAR
from .difficulty import FUNCTION_WORDS
from .iterate import components
from .lexicon import headword_candidates

#: Surfaces of irregular verbs, the last of several verbs that share one.
BASES = {f: b for b, fs in IRREGULAR.items() for f in fs}
#: Endings in -s that are no plural; prefixes that make a word harder; endings of formal nouns.
NO_PLURAL = r"(ss|us|is|as|os)$"
HARDER = ("dis", "under", "over", "mis", "counter", "non")
FORMAL = r"(ity|tion|sion|ment|ance|ence|ate)$"
#: Suffixes that a member of a word's family may have more than the word.
SUFFIXES = (
    "s", "es", "ed", "d", "ing", "er", "ers", "or", "ors", "est", "ly", "ily", "ally", "ness", "ment", "ments", "tion", "tions", "ation", "ations", "ition", "itions", "able", "ible", "al", "ial", "ic",
    "ical", "ically", "ive", "ively", "ous", "ously", "ful", "fully", "less", "lessly", "ize", "izes", "ized", "izing", "ise", "ises", "ised", "ising", "ify", "ifies", "ified", "ifying", "ity", "ities",
    "ty", "ties", "ist", "ists", "ism", "isms", "ance", "ances", "ence", "ences", "ant", "ants", "ent", "ents", "ery", "ry", "cy", "dom", "ship", "hood", "ward", "wards", "wise", "en", "ens", "ened", "ening",
)
#: Prefixes that are cut off to find a root.
PREFIXES = ("un", "in", "im", "ir", "il", "dis", "non", "mis", "re", "over", "under", "out", "pre", "post", "sub", "inter", "counter", "de")


def lemmas(words: DataFrame, levels: DataFrame) -> DataFrame:
    """w, lemma, level of words (w). A form of an irregular verb has that verb as its lemma. Else of the headwords that a
    word may stand for, of three letters and more, the first function word; without one the easiest that has a level (the
    likelier of equal ones), if it is no harder than the word, or the word an -s form and the headword under 5.95. Else the
    word itself. A level is raised where a prefix makes a known word harder; null where the lexicon has none."""
    w = words.select(F.lower(F.trim("w")).alias("w")).where("w <> ''").distinct()
    known = levels.select(F.col("word").alias("c"), F.col("level").alias("l"))
    own = w.join(known, F.col("w") == F.col("c"), "left").select("w", F.col("l").alias("wl"))
    exceptions = w.sparkSession.createDataFrame(sorted(BASES.items()), "s string, base string")  # of fixed size
    tried = w.select("w", F.posexplode(headword_candidates(F.col("w"))).alias("n", "c")).where("n > 0 AND length(c) >= 3")
    level = F.when(F.col("c").isin(*FUNCTION_WORDS), -1.0).otherwise(F.col("l"))
    # a function word counts as easier than all; n settles equal levels
    best = tried.join(known, "c", "left").withColumn("k", level).where("k IS NOT NULL").groupBy("w").agg(F.min(F.when(F.col("k") < 0, F.struct(F.col("k"), "n", "c", F.lit(1.0).alias("l"))).otherwise(F.struct(F.col("k"), "n", "c", F.col("l").alias("l")))).alias("best"))
    j = own.join(F.broadcast(exceptions), F.col("w") == F.col("s"), "left").join(best, "w", "left")
    bl = F.col("best.k")
    taken = (bl < 0) | F.col("wl").isNull() | (bl <= F.col("wl")) | (F.endswith("w", F.lit("s")) & ~F.col("w").rlike(NO_PLURAL) & (bl <= 5.95))
    j = j.select("w", F.coalesce("base", F.when(taken, F.col("best.c")), "w").alias("lemma"), F.col("base").isNotNull().alias("fixed"), F.coalesce(bl < 0, F.lit(False)).alias("closed"), F.when(taken, F.col("best.l")).otherwise(F.col("wl")).alias("level"))
    verbs = known.select(F.col("c").alias("vb"), F.col("l").alias("vl"))
    j = j.join(verbs, F.col("fixed") & (F.col("lemma") == F.col("vb")), "left").withColumn("level", F.when(F.col("fixed"), F.col("vl")).otherwise(F.col("level")))
    return _harder(j, known)


def _harder(j: DataFrame, known: DataFrame) -> DataFrame:
    """Levels of words with a prefix on a known word, by the first prefix for which the word behind it says so."""
    stems = F.array_compact(F.array(*(F.when(F.startswith("lemma", F.lit(p)) & (F.length("lemma") - len(p) >= 6), F.substring("lemma", F.lit(len(p) + 1), F.length("lemma"))) for p in HARDER)))
    t = j.where("NOT fixed AND NOT closed").select("w", F.col("level").alias("wl"), F.posexplode(stems).alias("n", "stem"))
    short = F.when(F.endswith("stem", F.lit("ing")) & (F.length("stem") >= 6), F.substring("stem", F.lit(1), F.length("stem") - 3))
    t = t.join(known.select(F.col("c").alias("stem"), F.col("l").alias("l1")), "stem", "left").withColumn("short", short).join(known.select(F.col("c").alias("short"), F.col("l").alias("l2")), "short", "left")
    b = F.coalesce("l1", "l2")
    t = t.where((b <= 5.5) & ((F.col("wl").isNull() & (b >= 1.5)) | ((b >= 3.0) & (F.col("wl") <= b))))
    raised = F.least(F.lit(5.3), F.greatest(F.coalesce("wl", F.lit(4.0)), b + F.when(F.col("stem").rlike(FORMAL), 1.5).otherwise(1.0)))
    t = t.groupBy("w").agg(F.min_by(raised, F.col("n")).alias("raised"))
    return j.join(t, "w", "left").select("w", "lemma", F.coalesce("raised", "level").alias("level"))


def stripped(w: Column, prefixes: bool = False) -> Column:
    """Words that w may be derived from by a suffix (five letters and more; a doubled letter or a silent e come off with
    it), and by a prefix (four letters and more)."""
    n = F.length(w)
    out = []
    for s in SUFFIXES:
        k, ends = len(s), F.endswith(w, F.lit(s))
        stem = F.substring(w, F.lit(1), n - k)
        out.append(F.when(ends & (n - k >= 5), stem))
        out.append(F.when(ends & (n - k - 1 >= 5) & (F.substring(w, n - k, F.lit(1)) == F.substring(w, n - k - 1, F.lit(1))), F.substring(w, F.lit(1), n - k - 1)))
        if s[0] in "aeiou":
            out.append(F.when(ends & (n - k + 1 >= 5), F.concat(stem, F.lit("e"))))
    if prefixes:
        out += [F.when(F.startswith(w, F.lit(p)) & (n - len(p) >= 4), F.substring(w, F.lit(len(p) + 1), n)) for p in PREFIXES]
    return F.array_distinct(F.array_compact(F.array(*out)))


def family_links(words: DataFrame, lemma: DataFrame, prefixes: bool = False) -> DataFrame:
    """a, b: words of the lexicon (w) that are of one family by one step: a word and its lemma, a word and what it is
    derived from, two spellings of one word (the smallest of them stands for all)."""
    known = words.select(F.col("w").alias("b"))
    derived = words.select(F.col("w").alias("a"), F.explode(stripped(F.col("w"), prefixes)).alias("b")).join(known, "b", "left_semi")
    forms = lemma.select(F.col("w").alias("a"), F.col("lemma").alias("b")).where("a <> b").join(known, "b", "left_semi")
    spelt = words.select(F.col("w").alias("a"), one_spelling(F.col("w")).alias("x"))
    spelt = spelt.join(spelt.groupBy("x").agg(F.min("a").alias("b")), "x").select("a", "b").where("a <> b")
    return derived.select("a", "b").unionByName(forms.select("a", "b")).unionByName(spelt).distinct()


def word_families(words: DataFrame, lemma: DataFrame, prefixes: bool = False) -> DataFrame:
    """w, family: the smallest word that links lead to. words: w, distinct; lemma: as lemmas() gives it."""
    return components(words.select(F.col("w").alias("node")), family_links(words, lemma, prefixes)).select(F.col("node").alias("w"), F.col("root").alias("family"))
