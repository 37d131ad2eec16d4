"""The lexicon as tables, and lookups in it.

entry: word, pos_all (array), kind (article, derived, alias, entity), base_word, core_level, level, assets (map of arrays)
phrase: phrase_key, tier (sense_unit, phrasal_verb, phrase_row, ...), host_word, sense_idx, raw_phrase
cue: host_word, cue_word, sense_idx, weight
cxn: subcat_group, word, pos, sense_idx (-1: all), zipf, pattern
trap: word, pos, sense_idx, trap_type, forbidden_frame
edge: word, relation, other

`corpus_levels` derives levels from a table of documents, and the queries in `plans` other tables by rank and by company; a
real lexicon takes their place as tables of the same columns. A lookup is a join of needles with a table, ranked where the first of several hits counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative strength of phrase tiers, the lower the stronger.
TIER_RANK = {"sense_unit": 1, "phrasal_verb": 2}
#: Assets that a derived entry borrows from its base.
BORROWED = ("collocations", "phrases", "phrasal_verbs", "thesaurus", "word_family", "grammar_boxes")
CUE_WEIGHTS = (30, 25, 20, 15)
HOPS = 3


def tier_rank(tier: Column) -> Column:
    return F.coalesce(*(F.when(tier == t, r) for t, r in TIER_RANK.items()), F.lit(3))


def words_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, i, w: the ASCII words of each text, lower-cased, in order."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z]+)"), 1)).alias("i", "w"))


def document_frequencies(docs: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """word, df: the number of documents that hold a word, of words of `least` letters or more."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z]+)"), 1))
    return docs.select("doc_id", F.explode(words).alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def corpus_levels(docs: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """word, df, level (1 to 6 by rank of document frequency, in steps by the logarithm of the rank) of words of `least`
    letters or more. The ranks are counted by frequency: one row for each frequency, so no global sort of words."""
    df = document_frequencies(docs, text, least)
    by = df.groupBy("df").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("df")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = by.select("df", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    share = (F.col("before") + 1) / F.col("all")
    level = F.round(F.greatest(F.lit(1.0), F.least(F.lit(6.0), 6.0 + F.log10(share) * 1.25)), 2)
    return df.join(ranks.select("df", level.alias("level")), "df").select("word", "df", "level")


def headword_candidates(surface: Column) -> Column:
    """Headwords that a surface may stand for, the most literal first."""
    s = surface
    n = F.length(s)

    def ends(*suffixes: str) -> Column:
        return reduce(lambda a, b: a | b, (F.endswith(s, F.lit(x)) for x in suffixes))

    def cut(k: int, add: str = "") -> Column:
        return F.concat(F.substring(s, F.lit(1), n - k), F.lit(add))

    def twin(k: int) -> Column:
        """The stem after cutting k letters ends in a doubled letter."""
        return (n - k > 2) & (F.substring(s, n - k, F.lit(1)) == F.substring(s, n - k - 1, F.lit(1)))

    hyphen, blank = F.contains(s, F.lit("-")), F.contains(s, F.lit(" "))
    ing, ed = ends("ing") & (n >= 5), ends("ed") & (n >= 4)
    cands = [
        s,
        F.when(hyphen, F.replace(s, F.lit("-"), F.lit(""))),
        F.when(hyphen, F.replace(s, F.lit("-"), F.lit(" "))),
        F.when(~hyphen & blank, F.replace(s, F.lit(" "), F.lit("-"))),
        F.when(ends("ies", "ied") & (n > 4), cut(3, "y")),
        F.when(ends("ses", "xes", "ches", "shes", "zes", "oes") & (n >= 4), cut(2)),
        F.when(ends("s") & ~ends("ss", "us", "is", "as"), cut(1)),
        F.when(ing, cut(3)), F.when(ing, cut(3, "e")), F.when(ing & twin(3), cut(4)),
        F.when(ed, cut(2)), F.when(ed, cut(2, "e")), F.when(ed & twin(2), cut(3)),
    ]
    return F.array_distinct(F.filter(F.array_compact(F.array(*cands)), lambda c: c != ""))


def lookup(needles: DataFrame, entry: DataFrame, surface: str = "surface") -> DataFrame:
    """needles with `found`, the first candidate that is an entry; else the entry spelled so without blanks and hyphens;
    else null. Distinct surfaces are looked up once."""
    s = needles.select(F.col(surface).alias("__s")).distinct()
    c = s.select("__s", F.posexplode(headword_candidates(F.lower(F.trim("__s")))).alias("__n", "__c"))
    words = entry.select(F.col("word").alias("__c")).distinct()
    direct = c.join(words, "__c").groupBy("__s").agg(F.min_by("__c", "__n").alias("direct"))
    tight = entry.where(F.col("word").rlike("[ -]")).groupBy(F.regexp_replace(F.lower("word"), "[ -]", "").alias("__t")).agg(F.min("word").alias("compound"))
    hit = s.join(direct, "__s", "left").join(tight, F.lower(F.trim("__s")) == F.col("__t"), "left").select("__s", F.coalesce("direct", "compound").alias("found"))
    return needles.join(hit, needles[surface].eqNullSafe(hit["__s"]), "left").drop("__s")


def resolve(entry: DataFrame, hops: int = HOPS) -> DataFrame:
    """word, kind, content_word (the end of an alias chain, at most `hops` long), alias_of, assets: an alias has those of
    its content, a derived word its own and what it lacks from its base, key by key without repeats."""
    base = entry.select(F.col("word").alias("__w"), F.col("kind").alias("__k"), F.col("base_word").alias("__b"), F.col("assets").alias("__a"))
    r = entry.withColumns({"content_word": F.col("word"), "ck": F.col("kind"), "cb": F.col("base_word"), "ca": F.col("assets")})
    for _ in range(hops):
        hop = (F.col("ck") == "alias") & F.col("cb").isNotNull() & (F.col("cb") != F.col("content_word"))
        r = r.join(base, hop & (F.col("cb") == F.col("__w")), "left").select(*[c for c in r.columns if c not in ("content_word", "ck", "cb", "ca")], F.coalesce("__w", "content_word").alias("content_word"), F.when(F.col("__w").isNull(), F.col("ck")).otherwise(F.col("__k")).alias("ck"), F.when(F.col("__w").isNull(), F.col("cb")).otherwise(F.col("__b")).alias("cb"), F.when(F.col("__w").isNull(), F.col("ca")).otherwise(F.col("__a")).alias("ca"))
    own, theirs = F.coalesce("ca", F.create_map().cast("map<string,array<string>>")), F.coalesce("__a", F.create_map().cast("map<string,array<string>>"))
    lent = F.map_filter(theirs, lambda k, _: k.isin(*BORROWED))
    both = F.map_zip_with(own, lent, lambda k, a, b: F.when(k == "collocations", F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))).otherwise(F.when(F.size(a) > 0, a).otherwise(F.coalesce(b, a))))
    r = r.join(base, (F.col("ck") == "derived") & (F.col("cb") == F.col("__w")) & (F.col("cb") != F.col("content_word")), "left")
    return r.select("word", "kind", "content_word", F.when(F.col("kind") == "alias", F.col("base_word")).alias("alias_of"), F.when(F.col("__w").isNull(), own).otherwise(both).alias("assets"))


def phrase_lookup(needles: DataFrame, phrase: DataFrame, first: bool = True, text: str = "phrase") -> DataFrame:
    """needles with track, host_word, sense_idx, tier, raw_phrase. Tracks: 1 the literal phrase (also with an exclamation
    mark), 2 its words, 3 the words with possessives as `your`, 4 the words with the first in its base form. Within a track
    the strongest tier, then host and sense. All hits with first=False."""
    s = needles.select(F.col(text).alias("__p")).distinct()
    plain = F.translate(F.lower(F.trim("__p")), "’‘", "''")
    literal = F.trim(F.regexp_replace(plain, "[!?,.]+$", ""))

    def key(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(c, r"\[[^\]]*\]|\([^)]*\)", " "), r"[^a-z0-9'-]+", " "))

    owner = F.regexp_replace(plain, r"\b(?:one's|ones|somebody's|someone's|sb's|my|his|her|their|our|its)\b", "your")
    head, rest = F.split_part(key(plain), F.lit(" "), F.lit(1)), F.regexp_extract(key(plain), r"^\S+(.*)$", 1)
    bases = F.transform(F.slice(headword_candidates(head), 2, 20), lambda h: F.concat(h, rest))
    tried = s.select("__p", F.explode(F.array(F.struct(F.lit(1).alias("track"), F.array(literal, F.concat(literal, F.lit("!"))).alias("keys")), F.struct(F.lit(2), F.array(key(plain))), F.struct(F.lit(3), F.array(key(owner))), F.struct(F.lit(4), bases))).alias("t"))
    tried = tried.select("__p", "t.track", F.posexplode("t.keys").alias("n", "k"))
    index = phrase.select(F.lower("raw_phrase").alias("k"), F.lit(True).alias("raw"), "host_word", "sense_idx", "tier", "raw_phrase").unionByName(phrase.select(F.col("phrase_key").alias("k"), F.lit(False).alias("raw"), "host_word", "sense_idx", "tier", "raw_phrase"))
    hit = tried.join(index, (tried["k"] == index["k"]) & (F.col("raw") == (F.col("track") == 1)))
    order = [F.col("track"), tier_rank(F.col("tier")), F.col("n"), F.col("host_word"), F.coalesce("sense_idx", F.lit(-1)), F.col("raw_phrase")]
    w = Window.partitionBy("__p").orderBy(*order) if first else Window.partitionBy("__p", "host_word", F.coalesce("sense_idx", F.lit(-1)), "tier").orderBy(*order)
    got = hit.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("__p", "track", "host_word", "sense_idx", "tier", "raw_phrase")
    return needles.join(got, needles[text].eqNullSafe(got["__p"]), "left").drop("__p")


def cxn_specs(needles: DataFrame, cxn: DataFrame) -> DataFrame:
    """Construction rows of each needle (word, pos or null, sense_idx or null): its pos or none, its sense or all; distinct
    by group, sense and pattern."""
    c = cxn.select([F.col(x).alias(f"c_{x}") for x in cxn.columns])
    j = needles.join(c, F.col("word") == F.col("c_word"))
    j = j.where((F.col("pos").isNull() | F.col("c_pos").isin("", "other") | (F.col("c_pos") == F.col("pos"))) & (F.col("sense_idx").isNull() | (F.col("c_sense_idx") == -1) | (F.col("c_sense_idx") == F.col("sense_idx"))))
    return j.dropDuplicates([*needles.columns, "c_subcat_group", "c_sense_idx", "c_pattern"])


def contrast_words(needles: DataFrame, cxn: DataFrame, limit: int = 12) -> DataFrame:
    """Words of a needle's contrast groups that stand in none of its ban groups in any sense, the most frequent first (ties
    by word); excluded words go after that, then the limit. needles: id, contrast, ban, exclude (arrays)."""
    words = cxn.select("subcat_group", "word", "zipf")
    want = needles.select("id", F.explode("contrast").alias("subcat_group")).join(words, "subcat_group").groupBy("id", "word").agg(F.max("zipf").alias("zipf"))
    barred = needles.select("id", F.explode("ban").alias("subcat_group")).join(words, "subcat_group").select("id", "word")
    out = needles.select("id", F.explode("exclude").alias("word"))
    left = want.join(barred, ["id", "word"], "left_anti").join(out, ["id", "word"], "left_anti")
    return left.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("zipf"), "word"))).where(F.col("place") <= limit)


def banned_words(ban_groups: DataFrame, cxn: DataFrame) -> DataFrame:
    """id, word: words of ban groups; a group whose name is a plain word bans that word."""
    g = ban_groups.select("id", F.explode("ban").alias("subcat_group"))
    return g.join(cxn, "subcat_group").select("id", "word").unionByName(g.where(F.col("subcat_group").rlike("^[a-z]+$")).select("id", F.col("subcat_group").alias("word"))).distinct()
