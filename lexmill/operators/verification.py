"""Extracted items held against their sources: quotes are snapped to sentences, wrong quotes replaced, repeats and inventions
taken out, headwords brought to their lemma, in this order, each step on what the ones before left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.forms import base_verb, inflected_forms
from ..functions.text import clean_core, ngram_coverage, words
from .iterate import cut
from .snapping import bare, snap

#: Words of a headword that stand for any other; the least coverage of a quote that is taken for genuine.
STOPS = ("something", "somebody", "ones", "someone", "sb", "sth", "entity", "field", "area", "role", "object", "domain", "type", "situation", "goal")
GENUINE = 0.85
#: Why an item goes, in the order in which the reasons are tried.
REASONS = ("empty", "same family", "repeated", "invented", "unmatched")


def headword(word: Column) -> Column:
    """A headword without its slots, cleaned."""
    return clean_core(F.regexp_replace(word, r"\[.*?\]|\(.*?\)", " "))


def forms_of(tok: Column) -> Column:
    return F.array_distinct(F.concat(inflected_forms(tok), inflected_forms(base_verb(tok))))


def form_in(tok: Column, forms: Column, text: Column) -> Column:
    """Whether a cleaned text has a word: one of its forms as a word, or its first four letters anywhere; adverbs in -ly must
    stand as they are."""
    whole = F.arrays_overlap(words(text), forms)
    return whole | (~((F.length(tok) >= 5) & F.endswith(tok, F.lit("ly"))) & F.contains(text, F.substring(tok, 1, 4)) & ((F.length(tok) >= 4) | F.contains(text, tok)))


def matched(toks: Column, text: Column) -> Column:
    """How many of a headword's words (structs of w and forms) a text has."""
    return F.size(F.filter(toks, lambda t: form_in(t["w"], t["forms"], text)))


def enough(toks: Column) -> Column:
    """Half of the words, rounded up."""
    return F.greatest(F.lit(1), F.ceil(F.size(toks) / 2).cast("int"))


def verify(items: DataFrame, docs: DataFrame, pool: DataFrame, families: DataFrame, lemmas: DataFrame) -> DataFrame:
    """items (doc_id, item, word, quote; items of a document in the order of their numbers) with headword, final_quote, mended
    (snapped, swapped or null), kept and reason.

    A quote snaps to the sentence that it is from. If it then lacks half of the headword's words, though the document has
    them all, the shortest sentence with all of them takes its place (the first of equal ones). An item goes if it has neither
    word nor quote; if an earlier one has a word of its family, or its word; if half of its words stand neither in its quote
    nor in the document; if they aren't in its quote and the quote isn't in the document (a coverage under 0.85). What stays
    has its lemma as headword, but for headwords of several words. Nulls count as empty; items without a document are
    invented. families: w, family; lemmas: w, lemma. A document's items and sentences meet in one row, as they do in one
    answer; forms are made once for each word."""
    it = items.select("doc_id", "item", F.coalesce("word", F.lit("")).alias("word"), F.coalesce("quote", F.lit("")).alias("quote"))
    it = it.withColumn("clean", headword(F.col("word")))
    vocabulary = it.select(F.explode(words(F.col("clean"))).alias("w")).distinct()
    vocabulary = cut(vocabulary.select("w", forms_of(F.col("w")).alias("forms")))
    toks = it.select("doc_id", "item", F.posexplode(words(F.col("clean"))).alias("n", "w")).where(~F.col("w").isin(*STOPS)).join(vocabulary, "w")
    toks = toks.groupBy("doc_id", "item").agg(F.sort_array(F.collect_list(F.struct("n", "w", "forms"))).alias("toks"))
    snapped = snap(it.select("doc_id", F.col("item").alias("quote_id"), "quote"), pool).select("doc_id", F.col("quote_id").alias("item"), "sentence")
    it = it.join(toks, ["doc_id", "item"], "left").join(snapped, ["doc_id", "item"], "left")
    it = it.withColumn("toks", F.coalesce("toks", F.array().cast("array<struct<n: int, w: string, forms: array<string>>>"))).withColumn("q", F.coalesce("sentence", bare(F.col("quote"))))
    it = cut(it)
    per = it.groupBy("doc_id").agg(F.collect_list(F.struct("item", "word", "clean", "quote", "toks", "q")).alias("items"))
    sents = pool.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sid", bare(F.col("text")).alias("s"), clean_core(bare(F.col("text"))).alias("core")))).alias("sents"))
    source = docs.select("doc_id", F.coalesce(clean_core(F.col("text")), F.lit("")).alias("source"))
    per = per.join(source, "doc_id", "left").join(sents, "doc_id", "left").withColumn("source", F.coalesce("source", F.lit(""))).withColumn("sents", F.coalesce("sents", F.array().cast(sents.schema["sents"].dataType)))

    with_ = lambda x, names, **more: F.struct(*(x[c].alias(c) for c in names), *(v.alias(k) for k, v in more.items()))
    # step by step, so that what a step takes from the one before is a field, not an expression repeated
    base = ("item", "word", "clean", "quote", "toks", "q")
    items_ = F.transform("items", lambda x: with_(x, base, core=clean_core(x["q"]), n=F.size(x["toks"])))

    def lacking(x: Column) -> Column:
        lacks = (x["n"] > 0) & (matched(x["toks"], x["core"]) < enough(x["toks"])) & (matched(x["toks"], F.col("source")) == x["n"])
        fit = F.when(lacks, F.filter("sents", lambda s: matched(x["toks"], s["core"]) == x["n"]))
        best = F.array_min(F.transform(fit, lambda s: F.struct(F.length(s["s"]).alias("n"), s["sid"].alias("sid"), s["s"].alias("s"), s["core"].alias("core"))))
        return with_(x, (*base, "core", "n"), best=best)

    def settled(x: Column) -> Column:
        mended = F.when(x["best"].isNotNull(), "swapped").when(x["q"] != F.trim(x["quote"]), "snapped")
        return with_(x, ("item", "word", "clean", "toks", "n"), final_quote=F.coalesce(x["best"]["s"], x["q"]), core=F.coalesce(x["best"]["core"], x["core"]), mended=mended)

    def judged(x: Column) -> Column:
        has = lambda text: F.when(x["n"] > 0, matched(x["toks"], text) >= enough(x["toks"])).otherwise(F.contains(text, x["clean"]))
        return with_(x, ("item", "word", "clean", "final_quote", "core", "mended"), here=has(x["core"]), there=has(F.col("source")), inside=(x["core"] == "") | F.contains(F.col("source"), x["core"]))

    items_ = F.transform(F.transform(F.transform(items_, lacking), settled), judged)
    out = per.select("doc_id", "source", F.explode(items_).alias("x")).select("doc_id", "source", "x.*")
    unknown = ~F.col("inside") & (ngram_coverage(F.col("core"), F.col("source")) < GENUINE)
    fault = F.when((F.col("word") == "") & (F.col("final_quote") == ""), REASONS[0]).when(~F.col("here") & ~F.col("there"), REASONS[3]).when(~F.col("here") & unknown, REASONS[4])
    out = cut(out.select("doc_id", "item", "word", "clean", "final_quote", "mended", fault.alias("fault")))
    # repeats are looked for among all items that aren't repeats themselves, whatever becomes of them later
    out = out.join(families.select(F.col("w").alias("fw"), "family"), F.col("clean") == F.col("fw"), "left").withColumn("kin", F.coalesce("family", "clean"))
    empty = (F.col("clean") == "") | (F.col("fault") == REASONS[0])
    order = lambda c: F.row_number().over(Window.partitionBy("doc_id", c, empty).orderBy("item"))
    out = out.withColumn("word_no", order("clean")).withColumn("kin_no", order("kin"))
    repeat = F.when(~F.coalesce(empty, F.lit(False)) & (F.col("kin_no") > 1), F.when(F.col("word_no") > 1, REASONS[2]).otherwise(REASONS[1]))
    reason = F.when(F.col("fault") == REASONS[0], F.col("fault")).otherwise(F.coalesce(repeat, F.col("fault")))
    out = out.join(lemmas.select(F.col("w").alias("lw"), "lemma"), (F.col("clean") == F.col("lw")) & (F.lower(F.trim("word")) == F.col("lw")), "left")
    return out.select("doc_id", "item", "word", F.when(reason.isNull(), F.coalesce("lemma", "word")).alias("headword"), "final_quote", "mended", reason.isNull().alias("kept"), reason.alias("reason"))
