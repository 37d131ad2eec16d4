"""Checks of generated items as Column expressions: contractions, formulas, invented quotes, shared wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import inflected_variants, replaced

#: Contractions of lower-cased text (either apostrophe) and what they stand for.
CONTRACTIONS = (
    (r"\bits\b", "it is"),
    (r"\bcan['’]t\b", "cannot"),
    (r"\bwon['’]t\b", "will not"),
    (r"\bi['’]m\b", "i am"),
    (r"\b(it|that|there|what|here|he|she|who)['’]s\b", "$1 is"),
    (r"\b(you|we|they)['’]re\b", "$1 are"),
    (r"\b(do|does|did|is|are|was|were|have|has|had|would|should|could|must)n['’]t\b", "$1 not"),
    (r"\b(i|you|we|they)['’]ve\b", "$1 have"),
    (r"\b(i|you|he|she|we|they)['’]ll\b", "$1 will"),
    (r"\b(i|you|he|she|we|they)['’]d\b", "$1 would"),
)
#: Words by which a quote says that it isn't in the text, and slots that only a pattern has.
INVENTED = ("not present in text", "not in text", "not found in text", "not in source", "inferred from", "implied by", "constructed from", "not explicitly mentioned")
SLOTS = r"(?i)\[(?:S|NP|VP|V|to-V|V3|V-ing|adj|adv|be|aux|modal)\]"
#: Names of a formula's slots for what they stand for.
SLOT_NAMES = {
    "np": ("np", "n", "noun", "noun phrase", "n phrase"),
    "vp": ("vp", "verb phrase", "predicate"),
    "s": ("s", "subject"),
    "v": ("v", "verb"),
    "v-ing": ("v ing", "participle", "participial phrase"),
    "v-ed": ("v ed", "v3", "past participle"),
    "adj": ("adj", "adjective", "adj phrase"),
    "adv": ("adv", "adverb", "adv phrase"),
    "prep": ("prep", "prepp", "preposition"),
    "det": ("det", "determiner"),
    "conj": ("conj", "conjunction"),
    "modal": ("modal", "modal verb", "modal vp"),
    "clause": ("clause", "main clause", "subordinate clause"),
    "to-v": ("to verb", "infinitive"),
    "wh": ("wh", "wh word", "relative pronoun"),
    "o": ("o", "object"),
}


def expand_contractions(c: Column) -> Column:
    """Lower-cased text with contractions written out."""
    return replaced(F.lower(c), *CONTRACTIONS)


def invented(quote: Column) -> Column:
    """A quote that says of itself that it isn't in the text, or that is a pattern with slots."""
    low = F.lower(quote)
    out = quote.rlike(SLOTS)
    for x in INVENTED:
        out = out | F.contains(low, F.lit(x))
    return out


def slot_identity(slot: Column) -> Column:
    """What a slot's name stands for; an unknown name for itself, its runs of letters and digits parted by blanks."""
    c = F.trim(F.regexp_replace(F.lower(slot), "[^a-z0-9]+", " "))
    return F.coalesce(*(F.when(c.isin(*names), k) for k, names in SLOT_NAMES.items()), c)


def formula_key(formula: Column) -> Column:
    """What formulas that differ in case, spacing, separators and slot names have in common; empty for null."""
    low = F.lower(F.coalesce(formula, F.lit("")))
    parts = F.regexp_extract_all(low, F.lit(r"(\[[^\]]*\]|[^\[]+|\[)"), 1)
    named = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\[[^\]]*\]$"), F.concat(F.lit("["), slot_identity(F.substring(p, F.lit(2), F.length(p) - 2)), F.lit("]"))).otherwise(p)), "")
    key = F.trim(replaced(named, (r"\+", " "), (r"\s*,\s*", ","), (r"[^a-z0-9()\[\]/']+", " "), (r"\s+", " ")))
    return F.regexp_replace(key, r"^\.+|\.+$", "")


def degenerate_slots(formula: Column) -> Column:
    """Slots and words, slots first, that offer names of one and the same thing, as [NP/Noun]; an array."""
    f = F.coalesce(formula, F.lit(""))
    slots = F.regexp_extract_all(f, F.lit(r"\[([^\]]+)\]"), 1)
    bare = F.filter(F.split(F.trim(F.regexp_replace(f, r"\[[^\]]*\]", " ")), r"\s+"), lambda w: w != "")

    def one(x: Column) -> Column:
        parts = F.filter(F.split(x, "/"), lambda p: F.trim(p) != "")
        return (F.size(parts) >= 2) & (F.size(F.array_distinct(F.transform(parts, slot_identity))) == 1)

    return F.transform(F.filter(F.concat(slots, bare), one), lambda x: F.trim(x))


def source_variants(source: Column, target: Column) -> Column:
    """A source's tokens and, where it has forms of the target, its tokens without them; an array of arrays."""
    tokens = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(source, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: w != "")
    forms = inflected_variants(target)
    kept = F.filter(tokens, lambda w: ~F.array_contains(forms, w))
    none = F.array().cast("array<array<string>>")
    return F.when(F.size(tokens) == 0, none).when(F.size(kept) == F.size(tokens), F.array(tokens)).otherwise(F.array(tokens, kept))


def longest_shared_run(a: Column, b: Column, most: int = 29) -> Column:
    """The most consecutive words, up to `most`, that both texts have. A run is in b if it is among b's words between blanks;
    the lengths that occur are all those up to the longest, so lengths are tried from each word on until one isn't there."""
    w1, w2 = (F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1) for x in (a, b))
    text = F.concat(F.lit(" "), F.array_join(w2, " "), F.lit(" "))

    def run(i: Column) -> Column:
        """How many words from place i on stand in b: grown word by word from what stood there before."""
        start = F.struct(F.lit(" ").alias("t"), F.lit(0).alias("n"), F.lit(True).alias("on"))

        def longer(s: Column, w: Column) -> Column:
            t = F.concat(s["t"], w, F.lit(" "))
            more = s["on"] & F.contains(text, t)
            return F.struct(F.when(more, t).otherwise(s["t"]).alias("t"), (s["n"] + more.cast("int")).alias("n"), more.alias("on"))

        return F.aggregate(F.slice(w1, i, most), start, longer, lambda s: s["n"])

    return F.when((F.size(w1) == 0) | (F.size(w2) == 0), F.lit(0)).otherwise(F.array_max(F.transform(F.sequence(F.lit(1), F.size(w1)), run)))


def matches_wordlist(target: Column, wordlist: Column) -> Column:
    """A cleaned target that is a headword of the list, or each token of which is a token of one headword, or begins with
    the same four letters."""
    t = F.filter(F.split(target, " "), lambda w: w != "")

    def like(x: Column, y: Column) -> Column:
        return (x == y) | ((F.length(x) >= 4) & (F.length(y) >= 4) & (F.substring(x, 1, 4) == F.substring(y, 1, 4)))

    some = F.exists(wordlist, lambda h: F.forall(t, lambda x: F.exists(F.filter(F.split(h, " "), lambda w: w != ""), lambda y: like(x, y))))
    return F.array_contains(wordlist, target) | ((F.size(t) > 0) & some)


