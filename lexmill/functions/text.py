"""Text normalisation as Column expressions. Null in, null out, unless a function says otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Word characters as the matched gates count them: letters, numbers and the underscore; combining marks are none.
WORD = r"\p{L}\p{N}_"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, for which Spark has no built-in."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def replaced(c: Column, *rules: tuple[str, str]) -> Column:
    """c after each (pattern, replacement) in turn."""
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def squeezed(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}\x1C-\x1F\x85]+", " "))


def normalize_text(c: Column, compose: bool = False) -> Column:
    """Lower-cased text without Markdown marks, dots, quotes, sentence pointers and brackets. compose: NFKC first, by a
    pandas UDF; leave it out for text that is already composed, so that the expression stays in the JVM."""
    c = F.lower(nfkc(c) if compose else c)
    return squeezed(
        replaced(
            c,
            (r"[*_`~]+", " "),
            (r"(\.{2,}|…)", " "),
            (r"[“”‘’\"'«»]+", ""),
            (r"\[?\bs-\d+\b\]?[:\-]?", " "),
            (r"[\[\](){}<>]+", " "),
        )
    )


def clean_core(c: Column, compose: bool = False) -> Column:
    """normalize_text without anything but word characters and blanks; blanks aren't collapsed a second time."""
    return F.trim(F.regexp_replace(normalize_text(c, compose), rf"[^{WORD}\s]", ""))


def words(c: Column) -> Column:
    """The parts of c between blanks, without empty ones."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of an array of tokens, joined by blanks; none if there are fewer tokens. The array is shifted against
    itself: a lambda that sliced it would have it computed anew for each place."""
    out = tokens
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(tokens, k, F.size(tokens)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(out)


def ngram_coverage(quote: Column, source: Column, n: int = 3) -> Column:
    """Share of a cleaned quote's distinct n-grams that the cleaned source has. A quote under n words: 1 if the source
    contains it, else the share of its words, repeats counted, among the source's. Nothing to compare: 0."""
    q, s = words(quote), words(source)
    grams = F.array_distinct(ngrams(q, n))
    short = F.when(F.contains(source, quote), F.lit(1.0)).otherwise(F.size(F.filter(q, lambda w: F.array_contains(s, w))) / F.size(q))
    full = F.size(F.array_intersect(grams, ngrams(s, n))) / F.size(grams)
    return F.when((F.size(q) == 0) | (F.size(s) == 0), F.lit(0.0)).when(F.size(q) < n, short).otherwise(full)


def strip_lexical_quotes(c: Column) -> Column:
    """Without quote marks round words; contractions and possessives keep their apostrophe."""
    c = F.translate(c, "‘’“”", "''\"\"")
    return squeezed(replaced(c, (r'"', ""), (r"(?<![A-Za-z])'(?=[A-Za-z])", ""), (r"(?<![sA-Za-z])'(?![A-Za-z])", ""), (r"(?<=[a-rt-zA-RT-Z.,!?])'(?![A-Za-z])", "")))


def normalize_name(c: Column) -> Column:
    """Key of a unit: without a file ending, lower-cased, letters and digits alone."""
    return replaced(F.lower(F.regexp_replace(c, r"(?i)\.(md|txt|html|json)$", "")), (r"[^a-z0-9]", ""))


def unit_stem(path: Column) -> Column:
    """The path part after `wiki`, else after `raw`, else the first; the part itself if it is the last. Without .md or .txt."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: p != "")

    def after(name: str) -> Column:
        at = F.array_position(parts, name).cast("int")
        return F.when(at > 0, F.try_element_at(parts, F.least(at + 1, F.size(parts))))

    return F.regexp_replace(F.coalesce(after("wiki"), after("raw"), F.try_element_at(parts, F.lit(1)), path), r"(\.md|\.txt)$", "")


def kebab(tag: Column) -> Column:
    return F.lower(replaced(tag, (r"(?i)\.md$", ""), (r"[\s_]+", "-")))


def normalized_tags(front_matter: Column) -> Column:
    """The tags of a `tags: [a, b]` line in kebab case, the first of equal ones kept in place; null without such a line."""
    inner = F.regexp_extract(front_matter, r"tags:\s*\[(.*?)\]", 1)
    parts = F.filter(F.transform(F.split(inner, ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.when(front_matter.rlike(r"tags:\s*\[(.*?)\]"), F.array_distinct(F.transform(parts, lambda t: kebab(replaced(t, (r'^"+|"+$', ""), (r"^'+|'+$", ""))))))


def expression_atoms(c: Column) -> Column:
    """Words of an expression, and the stems of those in -ing and -ed; hyphenated words stay whole."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]+(?:-[a-z]+)*)"), 1)
    stem = F.transform(
        found,
        lambda w: F.when(F.contains(w, F.lit("-")), F.lit(None))
        .when(w == "granted", F.lit("grant"))
        .when(F.endswith(w, F.lit("ing")), F.substring(w, F.lit(1), F.length(w) - 3))
        .when(F.endswith(w, F.lit("ed")), F.substring(w, F.lit(1), F.length(w) - 2)),
    )
    return F.array_sort(F.array_distinct(F.concat(found, F.array_compact(stem))))


def inflected_variants(c: Column) -> Column:
    """Surface forms that a word can plausibly take, by suffix alone; forms under three letters are left out. Sorted."""
    w = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", "")

    def cut(n: int) -> Column:
        return F.substring(w, F.lit(1), F.length(w) - n)

    plain = [w, *(F.concat(w, F.lit(s)) for s in ("s", "es", "d", "ed", "ing"))]
    in_y = F.endswith(w, F.lit("y")) & (F.length(w) > 2)
    in_e = F.endswith(w, F.lit("e")) & (F.length(w) > 3)
    more = [*(F.when(in_y, F.concat(cut(1), F.lit(s))) for s in ("ies", "ied")), *(F.when(in_e, F.concat(cut(1), F.lit(s))) for s in ("ing", "s"))]
    for suffix in ("ies", "ied", "ing", "es", "ed", "s", "d"):
        has = F.endswith(w, F.lit(suffix)) & (F.length(w) - len(suffix) >= 3)
        more += [F.when(has, F.concat(cut(len(suffix)), F.lit(s))) for s in ("", "s", "es", "d", "ed", "ing")]
    return F.array_sort(F.array_distinct(F.filter(F.array_compact(F.array(*plain, *more)), lambda f: (F.length(f) >= 3) & (w != ""))))


def same_stem(a: Column, b: Column) -> Column:
    """Equal after cleaning, or equal stems of four letters at least after one suffix is cut off."""
    a, b = clean_core(a), clean_core(b)
    cut = r"(?:ed|ing|s|es|ly|tion|ment)$"
    x, y = F.regexp_replace(a, cut, ""), F.regexp_replace(b, cut, "")
    return (a != "") & (b != "") & ((a == b) | ((F.length(x) >= 4) & (F.length(y) >= 4) & (x == y)))


def format_timestamp(seconds: Column) -> Column:
    """[MM:SS.ss], or [HH:MM:SS.ss] from an hour on."""
    h, m, s = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60), seconds % 60
    return F.when(h > 0, F.format_string("[%02d:%02d:%05.2f]", h, m, s)).otherwise(F.format_string("[%02d:%05.2f]", m, s))


def timestamp_seconds(c: Column) -> Column:
    """Seconds of [MM:SS.ss] or [HH:MM:SS.ss], brackets optional; 0 for anything else."""
    p = F.split(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^[\[\]]+|[\[\]]+$", ""), ":")

    def number(i: int, kind: str) -> Column:
        return F.trim(F.try_element_at(p, F.lit(i))).try_cast(kind)

    three = number(1, "int") * 3600 + number(2, "int") * 60 + number(3, "double")
    two = number(1, "int") * 60 + number(2, "double")
    return F.coalesce(F.when(F.size(p) == 3, three).when(F.size(p) == 2, two).otherwise(number(1, "double")), F.lit(0.0))


def media_url(c: Column) -> Column:
    """The first url of a share text without closing punctuation, or the page of a bare BV id; else the trimmed text."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    url = F.regexp_extract(raw, r"(https?://[^\s\"'<>]+)", 1)
    return F.when(raw.rlike("^BV[0-9A-Za-z]{10}$"), F.concat(F.lit("https://www.bilibili.com/video/"), raw)).when(url != "", F.regexp_replace(url, r"[.,;!)】\]]+$", "")).otherwise(raw)


def is_remote(c: Column) -> Column:
    return media_url(c).rlike("^https?://")


def video_id(c: Column) -> Column:
    """The 11 characters of a video id in any form of its url, or bare; null if there is none."""
    u = media_url(c)
    found = F.regexp_extract(u, r"(?:youtube\.com/(?:watch\?.*?v=|embed/|shorts/|v/)|youtu\.be/)([0-9A-Za-z_-]{11})(?:[?&/#]|$)", 1)
    bare = u.rlike("^[0-9A-Za-z_-]{11}$") & ~F.lower(u).rlike("^(http|bv|av)")
    return F.when(found != "", found).when(bare, u)
