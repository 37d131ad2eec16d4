"""String similarity and the sound of spellings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import replaced

#: Endings and the sounds they stand for, in the order in which they are tried.
ENDINGS = (
    ("ceed", "seed"), ("cede", "seed"), ("sede", "seed"), ("ceive", "seev"), ("lieve", "leev"), ("ight", "ite"), ("ought", "awt"), ("aught", "awt"),
    ("ssion", "shun"), ("scion", "shun"), ("tion", "shun"), ("sion", "shun"), ("cian", "shun"), ("cial", "shul"), ("tial", "shul"), ("ious", "us"), ("eous", "us"), ("ous", "us"),
)
FAR = 99


def bounded_distance(a: Column, b: Column) -> Column:
    """Edit distance up to 2, else 99."""
    d = F.levenshtein(a, b, 2)
    return F.when(d < 0, F.lit(FAR)).otherwise(d)


LONGEST = 20  # letters up to which prefixes are compared without a loop


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading characters. Words of up to LONGEST letters are compared prefix by prefix, in generated code."""
    n = F.least(F.length(a), F.length(b))
    steps = sum(((F.substring(a, 1, k) == F.substring(b, 1, k)) & (n >= k)).cast("int") for k in range(1, LONGEST + 1))
    return F.when(n <= LONGEST, steps).otherwise(looped_prefix(a, b))


def looped_prefix(a: Column, b: Column) -> Column:
    """common_prefix of words of any length, by little code."""
    n = F.least(F.length(a), F.length(b))
    # the longest prefix is where the first difference is: no loop beyond it has to be kept
    differ = F.array_position(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))), True)
    return F.when(n == 0, 0).when(differ == 0, n).otherwise(differ.cast("int") - 1)


#: Words of up to this many characters, all ASCII, are compared as numbers.
PACKED = 24


def packed(word: Column) -> Column:
    """What the comparison of many pairs needs of a word, computed once: n, its characters as numbers of eight each (null for
    words that aren't ASCII or longer than PACKED), and which letters it has an odd number of times, by code point mod 64."""
    number = lambda i: F.conv(F.hex(F.rpad(F.substring(word, 8 * i + 1, 8), 8, "\0")), 16, 10).cast("long")
    fits = (F.length(word) <= PACKED) & (F.octet_length(word) == F.length(word))
    odd = F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))
    return F.struct(F.length(word).alias("n"), *(F.when(fits, number(i)).alias(f"w{i}") for i in range(PACKED // 8)), odd.alias("odd"))


def packed_prefix(a: Column, b: Column, a_word: Column, b_word: Column) -> Column:
    """common_prefix of two words by what `packed` says of them: the place of the first byte that differs."""
    least = F.least(a["n"], b["n"])
    out = least
    for i in reversed(range(PACKED // 8)):
        x = a[f"w{i}"].bitwiseXOR(b[f"w{i}"])  # never negative, as no byte of ASCII has the highest bit
        place = F.when(x >= 1 << 32, F.when(x >= 1 << 48, F.when(x >= 1 << 56, 0).otherwise(1)).otherwise(F.when(x >= 1 << 40, 2).otherwise(3))).otherwise(F.when(x >= 1 << 16, F.when(x >= 1 << 24, 4).otherwise(5)).otherwise(F.when(x >= 1 << 8, 6).otherwise(7)))
        out = F.when(x != 0, place + 8 * i).otherwise(out)
    return F.when(a["w0"].isNotNull() & b["w0"].isNotNull(), out).otherwise(looped_prefix(a_word, b_word))


def packed_distance(a: Column, b: Column, a_word: Column, b_word: Column) -> Column:
    """bounded_distance of two words by what `packed` says of them: an edit changes the length by one at most and the parity
    of two letters at most, so that most pairs need no comparison."""
    far = (F.abs(a["n"] - b["n"]) > 2) | (F.bit_count(a["odd"].bitwiseXOR(b["odd"])) > 4)
    return F.when(far, FAR).otherwise(bounded_distance(a_word, b_word))


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def consonant_skeleton(word: Column) -> Column:
    """Consonants of a spelling by sound: silent letters gone, c as s or k, vowels dropped, doubles once. The rules are fixed
    values, in the order in which they are tried."""
    w = F.lower(F.trim(F.coalesce(word, F.lit(""))))
    return replaced(
        w, ("^kn", "n"), ("^wr", "r"), ("^ps", "s"), ("^wh", "w"), ("ph", "f"), ("qu", "kw"), ("x", "ks"), ("ck", "k"), ("dg", "j"),
        ("c(?=[eiy])", "s"), ("c", "k"), ("gh(?=[aeiouy]|$)", ""), ("[aeiouy]+", ""), (r"(.)\1+", "$1"),
    )


def rhyme_tail(word: Column) -> Column:
    """Sound of a spelling from its last vowel group on, or from the one before if the last is a mute or a short end."""
    w = F.lower(F.trim(F.coalesce(word, F.lit(""))))
    said = F.coalesce(*(F.when(F.endswith(w, F.lit(a)), F.concat(F.substring(w, F.lit(1), F.length(w) - len(a)), F.lit(b))) for a, b in ENDINGS), w)
    groups = F.regexp_extract_all(said, F.lit("([aeiouy]+[^aeiouy]*)"), 1)
    last, two = F.try_element_at(groups, F.lit(-1)), F.concat(F.try_element_at(groups, F.lit(-2)), F.try_element_at(groups, F.lit(-1)))
    mute = (F.size(groups) >= 2) & ((F.endswith(said, F.lit("e")) & (F.length(last) <= 2)) | (F.length(last) <= 3))
    tail = replaced(F.when(mute, two).otherwise(last), ("c(?=[eiy])", "s"), ("c", "k"), ("ph", "f"))
    return F.when(F.length(w) < 3, w).when(F.size(groups) == 0, F.substring(said, F.greatest(F.length(said) - 2, F.lit(1)), F.lit(3))).otherwise(tail)


def syllables(word: Column) -> Column:
    """Vowel groups, a final mute e left out; 1 at least, 0 for an empty word."""
    w = F.lower(F.trim(F.coalesce(word, F.lit(""))))
    mute = F.endswith(w, F.lit("e")) & ~w.rlike("(le|ee|ie|oe|ue)$") & (F.length(w) > 3)
    heard = F.when(mute, F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.when(w == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.regexp_count(heard, F.lit("[aeiouy]+"))))
