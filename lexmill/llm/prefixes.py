"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

The tokenizer is byte-pair encoding with word ends: texts are composed (NFC), lower-cased and split into pieces, white space
is dropped, and the last symbol of a piece carries an end mark. A sequence of tokens is what the merges give for its bytes
just when each two neighbours, merged by themselves, stay two. So exactly one token can end the encoding of a prefix of a
piece: the one that stands well beside the last token of the shorter prefix before it. For each byte of a piece the last
token and the count are thus found from those of earlier bytes, once with the end mark (the prefix is cut there) and once
without (the piece goes on); see `PrefixCounter.ends`. Counts of pieces add up, and pieces that are frequent are kept, as
differences from place to place, in a bounded cache. A text of n bytes takes time in proportion to n, long words included.

`count_tokens` gives the counts of whole texts and the longest prefix within a limit; `prefix_table` stores the count of
every prefix, a row for each `block` code points; `longest_prefixes` and `tokens_at` answer questions of truncation and
budget from that table with DataFrame functions, and encode nothing.

Places are code points of the text as it is. A prefix that ends within a sequence that composition joins (a letter before
its accent) counts as the whole sequence, so a truncation never parts them. Strings of special tokens in a text are one
token, as is the library's default; a prefix that ends within one counts as plain text.

Null texts are empty: 0 bytes, 0 tokens, and one row of the prefix table without counts. A null id stays null. Rows that
repeat are counted one by one. Empty tables give empty tables; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import cache, lru_cache
from itertools import accumulate
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import text_slices

MAX_SPEC = 64 << 20
#: The pieces of the vocabulary's pre-tokeniser; they are compared with the file's.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHORT_FORMS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def read_spec(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_SPEC + 1)
    if len(data) > MAX_SPEC:
        raise ValueError(f"{path} is larger than {MAX_SPEC} bytes")
    return data


@cache
def joined_backwards() -> frozenset[str]:
    """Characters that composition may join to what stands before them."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000) if not 0xAC00 <= c < 0xD7A4)
    seconds = {chr(int(p[-1], 16)) for p in pairs if p and not p[0].startswith("<")}
    hangul = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    return frozenset(c for c in seconds | hangul if not c.isascii())


@cache
def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next one from U+0100 on."""
    shown, rest = {*range(33, 127), *range(161, 173), *range(174, 256)}, iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Odd(Exception):
    """A text that needs the library for its pieces."""


class Beside(dict):
    """Whether a token stays by itself before another; looked up when first asked for. At most all pairs that texts have,
    which the caller bounds."""

    def __init__(self, stays, token: int):
        self.stays, self.token = stays, token

    def __missing__(self, other: int) -> bool:
        got = self[other] = self.stays(self.token, other)
        return got


class PrefixCounter:
    """spec: the bytes of a tokenizer's JSON file."""

    def __init__(self, spec: bytes, cache: int = 250_000):
        whole = json.loads(spec)
        model = whole["model"]
        split = whole["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if [n["type"] for n in whole["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or split != PIECES or not (mark := model["end_of_word_suffix"]):
            raise ValueError("another kind of tokenizer")
        self.library = Tokenizer.from_str(spec.decode())
        #: With one space before a piece, if there is one, so that most words take one match.
        self.pieces = regex.compile(" ?(?:" + PIECES.replace(r"[^\s", r"[^\p{White_Space}") + r")|\p{White_Space}+")
        self.space = regex.compile(r"\p{White_Space}")
        specials = sorted((t["content"] for t in whole["added_tokens"]), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        names = sorted({*model["vocab"], *(x for m in merges for x in m)})
        number = {x: i for i, x in enumerate(names)}
        self.rank, self.left, self.right, self.merged = [-1] * len(names), [-1] * len(names), [-1] * len(names), {}
        for r, (a, b) in enumerate(merges):
            self.merged[number[a], number[b]] = r
            t = number[a + b]
            if self.rank[t] >= 0:
                raise ValueError(f"two merges give {a + b}")
            self.rank[t], self.left[t], self.right[t] = r, number[a], number[b]
        sound = self.sound()
        #: Finds all tokens within symbols: (length, number of the token without the end mark, and of that with it, else -1).
        self.tokens = ahocorasick.Automaton()
        bare = {x: i for x, i in number.items() if sound[i] and not x.endswith(mark)}
        marked = {x.removesuffix(mark): i for x, i in number.items() if sound[i] and x.endswith(mark)}
        for x in bare | marked:
            self.tokens.add_word(x, (len(x), bare.get(x, -1), marked.get(x, -1)))
        self.tokens.make_automaton()
        #: By token: which tokens stay beside it. At a piece's start all do.
        self.beside = [Beside(self.stays, i) for i in range(len(names))] + [Beside(lambda a, b: True, len(names))]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.settled: set[str] = set()  # characters that the tables at hand know
        self.cache = cache

    def stays(self, a: int, b: int, below: int | None = None) -> bool:
        """True if tokens a and b side by side stay two, but for merges of rank `below` and more. Between two merges of a
        the symbol at its right edge is one node of its tree, and so for b's left edge; of equal merges the left one comes
        first, so a's edge has taken a merge before it meets b, and b's hasn't. They merge if a pair of edges that meet
        has a rank within the time that they meet."""
        rank, merged = self.rank, self.merged
        upto_a, upto_b = len(merged), len(merged)
        while True:
            r = merged.get((a, b))
            if r is not None and max(rank[a], rank[b] + 1) <= r < upto_a and r <= upto_b and (below is None or r < below):
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:  # going back in time, a's last merge is undone first
                upto_a, a = rank[a], self.right[a]
            else:
                upto_b, b = rank[b], self.left[b]

    def sound(self) -> list[bool]:
        """Tokens whose own bytes are merged to them; those of whose parts one isn't, or whose parts merge otherwise, are not."""
        ok = [True] * len(self.rank)
        for t in sorted(range(len(self.rank)), key=self.rank.__getitem__):
            if self.rank[t] >= 0:
                ok[t] = ok[self.left[t]] and ok[self.right[t]] and self.stays(self.left[t], self.right[t], self.rank[t])
        return ok

    def ends(self, piece: str) -> list[int]:
        """The count of tokens of each prefix of a piece, by code points."""
        plain = piece.isascii() and piece.isprintable()
        w = piece if plain else "".join(map(byte_symbols().__getitem__, piece.encode()))
        last, count, closed = [len(self.rank), *[None] * len(w)], [0] * (len(w) + 1), [None] * (len(w) + 1)
        beside = self.beside
        for end, (n, bare, marked) in self.tokens.iter(w):
            j, i = end + 1, end + 1 - n
            before = last[i]
            if before is None:
                continue  # a byte that has no symbol without the end mark
            if bare >= 0 and last[j] is None and beside[before][bare]:
                last[j], count[j] = bare, count[i] + 1
            if marked >= 0 and closed[j] is None and beside[before][marked]:
                closed[j] = count[i] + 1
        out = closed[1:] if plain else [closed[j] for j in accumulate(len(c.encode()) for c in piece)]
        if None in out:
            raise ValueError(f"{piece!r} can't be encoded")
        return out

    def piece_counts(self, piece: str) -> list[int]:
        counts = self.ends(piece)
        if len(piece) == 3 and piece in SHORT_FORMS:  # cut within, it is a quote and a letter
            counts[1] = counts[0] + self.ends(piece[1])[0]
        return counts

    def steps(self, piece: str) -> bytes:
        """By how much the count grows with each code point of a piece, as 16-bit integers; a piece may have a space before it.
        Kept in two generations: when the newer one is full it becomes the older, from which what is used again returns."""
        got = self.known.get(piece) or self.older.get(piece)
        if got is None:
            spaced = piece[0] == " " and len(piece) > 1 and not self.space.match(piece, 1)
            core = piece[1:] if spaced else piece
            if self.space.match(core):
                got = bytes(2 * len(piece))
            else:
                if not core.isascii() and not self.settled.issuperset(core):
                    if any(unicodedata.category(c) == "Cn" for c in core):
                        raise Odd  # newer than the tables at hand
                    self.settled.update(core)
                counts = self.piece_counts(core)
                got = bytes(2 * spaced) + array("h", map(sub, counts, [0, *counts])).tobytes()
        if len(piece) <= 64:
            if len(self.known) >= self.cache:
                self.older, self.known = self.known, {}
                if sum(map(len, self.beside)) > 2_000_000:
                    for row in self.beside:
                        row.clear()
            self.known[piece] = got
        return got

    def plain_steps(self, text: str) -> np.ndarray:
        """Growth of the count with each code point of a text without special tokens."""
        if text.isascii() or "İ" not in text and unicodedata.is_normalized("NFC", text):
            low = (text if text.isascii() else text.replace("Σ", "σ")).lower()  # each letter by itself: no final sigma
            if len(low) == len(text):
                get, miss = self.known.get, self.steps  # of a generation that may end meanwhile
                try:
                    return np.frombuffer(b"".join([get(p) or miss(p) for p in self.pieces.findall(low)]), "<i2")
                except Odd:
                    pass
        return np.concatenate([np.zeros(0, "<i2"), *(self.odd_steps(s) for s in regex.findall(r"\p{White_Space}+|\P{White_Space}+", text))])

    def odd_steps(self, run: str) -> np.ndarray:
        """plain_steps of a run with or without white space, by the library's own normalising and pieces."""
        if self.space.match(run[0]):
            return np.zeros(len(run), "<i2")
        back = joined_backwards()
        starts = [i for i, c in enumerate(run) if not i or not (unicodedata.combining(c) or c in back)]
        parts = [self.library.normalizer.normalize_str(run[a:b]) for a, b in zip(starts, [*starts[1:], len(run)], strict=True)]
        low, counts, base = "".join(parts), [], 0
        for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(low):
            own = self.piece_counts(low[a:b])
            counts += [base + n for n in own]
            base += own[-1]
        at = np.cumsum([len(p) for p in parts])
        upto = np.concatenate([[0], counts])[at]  # the count after each part, for all code points of it
        return np.diff(np.repeat(upto, np.diff([*starts, len(run)])), prepend=0).astype("<i2")

    def prefixes(self, text: str) -> np.ndarray:
        """The count of tokens of text[: i + 1] for each i."""
        if self.specials is None or not (found := list(self.specials.finditer(text))):
            return self.plain_steps(text).cumsum(dtype=np.int32)
        out, base, start = [], 0, 0
        for m in found:
            out.append(base + self.plain_steps(text[start : m.end() - 1]).cumsum(dtype=np.int32))
            base += (int(out[-1][m.start() - start - 1]) - base if m.start() > start else 0) + 1
            out.append(np.array([base], np.int32))
            start = m.end()
        return np.concatenate([*out, base + self.plain_steps(text[start:]).cumsum(dtype=np.int32)])


@lru_cache(1)
def counter_of(spec: bytes) -> PrefixCounter:
    """One for each Python worker, so that tasks that follow one another share its cache."""
    return PrefixCounter(spec)


def _source(docs: DataFrame, id_: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id_}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").alias("__t"))


def count_tokens(docs: DataFrame, spec: bytes, limit: int, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fits_chars: the code points of the longest prefix of at most `limit` tokens.
    The tokenizer is broadcast (under 2 MB here; refused above `MAX_SPEC` bytes)."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        counter = counter_of(shared.value)
        for b in batches:
            rows = []
            for _, t in text_slices(b, "__t"):
                counts = counter.prefixes((t or b"").decode())
                n = int(counts[-1]) if len(counts) else 0
                within = len(counts) if n <= limit else int(np.nonzero(counts <= limit)[0].max(initial=-1)) + 1
                rows.append((len(t or b""), n, n > limit, within))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.int64())))], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"])

    return _source(docs, id_, text).drop("row").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long")


def prefix_table(docs: DataFrame, spec: bytes, block: int = 4096, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row, block, least, counts: the token counts of the prefixes that end in each `block` code points, and the
    least of them. row tells rows that repeat an id apart. Written out, it answers what follows without the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    schema = "doc_id long, row long, block long, least int, counts array<int>"

    def run(batches):
        counter = counter_of(shared.value)
        for b in batches:
            for (_, t), doc, row in zip(text_slices(b, "__t"), b.column("doc_id").to_pylist(), b.column("row").to_pylist(), strict=True):
                counts = counter.prefixes((t or b"").decode())
                for n, lo in enumerate(range(0, max(1, len(counts)), block)):
                    part = counts[lo : lo + block]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc], pa.int64()), pa.array([row], pa.int64()), pa.array([n], pa.int64()), pa.array([int(part.min()) if len(part) else 0], pa.int32()), pa.array([part], pa.list_(pa.int32()))],
                        ["doc_id", "row", "block", "least", "counts"],
                    )

    return _source(docs, id_, text).mapInArrow(run, schema)


def longest_prefixes(table: DataFrame, limit: Column | int, block: int = 4096) -> DataFrame:
    """doc_id, row, chars: the longest prefix of at most `limit` tokens (a number, or a column of the table), from a
    prefix_table() of the same block."""
    most = F.lit(limit) if isinstance(limit, int) else limit
    place = F.array_max(F.transform("counts", lambda c, i: F.when(c <= most, i + 1).otherwise(0)))
    here = F.when(F.col("least") <= most, F.col("block") * block + place)
    return table.groupBy("doc_id", "row").agg(F.coalesce(F.max(F.when(place > 0, here)), F.lit(0)).cast("long").alias("chars"))


def tokens_at(table: DataFrame, places: DataFrame, block: int = 4096) -> DataFrame:
    """places (doc_id, chars) with n_tokens of that prefix, for each row of the document; null beyond the text's end, in
    negative places and for unknown documents."""
    at = places.select(F.col("doc_id").alias("__d"), "chars", F.when(F.col("chars") > 0, F.floor((F.col("chars") - 1) / block)).otherwise(0).alias("__b"))
    own = table.select("doc_id", "row", "block", "counts")
    place = (F.col("chars") - F.col("block") * block).cast("int")
    n = F.when(F.col("chars") == 0, 0).when(F.col("chars") > 0, F.try_element_at("counts", F.when(place > 0, place)))
    return at.join(own, (F.col("__d") == F.col("doc_id")) & (F.col("__b") == F.col("block")), "left").select(F.col("__d").alias("doc_id"), "row", "chars", n.cast("long").alias("n_tokens"))
