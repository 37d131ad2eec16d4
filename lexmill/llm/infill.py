"""Fill-in-middle transformation with bit-parallel big integers.

A text's UTF-8 bytes become two masks by bytes.translate: a bit for each byte that isn't white space, and one for each byte
that begins a code point. As integers, the text's first byte being the highest bit, one shift and one boolean operation mark
the last byte of every unit of the text at once; bit_count gives how many there are; and the place of the k-th is found by
halving the integer, counting one half, and going on in the half that holds it, so the work is that of the first halving
twice over. Numbers of code points are bit counts of slices of the second mask.

A unit is white space with the word that follows it, or the white space at the text's end. Cuts and forms are drawn from a
hash of seed and doc_id, so reruns agree. `transform` rewrites texts, `restore` gets them back from output and form alone.

Null texts are empty; empty texts and those that hold a sentinel stay plain. A null id draws as if it had no digits. Rows that
repeat an id are cut at the same draws. Empty tables give empty tables; all other columns pass, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import free_name, text_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: '1' for each byte that isn't white space; '1' for each byte that begins a code point.
SOLID = bytes(48 if b == 32 or 9 <= b <= 13 else 49 for b in range(256))
FIRST = bytes(48 if 0x80 <= b < 0xC0 else 49 for b in range(256))


def mask(data: bytes, kind: bytes) -> int:
    return int(data.translate(kind), 2) if data else 0


def unit_ends(data: bytes) -> int:
    """A bit for the last byte of each unit: a solid byte that no solid byte follows, and the last byte of all."""
    solid = mask(data, SOLID)
    return solid & ~(solid << 1) | (1 if data else 0)


def place(bits: int, width: int, k: int) -> int:
    """How many of `width` bits, from the highest on, it takes to hold k set ones; k of them there are."""
    done = 0
    while width > 1 and k:
        low = width >> 1
        high = bits >> low
        n = high.bit_count()
        if k <= n:
            bits, width = high, width - low
        else:
            bits, k, done, width = bits & ((1 << low) - 1), k - n, done + width - low, low
    return done + (1 if k else 0)


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of the seed and the id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4]) for i in (0, 4, 8, 12))


def rewrite(data: bytes, drawn: tuple[int, int, int, int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and middle, output) of a text."""
    ends = unit_ends(data)
    n = ends.bit_count()
    if not data or drawn[2] % 100 >= rate or PREFIX in data or SUFFIX in data or MIDDLE in data:
        return n, "plain", None, None, data
    a, b = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    i = place(ends, len(data), a)
    rest = ends & ((1 << len(data) - i) - 1)  # the second place is looked for behind the first
    j = i + place(rest, len(data) - i, b - a)
    chars = [mask(part, FIRST).bit_count() for part in (data[:i], data[i:j])]
    if drawn[3] % 100 < spm:
        return n, "spm", *chars, b"".join((SUFFIX, data[j:], PREFIX, data[:i], MIDDLE, data[i:j]))
    return n, "psm", *chars, b"".join((PREFIX, data[:i], SUFFIX, data[j:], MIDDLE, data[i:j]))


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_: str = "doc_id", text: str = "text", names: tuple[str, str, str, str] = ("n", "form", "prefix_chars", "middle_chars")) -> DataFrame:
    """docs with the text rewritten, and the four named columns (columns of those names give way). rate: hundredths of the
    texts that are rewritten; spm: hundredths of those whose suffix comes first."""
    taken = [c for c in docs.columns if c.lower() not in {x.lower() for x in names} or c in (id_, text)]
    src = docs.select(*(F.col(f"`{c}`") for c in taken))
    schema = StructType([*(StructField(text, StringType(), True) if f.name == text else f for f in src.schema.fields), *(StructField(c, StringType() if c == names[1] else LongType(), True) for c in names)])

    def run(batches):
        for b in batches:
            rows = [rewrite(t or b"", draws(seed, key), rate, spm) for (_, t), key in zip(text_slices(b, text), b.column(id_).to_pylist(), strict=True)]
            out = pa.array([r[4] for r in rows], pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            cols = [out if c == text else b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([r[i] for r in rows], pa.string() if i == 1 else pa.int64()) for i in range(4))], [*b.schema.names, *names])

    return src.mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. Sentinels stand in it three times at most, as texts that hold one stay plain."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1]))


def digests(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of documents."""
    t = free_name(["doc_id", "n", "form", "prefix_chars", "middle_chars"], "text")
    made = transform(docs.select("doc_id", F.col("text").alias(t)), seed, text=t)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(t, 256).alias("output_sha256"), F.sha2(restore(F.col(t), F.col("form")), 256).alias("restored_sha256"))
