"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of more than `chunk` + `overlap` characters is cut into chunks of `chunk` characters, each followed by `overlap`
characters of the next. The chunks of a text of more than `spread` characters become rows that are dealt to all tasks;
those of a shorter one, a fraction of a second's work, are read where the text stands. Every chunk is pre-tokenised by itself, from
its own first character, which may lie within a pre-token, and its pre-tokens are encoded, each by itself; a bounded cache
holds those that are frequent. A row per chunk then goes to its document, in order: its ids, and its pre-token boundaries
within the two overlaps. Where two neighbours overlap, the first place that is a boundary in both is the stitch: the pattern
looks at nothing before a match, so from a common boundary on both go the same way. The left chunk's ids count up to the
stitch, the right one's from there on. (A chunk's last boundary is not used: the pattern looks one character ahead.) If an
overlap has no common boundary, as within a word of thousands of letters, that document is read in one piece. Decoding
concatenates the bytes of the ids.

The rank file is read on the driver and broadcast (under 1 MB here; refused above `MAX_RANKS` bytes). Null texts are
empty; empty texts have no ids. Rows that repeat are encoded one by one. Lone surrogates can't occur in Spark strings.
Empty tables give empty tables; other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import stash, text_slices

MAX_RANKS = 64 << 20


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_RANKS + 1)
    if len(data) > MAX_RANKS:
        raise ValueError(f"{path} is larger than {MAX_RANKS} bytes")
    return data


class Codec:
    """Ranks and pattern; chunk and overlap in characters."""

    def __init__(self, ranks: bytes, pattern: str, chunk: int = 1 << 15, overlap: int = 256, cache: int = 200_000):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes = {i: t for t, i in table.items()}
        # \s of Rust's and of Python's engine differ in x1C-x1F
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.chunk, self.overlap, self.cache = chunk, overlap, cache
        self.known: dict[str, tuple[int, ...]] = {}

    def chunks(self, text: str):
        """(number, chunk with the overlap that follows it) of a long text."""
        for n, start in enumerate(range(0, max(1, len(text) - self.overlap), self.chunk)):
            last = start + self.chunk >= len(text) - self.overlap
            yield n, text[start:] if last else text[start : start + self.chunk + self.overlap]

    def encode_chunk(self, piece: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, boundaries within the overlaps, how many ids stand before each): places from the chunk's start; the last
        boundary, which may be none in the text, isn't among them."""
        ids: list[int] = []
        ends, before, pos = [0], [0], 0
        get, miss = self.known.get, self.encode_piece
        for p in self.pattern.findall(piece):
            ids += get(p) or miss(p)
            pos += len(p)
            if pos < len(piece) and (pos <= self.overlap or pos >= self.chunk):
                ends.append(pos)
                before.append(len(ids))
        return np.array(ids, "<u4"), np.array(ends, "<i8"), np.array(before, "<i8")

    def stitched(self, chunks) -> np.ndarray | None:
        """The ids of a text from encode_chunk() of its chunks in order; None where two have no common boundary."""
        out, left, start = [], None, 0
        for right in chunks:
            if left is not None:
                both, i, j = np.intersect1d(left[1], right[1] + self.chunk, return_indices=True)
                common = np.nonzero(both >= self.chunk)[0]
                if not len(common):
                    return None
                at = common[0]
                out.append(left[0][start : left[2][i[at]]])
                start = right[2][j[at]]
            left = right
        return np.concatenate([*out, left[0][start:]]) if left is not None else np.zeros(0, "<u4")

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        ids = self.known.get(piece)
        if ids is None:
            ids = tuple(self.bpe._encode_single_piece(piece.encode()))
            if len(self.known) >= self.cache:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, its chunks one after another."""
        if len(text) > self.chunk + self.overlap:
            ids = self.stitched(self.encode_chunk(c) for _, c in self.chunks(text))
            if ids is not None:
                return ids
        return self.encode_chunk(text)[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, id_: str = "doc_id", text: str = "text", ids: bool = True, digests: bool = False, chunk: int = 1 << 15, overlap: int = 256, spread: int = 1 << 18) -> DataFrame:
    """doc_id, n_tokens and, as asked for, ids (array of ints) or ids_sha256 and decoded_sha256."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    schema = "doc_id long, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def result(codec: Codec, key: pa.Array, coded: list[np.ndarray]) -> pa.RecordBatch:
        cols = [key, pa.array([len(x) for x in coded], pa.int64())]
        if ids:
            cols.append(pa.array([x.astype(np.int32) for x in coded], pa.list_(pa.int32())))
        if digests:
            cols += [pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in coded], pa.string()), pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in coded], pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", *["ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests])

    def whole(batches):
        codec = Codec(shared.value, pattern, chunk, overlap)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield result(codec, part.column("doc_id"), [codec.encode((t or b"").decode()) for _, t in text_slices(part, "__t")])

    def cut(batches):
        codec = Codec(shared.value, pattern, chunk, overlap)
        for b in batches:
            for (_, t), key in zip(text_slices(b, "__t"), b.column("__k").to_pylist(), strict=True):
                for n, piece in codec.chunks(t.decode()):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([n], pa.int64()), pa.array([piece], pa.string())], ["__k", "n", "piece"])

    def encode(batches):
        codec = Codec(shared.value, pattern, chunk, overlap)
        for b in batches:
            coded = [codec.encode_chunk(p) for p in b.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__k"), b.column("n"), *(pa.array([x[i].tobytes() for x in coded], pa.binary()) for i in range(3))], ["__k", "n", "c", "ends", "before"])

    def stitch(batches):
        """Chunks of a document stand one after another, in order."""
        codec = Codec(shared.value, pattern, chunk, overlap)
        now, held = None, []

        def done():
            if now is not None:
                got = codec.stitched(held)
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([None if got is None else got.tobytes()], pa.binary())], ["__d", "c"])

        for b in batches:
            for key, *x in zip(*(b.column(c).to_pylist() for c in ("__k", "c", "ends", "before")), strict=True):
                if key != now:
                    yield from done()
                    now, held = key, []
                held.append(tuple(np.frombuffer(v, kind) for v, kind in zip(x, ("<u4", "<i8", "<i8"), strict=True)))
        yield from done()

    def named(batches):
        codec = Codec(shared.value, pattern, chunk, overlap)
        for b in batches:
            for i in range(b.num_rows):
                part = b.slice(i, 1)
                c = part.column("c")[0].as_py()
                got = codec.encode_chunk(part.column("__t")[0].as_py())[0] if c is None else np.frombuffer(c, "<u4")
                yield result(codec, part.column("doc_id"), [got])

    src = docs.select(F.col(f"`{id_}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("__t"))
    is_long = F.coalesce(F.length("__t") > max(spread, chunk + overlap), F.lit(False))
    long_ = stash(src.where(is_long).withColumn("__k", F.monotonically_increasing_id()), "long")
    short = src.where(~is_long).mapInArrow(whole, schema)
    if long_.isEmpty():
        return short
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = long_.select("__k", "__t").mapInArrow(cut, "__k long, n long, piece string").repartition(parts, "__k", "n").mapInArrow(encode, "__k long, n long, c binary, ends binary, before binary")
    stitched = stash(coded.repartition(parts, "__k").sortWithinPartitions("__k", "n").mapInArrow(stitch, "__d long, c binary"), "stitched")
    again = long_.join(stitched, F.col("__k") == F.col("__d")).select("doc_id", F.when(F.col("c").isNull(), F.col("__t")).alias("__t"), "c")
    return short.unionByName(again.mapInArrow(named, schema))


def decode_documents(coded: DataFrame, ranks: bytes, pattern: str, ids: str = "ids") -> DataFrame:
    """coded with a column `decoded` (binary; one of that name gives way) from its ids. It is null where the ids are null,
    or hold a null or a number that the ranks don't have; empty ids are empty bytes."""
    shared = coded.sparkSession.sparkContext.broadcast(ranks)
    src = coded.select(*(F.col(f"`{c}`") for c in coded.columns if c != "decoded"))
    schema = StructType([*src.schema.fields, StructField("decoded", BinaryType(), True)])

    def run(batches):
        codec = Codec(shared.value, pattern)
        for b in batches:
            rows = [None if x is None or any(i not in codec.bytes for i in x) else b"".join(map(codec.bytes.__getitem__, x)) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.binary())], [*b.schema.names, "decoded"])

    return src.mapInArrow(run, schema)
