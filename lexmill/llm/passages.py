"""Substring dedup with a count-min prefilter.

A window is `width` consecutive words of one document. Each word that lies in a window whose words also start in a document
of smaller doc_id goes; windows are judged on the input.

1. Copies: documents whose whole text equals that of a smaller doc_id need no windows: all that their windows cover goes.
   This is a saving alone; above `broadcast_rows` such documents it is left out, and step 3 finds the same.
2. Sketch: every task counts, in a count-min row of 2**bits cells, the anchors of its documents' windows: of the
   `gram`-word sequences within a window, the one with the least hash. Equal windows have equal anchors, neighbouring
   windows share one, so a quarter as many counts suffice. A sketch is kept sparse (the cells that count anything), so it
   grows with the input and its row can be wide enough (2**40 cells) not to fill up. Partition sketches travel by blocks of
   cells and are summed block by block; what is left are the cells that count two or more. Counts are never too small, so no
   repeated window is lost; a window that passes for another's sake goes on to step 3, which is exact by itself. (The sketch
   has a depth of one: a row this wide errs less than several narrow ones of the same size together, and each row more
   would shuffle every count again.)
   If so few cells count two or more that a bitmap of them, 32 bits a cell, has at most 2**most_bits bits (128 MB), that
   bitmap is broadcast. Beyond that nothing of this passes the driver: for each 4 MB of text a task answers what these texts
   have in common by itself and sends each block its cells, each with one document; the block answers the documents whose
   cells others have sent as well, and a join brings the answers to the texts. A cell of a third of all documents is so one
   entry for each 4 MB. Either way texts are read twice, whatever their number.
3. Windows with an estimate of two or more are grouped by a 96-bit hash. A task first judges them among themselves: of its
   rows of a window only that of the smallest doc_id goes on, the others are found, so that a window of a third of all
   documents is one row for each task. The rest is shuffled once, sorted by window and doc_id, and streams past.
4. The places found, packed by document, meet the texts in one join.

Null texts have no words. Rows that repeat a doc_id count as one document for "smaller", each row being judged by its own
words. With a null doc_id nothing is removed, and nothing is removed for its sake. Texts under `width` words have no window.
Empty tables give empty tables; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stash, text_slices

#: Odd multipliers, powers of which weigh the words of a window.
WEIGHTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads each bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, n: int, weight: int) -> np.ndarray:
    """Hashes of each n consecutive word hashes."""
    m = max(0, len(h) - n + 1)
    out, w = np.zeros(m, np.uint64), 1
    for j in range(n):
        w = w * weight % 2**64
        out += h[j : j + m] * np.uint64(w)
    return mixed(out)


class Words:
    """The words of some documents in one array."""

    def __init__(self, texts: list[bytes], width: int, gram: int):
        split = [t.split() for t in texts]
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        total = int(self.sizes.sum())
        self.h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split)), np.uint64, total)
        self.doc = np.repeat(np.arange(len(split)), self.sizes)
        self.place = np.arange(total) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        n = max(0, total - width + 1)
        self.starts = np.nonzero(self.doc[:n] == self.doc[width - 1 :])[0] if n else np.zeros(0, np.int64)
        grams = rolled(self.h, gram, WEIGHTS[2])
        least = grams[:n].copy()
        for j in range(1, width - gram + 1):
            np.minimum(least, grams[j : j + n], out=least)
        self.anchors = least[self.starts]

    def distinct_anchors(self) -> np.ndarray:
        """Each document's anchors, (nearly) once for each document."""
        d, a = self.doc[self.starts], self.anchors
        if not len(a):
            return a
        turn = np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
        d, a = d[turn], a[turn]
        _, first = np.unique(a + mixed(d.astype(np.uint64) + np.uint64(1)), return_index=True)
        return a[first]


def cells(anchors: np.ndarray, bits: int) -> np.ndarray:
    return mixed(anchors + np.uint64(WEIGHTS[0])) >> np.uint64(64 - bits)


def groups_of_texts(batch, text: str, most: int = 1 << 22):
    """(first row, texts) for runs of rows of about `most` bytes, so that no batch is held in words at once."""
    start, out, size = 0, [], 0
    for i, t in text_slices(batch, text):
        out.append(t or b"")
        size += len(out[-1])
        if size >= most:
            yield start, out
            start, out, size = i + 1, [], 0
    if out:
        yield start, out


def overlapping(docs: DataFrame, width: int, gram: int, bits: int) -> DataFrame:
    """block, low, n: the sketch's cells that count two or more documents, written; docs: __t and __copy. A cell is
    block << low_bits | low, low being one of the n unsigned integers of 4 bytes."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    low_bits = min(32, max(0, bits - max(12, (parts * 8 - 1).bit_length())))

    def count(batches):
        held: list[np.ndarray] = []

        def emit():
            if not held:
                return
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            if not len(cell):  # no text of this task has a window
                return
            block = (cell >> np.uint64(low_bits)).astype(np.int64)
            cuts = np.concatenate([[0], np.nonzero(np.diff(block))[0] + 1, [len(cell)]])
            low, many = (cell & np.uint64((1 << low_bits) - 1)).astype("<u4"), n > 1
            for i in range(0, len(cuts) - 1, 4096):
                spans = list(zip(cuts[i : i + 4096], cuts[i + 1 : i + 4097], strict=False))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(block[a]) for a, _ in spans], pa.int64()),
                        pa.array([low[a:b][~many[a:b]].tobytes() for a, b in spans], pa.binary()),
                        pa.array([low[a:b][many[a:b]].tobytes() for a, b in spans], pa.binary()),
                    ],
                    ["block", "once", "more"],
                )

        for b in batches:
            for _, texts in groups_of_texts(b.filter(pc.invert(b.column("__copy"))), "__t"):
                held.append(cells(Words(texts, width, gram).distinct_anchors(), bits))
            if sum(map(len, held)) > 1 << 22:
                yield from emit()
        yield from emit()

    def merge(batches):
        """A partition holds whole blocks one after another."""
        now, once, more = None, [], []

        def done():
            if now is not None:
                one, n = np.unique(np.concatenate(once), return_counts=True)
                low = np.union1d(one[n > 1], np.concatenate(more))
                if len(low):
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([low.astype("<u4").tobytes()], pa.binary()), pa.array([len(low)], pa.int64())], ["block", "low", "n"])

        for b in batches:
            for block, x, y in zip(b.column("block").to_pylist(), b.column("once").to_pylist(), b.column("more").to_pylist(), strict=True):
                if block != now:
                    yield from done()
                    now, once, more = block, [], []
                once.append(np.frombuffer(x, "<u4"))
                more.append(np.frombuffer(y, "<u4"))
        yield from done()

    counted = docs.mapInArrow(count, "block long, once binary, more binary").repartition(parts, "block").sortWithinPartitions("block")
    return stash(counted.mapInArrow(merge, "block long, low binary, n long").withColumn("low_bits", F.lit(low_bits)), "cells")


class Bitmap:
    """Cells as a bitmap of 2**bits bits."""

    def __init__(self, bits: int):
        self.bits, self.map = bits, np.zeros(1 << (bits - 3), np.uint8)

    def place(self, cell: np.ndarray) -> np.ndarray:
        return mixed(cell + np.uint64(WEIGHTS[2])) >> np.uint64(64 - self.bits)

    def add(self, cell: np.ndarray) -> None:
        at = self.place(cell)
        np.bitwise_or.at(self.map, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def holds(self, cell: np.ndarray) -> np.ndarray:
        at = self.place(cell)
        return (self.map[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap_of(found: DataFrame, most_bits: int) -> Bitmap | None:
    """The bitmap of the cells that `overlapping` found; None if it would have over 2**most_bits bits."""
    n = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if 32 * n > 1 << most_bits:
        return None
    out = Bitmap(max(12, (32 * n - 1).bit_length() if n else 0))
    for r in found.toLocalIterator():
        out.add(np.frombuffer(r["low"], "<u4").astype(np.uint64) | np.uint64(r["block"]) << np.uint64(r["low_bits"]))
    return out


def answered(docs: DataFrame, width: int, gram: int, bits: int) -> DataFrame:
    """docs with __cells, the cells of each document that count two or more documents (8 bytes each; null if it has none)."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)

    def count(batches):
        for b in batches:
            b = b.filter(pc.and_(pc.invert(b.column("__copy")), pc.is_valid(b.column("doc_id"))))
            ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for start, texts in groups_of_texts(b, "__t"):
                w = Words(texts, width, gram)
                if not len(w.anchors):
                    continue
                cell, doc = cells(w.anchors, bits), ids[start + w.doc[w.starts]]
                order = np.lexsort((doc, cell))
                cell, doc = cell[order], doc[order]
                new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (doc[1:] != doc[:-1])])
                cell, doc = cell[new], doc[new]
                first = np.concatenate([[True], cell[1:] != cell[:-1]])
                many = np.diff(np.append(np.nonzero(first)[0], len(cell)))[np.cumsum(first) - 1] > 1
                block = (mixed(cell) % np.uint64(parts * 4)).astype(np.int64)
                # what these texts have in common is answered here, and one document of them speaks for all
                block = np.concatenate([block[first], -1 - block[many]])
                cell, doc = np.concatenate([cell[first], cell[many]]), np.concatenate([doc[first], doc[many]])
                order = np.argsort(block, kind="stable")
                block, cell, doc = block[order], cell[order], doc[order]
                cuts = np.concatenate([[0], np.nonzero(np.diff(block))[0] + 1, [len(block)]]).tolist()
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([int(block[x]) for x, _ in spans], pa.int64()), *(pa.array([v[x:y].astype("<i8").tobytes() for x, y in spans], pa.binary()) for v in (cell.view(np.int64), doc))], ["block", "cell", "doc"])

    def answer(batches):
        """A partition holds whole blocks one after another. Those of negative numbers are answers already."""
        now, held = None, []

        def told(doc, cell):
            ids, own = packed(doc, cell)
            for i in range(0, len(ids), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + (1 << 14)]), pa.array(own[i : i + (1 << 14)], pa.binary())], ["__a", "own"])

        def done():
            if now is not None:
                cell, doc = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((doc, cell))
                cell, doc = cell[order], doc[order]
                first = np.concatenate([[True], cell[1:] != cell[:-1]])
                lows = np.nonzero(first)[0]
                highs = np.append(lows[1:], len(cell)) - 1
                many = (doc[lows] != doc[highs])[np.cumsum(first) - 1]
                yield from told(doc[many], cell[many])

        for b in batches:
            for block, x, y in zip(b.column("block").to_pylist(), b.column("cell").to_pylist(), b.column("doc").to_pylist(), strict=True):
                cell, doc = np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")
                if block < 0:
                    yield from told(doc, cell)
                    continue
                if block != now:
                    yield from done()
                    now, held = block, []
                held.append((cell, doc))
        yield from done()

    sent = docs.mapInArrow(count, "block long, cell binary, doc binary").repartition(parts, "block").sortWithinPartitions("block").mapInArrow(answer, "__a long, own binary")
    answers = sent.groupBy("__a").agg(F.array_join(F.transform(F.collect_list("own"), F.hex), "").alias("own")).select("__a", F.unhex("own").alias("__cells"))
    return docs.join(answers, F.col("doc_id") == F.col("__a"), "left").drop("__a")


def text_tag(text: bytes) -> int:
    """31 bits that tell rows of one doc_id apart."""
    return xxhash.xxh32_intdigest(text) >> 1


def packed(doc: np.ndarray, at: np.ndarray):
    """doc_id, at: the distinct places of each document as the bytes of one array."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    if len(doc):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])])
        doc, at = doc[new], at[new]
    cuts = [0, *(np.nonzero(np.diff(doc))[0] + 1).tolist(), len(doc)] if len(doc) else [0]
    return doc[cuts[:-1]], [at[a:b].astype("<i8").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


FOUND = "k1 long, k2 int, doc_id long, at long, more binary"  # a place and further ones; or, with at null, places found


def repeated_windows(docs: DataFrame, found: DataFrame, width: int, gram: int, bits: int, most_bits: int) -> DataFrame:
    """doc_id, at (binary): the places (text tag and place, 8 bytes each) of windows that a smaller doc_id has as well."""
    spark = docs.sparkSession

    def of_all(src, holds):
        """holds: which of some windows' cells count two or more, by the cells, their rows and the batch."""

        def candidates(batches):
            held: list[tuple[np.ndarray, ...]] = []

            def emit():
                if not held:
                    return
                k1, k2, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                order = np.lexsort((at, doc, k1))
                k1, k2, doc, at = k1[order], k2[order], doc[order], at[order]
                if not len(k1):
                    return
                new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
                first = np.nonzero(new)[0]
                sure = doc > doc[first][np.cumsum(new) - 1]  # the task itself has the window in a smaller doc_id
                ids, places = packed(doc[sure], at[sure])
                ends = np.append(first[1:], len(k1))
                own = np.add.reduceat(~sure, first)  # places of the smallest doc_id stand first
                more = [at[i + 1 : i + n].astype("<i8").tobytes() if n > 1 else None for i, n in zip(first.tolist(), own.tolist(), strict=True)] if (ends - first > 1).any() else [None] * len(first)
                rows = [
                    pa.RecordBatch.from_arrays([pa.array(k1[first].view(np.int64)), pa.array(k2[first].view(np.int32)), pa.array(doc[first]), pa.array(at[first]), pa.array(more, pa.binary())], ["k1", "k2", "doc_id", "at", "more"]),
                    pa.RecordBatch.from_arrays([pa.array(mixed(ids.view(np.uint64)).view(np.int64)), pa.array(np.zeros(len(ids), np.int32)), pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(places, pa.binary())], ["k1", "k2", "doc_id", "at", "more"]),
                ]
                for r in rows:
                    yield from (r.slice(i, 1 << 15) for i in range(0, r.num_rows, 1 << 15))

            for b in batches:
                b = b.filter(pc.and_(pc.invert(b.column("__copy")), pc.is_valid(b.column("doc_id"))))
                ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                for start, texts in groups_of_texts(b, "__t"):
                    w = Words(texts, width, gram)
                    hit = w.starts[holds(cells(w.anchors, bits), start + w.doc[w.starts], b)]
                    k1, k2 = rolled(w.h, width, WEIGHTS[0])[hit], (rolled(w.h, width, WEIGHTS[1])[hit] >> np.uint64(32)).astype(np.uint32)
                    tags = np.fromiter(map(text_tag, texts), np.int64, len(texts))
                    held.append((k1, k2, ids[start + w.doc[hit]], tags[w.doc[hit]] << 32 | w.place[hit]))
                    if sum(len(x[0]) for x in held) > 1 << 20:
                        yield from emit()
            yield from emit()

        return src.mapInArrow(candidates, FOUND)

    def judge(batches):
        """Rows of a window stand one after another, the smallest doc_id first."""
        key, low = None, 0
        for b in batches:
            sure = pc.is_null(b.column("at"))
            yield from (pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("more")], ["doc_id", "at"]) for x in [b.filter(sure)] if x.num_rows)
            b = b.filter(pc.invert(sure))
            if not b.num_rows:
                continue
            k1, k2, doc = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "doc_id"))
            new = np.concatenate([[(k1[0], k2[0]) != key], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            lows = np.concatenate([[low], doc[new]])[np.cumsum(new)]
            key, low = (k1[-1], k2[-1]), lows[-1]
            b = b.filter(pa.array(doc > lows))
            one = np.ascontiguousarray(b.column("at").to_numpy(zero_copy_only=False), "<i8")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.Array.from_buffers(pa.binary(8), len(one), [None, pa.py_buffer(one)]).cast(pa.binary())], ["doc_id", "at"])
            further = b.filter(pc.is_valid(b.column("more")))
            if further.num_rows:
                yield pa.RecordBatch.from_arrays([further.column("doc_id"), further.column("more")], ["doc_id", "at"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    bitmap = bitmap_of(found, most_bits)
    if bitmap is not None:
        shared = spark.sparkContext.broadcast(bitmap)
        rows = of_all(docs, lambda cell, row, batch: shared.value.holds(cell))
    else:

        def own(cell, row, batch):
            out, held = np.zeros(len(cell), bool), batch.column("__cells")
            cuts = [0, *(np.nonzero(np.diff(row))[0] + 1).tolist(), len(row)] if len(row) else [0]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if held[int(row[x])].is_valid:
                    out[x:y] = np.isin(cell[x:y], np.frombuffer(held[int(row[x])].as_buffer(), "<u8"))
            return out

        rows = of_all(answered(docs, width, gram, bits), own)
    return rows.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "doc_id").mapInArrow(judge, "doc_id long, at binary")


def mark_copies(docs: DataFrame, broadcast_rows: int) -> DataFrame:
    """docs (doc_id, __t) with __copy: a smaller doc_id has the same text."""
    key = F.struct(F.xxhash64("__t").alias("a"), F.xxhash64(F.lit(7), "__t").alias("b"))
    low = docs.select("doc_id", key.alias("__k")).groupBy("__k").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("__k", "low")
    low = stash(low, "copies")
    if not small(low, broadcast_rows):
        return docs.withColumn("__copy", F.lit(False))
    return docs.withColumn("__k", key).join(F.broadcast(low), "__k", "left").select("doc_id", "__t", F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False)).alias("__copy"))


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of starts."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.subtract.at(d, np.minimum(starts + width, n), 1)
    return np.cumsum(d[:n]) > 0


def dedup_passages(docs: DataFrame, id_: str = "doc_id", text: str = "text", width: int = 13, gram: int = 7, bits: int = 40, most_bits: int = 30, broadcast_rows: int = 1_000_000, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (the kept words, joined by blanks)."""
    base = docs.select(F.col(f"`{id_}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("__t"))
    marked = mark_copies(base, broadcast_rows)
    found = repeated_windows(marked, overlapping(marked, width, gram, bits), width, gram, bits, most_bits)
    by_doc = found.groupBy(F.col("doc_id").alias("__d")).agg(F.collect_list("at").alias("__at"))
    joined = marked.join(by_doc, F.col("doc_id") == F.col("__d"), "left").drop("__d")

    def cut(batches):
        for b in batches:
            at, rows = b.column("__at"), []
            for (i, t), copy in zip(text_slices(b, "__t"), b.column("__copy").to_pylist(), strict=True):
                words = (t or b"").split()
                gone = np.zeros(len(words), bool)
                if copy and len(words) >= width:
                    gone[:] = True
                elif at[i].is_valid:
                    places = np.concatenate([np.frombuffer(m, "<i8") for m in at[i].as_py()])
                    own = places[places >> 32 == text_tag(t or b"")]
                    gone = covered(len(words), own & 0xFFFFFFFF, width)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)
                rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), *[pa.array(cols[3], pa.string())] * texts], ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * texts]
            )

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
