"""Removal of long repeated passages, exact, behind a count-min prefilter.

A window is WINDOW consecutive words. Each window selects an anchor: the leftmost GRAM-gram of
least hash inside it. Equal windows select equal anchors, so an anchor is counted at least as
often as each of its windows; there are about six times fewer anchors than windows.

Pass 1 sketches anchors: every partition counts its own into a count-min sketch (two rows of
cells, counts saturating at 2), partial sketches are merged block by block, and one bit a cell
("two or more") goes to the executors. Pass 2 groups exactly, by 128-bit window hashes, only the
windows whose anchor both rows estimate at two or more; an estimate is never too low, so no
repeated window is lost. Each task first reduces equal windows to the earliest one, so however hot a
passage is, one row for each flush of a task is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bit_at, buckets_for, cell_blocks, merge_blocks, merged_bits, mix, ngram_hashes

WINDOW, GRAM = 20, 10
#: Cells of a sketch row: four for each expected anchor, as a power of two within these bounds.
LEAST_BITS, MOST_BITS = 16, 29
BLOCKS = 64
#: Words hashed at once, anchors and windows that a task gathers before it flushes.
CHUNK_WORDS, FLUSH_ANCHORS, FLUSH_WINDOWS = 200_000, 4_000_000, 1_000_000
LAST = np.iinfo(np.int64).max


def chunks(batches, limit: int = CHUNK_WORDS):
    """Runs of rows (doc_id, text hash, words) of about limit words; a null doc_id comes last in order."""
    rows, total = [], 0
    for b in batches:
        for doc, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = (text or b"").split()
            if len(words) >= WINDOW:
                rows.append((LAST if doc is None else doc, key, words))
                total += len(words)
            if total >= limit:
                yield rows
                rows, total = [], 0
    if rows:
        yield rows


def hashed(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(128-bit word hashes, words of each row, first word of each row) of a chunk."""
    digest = xxhash.xxh3_128_digest
    h = np.frombuffer(b"".join([digest(w) for _, _, words in rows for w in words]), np.uint64).reshape(-1, 2)
    sizes = np.array([len(words) for _, _, words in rows], np.int64)
    return h, sizes, np.cumsum(sizes) - sizes


def anchors(h: np.ndarray, sizes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the chunk's windows, each one's anchor hash, where a new anchor is selected)."""
    grams = ngram_hashes(h[:, 0], GRAM, 3)
    spread = WINDOW - GRAM + 1
    starts = np.concatenate([np.arange(f, f + n - WINDOW + 1) for f, n in zip(firsts, sizes, strict=True)])
    least = np.lib.stride_tricks.sliding_window_view(grams, spread).argmin(axis=1)[starts] + starts
    return starts, grams[least], np.concatenate([[True], least[1:] != least[:-1]])


def cells(anchor: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each anchor in both rows."""
    return (anchor & U64((1 << bits) - 1)).astype(np.int64), (mix(anchor) >> U64(64 - bits)).astype(np.int64)


def sketch_rows(batches, bits: int):
    """Partial sketches: (block, packed cells) for the blocks touched."""

    def flush(found: list[np.ndarray]):
        for row, cell in enumerate(cells(np.concatenate(found), bits)):
            blocks = cell_blocks(cell, bits, BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array([row * BLOCKS + k for k, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], ["block", "data"])

    found, total = [], 0
    for rows in chunks(batches):
        _, anchor, new = anchors(*hashed(rows))
        found.append(anchor[new])
        total += len(found[-1])
        if total >= FLUSH_ANCHORS:
            yield from flush(found)
            found, total = [], 0
    if found:
        yield from flush(found)


def build_sketch(texts: DataFrame, bits: int) -> list[np.ndarray]:
    """Both rows' bits "two or more", packed; 2 * 2**bits / 8 bytes whatever the input."""
    width = (1 << bits) // BLOCKS
    merged = merge_blocks(texts.mapInArrow(lambda batches: sketch_rows(batches, bits), "block int, data binary"), merged_bits(width))
    empty = bytes(width // 8)
    join = [b"".join(zlib.decompress(merged[r * BLOCKS + k]) if r * BLOCKS + k in merged else empty for k in range(BLOCKS)) for r in range(2)]
    return [np.frombuffer(x, np.uint8) for x in join]


def often(anchor: np.ndarray, sketch: list[np.ndarray], bits: int) -> np.ndarray:
    """Where the count-min estimate, the lesser of both rows, is two or more."""
    out = np.ones(len(anchor), bool)
    for row, cell in zip(sketch, cells(anchor, bits), strict=True):
        out &= bit_at(row, cell)
    return out


def covered(starts: np.ndarray) -> np.ndarray:
    """Sorted window starts of one document as merged word ranges (begin, end), flat int32."""
    cut = np.flatnonzero(np.diff(starts) > WINDOW) + 1
    return np.stack([starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + WINDOW], 1).astype(np.int32).ravel()


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of equal rows in sorted columns."""
    if not len(keys[0]):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    cut = np.flatnonzero(np.concatenate([[True], new]))
    return cut, np.append(cut[1:], len(keys[0]))


def split_repeats(h1, h2, doc, key, start):
    """Sort windows; returns (order, later): later marks those that start after an equal one."""
    order = np.lexsort((key, start, doc, h2, h1))
    h1, h2, doc, start, key = h1[order], h2[order], doc[order], start[order], key[order]
    new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = (doc != doc[head]) | (start != start[head])
    return order, later


def ranges_by_document(doc, key, start) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    order = np.lexsort((start, key, doc))
    doc, key, start = doc[order], key[order], start[order]
    cut, ends = runs(doc, key)
    return doc[cut], key[cut], [covered(start[a:b]).tobytes() for a, b in zip(cut, ends, strict=True)]


FIELDS = "bucket int, known boolean, doc binary, key binary, start binary, h1 binary, h2 binary"


def suspect_rows(batches, sketch, bits: int, buckets: int):
    """Suspected windows for the exact grouping, packed for each bucket.

    known=false: the earliest of each set of equal windows that the task has met, dealt by anchor, those
    of a document side by side, so that they compress; known=true: word ranges of windows that it knows
    to be repeats, dealt by document: start holds the ranges, h1 their lengths in bytes.
    """

    def pack(at: np.ndarray, known: bool, columns: list[np.ndarray], ranges: list[bytes] | None = None):
        order = np.lexsort((columns[2], columns[0], at)) if ranges is None else np.argsort(at, kind="stable")
        at = at[order]
        cut, ends = runs(at)
        parts = [order[a:b] for a, b in zip(cut, ends, strict=True)]
        data = [[c[k].tobytes() for k in parts] for c in columns]
        if ranges is not None:
            data.append([b"".join(ranges[i] for i in k) for k in parts])
            data.append([np.array([len(ranges[i]) for i in k], np.int64).tobytes() for k in parts])
        data += [[b""] * len(cut)] * (5 - len(data))
        return pa.RecordBatch.from_arrays([pa.array(at[cut].astype(np.int32)), pa.array([known] * len(cut)), *[pa.array(x, pa.binary()) for x in data]], [f.split()[0] for f in FIELDS.split(", ")])

    def flush(held):
        h1, h2, anchor, doc, key, start = (np.concatenate(x) for x in zip(*held, strict=True))
        order, later = split_repeats(h1, h2, doc, key, start)
        first, known = order[~later], order[later]
        yield pack((anchor[first] % U64(buckets)).astype(np.int64), False, [x[first] for x in (doc, key, start, h1, h2)])
        docs, keys, ranges = ranges_by_document(*(x[known] for x in (doc, key, start)))
        yield pack((mix(docs.astype(np.uint64)) % U64(buckets)).astype(np.int64), True, [docs, keys], ranges)

    held, total = [], 0
    for rows in chunks(batches):
        h, sizes, firsts = hashed(rows)
        starts, anchor, _ = anchors(h, sizes, firsts)
        some = np.flatnonzero(often(anchor, sketch, bits))
        if not len(some):
            continue
        owner = np.repeat(np.arange(len(rows)), sizes - WINDOW + 1)[some]
        at = starts[some]
        docs, keys = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        h1, h2 = ngram_hashes(h[:, 0], WINDOW, 1)[at], ngram_hashes(h[:, 1], WINDOW, 2)[at]
        held.append((h1, h2, anchor[some], docs[owner], keys[owner], (at - firsts[owner]).astype(np.int32)))
        total += len(some)
        if total >= FLUSH_WINDOWS:
            yield from flush(held)
            held, total = [], 0
    if held:
        yield from flush(held)


def exact_groups(table):
    """One bucket: word ranges of each document that windows starting earlier elsewhere repeat."""
    kinds = {"doc": np.int64, "key": np.int64, "start": np.int32, "h1": np.uint64, "h2": np.uint64}
    first, docs, keys, data = [], [], [], []
    for r in table.to_pylist():
        if not r["known"]:
            first.append([np.frombuffer(r[k], t) for k, t in kinds.items()])
            continue
        docs.append(np.frombuffer(r["doc"], np.int64))
        keys.append(np.frombuffer(r["key"], np.int64))
        ends = np.cumsum(np.frombuffer(r["h1"], np.int64)).tolist()
        data += [r["start"][a:b] for a, b in zip([0, *ends], ends, strict=False)]
    if first:
        doc, key, start, h1, h2 = (np.concatenate(x) for x in zip(*first, strict=True))
        order, later = split_repeats(h1, h2, doc, key, start)
        own = ranges_by_document(*(x[order[later]] for x in (doc, key, start)))
        docs.append(own[0])
        keys.append(own[1])
        data += own[2]
    return pa.table({"doc": pa.array(np.concatenate(docs), pa.int64()), "key": pa.array(np.concatenate(keys), pa.int64()), "ranges": pa.array(data, pa.binary())})


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, and the kept text if asked for.

    A word is removed if a window of WINDOW words covers it whose words also start earlier: in a
    document of smaller doc_id, or earlier in the same one. Windows are judged on the input. A null
    doc_id counts as larger than all others; rows that share a doc_id stand at the same place, so
    none of them is earlier than another. A null text has no words; documents of under WINDOW
    words keep all of them. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("t"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    bits = min(MOST_BITS, max(LEAST_BITS, int(size // 9).bit_length()))
    sketch = spark.sparkContext.broadcast(build_sketch(base, bits))
    buckets = buckets_for(size // 6, 400_000, 64)
    suspects = base.mapInArrow(lambda batches: suspect_rows(batches, sketch.value, bits, buckets), FIELDS)
    found = suspects.groupBy("bucket").applyInArrow(exact_groups, "doc long, key long, ranges binary")
    found = found.groupBy("doc", "key").agg(F.collect_list("ranges").alias("ranges")).withColumnRenamed("key", "k")
    joined = base.join(found.hint("shuffle_hash"), (F.coalesce("doc_id", F.lit(int(LAST))) == F.col("doc")) & (F.col("key") == F.col("k")), "left")

    def apply(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                gone = np.zeros(len(words), bool)
                for x in ranges or ():
                    for a, z in np.frombuffer(x, np.int32).reshape(-1, 2):
                        gone[a:z] = True
                removed = int(gone.sum())
                kept = b" ".join(words if not removed else [words[i] for i in np.flatnonzero(~gone)])
                for o, v in zip(out, (len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None), strict=True):
                    o.append(v)
            arrays = [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(out[3], pa.string())] * with_text, names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    return joined.select("doc_id", "t", "ranges").mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
