"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts are normalised to their words, A-Z lower-cased and joined by single spaces, in one pass of
byte translation; an automaton of every item's windows then scans each normalised text once. Match
ends are mapped to word numbers, and those, where spans are asked for, to offsets in the original.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, small

WINDOW = 13
#: Bytes of distinct windows in one automaton, which bounds what is collected and broadcast at once; a
#: larger benchmark is scanned in several passes, each with an automaton over its share of the windows.
AUTOMATON_BYTES = 8_000_000
#: Everything below U+0080 that is no digit or letter divides words; bytes of other characters are part of words.
TABLE = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normal_words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, in UTF-8."""
    return (text or b"").lower().translate(TABLE).split()


def item_windows(words: list[bytes], n: int = WINDOW) -> set[bytes]:
    """An item's windows; an item of fewer than n words, but not none, is one window."""
    if not words:
        return set()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def window_table(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item_id string, win binary) of every distinct window of every item; an item may have no id."""

    def run(batches):
        for b in batches:
            rows = [(i, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in sorted(item_windows(normal_words(t), n))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["item_id", "win"])

    some = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("t"))
    return some.mapInArrow(run, "item_id string, win binary").distinct()


def automaton(windows: list[tuple[bytes, tuple[str | None, ...]]]) -> ahocorasick.Automaton:
    """Windows between spaces, one character for each byte, valued (number of words, item ids)."""
    a = ahocorasick.Automaton()
    for w, items in windows:
        a.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, len(w) + 1, items))
    a.make_automaton()
    return a


def scan(words: list[bytes], a: ahocorasick.Automaton, hit: np.ndarray, items: set[str | None]) -> None:
    """Mark the words inside any window that occurs, and collect the items it belongs to."""
    if not words or not len(a):
        return
    text = b" " + b" ".join(words) + b" "
    spaces = None
    for end, (n, size, ids) in a.iter(text.decode("latin-1")):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        first = int(np.searchsorted(spaces, end - size))
        hit[first : first + n] = True
        items.update(ids)


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code-point ranges of the original text that the runs of hit words cover, end exclusive."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lower = np.where((code >= 65) & (code <= 90), code + 32, code)
    inside = np.concatenate([[False], (lower >= 128) | ((lower >= 48) & (lower <= 57)) | ((lower >= 97) & (lower <= 122)), [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    runs = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(runs[::2], runs[1::2], strict=True)]


def ranges(hit: np.ndarray) -> bytes:
    """The runs of hit words (begin, end), flat int32."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).astype(np.int32).tobytes()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, keep: tuple[str, ...] = (), spans: bool = False, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    `keep` names columns of docs to carry through, under names that begin with `__k_` (`contaminated`
    then tells which rows to drop); `spans` adds the contaminated ranges of the original text as array<array<long>>.
    A null or wordless text has no words and no hits and is clean; so is everything when the
    benchmark is empty or holds null texts only. Items that repeat an id count once,
    and so do all those with a null id, which items_sha256 leaves out. Rows of docs are judged alone, so repeated rows get equal results.
    Windows of more than automaton_bytes are dealt to passes by their hash; between passes documents and
    what was found so far are written to the shared folder, so that driver and executors hold one share at a time.
    """
    spark = docs.sparkSession
    table = window_table(benchmark, n).groupBy("win").agg(F.sort_array(F.collect_set("item_id")).alias("ids"), F.max(F.col("item_id").isNull()).alias("unnamed"))
    windows = Stash(table, "windows")
    total = windows.df.agg(F.coalesce(F.sum(F.octet_length("win") + 2), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, -(-int(total) // automaton_bytes))
    kept = [c for c in keep if c != "doc_id"]

    def run(batches, share, first: bool, last: bool):
        a = automaton(share.value)
        for b in small(batches):
            texts = b.column(1).to_pylist()
            words = [normal_words(t) for t in texts]
            hits = [np.zeros(len(w), bool) for w in words]
            items: list[set[str | None]] = [set() for _ in words]
            if not first:
                for h, i, found, ids in zip(hits, items, b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                    for x, y in np.frombuffer(found, np.int32).reshape(-1, 2):
                        h[x:y] = True
                    i.update(ids)
            for w, h, i in zip(words, hits, items, strict=True):
                scan(w, a, h, i)
            own = b.columns[2 : 2 + len(kept)]
            if not last:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *own, pa.array([ranges(h) for h in hits], pa.binary()), pa.array([list(i) for i in items], pa.list_(pa.string()))], between)
                continue
            out = {k: [] for k in kinds}
            for t, w, h, i in zip(texts, words, hits, items, strict=True):
                n_hit = int(h.sum())
                out["n_words"].append(len(w))
                out["n_hit"].append(n_hit)
                out["n_items"].append(len(i))
                out["items_sha256"].append(hashlib.sha256(",".join(sorted(x for x in i if x is not None)).encode()).hexdigest())
                out["contaminated"].append(n_hit > 0 and 20 * n_hit >= len(w))
                out["spans"].append([list(x) for x in original_spans(t.decode(), h)] if spans and n_hit else [])
            arrays = [pa.array(out[k], t) for k, t in kinds.items() if spans or k != "spans"]
            yield pa.RecordBatch.from_arrays([b.column(0), *own, *arrays], names)

    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "spans": pa.list_(pa.list_(pa.int64()))}
    added = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", spans array<array<long>>" * spans
    now = docs.select("doc_id", F.col("text").cast("binary").alias("__t"), *[F.col(f"`{c}`").alias(f"__k{k}") for k, c in enumerate(kept)])
    own = ["doc_id", *[f"__k{k}" for k in range(len(kept))]]
    names = [*own, *[x.split()[0] for x in added.split(", ")]]
    between = [own[0], "__t", *own[1:], "__hits", "__items"]
    kind = f"doc_id {now.schema[0].dataType.simpleString()}"
    others = [f"__k{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(kept)]
    held: Stash | None = None
    for k in range(passes):
        some = windows.df.where(F.pmod(F.xxhash64("win"), F.lit(passes)) == k)
        share = spark.sparkContext.broadcast([(bytes(r["win"]), (*r["ids"], *[None] * r["unnamed"])) for r in some.toLocalIterator()])
        last = k == passes - 1
        schema = ", ".join([kind, *others, added] if last else [kind, "__t binary", *others, "__hits binary, __items array<string>"])
        now = now.mapInArrow(lambda batches, share=share, first=k == 0, last=last: run(batches, share, first, last), schema)
        if not last:
            before, held = held, Stash(now, "scanned")
            now = held.df
            if before:
                before.drop()
    windows.drop()
    return now.withColumnsRenamed({f"__k{k}": f"__k_{c}" for k, c in enumerate(kept)})
