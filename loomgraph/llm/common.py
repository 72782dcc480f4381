"""Pieces that several operators share: inputs, durable stashes, word hashing, counting sketches."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]"
U64 = np.uint64
MASK = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- durable intermediate tables ------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset a temporary one, on a local master only.

    On several machines a temporary folder would be another one on each, and rows would be lost.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if context.getCheckpointDir() is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
    return context.getCheckpointDir()


class Stash:
    """A DataFrame written to the shared folder and read back: its lineage ends there."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Remove the files; only once nothing unread depends on them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def buckets_for(rows: int, per_bucket: int, least: int = 1, most: int = 1 << 20) -> int:
    """How many hash buckets keep about per_bucket rows each."""
    return int(min(most, max(least, -(-rows // per_bucket))))


# --- native word counting ---------------------------------------------------------------------


def word_count(text: str | Column) -> Column:
    """Number of words of a text, without Python; null counts 0."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    bare = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, f"{SPACE}+"))).cast("long")


# --- vectorised hashing on executors ----------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64 (Steele, Lea, Flood 2014; constants fixed there): spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    if seed:
        return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))
    return np.fromiter(map(digest, words), np.uint64, len(words))


def multipliers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def ngram_hashes(hashes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive words (empty if there are fewer words)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j, k in enumerate(multipliers(n, seed)):
        out += hashes[j : j + m] * k
    return mix(out)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def ints_of(batch: pa.RecordBatch, name: str = "doc_id") -> list[int | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def small(batches, limit: int = 4_000_000):
    """The batches cut into ones of about limit bytes, so that what a task makes of a batch stays small."""
    for b in batches:
        step = max(1, int(b.num_rows * limit / max(1, b.nbytes)))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


# --- merged partition sketches ------------------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Ascending uint32 values as their differences, byte plane by byte plane, compressed: about a byte for each of a dense list."""
    steps = np.diff(values.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def plain(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint32)


def cell_blocks(cells: np.ndarray, bits: int, blocks: int) -> Iterable[tuple[int, bytes]]:
    """(block, packed offset * 2 + (two or more)) of the cells met, of 2**bits cells in equal blocks."""
    width = (1 << bits) // blocks
    cells, counts = np.unique(cells, return_counts=True)
    code = ((cells % width) * 2 + (counts > 1)).astype(np.uint32)
    cuts = np.searchsorted(cells, np.arange(blocks + 1) * width)
    return [(k, packed(code[cuts[k] : cuts[k + 1]])) for k in range(blocks) if cuts[k + 1] > cuts[k]]


def merged_bits(width: int) -> Callable[[Iterable[np.ndarray]], np.ndarray]:
    """Merges what cell_blocks made of a block of width cells: one bit a cell, two or more."""

    def merge(parts) -> np.ndarray:
        count = np.zeros(width, np.uint8)
        for code in parts:
            at = code >> 1
            count[at] = np.minimum(count[at] + 1 + (code & 1), 2)
        return np.packbits(count > 1)

    return merge


def bit_at(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def merge_blocks(parts: DataFrame, merge: Callable[[Iterable[np.ndarray]], np.ndarray], decode: Callable[[bytes], np.ndarray] = unpacked) -> dict[int, bytes]:
    """Merge compressed blocks (block int, data binary) of partition sketches.

    The blocks of a sketch are merged in parallel, one task for each; what reaches the driver is
    one merged sketch, whose size its caller fixes beforehand whatever the input.
    """

    def run(key, table):
        decoded = (decode(x.as_py()) for x in table.column("data"))
        merged = zlib.compress(merge(decoded).tobytes(), 1)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([merged], pa.binary())})

    rows = parts.groupBy("block").applyInArrow(run, "block int, data binary").collect()
    return {r["block"]: bytes(r["data"]) for r in rows}
