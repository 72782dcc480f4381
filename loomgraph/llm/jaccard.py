"""Exact Jaccard join of documents' word n-gram sets, by prefix trees.

Every set is put in one global order of its n-grams: those that merged partition sketches show to
stand in one document alone come first, the others by their frequency, estimated by a small counting
sketch, then by hash. Equal sets are one class, handled once. Two sets that reach the similarity share
an n-gram among the first |x| - ceil(t |x|) + 1 of each, so classes that share such an n-gram are
the candidates, if at the first n-gram they share what is left of both sets can still hold the
overlap. Where they meet at a later n-gram the same test may only turn down pairs that the first one
has proposed already. The sketches never call a repeated n-gram single, so n-grams that they call single need
not be sent: most texts send nothing. Pairs whose parity signatures differ in more bits than linked sets may in
n-grams are turned down before any set is fetched.

Candidates are verified in tries: the sets to be compared with one query set are stored in global
order, so that sets with equal beginnings share a path; overlaps with the query are carried down the
path once, and a subtree is left as soon as what remains of the query cannot reach the overlap.

A small group of candidates compares all its members. A large one would make pairs by the square,
so it first compares members with a few leaders of about their size, which joins groups of copies
into components; only pairs of members whose components still differ are compared after that. No
pair of linked sets is lost: each is compared, or known to be connected already.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Stash, bit_at, buckets_for, cell_blocks, merge_blocks, merged_bits, mix, ngram_hashes, plain, word_hashes

SHINGLE = 5
#: Cells of the frequency sketch (a power of two within these bounds) and its blocks. It orders repeated n-grams, so noise costs no link.
LEAST_BITS, MOST_BITS, BLOCKS = 14, 22, 32
#: Cells, of one bit, of the sketch that tells single n-grams: one to two for each n-gram, up to 2**30 (128 MB).
#: Beyond 8 GB of text it tells fewer and fewer of them, and prefixes are sent whole again, about 24 bytes for each four n-grams.
MOST_SINGLE_BITS = 30
#: n-grams that a task gathers before it writes them to the sketch.
FLUSH_GRAMS = 2_000_000
#: The top bits of an n-gram's code hold its frequency's logarithm (0: single), the others its hash.
LEVEL_SHIFT = 59
#: In a group, members outside its largest component compare with all the others if they are at most
#: SMALL (FEW after the first round); else all compare with LEADERS of each size, 512 times as many each round.
SMALL, FEW, LEADERS = 16, 64, 8
#: Prefix n-grams that a task gathers before it deals them out; sets that one task compares with a hot leader.
FLUSH, CHUNK = 1_000_000, 512
#: Members of a group in a row of packed ones, and in one task of later rounds.
PACKED, MEMBERS = 65_536, 20_000
#: Links that a task contracts at once, at 16 bytes each; no more than these go to one task.
TOGETHER = 1 << 20
#: Bits of the parity signature by which pairs are turned down, in columns of 64.
SIGNATURE = 512
SIGS = [f"s{k}" for k in range(SIGNATURE // 64)]
LAST = np.iinfo(np.int64).max


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def linked(inter: int, a: int, b: int) -> bool:
    """100 * intersection >= 75 * union."""
    return 100 * inter >= 75 * (a + b - inter)


def shingle_sets(texts: list[bytes | None]):
    """For each text the sorted distinct hashes of its 5-word shingles, A-Z lower-cased; the whole sequence if shorter."""
    held: list[list[bytes]] = []
    total = 0
    for text in texts:
        held.append((text or b"").lower().split())
        total += len(held[-1])
        if total >= 200_000:
            yield from hashed_sets(held)
            held, total = [], 0
    yield from hashed_sets(held)


def hashed_sets(texts: list[list[bytes]]):
    words = word_hashes([w for words in texts for w in words])
    grams = ngram_hashes(words, SHINGLE, 7 + SHINGLE)
    at = 0
    for own in texts:
        n = len(own)
        h = grams[at : at + n - SHINGLE + 1] if n >= SHINGLE else ngram_hashes(words[at : at + n], n, 7 + n) if n else grams[:0]
        at += n
        h = np.sort(h)
        yield h[np.concatenate([[True], h[1:] != h[:-1]])] if n > SHINGLE else h


def class_id(hashes: np.ndarray) -> int:
    """64 bits over a sorted set: equal for equal sets."""
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes at each bit: two sets' signatures differ in at most as many bits as the sets in members."""
    return np.packbits(np.bincount((hashes & U64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE) & 1).view(np.int64)


class Order:
    """The global order of n-grams: level 0 for single ones, else the logarithm of their estimated frequency."""

    def __init__(self, levels: np.ndarray, bits: int, repeated: np.ndarray, wide: int):
        self.levels, self.bits, self.repeated, self.wide = levels, bits, repeated, wide

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Hashes as codes that sort in the global order."""
        level = self.levels[(hashes & U64((1 << self.bits) - 1)).astype(np.int64)].astype(np.uint64)
        level *= bit_at(self.repeated, single_cells(hashes, self.wide))
        return np.sort((level << U64(LEVEL_SHIFT)) | (hashes >> U64(64 - LEVEL_SHIFT)))


def single_cells(hashes: np.ndarray, wide: int) -> np.ndarray:
    return (hashes >> U64(64 - wide)).astype(np.int64)


# --- pass 1: classes and frequencies --------------------------------------------------------------


def first_pass(batches, bits: int, wide: int):
    """(doc, class, n, signature) of each row, and this task's n-grams in blocks of both sketches: singles from block BLOCKS on."""
    counts = np.zeros(1 << bits, np.uint32)
    names = ["doc", "class", "n", *SIGS, "block", "data"]
    held: list[np.ndarray] = []
    total = 0

    def blocks(found: list[tuple[int, bytes]]):
        none = [pa.nulls(len(found), pa.int64())] * (3 + len(SIGS))
        return pa.RecordBatch.from_arrays([*none, pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names)

    def flush():
        grams = np.concatenate(held)
        np.add.at(counts, (grams & U64((1 << bits) - 1)).astype(np.int64), np.uint32(1))
        return blocks([(BLOCKS + k, x) for k, x in cell_blocks(single_cells(grams, wide), wide, BLOCKS)])

    for b in batches:
        ids, sizes, sigs = [], [], []
        for h in shingle_sets(b.column(1).to_pylist()):
            ids.append(class_id(h) if len(h) else None)
            sigs.append(signature(h))
            sizes.append(len(h))
            held.append(h)
            total += len(h)
            if total >= FLUSH_GRAMS:
                yield flush()
                held, total = [], 0
        sig = np.stack(sigs) if sigs else np.empty((0, len(SIGS)), np.int64)
        rows = [b.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *[pa.array(sig[:, k].copy()) for k in range(len(SIGS))]]
        yield pa.RecordBatch.from_arrays([*rows, pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], names)
    if held:
        yield flush()
    parts = np.split(counts, BLOCKS)
    yield blocks([(k, zlib.compress(parts[k].tobytes(), 1)) for k in range(BLOCKS) if parts[k].any()])


def frequency_order(parts: DataFrame, bits: int, wide: int) -> Order:
    """The merged sketches: floor(log2(count + 1)) of each cell, one byte a cell, from 1 to 31; and one bit a cell, two or more."""

    def merge(found) -> np.ndarray:
        total = np.zeros((1 << bits) // BLOCKS, np.uint64)
        for x in found:
            total += x
        return np.clip(np.floor(np.log2(total.astype(np.float64) + 1)), 1, 31).astype(np.uint8)

    levels = merge_blocks(parts.where(F.col("block") < BLOCKS), merge, plain)
    ones = (np.ones((1 << bits) // BLOCKS, np.uint8)).tobytes()
    levels = np.frombuffer(b"".join(zlib.decompress(levels[k]) if k in levels else ones for k in range(BLOCKS)), np.uint8)
    width = (1 << wide) // BLOCKS
    found = merge_blocks(parts.where(F.col("block") >= BLOCKS), merged_bits(width))
    return Order(levels, bits, np.frombuffer(b"".join(zlib.decompress(found[k]) if k in found else bytes(width // 8) for k in range(BLOCKS, 2 * BLOCKS)), np.uint8), wide)


# --- pass 2: candidates ---------------------------------------------------------------------------


def prefix_rows(batches, order: Order, buckets: int):
    """First n-grams of each class that the task meets, but for single ones, with their places, packed for the bucket that their code picks."""

    def flush(held):
        token, cls, n, place = (np.concatenate(x) for x in zip(*held, strict=True))
        at = (mix(token) % U64(buckets)).astype(np.int32)
        by = np.argsort(at, kind="stable")
        at, columns = at[by], [x[by] for x in (token, cls, n, place)]
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        ends = np.append(cut[1:], len(at))
        data = [pa.array([x[a:z].tobytes() for a, z in zip(cut, ends, strict=True)], pa.binary()) for x in columns]
        return pa.RecordBatch.from_arrays([pa.array(at[cut], pa.int32()), *data], ["bucket", "token", "cls", "n", "place"])

    held, total, seen = [], 0, set()
    for b in batches:
        for h in shingle_sets(b.column(1).to_pylist()):
            if not len(h):
                continue
            cls = class_id(h)
            if cls in seen:
                continue
            if len(seen) > 1_000_000:
                seen.clear()
            seen.add(cls)
            p = prefix_length(len(h))
            own = order.codes(h)[:p]
            single = int(np.searchsorted(own, U64(1 << LEVEL_SHIFT)))
            p -= single
            held.append((own[single:], np.full(p, cls, np.int64), np.full(p, len(h), np.int32), np.arange(single, single + p, dtype=np.int32)))
            total += p
            if total >= FLUSH:
                yield flush(held)
                held, total = [], 0
    if total:
        yield flush(held)


def compatible(a, b):
    """Sizes at which 75 of 100 can be reached."""
    return (4 * a >= 3 * b) & (4 * b >= 3 * a)


def reachable(n: np.ndarray, place: np.ndarray, i):
    """Whether the sets can reach the similarity with set i if the n-gram at place is the first that they share."""
    n = n.astype(np.int64)
    left = n - place
    return compatible(n, n[i]) & (7 * np.minimum(left, left[i]) >= 3 * (n + n[i]))


def propose(cls: np.ndarray, n: np.ndarray, place: np.ndarray, root: np.ndarray, few: int, k: int, sig: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """Pairs of positions of a group's members in different components to compare next, and whether they are all there are."""
    names, inverse, counts = np.unique(root, return_inverse=True, return_counts=True)
    largest = inverse == counts.argmax()
    others = np.flatnonzero(~largest)
    complete = len(others) <= few
    lead = others
    if not complete:
        band, rank = np.floor(np.log(n) / np.log(8 / 7)).astype(np.int64), mix(cls.astype(np.uint64) + U64(k))
        order = np.lexsort((rank, band, largest))
        new = np.concatenate([[True], (band[order][1:] != band[order][:-1]) | (largest[order][1:] != largest[order][:-1])])
        at = np.arange(len(order))
        lead = order[at - np.maximum.accumulate(np.where(new, at, 0)) < k]
        complete = len(np.intersect1d(lead, others)) == len(others)
    out = [np.empty((0, 2), np.int64)]
    for i in lead:
        some = np.flatnonzero((inverse != inverse[i]) & reachable(n, place, i))
        if sig is not None:  # linked sets differ in a seventh of the sum of their sizes at most
            some = some[7 * np.bitwise_count(sig[some] ^ sig[i]).sum(1, np.int64) <= n[some].astype(np.int64) + n[i]]
        out.append(np.stack([np.minimum(some, i), np.maximum(some, i)], 1))
    return np.concatenate(out), complete


class Pairs:
    """Distinct pairs of a bucket's classes."""

    def __init__(self, cls: np.ndarray):
        self.names, self.held, self.size = np.unique(cls), [np.empty(0, np.int64)], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = np.searchsorted(self.names, a), np.searchsorted(self.names, b)
        self.held.append(np.minimum(a, b) * len(self.names) + np.maximum(a, b))
        self.size += len(a)
        if self.size > 4_000_000:
            self.held, self.size = [np.unique(np.concatenate(self.held))], 0

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        found = np.unique(np.concatenate(self.held))
        return self.names[found // max(1, len(self.names))], self.names[found % max(1, len(self.names))]


def candidate_groups(table):
    """One bucket: pairs of candidate classes (a < b), and the members of groups whose pairs are not all there."""
    rows = [[np.frombuffer(x.as_py(), t) for x in table.column(k)] for k, t in (("token", np.uint64), ("cls", np.int64), ("n", np.int32), ("place", np.int32))]
    token, cls, n, place = (np.concatenate(x) for x in rows)
    order = np.lexsort((cls, token))  # by code, so that of groups with equal members the first has the earliest places
    token, cls, n, place = token[order], cls[order], n[order], place[order]
    keep = np.concatenate([[True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])])
    token, cls, n, place = token[keep], cls[keep], n[keep], place[keep]
    cut = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    sizes = np.diff(np.append(cut, len(token)))
    two = cut[sizes == 2]
    first, second = n[two].astype(np.int64), n[two + 1].astype(np.int64)
    two = two[compatible(first, second) & (7 * np.minimum(first - place[two], second - place[two + 1]) >= 3 * (first + second))]
    pairs, large, done = Pairs(cls), [], set()
    pairs.add(cls[two], cls[two + 1])
    for a, size in zip(cut[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        members = cls[a : a + size]
        if (own := members.tobytes()) in done:
            continue
        done.add(own)
        found, complete = propose(members, n[a : a + size], place[a : a + size], members, SMALL, LEADERS)
        pairs.add(members[found[:, 0]], members[found[:, 1]])
        if not complete:
            for x in range(a, a + size, PACKED):
                some = slice(x, min(a + size, x + PACKED))
                large.append((int(token[a : a + 1].view(np.int64)[0]), cls[some].tobytes(), n[some].tobytes(), place[some].tobytes()))
    first, second = pairs.columns()
    m, g = len(first), len(large)
    column = lambda values, kind: pa.concat_arrays([pa.nulls(m, kind), pa.array(values, kind)])
    return pa.table(
        {
            "a": pa.concat_arrays([pa.array(first), pa.nulls(g, pa.int64())]),
            "b": pa.concat_arrays([pa.array(second), pa.nulls(g, pa.int64())]),
            **{c: column([x[k] for x in large], pa.binary() if k else pa.int64()) for k, c in enumerate(("token", "cls", "n", "place"))},
        }
    )


# --- verification in tries -------------------------------------------------------------------------


class Trie:
    """Sets (sorted codes) by their paths; a set's own segment hangs on the path of the one before it.

    A query marks the codes it holds, sums hits along segments, and takes them from parent to child
    one generation at a time, so an overlap is computed once for all sets below a node. A segment
    and all below it are left when the hits so far and the query's codes still to come are
    too few for any set. n holds the sizes of whole sets, of which single n-grams, never shared, are left out.
    """

    def __init__(self, sets: list[np.ndarray], n: list[int]):
        self.n = np.array(n, np.int64)
        self.vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.array([len(x) for x in sets], np.int64)
        firsts = np.cumsum(sizes) - sizes
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        nodes, start, attach, parent, depth, stack, before, total = [], [], [], [], [], [], np.empty(0, np.uint64), 0
        for k, i in enumerate(self.order):
            own = sets[i]
            m = min(len(before), len(own))
            differ = before[:m] != own[:m]
            shared = int(differ.argmax()) if differ.any() else m
            while stack and stack[-1][1] >= shared:
                stack.pop()
            up, top = stack[-1] if stack else (-1, 0)
            parent.append(up)
            attach.append(start[up] + shared - 1 - top if stack else -1)
            depth.append(depth[up] + 1 if stack else 0)
            start.append(total)
            nodes.append(ids[firsts[i] + shared : firsts[i] + len(own)])
            total += len(own) - shared
            stack.append((k, shared))
            before = own
        self.nodes, self.start, self.attach, self.parent = np.concatenate(nodes), np.array(start), np.array(attach), np.array(parent)
        self.end = np.append(self.start[1:], total)
        depth = np.array(depth)
        self.generations = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]

    def links(self, query: np.ndarray, n: int) -> np.ndarray:
        """Which sets reach the similarity with the query, a set of n."""
        place = np.searchsorted(self.vocabulary, query)
        held = np.zeros(len(self.vocabulary) + 1, bool)
        place = place[self.vocabulary[np.minimum(place, len(self.vocabulary) - 1)] == query]
        held[place] = True
        sums = np.concatenate([[0], np.cumsum(held[self.nodes])])
        base, dead = np.zeros(len(self.start), np.int64), np.zeros(len(self.start), bool)
        least = (3 * n + 3) // 4
        for segs in self.generations[1:]:
            up, at = self.parent[segs], self.attach[segs]
            base[segs] = base[up] + sums[at + 1] - sums[self.start[up]]
            to_come = len(place) - np.searchsorted(place, self.nodes[at], "right")
            dead[segs] = dead[up] | (base[segs] + to_come < least)
        over = base + sums[self.end] - sums[self.start]
        sizes = self.n[self.order]
        out = np.zeros(len(sizes), bool)
        out[self.order] = ~dead & (100 * over >= 75 * (sizes + n - over))
        return out


def trie_of(names: list[int], sets: dict[int, np.ndarray], size: dict[int, int]) -> Trie:
    return Trie([sets[c] for c in names], [size[c] for c in names])


def verify_bucket(table):
    """Rows (cls, n, codes) of sets and (cls, members) of leaders: links (u, v) of leaders with members."""
    sets: dict[int, np.ndarray] = {}
    size: dict[int, int] = {}
    led: list[tuple[int, list[int]]] = []
    for cls, n, data, members in zip(*(table.column(c).to_pylist() for c in ("cls", "n", "codes", "members")), strict=True):
        if members is None:
            sets[cls], size[cls] = np.frombuffer(data, np.uint64), n
        else:
            led.append((cls, members))
    names = np.array(sorted(sets), np.int64)
    whole, u, v = None, [], []
    for lead, members in led:
        if 8 * len(members) >= len(names):
            whole = whole or trie_of(names.tolist(), sets, size)
            on = np.isin(names, members) & whole.links(sets[lead], size[lead])
            found = names[on].tolist()
        else:
            found = [c for c, ok in zip(members, trie_of(members, sets, size).links(sets[lead], size[lead]), strict=True) if ok]
        u += found
        v += [lead] * len(found)
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def verify(pairs: DataFrame, sets: DataFrame, n_pairs: int) -> DataFrame:
    """Links (u, v) among pairs (a, b). The endpoint in more pairs leads; hot leaders are split into chunks.

    A bucket gets each set that its leaders need once, however many of them need it.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("deg"))
    both = pairs.join(ends.select(F.col("c").alias("a"), F.col("deg").alias("da")), "a").join(ends.select(F.col("c").alias("b"), F.col("deg").alias("db")), "b")
    first = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    led = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("leader"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("cls"), F.ceil(F.greatest("da", "db") / F.lit(CHUNK)).alias("chunks"))
    buckets = buckets_for(n_pairs, 10_000, 24)
    place = F.pmod(F.xxhash64("leader", F.pmod(F.xxhash64("cls"), F.col("chunks"))), F.lit(buckets)).cast("int")
    led = led.select("leader", "cls", place.alias("bucket"))
    needed = led.select("bucket", "cls").union(led.select("bucket", "leader")).distinct()
    rows = needed.join(sets, "cls").select("bucket", "cls", "n", "codes", F.lit(None).cast("array<bigint>").alias("members"))
    rows = rows.union(led.groupBy("bucket", "leader").agg(F.collect_list("cls").alias("m")).select("bucket", "leader", F.lit(None).cast("long"), F.lit(None).cast("binary"), "m"))
    return rows.repartition(min(buckets, 4096), "bucket").groupBy("bucket").applyInArrow(verify_bucket, "u long, v long")


# --- connected components --------------------------------------------------------------------------


def stars(links: np.ndarray) -> pa.RecordBatch:
    """Links (two rows of ends) as their components' stars: each node but the least of its component, with that one."""
    names, ends = np.unique(links, return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(names))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    below = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[below]), pa.array(names[root[below]])], ["u", "v"])


def contracted(batches):
    """Stars in place of a task's links, up to TOGETHER and a batch of them at once."""
    held, total = [], 0
    for b in batches:
        held.append(np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]))
        total += b.num_rows
        if total > TOGETHER:
            yield stars(np.concatenate(held, 1))
            held, total = [], 0
    if held:
        yield stars(np.concatenate(held, 1))


def components(links: DataFrame) -> Stash:
    """A stash of (u, v): each node but the least of its component, with that least one.

    Up to TOGETHER links are contracted in one task, which spares the driver some ten exchanges a round. More
    are contracted by each task, and if what is left is still more go through alternating large and small stars,
    which hold only links, in the cluster, and write each round to the shared folder. Links are written before
    they are contracted, so that no task holds a Python worker that makes links and another that contracts them.
    """
    held = Stash(links, "links")
    for _ in range(2):
        together = held.df.count() <= TOGETHER
        after = Stash((held.df.coalesce(1) if together else held.df).mapInArrow(contracted, "u long, v long"), "links")
        held.drop()
        if together:
            return after
        held = after
    mark = None
    while True:
        edges = held.df
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "k")
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = Stash(small, "links")
        held.drop()
        held = after
        now = held.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return held
        mark = tuple(now)


# --- the join ---------------------------------------------------------------------------------------


def bloom(keys: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """Bits (at most 2**28) of a filter over a column of 64-bit keys, merged from partitions."""
    bits = min(28, max(12, (16 * n).bit_length()))
    blocks = min(BLOCKS, 1 << (bits - 12))

    def part(batches):
        found = np.unique(np.concatenate([np.empty(0, np.int64)] + [places(b.column(0).to_numpy(zero_copy_only=False), bits) for b in batches]))
        width = (1 << bits) // blocks
        for k in np.unique(found // width):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress((found[found // width == k] % width).astype(np.uint32).tobytes(), 1)], pa.binary())], ["block", "data"])

    def merge(parts) -> np.ndarray:
        on = np.zeros((1 << bits) // blocks, bool)
        for at in parts:
            on[at] = True
        return np.packbits(on)

    merged = merge_blocks(keys.mapInArrow(part, "block int, data binary"), merge, plain)
    empty = bytes((1 << bits) // blocks // 8)
    return bits, np.frombuffer(b"".join(zlib.decompress(merged[k]) if k in merged else empty for k in range(blocks)), np.uint8)


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> U64(64 - bits)).astype(np.int64)


def candidate_sets(base: DataFrame, reps: DataFrame, order) -> DataFrame:
    """(cls, n, codes without single n-grams) of the classes whose smallest document is in reps (doc): one scan, no shuffle of texts."""
    n = reps.count()
    wide, packed = bloom(reps, n)
    shared = base.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            at = places(b.column(0).to_numpy(zero_copy_only=False), wide)
            ids, sizes, data = [], [], []
            for h in shingle_sets(b.column(1).filter(pa.array(bit_at(shared.value, at))).to_pylist()):
                cls = class_id(h) if len(h) else None
                if cls is not None and cls not in seen:
                    seen.add(cls)
                    own = order.value.codes(h)
                    ids.append(cls)
                    sizes.append(len(own))
                    data.append(own[np.searchsorted(own, U64(1 << LEVEL_SHIFT)) :].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], ["cls", "n", "codes"])

    # the filter lets some others through, so a document of that number may pass for those without one
    return base.select(F.coalesce("doc", F.lit(int(LAST))), "t").mapInArrow(run, "cls long, n long, codes binary")


def plausible(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures differ in a seventh of the sum of their sizes at most, as those of linked sets do."""
    both = pairs
    for x in "ab":
        both = both.join(signatures.select(*[F.col(c).alias(f"{c}_{x}") for c in signatures.columns]), F.col(x) == F.col(f"c_{x}"))
    differ = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in SIGS), F.lit(0))
    return both.where(7 * differ <= F.col("n_a") + F.col("n_b")).select("a", "b")


def group_members(groups: DataFrame) -> DataFrame:
    """(token, cls, n, place) of the packed groups."""

    def explode(batches):
        for b in batches:
            for t, c, n, p in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                cls = np.frombuffer(c, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cls), t)), pa.array(cls), *(pa.array(np.frombuffer(x, np.int32)) for x in (n, p))], ["token", "cls", "n", "place"])

    return groups.mapInArrow(explode, "token long, cls long, n int, place int")


def led_members(members: DataFrame, roots: DataFrame, k: int) -> DataFrame:
    """members of groups with several components, with root, size (of the group), other (not of its largest component) and lead.

    Where at most FEW are of other components those lead; else about k of each band of sizes, picked by
    their hashes: bands are counted, not sorted, so that no group meets in one task.
    """
    rooted = members.join(roots, F.col("cls") == F.col("id"), "left").select("token", "cls", "n", "place", F.coalesce("root", "cls").alias("root"))
    by_root = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
    groups = by_root.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("top"), F.sum("c").alias("size"), (F.sum("c") - F.max("c")).alias("others")).where("others > 0")
    rooted = rooted.join(groups, "token").withColumns({"other": F.col("root") != F.col("top"), "band": F.floor(F.log("n") / float(np.log(8 / 7)))})
    bands = rooted.groupBy("token", "band", "other").agg(F.count(F.lit(1)).alias("in_band"))
    share = F.pmod(F.xxhash64("cls", F.lit(k)), F.lit(1 << 30)) < F.lit(float(k) * (1 << 30)) / F.col("in_band")
    return rooted.join(bands, ["token", "band", "other"]).select("token", "cls", "n", "place", "root", "size", "other", F.when(F.col("others") <= FEW, F.col("other")).otherwise(share).alias("lead"))


def remaining_pairs(led: DataFrame, signatures: DataFrame, n_groups: int) -> DataFrame:
    """Pairs (a, b) of leaders with members of other components. A group is dealt in chunks of its members, each of which gets all its leaders."""
    buckets = buckets_for(n_groups, 8, 24, 4096)
    rows = led.join(signatures.drop("n"), F.col("cls") == F.col("c")).withColumn("chunks", F.ceil(F.col("size") / MEMBERS).cast("int"))
    columns = ["token", "cls", "n", "place", "root", *SIGS]
    members = rows.select("chunks", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int").alias("chunk"), F.lit(False).alias("leads"), *columns)
    leaders = rows.where("lead").select("chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("leads"), *columns)
    dealt = members.union(leaders).withColumn("bucket", F.pmod(F.xxhash64("token", "chunk"), F.lit(buckets)).cast("int"))

    def pairs(table):
        get = lambda name: table.column(name).to_numpy()
        order = np.lexsort((get("leads"), get("chunk"), get("token")))
        token, chunk, leads, cls, n, place, root = (get(c)[order] for c in ("token", "chunk", "leads", "cls", "n", "place", "root"))
        sig = np.stack([get(x) for x in SIGS], 1).view(np.uint64)[order]
        n = n.astype(np.int64)
        left = n - place
        cut = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (chunk[1:] != chunk[:-1])]))
        out = Pairs(cls)
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(token)], strict=True):
            own = slice(a, a + int((~leads[a:z]).sum()))
            for i in range(own.stop, z):
                both = n[own] + n[i]
                some = np.flatnonzero((root[own] != root[i]) & compatible(n[own], n[i]) & (7 * np.minimum(left[own], left[i]) >= 3 * both))
                some = some[7 * np.bitwise_count(sig[own][some] ^ sig[i]).sum(1, np.int64) <= both[some]]
                out.add(cls[own][some], np.full(len(some), cls[i]))
        return pa.table({c: pa.array(x) for c, x in zip("ab", out.columns(), strict=True)})

    return dealt.select("bucket", "chunk", "leads", *columns).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    A set is the distinct 5-word shingles of a whole text, A-Z lower-cased; with fewer words the
    whole sequence is its one shingle; a text that is null, empty or wordless has none, links with
    nothing and is its own component. Rows that repeat a doc_id are separate rows of equal name. A
    null doc_id is larger than all others, so it names a component (as null) only where there is
    no other. An empty table gives no rows. Other columns are not read. Shingles are compared by
    59-bit and sets grouped by 64-bit hashes.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("t"))
    size = int(base.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"])
    bits = min(MOST_BITS, max(LEAST_BITS, (size // 48).bit_length()))
    wide = min(MOST_SINGLE_BITS, max(LEAST_BITS, (size // 8).bit_length()))
    sigs = ", ".join(f"{c} long" for c in SIGS)
    held = [Stash(base.mapInArrow(lambda batches: first_pass(batches, bits, wide), f"doc long, class long, n long, {sigs}, block int, data binary"), "classes")]
    first = held[0].df
    order = spark.sparkContext.broadcast(frequency_order(first.where("block is not null").select("block", "data"), bits, wide))
    rows = first.where("block is null").select("doc", F.col("class").alias("cls"), "n")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc").alias("rep"))
    signatures = first.where("class is not null").groupBy(F.col("class").alias("c")).agg(*[F.min(x).alias(x) for x in ("n", *SIGS)])

    buckets = buckets_for(size // 24, 300_000, 48)
    prefixes = base.mapInArrow(lambda batches: prefix_rows(batches, order.value, buckets), "bucket int, token binary, cls binary, n binary, place binary")
    held.append(Stash(prefixes.groupBy("bucket").applyInArrow(candidate_groups, "a long, b long, token long, cls binary, n binary, place binary"), "candidates"))
    found = held[-1].df
    proposed = found.where("a is not null").select("a", "b").distinct()
    held.append(Stash(plausible(proposed, signatures), "pairs"))
    pairs = held[-1].df
    groups = found.where("cls is not null").select("token", "cls", "n", "place")

    n_pairs = pairs.count()
    roots = None

    def sets_of(some: DataFrame) -> DataFrame:
        # read once, by verify, whose join finds them dealt by class already
        involved = some.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        reps = classes.join(involved, "cls", "left_semi").select(F.coalesce("rep", F.lit(int(LAST))).alias("doc")).distinct()
        return candidate_sets(base, reps, order).dropDuplicates(["cls"])

    def roots_of(trees: Stash) -> DataFrame:
        return trees.df.select(F.col("u").alias("id"), F.col("v").alias("root"))

    n_groups = groups.count()
    if n_pairs or n_groups:
        trees = components(verify(pairs, sets_of(pairs), n_pairs))
        roots = roots_of(trees)
        k = LEADERS
        while n_groups:
            k *= 512
            led = Stash(led_members(group_members(groups), roots, k), "members")
            more = Stash(remaining_pairs(led.df, signatures, n_groups), "pairs")
            incomplete = not led.df.where("other and not lead").isEmpty()
            led.drop()
            n_more = more.df.count()
            if n_more:
                after = components(trees.df.union(verify(more.df, sets_of(more.df), n_more)))
                trees.drop()
                trees = after
                roots = roots_of(trees)
            more.drop()
            if not incomplete:
                break
        held.append(trees)
    if roots is None:
        named = classes.select(F.col("cls").alias("c"), F.col("rep").alias("least"))
    else:
        rooted = classes.join(roots, F.col("cls") == F.col("id"), "left").select(F.col("cls").alias("c"), "rep", F.coalesce("root", "cls").alias("root"))
        least = rooted.groupBy("root").agg(F.min("rep").alias("least")).withColumnRenamed("root", "r")
        named = rooted.join(least, F.col("root") == F.col("r")).select("c", "least")
    out = rows.join(named, F.col("cls") == F.col("c"), "left")
    out = Stash(out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id")), "near-duplicates")
    for x in held:
        x.drop()
    return out.df
