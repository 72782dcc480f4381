"""Near-duplicate line removal by segment partition, with DataFrame operations alone.

Distinct lines are split into EDITS + 1 segments. A line within an edit of another holds one of that
line's segments unchanged, at a place that the segment's number and the difference in length fix; so
each line is indexed by (length, segment), and probes with the substrings that can match: its own
segments, as one of equal length does, and those of lines shorter by one. Where many lines meet, the
segment that may differ is split again, until few meet. Candidates are verified by edit distance in a
band of 2 * EDITS + 1 diagonals whose column of differences is one machine word, updated by bit operations.
Lines too short for an edit to mean little are repeats where they are equal: their hashes group them, without pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Stash

#: Edit threshold, and the shortest line (code points) that it holds for; shorter ones are judged by equality, or not at all.
EDITS, LEAST_CHARS = 1, 20
#: Keys at which more pairs than GROUP would meet are replaced by finer ones: PARTS of what they leave out.
GROUP, PARTS = 256, 8
#: Bits of the map of candidate lines, whose broadcast size they fix: 2**25 bits are 4 MB.
MAP_BITS, MAP_WORD = 25, 32_768


def bounds(m: int, lo: Column, hi: Column) -> list[tuple[Column, Column]]:
    """Bounds of the m segments of the characters lo to hi (from 0, end exclusive); of two, the last is longer by one at most."""
    at = [lo + F.floor((hi - lo) * j / m).cast("int") for j in range(m + 1)]
    return list(zip(at[:-1], at[1:], strict=True))


def entry(line: Column, d: Column, lo: Column, hi: Column) -> Column:
    """Index entry (d 0) of a line, or its probe (d 1) for lines shorter by one character: all but their characters lo to hi.

    What precedes lo is at the same place in both lines, what follows hi is d places later in the longer one.
    """
    n = F.char_length(line) - d
    key = F.xxhash64(n, lo, hi, F.substring(line, F.lit(1), lo), F.substring(line, hi + d + 1, n - hi))
    return F.struct(key.alias("key"), d.cast("int").alias("d"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def first_entries(lines: DataFrame) -> DataFrame:
    """lines with (key, d, lo, hi) for each of EDITS + 1 segments left out: a line within EDITS edits holds the other one unchanged."""
    out = []
    for d in range(EDITS + 1):
        n = (F.char_length("line") - d).cast("int")
        out += [entry(F.col("line"), F.lit(d), lo, hi) for lo, hi in bounds(EDITS + 1, F.lit(0), n)]
    return lines.select("*", F.explode(F.array(*out)).alias("e")).select(*lines.columns, "e.key", "e.d", "e.lo", "e.hi")


def finer_entries(entries: DataFrame) -> DataFrame:
    """Entries that leave out a PARTS-th of what entries leave out: the edit is in one of the parts, the others are held too."""
    out = [entry(F.col("line"), F.col("d"), lo, hi) for lo, hi in bounds(PARTS, F.col("lo"), F.col("hi"))]
    return entries.select("h1", "line", F.explode(F.array(*out)).alias("e")).select("h1", "line", "e.key", "e.d", "e.lo", "e.hi").where("lo < hi")


def shared_keys(entries: DataFrame) -> DataFrame:
    """(key, own, far) of the keys at which lines meet: own lines of the key's length, far ones that are longer."""
    counts = entries.groupBy("key").agg(F.sum(F.lit(1) - F.col("d")).alias("own"), F.sum("d").alias("far"))
    return counts.where("own > 1 or own * far > 0")


def meetings(entries: DataFrame) -> DataFrame:
    """(a, b) of the lines that meet at a key, each pair of a key once."""
    index = entries.where("d = 0").select(F.col("key").alias("k"), F.col("h1").alias("i"))
    met = entries.select("key", "d", "h1").join(index, (F.col("key") == F.col("k")) & ((F.col("d") == 1) | (F.col("h1") < F.col("i"))))
    return met.select(F.least("h1", "i").alias("a"), F.greatest("h1", "i").alias("b"))


def with_ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with both arrays as long and short."""
    swap = F.size(a) < F.size(b)
    return df.withColumn("long", F.when(swap, F.col(b)).otherwise(F.col(a))).withColumn("short", F.when(swap, F.col(a)).otherwise(F.col(b)))


def within(a: str, b: str, tau: int = EDITS) -> Column:
    """Whether two arrays of characters, the longer first, are within tau edits, by a banded bit-parallel scan.

    Bit j of a column's words stands for the diagonal j - tau; words have 2 * tau + 1 bits. Down to
    the diagonal's end each column tells whether the diagonal's cell grew, after it whether cells of the last row did.
    """
    width = 2 * tau + 1
    full = (1 << width) - 1
    bits = lambda x: x.bitwiseAND(F.lit(full))
    size_a, size_b = F.size(a), F.size(b)
    zero = F.lit(0).cast("bigint")

    def step(state: Column, j: Column) -> Column:
        match = zero
        for k in range(width):
            same = F.get(F.col(a), j + (k - tau)).eqNullSafe(F.get(F.col(b), j)) & (j + (k - tau) >= 0) & (j + (k - tau) < size_a)
            match = match + F.when(same, F.lit(1 << k)).otherwise(0).cast("bigint")
        vp, vn, dist = state["vp"], state["vn"], state["dist"]
        return F.struct(match.alias("eq"), vp.alias("vp"), vn.alias("vn"), dist.alias("dist"))

    def finish(s: Column, j: Column) -> Column:
        eq, vp, vn = s["eq"], s["vp"], s["vn"]
        d0 = bits((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn))
        return F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"), s["dist"].alias("dist"))

    def move(s: Column, j: Column) -> Column:
        d0, vp, vn = s["d0"], s["vp"], s["vn"]
        hp = bits(vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))))
        hn = d0.bitwiseAND(vp)
        on_diagonal = j < size_a - tau
        top = F.lit(1 << (2 * tau)).cast("bigint")
        row = F.lit(2 * tau - 1) - (j - F.greatest(size_a - tau, F.lit(0)))
        bit = F.when((row >= 0) & (row < 63), F.expr("1L") * F.pow(F.lit(2), F.greatest(row, F.lit(0))).cast("bigint")).otherwise(zero)
        grown = F.when(d0.bitwiseAND(top) == 0, 1).otherwise(0)
        last = F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0)
        x = F.shiftright(d0, 1)
        return F.struct(
            hn.bitwiseOR(bits(F.bitwise_not(x.bitwiseOR(hp)))).alias("vp"),
            x.bitwiseAND(hp).alias("vn"),
            (s["dist"] + F.when(on_diagonal, grown).otherwise(last)).cast("int").alias("dist"),
        )

    def column(state: Column, j: Column) -> Column:
        # each lambda binds what the next one reads more than once
        one = F.transform(F.array(step(state, j)), lambda s: finish(s, j))
        return F.get(F.transform(one, lambda s: move(s, j)), F.lit(0))

    start = F.struct(
        F.lit(((1 << (tau + 1)) - 1) << tau).cast("bigint").alias("vp"),
        zero.alias("vn"),
        F.lit(tau).alias("dist"),
    )
    # the scan may only stop at the end; a distance over 2 * tau on the diagonal cannot come back
    done = F.aggregate(F.sequence(F.lit(0), size_b - 1), start, lambda s, j: F.when(s["dist"] > 2 * tau, s).otherwise(column(s, j)))
    return (F.abs(size_a - size_b) <= tau) & (done["dist"] <= tau)


def judged_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """(doc, key, pos, line, h1, h2, n) of every judged line."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("text").alias("key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    base = base.withColumn("n", F.char_length("line")).where(is_judged(F.col("line"), short))
    return base.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(2), "line"))


def candidate_pairs(lines: DataFrame, stashes: list[Stash]) -> DataFrame:
    """(a, b) of line hashes h1, a < b, that meet at a key, read from stashes that are added to the list. A key at which many lines meet is replaced by finer ones.

    Two lines within an edit meet at one of the finer keys again, so none of them is lost; the
    replacement ends where a single character is left out, at which lines that meet are linked.
    """
    slim = lines.select("h1", "line")
    stashes.append(Stash(shared_keys(first_entries(slim)), "line-keys"))
    shared = stashes[-1].df
    some = mapped(first_entries(slim), "key", hash_map(shared.select(F.col("key").alias("h"))))
    found = []
    while True:
        stashes.append(Stash(some.join(shared, "key"), "line-entries"))
        held = stashes[-1].df
        few = (F.col("own") * (F.col("own") + F.col("far")) <= GROUP) | (F.col("hi") - F.col("lo") <= 1)
        found.append(meetings(held.where(few)))
        many = held.where(~few)
        if many.isEmpty():
            break
        some = finer_entries(many)
        shared = shared_keys(some)
    return reduce(DataFrame.union, found).distinct()


def hash_map(hashes: DataFrame) -> DataFrame:
    """(word, bitmap) of the column h: at most 2**MAP_BITS bits whatever the number of rows."""
    place = F.pmod("h", F.lit(1 << MAP_BITS))
    return hashes.select(place.alias("p")).groupBy(F.floor(F.col("p") / MAP_WORD).cast("int").alias("word")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(MAP_WORD))).alias("bitmap"))


def mapped(df: DataFrame, column: str, bitmap: DataFrame) -> DataFrame:
    """Rows whose hash in column the map holds; the map is broadcast, its size is fixed."""
    place = F.pmod(column, F.lit(1 << MAP_BITS))
    some = df.withColumn("place", place).join(F.broadcast(bitmap), F.floor(F.col("place") / MAP_WORD).cast("int") == F.col("word"))
    bit = F.pmod("place", F.lit(MAP_WORD)).cast("int")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return some.where(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0).drop("place", "word", "bitmap")


def kept_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """(doc, key, kept array<int>): positions of the judged lines of each document that stay."""
    first = F.min(F.struct("doc", "key", "pos")).alias("first")
    held = [Stash(judged_lines(docs, short).groupBy("h1", "h2").agg(first, F.first("line").alias("line"), F.first("n").alias("n")), "lines")]
    classes = held[0].df
    # lines under LEAST_CHARS are repeats by their class alone
    long = classes.where(F.col("n") >= LEAST_CHARS)
    stashes: list[Stash] = []
    pairs = Stash(candidate_pairs(long, stashes), "line-pairs")
    for x in stashes:
        x.drop()
    held.append(pairs)
    near = mapped(long, "h1", hash_map(pairs.df.select(F.explode(F.array("a", "b")).alias("h")))).select("h1", "h2", "first", F.split("line", "").alias("chars"))
    left, right = (near.select(*[F.col(c).alias(f"{c}_{s}") for c in near.columns]) for s in "ab")
    both = pairs.df.join(left, F.col("a") == F.col("h1_a")).join(right, F.col("b") == F.col("h1_b"))
    linked = with_ordered(both, "chars_a", "chars_b").where(within("long", "short"))
    later = F.col("first_a") > F.col("first_b")
    gone = linked.select(F.when(later, F.col("h1_a")).otherwise(F.col("h1_b")).alias("h1"), F.when(later, F.col("h2_a")).otherwise(F.col("h2_b")).alias("h2")).distinct()
    stay = classes.select("h1", "h2", "first").join(gone, ["h1", "h2"], "left_anti")
    kept = Stash(stay.groupBy("first.doc", "first.key").agg(F.sort_array(F.collect_list("first.pos")).alias("kept")), "kept-lines")
    for x in held:
        x.drop()
    return kept.df


def positions(line_test) -> Column:
    """Positions of the lines of __lines for which line_test holds."""
    return F.filter(F.transform("__lines", lambda x, i: F.when(line_test(x), i)), lambda i: i.isNotNull())


def is_judged(line: Column, short: bool = False) -> Column:
    """Whether a line has a word in it and, unless short, LEAST_CHARS characters or more."""
    word = line.rlike(f"[^{SPACE[1:-1]}]")
    return word if short else (F.char_length(line) >= LEAST_CHARS) & word


def line_verdicts(docs: DataFrame, short: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_removed, removed (line numbers from 0, comma-joined).

    Lines are split at U+000A. A line of LEAST_CHARS characters or more with a word in it is
    removed if it is within EDITS edits (insert, delete, replace a code point) of a line that stands
    earlier: in a document of smaller doc_id, or earlier in the same one. With `short`, a shorter line
    with a word in it is removed if an equal one stands earlier; without, it stays. Lines are judged on the
    input, so a line may fall to an earlier one that falls itself. A null doc_id is larger than all
    others. Rows that share a doc_id are ordered by their text's hash; equal rows count as one row
    and get equal results. A null text has no lines. An empty table gives no rows. Other columns
    are not read. The texts themselves are not shuffled for this result.
    """
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("text").alias("key"), F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")).alias("__lines"))
    base = base.select("doc_id", "doc", "key", F.size("__lines").cast("long").alias("n_lines"), positions(lambda x: is_judged(x, short)).alias("judged"))
    kept = kept_lines(docs, short).select(F.col("doc").alias("d"), F.col("key").alias("k"), "kept")
    out = base.join(kept, (F.col("doc") == F.col("d")) & (F.col("key") == F.col("k")), "left")
    out = out.withColumn("gone", F.when(F.col("kept").isNull(), F.col("judged")).otherwise(F.array_except("judged", "kept")))
    return out.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.concat_ws(",", F.col("gone").cast("array<string>")).alias("removed"))


def remove_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """docs with the same columns, their texts without the removed lines, documents left without a word dropped.

    A document that had no word before stays as it is. n_chars, if there, is the new length; `short` as in line_verdicts.
    """
    # columns are packed, so that none of theirs can clash with what is added
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64("text").alias("k"), "text")
    kept = kept_lines(docs, short).hint("shuffle_hash")
    out = row.join(kept, (F.col("d") == F.col("doc")) & (F.col("k") == F.col("key")), "left").withColumn("__lines", F.split("text", "\n"))
    others = positions(lambda x: ~is_judged(x, short))
    stay = F.sort_array(F.concat(F.coalesce("kept", F.array().cast("array<int>")), others))
    out = out.withColumn("stay", stay).withColumn("left", F.array_join(F.transform("stay", lambda i: F.get("__lines", i)), "\n"))
    word = f"[^{SPACE[1:-1]}]"
    out = out.where(F.col("text").isNull() | F.col("left").rlike(word) | ~F.col("text").rlike(word))
    new = {"text": F.when(F.col("text").isNotNull(), F.col("left"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("left").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
