"""Quality rules and robust multivariate outliers, with DataFrame operations alone.

Five statistics of every text are transformed to a vector. For each language and source, each
language and the whole table the minimum covariance determinant is estimated over the documents that pass the base rules:
from two deterministic starts, concentration steps take mean and covariance of the three quarters
of the documents nearest so far, until no group's determinant falls any more; the start with the smaller determinant gives the estimate. A
document far from its group's estimate, by Mahalanobis distance, is rejected; if the group is small,
the estimate of its language judges, and if that is small too, the one of the whole table. The distance adds to
the group's covariance the error with which a text of that length tells each statistic, so what a
short text may show by chance counts less than the same share in a long one.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Stash

MIN_WORDS = 50
#: Share of a group that an estimate covers, and the smallest group that is judged by its own estimate.
SUPPORT, LEAST_GROUP = 0.75, 40
#: Steps end when no log determinant falls by FALL, and after MOST_STEPS in any case.
FALL, MOST_STEPS = 1e-3, 12
#: Scale that makes the covariance of the nearest 75 % of a 5-dimensional normal sample that of the whole.
CONSISTENCY = 1.41
#: Chi-square with 5 degrees of freedom at 1 - 1e-6; distances beyond it are outliers.
CUTOFF = 37.33
#: The least standard deviation of each transform in a group, for numerical stability: about one word in the shortest text that passes.
FLOORS = (0.02, 0.02, 0.02, 0.02, 0.02)
#: Words that the smallest repeat covers: two windows of three.
LEAST_REPEAT = 6
P = len(FLOORS)
#: Groups of three levels: language and source (0), language (1), the whole table (2); the coarser leave the finer columns null.
GROUP = ("level", "lang", "source")
KEYS = [f"g_{c}" for c in GROUP]
MEANS, COVS = [f"m{j}" for j in range(P)], [f"c{j}{k}" for j in range(P) for k in range(j + 1)]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five base columns and base_failed; each text is read once, whole."""
    text = F.coalesce("text", F.lit(""))
    # one plain character between words lets split search without a pattern: its empty pieces tell how many there were
    spaced = text
    for c in "\t\n\x0b\f\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    out = docs.select("doc_id", "lang", "source", text.alias("t"), F.split(spaced, " ").alias("pieces"), F.split(text, "\n").alias("lines"))
    out = out.withColumns({"w": F.array_remove("pieces", ""), "lines": F.filter("lines", lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))})
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    out = out.withColumn("h", F.when(F.size("w") >= 3, hashes).otherwise(F.array().cast("array<bigint>")))
    # only a text with a repeated window pays for sorting windows with their places
    out = out.withColumn("some", F.size(F.array_distinct("h")) < F.size("h"))
    out = out.withColumn("places", F.when(F.col("some"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    again = F.filter(
        F.transform("places", lambda x, i: F.when((F.get("places", i - 1)["h"] == x["h"]) | (F.get("places", i + 1)["h"] == x["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    out = out.withColumn("again", again)
    covered = F.size(F.array_distinct(F.flatten(F.transform("again", lambda i: F.array(i, i + 1, i + 2)))))
    return out.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        (F.char_length("t") - F.size("pieces") + 1).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("some"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics; shares are put on a square-root scale, sizes on a logarithmic one."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log1p("n_words"),
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def errors() -> list[Column]:
    """Variance of measurement of each transform in a text: that of the root of a share of n is 1 / 4n, by counts of independent events."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [F.lit(0.0), 0.25 / words, 0.25 / chars, 0.25 / F.greatest("n_lines", F.lit(1)), 0.25 * LEAST_REPEAT / words]


def same_group() -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in GROUP])


def leveled(rows: DataFrame) -> DataFrame:
    """rows once for each level of groups they belong to."""
    at = lambda c, last: F.when(F.col("level") <= last, F.col(c)).alias(c)
    rows = rows.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return rows.select("level", at("lang", 1), at("source", 0), *[f"x{j}" for j in range(P)])


def grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*[F.col(c).alias(f"g_{c}") for c in GROUP])


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and b of the same groups, side by side."""
    b = b.withColumnsRenamed({c: f"o_{c}" for c in KEYS})
    return a.join(b, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in KEYS])).drop(*[f"o_{c}" for c in KEYS])


def moments(rows: DataFrame, weight: str, tag: str) -> list[Column]:
    """Aggregates for mean and covariance of the rows where weight holds."""
    on = lambda x: F.avg(F.when(F.col(weight), x))
    out = [on(F.col(f"x{j}")).alias(f"{tag}m{j}") for j in range(P)]
    return out + [on(F.col(f"x{j}") * F.col(f"x{k}")).alias(f"{tag}c{j}{k}") for j in range(P) for k in range(j + 1)]


def whitener(groups: DataFrame, tag: str, scale: float) -> DataFrame:
    """From means and raw second moments: the inverse Cholesky factor (a00, a10, a11 ...) and log determinant."""
    c = lambda j, k: F.col(f"{tag}c{max(j, k)}{min(j, k)}")
    m = lambda j: F.col(f"{tag}m{j}")
    out = groups.withColumns({f"{tag}s{j}{k}": scale * (c(j, k) - m(j) * m(k)) + (F.lit(FLOORS[j] ** 2) if j == k else F.lit(0.0)) for j in range(P) for k in range(j + 1)})
    for j in range(P):
        for k in range(j + 1):
            rest = F.col(f"{tag}s{j}{k}") - reduce(add, [F.col(f"{tag}l{j}{i}") * F.col(f"{tag}l{k}{i}") for i in range(k)], F.lit(0.0))
            value = F.sqrt(F.greatest(rest, F.lit(FLOORS[j] ** 2))) if j == k else rest / F.col(f"{tag}l{k}{k}")
            out = out.withColumn(f"{tag}l{j}{k}", value)
    for j in range(P):
        for k in range(j + 1):
            if j == k:
                value = 1 / F.col(f"{tag}l{j}{j}")
            else:
                value = -reduce(add, [F.col(f"{tag}l{j}{i}") * F.col(f"{tag}a{i}{k}") for i in range(k, j)]) / F.col(f"{tag}l{j}{j}")
            out = out.withColumn(f"{tag}a{j}{k}", value)
    out = out.withColumn(f"{tag}det", reduce(add, [F.log(F.col(f"{tag}l{j}{j}")) for j in range(P)]))
    return out.select(*KEYS, "size", *estimate_columns(tag))


def estimate_columns(tag: str) -> list[str]:
    return [f"{tag}m{j}" for j in range(P)] + [f"{tag}{x}{j}{k}" for x in "as" for j in range(P) for k in range(j + 1)] + [f"{tag}det"]


def distance(tag: str) -> Column:
    """Squared Mahalanobis distance of x to an estimate."""
    z = [reduce(add, [F.col(f"{tag}a{j}{k}") * (F.col(f"x{k}") - F.col(f"{tag}m{k}")) for k in range(j + 1)]) for j in range(P)]
    return reduce(add, [x * x for x in z])


def with_distance(rows: DataFrame, tag: str) -> DataFrame:
    """rows with distance: the squared Mahalanobis distance of x under an estimate's covariance and the text's own errors."""
    own = errors()
    for j in range(P):
        for k in range(j + 1):
            rest = F.col(f"{tag}s{j}{k}") - reduce(add, [F.col(f"l{j}{i}") * F.col(f"l{k}{i}") for i in range(k)], F.lit(0.0))
            value = F.sqrt(F.greatest(rest + own[j], F.lit(FLOORS[j] ** 2))) if j == k else rest / F.col(f"l{k}{k}")
            rows = rows.withColumn(f"l{j}{k}", value)
        off = F.col(f"x{j}") - F.col(f"{tag}m{j}") - reduce(add, [F.col(f"l{j}{i}") * F.col(f"z{i}") for i in range(j)], F.lit(0.0))
        rows = rows.withColumn(f"z{j}", off / F.col(f"l{j}{j}"))
    return rows.withColumn("distance", reduce(add, [F.col(f"z{j}") ** 2 for j in range(P)]))


def starts(rows: DataFrame) -> Stash:
    """Two diagonal starts for each group: spread by median deviation (u), and by the interquartile range (v)."""
    middle = grouped(rows).agg(F.count(F.lit(1)).alias("size"), *[F.percentile_approx(f"x{j}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q{j}") for j in range(P)])
    held = Stash(middle, "mcd")
    middle = held.df
    near = rows.join(middle, same_group())
    spread = grouped(near).agg(*[F.percentile_approx(F.abs(F.col(f"x{j}") - F.col(f"q{j}")[1]), 0.5, 1000).alias(f"d{j}") for j in range(P)])
    out = joined(middle, spread)
    columns = [*KEYS, "size"]
    for tag, width in (("u", lambda j: 1.4826 * F.col(f"d{j}")), ("v", lambda j: (F.col(f"q{j}")[2] - F.col(f"q{j}")[0]) / 1.349)):
        columns += [F.col(f"q{j}")[1].alias(f"{tag}m{j}") for j in range(P)]
        columns += [(1 / F.sqrt(width(j) ** 2 + FLOORS[j] ** 2) if j == k else F.lit(0.0)).alias(f"{tag}a{j}{k}") for j in range(P) for k in range(j + 1)]
        columns += [F.lit(0.0).alias(f"{tag}s{j}{k}") for j in range(P) for k in range(j + 1)]
        columns.append(F.lit(0.0).alias(f"{tag}det"))
    out = Stash(out.select(*columns), "mcd")
    held.drop()
    return out


def estimates(rows: DataFrame) -> tuple[DataFrame, Stash]:
    """(g_level, g_lang, g_source, size, em*, ea*, es*): the estimate of every group, and the stash it is read from; rows hold level, lang, source and x0..x4.

    A step that does not make a group's determinant smaller leaves that group's estimate as it was.
    """
    columns = [*KEYS, "size", *estimate_columns("u"), *estimate_columns("v")]
    held = starts(rows)
    for step in range(MOST_STEPS):
        now = held.df
        near = rows.join(now.select(*KEYS, *[c for c in columns if c[1:2] in "ma"]), same_group())
        near = near.select(*GROUP, *[f"x{j}" for j in range(P)], distance("u").alias("du"), distance("v").alias("dv"))
        cut = Stash(grouped(near).agg(F.percentile_approx("du", SUPPORT, 1000).alias("cu"), F.percentile_approx("dv", SUPPORT, 1000).alias("cv")), "mcd")
        near = near.join(cut.df, same_group()).withColumn("inu", F.col("du") <= F.col("cu")).withColumn("inv", F.col("dv") <= F.col("cv"))
        found = Stash(grouped(near).agg(F.count(F.lit(1)).alias("size"), *moments(near, "inu", "u"), *moments(near, "inv", "v")), "mcd")
        new = joined(whitener(found.df, "u", CONSISTENCY), whitener(found.df, "v", CONSISTENCY).drop("size"))
        if step:  # the starts have no determinant
            old = now.select(*[F.col(c).alias(c if c in KEYS else f"o_{c}") for c in columns])
            both = joined(new, old)
            falls = {t: F.col(f"{t}det") < F.col(f"o_{t}det") - FALL for t in "uv"}
            new = both.select(*KEYS, "size", *[F.when(falls[c[0]], F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for t in "uv" for c in estimate_columns(t)], (falls["u"] | falls["v"]).alias("fell"))
        after = Stash(new.select(*columns, "fell") if step else new.select(*columns, F.lit(True).alias("fell")), "mcd")
        for x in (held, cut, found):
            x.drop()
        held = after
        if held.df.where("fell").isEmpty():
            break
    better = F.col("udet") <= F.col("vdet")
    return held.df.select(*KEYS, "size", *[F.when(better, F.col(f"u{c[1:]}")).otherwise(F.col(f"v{c[1:]}")).alias(f"e{c[1:]}") for c in estimate_columns("u")]), held


def with_estimate(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """rows with the columns of the finest estimate over LEAST_GROUP documents or more, else those of the whole table."""
    names = estimate_columns("e")
    for level in range(3):
        some = fitted.where(f"g_level = {level}" + f" and size >= {LEAST_GROUP}" * (level < 2))
        some = some.select(*[F.col(f"g_{c}").alias(f"k_{c}") for c in GROUP[1 : 3 - level]], F.struct(*names).alias(f"e_{level}"))
        on = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in GROUP[1 : 3 - level]]
        some = some if level == 0 else F.broadcast(some)
        rows = rows.join(some, reduce(lambda a, b: a & b, on, F.lit(True)), "left").drop("k_lang", "k_source")
    return rows.withColumn("e", F.coalesce("e_0", "e_1", "e_2")).select("*", "e.*").drop("e", "e_0", "e_1", "e_2")


def judge(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    kept is false if base_failed, else whether the squared distance is at most CUTOFF; any statistic
    can exceed it alone, where a text is long enough to tell it so well. Where fewer than LEAST_GROUP
    documents of a group pass the base rules, those are judged by the estimate of their language, or of
    the whole table, which judges whatever its size. Where base_failed, distance is null. A null
    text has no words and fails; null lang and source form groups of their own; repeated rows count as often as they stand; an empty table gives no rows. Other columns are not read.
    """
    held = [Stash(statistics(docs).select("*", *[x.alias(f"x{j}") for j, x in enumerate(vector())]), "statistics")]
    rows = held[0].df
    held.append(Stash(leveled(rows.where(~F.col("base_failed"))), "levels"))
    fitted, last = estimates(held[1].df)
    far = with_distance(with_estimate(rows, fitted), "e")
    far = far.withColumn("distance", F.when(~F.col("base_failed"), F.col("distance")))
    kept = ~F.col("base_failed") & (F.col("distance") <= CUTOFF)
    out = Stash(far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance"), "judged")
    for x in (*held, last):
        x.drop()
    return out.df
