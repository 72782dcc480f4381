"""The estimate and the verdict of the quality rules against a plain version in numpy."""

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import rules

P = rules.P


def rank(x, p):
    return np.sort(x)[max(0, int(np.ceil(p * len(x))) - 1)]


def factor(cov):
    """Cholesky factor whose pivots are at least the floors."""
    low = np.zeros((P, P))
    for j in range(P):
        for k in range(j + 1):
            rest = cov[j, k] - low[j, :k] @ low[k, :k]
            low[j, k] = np.sqrt(max(rest, rules.FLOORS[j] ** 2)) if j == k else rest / low[k, k]
    return low


def estimate(x):
    """(mean, covariance) of a group, by concentration steps from both starts."""
    median = np.array([rank(x[:, j], 0.5) for j in range(P)])
    floor = np.array(rules.FLOORS) ** 2
    mad = 1.4826 * np.array([rank(np.abs(x[:, j] - median[j]), 0.5) for j in range(P)])
    iqr = np.array([rank(x[:, j], 0.75) - rank(x[:, j], 0.25) for j in range(P)]) / 1.349
    best = None
    for width in (mad, iqr):
        mean, low, det, cov = median, np.diag(np.sqrt(width**2 + floor)), None, None
        while True:
            d = (np.linalg.solve(low, (x - mean).T) ** 2).sum(0)
            some = x[d <= rank(d, rules.SUPPORT)]
            new = rules.CONSISTENCY * (some.T @ some / len(some) - np.outer(some.mean(0), some.mean(0))) + np.diag(floor)
            own = factor(new)
            fell = det is None or np.log(np.diag(own)).sum() < det - rules.FALL
            if fell:
                mean, low, det, cov = some.mean(0), own, np.log(np.diag(own)).sum(), new
            else:
                break
        if best is None or det < best[0] - 1e-12:
            best = (det, mean, cov)
    return best[1], best[2]


def texts(rng, n, share):
    out = []
    for k in range(n):
        words = [f"w{rng.integers(0, 300)}" for _ in range(rng.integers(60, 120))]
        for p in rng.choice(len(words), int(share * len(words)), replace=False):
            words[p] += "#"
        lines = [" ".join(words[a : a + 12]) for a in range(0, len(words), 12)]
        out.append("\n".join(lines + lines[:1] * int(rng.integers(0, 3))))
    return out


def test_estimate_and_verdict_equal_the_plain_version(spark):
    rng = np.random.default_rng(4)
    rows = [(t, "en", "a") for t in texts(rng, 70, 0.05)] + [(t, "en", None) for t in texts(rng, 60, 0.1)] + [(t, "de", "a") for t in texts(rng, 12, 0.0)]
    rows += [(" ".join(f"x{k}###" for k in range(90)), "en", "a"), (None, None, None), ("short", "en", "a"), (rows[0][0], "en", "a")]
    docs = spark.createDataFrame([(k, *r, "clash") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, distance string").repartition(3)
    stats = rules.statistics(docs).select("*", *[x.alias(f"x{j}") for j, x in enumerate(rules.vector())], *[x.alias(f"e{j}") for j, x in enumerate(rules.errors())]).toPandas().sort_values("doc_id")
    found = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    judged = stats[~stats.base_failed]
    x = judged[[f"x{j}" for j in range(P)]].to_numpy(float)
    groups = [judged.lang.fillna("-").str.cat(judged.source.fillna("-"), sep="/"), judged.lang.fillna("-"), judged.lang.fillna("-").map(lambda _: "")]
    held = [{g: (int((own == g).sum()), estimate(x[(own == g).to_numpy()])) for g in own.unique()} for own in groups]
    for k, (i, row) in enumerate(judged.iterrows()):
        level = next(n for n in range(3) if n == 2 or held[n][groups[n].iloc[k]][0] >= rules.LEAST_GROUP)
        mean, cov = held[level][groups[level].iloc[k]][1]
        low = factor(cov + np.diag(row[[f"e{j}" for j in range(P)]].to_numpy(float)))
        distance = (np.linalg.solve(low, x[k] - mean) ** 2).sum()
        r = found[row.doc_id]
        assert np.isclose(r["distance"], distance, rtol=1e-6), (row.doc_id, level, r["distance"], distance)
        assert r["kept"] == (distance <= rules.CUTOFF)
    assert not found[142]["kept"] and not found[142]["base_failed"]
    for i in stats[stats.base_failed].doc_id:
        assert found[i]["distance"] is None and not found[i]["kept"]
    assert found[0]["distance"] == found[145]["distance"]
    assert rules.judge(docs.where(F.lit(False))).count() == 0
