"""The corpus pipeline from end to end on a small corpus, each stage against a plain version of it."""

import numpy as np
import pytest

import corpus_pipeline
from loomgraph.llm import classifier, decontam, jaccard


def sentence(rng, n, vocabulary):
    return " ".join(f"{vocabulary}{rng.integers(0, 400)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    texts = [sentence(rng, 60, "word") for _ in range(40)]
    common = "This very line stands in many of the documents."
    texts += [f"{common}\n{sentence(rng, 50, 'word')}" for _ in range(6)]
    texts += [texts[3], texts[3], texts[5] + " more", None, "", "one\ntwo"]
    items = [sentence(rng, 30, "item") for _ in range(3)]
    texts += [sentence(rng, 20, "word") + " " + items[0], sentence(rng, 60, "word") + "\n" + " ".join(items[1].split()[:12]), items[2]]
    good = len(texts)
    texts += [" ".join(["spam"] * 40) + f" {sentence(rng, 30, 'junk')}" for _ in range(40)]
    rows = [(k, t, "en", ["a", "b", None][k % 3], len(t or ""), "clash") for k, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row` string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k < good), 0) for k in range(len(texts)) if texts[k]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])


def within_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def deduped(rows):
    seen, out = [], []
    for r in rows:
        lines = []
        for line in (r["text"] or "").split("\n"):
            if line.split() and any(line == x or (len(line) >= 20 and len(x) >= 20 and within_edit(line, x)) for x in seen):
                continue
            lines.append(line)
        seen += [x for x in (r["text"] or "").split("\n") if x.split()]
        # lines of one document fall to earlier ones of it as well, but there are none such here
        left = "\n".join(lines)
        if r["text"] is None or left.split() or not r["text"].split():
            out.append({**r, "text": None if r["text"] is None else left, "n_chars": len(left) if r["text"] is not None else None})
    return out


def representatives(rows):
    sets = []
    for r in rows:
        w = (r["text"] or "").lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and jaccard.linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [r for k, r in enumerate(rows) if find(k) == k]


def clean(rows, items):
    windows = set().union(*(decontam.item_windows(decontam.normal_words(t.encode())) for t in items))
    out = []
    for r in rows:
        w = decontam.normal_words((r["text"] or "").encode())
        hit = {p for j in range(len(w) - 12) for p in range(j, j + 13) if b" ".join(w[j : j + 13]) in windows}
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def test_every_stage_and_the_whole(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]

    kept = stages["quality classifier"](spark, docs, corpus)
    model = classifier.train(docs, labels)
    expected = [r for r in rows_of(docs) if model.score((r["text"] or "").encode(), {}) >= classifier.THRESHOLD]
    assert kept.columns == docs.columns and rows_of(kept) == expected
    spam = [r for r in rows_of(docs) if (r["text"] or "").startswith("spam")]
    assert not [r for r in expected if r in spam] and len(expected) >= 50

    before = rows_of(kept)
    lines = stages["line dedup"](spark, kept, corpus)
    found = rows_of(lines)
    assert [(r["doc_id"], r["text"]) for r in found] == [(r["doc_id"], r["text"]) for r in deduped(before)]
    assert lines.columns == docs.columns

    one = stages["n-gram Jaccard join"](spark, kept, corpus)
    assert rows_of(one) == representatives(before) and len(rows_of(one)) < len(before)
    assert rows_of(stages["benchmark decontamination"](spark, kept, corpus)) == clean(before, items) != before

    last = clean(representatives(found), items)
    mixed = rows_of(corpus_pipeline.run(spark, corpus))
    assert [r["doc_id"] for r in mixed] == [r["doc_id"] for r in last]
    assert [r["size"] for r in mixed] == [len((r["text"] or "").split()) for r in last]
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in mixed)
    for source in ("a", "b", None):
        own = [r for r in mixed if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 1


def test_empty_corpus(spark, corpus, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
