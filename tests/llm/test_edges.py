"""Nulls, repeated rows, very long values and clashing columns, where other tests do not have them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import classifier, decontam, jaccard, linededup, substring, urlfilter

LAST = (1 << 63) - 1


def test_urls(spark):
    long = "http://" + "a." * 50_000 + "net/" + "x" * 100_000
    rows = [(1, "http://a.net/"), (1, "http://a.net/"), (None, "http://a.net/"), (2, None), (3, long), (4, "http://" + "x" * 200_000), (5, "://"), (6, "HTTP://NET/?#"), (7, "a://b://net/")]
    pages = spark.createDataFrame([(i, u, "clash", 1, "rule") for i, u in rows], "page_id long, url string, host string, path int, verdict string")
    found = [tuple(r) for r in urlfilter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert found.count((1, "a.net", "/", "net/", "block")) == 2 and (None, "a.net", "/", "net/", "block") in found
    by = {r[0]: r for r in found}
    assert by[2][1:] == ("", "", None, "allow") and by[5][1:] == ("", "", None, "allow")
    assert by[3][1] == "a." * 50_000 + "net" and by[3][3:] == ("net/", "block") and len(by[3][2]) == 100_001
    assert by[4][3:] == (None, "allow") and by[6][1:] == ("net", "/", "net/", "block") and by[7][1:] == ("b:", "//net/", None, "allow")


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(2)
    text = lambda w: " ".join(f"{w}{rng.integers(0, 50)}" for _ in range(40))
    docs = [(k, text("good" if k % 2 else "bad")) for k in range(60)]
    return docs, [(k, k % 2) for k, _ in docs]


def test_classifier(spark, labelled):
    docs, labels = labelled
    rows = [*docs, (None, docs[1][1]), (61, None), (62, ""), (63, " \n"), (64, "good1 " * 300_000), (1, docs[1][1]), (1, docs[1][1])]
    wide = spark.createDataFrame([(i, t, 0.5, "clash", 2) for i, t in rows], "doc_id long, text string, score double, __t string, predicted int")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (1, 1)], "doc_id long, quality int")
    model = classifier.train(wide, marks)
    found = classifier.score_documents(wide, model, keep=("score", "__t", "predicted", "text"))
    out = [r.asDict() for r in found.collect()]
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["__k_score"] for r in out} == {0.5} and {r["__k_predicted"] for r in out} == {2}
    scores = {}
    for r in out:
        scores.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(scores[1]) == 1 and scores[None] == scores[1]
    assert len(scores[61] | scores[62] | scores[63]) == 1
    assert scores[64].pop() > 0.3 and np.mean([s for i in range(60) for s in scores[i] if i % 2]) > np.mean([s for i in range(60) for s in scores[i] if not i % 2])
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]


def test_greatest_id_is_no_null(spark):
    words = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(LAST, words), (None, words + " more"), (None, "other")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect()), key=repr) == sorted([(LAST, 36, LAST), (None, 37, LAST), (None, 1, None)], key=repr)


def test_repeated_rows_and_clashes(spark):
    line = "This line is long enough to be judged."
    rows = [(1, f"{line}\nfirst"), (1, f"{line}\nfirst"), (2, line), (None, line), (3, None)]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, key string, pos int, `a.b` string")
    left = linededup.remove_lines(docs, short=True)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["a.b"]) for r in left.collect()), key=repr) == sorted([(1, f"{line}\nfirst", "y")] * 2 + [(3, None, "y")], key=repr)
    assert substring.remove_repeats(docs, with_text=True).where(F.col("doc_id") == 3).first()["kept_text"] == ""
    items = spark.createDataFrame([("i", line)], "item_id string, text string")
    found = decontam.decontaminate(docs, items, keep=("a.b", "key"))
    assert found.where("contaminated").count() == 4 and "__k_a.b" in found.columns
