"""Each operator against a brute-force version on small tables with nulls, ties, long and repeated texts."""

import binascii
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import classifier, decontam, jaccard, linededup, mixing, pii, rules, substring, tokencount, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, doc string, __kept int"


def sentence(rng, n, vocabulary=60):
    return " ".join(f"w{rng.integers(0, vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = [sentence(rng, 80, 400) for _ in range(12)]
    texts = [None, "", "  \n\t", "one", "one", "ONE two three", "x" * 20_000, base[0], base[0], "\n".join(base[:3])]
    for k, t in enumerate(base):
        words = t.split()
        words[k % 70] = "changed"
        texts += [t, " ".join(words), "Intro line of this very document %d\n%s" % (k, t), sentence(rng, 30) + " " + " ".join(words[10:45])]
    texts += [" ".join(["again"] * 60), "line that repeats often enough\nline that repeats often enough\nline that repeats often enough!"]
    out = [(k, t, ["en", None][k % 2], ["a", "b", None][k % 3], "clash", 1) for k, t in enumerate(texts)]
    return [*out, (None, base[1], None, None, None, None), (3, "one", "en", "a", "clash", 1), (7, base[0], "en", "a", "clash", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def collect(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def key(i):
    return float("inf") if i is None else i


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert substring.remove_repeats(none).count() == 0
    assert jaccard.near_duplicates(none).count() == 0
    assert decontam.decontaminate(none, benchmark).count() == 0
    assert rules.judge(none).count() == 0
    assert classifier.score_documents(none, classifier.train(none, labels)).count() == 0
    assert linededup.line_verdicts(none).count() == 0
    assert linededup.remove_lines(none).count() == 0
    assert tokencount.count_tokens(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_substring(docs, rows):
    first = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            first[k] = min(first.get(k, (float("inf"), 0)), (key(i), j))
    expected = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = {p for j in range(len(w) - 19) if first[tuple(w[j : j + 20])] < (key(i), j) for p in range(j, j + 20)}
        expected.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    assert collect(substring.remove_repeats(docs)) == sorted(expected, key=repr)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.net/x", "http://a.EXAMPLE.net/en/1?q", "http://example.com/de/", "http://net", "http://xnet/", "https://q.org/fr/#t", "http://net/", "http://a.net:80/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = [tuple(r)[1:] for r in urlfilter.filter_urls(pages).orderBy("page_id").collect()]
    assert found[0] == found[1] == found[2] == ("", "", None, "allow")
    assert found[3] == ("a.net", "/x", "net/", "block")
    assert found[4][2:] == ("example.net/en/", "allow")
    assert found[5][2:] == ("example.com/de/", "block")
    assert found[6] == ("net", "", None, "allow")
    assert found[7][2:] == (None, "allow")
    assert found[8][2:] == ("org/fr/", "allow")
    assert found[9][2:] == ("net/", "block")
    assert found[10][2:] == (None, "allow")


def test_digest_collision_is_confirmed():
    keys = np.array([5, 5], np.uint64)
    import xxhash

    wanted = xxhash.xxh64_intdigest(b"a.b/")
    keys = np.array([wanted, wanted], np.uint64)
    assert urlfilter.probe([("a.b", "/")], keys, [["other", "/", "block"], ["a.b", "/", "allow"]], (1,)) == [("a.b/", "allow")]


def test_near_duplicates(docs, rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and jaccard.linked(n, len(sets[a]), len(sets[b])):
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(least.get(find(k), float("inf")), key(r[0]))
    back = lambda x: None if x == float("inf") else int(x)
    expected = [(r[0], len(sets[k]), back(least[find(k)])) for k, r in enumerate(rows)]
    assert collect(jaccard.near_duplicates(docs)) == sorted(expected, key=repr)


@pytest.mark.parametrize("tight", [False, True])
def test_large_candidate_groups(spark, monkeypatch, tight):
    if tight:  # several rounds, few leaders, groups in several rows and chunks
        for name, value in (("SMALL", 2), ("FEW", 2), ("LEADERS", 1 / 512), ("MEMBERS", 12), ("PACKED", 10)):
            monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(1)
    base = sentence(rng, 60, 5000).split()
    texts = []
    for _ in range(150):
        own = list(base)
        for p in rng.choice(60, rng.integers(0, 6), replace=False):
            own[p] = f"new{rng.integers(0, 10**6)}"
        texts.append(" ".join(own))
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[j : j + 5]) for j in range(56)} for t in texts]
    root = list(range(150))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(150):
        for b in range(a):
            if jaccard.linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert found == {k: find(k) for k in range(150)}


@pytest.mark.parametrize("together", [0, 10**6])
def test_components(spark, monkeypatch, together):
    """Chains, stars, rings and repeated links end at their least node, in few jobs where one task can hold the links."""
    monkeypatch.setattr(jaccard, "TOGETHER", together)
    rng = np.random.default_rng(5)
    names = rng.choice(10**12, 600, replace=False) - 5 * 10**11
    links = [(k, k + 1) for k in range(80)] + [(199, k) for k in range(100, 199)] + [(200 + k, 200 + (k + 1) % 40) for k in range(40)] + [(300, 301), (301, 300), (300, 300)]
    links += [tuple(x) for x in rng.integers(310, 600, (200, 2)).tolist()]
    links = [tuple(int(names[x]) for x in links[k]) for k in rng.permutation(len(links))]
    root = {x: x for link in links for x in link}
    for _ in root:
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    found = jaccard.components(spark.createDataFrame(links, "u long, v long").repartition(5))
    jobs = len(set(tracker.getJobIdsForGroup(None)) - before)
    assert {r["u"]: r["v"] for r in found.df.collect()} == {x: r for x, r in root.items() if x != r}
    assert found.df.count() == sum(x != r for x, r in root.items())
    assert not together or jobs <= 6


def test_decontamination(spark, docs, rows):
    items = [(1, " ".join(rows[10][1].split()[5:40])), (2, "One"), (3, None), (4, ""), (10, rows[10][1])]
    found = {(r["doc_id"], r["n_words"]): r for r in decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), spans=True).collect()}
    windows = {}
    for i, t in items:
        w = decontam.normal_words((t or "").encode())
        for j in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[j : j + 13]), set()).add(str(i))
    for i, t, *_ in rows:
        w = decontam.normal_words((t or "").encode())
        hit, own = set(), set()
        for x, ids in windows.items():
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit |= set(range(j, j + len(x)))
                    own |= ids
        r = found[i, len(w)]
        assert (r["n_hit"], r["n_items"], r["items_sha256"]) == (len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest())
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
        assert bool(r["spans"]) == bool(hit)


def test_decontamination_in_several_passes(spark, docs, rows):
    items = spark.createDataFrame([(1, " ".join(rows[10][1].split()[5:40])), (2, "One"), (3, None), (None, rows[13][1]), (10, rows[10][1])], "item_id long, text string")
    wide = docs.withColumn("a.b", F.lit(1))
    one = decontam.decontaminate(wide, items, keep=("a.b", "text"), spans=True)
    several = decontam.decontaminate(wide, items, keep=("a.b", "text"), spans=True, automaton_bytes=2_000)
    assert one.columns == several.columns and collect(one) == collect(several)
    assert sum(r["n_hit"] > 0 for r in one.collect()) > 5


def test_decontamination_by_items_without_id(spark):
    docs = spark.createDataFrame([(1, "a one two b"), (2, "one two three"), (3, "c d")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, "one two"), (None, "two three"), (7, "two three")], "item_id long, text string")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = collect(decontam.decontaminate(docs, benchmark), "doc_id", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == [(1, 2, 1, digest(""), True), (2, 3, 2, digest("7"), True), (3, 0, 0, digest(""), False)]


def test_quality_statistics(docs, rows):
    expected = []
    for i, t, *_ in rows:
        t = t or ""
        w = t.encode().split()
        three = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        n = Counter(three)
        again = {p for j, x in enumerate(three) if n[x] > 1 for p in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        expected.append((i, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)))
    found = rules.judge(docs)
    assert collect(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(expected, key=repr)
    assert found.where("base_failed and kept").count() == 0


def test_outliers_are_rejected(spark):
    rng = np.random.default_rng(0)
    texts = [sentence(rng, 200, 5000) for _ in range(120)] + [re.sub(" ", "### ", sentence(rng, 200, 5000)) for _ in range(6)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(docs).collect()}
    assert not any(kept[k] for k in range(120, 126)) and sum(kept[k] for k in range(120)) >= 118


def test_repetition_alone_is_rejected(spark):
    rng = np.random.default_rng(2)
    plain = lambda n: "\n".join(sentence(rng, 10, 5000) for _ in range(n))
    texts = [plain(40) for _ in range(120)]
    for _ in range(4):
        own = plain(34).split("\n")
        texts.append("\n".join(own[:28] + own[28:] * 2))
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    assert not any(found[k]["base_failed"] or found[k]["kept"] for k in range(120, 124))
    assert sum(found[k]["kept"] for k in range(120)) >= 118


def test_small_groups_are_judged(spark):
    rng = np.random.default_rng(4)
    texts = [sentence(rng, 200, 5000) for _ in range(60)] + [re.sub(" ", "### ", sentence(rng, 200, 5000)) for _ in range(4)]
    rows = [(k, t, ["en", "de"][k % 8 == 0], f"s{k % 16}") for k, t in enumerate(texts)]
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(kept[k] for k in range(60, 64)) and sum(kept[k] for k in range(60)) >= 58


def test_classifier_learns(spark):
    rng = np.random.default_rng(0)
    good, bad = [sentence(rng, 50, 900) for _ in range(150)], [sentence(rng, 50, 900).replace(" ", "%% ") for _ in range(150)]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(good + bad)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(300)] + [(None, 1), (1, None)], "doc_id long, quality int")
    found = classifier.score_documents(docs, classifier.train(docs, labels)).where("held_out").toPandas()
    assert ((found.predicted == 1) == (found.doc_id < 150)).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_classifier_learns_beside_a_repeated_id(spark):
    ids = [k for k in range(30) if binascii.crc32(str(k).encode()) % 5][:10]
    text = lambda k: f"good text {k}" if k % 2 else f"%% bad %% {k}"
    docs = spark.createDataFrame([(k, text(k)) for k in ids] + [(ids[0], text(ids[0]))] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, quality int")
    assert np.abs(classifier.train(docs, labels, 20).fold).max() > 0


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def test_line_dedup(docs, rows):
    order = {k: r for k, r in enumerate(rows)}
    lines = [(key(r[0]), j, x) for r in rows for j, x in enumerate(r[1].split("\n") if r[1] is not None else []) if len(x) >= 20 and x.split()]
    expected = []
    for r in order.values():
        own = r[1].split("\n") if r[1] is not None else []
        gone = [j for j, x in enumerate(own) if len(x) >= 20 and x.split() and any((i, p) < (key(r[0]), j) and within_one(x, y) for i, p, y in lines)]
        expected.append((r[0], len(own), len(gone), ",".join(map(str, gone))))
    assert collect(linededup.line_verdicts(docs)) == sorted(expected, key=repr)
    kept = linededup.remove_lines(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 0 and text is null").count() == 1


def test_short_lines(spark):
    rows = [(1, "Les.\nOne.\n \nLes."), (2, "Les.\n\nOnes.\nOne"), (2, "Les.\n\nOnes.\nOne"), (3, "One.\n \n" + "x" * 19), (4, "x" * 20 + "\n" + "x" * 19), (5, None), (6, "Les.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collect(linededup.line_verdicts(docs, short=True), "doc_id", "removed") == [(1, "3"), (2, "0"), (2, "0"), (3, "0"), (4, "1"), (5, ""), (6, "0")]
    left = dict(collect(linededup.remove_lines(docs, short=True)))
    assert left == {1: "Les.\nOne.\n ", 2: "\nOnes.\nOne", 3: " \n" + "x" * 19, 4: "x" * 20, 5: None}


def test_short_lines_in_query(spark, tmp_path):
    from loomgraph.llm.queries import op8_line_dedup

    spark.createDataFrame([(1, "Les."), (2, "Les.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert collect(op8_line_dedup(spark, str(tmp_path)), "doc_id", "removed") == [(1, ""), (2, "0")]


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance(spark, tau):
    rng = np.random.default_rng(tau)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice(list("abé"), rng.integers(1, 10)))
        b = list(a)
        for _ in range(rng.integers(0, 4)):
            p = int(rng.integers(0, len(b) + 1))
            b[p : p + int(rng.integers(0, 2))] = rng.choice(list("abé"), rng.integers(0, 2)).tolist()
        if b:
            pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.split("a", "").alias("x"), F.split("b", "").alias("y"))
    found = linededup.with_ordered(df, "x", "y").select(linededup.within("long", "short", tau).alias("w"), (F.levenshtein("a", "b") <= tau).alias("l")).collect()
    assert all(r["w"] == r["l"] for r in found)


def test_token_counts(spark, docs, rows):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    scores = tokencount.read_vocabulary()
    exact = Tokenizer(Unigram(list(scores.items()), None, False))
    find = tokencount.regex.compile(tokencount.PRE_TOKEN).findall
    expected = []
    for i, t, *_ in rows:
        own = find(t or "")
        assert "".join(own) == (t or "")
        expected.append((i, len(own), sum(len(exact.encode(x.encode().decode("latin-1")).ids) for x in own)))
    assert collect(tokencount.count_tokens(docs)) == sorted(expected, key=repr)


def test_mixing(docs):
    found = mixing.mix_sources(docs).toPandas()
    assert (found.taken <= 2 * found["size"]).all()
    for _, own in found.groupby("source", dropna=False):
        assert abs(own.taken.sum() - own.target.iloc[0]) < 1
        assert own["size"].sum() == own.source_size.iloc[0]
    assert collect(mixing.mix_sources(docs)) == collect(mixing.mix_sources(docs.repartition(2)))


def test_personal_data(spark):
    model = pii.train()
    texts = ["mail a.b@c.de now", "ip 1.2.3.4 and 1.2.3.400", "card 4111 1111 1111 1111.", "+1 (743) 555-3824 x", None, "", "nothing here", "x" * 5000 + " 4111111111111111 " + "y" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs, model).collect()}
    assert [found[k][c] for k, c in ((0, "n_email"), (1, "n_ip"), (2, "n_card"), (3, "n_phone"), (7, "n_card"))] == [1] * 5
    assert found[0]["spans"] == "email:5:13" and found[0]["base_sha256"] == hashlib.sha256(b"email:5:13").hexdigest()
    assert found[7]["spans"] == "card:5001:5017"
    assert all(found[k]["spans"] == "" for k in (4, 5, 6))


def test_network_finds_held_out_spans():
    model = pii.train()
    ids, tags = pii.labelled(np.random.default_rng(77), 150)
    score = pii.emissions(model, ids)
    guess = pii.viterbi(score, model["trans"])
    spans = lambda t, r: {s[:3] for s in pii.window_spans(t[r], score[r], 0, pii.WINDOW, pii.WINDOW)}
    both = [(spans(tags, r), spans(guess, r)) for r in range(150)]
    right = sum(len(a & b) for a, b in both)
    assert right / sum(len(a) for a, _ in both) > 0.6 and right / max(1, sum(len(b) for _, b in both)) > 0.7


def test_reconcile_prefers_the_greatest_total():
    assert pii.reconcile([(0, 10, "card", 3.0), (0, 4, "ip", 2.0), (5, 10, "ip", 2.0), (20, 25, "email", 1.0)]) == [(0, 4, "ip"), (5, 10, "ip"), (20, 25, "email")]


def test_candidate_tests_turn_down_no_linked_pair():
    rng = np.random.default_rng(5)
    seen = 0
    for _ in range(3000):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 80)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.7, 1)], rng.integers(0, 1 << 62, rng.integers(0, 12)).astype(np.uint64)]))
        both = np.intersect1d(a, b)
        if not jaccard.linked(len(both), len(a), len(b)) or not len(b):
            continue
        seen += 1
        n, place = np.array([len(a), len(b)], np.int32), np.array([np.searchsorted(a, both[0]), np.searchsorted(b, both[0])], np.int32)
        assert max(place[0] - jaccard.prefix_length(len(a)), place[1] - jaccard.prefix_length(len(b))) < 0
        sig = np.stack([np.frombuffer(jaccard.signature(x), np.uint64) for x in (a, b)])
        found, complete = jaccard.propose(np.array([1, 2]), n, place, np.array([1, 2]), jaccard.FEW, jaccard.LEADERS, sig)
        assert complete and [0, 1] in found.tolist()
    assert seen > 500
