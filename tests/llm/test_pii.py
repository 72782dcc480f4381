"""Personal data: the base against plain patterns, what the network adds, and long or odd texts."""

import random
import re
import time

import pytest

from loomgraph.llm import pii

#: The contract's patterns as they are written, slow on long texts.
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


@pytest.fixture(scope="module")
def model():
    return pii.train()


def test_base_equals_the_plain_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("a1@.-+ 25(é") for _ in range(rng.randrange(40)))
        plain = [(m.start(), m.end(), k) for k, p in PLAIN.items() for m in p.finditer(text) if pii.valid(k, m[0])]
        assert sorted(plain, key=pii.rank) == pii.base_spans(text), text


@pytest.mark.parametrize("text", ["a" * 10**6, "1" * 10**6, "1." * 300_000, "a@" * 300_000, "+1" + "(" * 10**6, "a" * 10**6 + "@", "0" * 10**5 + "1.2.3.4"])
def test_long_runs_take_linear_time(text):
    begun = time.process_time()
    found = pii.base_spans(text)
    assert time.process_time() - begun < 5
    assert ("ip" in {k for _, _, k in found}) == text.startswith(("1.", "0"))


def test_octets_of_any_length():
    assert pii.valid("ip", "0255.00000.1.2") and not pii.valid("ip", "256.1.1.1") and not pii.valid("ip", "1.1.1." + "9" * 5000)


def test_network_adds_what_the_patterns_miss(spark, model):
    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'hethe onre token = "{token}" thndtion. End', "reda les 9807915762804490 esnd la ou", "plain words 12 of 2024-01-02 and 3.5% here", 'name = "word" is 42', f'x token = "{token}" mail a.b@c.de and']
    rows = [*enumerate(texts), (None, texts[0]), (0, texts[0]), (9, None)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, spans string, n_secret int")
    found = [r.asDict() for r in pii.find_personal_data(docs, model).collect()]
    by = {r["doc_id"]: r for r in found}
    assert len(found) == 8 and len({r["spans"] for r in found if r["doc_id"] in (0, None)}) == 1
    assert by[0]["spans"] == "secret:20:60" and (by[0]["n_secret"], by[0]["n_spans"], by[0]["n_email"]) == (1, 1, 0)
    assert by[1]["spans"] == "account:9:25" and (by[1]["n_account"], by[1]["n_card"]) == (1, 0)
    assert by[2]["spans"] == by[3]["spans"] == by[9]["spans"] == ""
    assert by[4]["n_spans"] == 2 and by[4]["n_email"] == 1 and "secret:" in by[4]["spans"]
    assert pii.find_personal_data(docs.limit(0), model).count() == 0


def test_every_trigger_is_inside_a_window():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice("  wor7@") if rng.random() < 0.05 else "x" for _ in range(rng.randrange(900)))
        held = set()
        for s in pii.windows(text):
            held.update(range(s, s + pii.WINDOW))
        for m in pii.TRIGGER.finditer(text):
            assert set(range(max(0, m.start() - pii.MARGIN), min(len(text), m.end() + pii.MARGIN))) <= held
