"""Personal data: exact base patterns, and a character BiLSTM with CRF transitions for what they miss.

The network is trained in numpy, on the driver, from labelled spans that a seeded generator writes
into invented text (addresses in several spellings, long account numbers, assigned secrets, and
look-alikes that are none). Every kind has a digit, an `@` or a bracketed `at` in it, so the network reads
the overlapping windows within MARGIN characters of such ones in a whole text; nowhere else can a span
stand. Windows are decoded by Viterbi search, spans cut by a window's edge give way to the neighbour that
holds them whole, and of all spans of a text the set of greatest total score without overlaps is kept.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small

#: Kinds of the base patterns, in the order of lists.
KINDS = ("email", "ip", "card", "phone")
#: Kinds that the network tells. A long number that it finds is a card if its digits pass Luhn's test, else an account.
LEARNT = (*KINDS, "secret")
LISTED = (*KINDS, "account", "secret")
#: Characters before an address's sign and patterns of the base, taken apart so that each text is read once.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I)
WINDOW, STRIDE, MARGIN = 128, 64, 48
#: Hidden units of each direction, training windows, epochs, batch, step and seed.
HIDDEN, TRAIN, EPOCHS, BATCH, RATE, SEED = 16, 640, 12, 24, 0.02, 5
TAGS = 1 + 2 * len(LEARNT)
#: Character classes: one digit class, letters by what spans are made of, separators one by one.
SEPARATORS = "@.-_+()[] \n:/,=\"'"
CLASSES = len(SEPARATORS) + 6
#: Windows decoded at once.
DECODE = 512


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and int(digits) <= 255)


def valid(kind: str, text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(octet(x) for x in re.findall("[0-9]+", text))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each `@`."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > end and text[first - 1] in LOCAL:
            first -= 1
        found = DOMAIN.match(text, at + 1) if first < at else None
        if found:
            end = found.end()
            out.append((first, end))
        at = text.find("@", max(end, at + 1))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of four numbers between dots: fours of every chain of dotted numbers."""
    out = []
    for chain in DOTTED.finditer(text):
        if text.count(".", chain.start(), chain.end()) >= 3:
            parts = [m.span() for m in re.compile("[0-9]+").finditer(text, chain.start(), chain.end())]
            out += [(parts[k][0], parts[k + 3][1]) for k in range(0, len(parts) - 3, 4)]
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind): leftmost non-overlapping matches of each kind, failing ones dropped; linear in the text."""
    if not TRIGGER.search(text):
        return []
    places = {"email": emails(text), "ip": addresses(text), "card": [m.span() for m in CARD.finditer(text)], "phone": [m.span() for m in PHONE.finditer(text)]}
    return sorted(((a, b, kind) for kind, found in places.items() for a, b in found if valid(kind, text[a:b])), key=rank)


def rank(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], LISTED.index(span[2]), span[1]


# --- the network ------------------------------------------------------------------------------------


def classes(text: str) -> np.ndarray:
    """A character class for each code point."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.full(len(code), CLASSES - 1, np.int64)
    out[(code >= 48) & (code <= 57)] = 0
    out[(code >= 97) & (code <= 122)] = 1
    out[(code >= 65) & (code <= 90)] = 2
    out[code >= 128] = 3
    out[(code < 32) | (code == 127)] = 4
    for k, c in enumerate(SEPARATORS):
        out[code == ord(c)] = 5 + k
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """One LSTM over classes (batch, time); gates in the order input, forget, output, candidate."""

    @staticmethod
    def start(rng) -> dict[str, np.ndarray]:
        b = np.zeros(4 * HIDDEN, np.float32)
        b[HIDDEN : 2 * HIDDEN] = 1
        return {"x": rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN)).astype(np.float32), "h": rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32), "b": b}

    @staticmethod
    def forward(p, ids: np.ndarray, keep: bool = False):
        n, steps = ids.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, saved = np.empty((n, steps, HIDDEN), np.float32), []
        given = p["x"] + p["b"]
        for t in range(steps):
            z = given[ids[:, t]] + h @ p["h"]
            gate, cand = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            before, c = (h, c), f * c + i * cand
            th = np.tanh(c)
            h = o * th
            out[:, t] = h
            if keep:
                saved.append((before, i, f, o, cand, th))
        return out, saved

    @staticmethod
    def backward(p, ids, saved, grad_out) -> dict[str, np.ndarray]:
        n, steps = ids.shape
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            (h0, c0), i, f, o, cand, th = saved[t]
            dh = dh + grad_out[:, t]
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate([dc * cand * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - cand * cand)], 1)
            grad["h"] += h0.T @ dz
            grad["b"] += dz.sum(0)
            np.add.at(grad["x"], ids[:, t], dz)
            dh, dc = dz @ p["h"].T, dc * f
        return grad


def emissions(model, ids: np.ndarray) -> np.ndarray:
    ahead, _ = Direction.forward(model["ahead"], ids)
    back, _ = Direction.forward(model["back"], ids[:, ::-1])
    return np.concatenate([ahead, back[:, ::-1]], 2) @ model["out"] + model["bias"]


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def crf_gradient(score: np.ndarray, trans: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log likelihood of the tags by emissions and transitions."""
    n, steps, k = score.shape
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[:, 0] = score[:, 0]
    for t in range(1, steps):
        alpha[:, t] = logsumexp(alpha[:, t - 1, :, None] + trans, 1) + score[:, t]
    for t in range(steps - 2, -1, -1):
        beta[:, t] = logsumexp(trans + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    whole = logsumexp(alpha[:, -1], 1)
    each = np.exp(alpha + beta - whole[:, None, None])
    each[np.arange(n)[:, None], np.arange(steps), tags] -= 1
    between = np.zeros_like(trans)
    for t in range(1, steps):
        between += np.exp(alpha[:, t - 1, :, None] + trans + (score[:, t] + beta[:, t])[:, None, :] - whole[:, None, None]).sum(0)
    np.add.at(between, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
    return each, between


def viterbi(score: np.ndarray, trans: np.ndarray) -> np.ndarray:
    n, steps, k = score.shape
    best, back = score[:, 0], np.empty((n, steps, k), np.int8)
    for t in range(1, steps):
        every = best[:, :, None] + trans
        back[:, t] = every.argmax(1)
        best = every.max(1) + score[:, t]
    out = np.empty((n, steps), np.int64)
    out[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = back[np.arange(n), t, out[:, t]]
    return out


# --- labelled spans ------------------------------------------------------------------------------------


def card_number(rng) -> str:
    digits = "4" + "".join(str(x) for x in rng.integers(0, 10, 14))
    return digits + next(str(c) for c in range(10) if luhn(digits + str(c)))


def example(rng) -> tuple[str, str, str | None]:
    """What stands before it, an address or the like with its kind, or a look-alike with None."""
    d = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    mixed = lambda letters, n: "".join(rng.choice(list(letters), n))
    word = lambda: mixed("abcdehilmnoprstu", rng.integers(2, 8))
    pick = int(rng.integers(0, 24))
    if pick <= 2:
        at, dot = [("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(AT)", "."), ("[ at ]", ".")][int(rng.integers(0, 5))]
        return "", f"{word()}{rng.choice(['.', '', '_'])}{d(2) if pick else word()}{at}{word()}{d(1) if pick else ''}{dot}{rng.choice(['com', 'org', 'de', 'example' + dot + 'com'])}", "email"
    if pick <= 4:
        return "", rng.choice([".", ".", "[.]"]).join(str(x) for x in rng.integers(0, 256, 4)), "ip"
    if pick <= 8:
        n = card_number(rng) if rng.random() < 0.5 else d(16)
        return "", str(rng.choice(["", "", " ", "-", "."])).join([n[:4], n[4:8], n[8:12], n[12:]]), "card"
    if pick <= 12:
        a, b, c = d(3), d(3), d(4)
        return "", str(rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {a} {b}{c}", f"{a}.{b}.{c}", f"00{d(2)} {a} {b} {c}"])), "phone"
    if pick <= 16:
        letters = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"][int(rng.integers(0, 3))]
        name = [word(), "token", "key", "secret", word() + "_key"][int(rng.integers(0, 5))]
        name = name.upper() if rng.random() < 0.2 else name
        return name + str(rng.choice([' = "', ' = "', '="', ": ", "=", " = '", ": '"])), mixed(letters, rng.integers(20, 49)), "secret"
    if pick == 17:  # named, but no secret
        return f"{word()} = ", str(rng.choice([word(), d(3), '"' + word() + '"', word() + " " + word(), f"{d(1)}.{d(2)}"])), None
    return "", str(rng.choice([d(int(rng.integers(1, 5))), f"20{d(2)}-0{1 + rng.integers(0, 9)}-{d(2)}", f"{d(1)}.{d(1)}", f"{d(2)}:{d(2)}", f"#{d(6)}", f"{d(2)}%", f"{word()}{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"@{word()}", f"{word()}-{d(3)}-{word()}", f"{d(1)},{d(3)},{d(3)}"])), None


def labelled(rng, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags (0 outside, 1 + 2 k begin, 2 + 2 k inside) of n windows of invented text."""
    ids, tags = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    letters = list("etaoinshrdluéäñcm")
    for row in range(n):
        text, marks = "", []
        while len(text) < WINDOW + 40:
            if rng.random() < 0.3:
                before, own, kind = example(rng)
                text += before
                if kind:
                    marks.append((len(text), len(text) + len(own), LEARNT.index(kind)))
                text += own + before[-1:] * (before[-1:] in ('"', "'"))
            else:
                own = "".join(rng.choice(letters, rng.integers(1, 10)))
                text += own.capitalize() if rng.random() < 0.15 else own
            text += str(rng.choice([" ", " ", " ", " ", ". ", ", ", "\n", "### ", "!! ", " | "]))
        cut = int(rng.integers(0, 40))
        ids[row] = classes(text)[cut : cut + WINDOW]
        own = np.zeros(len(text), np.int64)
        for a, b, k in marks:
            own[a:b] = 2 + 2 * k
            own[a] = 1 + 2 * k
        tags[row] = own[cut : cut + WINDOW]
    return ids, tags


def train(n: int = TRAIN, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Fit by stochastic gradient descent with Adam steps; the same weights each time."""
    rng = np.random.default_rng(seed)
    ids, tags = labelled(rng, n)
    model = {"ahead": Direction.start(rng), "back": Direction.start(rng), "out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)).astype(np.float32), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    flat = [model["ahead"][k] for k in "xhb"] + [model["back"][k] for k in "xhb"] + [model["out"], model["bias"], model["trans"]]
    first, second, step = [np.zeros_like(x) for x in flat], [np.zeros_like(x) for x in flat], 0
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            x, y = ids[at], tags[at]
            ahead, s1 = Direction.forward(model["ahead"], x, True)
            back, s2 = Direction.forward(model["back"], x[:, ::-1], True)
            both = np.concatenate([ahead, back[:, ::-1]], 2)
            each, between = crf_gradient(both @ model["out"] + model["bias"], model["trans"], y)
            each = (each / len(at)).astype(np.float32)
            into = each @ model["out"].T
            g1 = Direction.backward(model["ahead"], x, s1, into[:, :, :HIDDEN])
            g2 = Direction.backward(model["back"], x[:, ::-1], s2, into[:, ::-1, HIDDEN:])
            grads = [g1[k] for k in "xhb"] + [g2[k] for k in "xhb"] + [np.tensordot(both, each, ((0, 1), (0, 1))), each.sum((0, 1)), (between / len(at)).astype(np.float32)]
            step += 1
            rate = RATE * (1 - epoch / epochs) / (1 + 0.1 * epoch)
            for p, g, m, v in zip(flat, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    for k in range(len(LEARNT)):  # no inside without its begin
        for tag in range(TAGS):
            if tag not in (1 + 2 * k, 2 + 2 * k):
                model["trans"][tag, 2 + 2 * k] = -30
    return model


#: The default model, once it is made in a driver's life.
MADE: dict[str, dict] = {}


def default_model() -> dict:
    if "model" not in MADE:
        MADE["model"] = train()
    return MADE["model"]


# --- decoding ---------------------------------------------------------------------------------------------


def windows(text: str) -> list[int]:
    """Starts of overlapping windows over every stretch within MARGIN of a trigger character."""
    out, first, last = [], 0, -1
    for m in TRIGGER.finditer(text):
        if m.start() - MARGIN > last:
            out += covering(first, last)
            first = max(0, m.start() - MARGIN)
        last = min(len(text), m.end() + MARGIN)
    return out + covering(first, last)


def covering(first: int, last: int) -> list[int]:
    """Starts, STRIDE apart, of the windows that cover a stretch."""
    return list(range(first, max(first, last - WINDOW) + STRIDE, STRIDE)) if last > first else []


def window_spans(tags: np.ndarray, score: np.ndarray, start: int, size: int, length: int) -> list[tuple[int, int, str, float]]:
    """Spans of a decoded window in text offsets, without those that its edges cut."""
    out, t = [], 0
    while t < size:
        if tags[t] % 2 == 1:
            z, inside = t + 1, tags[t] + 1
            while z < size and tags[z] == inside:
                z += 1
            whole = (t > 0 or start == 0) and (z < size or start + size >= length)
            if whole:
                gain = float((score[np.arange(t, z), tags[t:z]] - score[t:z, 0]).sum())
                out.append((start + t, start + z, LEARNT[(tags[t] - 1) // 2], gain))
            t = z
        else:
            t += 1
    return out


def reconcile(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """Of all windows' spans the non-overlapping set of greatest total score (weighted interval scheduling)."""
    best: dict[tuple[int, int, str], float] = {}
    for a, b, k, s in spans:
        best[a, b, k] = max(s, best.get((a, b, k), s))
    found = sorted(((a, b, k, s) for (a, b, k), s in best.items() if s > 0), key=lambda x: (x[1], x[0], x[2]))
    ends, total, take = [x[1] for x in found], [0.0], []
    for i, (a, _, _, s) in enumerate(found):
        j = bisect_right(ends, a, 0, i)
        take.append(total[j] + s > total[-1])
        total.append(max(total[-1], total[j] + s))
    out, i = [], len(found)
    while i:
        if take[i - 1]:
            out.append(found[i - 1][:3])
            i = bisect_right(ends, found[i - 1][0], 0, i - 1)
        else:
            i -= 1
    return out[::-1]


#: What an added span must look like: the network finds it, this confirms it.
ADDED = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+\s?(@|[(\[]\s?at\s?[)\]])\s?[A-Za-z0-9-]+(\s?(\.|[(\[]dot[)\]])\s?[A-Za-z0-9-]+)+", re.I),
    "ip": re.compile(r"[0-9]{1,3}((\.|\[\.\])[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]{4}([ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,7}"),
    "phone": re.compile(r"(\+[0-9]{1,3} ?|00[0-9]{1,3} )?(\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}([ .-]?[0-9]{2,7})+"),
    "secret": re.compile(r"(?=.*[A-Za-z])(?=(.*[0-9]){2})[A-Za-z0-9+/_-]{16,}"),
}


def accept(text: str, base: list[tuple[int, int, str]], found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Confirmed spans of the network that overlap no base span and cut no longer run of digits or letters."""
    taken = [0]  # ends of the base spans so far, in the order of their starts
    for _, y, _ in base:
        taken.append(max(taken[-1], y))
    starts, out = [x for x, _, _ in base], []
    for a, b, kind in found:
        edge = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
        if edge and taken[bisect_left(starts, b)] <= a and ADDED[kind].fullmatch(text[a:b]) and (kind == "card" or valid(kind, text[a:b])):
            out.append((a, b, "account" if kind == "card" and not valid(kind, text[a:b]) else kind))
    return out


def decode(model, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """The network's spans of each whole text."""
    todo = [(i, s) for i, t in enumerate(texts) for s in windows(t)]
    spans: list[list] = [[] for _ in texts]
    for k in range(0, len(todo), DECODE):
        some = todo[k : k + DECODE]
        ids = np.full((len(some), WINDOW), 4, np.int64)
        for row, (i, s) in enumerate(some):
            own = classes(texts[i][s : s + WINDOW])
            ids[row, : len(own)] = own
        score = emissions(model, ids)
        tags = viterbi(score, model["trans"])
        for row, (i, s) in enumerate(some):
            size = min(WINDOW, len(texts[i]) - s)
            spans[i] += window_spans(tags[row], score[row], s, size, len(texts[i]))
    return [reconcile(x) for x in spans]


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=rank))


def find_personal_data(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_account, n_secret, n_spans.

    The first four counts and base_sha256 are of the base patterns; spans lists those and what the
    network adds: further spellings of the four kinds, long numbers that are no card (account) and secrets,
    which the last counts, of all spans, include.
    Offsets are code points, ends exclusive. Whole texts are read; a null text is an empty one and
    has no spans. Rows are judged alone, so repeated rows agree; an empty table gives no rows; a null
    doc_id stays null. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        for b in small(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            near = [i for i, t in enumerate(texts) if TRIGGER.search(t)]
            more: list[list] = [[] for _ in texts]
            for i, found in zip(near, decode(shared.value, [texts[i] for i in near]), strict=True):
                more[i] = accept(texts[i], base[i], found)
            counts = [pa.array([sum(s[2] == k for s in x) for x in base], pa.int64()) for k in KINDS]
            added = [pa.array([sum(s[2] == k for s in x) for x in more], pa.int64()) for k in LISTED[len(KINDS) :]] + [pa.array([len(x) + len(y) for x, y in zip(base, more, strict=True)], pa.int64())]
            digests = pa.array([hashlib.sha256(listed(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digests, pa.array([listed(x + y) for x, y in zip(base, more, strict=True)], pa.string()), *added], names)

    some = docs.select("doc_id", "text")
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_account", "n_secret", "n_spans"]
    return some.mapInArrow(run, f"doc_id {some.schema[0].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_account long, n_secret long, n_spans long")
