"""Token counts under a unigram model, by dynamic programming along a trie.

The distinct pre-tokens of a batch are the leaves of a trie. The forward score of a node - the best
log probability of cutting its prefix into pieces, and how many pieces that takes - depends on the
prefix alone, so it is computed once however many pre-tokens go through the node. Visiting the
leaves in order walks the trie depth first with one path of scores in memory.

The vocabulary is that of a public tokenizer, given by path and never trained; piece r in rank
order has the Zipf-Mandelbrot probability 1 / (r + 3), normalised over the vocabulary.
"""

from __future__ import annotations

import base64
import math

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level tokenizers cut text before they look for pieces.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a task remembers before it starts again, and the longest remembered.
CACHE, LONGEST = 500_000, 64


def read_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Log probability of each piece, its bytes as Latin-1 characters."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f)}
    total = math.log(sum(1 / (r + 3) for r in ranks.values()))
    return {piece: -math.log(r + 3) - total for piece, r in ranks.items()}


def with_suffixes(scores: dict[str, float]) -> dict[str, float | None]:
    """Pieces and all their proper suffixes (None): where a suffix is missing no longer piece can end."""
    out: dict[str, float | None] = dict(scores)
    for piece in scores:
        for k in range(1, len(piece)):
            out.setdefault(piece[k:], None)
    return out


def count_sorted(pre_tokens: list[str], pieces: dict[str, float | None]) -> list[int]:
    """Pieces of the best cut of each pre-token; of equally good cuts the one with the fewest pieces.

    pre_tokens are distinct and sorted; the path of scores is kept up to what the next one shares.
    """
    get, best, count, out, before = pieces.get, [0.0], [0], [], ""
    for token in pre_tokens:
        shared, most = 0, min(len(before), len(token))
        if token[: len(before)] == before:
            shared = len(before)
        else:
            while shared < most and token[shared] == before[shared]:
                shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(token) + 1):
            top, n = -math.inf, 0
            for start in range(end - 1, -1, -1):
                score = get(token[start:end], False)
                if score is False:
                    break
                if score is not None:
                    score += best[start]
                    if score > top or (score == top and count[start] + 1 < n):
                        top, n = score, count[start] + 1
            best.append(top)
            count.append(n)
        out.append(count[-1])
        before = token
    return out


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of docs: doc_id, n_pretokens, n_tokens.

    Whole texts are counted; a null or empty text has neither. The vocabulary holds every byte,
    so every text has a cut. Rows are counted alone: repeated rows agree, an empty table gives no
    rows, a null doc_id stays null. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        pieces, find, known = with_suffixes(shared.value), regex.compile(PRE_TOKEN).findall, {}
        for b in small(batches):
            found = [find(t or "") for t in b.column(1).to_pylist()]
            new = {x for own in found for x in own if x not in known}
            if len(known) + len(new) > CACHE:
                known.clear()
                new = {x for own in found for x in own}
            pairs = sorted((x.encode().decode("latin-1"), x) for x in new)
            counts = dict(zip((x for _, x in pairs), count_sorted([x for x, _ in pairs], pieces), strict=True))
            known.update((x, n) for x, n in counts.items() if len(x) <= LONGEST)
            totals = [sum(known[x] if x in known else counts[x] for x in own) for own in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(totals, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    some = docs.select("doc_id", F.col("text"))
    return some.mapInArrow(run, f"doc_id {some.schema[0].dataType.simpleString()}, n_pretokens long, n_tokens long")
