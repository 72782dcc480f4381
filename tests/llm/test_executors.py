"""What runs on executors needs no copy of the repository there."""

import subprocess
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from loomgraph.llm import classifier, common, decontam, jaccard, pii, substring

RUN = """
import pickle, sys
assert not any("repo" in p for p in sys.path), sys.path
for task in pickle.load(open(sys.argv[1], "rb")):
    print(task())
assert "loomgraph" not in sys.modules
"""


def test_tasks_run_without_the_repository(tmp_path):
    text = " ".join(f"w{k % 37}" for k in range(200)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([5, 6]), pa.array([text, text])], ["doc_id", "key", "t"])
    pair = batch.select(["doc_id", "t"])
    order = jaccard.Order(np.ones(1 << 14, np.uint8), 14, np.full(1 << 11, 255, np.uint8), 14)
    sketch = [np.full(1 << 13, 255, np.uint8)] * 2
    tasks = [
        lambda: sum(b.num_rows for b in substring.sketch_rows([batch], 16)),
        lambda: sum(b.num_rows for b in substring.suspect_rows([batch], sketch, 16, 4)),
        lambda: sum(b.num_rows for b in jaccard.first_pass([pair], 14, 14)),
        lambda: sum(b.num_rows for b in jaccard.prefix_rows([pair], order, 4)),
        lambda: len(common.ngram_hashes(common.word_hashes(text.split()), 5)),
        lambda: len(pii.accept("at a.b@c.de", pii.base_spans("at a.b@c.de"), [])),
        lambda: int(classifier.Model(np.ones(classifier.BUCKETS), 0.0).score(text, {}) > 0.7),
        lambda: len(decontam.item_windows(decontam.normal_words(text))),
        lambda: jaccard.trie_of([1], {1: np.arange(4, dtype=np.uint64)}, {1: 4}).links(np.arange(4, dtype=np.uint64), 4).sum(),
    ]
    # the test module itself would not be there either
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    (tmp_path / "tasks").write_bytes(cloudpickle.dumps(tasks))
    done = subprocess.run([sys.executable, "-I", "-c", RUN, str(tmp_path / "tasks")], cwd="/", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert [int(x) for x in done.stdout.split()] == [t() for t in tasks]


def test_packed_cells_come_back():
    rng = np.random.default_rng(1)
    for n in (1, 5, 5000):
        x = np.sort(rng.integers(0, 1 << 32, n, dtype=np.uint32))
        assert (common.unpacked(common.packed(x)) == x).all()
    cells = rng.integers(0, 1 << 14, 9000)
    blocks = dict(common.cell_blocks(cells, 14, 32))
    found = np.concatenate([np.unpackbits(common.merged_bits(512)([common.unpacked(blocks[k])])) for k in range(32)])
    assert (found == (np.bincount(cells, minlength=1 << 14) > 1)).all()
