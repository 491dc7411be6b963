"""What a task holds beside its batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from chatterloom.llm import kernels as K
from chatterloom.llm import quality as Q


def texts(count, words):
    made = np.random.default_rng(1).integers(0, 5000, (count, words)).astype(str)
    return pa.RecordBatch.from_arrays([pa.array(range(count)), pa.array([" ".join(w) for w in made])], names=["id", "text"])


def peak(run):
    run()  # tables that a worker keeps
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_features_take_memory_by_the_piece():
    batch = texts(4000, 300)

    def run(**limit):
        for part in K.pieces(batch, "text", **limit):
            Q.features(*K.utf8(part.column("text")))

    assert peak(run) < 48_000_000 < peak(lambda: run(limit=2 << 20))


def test_texts_become_strings_by_the_piece():
    batch = texts(4000, 300)
    assert list(K.keyed_texts(batch)) == list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    assert peak(lambda: sum(len(t) for _, t in K.keyed_texts(batch))) < 2_000_000 < batch.nbytes // 2
