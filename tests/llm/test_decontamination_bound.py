"""Windows that cannot reach the floor are settled without their vectors, and no other window is lost by it."""

import random
from dataclasses import replace

import numpy as np
import pytest

from rundelta.llm import decontaminate


@pytest.fixture(scope="module")
def model_and_words(spark):
    rng = random.Random(5)

    def varied(n):
        return [f"w{int(6_000 * rng.random() ** 3)}" for _ in range(n)]

    items = [(i, " ".join(varied(rng.randint(4, 90))), None) for i in range(120)]
    docs = spark.createDataFrame([(i, " ".join(varied(100))) for i in range(100)], "doc_id long, text string")
    return decontaminate.prepare(docs, items), items, varied


def test_unlike_windows_need_no_vectors(model_and_words):
    model, items, varied = model_and_words
    blind = replace(model, table=None)
    words = [w.encode() for n, w in enumerate(varied(600))]
    assert blind.check([w if n % 12 == 0 else b"elsewhere" for n, w in enumerate(words)], 0.3, 0.75, 0.5) == {}


def test_bound_loses_no_window(model_and_words):
    model, items, varied = model_and_words
    words = []
    for _, text, _ in items:
        words += [*varied(40), *text.split(), *["elsewhere"] * 17]
    words = decontaminate.words_of(" ".join(words * 5))
    ids = np.array([model.terms.get(w, -1) for w in words])
    assert len(ids) > 2 * 2048 * 3 and len(model.scales) == 3
    for floor in (-1.0, 0.05, 0.3, 0.7):
        for scale in model.scales:
            wanted = {}
            starts = range(0, len(ids), scale.half)
            for at in [a for a in starts if a + scale.half < len(ids)]:
                window = ids[at : at + 2 * scale.half]
                cosine = model.table[window].astype(np.float64).sum(axis=0) @ scale.vectors / np.sqrt(model.squares[window].sum())
                for i, c in zip(scale.owners.tolist(), cosine.tolist(), strict=True):
                    wanted[i, at] = max(c, wanted.get((i, at), c))
            got = dict(model._alike(ids, scale, floor))
            assert all(abs(c - wanted[k]) < 1e-4 for k, c in got.items())
            assert {k for k, c in wanted.items() if c >= floor + 1e-4} <= got.keys()
            assert got or floor > 0.3
