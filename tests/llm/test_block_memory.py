"""What a worker holds while it scores a block of texts, which bounds the documents a task can have at once."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest

ngram_lm = pytest.importorskip("lodestone.llm.ngram_lm")
zstandard = pytest.importorskip("zstandard")


def test_scoring_a_block_takes_little_beside_its_texts():
    dice = np.random.default_rng(3)
    texts = [dice.choice(np.frombuffer(b"kamiro ", dtype=np.uint8), n).tobytes() for n in (3_000_000, 40, 0, 2_000_000, *[900] * 1_000)]
    grams = np.unique(np.concatenate([ngram_lm._keys([b"\0" * 4 + x])[0] for x in texts if x]))
    p = dice.uniform(0.01, 1, len(grams))
    docs = pd.DataFrame({"block": [7], **{c: [[1] * len(texts)] for c in ngram_lm._OWN[:-1]}, "lang": [["en"] * len(texts)], "sizes": [[len(x) for x in texts]], "texts": [zstandard.ZstdCompressor().compress(b"".join(texts))]})
    tracemalloc.start()
    found = ngram_lm._score(None, docs, pd.DataFrame({"block": 7, "gram": grams, "p": p}))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10 * sum(map(len, texts)), f"{most / 1e6:.0f} MB for {sum(map(len, texts)) / 1e6:.0f} MB of text"
    of = dict(zip(grams.tolist(), np.log2(p)))
    want = [-sum(of[k] for k in ngram_lm._keys([b"\0" * 4 + x])[0].tolist()) for x in texts]
    assert np.allclose(found["bits"], want) and found["n_bytes"].tolist() == [len(x) for x in texts]
