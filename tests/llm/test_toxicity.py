"""The factorization machine at its production defaults."""

import numpy as np

from quillspark.llm import toxicity


def test_defaults_learn_a_marginally_neutral_partner():
    r = np.random.default_rng(0)
    n = 6000
    group, insult = r.random(n) < 0.1, r.random(n) < 0.02
    toxic = group & insult | ~group & (r.random(n) < 0.02)  # a group mention alone changes nothing
    x = np.stack([np.ones(n, bool), group, insult, *(r.random(n) < 0.1 for _ in range(50))], 1)
    row, col = np.nonzero(x)
    model = toxicity.fit({"label": toxic.astype(int), "row": row, "bucket": col.astype(np.int32), "value": np.ones(len(row))})
    score = lambda *b: model(np.zeros(len(b), int), np.array(b), np.ones(len(b)), 1)[0][0]
    assert model.slot[1] >= 0 and score(0, 1, 2) >= 0.7 and max(score(0, 1), score(0, 2), score(0)) < 0.1
