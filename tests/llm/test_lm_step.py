"""A gradient step of the language model against plain loops."""

import numpy as np

from quillrank.llm import lm


def test_a_step_equals_plain_loops():
    deal = np.random.default_rng(5)
    weights, feature, target = deal.normal(size=(40, 32)).astype(np.float32), deal.integers(0, 40, (3, 60)), deal.integers(0, 32, 60)
    prior, met = np.log(np.full(32, 1 / 32)).astype(np.float32), np.zeros(40, np.int64)
    model = lm.Model(np.empty(0), prior, prior, prior, weights.copy(), 1.0, 1)
    model._step(feature, prior, target, met)
    want, seen, change = weights.astype(float), np.zeros(40, np.int64), np.zeros((40, 32))
    for t in range(60):
        z = np.exp(weights[feature[:, t]].astype(float).sum(axis=0) + prior)
        g = np.eye(32)[target[t]] - z / z.sum()
        for f in feature[:, t]:
            seen[f] += 1
            change[f] += g
    want += change * (lm.STEP / (1 + np.sqrt(seen)))[:, None]
    assert (met == seen).all() and np.allclose(model.weights, want, atol=1e-4)
