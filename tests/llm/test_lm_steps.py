"""What a training step of op1's network calls, and that it is still the gradient."""

import cProfile
import pstats

import numpy as np
from test_llm import MODEL, corpus

from verisift.llm import lm_scoring


def made():
    codec = lm_scoring._codec(open(MODEL, "rb").read())
    n = codec.bare.vocab_size()
    texts = [r[1] for r in corpus(5, 60)]
    flat, edge = lm_scoring._subwords(codec, sorted({w for t in texts for w in (t or "").encode().lower().split()}))
    symbol = np.full(n + 1, lm_scoring.TAIL, np.int32)
    symbol[np.argsort(-np.bincount(flat, minlength=n), kind="stable")[: lm_scoring.HEAD - 1]] = np.arange(1, lm_scoring.HEAD)
    t = lm_scoring.Texts(texts, codec, symbol)
    return t, lm_scoring.Prior(t.neighbours(np.ones(len(texts), bool))), t.windows()


def test_calls_of_a_step():
    t, prior, (first, stop, begin) = made()
    t.x, t.y = (np.random.default_rng(i).integers(0, lm_scoring.HEAD, len(t.y)).astype(np.int32) for i in (1, 2))  # all groups
    net, seen = lm_scoring.Network(), cProfile.Profile()
    seen.enable()
    net.train(prior, t, first, stop, begin, 0.001)
    seen.disable()
    assert pstats.Stats(seen).total_calls / -(-len(first) // lm_scoring.TRAIN_BATCH) < 150


def test_gradients():
    t, prior, (first, stop, begin) = made()
    place = np.minimum(first[:20, None] + np.arange(lm_scoring.WINDOW), stop[:20, None] - 1)
    on = (first[:20, None] + np.arange(lm_scoring.WINDOW) < stop[:20, None]) & (place >= begin[:20, None])
    net, rng = lm_scoring.Network(), np.random.default_rng(2)
    grads = {k: np.zeros_like(a) for k, a in net.p.items()}
    logs = net.logs(prior, t.x[place], t.y[place], on, grads)
    np.testing.assert_allclose(logs, net.logs(prior, t.x[place], t.y[place], on), rtol=1e-4, atol=1e-4)
    for k, g in grads.items():
        way = g * rng.random(g.shape, np.float32)
        far = 0.02 / np.linalg.norm(way)
        means = []
        for sign in (1, -1):
            other = lm_scoring.Network({n: a + sign * far * way if n == k else a for n, a in net.p.items()})
            means.append(other.logs(prior, t.x[place], t.y[place], on).astype(float).mean())
        np.testing.assert_allclose((means[0] - means[1]) / 2, far * (way * g).sum(), rtol=0.05)
