"""A view that only fits its own rows well gives no pseudo-labels; one that holds on other rows does."""

import numpy as np

from verisift.llm.quality import ArrayPool, TablePool, _limits, co_train, fit_logistic, sums_of, told


def test_gate_is_judged_on_other_rows():
    rng = np.random.default_rng(8)
    y = (rng.random(400) < 0.5).astype(float)
    sign = lambda y: np.stack([2 * y - 1 + rng.normal(size=len(y)), np.ones(len(y))], 1)
    noise = lambda n: np.concatenate([rng.normal(size=(n, 80)), np.ones((n, 1))], 1)
    pool = (rng.random(1000) < 0.5).astype(float)
    held = np.arange(len(y)) % 4 == 3
    alone = lambda v: fit_logistic(v[~held], y[~held], np.ones(int((~held).sum())))
    t, m = sign(y), noise(len(y))
    made = co_train(t, m, y, ArrayPool(sign(pool), noise(len(pool))))
    np.testing.assert_allclose(made.text, alone(t))
    assert not np.allclose(made.meta, alone(m))
    t, m = sign(y), sign(y)
    made = co_train(t, m, y, ArrayPool(sign(pool), sign(pool)))
    assert not np.allclose(made.text, alone(t)) and not np.allclose(made.meta, alone(m))


def test_limits_take_ties_and_only_sure_ones():
    assert _limits({-300: 5, -200: 90, 0: 10, 400: 95}) == (-1.99, 4.0)
    assert _limits({-50: 100, 50: 100}) == (-1.0, 1.0)


def test_first_rule_counts():
    t, m = np.array([[-2.0], [2.0], [0.0], [0.0]]), np.array([[3.0], [-3.0], [3.0], [0.0]])
    to, label = told([(0, np.ones(1), -1.0, 1.0), (1, np.ones(1), -1.0, 1.0)], t, m)
    assert to.tolist() == [1, 1, 0, -1] and label.tolist() == [0, 1, 1, 0]


def test_a_table_gives_what_arrays_give(spark):
    rng = np.random.default_rng(3)
    n = 500
    truth = rng.random(n) < 0.5
    t, m = (np.stack([np.where(truth, 1.5, -1.5) + rng.normal(size=n), rng.normal(size=n), np.ones(n)], 1).astype("<f2") for _ in range(2))
    rows = spark.createDataFrame([(bytearray(a.tobytes()), bytearray(b.tobytes())) for a, b in zip(t, m, strict=True)], "t binary, m binary").repartition(5)
    arrays, table = ArrayPool(t.astype(np.float32), m.astype(np.float32)), TablePool(rows)
    rules = [(0, np.array([1.0, 0.2, 0.0]), -1.5, 1.5)]
    assert table.spread(rules, 1, np.ones(3)) == arrays.spread(rules, 1, np.ones(3))
    np.testing.assert_allclose(table.sums(rules, 1, np.ones(3)), sums_of(rules, 1, np.ones(3), *arrays.views))
    y = (rng.random(120) < 0.5).astype(float)
    lt, lm = (np.stack([2 * y - 1 + rng.normal(size=120), rng.normal(size=120), np.ones(120)], 1) for _ in range(2))
    a, b = co_train(lt, lm, y, arrays), co_train(lt, lm, y, table)
    np.testing.assert_allclose(a.text, b.text, rtol=1e-6)
    np.testing.assert_allclose(a.meta, b.meta, rtol=1e-6)


def test_second_order_sums_stand_for_rows():
    """A fit on labelled rows and the sums of others is near one on all rows, once the sums are taken near its weights."""
    from verisift.llm.quality import Given

    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(600, 3)), np.ones((600, 1))], 1)
    y = (x @ np.array([1.0, -0.5, 0.3, 0.1]) + rng.logistic(size=600) > 0).astype(float)
    weight = np.concatenate([np.ones(100), np.full(500, 0.5)])
    whole = fit_logistic(x, y, weight, steps=3000)
    w = fit_logistic(x[:100], y[:100], np.ones(100))
    for _ in range(4):
        p = 1 / (1 + np.exp(-x[100:] @ w))
        of = [(y[100:] == v) for v in (0, 1)]
        given = Given(w, np.array([o.sum() for o in of]), np.array([x[100:][o].T @ (p[o] - v) for v, o in enumerate(of)]), np.array([(x[100:][o] * (p[o] * (1 - p[o]))[:, None]).T @ x[100:][o] for o in of]))
        w = fit_logistic(x[:100], y[:100], np.ones(100), steps=3000, given=given)
    np.testing.assert_allclose(w, whole, atol=1e-3)
