import copy

import numpy as np
import pytest

from tidewatch.functions.learners import LstmAutoencoder


def test_gradients_follow_differences():
    x, rate, eps = np.array([0.3, -0.2, 0.5]), 1e-6, 1e-5
    net = LstmAutoencoder(3, 5, 2, rate)
    taught = copy.deepcopy(net)
    taught.loss(x, learn=True)
    for at in (lambda n: n.encoder.w, lambda n: n.encoder.b, lambda n: n.decoder.w, lambda n: n.w[0], lambda n: n.w[1], lambda n: n.b[0]):
        got = (at(net) - at(taught)) / rate
        for place in np.ndindex(at(net).shape):
            up, down = copy.deepcopy(net), copy.deepcopy(net)
            at(up)[place] += eps
            at(down)[place] -= eps
            assert got[place] == pytest.approx((up.loss(x) - down.loss(x)) / (2 * eps), abs=1e-5)


def test_learns_to_repeat_and_spots_strange_rows():
    net, rng = LstmAutoencoder(2, 16, 4, 0.05), np.random.default_rng(3)
    losses = [net.step(tuple(rng.normal([0.4, -0.3], 0.05)))[0] for _ in range(2000)]
    assert np.mean(losses[-100:]) < np.mean(losses[:100]) / 5
    assert net.loss(np.array([-0.6, 0.7])) > 20 * np.mean(losses[-100:])
