"""Draws beyond numpy's limit follow the hypergeometric law."""

import math

import numpy as np
import pytest

from auditspan.llm import sharding


def pmf(good, bad, drawn):
    total = math.comb(good + bad, drawn)
    return np.array([math.comb(good, k) * math.comb(bad, drawn - k) / total if 0 <= drawn - k <= bad else 0.0 for k in range(min(good, drawn) + 1)])


@pytest.mark.parametrize("good, bad, drawn", [(40, 60, 30), (60, 40, 30), (60, 40, 80), (500, 20, 100), (25, 900, 300), (200, 200, 200), (33, 34, 50)])
@pytest.mark.parametrize("sampler", [sharding.ratio_of_uniforms, sharding.by_steps])
def test_samplers_follow_the_law(good, bad, drawn, sampler):
    rng, n = np.random.default_rng([good, bad, drawn]), 12_000
    seen = np.bincount([sampler(rng, good, bad, drawn) for _ in range(n)], minlength=min(good, drawn) + 1)
    want = pmf(good, bad, drawn) * n
    big = want > 5
    chi = ((seen[big] - want[big]) ** 2 / want[big]).sum()
    free = int(big.sum())
    assert chi < free + 5 * math.sqrt(2 * free) + 5 and seen[~big].sum() < 60 + 3 * want[~big].sum()


@pytest.mark.parametrize("d", [-20, -1, 0, 1, 7, 400])
@pytest.mark.parametrize("a", [21.0, 64.0, 1e4, 3e9])
def test_differences_of_log_gammas(a, d):
    if a + d > 0:
        want = sum(math.log1p(k / a) for k in range(d)) if d >= 0 else -sum(math.log1p((k + d) / a) for k in range(-d))
        assert sharding.log_rising(a, float(d)) == pytest.approx(want, abs=1e-9, rel=1e-9)


@pytest.mark.parametrize("good, bad, drawn", [(3 * 10 ** 11, 7 * 10 ** 11, 10 ** 11), (10 ** 13, 5, 10 ** 12), (8, 10 ** 12, 10 ** 11), (10 ** 12, 10 ** 12, 2 * 10 ** 12 - 3)])
def test_large_draws(good, bad, drawn):
    rng = np.random.default_rng(4)
    got = np.array([sharding.hypergeometric(rng, good, bad, drawn) for _ in range(1500)], float)
    total, share = good + bad, good / (good + bad)
    spread = math.sqrt(drawn * share * (1 - share) * (total - drawn) / (total - 1))
    assert abs(got.mean() - drawn * share) < 5 * spread / math.sqrt(len(got)) + 1e-3
    assert got.std() == pytest.approx(spread, rel=0.15, abs=0.05) and got.min() >= max(0, drawn - bad) and got.max() <= min(good, drawn)


def test_margins_beyond_the_limit():
    table = np.array(sharding.draw_matrix([6 * 10 ** 9, 10 ** 9, 1], [5 * 10 ** 9, 10 ** 9, 10 ** 9 + 1], [1]), object)
    assert table.sum(axis=1).tolist() == [6 * 10 ** 9, 10 ** 9, 1] and table.sum(axis=0).tolist() == [5 * 10 ** 9, 10 ** 9, 10 ** 9 + 1]
