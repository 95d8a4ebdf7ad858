import math

import numpy as np
import pytest

from cytoquill.functions import kernels, special


def test_gamma_family():
    x = np.array([1e-3, 0.1, 0.5, 1, 1.5, 2, 3.7, 9.99, 10, 55.5, 1e4, 1e8])
    assert special.gammaln(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
    assert float(special.digamma(1.0)) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert float(special.trigamma(1.0)) == pytest.approx(math.pi**2 / 6, abs=1e-12)
    assert special.digamma(x + 1) - special.digamma(x) == pytest.approx(1 / x, rel=1e-8, abs=1e-12)
    assert special.trigamma(x) - special.trigamma(x + 1) == pytest.approx(1 / x**2, rel=1e-6, abs=1e-15)


def test_tails():
    assert float(special.t_two_sided(12.706204736, 1)) == pytest.approx(0.05, abs=1e-9)
    assert float(special.t_two_sided(2.228138852, 10)) == pytest.approx(0.05, abs=1e-9)
    assert np.isnan(special.t_two_sided(np.nan, 3))
    assert special.f_ppf(0.95, 3, 10) == pytest.approx(3.708264811, abs=1e-7)
    assert special.f_ppf(0.99, 2, 14) == pytest.approx(6.514884, abs=1e-5)
    assert float(special.norm_sf(1.959963984540054)) == pytest.approx(0.025, abs=1e-12)


def test_small_fit_has_the_recorded_coefficients():
    y, size, x = np.array([[3.0, 4, 5, 6]]), np.ones(4), np.array([[1.0, 0], [1, 0], [1, 1], [1, 1]])
    alpha = kernels.fit_alpha(y, kernels.linear_mu(y, x, size), x)
    assert alpha[0] <= 1e-5  # counts vary less than Poisson ones: the bound
    glm = kernels.fit_glm(y, x, size, alpha)
    assert glm.converged.all()
    assert glm.beta[0] == pytest.approx([1.25276277402, 0.45198523193], abs=1e-5)
    assert glm.hat[0] == pytest.approx([0.5] * 4, abs=1e-4)
    assert glm.mu[0] == pytest.approx([3.5, 3.5, 5.5, 5.5], abs=1e-4)


def test_dispersion_is_found_again():
    rng = np.random.default_rng(3)
    alpha, mu = 0.3, 80.0
    y = rng.negative_binomial(1 / alpha, 1 / (1 + alpha * mu), (200, 24)).astype(float)
    x = np.repeat(np.eye(2), 12, 0)
    got = kernels.fit_alpha(y, kernels.linear_mu(y, x, np.ones(24)), x)
    assert np.median(got) == pytest.approx(alpha, rel=0.1)
    slope = kernels.alpha_slope(y, kernels.linear_mu(y, x, np.ones(24)), got)
    assert np.isfinite(slope).all()


def test_trend_is_found_again():
    rng = np.random.default_rng(5)
    mean = np.exp(rng.uniform(1, 8, 2000))
    disp = (4 / mean + 0.05) * rng.gamma(5, 1 / 5, 2000)
    a1, a0 = kernels.fit_trend(mean, disp)
    assert (a1, a0) == (pytest.approx(4, rel=0.15), pytest.approx(0.05, rel=0.1))


def test_wald_alternatives_agree():
    rng = np.random.default_rng(1)
    y, x, c = rng.poisson(50, (20, 8)).astype(float), np.repeat(np.eye(2), 4, 0), np.array([1.0, -1])
    glm = kernels.fit_glm(y, x, np.ones(8), np.full(20, 0.01))
    _, se, stat, p = kernels.wald(glm.beta, glm.mu, x, np.full(20, 0.01), c)
    assert (se > 0).all() and ((p >= 0) & (p <= 1)).all()
    up = kernels.wald(glm.beta, glm.mu, x, np.full(20, 0.01), c, 0.0, "greater")[3]
    down = kernels.wald(glm.beta, glm.mu, x, np.full(20, 0.01), c, 0.0, "less")[3]
    assert np.minimum(up, down) * 2 == pytest.approx(p)
    with pytest.raises(ValueError, match="alternative"):
        kernels.wald(glm.beta, glm.mu, x, np.full(20, 0.01), c, 0.0, "other")


def test_shrinking_pulls_small_effects_to_zero():
    rng = np.random.default_rng(2)
    x = np.stack([np.ones(12), np.repeat([0.0, 1], 6)], 1)
    y = rng.poisson(np.where(x[:, 1] > 0, 21, 20), (30, 12)).astype(float)
    glm = kernels.fit_glm(y, x, np.ones(12), np.full(30, 0.01))
    b, se, _ = kernels.shrink(y, x, np.ones(12), np.full(30, 0.01), glm.beta, 1, 0.05)
    assert (np.abs(b[:, 1]) <= np.abs(glm.beta[:, 1]) + 1e-9).all() and (se > 0).all()


def test_lowess_is_local_and_robust():
    rng = np.random.default_rng(2)
    x = np.sort(rng.uniform(0, 10, 80))
    y = np.sin(x) + rng.normal(0, 0.05, 80)
    smooth = kernels.lowess(x, y, 0.2)
    assert np.abs(smooth - np.sin(x)).max() < 0.15
    off = y.copy()
    off[40] += 30  # one far point moves its surroundings little
    assert np.abs(kernels.lowess(x, off, 0.2, 6) - np.sin(x)).max() < 0.3
    # Equivariant under shifts and scales of both axes, and its first round is weighted least squares.
    assert kernels.lowess(3 * x + 7, -2 * y + 1, 0.2) == pytest.approx(-2 * smooth + 1, abs=1e-9)
    i, k = 17, 16
    reach = np.sort(np.abs(x - x[i]))[k - 1]
    w = np.clip(1 - (np.abs(x - x[i]) / reach) ** 3, 0, None) ** 3
    slope, level = np.polyfit(x, y, 1, w=np.sqrt(w))
    assert kernels.lowess(x, y, 0.2, 1)[i] == pytest.approx(slope * x[i] + level, abs=1e-9)
    assert kernels.lowess(np.zeros(5), np.arange(5.0)) == pytest.approx(np.full(5, 2.0))


def test_trimmed_mean_and_lowess():
    assert kernels.trimmed_mean(np.array([[1.0, 2, 3, 100]]), 0.25)[0] == 2.5
    x = np.linspace(0, 1, 50)
    assert kernels.lowess(x, 3 * x + 1) == pytest.approx(3 * x + 1, abs=1e-9)
