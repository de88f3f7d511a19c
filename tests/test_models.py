"""Models against direct maximisation, dense systems and loops."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepforge.operators import factors, gram, models, special


def test_sums_without_a_loop(spark):
    df = spark.createDataFrame([(x, float(n)) for x in (1.0, 1.5, 3.25, 40.0, 1e3, 1e7) for n in (1, 2, 7, 100, 3000)], "x double, n double")
    x, n = F.col("x"), F.col("n")
    for r in df.select("x", "n", special.sum_log(x, n), special.sum_inverse(x, n), special.sum_inverse_square(x, n)).collect():
        at = range(int(r[1]))
        assert r[2] == pytest.approx(math.fsum(math.log(r[0] + i) for i in at), rel=1e-12, abs=1e-13)
        assert r[3] == pytest.approx(math.fsum(1 / (r[0] + i) for i in at), rel=1e-12)
        assert r[4] == pytest.approx(math.fsum(1 / (r[0] + i) ** 2 for i in at), rel=1e-12)


def _lived(n, groups, seed):
    rnd = random.Random(seed)
    return [(rnd.randrange(1, 12), rnd.random() < 0.7, rnd.gauss(0, 1), rnd.gauss(1, 2), rnd.choice(groups)) for _ in range(n)]


def _partial(rows, beta, efron=True):
    """Log partial likelihood, gradient and information by a loop over tied events."""
    ll, grad, info = 0.0, np.zeros(2), np.zeros((2, 2))
    for g in {r[4] for r in rows}:
        own = [r for r in rows if r[4] == g]
        for t in {r[0] for r in own if r[1]}:
            x = np.array([r[2:4] for r in own if r[0] >= t])
            e = np.array([r[2:4] for r in own if r[0] == t and r[1]])
            w, we = np.exp(x @ beta), np.exp(e @ beta)
            ll, grad = ll + (e @ beta).sum(), grad + e.sum(0)
            for i in range(len(e)):
                f = i / len(e) if efron else 0.0
                s0, s1 = w.sum() - f * we.sum(), w @ x - f * we @ e
                s2 = (x.T * w) @ x - f * (e.T * we) @ e
                ll, grad, info = ll - math.log(s0), grad - s1 / s0, info + s2 / s0 - np.outer(s1, s1) / s0**2
    return ll, grad, info


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_with_many_ties_equals_the_loop(spark, ties):
    rows = _lived(300, "ab", 1)
    df = spark.createDataFrame([(t, int(e), x, z, g) for t, e, x, z, g in rows], "t int, e int, x double, z double, g string")
    fit = models.cox(df, "t", "e", ["x", "z"], "g", ties=ties)
    beta = np.zeros(2)
    for _ in range(20):
        ll, grad, info = _partial(rows, beta, ties == "efron")
        beta = beta + np.linalg.solve(info, grad)
    ll, _, info = _partial(rows, beta, ties == "efron")
    assert fit.coef == pytest.approx(beta, abs=1e-9) and fit.cov == pytest.approx(np.linalg.inv(info), rel=1e-8) and fit.loglik == pytest.approx(ll, rel=1e-12)
    assert "Generate" not in fit.times._jdf.queryExecution().optimizedPlan().toString()


def test_all_rows_die_at_once(spark):
    rows = [(1, True, float(i), float(i * i % 5), "a") for i in range(40)]
    df = spark.createDataFrame([(t, int(e), x, z, g) for t, e, x, z, g in rows], "t int, e int, x double, z double, g string")
    fit = models.cox(df, "t", "e", ["x", "z"])
    assert _partial(rows, fit.coef)[1] == pytest.approx([0, 0], abs=1e-6)
    with pytest.raises(ValueError):
        models.cox(df.where("e = 0"), "t", "e", "x")


def _sequential(y, blocks):
    sse, rank = [((y - y.mean()) ** 2).sum()], [1]
    x = np.ones((len(y), 1))
    for b in blocks:
        x = np.hstack([x, b])
        fit = x @ np.linalg.lstsq(x, y, rcond=None)[0]
        sse.append(((y - fit) ** 2).sum())
        rank.append(np.linalg.matrix_rank(x))
    return sse, rank


@pytest.mark.parametrize("terms", [["f", "g", "x", "f*g", "g*x"], ["x", "g"], ["g*x", "f"], ["x*z", "f"], ["f"], ["x"]])
def test_anova_equals_dense_least_squares(spark, terms):
    rnd = random.Random(7)
    rows = [(rnd.choice("abcdefgh"), rnd.choice("xyz"), 100 + rnd.gauss(0, 1), rnd.gauss(0, 3)) for _ in range(240)]
    rows = [(*r, (ord(r[0]) % 3) + 0.4 * r[2] - r[3] + rnd.gauss(0, 1)) for r in rows]
    holes = [(None, "x", 1.0, 1.0, 1.0), ("a", "x", 1.0, 1.0, None), ("a", "x", None, 1.0, 2.0)] if "x" in str(terms) else []
    df = spark.createDataFrame(rows + holes, "f string, g string, x double, z double, y double")
    if "f" not in str(terms):
        df = df.where("f is not null")
    one = {"f": 0, "g": 1, "x": 2, "z": 3}
    dummy = lambda v: np.array([[r[one[v]] == k for k in sorted({s[one[v]] for s in rows})] for r in rows], float) if v in "fg" else np.array([[r[one[v]]] for r in rows])
    blocks = []
    for t in terms:
        b = np.ones((len(rows), 1))
        for v in t.split("*"):
            b = np.einsum("ni,nj->nij", b, dummy(v)).reshape(len(rows), -1)
        blocks.append(b)
    sse, rank = _sequential(np.array([r[4] for r in rows]), blocks)
    got = models.anova(df, "y", terms).collect()
    left = len(rows) - rank[-1]
    want = [(t, rank[i + 1] - rank[i], sse[i] - sse[i + 1]) for i, t in enumerate(terms) if rank[i + 1] > rank[i]] + [("residuals", left, sse[-1])]
    assert [(r.term, r.df) for r in got] == [w[:2] for w in want]
    assert [r.ss for r in got] == pytest.approx([w[2] for w in want], rel=1e-7, abs=1e-7)
    for r in got[:-1]:
        assert r.f == pytest.approx(r.ms / got[-1].ms) and r.p_value == pytest.approx(models.f_tail(r.f, r.df, left))


def test_anova_of_two_thousand_levels(spark):
    df = spark.range(12_000).select(F.concat(F.lit("l"), F.col("id") % 2000).alias("f"), (F.col("id") % 3).cast("string").alias("g"), F.randn(1).alias("x"), F.randn(2).alias("y"))
    got = {r.term: r.df for r in models.anova(df, "y", ["f", "g", "x"]).collect()}
    assert got == {"f": 1999, "g": 2, "x": 1, "residuals": 12_000 - 2003}
    with pytest.raises(ValueError):
        models.anova(df.limit(2), "y", ["f", "x"])


def test_anova_holds_no_levels_of_the_absorbed_factor_on_the_driver(spark, monkeypatch):
    df = spark.range(60_000).select(F.concat(F.lit("l"), F.col("id") % 20_000).alias("f"), (F.col("id") % 3).cast("string").alias("g"), F.randn(1).alias("x"), F.randn(2).alias("y"))
    monkeypatch.setattr(factors, "DENSE", 100)
    tracemalloc.start()
    try:
        got = {r.term: r.df for r in models.anova(df, "y", ["f", "g", "x"]).collect()}
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == {"f": 19_999, "g": 2, "x": 1, "residuals": 60_000 - 20_003}
    assert peak < 5_000_000  # 20,000 levels as Python rows alone are more; their square is 3.2 GB
    with pytest.raises(ValueError):
        models.anova(df.withColumn("g", (F.col("y") * 5).cast("int").cast("string")), "y", ["f", "g"])


def test_absorbed_slopes_equal_those_beside_dummies(spark):
    rnd = random.Random(3)
    rows = [(f"s{rnd.randrange(30)}", 50 + rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0), ("s1", None, 1.0, 1.0)], "s string, x double, z double, y double")
    levels = sorted({r[0] for r in rows})
    x = np.array([[r[1], r[2], *[r[0] == k for k in levels]] for r in rows], float)
    y = np.array([r[3] for r in rows])
    b, sse = np.linalg.lstsq(x, y, rcond=None)[:2]
    fit = models.reg_absorb(df, "y", ["x", "z"], "s")
    assert fit.coef == pytest.approx(b[:2], rel=1e-8) and fit.sse == pytest.approx(float(sse[0]), rel=1e-9)
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x))[:2] * sse[0] / (300 - 2 - len(levels)))
    assert [r.se for r in fit.coefficients().collect()] == pytest.approx(list(se), rel=1e-8)
    assert fit.statistics().first().levels == len(levels)
    with pytest.raises(ValueError):
        models.reg_absorb(df.withColumn("w", F.col("x") * 2), "y", ["x", "w"], "s")


def test_many_columns_are_summed_as_matrices(spark):
    cols = [F.col("id").cast("double") % (i + 2) + i for i in range(gram.WIDE + 3)]
    df = spark.range(500)
    wide, extra = gram.cross_products(df, cols, F.col("id") * 0.01, [F.sum("id")])
    x = np.array([[j % (i + 2) + i for i in range(len(cols))] for j in range(500)], float)
    assert wide == pytest.approx((x.T * (np.arange(500) * 0.01)) @ x) and extra == [124_750]
    few, _ = gram.cross_products(df, cols[:4], F.col("id") * 0.01)
    assert few == pytest.approx(wide[:4, :4])
    assert gram.cross_products(df.limit(0), cols)[0].sum() == 0
    fit = models.reg(df.select(F.randn(9).alias("y"), *[F.randn(i).alias(f"x{i}") for i in range(30)]), "y", [f"x{i}" for i in range(30)])
    assert len(fit.coef) == 31


def _logit(rows, names):
    x, y = np.array([r[1:] for r in rows], float), np.array([r[0] for r in rows], float)
    b = np.zeros(x.shape[1])
    for _ in range(30):
        m = 1 / (1 + np.exp(-x @ b))
        h = (x.T * (m * (1 - m))) @ x
        b = b + np.linalg.solve(h, x.T @ (y - m))
    return dict(zip(names, zip(b, np.sqrt(np.diag(np.linalg.inv(h))))))


def test_logistic_with_factors_and_interactions(spark):
    rnd = random.Random(5)
    raw = [(rnd.random(), rnd.choice("abc")) for _ in range(400)]
    rows = [(int(rnd.random() < 1 / (1 + math.exp(1 - 2 * x - (g == "b") + (g == "c") * x))), x, g) for x, g in raw]
    df = spark.createDataFrame(rows + [(None, 1.0, "a"), (1, None, "a"), (0, 0.5, None)], "y int, x double, g string")
    want = _logit([(y, x, g == "b", g == "c", x * (g == "b"), x * (g == "c"), 1) for y, x, g in rows], ["x", "g_b", "g_c", "x:g_b", "x:g_c", "intercept"])
    got = models.logistic(df, "y ~ x*g").collect()
    assert [r.term for r in got] == list(want)
    for r in got:
        b, se = want[r.term]
        assert (r.estimate, r.se) == (pytest.approx(b, abs=1e-7), pytest.approx(se, rel=1e-6))
        assert (r.odds_ratio, r.wald_low) == (pytest.approx(math.exp(b), rel=1e-6), pytest.approx(math.exp(b - 1.959964 * se), rel=1e-6))
    stats = models.logistic_fit(df.withColumn("y", F.col("y") == 1), "y ~ x").statistics().first()
    assert stats.n == 401 and stats.chi2 > 0 and 0 <= stats.p_value <= 1 and stats.aic == pytest.approx(4 - 2 * stats.loglik)


def test_logistic_without_a_maximum(spark):
    complete = spark.createDataFrame([(int(i > 20), float(i)) for i in range(40)], "y int, x double")
    with pytest.raises(ValueError, match="separation by .*x"):
        models.logistic(complete, "y ~ x")
    quasi = spark.createDataFrame([(i % 2, "a", float(i % 7)) for i in range(40)] + [(1, "b", float(i % 5)) for i in range(20)], "y int, g string, x double")
    with pytest.raises(ValueError, match="separation by g_b"):
        models.logistic(quasi, "y ~ g + x")
    with pytest.raises(ValueError, match="one value"):
        models.logistic(complete.where("y = 1"), "y ~ x")
    with pytest.raises(ValueError, match="singular"):
        models.logistic(complete.withColumn("y", F.col("x").cast("int") % 2).withColumn("z", F.col("x") * 2), "y ~ x + z")


def test_mixed_is_at_the_top_of_its_likelihood(spark):
    rnd = random.Random(11)
    shift = [rnd.gauss(0, 2) for _ in range(25)]
    rows = [(g, x := rnd.gauss(0, 1), 3 + 2 * x + shift[g] + rnd.gauss(0, 1)) for g in range(25) for _ in range(1 + g % 6)]
    fit = models.mixed(spark.createDataFrame(rows, "g int, x double, y double"), "y", "x", "g")

    def loss(lam):
        n, x, y = len(rows), np.array([[1, r[1]] for r in rows]), np.array([r[2] for r in rows])
        v = np.eye(n) + lam * np.equal.outer([r[0] for r in rows], [r[0] for r in rows])
        vi = np.linalg.inv(v)
        xx = x.T @ vi @ x
        b = np.linalg.solve(xx, x.T @ vi @ y)
        rss = (y - x @ b) @ vi @ (y - x @ b)
        return (n - 2) * math.log(rss) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1], b, rss / (n - 2)

    lam = fit.tau2 / fit.sigma2
    assert loss(lam)[1] == pytest.approx(fit.coef, rel=1e-8) and loss(lam)[2] == pytest.approx(fit.sigma2, rel=1e-8)
    h = 1e-4 * lam
    assert abs(loss(lam + h)[0] - loss(lam - h)[0]) / (2 * h) < 1e-6 and loss(lam)[0] < min(loss(lam / 2)[0], loss(lam * 2)[0], loss(0)[0])
