"""Statistical models: data passes on Spark, p by p systems on the driver.

Every fit is a fixed number of aggregates over the rows, or iterates over a table reduced to one row
per event time or cluster size; coefficient tables come back as small frames.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .factors import CrossProducts, within
from .gram import cross_products
from .order import dealt, running_sums
from .rules import as_list
from .special import sum_inverse, sum_inverse_square, sum_log


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return float(_beta_tail(df / (df + t * t), df / 2, 0.5))


def f_tail(f: float, d1: float, d2: float) -> float:
    return float(_beta_tail(d2 / (d2 + d1 * f), d2 / 2, d1 / 2))


def chi2_tail(x: float, df: float) -> float:
    """Upper tail by the series of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, h = df / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= h / n
        total += term
    return max(0.0, 1 - total * math.exp(-h + a * math.log(h) - math.lgamma(a)))


def _exp(x: float) -> float:
    return math.exp(min(x, 700.0))


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def tukey_tail(q: float, k: int, df: float) -> float:
    """Upper tail of the studentised range, by quadrature over the scale and the normal kernel."""
    z, w = np.polynomial.legendre.leggauss(96)
    u = 8 * z
    phi = np.exp(-u * u / 2) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
    s, ws = np.polynomial.legendre.leggauss(48)
    s = 1 + s  # scale between 0 and 2
    dens = np.exp((df - 1) * np.log(s) - df * s * s / 2 + df / 2 * math.log(df) - (df / 2 - 1) * math.log(2) - math.lgamma(df / 2))
    inner = np.array([8 * (w * phi * k * np.maximum(cdf(u) - cdf(u - q * x), 0) ** (k - 1)).sum() for x in s])
    return float(min(1.0, max(0.0, 1 - (ws * dens * inner).sum() / (ws * dens).sum())))


def _moments(df: DataFrame, cols: list[Column]) -> tuple[int, np.ndarray]:
    """n and the cross-product matrix of (1, cols) over complete rows, in one aggregate."""
    complete = df.where(reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]))
    m, _ = cross_products(complete, [F.lit(1.0), *cols])
    return int(m[0, 0]), m


class Linear:
    """A least-squares fit: terms, coefficients, covariance and fit statistics."""

    def __init__(self, spark, terms: list[str], n: int, m: np.ndarray):
        p = len(terms)
        xx = m[:p, :p]
        if n <= p or np.linalg.matrix_rank(xx) < p:
            raise ValueError("the design is singular or has too few rows")
        # centred for accuracy
        self.spark, self.terms, self.n, self.p = spark, terms, n, p
        mean = m[0] / n
        c = m - n * np.outer(mean, mean)
        slope = np.linalg.solve(c[1:p, 1:p], c[1:p, p]) if p > 1 else np.zeros(0)
        self.coef = np.concatenate([[mean[p] - mean[1:p] @ slope], slope])
        self.sse = float(c[p, p] - slope @ c[1:p, p])
        self.sst = float(c[p, p])
        self.mse = self.sse / (n - p)
        self.cov = np.linalg.inv(xx) * self.mse

    def coefficients(self) -> DataFrame:
        """term, estimate, se, t, p_value."""
        se = np.sqrt(np.diag(self.cov))
        rows = [(t, float(b), float(s), float(b / s), t_tail(b / s, self.n - self.p)) for t, b, s in zip(self.terms, self.coef, se)]
        return self.spark.createDataFrame(rows, "term string, estimate double, se double, t double, p_value double")

    def statistics(self) -> DataFrame:
        """n, root_mse, r2, adj_r2, f, p_value."""
        r2 = 1 - self.sse / self.sst
        f = (self.sst - self.sse) / (self.p - 1) / self.mse if self.p > 1 else 0.0
        row = (self.n, math.sqrt(self.mse), r2, 1 - (1 - r2) * (self.n - 1) / (self.n - self.p), f, f_tail(f, self.p - 1, self.n - self.p) if self.p > 1 else 1.0)
        return self.spark.createDataFrame([row], "n long, root_mse double, r2 double, adj_r2 double, f double, p_value double")


def reg(df: DataFrame, y: str, xs) -> Linear:
    """REG: least squares with intercept over complete rows."""
    xs = as_list(xs)
    n, m = _moments(df, [*[F.col(x) for x in xs], F.col(y)])
    return Linear(df.sparkSession, ["intercept", *xs], n, m)


class Absorbed:
    """A least-squares fit of slopes within the levels of an absorbed factor."""

    def __init__(self, spark, terms: list[str], n: int, levels: int, m: np.ndarray, sst: float):
        self.spark, self.terms, self.n, self.levels, self.left = spark, terms, n, levels, n - levels - len(terms)
        xx, xy = m[:-1, :-1], m[:-1, -1]
        if self.left <= 0 or np.linalg.matrix_rank(xx) < len(terms):
            raise ValueError("the design is singular or has too few rows")
        self.coef = np.linalg.solve(xx, xy)
        self.sse, self.sst = float(m[-1, -1] - self.coef @ xy), sst
        self.mse = self.sse / self.left
        self.cov = np.linalg.inv(xx) * self.mse

    def coefficients(self) -> DataFrame:
        """term, estimate, se, t, p_value."""
        se = np.sqrt(np.diag(self.cov))
        rows = [(t, float(b), float(s), float(b / s), t_tail(b / s, self.left)) for t, b, s in zip(self.terms, self.coef, se)]
        return self.spark.createDataFrame(rows, "term string, estimate double, se double, t double, p_value double")

    def statistics(self) -> DataFrame:
        """n, levels, root_mse, r2 (of all terms, the factor too)."""
        return self.spark.createDataFrame([(self.n, self.levels, math.sqrt(self.mse), 1 - self.sse / self.sst)], "n long, levels long, root_mse double, r2 double")


def reg_absorb(df: DataFrame, y: str, xs, absorb) -> Absorbed:
    """REG with ABSORB: least squares of ``xs`` beside a factor of any number of levels (null levels and incomplete rows are left out)."""
    return Absorbed(df.sparkSession, as_list(xs), *within(df, y, xs, absorb))


def anova(df: DataFrame, y: str, terms: list[str]) -> DataFrame:
    """term, df, ss, ms, f, p_value: sequential sums of squares; "a*b" is an interaction, string columns are factors. The largest may have any number of levels, the other columns what the dense part can hold (``factors.DENSE``)."""
    sums = CrossProducts(df, y, terms)
    fits = sums.fits()
    left = sums.n - fits[-1][0]
    if left <= 0:
        raise ValueError("the design has as many columns as rows")
    sse = fits[-1][1]
    ms, out = sse / left, []
    for term, (r0, s0), (r1, s1) in zip(terms, fits, fits[1:]):
        if d := r1 - r0:
            f = (s0 - s1) / d / ms
            out.append((term, d, s0 - s1, (s0 - s1) / d, f, f_tail(f, d, left)))
    out.append(("residuals", left, sse, ms, None, None))
    return df.sparkSession.createDataFrame(out, "term string, df long, ss double, ms double, f double, p_value double")


def tukey(df: DataFrame, y: str, group: str) -> DataFrame:
    """a, b, diff, q, p_value: Tukey-Kramer comparisons of group means."""
    g = df.where(F.col(y).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v")).orderBy(group).collect()
    left = sum(r["n"] for r in g) - len(g)
    mse = sum((r["n"] - 1) * (r["v"] or 0.0) for r in g) / left
    rows = []
    for i, a in enumerate(g):
        for b in g[i + 1 :]:
            d = b["m"] - a["m"]
            q = abs(d) / math.sqrt(mse / 2 * (1 / a["n"] + 1 / b["n"]))
            rows.append((str(a[0]), str(b[0]), d, q, tukey_tail(q, len(g), left)))
    return df.sparkSession.createDataFrame(rows, "a string, b string, diff double, q double, p_value double")


#: Levels of a factor that a logistic model may have: each is a column of its system.
LEVELS = 400


def _design(df: DataFrame, formula: str) -> tuple[str, list[str], DataFrame, list[Column]]:
    """The response, the names of the columns, the complete rows and the columns of ``y ~ a + b + a:b``; ``a*b`` is short for all three.

    String columns are factors: a column for each level but the first. Intercept last.
    """
    y, right = (x.strip() for x in formula.split("~"))
    terms: list[str] = []
    for t in (x.strip() for x in right.split("+")):
        parts = [x.strip() for x in t.split("*")]
        terms += [*parts, ":".join(parts)] if len(parts) > 1 else [t.replace(" ", "")]
    terms = list(dict.fromkeys(terms))
    names = list(dict.fromkeys(v for t in terms for v in t.split(":")))
    kinds, rows = dict(df.dtypes), df.na.drop(subset=[y, *names])
    one: dict[str, list[tuple[str, Column]]] = {}
    for v in names:
        if kinds[v] != "string":
            one[v] = [(v, F.col(v).cast("double"))]
            continue
        levels = [r[0] for r in rows.select(v).distinct().orderBy(v).limit(LEVELS + 1).collect()]
        if len(levels) > LEVELS:
            raise ValueError(f"{v} has more than {LEVELS} levels")
        one[v] = [(f"{v}_{x}", (F.col(v) == F.lit(x)).cast("double")) for x in levels[1:]]
    cols = [c for t in terms for c in reduce(lambda a, b: [(f"{n}:{m}", x * z) for n, x in a for m, z in b], [one[v] for v in t.split(":")])]
    return y, [*[n for n, _ in cols], "intercept"], rows, [*[c for _, c in cols], F.lit(1.0)]


class Logistic:
    """A fitted logistic regression."""

    def __init__(self, spark, terms, coef, cov, loglik, n, events, rounds):
        self.spark, self.terms, self.coef, self.cov, self.loglik, self.n, self.events, self.rounds = spark, terms, coef, cov, loglik, n, events, rounds

    def coefficients(self) -> DataFrame:
        """term, estimate, se, z, p_value, odds_ratio, wald_low, wald_high."""
        se = np.sqrt(np.diag(self.cov))
        rows = [(t, float(b), float(e), float(b / e), normal_tail(b / e), _exp(b), _exp(b - 1.959964 * e), _exp(b + 1.959964 * e)) for t, b, e in zip(self.terms, self.coef, se)]
        return self.spark.createDataFrame(rows, "term string, estimate double, se double, z double, p_value double, odds_ratio double, wald_low double, wald_high double")

    def statistics(self) -> DataFrame:
        """n, events, loglik, null_loglik, aic, chi2 (likelihood ratio against the intercept alone), df, p_value."""
        p = self.events / self.n
        null = self.events * math.log(p) + (self.n - self.events) * math.log(1 - p)
        k = len(self.terms) - 1
        chi2 = 2 * (self.loglik - null)
        row = (self.n, self.events, self.loglik, null, 2 * (k + 1) - 2 * self.loglik, chi2, k, chi2_tail(chi2, k) if k else 1.0)
        return self.spark.createDataFrame([row], "n long, events long, loglik double, null_loglik double, aic double, chi2 double, df long, p_value double")


def logistic_fit(df: DataFrame, formula: str, max_iter: int = 40) -> Logistic:
    """LOGISTIC: maximum likelihood by Newton steps, each one aggregate over the rows; ``y`` is 0 or 1 (or boolean), incomplete rows are left out.

    Where a combination of terms tells the events from the others (separation, complete or not), there is no
    maximum: the steps then run along that combination, and a pass shows that no row lies on its wrong side.
    ValueError names its terms. A singular design is a ValueError too.
    """
    y, terms, rows, cols = _design(df, formula)
    p, y = len(terms), F.col(y).cast("double")
    beta, step, last = np.zeros(p), np.zeros(p), -math.inf
    score = lambda b: reduce(lambda u, v: u + v, [F.lit(float(b[j])) * cols[j] for j in range(p)])
    for rounds in range(1, max_iter + 1):
        eta = score(beta)
        mu = 1 / (1 + F.exp(-eta))
        # log(1 + exp(eta)) without overflow
        loglik = F.sum(y * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta))))
        side = (2 * y - 1) * score(step)
        extra = [F.sum(cols[j] * (y - mu)) for j in range(p)] + [loglik, F.min(side), F.max(side), F.count(F.lit(1)), F.sum(y)]
        info, more = cross_products(rows, cols, mu * (1 - mu), extra)
        grad, (value, low, high, n, events) = np.array([v or 0.0 for v in more[:p]]), more[p:]
        if not events or events == n:
            raise ValueError("the response has one value only")
        if rounds == 1 and np.linalg.matrix_rank(info) < p:
            raise ValueError("the design is singular")
        if value < last and np.abs(step).max() > 1e-8:
            step = step / 2
            beta = beta - step
            continue
        if rounds > 6 and high > 0 and low >= -1e-6 * high:
            raise ValueError("separation by " + ", ".join(t for t, s in zip(terms, step) if abs(s) > 1e-3 * np.abs(step).max()))
        if value - last <= 1e-12 * (abs(value) + 1):
            return Logistic(df.sparkSession, terms, beta, np.linalg.inv(info), value, n, int(events), rounds)
        last, step = value, np.linalg.lstsq(info, grad, rcond=None)[0]
        beta = beta + step
    raise RuntimeError("the Newton steps did not settle")


def logistic(df: DataFrame, formula: str) -> DataFrame:
    """term, estimate, se, z, p_value, odds_ratio, wald_low, wald_high of ``y ~ terms`` (string columns are factors)."""
    return logistic_fit(df, formula).coefficients()


class Mixed:
    """A linear model with one random intercept, fitted by REML."""

    def __init__(self, spark, terms, coef, cov, sigma2, tau2, n, groups):
        self.spark, self.terms, self.coef, self.cov, self.sigma2, self.tau2, self.n, self.groups = spark, terms, coef, cov, sigma2, tau2, n, groups

    def coefficients(self) -> DataFrame:
        se = np.sqrt(np.diag(self.cov))
        return self.spark.createDataFrame(
            [(t, float(b), float(s), float(b / s), normal_tail(b / s)) for t, b, s in zip(self.terms, self.coef, se)],
            "term string, estimate double, se double, z double, p_value double"
        )

    def variances(self) -> DataFrame:
        return self.spark.createDataFrame([(float(self.sigma2), float(self.tau2), self.n, self.groups)], "residual double, intercept double, n long, subjects long")

    def estimate(self, **weights: float) -> DataFrame:
        """A linear combination of coefficients, as LSMEANS, ESTIMATE and CONTRAST give them."""
        return estimate(self.spark, self.terms, self.coef, self.cov, weights)


def estimate(spark, terms: list[str], coef: np.ndarray, cov: np.ndarray, weights: dict[str, float]) -> DataFrame:
    """estimate, se, z, p_value of the weighted sum of coefficients."""
    l = np.array([weights.get(t, 0.0) for t in terms])
    b, s = float(l @ coef), math.sqrt(float(l @ cov @ l))
    return spark.createDataFrame([(b, s, b / s if s else None, normal_tail(b / s) if s else None)], "estimate double, se double, z double, p_value double")


def lsmeans(fit: Linear | Mixed, at: list[dict[str, float]], labels: list[str]) -> DataFrame:
    """label, estimate, se: fitted means at given values of the terms (the intercept counts as 1)."""
    rows = []
    for label, w in zip(labels, at):
        l = np.array([1.0 if t == "intercept" else w.get(t, 0.0) for t in fit.terms])
        rows.append((label, float(l @ fit.coef), math.sqrt(float(l @ fit.cov @ l))))
    return fit.spark.createDataFrame(rows, "label string, estimate double, se double")


def mixed(df: DataFrame, y: str, xs, subject: str) -> Mixed:
    """MIXED with a random intercept per subject.

    Subjects are summed to their sizes and totals, then by size: the likelihood at any variance
    ratio is a sum over the few distinct sizes, so the search makes no further pass over the data.
    """
    xs = as_list(xs)
    cols = [*[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    rows = df.where(reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]) & F.col(subject).isNotNull())
    n, m = _moments(rows, cols)
    k = len(cols) + 1
    sums = rows.groupBy(subject).agg(F.count(F.lit(1)).alias("size"), *[F.sum(c).alias(f"s{i + 1}") for i, c in enumerate(cols)])
    s = lambda i: F.col("size").cast("double") if i == 0 else F.col(f"s{i}")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    by_size = sums.groupBy("size").agg(F.count(F.lit(1)).alias("g"), *[F.sum(s(i) * s(j)).alias(f"p{a}") for a, (i, j) in enumerate(pairs)]).collect()
    sizes = np.array([r["size"] for r in by_size], float)
    many = np.array([r["g"] for r in by_size], float)
    cross = np.zeros((len(by_size), k, k))
    for a, (i, j) in enumerate(pairs):
        cross[:, i, j] = cross[:, j, i] = [r[f"p{a}"] for r in by_size]
    p = k - 1

    def at(lam: float):
        a = m - np.tensordot(lam / (1 + sizes * lam), cross, 1)
        xx, xy, yy = a[:p, :p], a[:p, p], a[p, p]
        b = np.linalg.solve(xx, xy)
        rss = max(float(yy - b @ xy), 1e-12)
        ll = -0.5 * ((n - p) * math.log(rss) + float((many * np.log1p(sizes * lam)).sum()) + np.linalg.slogdet(xx)[1])
        return ll, b, xx, rss / (n - p)

    def slope(lam: float) -> float:
        """Minus twice the derivative of the restricted likelihood: zero at its estimate."""
        _, b, xx, s2 = at(lam)
        fall = np.tensordot(1 / (1 + sizes * lam) ** 2, cross, 1)
        r = np.append(-b, 1.0)
        return float(-(r @ fall @ r) / s2 + (many * sizes / (1 + sizes * lam)).sum() - np.trace(np.linalg.solve(xx, fall[:p, :p])))

    grid = np.concatenate([[0.0], np.exp(np.linspace(-14, 6, 81))])
    best = int(np.argmax([at(g)[0] for g in grid]))
    lo, hi = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    for _ in range(100):
        middle = (lo + hi) / 2
        lo, hi = (lo, middle) if slope(middle) > 0 else (middle, hi)
    lam = (lo + hi) / 2 if at((lo + hi) / 2)[0] > at(0.0)[0] else 0.0
    _, b, xx, s2 = at(lam)
    return Mixed(df.sparkSession, ["intercept", *xs], b, np.linalg.inv(xx) * s2, s2, lam * s2, n, int(many.sum()))


class Cox:
    """A fitted proportional-hazards model."""

    def __init__(self, spark, terms, coef, cov, loglik, rounds, times):
        self.spark, self.terms, self.coef, self.cov, self.loglik, self.rounds, self.times = spark, terms, coef, cov, loglik, rounds, times

    def coefficients(self) -> DataFrame:
        """term, estimate, se, z, p_value, hazard_ratio, wald_low, wald_high."""
        se = np.sqrt(np.diag(self.cov))
        rows = [(t, float(b), float(s), float(b / s), normal_tail(b / s), _exp(b), _exp(b - 1.959964 * s), _exp(b + 1.959964 * s)) for t, b, s in zip(self.terms, self.coef, se)]
        return self.spark.createDataFrame(rows, "term string, estimate double, se double, z double, p_value double, hazard_ratio double, wald_low double, wald_high double")

    def ph_test(self) -> DataFrame:
        """term, rho, chi2, p_value: correlation of mean Schoenfeld residuals with event time."""
        p = len(self.terms)
        t = self.times.where("d > 0")
        row = t.agg(F.count(F.lit(1)).alias("n"), *[F.corr("time", F.col(f"x{j}") / F.col("d") - F.col(f"r1_{j}") / F.col("r0")).alias(f"c{j}") for j in range(p)]).first()
        out = [(self.terms[j], row[f"c{j}"], row["n"] * (row[f"c{j}"] or 0.0) ** 2, chi2_tail(row["n"] * (row[f"c{j}"] or 0.0) ** 2, 1)) for j in range(p)]
        return self.spark.createDataFrame(out, "term string, rho double, chi2 double, p_value double")


def _whole(cells: dict[str, Column], table: DataFrame, p: int) -> DataFrame:
    return table.agg(*[F.sum(c).alias(k) for k, c in cells.items()], F.sum("lw").alias("lw"), *[F.sum(f"x{j}").alias(f"x{j}") for j in range(p)])


def _breslow(table: DataFrame, p: int, pairs) -> DataFrame:
    """Sums over event times of the partial likelihood's parts, all events of a time facing the whole risk set."""
    d, r = F.col("d").cast("double"), lambda k: F.col("r" + k) / F.col("r0")
    cells = {"ld": d * F.log("r0")} | {f"g{j}": d * r(f"1_{j}") for j in range(p)} | {f"h{i}_{j}": d * (r(f"2_{i}_{j}") - r(f"1_{i}") * r(f"1_{j}")) for i, j in pairs}
    return _whole(cells, table, p)


def _efron(table: DataFrame, p: int, pairs) -> DataFrame:
    """The same by Efron: the l-th of d tied events faces the risk set less l / d of the tied rows.

    With A = d r0 / e0 the risk sets are e0 / d (A - l), so their logarithms, reciprocals and squared
    reciprocals are sums over A, A - 1, …, A - d + 1, which have closed forms: no row for each tied event.
    """
    d, r0, e0 = F.col("d").cast("double"), F.col("r0"), F.col("e0")
    top = d * r0 / e0
    low = F.greatest(top - d + 1, F.lit(1.0))
    t = table.withColumns({"__a": top, "__k": d / e0, "__l": sum_log(low, d), "__1": sum_inverse(low, d), "__2": sum_inverse_square(low, d)})
    a, k, s1, s2 = F.col("__a"), F.col("__k"), F.col("__1"), F.col("__2")
    first = lambda i: (F.col(f"r1_{i}") - a / d * F.col(f"e1_{i}"), F.col(f"e1_{i}"))
    cells = {"ld": F.col("__l") - d * F.log(k)} | {f"g{j}": k * (first(j)[0] * s1 + first(j)[1]) for j in range(p)}
    for i, j in pairs:
        (ci, ei), (cj, ej), e2 = first(i), first(j), F.col(f"e2_{i}_{j}")
        second = k * ((F.col(f"r2_{i}_{j}") - a / d * e2) * s1 + e2)
        cells[f"h{i}_{j}"] = second - k * k * (ci * cj * s2 + (ci * ej + cj * ei) * s1 / d + ei * ej / d)
    return _whole(cells, t, p)


def cox(df: DataFrame, time: str, event: str, xs, strata=None, ties: str = "efron", max_iter: int = 25) -> Cox:
    """PHREG by Newton steps; each is an aggregate to event times and sums over the risk sets of that small table.

    ``event``: 1 for an event, 0 for censoring. Ties by Efron, or "breslow".
    """
    xs, strata = as_list(xs), as_list(strata)
    p = len(xs)
    keep = [F.col(c).cast("double").alias(f"v{j}") for j, c in enumerate(xs)]
    data = dealt(df.na.drop(subset=[time, event, *xs]).select(*strata, F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("event"), *keep), [*strata, "time"])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    beta = np.zeros(p)
    for rounds in range(1, max_iter + 1):
        risk = F.exp(reduce(lambda a, b: a + b, [F.lit(float(beta[j])) * F.col(f"v{j}") for j in range(p)]))
        hit = F.col("event") == 1
        base = data.withColumn("w", risk)
        sums = {"s0": F.col("w")} | {f"s1_{j}": F.col("w") * F.col(f"v{j}") for j in range(p)} | {f"s2_{i}_{j}": F.col("w") * F.col(f"v{i}") * F.col(f"v{j}") for i, j in pairs}
        aggs = [F.sum(v).alias(k) for k, v in sums.items()] + [F.coalesce(F.sum(F.when(hit, v)), F.lit(0.0)).alias("e" + k[1:]) for k, v in sums.items()]
        aggs += [
            F.sum("event").alias("d"), F.coalesce(F.sum(F.when(hit, F.log("w"))), F.lit(0.0)).alias("lw")
        ] + [F.coalesce(F.sum(F.when(hit, F.col(f"v{j}"))), F.lit(0.0)).alias(f"x{j}") for j in range(p)]
        by_time = base.groupBy(*strata, "time", "__part").agg(*aggs)
        at_risk = running_sums(by_time, strata, "time", {"r" + k[1:]: k for k in sums}, descending=True).where("d > 0")
        a = (_efron if ties == "efron" else _breslow)(at_risk, p, pairs).first()
        if a["ld"] is None:
            raise ValueError("no events")
        loglik = a["lw"] - a["ld"]
        grad = np.array([a[f"x{j}"] - a[f"g{j}"] for j in range(p)])
        info = np.zeros((p, p))
        for i, j in pairs:
            info[i, j] = info[j, i] = a[f"h{i}_{j}"]
        step = np.linalg.solve(info, grad)
        if step @ grad < 1e-12:  # a step below a millionth of the standard error
            break
        beta = beta + step
    else:
        raise RuntimeError("the Newton steps did not settle")
    return Cox(df.sparkSession, xs, beta, np.linalg.inv(info), loglik, rounds, at_risk)


def _risk_table(df: DataFrame, time: str, event: str, strata: list[str]) -> DataFrame:
    """strata, the time under its own name, events, censored, __part, at_risk: one row per time, sizes summed from the latest time back."""
    rows = df.na.drop(subset=[time, event]).groupBy(*strata, time).agg(F.sum(F.col(event).cast("long")).alias("events"), F.count(F.lit(1)).alias("__n"))
    table = running_sums(dealt(rows, [*strata, time]), strata, time, {"at_risk": "__n"}, descending=True)
    return table.select(*strata, time, "events", (F.col("__n") - F.col("events")).alias("censored"), "__part", "at_risk")


def km(df: DataFrame, time: str, event: str, strata=None) -> DataFrame:
    """LIFETEST: strata, time, at_risk, events, censored, survival and its Greenwood standard error."""
    strata = as_list(strata)
    d, n = F.col("events"), F.col("at_risk")
    # a product of factors 1 - d / n: the logarithms of those above zero, and how many are zero
    table = _risk_table(df, time, event, strata).withColumns(
        {"__log": F.when(d < n, F.log(1 - d / n)).otherwise(0.0), "__zero": (d == n).cast("int"), "__g": F.coalesce(F.try_divide(d, n * (n - d)), F.lit(0.0))}
    )
    sums = running_sums(table, strata, time, {"__logs": "__log", "__zeros": "__zero", "__gs": "__g"})
    out = sums.withColumn("survival", F.when(F.col("__zeros") > 0, 0.0).otherwise(F.exp("__logs"))).withColumn("se", F.col("survival") * F.sqrt("__gs"))
    return out.select(*strata, F.col(time).alias("time"), "events", "censored", "at_risk", "survival", "se")


def logrank_table(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """group, n, observed, expected of the log-rank test.

    A row is at risk at all event times up to its own, so what a group expects is the sum of its rows' cumulative hazards:
    one running sum over the event times, met by the groups' counts at each time.
    """
    hazard = _risk_table(df, time, event, []).withColumn("__h", F.col("events") / F.col("at_risk"))
    upto = running_sums(hazard, [], time, {"__hazard": "__h"}).select(F.col(time).alias("__t"), "__hazard")
    own = df.na.drop(subset=[time, event]).groupBy(group, F.col(time).alias("__t")).agg(F.count(F.lit(1)).alias("__k"), F.sum(F.col(event).cast("long")).alias("__e"))
    return own.join(upto, "__t").groupBy(group).agg(F.sum("__k").alias("n"), F.sum("__e").alias("observed"), F.sum(F.col("__k") * F.col("__hazard")).alias("expected"))


def logrank(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """chi2, df, p_value by the sum of (O - E)^2 / E over the groups."""
    row = logrank_table(df, time, event, group).agg(F.sum((F.col("observed") - F.col("expected")) ** 2 / F.col("expected")).alias("c"), F.count(F.lit(1)).alias("k")).first()
    return df.sparkSession.createDataFrame([(row["c"], row["k"] - 1, chi2_tail(row["c"], row["k"] - 1))], "chi2 double, df long, p_value double")
