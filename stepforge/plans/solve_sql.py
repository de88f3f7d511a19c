"""SQL text for what the checks of models need: linear systems, tails and Newton steps, written out as common table expressions."""

from __future__ import annotations


def solved(name: str, source: str, p: int) -> str:
    """CTEs up to ``name``: s0, s1, … solve the symmetric system of the rows of ``source`` (h{i}_{j} for i <= j, g{i}); v{i}_{j} is its inverse.

    Columns of ``source`` called ``k`` are kept: one system for each row.
    """
    wide = 2 * p + 1
    start = [f"h{min(i, j)}_{max(i, j)} AS m{i}_{j}" for i in range(p) for j in range(p)] + [f"g{i} AS m{i}_{p}" for i in range(p)] + [
        f"{1.0 if i == j else 0.0} AS m{i}_{p + 1 + j}" for i in range(p) for j in range(p)
    ]
    out = [f"{name}x0 AS MATERIALIZED (SELECT k, {', '.join(start)} FROM {source})"]
    for c in range(p):
        cells = [f"m{i}_{j} {f'/ m{c}_{c}' if i == c else f'- m{i}_{c} * m{c}_{j} / m{c}_{c}'} AS m{i}_{j}" for i in range(p) for j in range(c + 1, wide)]
        out.append(f"{name}x{c + 1} AS MATERIALIZED (SELECT k, {', '.join(cells)} FROM {name}x{c})")
    ends = [f"m{i}_{p} AS s{i}" for i in range(p)] + [f"m{i}_{p + 1 + j} AS v{i}_{j}" for i in range(p) for j in range(i, p)]
    return ",\n".join([*out, f"{name} AS MATERIALIZED (SELECT k, {', '.join(ends)} FROM {name}x{p})"])


def tail(z: str, df: str | None = None) -> str:
    """Two-sided tail of the normal distribution, or of Student's t: one less twice the integral from 0, by Simpson's rule."""
    a = f"least(abs({z}), 12.0)"
    density = "exp(-u * u / 2) / sqrt(2 * pi())" if df is None else f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * pow(1 + u * u / {df}, -({df} + 1) / 2.0)"
    at = density.replace("u * u", f"pow({a} * i / 1000.0, 2)")
    return f"greatest(0.0, 1 - 2 * {a} / 3000.0 * list_sum(list_transform(range(0, 1001), lambda i: {at} * CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)))"


def logistic(data: str, p: int, rounds: int = 9) -> str:
    """CTEs after ``data`` (y, x0, x1, …): the estimates b0, b1, … in ``b`` and the inverse information v{i}_{j} in ``e``."""
    eta = " + ".join(f"b{i} * x{i}" for i in range(p))
    info = [f"sum(m * (1 - m) * x{i} * x{j}) AS h{i}_{j}" for i in range(p) for j in range(i, p)] + [f"sum(x{i} * (y - m)) AS g{i}" for i in range(p)]
    out = ["b_0 AS (SELECT 0 AS k, " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(p)) + ")"]
    for r in range(rounds + 1):
        out.append(f"n_{r} AS MATERIALIZED (SELECT 0 AS k, {', '.join(info)} FROM (SELECT {data}.*, 1 / (1 + exp(-({eta}))) AS m FROM {data}, b_{r}))")
        out.append(solved(f"e_{r}" if r < rounds else "e", f"n_{r}", p))
        if r < rounds:
            out.append(f"b_{r + 1} AS MATERIALIZED (SELECT 0 AS k, {', '.join(f'b{i} + s{i} AS b{i}' for i in range(p))} FROM b_{r} JOIN e_{r} USING (k))")
    return ",\n".join([*out, f"b AS (SELECT * FROM b_{rounds})"])


def cox(data: str, rounds: int = 8) -> str:
    """CTEs after ``data`` (seg, time, event, x): the slope b and its information h in ``e``, the risk sets at b in ``r``; ties by Efron, one row a tied event."""
    out = ["b_0 AS (SELECT 0.0::DOUBLE AS b)"]
    for i in range(rounds + 1):
        last = i == rounds
        sums = ", ".join(f"sum(exp(b * x) * pow(x, {j})) AS s{j}, sum(exp(b * x) * pow(x, {j})) FILTER (WHERE event = 1) AS e{j}" for j in range(3))
        out.append(f"t_{i} AS MATERIALIZED (SELECT seg, time, b, {sums}, sum(event) AS d, sum(x) FILTER (WHERE event = 1) AS x FROM {data}, b_{i} GROUP BY seg, time, b)")
        risk = f"r{'' if last else f'_{i}'}"
        out.append(f"{risk} AS MATERIALIZED (SELECT *, {', '.join(f'sum(s{j}) OVER (PARTITION BY seg ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS r{j}' for j in range(3))} FROM t_{i})")
        tied = f"(SELECT *, l / d AS f FROM (SELECT *, unnest(range(CAST(d AS BIGINT))) AS l FROM {risk} WHERE d > 0))"
        out.append(
            f"e{'' if last else f'_{i}'} AS MATERIALIZED (SELECT any_value(b) AS b, sum((r2 - f * e2) / (r0 - f * e0) - pow((r1 - f * e1) / (r0 - f * e0), 2)) AS h, (SELECT sum(x) FROM {risk} WHERE d > 0) - sum((r1 - f * e1) / (r0 - f * e0)) AS g FROM {tied})"
        )
        if not last:
            out.append(f"b_{i + 1} AS MATERIALIZED (SELECT b + g / h AS b FROM e_{i})")
    return ",\n".join(out)


def mixed(data: str, p: int, rounds: int = 8, steps: int = 40) -> str:
    """CTEs after ``data`` (grp, x0 = 1, x1, …, y as the last x): coefficients s0, …, inverse v{i}_{j}, residual variance mse and ratio lam in ``fit``.

    The restricted likelihood of one random intercept is taken on a grid of ratios, then the zero of its derivative is enclosed by ever finer grids.
    """
    cells = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    out = [
        f"whole AS MATERIALIZED (SELECT count(*) AS n, {', '.join(f'sum(x{i} * x{j}) AS w{i}_{j}' for i, j in cells)} FROM {data})",
        f"grp AS (SELECT grp, count(*) AS size, {', '.join(f'sum(x{i}) AS t{i}' for i in range(p + 1))} FROM {data} GROUP BY grp)",
        f"sized AS MATERIALIZED (SELECT size, count(*) AS many, {', '.join(f'sum(t{i} * t{j}) AS c{i}_{j}' for i, j in cells)} FROM grp GROUP BY size)",
        "k_0 AS (SELECT 0.0::DOUBLE AS k UNION ALL SELECT exp(-14 + 0.25 * unnest(range(81))))",
    ]
    low = lambda a, i, j: f"{a}{min(i, j)}_{max(i, j)}"
    for r in range(rounds + 1):
        last = r == rounds
        sums = ", ".join(f"any_value(w{i}_{j}) - sum(k / (1 + size * k) * c{i}_{j}) AS a{i}_{j}, sum(c{i}_{j} / pow(1 + size * k, 2)) AS f{i}_{j}" for i, j in cells)
        out.append(
            f"a_{r} AS MATERIALIZED (SELECT k, any_value(n) AS n, sum(many * ln(1 + size * k)) AS spread, sum(many * size / (1 + size * k)) AS turn, {sums} FROM k_{r}, sized, whole GROUP BY k)"
        )
        named = [f"a{i}_{j} AS h{i}_{j}" for i in range(p) for j in range(i, p)] + [f"a{i}_{p} AS g{i}" for i in range(p)]
        out.append(f"h_{r} AS (SELECT k, {', '.join(named)} FROM a_{r})")
        out.append(solved(f"e_{r}", f"h_{r}", p))
        rss = f"(a{p}_{p} - ({' + '.join(f's{i} * a{i}_{p}' for i in range(p))}))"
        quad = " + ".join(f"{'' if i == j else '2 * '}{sign(i, p)}{sign(j, p)}f{i}_{j}" for i, j in cells)
        trace = " + ".join(f"{'' if i == j else '2 * '}v{i}_{j} * f{i}_{j}" for i in range(p) for j in range(i, p))
        out.append(
            f"l_{r} AS MATERIALIZED (SELECT a_{r}.k, -({quad}) / ({rss} / (n - {p})) + turn - ({trace}) AS slope, (n - {p}) * ln({rss}) + spread + logdet AS loss, {rss} / (n - {p}) AS mse "
            f"FROM a_{r} JOIN e_{r} USING (k) JOIN ({logdet(f'e_{r}', p)}) USING (k))"
        )
        if r == 0:
            out.append(f"o_0 AS MATERIALIZED (SELECT arg_min(k, loss) AS best, (SELECT loss FROM l_0 WHERE k = 0) AS none FROM l_0)")
            out.append(
                f"i_0 AS MATERIALIZED (SELECT coalesce((SELECT max(k) FROM l_0, o_0 WHERE k < best), 0) AS lo, coalesce((SELECT min(k) FROM l_0, o_0 WHERE k > best), (SELECT best FROM o_0)) AS hi)"
            )
        elif not last:
            out.append(f"i_{r} AS MATERIALIZED (SELECT coalesce(max(k) FILTER (WHERE slope <= 0), min(k)) AS lo, coalesce(min(k) FILTER (WHERE slope > 0), max(k)) AS hi FROM l_{r})")
        if r < rounds - 1:
            out.append(f"k_{r + 1} AS MATERIALIZED (SELECT DISTINCT lo + (hi - lo) * unnest(range({steps + 1})) / {float(steps)} AS k FROM i_{r})")
        elif r == rounds - 1:
            out.append(f"k_{r + 1} AS MATERIALIZED (SELECT (lo + hi) / 2 AS k FROM i_{r} UNION SELECT 0.0)")
    keep = f"(SELECT k FROM l_{rounds} ORDER BY loss, k LIMIT 1)"
    out.append(
        f"fit AS MATERIALIZED (SELECT k AS lam, mse, {', '.join(f's{i}' for i in range(p))}, {', '.join(f'v{i}_{j}' for i in range(p) for j in range(i, p))} FROM e_{rounds} JOIN l_{rounds} USING (k) WHERE k = {keep})"
    )
    return ",\n".join(out)


def sign(i: int, p: int) -> str:
    """The i-th entry of (-b, 1), the weights of a residual."""
    return "" if i == p else f"(-s{i}) * "


def logdet(name: str, p: int) -> str:
    """k and the logarithm of the determinant, from the pivots of ``solved``."""
    return f"SELECT {name}x0.k, {' + '.join(f'ln({name}x{c}.m{c}_{c})' for c in range(p))} AS logdet FROM {name}x0 " + " ".join(f"JOIN {name}x{c} ON {name}x{c}.k = {name}x0.k" for c in range(1, p))
