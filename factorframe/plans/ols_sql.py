"""Least squares as plain SQL (moments, then elimination column by column), used as an independent check."""


def ols_sql(base: str, keys: list[str], xs: list[str], y: str, ridge: float = 0.0, min_rows: int = 0, lam: str | None = None) -> str:
    """Query text: keys, n, alpha, b_{x}, r2, rss and, without penalty, t_alpha, t_{x}."""
    k = len(xs)
    pen = lam or repr(float(ridge))
    key = ", ".join(keys)
    ok = " AND ".join(f"{v} IS NOT NULL" for v in xs + [y])
    cols = ["count(*) AS n", f"avg({y}) AS my", f"var_pop({y}) AS syy"]
    cols += [f"avg({x}) AS m{i}, covar_pop({x}, {y}) AS y{i}" for i, x in enumerate(xs)]
    cols += [f"covar_pop({xs[max(i, j)]}, {xs[min(i, j)]}) AS s{i}_{j}" for i in range(k) for j in range(k)]
    q = f"SELECT {key}, {', '.join(cols)} FROM {base} WHERE {ok} GROUP BY {key}"
    if min_rows:
        q += f" HAVING count(*) >= {min_rows}"
    start = [f"s{i}_{j}" + (f" + {pen} / n" if i == j else "") + f" AS a{i}_{j}" for i in range(k) for j in range(k)]
    start += [f"y{i} AS c{i}" for i in range(k)] + [f"CAST({int(i == j)} AS DOUBLE) AS e{i}_{j}" for i in range(k) for j in range(k)]
    q = f"SELECT *, {', '.join(start)} FROM ({q})"
    cells = [f"a{{i}}_{j}" for j in range(k)] + ["c{i}"] + [f"e{{i}}_{j}" for j in range(k)]
    for p in range(k):
        rep = []
        for i in range(k):
            for cell in cells:
                own, piv = cell.format(i=i), cell.format(i=p)
                rep.append(f"{own} / a{p}_{p} AS {own}" if i == p else f"{own} - a{i}_{p} * {piv} / a{p}_{p} AS {own}")
        q = f"SELECT * REPLACE ({', '.join(rep)}) FROM ({q})"
    alpha = "my - (" + " + ".join(f"c{i} * m{i}" for i in range(k)) + ")"
    quad = " + ".join(f"c{i} * c{j} * s{i}_{j}" for i in range(k) for j in range(k))
    rss = f"n * (syy - 2 * ({' + '.join(f'c{i} * y{i}' for i in range(k))}) + {quad})"
    q = f"SELECT *, {alpha} AS alpha, {rss} AS rss FROM ({q})"
    out = [key, "n", "alpha"] + [f"c{i} AS b_{x}" for i, x in enumerate(xs)] + ["1 - rss / (n * syy) AS r2", "rss"]
    if not ridge and not lam:
        lev = " + ".join(f"m{i} * e{i}_{j} * m{j}" for i in range(k) for j in range(k))
        out.append(f"alpha / sqrt(rss / (n - {k + 1}) / n * (1 + {lev})) AS t_alpha")
        out += [f"c{i} / sqrt(rss / (n - {k + 1}) / n * e{i}_{i}) AS t_{x}" for i, x in enumerate(xs)]
    return f"SELECT {', '.join(out)} FROM ({q})"


def student_sql(t: str, dof: str) -> str:
    """Two-sided p-value of Student's t for whole degrees of freedom: the finite series of its distribution."""
    angle, cos = f"atan(abs({t}) / sqrt({dof}))", f"(1 / sqrt(1 + pow({t}, 2) / ({dof})))"
    sin = f"(abs({t}) / sqrt({dof}) * {cos})"
    even = f"list_sum(list_transform(range(0, ({dof}) // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0)) / sqrt(pi()) * pow({cos}, 2 * j)))"
    odd = f"coalesce(list_sum(list_transform(range(1, ({dof}) // 2 + 1), lambda j: exp(lgamma(j + 0.0) - lgamma(j + 0.5)) * sqrt(pi()) / 2 * pow({cos}, 2 * j - 1))), 0)"
    return f"(1 - CASE WHEN ({dof}) % 2 = 0 THEN {sin} * {even} ELSE 2 / pi() * ({angle} + {sin} * {odd}) END)"
