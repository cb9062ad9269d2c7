"""Least squares as plain SQL: elimination over named columns, for check SQL."""

from __future__ import annotations

from itertools import combinations_with_replacement


def gram_cte(name: str, src: str, by: list[str], features: list[str], y: str, where: str = "", weight: str = "1.0",
             lam: float | str = 0.0) -> str:
    """Weighted sums of products of [1, features, y]; the penalty enters the
    diagonal of the centred system, so sums are centred here."""
    v = [*features, y]
    keys = ", ".join(by)
    cond = " AND ".join(f"{c} IS NOT NULL" for c in v) + (f" AND ({where})" if where else "")
    raw = ", ".join(f"sum({a} * {b} * {weight}) AS s_{i}_{j}" for (i, a), (j, b) in combinations_with_replacement(list(enumerate(v)), 2))
    first = ", ".join(f"sum({a} * {weight}) AS m_{i}" for i, a in enumerate(v))
    head = f"{keys}, " if by else ""
    group = f" GROUP BY {keys}" if by else ""
    return (f"{name}_raw AS (SELECT {head}CAST(count(*) AS BIGINT) AS n_train, sum({weight}) AS w, {first}, {raw} FROM {src} WHERE {cond}{group})"
            f", {centre(name, by, len(features), lam)}")


def centre(name: str, by: list[str], p: int, lam: float | str = 0.0, extra: str = "") -> str:
    head = "".join(f"{k}, " for k in by)
    cells = ", ".join(f"CAST(s_{i}_{j} - m_{i} * m_{j} / w + {lam if i == j and i < p else 0} AS DOUBLE) AS c_{i}_{j}"
                      for i, j in combinations_with_replacement(range(p + 1), 2))
    means = ", ".join(f"m_{i} / w AS mu_{i}" for i in range(p + 1))
    return f"{name} AS (SELECT {head}{extra}n_train, {means}, {cells} FROM {name}_raw)"


def solve_cte(out: str, name: str, by: list[str], p: int, keep: str = "") -> str:
    """Chain of elimination steps, then back substitution: b0 (intercept), b1.."""
    head = "".join(f"{k}, " for k in by) + (keep + ", " if keep else "")
    mus = ", ".join(f"mu_{i}" for i in range(p + 1))
    ctes, prev = [], name
    for k in range(p):
        cols = []
        for i, j in combinations_with_replacement(range(p + 1), 2):
            if i <= k:
                cols.append(f"c_{i}_{j}")
            else:
                cols.append(f"c_{i}_{j} - c_{k}_{i} * c_{k}_{j} / nullif(c_{k}_{k}, 0) AS c_{i}_{j}")
        nxt = f"{out}_e{k}"
        ctes.append(f"{nxt} AS (SELECT {head}n_train, {mus}, {', '.join(cols)} FROM {prev})")
        prev = nxt

    for k in reversed(range(p)):
        minus = "".join(f" - c_{k}_{j} * b{j + 1}" for j in range(k + 1, p))
        nxt = f"{out}_b{k}"
        ctes.append(f"{nxt} AS (SELECT *, (c_{k}_{p}{minus}) / nullif(c_{k}_{k}, 0) AS b{k + 1} FROM {prev})")
        prev = nxt
    inter = "".join(f" - mu_{i} * b{i + 1}" for i in range(p))
    betas = ", ".join(f"b{i + 1}" for i in range(p))
    ctes.append(f"{out} AS (SELECT {head}n_train, mu_{p}{inter} AS b0, {betas} FROM {prev})")
    return ", ".join(ctes)


def predict_sql(features: list[str], alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return f"({a}b0" + "".join(f" + {a}b{i + 1} * {f}" for i, f in enumerate(features)) + ")"
