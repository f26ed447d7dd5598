"""SQL of boosted trees: the same rounds, levels and penalties, written out level by level."""

from __future__ import annotations


def boosted_sql(source: str, classes: int, rounds: int, depth: int, eta: float, lam: float, alpha: float, gamma: float, bins: int, features: int) -> str:
    """A WITH list that ends in p (r, k, p): probabilities of rows of `source` (r, x, y); one class is the logistic case."""
    shrunk = lambda g: f"(sign({g}) * greatest(abs({g}) - {alpha}, 0))"
    worth = lambda g, h: f"({shrunk(g)} * {shrunk(g)} / ({h} + {lam}))"
    out = [
        f"src AS MATERIALIZED ({source})",
        f"v AS MATERIALIZED (SELECT r, unnest(range(0, {features})) AS f, unnest(x) AS v FROM src)",
        f"q AS (SELECT f, unnest(quantile_disc(v, [{', '.join(f'{k / bins!r}' for k in range(1, bins))}])) AS c FROM v GROUP BY f)",
        "cuts AS MATERIALIZED (SELECT f, c, row_number() OVER (PARTITION BY f ORDER BY c) - 1 AS s FROM (SELECT DISTINCT f, c FROM q))",
        f"m0 AS MATERIALIZED (SELECT r, k, x, y, 0.0::DOUBLE AS m FROM src, (SELECT unnest(range(0, {classes})) AS k))",
    ]
    for t in range(rounds):
        if classes == 1:
            loss = f"SELECT r, k, x, p - y AS g, greatest(p * (1 - p), 1e-16) AS h FROM (SELECT *, 1 / (1 + exp(-m)) AS p FROM m{t})"
        else:
            loss = f"SELECT r, k, x, p - CASE WHEN y = k THEN 1 ELSE 0 END AS g, greatest(2 * p * (1 - p), 1e-16) AS h FROM (SELECT *, exp(m) / sum(exp(m)) OVER (PARTITION BY r) AS p FROM m{t})"
        out.append(f"g{t} AS MATERIALIZED ({loss})")
        at = f"(SELECT r, k, x, g, h, 1 AS node FROM g{t})"
        for d in range(depth):
            name = f"{t}_{d}"
            out += [
                f"n{name} AS MATERIALIZED (SELECT * FROM {at})",
                f"h{name} AS (SELECT n.k, n.node, v.f, v.v, sum(g) AS g, sum(h) AS h FROM n{name} n JOIN v USING (r) GROUP BY ALL)",
                f"l{name} AS (SELECT k, node, f, s, c, sum(CASE WHEN v < c THEN g ELSE 0 END) AS gl, sum(CASE WHEN v < c THEN h ELSE 0 END) AS hl, sum(g) AS g, sum(h) AS h FROM h{name} JOIN cuts USING (f) GROUP BY k, node, f, s, c)",
                f"""s{name} AS MATERIALIZED (
                    SELECT k, node, f, c, gain FROM (
                        SELECT *, row_number() OVER (PARTITION BY k, node ORDER BY gain DESC, f, s) AS place FROM (
                            SELECT *, CASE WHEN hl >= 1 AND h - hl >= 1 THEN round({worth('gl', 'hl')} + {worth('(g - gl)', '(h - hl)')} - {worth('g', 'h')}, 9) ELSE -1 END AS gain FROM l{name}))
                    WHERE place = 1 AND gain > 1e-6)""",
            ]
            at = f"(SELECT n.r, n.k, n.x, n.g, n.h, CASE WHEN n.x[s.f + 1] < s.c THEN 2 * n.node ELSE 2 * n.node + 1 END AS node FROM n{name} n JOIN s{name} s USING (k, node))"
        for d in range(depth - 1, -1, -1):
            kept = f"OR EXISTS (SELECT 1 FROM k{t}_{d + 1} b WHERE b.k = a.k AND b.node // 2 = a.node)" if d < depth - 1 else ""
            out.append(f"k{t}_{d} AS MATERIALIZED (SELECT * FROM s{t}_{d} a WHERE gain >= {gamma} {kept})")
        ends = f"(SELECT r, k, x, g, h, 1 AS node FROM g{t})"
        for d in range(depth):
            ends = f"(SELECT e.r, e.k, e.x, e.g, e.h, CASE WHEN b.f IS NULL THEN e.node WHEN e.x[b.f + 1] < b.c THEN 2 * e.node ELSE 2 * e.node + 1 END AS node FROM {ends} e LEFT JOIN k{t}_{d} b ON b.k = e.k AND b.node = e.node)"
        out += [
            f"e{t} AS MATERIALIZED (SELECT r, k, g, h, node FROM {ends})",
            f"w{t} AS (SELECT k, node, {eta} * -{shrunk('sum(g)')} / (sum(h) + {lam}) AS w FROM e{t} GROUP BY k, node)",
            f"m{t + 1} AS MATERIALIZED (SELECT m.r, m.k, m.x, m.y, m.m + w.w AS m FROM m{t} m JOIN e{t} e ON e.r = m.r AND e.k = m.k JOIN w{t} w ON w.k = e.k AND w.node = e.node)",
        ]
    p = "1 / (1 + exp(-m))" if classes == 1 else "exp(m) / sum(exp(m)) OVER (PARTITION BY r)"
    out.append(f"p AS (SELECT r, k, y, {p} AS p FROM m{rounds})")
    return "WITH " + ",\n        ".join(out)
