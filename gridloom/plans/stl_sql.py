"""The seasonal-trend decomposition without robustness weights, stated in SQL: plain sums over each place's neighbours."""

from __future__ import annotations

SEASONAL, ROUNDS = 7, 5


def _odd_above(x: float) -> int:
    return int(x) + 1 + int(x) % 2


def _loess(name: str, source: str, span: int, ends: int) -> str:
    """name (g, i, v): source (g, i, v, evenly spaced from 0) smoothed by local lines, at its places and ends more on either side."""
    return f"""{name}_n AS MATERIALIZED (SELECT g, count(*) AS n, least(count(*), {span}) AS q FROM {source} GROUP BY g),
{name}_at AS MATERIALIZED (SELECT g, n, q, a, greatest(least(a - (q - 1) // 2, n - q), 0) AS lo FROM (SELECT *, unnest(range(-{ends}, n + {ends})) AS a FROM {name}_n)),
{name}_r AS (SELECT g, n, q, a, lo, greatest(a - lo, lo + q - 1 - a) + greatest(0, ({span} - n) // 2) AS reach FROM {name}_at),
{name}_w AS (SELECT r.g, r.n, r.a, s.i, s.v, abs(s.i - r.a) / greatest(r.reach, 1e-12) AS u FROM {name}_r r JOIN {source} s ON s.g = r.g AND s.i BETWEEN r.lo AND r.lo + r.q - 1),
{name}_s AS (SELECT g, n, a, sum(w) AS w, sum(w * (i - a)) / sum(w) AS c, sum(w * (i - a) ** 2) / sum(w) AS cc, sum(w * v) / sum(w) AS m, sum(w * (i - a) * v) / sum(w) AS cm
  FROM (SELECT *, CASE WHEN u <= 0.001 THEN 1 WHEN u <= 0.999 THEN (1 - u ** 3) ** 3 ELSE 0 END AS w FROM {name}_w) GROUP BY 1, 2, 3),
{name} AS MATERIALIZED (SELECT g, a AS i, m + CASE WHEN sqrt(greatest(cc - c * c, 0)) > 0.001 * (n - 1) THEN -c / (cc - c * c) ELSE 0 END * (cm - c * m) AS v FROM {name}_s)"""


def _moved(name: str, source: str, n: int) -> str:
    """The means of n neighbours, numbered from 0."""
    return f"""{name} AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY i) - 1 AS i, v FROM (SELECT g, i, avg(v) OVER (PARTITION BY g ORDER BY i ROWS {n - 1} PRECEDING) AS v,
  row_number() OVER (PARTITION BY g ORDER BY i) AS k FROM {source}) WHERE k >= {n})"""


def stl_sql(source: str, to: str, period: int = 24) -> str:
    """Tables that end in one named to (code, ts, kwh, trend, seasonal, resid), from source (code, ts, kwh without gaps)."""
    trend, low = _odd_above(1.5 * period / (1 - 1.5 / SEASONAL) - 1e-9), _odd_above(period)
    p = to + "_"
    parts = [f"{p}y AS MATERIALIZED (SELECT code AS g, row_number() OVER (PARTITION BY code ORDER BY ts) - 1 AS i, ts, kwh AS v FROM {source} QUALIFY count(*) OVER (PARTITION BY code) >= {2 * period})"]
    for k in range(ROUNDS):
        less = f"y.v - t.v FROM {p}y y JOIN {p}t{k - 1} t ON t.g = y.g AND t.i = y.i" if k else f"y.v FROM {p}y y"
        value, _, table = less.partition(" FROM ")
        parts += [
            f"{p}d{k} AS MATERIALIZED (SELECT y.g || ' ' || (y.i % {period}) AS g, y.i // {period} AS i, {value} AS v FROM {table})",
            _loess(f"{p}c{k}", f"{p}d{k}", SEASONAL, 1),
            f"{p}e{k} AS MATERIALIZED (SELECT o.code AS g, (c.i + 1) * {period} + o.phase AS i, c.v FROM {p}c{k} c JOIN (SELECT DISTINCT g AS code, i % {period} AS phase FROM {p}y) o ON o.code || ' ' || o.phase = c.g)",
            _moved(f"{p}m1{k}", f"{p}e{k}", period),
            _moved(f"{p}m2{k}", f"{p}m1{k}", period),
            f"{p}m3{k} AS MATERIALIZED (" + _moved("x", f"{p}m2{k}", 3)[len("x AS (") :],
            _loess(f"{p}l{k}", f"{p}m3{k}", low, 0),
            f"{p}s{k} AS MATERIALIZED (SELECT y.g, y.i, e.v - l.v AS v, y.v - (e.v - l.v) AS rest FROM {p}y y JOIN {p}e{k} e ON e.g = y.g AND e.i = y.i + {period} JOIN {p}l{k} l ON l.g = y.g AND l.i = y.i)",
            f"{p}a{k} AS MATERIALIZED (SELECT g, i, rest AS v FROM {p}s{k})",
            _loess(f"{p}t{k}", f"{p}a{k}", trend, 0),
        ]
    last = ROUNDS - 1
    parts.append(f"{to} AS MATERIALIZED (SELECT y.g AS code, y.ts, y.v AS kwh, t.v AS trend, s.v AS seasonal, y.v - t.v - s.v AS resid FROM {p}y y JOIN {p}s{last} s ON s.g = y.g AND s.i = y.i JOIN {p}t{last} t ON t.g = y.g AND t.i = y.i)")
    return ",\n".join(parts)
