"""Segmented fits stated in SQL: the same grids, errors and choice of model, from plain sums over the rows of each break."""

from __future__ import annotations

from gridloom.operators.prism import ABSENT, BITS, BREAKS, COLDEST, COOLING, GRAIN, HEATING, STAGES  # noqa: F401

NO_BREAK = (-2e9, -1e9, 1e9)


def _has(d: int) -> str:
    return "model IN (" + ", ".join(f"'{m}'" for m, own in BREAKS.items() if f"x{d}" in own.split()) + ")"


def _stage(k: int, before: str | None) -> str:
    """Tables h{k}: hinges of the stage's grid, and b{k}: the best breaks."""
    (step, reach), (step3, reach3) = STAGES[k]
    ends = [(f"greatest(low, {COLDEST})", "0.0"), *[(str(a), str(b)) for a, b in (HEATING, COOLING)]]
    if before:
        source = f"areas JOIN {before} USING (code)"
        around = f"CASE WHEN model = '4sg' THEN {reach3} ELSE {reach} END"
        ends = [(f"greatest({a}, x{d} - {around})", f"least({b}, x{d} + {around})") for d, (a, b) in enumerate(ends)]
    else:
        source = "areas, (SELECT unnest([" + ", ".join(f"'{m}'" for m in BREAKS) + "]) AS model)"
    ranges = " UNION ALL ".join(f"SELECT code, model, {d} AS d, ({a})::DOUBLE AS lo, ({b})::DOUBLE AS hi FROM {source} WHERE {_has(d)}" for d, (a, b) in enumerate(ends))
    size = f"CASE WHEN model = '4sg' THEN {step3} ELSE {step} END"
    none = " UNION ALL ".join(f"SELECT code, model, {d}, 0, {x}::DOUBLE, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0 FROM {source} WHERE NOT {_has(d)}" for d, x in enumerate(NO_BREAK))
    return f"""r{k} AS ({ranges}),
g{k} AS (SELECT code, model, d, i, lo + i * ({size})::DOUBLE AS x FROM (SELECT *, unnest(generate_series(0, floor((hi - lo) / ({size}) + 1e-6)::BIGINT)) AS i FROM r{k})),
x{k} AS (SELECT DISTINCT code, d = 2 AS up, x FROM g{k}),
s{k} AS (SELECT x.code, x.up, x.x, coalesce(sum(abs(x.x - a.t)), 0) AS h, coalesce(sum((x.x - a.t) ** 2), 0) AS q, coalesce(sum(abs(x.x - a.t) * a.y), 0) AS hy,
    count(a.t)::DOUBLE AS beyond, coalesce(sum(a.t), 0) AS bs, coalesce(sum(a.t * a.t), 0) AS bss
  FROM x{k} x LEFT JOIN rows a ON a.code = x.code AND CASE WHEN x.up THEN a.t > x.x ELSE a.t < x.x END GROUP BY 1, 2, 3),
h{k} AS (SELECT g.code, g.model, g.d, g.i, g.x, s.h, s.q - s.h * s.h / areas.n AS hh, s.hy, s.beyond, s.beyond AS bn, s.bs, s.bss
  FROM g{k} g JOIN s{k} s ON s.code = g.code AND s.x = g.x AND s.up = (g.d = 2) JOIN areas ON areas.code = g.code UNION ALL {none}),
c{k} AS ({_solved(f"h{k}")}),
b{k} AS (SELECT * FROM c{k} WHERE (model IN ('2ch', '2cl') OR (x0 < x1 - 1e-9 AND x1 <= x2)) AND level >= 0 AND kb >= 0 AND kc >= 0
  QUALIFY row_number() OVER (PARTITION BY code, model ORDER BY round(CASE WHEN yy > 0 THEN error / yy ELSE 0 END / {GRAIN})::BIGINT, i0, i1, i2) = 1)"""


def _solved(hinges: str) -> str:
    return f"""SELECT *, m - (ka * h0 + kb * h1 + kc * h2) / n AS level, greatest(yy - ka * y0 - kb * y1 - kc * y2, 0) AS error FROM (
  SELECT *, (p * y0 + q * y1 + r * y2) / det AS ka, (q * y0 + u * y1 + v * y2) / det AS kb, (r * y0 + v * y1 + w * y2) / det AS kc FROM (
  SELECT *, nullif(CASE WHEN aa > 0 AND bb > 0 AND cc > 0 AND aa * p + ab * q + ac * r > 1e-10 * aa * bb * cc THEN aa * p + ab * q + ac * r ELSE 0 END, 0) AS det FROM (
  SELECT *, bb * cc - bc * bc AS p, ac * bc - ab * cc AS q, ab * bc - ac * bb AS r, aa * cc - ac * ac AS u, ab * ac - aa * bc AS v, aa * bb - ab * ab AS w FROM (
  SELECT a.code, a.model, a.i AS i0, b.i AS i1, c.i AS i2, a.x AS x0, b.x AS x1, c.x AS x2, a.h AS h0, b.h AS h1, c.h AS h2, a.hy AS y0, b.hy AS y1, c.hy AS y2, a.hh AS aa, b.hh AS bb, c.hh AS cc,
    b.beyond AS beyond1, c.beyond AS beyond2, a.bn * a.x * b.x - (a.x + b.x) * a.bs + a.bss - a.h * b.h / o.n AS ab, -a.h * c.h / o.n AS ac, -b.h * c.h / o.n AS bc, o.n, o.m, o.yy
  FROM {hinges} a JOIN {hinges} b ON b.code = a.code AND b.model = a.model AND b.d = 1 JOIN {hinges} c ON c.code = a.code AND c.model = a.model AND c.d = 2 JOIN areas o ON o.code = a.code WHERE a.d = 0))))"""


def _density(k: int) -> str:
    """The F density at 0.05 for k and free degrees of freedom."""
    return "(1 + 0.1 / free) ** (-(free + 2) / 2)" if k == 2 else "free / 2 * (free / 2 + 1) * (4 / free) ** 2 * 0.05 * (1 + 0.2 / free) ** (-(2 + free / 2))"


def _better(a: str, b: str, k_a: int, k_b: int) -> str:
    free = f"greatest(n_points - {k_b} + 1, 1)::DOUBLE"
    return f"({b} IS NOT NULL AND ({a} IS NULL OR ({a} - {b}) / {k_b - k_a} / greatest({b} / {free}, 1e-9) > {_density(k_b - k_a).replace('free', free)}))"


def prism_sql(aligned: str) -> str:
    """Tables candidates and fits after one named by aligned (code, kwh, temperature)."""
    stages = ", ".join(_stage(k, f"b{k - 1}" if k else None) for k in range(len(STAGES)))
    last = f"b{len(STAGES) - 1}"
    cold, heat, cool = (_has(d) for d in range(3))
    return f"""levels AS (SELECT code, avg(kwh) AS m FROM {aligned} GROUP BY code),
rows AS (SELECT a.code, a.temperature AS t, a.kwh - l.m AS y FROM {aligned} a JOIN levels l ON l.code = a.code),
areas AS (SELECT r.code, count(*)::DOUBLE AS n, max(l.m) AS m, sum(r.y * r.y) AS yy, min(r.t) AS low, avg(r.t) AS mean_temp FROM rows r JOIN levels l ON l.code = r.code GROUP BY r.code HAVING count(*) >= 20 AND max(r.t) - min(r.t) >= 1e-6),
{stages},
solved AS (SELECT code, model, n, m, yy, error AS sse, CASE WHEN {cold} THEN x0 ELSE -10 END AS x0, CASE WHEN {heat} THEN x1 ELSE 10 END AS x1, CASE WHEN {cool} THEN x2 ELSE 20 END AS x2,
  level AS y1, -kb AS k1, kc AS k2, CASE WHEN {cold} THEN -kb - ka ELSE 0 END AS k0, CASE WHEN {cold} THEN level - kb * (x0 - x1) ELSE 0 END AS y0, beyond1, beyond2 FROM {last}),
candidates AS (SELECT *, (NOT {heat} OR (round(k1, 4) < 0 AND beyond1 > 5)) AND (NOT {cool} OR (round(k2, 4) > 0 AND beyond2 > 5)) AND (NOT {cold} OR k0 >= 0) AS valid FROM solved),
errors AS (SELECT code, max(n) AS n_points, {", ".join(f"max(CASE WHEN model = '{m}' THEN sse END) AS e_{m}, max(CASE WHEN model = '{m}' AND valid THEN sse END) AS v_{m}" for m in BREAKS)} FROM candidates GROUP BY code),
picked AS (SELECT *, CASE WHEN v_2ch IS NOT NULL AND v_2ch <= coalesce(v_2cl, 'inf'::DOUBLE) THEN '2ch' ELSE '2cl' END AS two, least(v_2ch, v_2cl) AS e2,
  CASE WHEN v_3sg IS NOT NULL AND v_3sg <= coalesce(v_3be, 'inf'::DOUBLE) THEN '3sg' ELSE '3be' END AS three, least(v_3sg, v_3be) AS e3 FROM errors),
named AS (SELECT *, CASE WHEN e3 IS NULL THEN two WHEN {_better("e2", "v_4sg", 3, 7)} OR {_better("e3", "v_4sg", 5, 7)} THEN '4sg' WHEN {_better("e2", "e3", 3, 5)} THEN three ELSE two END AS winner,
  least(e_2ch, e_2cl, e_3sg) AS least_allowed FROM picked),
chosen AS (SELECT code, n_points, CASE WHEN (winner = '2ch' AND e_2ch IS NOT NULL) OR (winner = '2cl' AND e_2cl IS NOT NULL) OR (winner = '3sg' AND e_3sg IS NOT NULL) THEN winner
  WHEN least_allowed IS NOT NULL THEN CASE least_allowed WHEN e_2ch THEN '2ch' WHEN e_2cl THEN '2cl' ELSE '3sg' END
  ELSE CASE WHEN winner = '3be' AND e_3be IS NOT NULL THEN '3be' WHEN winner = '4sg' AND e_4sg IS NOT NULL THEN '4sg' WHEN e_3be <= coalesce(e_4sg, 'inf'::DOUBLE) THEN '3be' ELSE '4sg' END END AS model FROM named),
fits AS (SELECT c.*, a.mean_temp, (SELECT count(*) FROM rows r WHERE r.code = c.code AND r.t <= c.x1) AS n_left, (SELECT count(*) FROM rows r WHERE r.code = c.code AND r.t > c.x1 AND r.t < c.x2) AS n_middle,
  (SELECT count(*) FROM rows r WHERE r.code = c.code AND r.t >= c.x2) AS n_right FROM candidates c JOIN chosen USING (code, model) JOIN areas a ON a.code = c.code)"""


PARTS = ", ".join(f"round({p}, 4) AS {p}" for p in ("x0", "x1", "x2", "y0", "y1", "k0", "k1", "k2"))
FITS = f"""code, model, n::BIGINT AS n_points, round(CASE WHEN yy > 0 THEN 1 - sse / yy ELSE 0 END, 6) AS r2, round(sqrt(sse / greatest(n - 3, 1)) / greatest(m, 1e-9), 6) AS cvrmse, round(sse, 3) AS sse,
  n_left, n_middle, n_right, {PARTS}, round(m, 6) AS mean_load, round(mean_temp, 6) AS mean_temp, round(sqrt(sse / (n - 1)), 6) AS resid_std"""
