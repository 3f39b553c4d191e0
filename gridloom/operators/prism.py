"""Segmented temperature response: piecewise-linear load with up to four segments, with SQL functions only.

With the break temperatures fixed a model is linear in hinges, so its least error follows from sums over the rows below each break. An area's rows
are summed by temperature, its temperatures sorted, and running sums kept as one array (a few hundred entries,
however many rows there are). Then any combination of breaks costs a constant: a search by halving for each break, and a
system of three equations. Breaks are searched on a coarse grid and then on a fine one around the best (STAGES). Combinations are
rows that combine to the best of each area and model before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.timeseries import align_weather
from gridloom.operators.weather_model import by_temperature, heating_change_point, hinge_fit, normalize_weather, per_capita
from gridloom.storage import stored

MODELS = ("2ch", "2cl", "3seg")
# Ranges of the heating and cooling breaks (the cold break is from COLDEST to 0), fewest points
# of a fit and, beyond a break, of a valid segment.
HEATING, COOLING, COLDEST = (2.0, 20.0), (15.0, 25.0), -40.0
LEAST_POINTS, BEYOND = 20, 5
PARAMETERS = ["x0", "x1", "x2", "y0", "y1", "k0", "k1", "k2"]
#: Breaks that a model doesn't have read as these.
ABSENT = {"x0": -10.0, "x1": 10.0, "x2": 20.0}
#: The breaks of each model: cold, heating and cooling.
BREAKS = {"2ch": "x1", "2cl": "x2", "3sg": "x1 x2", "3be": "x0 x1", "4sg": "x0 x1 x2"}
#: Step of the grid, and how far around the best of the grid before it (none: the whole range), by number of breaks under three and of three.
COARSE = 0.5
STAGES = [((COARSE, None), (2 * COARSE, None)), ((0.025, 0.5), (0.1, 1.0))]
#: Errors over the load's variation are told apart by so much; ties go to the lowest breaks, x0 first.
GRAIN = 1e-9
#: Bits that number the breaks of a grid: 2 ** 7 for each.
BITS = 7


def _responses(aligned: DataFrame, key: str, value: str, temperature: str) -> DataFrame:
    """A row per area (_key): its sums, and at: for each temperature in order, the sums over all rows up to it (load less its mean m)."""
    query = """
      SELECT _key, at, m, z.n, z.s, z.ss, z.y, z.ty, at[0].t AS low, greatest(raw - z.y * z.y / z.n, 0D) AS yy
      FROM (SELECT _key, sort_array(collect_list(own)) AS at, element_at(at, -1) AS z, sum(yy) AS raw, max(m) AS m
            FROM (SELECT _key, m, yy, named_struct('t', double(t), 'n', double(sum(n) OVER w), 's', sum(n * t) OVER w, 'ss', sum(n * t * t) OVER w, 'y', sum(y) OVER w, 'ty', sum(t * y) OVER w) AS own
                  FROM {rows} WINDOW w AS (PARTITION BY _key ORDER BY t ROWS UNBOUNDED PRECEDING))
            GROUP BY _key)
      WHERE z.n >= {least} AND z.t - at[0].t >= 1e-6"""
    rows = by_temperature(aligned, key, value, temperature).withColumnRenamed(key, "_key")
    return aligned.sparkSession.sql(query, rows=rows, least=LEAST_POINTS)


HALVES = "array(" + ", ".join(str(1 << b) for b in reversed(range(20))) + ")"
NOTHING = "named_struct('t', 0D, 'n', 0D, 's', 0D, 'ss', 0D, 'y', 0D, 'ty', 0D)"


def _below(x: str, including: bool) -> str:
    """The sums over the rows whose temperature is below x (or at it), found by halving."""
    sign = "<=" if including else "<"
    return f"coalesce(get(at, aggregate({HALVES}, 0, (i, j) -> CASE WHEN i + j <= size(at) AND get(at, i + j - 1).t {sign} {x} THEN i + j ELSE i END) - 1), {NOTHING})"


def _hinges(xs: str, left: bool) -> str:
    """What a break at each of xs contributes: its hinge's sum h, centred square hh and product with load hy, and how many rows lie beyond."""
    n, s, ss, y, ty = (f"b.{c}" if left else f"({c} - b.{c})" for c in ("n", "s", "ss", "y", "ty"))
    total, flip = (f"({n} * x - {s})", f"(x * {y} - {ty})") if left else (f"({s} - {n} * x)", f"({ty} - x * {y})")
    own = f"named_struct('x', x, 'h', {total}, 'hh', {n} * x * x - 2 * x * {s} + {ss} - {total} * {total} / n, 'hy', {flip} - {total} * y / n, 'beyond', {n}, 'bn', b.n, 'bs', b.s, 'bss', b.ss)"
    return f"transform({xs}, x -> transform(array({_below('x', not left)}), b -> {own})[0])"


def _no_hinge(x: float) -> str:
    return f"array(named_struct('x', {x}D, 'h', 0D, 'hh', 1D, 'hy', 0D, 'beyond', 0D, 'bn', 0D, 'bs', 0D, 'bss', 0D))"


def _has(name: str) -> str:
    return "model IN (" + ", ".join(f"'{m}'" for m, own in BREAKS.items() if name in own.split()) + ")"


#: Slopes of the hinges at a cold (a), a heating (b) and a cooling break (c), the level, and the error; null where the hinges depend on each other.
SOLVED = """
  SELECT *, m + (y - ka * a.h - kb * b.h - kc * c.h) / n AS level, greatest(yy - ka * a.hy - kb * b.hy - kc * c.hy, 0D) AS error
  FROM (SELECT *, (p * a.hy + q * b.hy + r * c.hy) / det AS ka, (q * a.hy + u * b.hy + v * c.hy) / det AS kb, (r * a.hy + v * b.hy + w * c.hy) / det AS kc
    FROM (SELECT *, CASE WHEN a.hh > 0 AND b.hh > 0 AND c.hh > 0 AND a.hh * p + ab * q + ac * r > 1e-10 * a.hh * b.hh * c.hh THEN a.hh * p + ab * q + ac * r END AS det
      FROM (SELECT *, b.hh * c.hh - bc * bc AS p, ac * bc - ab * c.hh AS q, ab * bc - ac * b.hh AS r, a.hh * c.hh - ac * ac AS u, ab * ac - a.hh * bc AS v, a.hh * b.hh - ab * ab AS w
        FROM (SELECT *, a.bn * a.x * b.x - (a.x + b.x) * a.bs + a.bss - a.h * b.h / n AS ab, -a.h * c.h / n AS ac, -b.h * c.h / n AS bc FROM {combined}))))"""


def _searched(areas: DataFrame, stage: int, around: DataFrame | None) -> DataFrame:
    """(_key, model, x0, x1, x2): the breaks of least error on a stage's grid, of those whose slopes and level have the right signs."""
    (step, reach), (step3, reach3) = STAGES[stage]
    ends = {"x0": (f"greatest(low, {COLDEST}D)", "0D"), "x1": tuple(f"{x}D" for x in HEATING), "x2": tuple(f"{x}D" for x in COOLING)}
    if around is None:
        source = "{areas} LATERAL VIEW explode(array(" + ", ".join(f"'{m}'" for m in BREAKS) + ")) AS model"
    else:
        source = "{areas} JOIN {around} USING (_key)"
        ends = {x: (f"greatest({a}, {x} - reach)", f"least({b}, {x} + reach)") for x, (a, b) in ends.items()}
    grid = {}
    for x, none in zip(ends, (-2e9, -1e9, 1e9), strict=True):
        xs = f"transform(sequence(0, n{x}), k -> l{x} + k * step)"
        grid[x] = f"CASE WHEN NOT {_has(x)} THEN {_no_hinge(none)} WHEN n{x} >= 0 THEN {_hinges(xs, x != 'x2')} END AS g{x}"
    query = f"""
      WITH sized AS (SELECT *, CASE WHEN model = '4sg' THEN {step3}D ELSE {step}D END AS step, CASE WHEN model = '4sg' THEN {reach3 or 0}D ELSE {reach or 0}D END AS reach FROM {source}),
      ranged AS (SELECT *, {", ".join(f"{a} AS l{x}, int(floor(({b} - {a}) / step + 1e-6)) AS n{x}" for x, (a, b) in ends.items())} FROM sized),
      grids AS (SELECT _key, model, n, y, m, yy, {", ".join(grid.values())} FROM ranged),
      every AS (SELECT *, explode(sequence(0, size(gx0) * size(gx1) * size(gx2) - 1)) AS k FROM grids WHERE gx0 IS NOT NULL AND gx1 IS NOT NULL AND gx2 IS NOT NULL),
      placed AS (SELECT _key, model, n, y, m, yy, k div (size(gx1) * size(gx2)) AS i, k div size(gx2) % size(gx1) AS j, k % size(gx2) AS l, gx0, gx1, gx2 FROM every),
      met AS (SELECT _key, model, n, y, m, yy, (i * {1 << BITS} + j) * {1 << BITS} + l AS place, get(gx0, int(i)) AS a, get(gx1, int(j)) AS b, get(gx2, int(l)) AS c FROM placed),
      solved AS ({SOLVED.format(combined="met")}),
      best AS (SELECT _key, model, min(CASE WHEN level >= 0 AND kb >= 0 AND kc >= 0 AND (model IN ('2ch', '2cl') OR (a.x < b.x - 1e-9 AND b.x <= c.x))
          THEN bigint(round(CASE WHEN yy > 0 THEN error / yy ELSE 0D END / {GRAIN})) * {1 << 3 * BITS} + place END) AS code FROM solved GROUP BY _key, model)
      SELECT _key, model, {", ".join(f"l{x} + (shiftright(code, {BITS * (2 - d)}) & {(1 << BITS) - 1}) * step AS {x}" for d, x in enumerate(ends))}
      FROM best JOIN (SELECT _key, model, step, lx0, lx1, lx2 FROM ranged) USING (_key, model) WHERE code IS NOT NULL"""
    frames = {"areas": areas} | ({"around": around} if around is not None else {})
    return areas.sparkSession.sql(query, **frames)


def prism_candidates(aligned: DataFrame, key: str = "code", value: str = "kwh", temperature: str = "temperature") -> DataFrame:
    """A row per area and model that has slopes of the right signs: model, valid, sse, the parameters, and the area's sums.

    valid: over BEYOND rows lie beyond each heating and cooling break, slopes aren't 0 and load doesn't rise again below the cold break.
    """
    tasks = int(aligned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    areas = stored(_responses(aligned, key, value, temperature), "responses").repartition(tasks, "_key")  # a few small files, but much work for each row
    best = None
    for stage in range(len(STAGES)):  # five rows an area
        best = stored(_searched(areas, stage, best), "breaks")
    cold, heat, cool = map(_has, ABSENT)
    own = ", ".join(f"CASE WHEN {_has(x)} THEN {_hinges(f'array({x})', x != 'x2')} ELSE {_no_hinge(0.0)} END[0] AS {h}" for x, h in zip(ABSENT, "abc", strict=True))
    slopes = {"k0": f"CASE WHEN {cold} THEN -kb - ka ELSE 0D END", "k1": "-kb", "k2": "kc", "y0": f"CASE WHEN {cold} THEN level - kb * (x0 - x1) ELSE 0D END", "y1": "level"}
    query = f"""
      WITH met AS (SELECT *, {own} FROM {{areas}} JOIN {{best}} USING (_key)),
      solved AS ({SOLVED.format(combined="met")}),
      named AS (SELECT * EXCEPT (x0, x1, x2), {", ".join(f"CASE WHEN {_has(x)} THEN {x} ELSE {none}D END AS {x}" for x, none in ABSENT.items())}, {", ".join(f"{v} AS {p}" for p, v in slopes.items())} FROM solved),
      sided AS (SELECT *, {_below("x1", True)}.n AS upto, {_below("x2", False)}.n AS before FROM named)
      SELECT _key AS `{key}`, model, (NOT {heat} OR (round(k1, 4) < 0 AND b.beyond > {BEYOND})) AND (NOT {cool} OR (round(k2, 4) > 0 AND c.beyond > {BEYOND})) AND (NOT {cold} OR k0 >= 0) AS valid,
        int(n) AS n_points, error AS sse, yy, {", ".join(f"round({p}, 4) + 0D AS {p}" for p in PARAMETERS)},
        int(upto) AS n_left, int(greatest(before - upto, 0D)) AS n_middle, int(n - before) AS n_right, m + y / n AS mean_load, s / n AS mean_temp FROM sided"""
    return aligned.sparkSession.sql(query, areas=areas, best=best)


def f_density(x: float, d1: int, d2: Column) -> Column:
    """The density of the F distribution for 2 or 4 degrees of freedom above, where it has a closed form."""
    if d1 == 2:
        return F.pow(1 + 2 * x / d2, -(d2 + 2) / 2)
    half = d2 / 2
    return half * (half + 1) * (4 / d2) * (4 / d2) * x * F.pow(1 + 4 * x / d2, -(2 + half))


def f_critical(level: float, d1: int, d2: Column) -> Column:
    """The value that an F variable with 2 or 4 degrees of freedom above exceeds with probability level; for 4 by halving."""
    if d1 == 2:
        return d2 / 2 * (F.pow(F.lit(level), -2 / d2) - 1)

    def exceeds(x: Column) -> Column:
        z = d2 / (d2 + 4 * x)
        return F.pow(z, d2 / 2) * (1 + d2 / 2 * (1 - z)) > level

    steps = F.array(*[F.lit(float(2.0**k)) for k in range(20, -40, -1)])
    return F.aggregate(steps, F.lit(0.0), lambda low, step: F.when(exceeds(low + step), low + step).otherwise(low))


def _chosen(models: tuple[str, ...], f_rule: str) -> Column:
    """The name of the model that wins among fits (a map from names), by the F rule; n_points is the number of rows."""

    def sse(name: str) -> Column:
        return F.col("fits")[name]["sse"]

    def pick(names: tuple[str, ...]) -> tuple[Column, Column]:
        """Of the valid ones the least error and its model; infinity and the last without any."""
        found = F.lit(float("inf"))
        name = F.lit(names[-1])
        for m in reversed(names):
            own = F.when(F.col("fits")[m]["valid"], sse(m))
            name = F.when(own <= found, F.lit(m)).otherwise(name)
            found = F.when(own <= found, own).otherwise(found)
        return name, found

    def better(a: Column, b: Column, k_a: int, k_b: int) -> Column:
        free = F.greatest(F.col("n_points") - k_b + 1, F.lit(1)).cast("double")
        least = f_density(0.05, k_b - k_a, free) if f_rule == "pdf" else f_critical(0.05, k_b - k_a, free)
        return (b < float("inf")) & ((a - b) / (k_b - k_a) / F.greatest(b / free, F.lit(1e-9)) > least)

    def least(names: list[str]) -> Column:
        rows = [F.when(sse(m).isNotNull(), F.struct(sse(m).alias("sse"), F.lit(k).alias("k"), F.lit(m).alias("m"))) for k, m in enumerate(names)]
        return F.array_min(F.array(*rows))["m"]

    (two, e2), (three, e3), (four, e4) = pick(("2ch", "2cl")), pick(("3sg", "3be")), pick(("4sg",))
    to_three = better(e2, e3, 3, 5)
    to_four = better(e2, e4, 3, 7) | better(e3, e4, 5, 7)
    name = F.when(e3 == float("inf"), two).when(to_four, four).when(to_three, three).otherwise(two)
    allowed = sorted({m.replace("3seg", "3sg") for m in models})
    has = F.map_contains_key("fits", name)
    own = F.coalesce(*[F.when(F.map_contains_key("fits", F.lit(m)), True) for m in allowed], F.lit(False))
    return F.when(has & name.isin(allowed), name).when(own, least(allowed)).when(has, name).otherwise(least(list(BREAKS)))


def prism_fit(
    aligned: DataFrame,
    models: tuple[str, ...] = MODELS,
    f_rule: str = "pdf",
    key: str = "code",
    value: str = "kwh",
    temperature: str = "temperature",
) -> DataFrame:
    """Per area the chosen model with its parameters and errors, and all candidates; areas with under LEAST_POINTS points, a constant temperature or no model that fits give none.

    More segments win if the F statistic exceeds a threshold: with f_rule "pdf" the density at 0.05
    (a very lenient rule, kept for equal choices), with "critical" the 5 % critical value. If the winner isn't
    among models the allowed candidate of least error replaces it.
    """
    found = prism_candidates(aligned, key, value, temperature)
    mean = F.greatest(F.col("mean_load"), F.lit(1e-9))
    fit = found.withColumn("cvrmse", F.sqrt(F.col("sse") / F.greatest(F.col("n_points") - 3, F.lit(1))) / mean)
    parts = ["sse", "cvrmse", "valid", "n_left", "n_middle", "n_right", *PARAMETERS]
    same = ["n_points", "yy", "mean_load", "mean_temp"]
    one = fit.groupBy(key, *same).agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct(*parts)))).alias("fits"))  # five entries at most
    one = one.withColumn("model", _chosen(models, f_rule)).withColumn("own", F.element_at("fits", F.col("model")))
    sse = F.col("own.sse")
    candidates = F.transform_values("fits", lambda _, c: F.struct(F.array(*[c[p] for p in PARAMETERS]).alias("p"), c["sse"].alias("sse"), c["cvrmse"].alias("cvrmse")))
    return one.select(
        key,
        "model",
        "n_points",
        F.when(F.col("yy") > 0, 1 - sse / F.col("yy")).otherwise(0.0).alias("r2"),
        F.col("own.cvrmse").alias("cvrmse"),
        sse.alias("sse"),
        *[F.col(f"own.{c}").alias(c) for c in ("n_left", "n_middle", "n_right", *PARAMETERS)],
        "mean_load",
        "mean_temp",
        F.sqrt(sse / (F.col("n_points") - 1)).alias("resid_std"),
        candidates.alias("candidates"),
    )


def prism_predict(temperature: Column, model: Column, p: dict[str, Column]) -> Column:
    """Load at a temperature for parameters of a fit; an unknown model reads as three segments with clamped slopes and breaks."""
    t, zero = temperature, F.lit(0.0)
    x2 = F.greatest(p["x2"], p["x1"])
    heat = F.least(p["k1"], zero) * F.least(t - p["x1"], zero)
    cool = F.greatest(p["k2"], zero)
    cold = p["y0"] + p["k0"] * (t - p["x0"])
    two_cool = p["y1"] + cool * F.greatest(t - p["x2"], zero)
    three = p["y1"] + heat + cool * F.greatest(t - x2, zero)
    return (
        F.when(model == "2ch", p["y1"] + heat)
        .when(model == "2cl", two_cool)
        .when(model.isin("3be", "4sg") & (t <= p["x0"]), cold)
        .when(model == "3be", p["y1"] + heat)
        .otherwise(three)
    )


def prism_curve(fits: DataFrame, low: float, high: float, points: int = 300, key: str = "code") -> DataFrame:
    """(key, temperature, fitted, lower, upper) on an even grid; the band is 1.96 standard deviations of the residuals."""
    step = (high - low) / (points - 1)
    t = F.lit(low) + F.col("i") * F.lit(step)
    y = prism_predict(F.col("temperature"), F.col("model"), {p: F.col(p) for p in PARAMETERS})
    grid = fits.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("temperature", t).withColumn("fitted", y)
    band = 1.96 * F.col("resid_std")
    return grid.select(key, "temperature", "fitted", (F.col("fitted") - band).alias("lower"), (F.col("fitted") + band).alias("upper"))


def prism_grid(
    aligned: DataFrame, step: float = COARSE, key: str = "code", value: str = "kwh", temperature: str = "temperature"
) -> DataFrame:
    """The best heating ("2ch") and cooling ("2cl") model of each area with SQL functions only: every break against every temperature, by which rows are summed first."""
    summed, t = by_temperature(aligned, key, value, temperature), F.col("t")

    def side(name: str, ends: tuple[float, float], hinge: Column) -> DataFrame:
        n = round((ends[1] - ends[0]) / step)
        grid = F.array(*[F.lit(ends[0] + step * k) for k in range(n + 1)])
        rows = summed.withColumn("x", F.explode(grid)).withColumn("h", F.greatest(hinge, F.lit(0.0)))
        fit = hinge_fit(rows, key, "x")
        valid = fit.where((F.col("slope") > 0) & (F.col("level") >= 0) & (F.col("beyond") > BEYOND))
        best = Window.partitionBy(key).orderBy(F.round("sse", 6), "x")
        return valid.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, F.lit(name).alias("model"), F.col("x").alias("break_temp"), F.col("level").alias("baseload"), "slope", "sse")

    return side("2ch", HEATING, F.col("x") - t).unionByName(side("2cl", COOLING, t - F.col("x")))


def prism_table(
    load: DataFrame,
    weather: DataFrame,
    population: DataFrame | None = None,
    mode: str = "segmented",
    normalize_first: bool = False,
    city: str | None = None,
    key: str = "code",
    ts: str = "ts",
    value: str = "kwh",
    **options,
) -> DataFrame:
    """Fits of all areas, steepest heating first; load optionally normalised for weather, then divided by population.

    With city, load and weather have such a column and each area meets its own city's weather.
    """
    df = load.select(key, ts, value, *[city] * bool(city))
    if normalize_first:
        df = normalize_weather(df, align_weather(df, weather, key, ts, value, city=city), key, ts, value)
    if population is not None:
        df = per_capita(df, population, True, key, value)
    aligned = align_weather(df, weather, key, ts, value, city=city)
    if mode == "heating_only":
        return heating_change_point(aligned, key=key, value=value).orderBy(F.desc("heating_slope"))
    if mode != "segmented":
        raise ValueError("mode must be 'segmented' or 'heating_only'")
    fits = prism_fit(aligned, key=key, value=value, **options)
    named = fits.withColumns(
        {
            "heating_change_point_temp_c": F.col("x1"),
            "baseload_intercept": F.col("y1"),
            "heating_slope_per_hdd": -F.col("k1"),
            "cooling_slope_per_cdd": F.col("k2"),
        }
    )
    return named.orderBy(F.desc("heating_slope_per_hdd"))
