"""Census predictors of load, imputation of areas without load from similar ones, and its evaluation.

Tables: census (code, feature, value) long, load (code, ts, kwh). What is compared pair by pair is
targets times donors (areas, not load rows): an area's selected features (at most max_features) are one
array, blocks of targets meet blocks of donors in grouped maps, each of which searches a tree of its donors, and only the nearest donor of a block leaves it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.columns import correlation, month_of
from gridloom.operators.timeseries import AGGREGATES, monthly_energy
from gridloom.storage import stored

#: Fixed value: the feature of census files that counts people.
POPULATION = "Population and dwelling counts / Population, 2021"
#: Areas without load of a block that meets a block of donors in one task, and donors of such a block: a search takes hardly longer in a larger tree.
BLOCK, DONORS = 5000, 50_000


def select_features(
    census: DataFrame,
    load: DataFrame,
    method: str = "spearman",
    max_features: int = 20,
    min_coverage: float = 0.8,
    min_distinct: int = 5,
    min_pairs: int = 8,
    min_areas: int = 5,
    how: str = "sum",
    candidates: list[str] | None = None,
    key: str = "code",
) -> DataFrame:
    """(feature, score, n_months): features by mean absolute correlation with monthly load over months, best first.

    Only areas count that have load and are in the census; candidates limits the features. A feature needs values for enough areas and enough distinct ones; a
    month needs min_pairs areas with both. Ties go by name. Fewer than min_areas such areas are an error when the rows are made.
    """
    if method not in ("spearman", "pearson"):
        raise ValueError("method must be 'spearman' or 'pearson'")
    if how not in ("sum", "mean"):
        raise ValueError("how must be 'sum' or 'mean'")
    by_month = stored(load.groupBy(key, month_of("ts").alias("ts")).agg(AGGREGATES[how]("kwh").alias("kwh")), "months")  # a row per area and month; load may be long
    monthly = monthly_energy(by_month, how, key)
    codes = monthly.select(key).distinct().join(census.select(key).distinct(), key, "left_semi")
    n = codes.agg(F.count(F.lit(1)).alias("areas"))
    own = census.where(F.col("value").isNotNull()).join(codes, key, "left_semi")
    if candidates is not None:
        own = own.where(F.col("feature").isin(candidates))
    too_few = F.raise_error(F.lit(f"features need {min_areas} areas with load in the census")).cast("boolean")
    good = (
        own.groupBy("feature")
        .agg(F.count_distinct(key).alias("have"), F.count_distinct("value").alias("kinds"))
        .join(F.broadcast(n))
        .where(F.when(F.col("areas") < min_areas, too_few).otherwise((F.col("have") / F.col("areas") >= min_coverage) & (F.col("kinds") >= min_distinct)))
    )
    pairs = own.join(good.select("feature"), "feature").join(monthly.where(F.col("kwh").isNotNull()), key).select("feature", "ts", F.col("value").alias("x"), F.col("kwh").alias("y"))
    if method == "spearman":
        pairs = pairs.select("feature", "ts", *[_rank(c).alias(c) for c in ("x", "y")])
    by_month = pairs.groupBy("feature", "ts").agg(F.abs(correlation("x", "y")).alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pairs)
    scores = by_month.where(F.col("r").isNotNull() & ~F.isnan("r")).groupBy("feature").agg(F.avg("r").alias("score"), F.count(F.lit(1)).alias("n_months"))
    return scores.orderBy(F.desc("score"), "feature").limit(max_features)


def _rank(column: str) -> Column:
    month = Window.partitionBy("feature", "ts")
    ties = Window.partitionBy("feature", "ts", column)
    return F.rank().over(month.orderBy(column)) + (F.count(F.lit(1)).over(ties) - 1) / 2


def donor_distance(census: DataFrame, features: DataFrame, targets: DataFrame, donors: DataFrame, key: str = "code") -> DataFrame:
    """(code, donor, distance): weighted distance of standardised features between targets and donors.

    Standardised by the donors' mean and deviation; features without deviation, or missing for the
    target, don't count, and weights (scores) are shared among the rest. A feature that the donor
    lacks adds nothing to its distance.
    """
    own = census.where(F.col("value").isNotNull()).join(F.broadcast(features.select("feature", "score")), "feature")
    given = own.join(donors.select(key), key, "left_semi")
    spread = given.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).where(F.col("s") > 0)
    z = (F.col("value") - F.col("m")) / F.col("s")
    d = given.join(spread, "feature").select(F.col(key).alias("donor"), "feature", z.alias("zd"))
    t = own.join(targets.select(key), key, "left_semi").join(spread, "feature").select(key, "feature", "score", z.alias("zt"))
    weighted = t.withColumn("w", F.col("score") / F.sum("score").over(Window.partitionBy(key)))
    return weighted.join(d, "feature").groupBy(key, "donor").agg(F.sqrt(F.sum(F.col("w") * (F.col("zd") - F.col("zt")) ** 2)).alias("distance"))


def _vectors(census: DataFrame, features: DataFrame, donors: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(key, z, w): standardised values and scores of features in one order, NaN where missing or without deviation; and how many."""
    own = census.where(F.col("value").isNotNull()).join(F.broadcast(features.select("feature", "score")), "feature")
    given = own.join(donors.select(key), key, "left_semi")
    spread = given.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.max("score").alias("score")).where(F.col("s") > 0)
    names = sorted({r[0] for r in features.select("feature").collect()})  # at most max_features
    if not names:
        return census.select(key).limit(0), 0
    z = (F.col("value") - F.col("m")) / F.col("s")
    rows = own.select(key, "feature", "value").join(F.broadcast(spread), "feature")
    wide = rows.groupBy(key).pivot("feature", names).agg(F.avg(z).alias("z"), F.max("score").alias("w"))
    nan = F.lit(float("nan"))
    arrays = [F.array(*[F.coalesce(F.col(f"`{n}_{c}`"), nan if c == "z" else F.lit(0.0)) for n in names]).alias(c) for c in ("z", "w")]
    return wide.select(key, *arrays), len(names)


class DonorIndex:
    """Donors in leaves of a kd-tree with their boxes, for distances whose weights and features differ by target.

    A feature that a donor lacks adds nothing to its distance, so it bounds nothing in that donor's leaf; a target's weights multiply the
    gaps between it and a box, which therefore bound its distance to all donors of the leaf from below.
    """

    LEAF, DIGITS = 32, 9

    def __init__(self, z: np.ndarray):
        self.missing, self.z = np.isnan(z), np.nan_to_num(z)
        self.leaves, stack = [], [np.arange(len(z))]
        while stack:
            own = stack.pop()
            if len(own) <= self.LEAF:
                self.leaves.append(np.sort(own))
                continue
            axis, m = int(np.ptp(self.z[own], axis=0).argmax()), len(own) // 2
            own = own[np.argpartition(self.z[own, axis], m)]
            stack += [own[m:], own[:m]]
        known = [~self.missing[leaf].any(0) for leaf in self.leaves]
        self.low = np.array([np.where(k, self.z[leaf].min(0), -np.inf) for k, leaf in zip(known, self.leaves, strict=True)])
        self.high = np.array([np.where(k, self.z[leaf].max(0), np.inf) for k, leaf in zip(known, self.leaves, strict=True)])

    def distances(self, own: np.ndarray, w: np.ndarray, donors: np.ndarray) -> np.ndarray:
        """(targets, donors): infinite where they have no feature in common."""
        use = ~np.isnan(own)[:, None, :] & ~self.missing[None, donors]
        off = self.z[None, donors] - np.nan_to_num(own)[:, None]
        square = np.where(use, w[:, None] * off**2, 0.0).sum(2)
        return np.where(use.any(2), np.sqrt(square), np.inf)

    def nearest(self, own: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The donor of least distance of each target (by DIGITS digits, the first on ties), the distance, and how many pairs were computed."""
        w = np.where(np.isnan(own), 0.0, w)
        total = w.sum(1, keepdims=True)
        w = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
        here = np.nan_to_num(own)
        bound = np.zeros((len(own), len(self.leaves)))
        for k in range(own.shape[1]):
            gap = np.maximum(np.maximum(self.low[None, :, k] - here[:, k, None], here[:, k, None] - self.high[None, :, k]), 0.0)
            bound += w[:, k, None] * gap**2
        bound = np.sqrt(bound)
        order = np.argsort(bound, axis=1, kind="stable")
        best, far, exact = np.zeros(len(own), np.int64), np.full(len(own), np.inf), np.full(len(own), np.inf)
        active, pairs = np.arange(len(own)), 0
        for step in range(len(self.leaves)):
            leaf = order[active, step]
            on = bound[active, leaf] <= far[active] + 2 * 10.0**-self.DIGITS
            active, leaf = active[on], leaf[on]  # the rest of a target's leaves is farther still
            if not len(active):
                break
            for c in np.unique(leaf):
                who, donors = active[leaf == c], self.leaves[c]
                d = self.distances(own[who], w[who], donors)
                pairs += d.size
                near = np.round(d, self.DIGITS)
                at = near.argmin(1)  # the first of equal ones; a leaf's donors are in order
                rows = np.arange(len(who))
                better = (near[rows, at] < far[who]) | ((near[rows, at] == far[who]) & (donors[at] < best[who]) & np.isfinite(far[who]))
                moved = who[better]
                best[moved], far[moved], exact[moved] = donors[at][better], near[rows, at][better], d[rows, at][better]
        return best, exact, pairs


def nearest_donor(census: DataFrame, features: DataFrame, targets: DataFrame, donors: DataFrame, key: str = "code") -> DataFrame:
    """For tables of targets and donors without repeats, (key, donor, distance) of the donor of least distance (as donor_distance; told by 9 digits, ties to the first donor) for each target that has one."""
    kind = census.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, donor {kind}, distance double"
    vectors, n = _vectors(census, features, donors, key)
    if not n:
        return census.sparkSession.createDataFrame([], schema)
    vectors = stored(vectors, "vectors")
    givers = vectors.join(donors.select(key).distinct(), key, "left_semi")
    again = vectors.select(*[F.col(c).alias(c) for c in vectors.columns])  # columns of its own, as both sides meet below
    askers = again.join(targets.select(key).distinct(), key, "left_semi")
    shards, blocks = (max(1, -(-x.count() // n)) for x, n in ((donors, DONORS), (targets, BLOCK)))
    draw = lambda n: F.pmod(F.xxhash64(key), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    givers = givers.withColumn("shard", draw(shards)).withColumn("block", every(blocks))
    askers = askers.withColumn("block", draw(blocks)).withColumn("shard", every(shards))

    def nearest(given: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(given) or not len(asking):
            none = asking[[key]].iloc[:0]
            return none.assign(donor=none[key], distance=0.0)
        given = given.sort_values(key)
        index = DonorIndex(np.stack(given["z"].to_numpy()))
        rows = []
        for a in range(0, len(asking), 1000):
            part = asking.iloc[a : a + 1000]
            best, found, _ = index.nearest(np.stack(part["z"].to_numpy()), np.stack(part["w"].to_numpy()))
            rows.append(pd.DataFrame({key: part[key].to_numpy(), "donor": given[key].to_numpy()[best], "distance": found})[np.isfinite(found)])
        return pd.concat(rows)

    found = givers.groupBy("shard", "block").cogroup(askers.groupBy("shard", "block")).applyInPandas(nearest, schema)
    near = F.struct(F.round("distance", 9).alias("near"), "donor", "distance")
    return found.groupBy(key).agg(F.min(near).alias("b")).select(key, "b.donor", "b.distance")


def impute_by_census(
    load: DataFrame,
    census: DataFrame,
    areas: DataFrame,
    features: DataFrame | None = None,
    population_scaling: bool = True,
    population: str = POPULATION,
    scale_clip: tuple[float, float] = (0.5, 2.0),
    key: str = "code",
    ts: str = "ts",
    value: str = "kwh",
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(load with imputed areas, report) for areas without load: the nearest donor's series times the ratio of populations.

    population names the census feature; more options go to select_features. The ratio is kept within scale_clip and is 1 if either population is missing; of several populations of
    an area the least counts. Ties go to the first donor in order. Features and report are stored. Report: code, donor, distance, scale, status (imputed, missing_census, no_comparable_donor).
    """
    both = load.select(key, F.lit(True).alias("given")).unionByName(areas.select(key, F.lit(False).alias("given")))
    both = stored(both.groupBy(key).agg(F.max("given").alias("given")), "areas")  # a row per area; load may be long to make
    donors, targets = both.where("given").select(key), both.where("not given").select(key)
    if features is None:
        features = select_features(census, load, key=key, **options)
    features = stored(features, "features")
    best = nearest_donor(census, features, targets, donors, key)
    people = census.where(F.col("feature") == population).groupBy(key).agg(F.min("value").alias("people"))
    known = census.select(key).distinct().withColumn("has_census", F.lit(True))
    report = (
        targets.join(known, key, "left")
        .join(best, key, "left")
        .join(people.withColumnRenamed("people", "own"), key, "left")
        .join(people.select(F.col(key).alias("donor"), F.col("people").alias("other")), "donor", "left")
    )
    ratio = F.col("own") / F.nullif("other", F.lit(0.0))
    scale = F.least(F.greatest(ratio, F.lit(scale_clip[0])), F.lit(scale_clip[1])) if population_scaling else F.lit(1.0)
    status = F.when(F.col("has_census").isNull(), "missing_census").when(F.col("donor").isNull(), "no_comparable_donor").otherwise("imputed")
    report = report.select(key, "donor", "distance", F.when(F.col("donor").isNotNull(), F.coalesce(scale, F.lit(1.0))).alias("scale"), status.alias("status"))
    report = stored(report, "report")
    copied = (
        load.select(F.col(key).alias("donor"), ts, value)
        .join(report.where("status = 'imputed'").select(key, "donor", "scale"), "donor")
        .select(key, ts, (F.col(value) * F.col("scale")).alias(value))
    )
    return load.select(key, ts, value).unionByName(copied), report


def error_metrics(pairs: DataFrame, by: list[str], truth: str = "truth", predicted: str = "predicted", eps: float = 1e-9) -> DataFrame:
    """Per group: n_obs, mae, rmse, mbe, mape_pct (where the truth is eps or more), corr (two pairs or more); pairs with a null don't count."""
    t, p = F.col(truth), F.col(predicted)
    both = t.isNotNull() & p.isNotNull()
    e = F.when(both, p - t)
    n = F.count(e)
    return pairs.groupBy(*by).agg(
        n.alias("n_obs"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("mbe"),
        (100 * F.avg(F.when(both & (F.abs(t) >= eps), F.abs(e) / F.abs(t)))).alias("mape_pct"),
        F.when(n >= 2, correlation(F.when(both, t), F.when(both, p))).alias("corr"),
    )


def holdout_codes(codes: list[str], fraction: float = 0.1, n: int | None = None, seed: int = 42) -> list[str]:
    """A seeded choice of area codes; areas are few, load rows aren't touched."""
    size = n if n is not None else max(1, round(len(codes) * fraction))
    return sorted(np.random.default_rng(seed).choice(sorted(codes), size=size, replace=False).tolist())


def evaluate_holdout(
    load: DataFrame, census: DataFrame, areas: DataFrame, holdout: list[str] | DataFrame, key: str = "code", ts: str = "ts", value: str = "kwh", **options
) -> tuple[DataFrame, DataFrame]:
    """(hourly, monthly) error metrics by code of the imputation of areas whose load is withheld.

    holdout is a list of codes, or a table of them. A withheld area that isn't among areas gets no prediction (n_obs 0). Monthly sums count missing hours as 0.
    """
    if not isinstance(holdout, DataFrame):
        holdout = load.sparkSession.createDataFrame([(c,) for c in holdout], load.select(key).schema)
    held = holdout.select(key).distinct()
    truth, rest = load.join(held, key, "left_semi"), load.join(held, key, "left_anti")
    filled, _ = impute_by_census(rest, census, areas, key=key, ts=ts, value=value, **options)
    predicted = filled.join(held, key, "left_semi")
    hourly = truth.select(key, ts, F.col(value).alias("truth")).join(predicted.select(key, ts, F.col(value).alias("predicted")), [key, ts], "left")
    month = F.date_trunc("month", ts).cast("timestamp_ntz").alias(ts)
    sums = [
        x.groupBy(key, month).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(name)) for x, name in ((truth, "truth"), (predicted, "predicted"))
    ]
    return error_metrics(hourly, [key]), error_metrics(sums[0].join(sums[1], [key, ts], "left"), [key])


def column_hierarchy(names: DataFrame, column: str = "name") -> DataFrame:
    """(id, parent, label, depth, n_columns) for every prefix of names that ' / ' parts."""
    parts = F.split(column, r"\s*/\s*")
    paths = names.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    prefix = F.array_join(F.slice("p", F.lit(1), F.col("depth")), " / ")
    up = F.when(F.col("depth") > 1, F.array_join(F.slice("p", F.lit(1), F.col("depth") - 1), " / ")).otherwise("")
    return paths.groupBy(prefix.alias("id"), up.alias("parent"), F.get("p", F.col("depth") - 1).alias("label"), F.col("depth").cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n_columns"))
