"""The driver tables as the library's logical inputs, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.columns import hour_of
from gridloom.operators.census import POPULATION


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_hourly(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("event_type").alias("code"), hour_of("ts").alias("ts"), "value")
    return events.groupBy("code", "ts").agg(F.sum("value").alias("kwh"))


def load_gappy(spark: SparkSession, d: str) -> DataFrame:
    return load_hourly(spark, d).where((F.hour("ts") + F.dayofmonth("ts")) % 7 != 0)


def load_user(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").alias("code"), hour_of("ts").alias("ts"), "value")
    return events.groupBy("code", "ts").agg(F.sum("value").alias("kwh"))


def load_daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("code"), F.col("l_shipdate").alias("ts")).agg(F.sum("l_quantity").alias("kwh"))


def weather_hourly(spark: SparkSession, d: str) -> DataFrame:
    hours = table(spark, d, "events").select(hour_of("ts").alias("ts")).distinct()
    t = (F.dayofyear("ts") * 7 + F.hour("ts") * 3) % 40 - 15
    return hours.select("ts", t.cast("double").alias("temperature"))


def weather_sparse(spark: SparkSession, d: str) -> DataFrame:
    return weather_hourly(spark, d).where(F.hour("ts") % 6 == 0)


def census_long(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    wide = c.select(
        F.col("c_custkey").alias("code"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"),
        (F.col("c_custkey") * 7 % 31).cast("double").alias("index31"),
        F.when(F.col("c_custkey") % 3 > 0, (F.col("c_custkey") % 11).cast("double")).alias("sparse"),
        (100 + F.col("c_custkey") % 97).cast("double").alias(POPULATION),
    )
    return wide.unpivot(["code"], ["balance", "nation", "index31", "sparse", POPULATION], "feature", "value")


def areas(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    cx = (F.col("n_nationkey") % 5 * 10).cast("double")
    cy = (F.floor(F.col("n_nationkey") / 5) * 10).cast("double")
    at = lambda dx, dy: F.struct((cx + dx).alias("x"), (cy + dy).alias("y"))
    ring = F.array(at(-5, -5), at(5, -5), at(5, 5), at(-5, 5))
    return n.select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("code"), F.array(ring).alias("rings"), cx.alias("cx"), cy.alias("cy"))


def small_areas(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias("code"),
        (F.col("s_suppkey") * 13 % 47).cast("double").alias("cx"),
        (F.col("s_suppkey") * 29 % 43).cast("double").alias("cy"),
    )


def raw_buildings(spark: SparkSession, d: str) -> DataFrame:
    """Sources of buildings as their files name the columns; every seventh id is there twice, cells complementing each other."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit(" B"), k.cast("string"), F.lit(" ")).alias("ID_UEV"),
        F.when(k % 5 > 0, (1900 + k % 120).cast("string")).otherwise(F.lit("n/a")).alias("ANNEE_CONS"),
        F.when(k % 4 > 0, F.col("p_type")).alias("LIBELLE_UT"),
        F.col("p_brand").alias("g_usag_pre"),
        F.col("p_brand").alias("BuildingCategory"),
        F.col("p_size").cast("string").alias("ETAGE_HORS"),
        F.col("p_retailprice").alias("TotalFloorArea"),
        (k % 50).cast("double").alias("Z_Min"),
        F.when(k % 6 > 0, (k % 50 + 3 + F.col("p_size")).cast("double")).alias("Z_Max"),
        F.lit(4.5).alias("Hieght_LiD"),
    )


def building_points(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("building_id"),
        (F.col("p_partkey") * 17 % 601 / 10 - 7).alias("cx"),
        (F.col("p_partkey") * 31 % 557 / 10 - 6).alias("cy"),
    )


def day_labels(spark: SparkSession, d: str) -> DataFrame:
    days = load_hourly(spark, d).select("code", F.to_date("ts").alias("date")).distinct()
    return days.withColumn("cluster_label", F.concat(F.lit("c"), (F.dayofmonth("date") * 5 % 7 % 3).cast("string")))


def people(spark: SparkSession, d: str) -> DataFrame:
    return census_long(spark, d).where(F.col("feature") == POPULATION).select("code", F.col("value").alias("population"))


SQL = {
    "load_hourly": "SELECT event_type AS code, date_trunc('hour', ts) AS ts, sum(value) AS kwh FROM events GROUP BY 1, 2",
    "load_gappy": "SELECT * FROM load_hourly WHERE (hour(ts) + dayofmonth(ts)) % 7 <> 0",
    "load_user": "SELECT user_id AS code, date_trunc('hour', ts) AS ts, sum(value) AS kwh FROM events GROUP BY 1, 2",
    "load_daily": "SELECT l_suppkey AS code, l_shipdate AS ts, sum(l_quantity) AS kwh FROM lineitem GROUP BY 1, 2",
    "weather_hourly": "SELECT ts, ((dayofyear(ts) * 7 + hour(ts) * 3) % 40 - 15)::DOUBLE AS temperature FROM (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events)",
    "weather_sparse": "SELECT * FROM weather_hourly WHERE hour(ts) % 6 = 0",
    "grid": """SELECT c.code, g.ts FROM (SELECT DISTINCT code FROM load_gappy) c,
        (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM load_gappy) g""",
    "full_load": "SELECT g.code, g.ts, l.kwh FROM grid g LEFT JOIN load_gappy l ON g.code = l.code AND g.ts = l.ts",
    "aligned": "SELECT l.code, l.ts, l.kwh, w.temperature FROM load_hourly l JOIN weather_hourly w ON l.ts = w.ts",
    "census": f"""SELECT c_custkey AS code, unnest(['balance', 'nation', 'index31', 'sparse', '{POPULATION}']) AS feature,
        unnest([c_acctbal, c_nationkey::DOUBLE, (c_custkey * 7 % 31)::DOUBLE, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 11)::DOUBLE END, (100 + c_custkey % 97)::DOUBLE]) AS value FROM customer""",
    "areas": "SELECT lpad(n_nationkey::VARCHAR, 2, '0') AS code, (n_nationkey % 5 * 10)::DOUBLE AS cx, (n_nationkey // 5 * 10)::DOUBLE AS cy FROM nation",
    "small_areas": "SELECT s_suppkey::VARCHAR AS code, (s_suppkey * 13 % 47)::DOUBLE AS cx, (s_suppkey * 29 % 43)::DOUBLE AS cy FROM supplier",
    "points": "SELECT 'B' || p_partkey AS building_id, (p_partkey * 17 % 601) / 10.0::DOUBLE - 7 AS cx, (p_partkey * 31 % 557) / 10.0::DOUBLE - 6 AS cy FROM part",
    "standard": """SELECT 'B' || p_partkey AS building_id, CASE WHEN p_partkey % 4 > 0 THEN p_type ELSE p_brand END AS building_type, p_brand AS building_category,
        CASE WHEN p_partkey % 5 > 0 THEN 1900 + p_partkey % 120 END AS year_built, p_size::BIGINT AS stories, p_retailprice AS total_floor_area,
        CASE WHEN p_partkey % 6 > 0 THEN (3 + p_size)::DOUBLE ELSE 4.5 END AS height_m, p_partkey FROM part""",
    "labels_of_days": "SELECT DISTINCT code, ts::DATE AS date, 'c' || (dayofmonth(ts) * 5 % 7 % 3) AS cluster_label FROM load_hourly",
}
NEEDS = {
    "load_gappy": ["load_hourly"],
    "weather_sparse": ["weather_hourly"],
    "grid": ["load_gappy"],
    "full_load": ["grid", "load_gappy"],
    "aligned": ["load_hourly", "weather_hourly"],
    "labels_of_days": ["load_hourly"],
}


def with_tables(names: str, body: str) -> str:
    """body after the named tables and those that they need; body may begin with more tables and a comma between."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    return f"WITH {head}{', ' if not body.lstrip().upper().startswith('SELECT') else ' '}{body}"
