import datetime as dt
import json

from pyspark.sql import functions as F

from gridloom.config import Paths
from gridloom.sources.project import load_project
from gridloom.streaming.daily import daily_peaks, write_daily_peaks
from tests.test_timeseries import START, series


def feature(key, code, x):
    ring = [[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]
    return {"type": "Feature", "properties": {key: code}, "geometry": {"type": "Polygon", "coordinates": [ring]}}


def test_project(spark, tmp_path):
    raw = [("H1A", "2024-01-02 12:00:00", 1.0), ("H1A", "2024-01-02 12:00:00", 2.0), ("H9Z", "2024-01-02 12:00:00", 5.0)]
    spark.createDataFrame(raw, "CP3 string, DateIntervalUTC string, kWh double").write.parquet(str(tmp_path / "load"))
    (tmp_path / "w.csv").write_text("date_time_local,temperature\n2024-01-02 07:00:00,-5\n")
    for name, key, codes in (("a", "CFSAUID", ("H1A", "H1B")), ("d", "DAUID", ("D1",))):
        features = [feature(key, c, 3 * k) for k, c in enumerate(codes)]
        (tmp_path / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.txt").write_text("COL0 - GEO UID\nCOL1 - population\n")
    (tmp_path / "c" / "c.csv").write_text("COL0,COL1\nH1A,100\n")
    p = lambda x: str(tmp_path / x)
    c = load_project(spark, Paths(p("load"), {"m": p("w.csv")}, {"m": p("a.geojson")}, [p("c")], da_geometry={"m": p("d.geojson")}))
    assert [r.code for r in c.codes().collect()] == ["H1A"] and [r.code for r in c.codes("da").collect()] == ["D1"]
    row = c.load.where("code = 'H1A'").first()
    assert (row.ts, row.kwh) == (dt.datetime(2024, 1, 2, 7), 3.0)
    assert c.nearest.first().nearest == ["H1A"] and c.census.first().value == 100 and c.weather.count() == 1


def test_daily_peaks_of_a_stream(spark, tmp_path):
    load = series(spark, [float(h % 24 + h // 24) for h in range(72)]).withColumn("ts", F.col("ts").cast("timestamp"))
    load.repartition(1).write.parquet(str(tmp_path / "in"))
    want = {r.day: (r.peak_load, r.am_peak, r.pm_peak, r.n) for r in daily_peaks(load).collect()}
    assert want[START] == (23, 11, 21, 24) and len(want) == 3
    stream = spark.readStream.schema(load.schema).parquet(str(tmp_path / "in"))
    q = write_daily_peaks(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    got = {r.day: (r.peak_load, r.am_peak, r.pm_peak, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {d: v for d, v in want.items() if d < START + dt.timedelta(days=2)}


def test_stages_are_timed_and_reported(spark, tmp_path):
    from gridloom.plans.stages import run_stages, write_report

    def broken():
        raise ValueError("x")

    rows = run_stages({"range": lambda: spark.range(10), "broken": broken, "none": lambda: None})
    assert [(r["stage"], r["status"]) for r in rows] == [("range", "ok"), ("broken", "error: ValueError"), ("none", "ok")]
    write_report(rows, str(tmp_path / "out"), sf="x")
    import csv
    import json

    saved = json.loads((tmp_path / "out" / "stages.json").read_text())
    assert saved["sf"] == "x" and saved["stages"] == rows
    assert [r["stage"] for r in csv.DictReader((tmp_path / "out" / "stages.csv").open())] == ["range", "broken", "none"]
