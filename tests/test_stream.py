"""Daily metrics of a stream against the batch operator: several runs on one checkpoint, late rows, days of 23 and 25 hours."""

import datetime as dt

import numpy as np
import pytest

from gridloom.operators import short_term
from gridloom.sources.readers import long_from_raw
from gridloom.streaming.daily import daily_metrics_stream

ZONE = "America/Toronto"


@pytest.mark.parametrize(("first", "still"), [(dt.datetime(2024, 3, 8, 5), 2), (dt.datetime(2024, 11, 1, 4), 1)])
def test_metrics_of_a_stream(spark, tmp_path, first, still):
    """Four local days around a clock change, in shuffled files; the stream is stopped and started again between them."""
    rng = np.random.default_rng(first.month)
    hours = [(code, first + dt.timedelta(hours=h), float(np.round(rng.uniform(1, 9), 3))) for code in ("a", "b") for h in range(120)]
    raw = spark.createDataFrame([(c, str(t), str(x)) for c, t, x in hours], "CP3 string, DateIntervalUTC string, kWh string")
    batch = short_term.daily_metrics(long_from_raw(raw, ZONE), order="utc")
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def run(rows):
        order = rng.permutation(len(rows))
        df = spark.createDataFrame([(rows[k][0], rows[k][1].replace(tzinfo=dt.timezone.utc), rows[k][2]) for k in order], "code string, ts timestamp, kwh double")
        df.repartition(2).write.mode("append").parquet(source)
        stream = daily_metrics_stream(spark.readStream.schema(df.schema).parquet(source), ZONE)
        stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()

    run([r for r in hours if r[1] < first + dt.timedelta(hours=40)])
    run([r for r in hours if first + dt.timedelta(hours=40) <= r[1] < first + dt.timedelta(hours=90)])
    run([("a", first + dt.timedelta(hours=3), 1000.0)] + [r for r in hours if r[1] >= first + dt.timedelta(hours=90)])  # a late row of a day that is final
    got = {(r.code, r.date): r for r in spark.read.parquet(out).collect()}
    want = {(r.code, r.date): r for r in batch.collect()}
    days = sorted({d for _, d in want})
    assert {d for _, d in got} == set(days[:-still]) and len(days) == 4 + still  # the others end after the watermark
    for k, r in got.items():
        for m in short_term.METRICS:
            assert r[m] == pytest.approx(want[k][m]), (k, m)
