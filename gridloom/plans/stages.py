"""Times of a pipeline's stages, and their report as CSV and JSON."""

from __future__ import annotations

import csv
import json
import os
import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame


def run_stages(stages: Mapping[str, Callable[[], DataFrame | None]]) -> list[dict]:
    """(stage, seconds, status) in order; a stage's rows are made and thrown away. One that fails is reported and the rest still run."""
    out = []
    for name, stage in stages.items():
        began, status = time.perf_counter(), "ok"
        try:
            df = stage()
            if df is not None:
                df.write.format("noop").mode("overwrite").save()
        except Exception as error:  # the report says what failed
            status = f"error: {type(error).__name__}"
        out.append({"stage": name, "seconds": round(time.perf_counter() - began, 3), "status": status})
    return out


def write_report(rows: list[dict], folder: str, **context) -> None:
    """stages.csv and stages.json (with context) in a folder of the driver."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "stages.csv"), "w", newline="") as f:
        writer = csv.DictWriter(f, ["stage", "seconds", "status"])
        writer.writeheader()
        writer.writerows(rows)
    with open(os.path.join(folder, "stages.json"), "w") as f:
        json.dump({**context, "stages": rows}, f, indent=1)
