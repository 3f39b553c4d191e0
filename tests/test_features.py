"""GeoJSON in splits: against the json module, with braces and quotes in strings, and split sizes down to a few bytes."""

import json

import pytest
from pyspark.sql import functions as F

from gridloom.functions.projection import GEOGRAPHIC
from gridloom.sources import features, readers, writers


def document(n):
    odd = ["}", "{", '"', "\\", "a}b{c", '\\"}', "{}{}", "é😀}", "", "line\nend}", "tab\t{"]
    made = [
        {"type": "Feature", "properties": {"FSA": f"A{k:03d}", "note": odd[k % len(odd)], odd[k % 9] + "key": {"deep": [{"x": odd[k % 7]}]}}, "geometry": {"type": "Polygon", "coordinates": [[[k, 0], [k + 1, 0], [k + 1, 1], [k, 0]]]}}
        for k in range(n)
    ]
    return {"type": "FeatureCollection", "name": "odd } name {", "crs": {"type": "name", "properties": {"name": "x}"}}, "features": made, "after": {"type": "note"}}


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", ["64b", "1000b", "1m"])
def test_features_of_a_split_document(spark, tmp_path, indent, size):
    doc = document(90)
    path = tmp_path / "d.geojson"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        texts = features.read_feature_texts(spark, str(path))
        got = [json.loads(r.feature) for r in texts.orderBy("number").collect()]
        splits = spark.read.text(str(path)).select(F.col("_metadata.file_block_start")).distinct().count() if indent else 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == [doc["crs"], *doc["features"], doc["after"]]
    assert splits > 1 or size == "1m"


def test_geometry_of_several_files(spark, tmp_path):
    for name in ("x", "y"):
        (tmp_path / f"{name}.geojson").write_text(json.dumps(document(12 if name == "x" else 3)))
    got = readers.read_geometry(spark, {n: str(tmp_path / f"{n}.geojson") for n in ("x", "y")}).collect()
    assert sorted((r.city, r.code) for r in got) == [("x", f"A{k:03d}") for k in range(12)] + [("y", f"A{k:03d}") for k in range(3)]
    assert all(len(r.rings[0]) == 4 or len(r.rings[0]) == 3 for r in got)
    (tmp_path / "none.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    assert readers.read_geometry(spark, {"n": str(tmp_path / "none.geojson")}).count() == 0


RING = "array<array<struct<x:double,y:double>>>"


@pytest.mark.parametrize(("kind", "ids"), [("string", ["b", "b", None, "a"]), ("long", [10, 9, 9, None]), ("string", []), ("string", [None, None])])
def test_feature_collection_is_json_for_any_ids(spark, tmp_path, kind, ids):
    rows = [(i, [[(0.0, 0.0), (1.0, 0.0), (1.0, float(k)), (0.0, 0.0)]]) for k, i in enumerate(ids)]
    path = str(tmp_path / "out")
    writers.write_feature_collection(spark.createDataFrame(rows, f"building_id {kind}, rings {RING}").repartition(3), path, GEOGRAPHIC)
    parts = sorted((tmp_path / "out").glob("part-*"))
    doc = json.loads("".join(p.read_text() for p in parts))
    found = [f["properties"].get("building_id") for f in doc["features"]]
    plain = lambda x: (x is not None, str(x).zfill(5))
    assert doc["type"] == "FeatureCollection" and sorted(map(plain, found)) == sorted(map(plain, ids)) and [f is None for f in found] == sorted([i is None for i in ids], reverse=True)


def test_feature_collection_makes_each_feature_once(spark, tmp_path):
    """What a feature is made from runs once a building, not again to find the order; equal first features keep one comma between them."""
    made = spark.sparkContext.accumulator(0)

    def counted(i: str) -> str:
        made.add(1)
        return i

    df = spark.createDataFrame([(i, [[(304800.0, 5e6), (304801.0, 5e6), (304801.0, 5000001.0)]]) for i in ("b", "a", "a", "c")], f"building_id string, rings {RING}")
    path = str(tmp_path / "out")
    writers.write_feature_collection(df.repartition(3).withColumn("name", F.udf(counted, "string")("building_id")), path, "EPSG:2950")
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))))
    assert [f["properties"]["building_id"] for f in doc["features"]] == ["a", "a", "b", "c"]
    assert made.value == 4
