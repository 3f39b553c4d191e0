"""Shapefiles against the same buildings as GeoJSON."""

import json
import struct

import pytest

from gridloom.sources import readers, shapefile


def write_shapefile(base, records, kind=5):
    """records: (attributes as text, rings or None), the attributes' names alike."""
    body, index, at = b"", b"", 100
    for k, (_, rings) in enumerate(records, 1):
        if rings is None:
            content = struct.pack("<i", 0)
        else:
            points = [p for r in rings for p in r]
            starts = [sum(map(len, rings[:j])) for j in range(len(rings))]
            xs, ys = zip(*points, strict=True)
            content = struct.pack("<i4dii", kind, min(xs), min(ys), max(xs), max(ys), len(rings), len(points))
            content += struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        index += struct.pack(">ii", at // 2, len(content) // 2)
        body += struct.pack(">ii", k, len(content) // 2) + content
        at += 8 + len(content)
    head = lambda n: struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<ii8d", 1000, kind, *[0.0] * 8)
    base.with_suffix(".shp").write_bytes(head(100 + len(body)) + body)
    base.with_suffix(".shx").write_bytes(head(100 + len(index)) + index)
    names = list(records[0][0])
    width = 12
    dbf = struct.pack("<B3BIHH20x", 3, 24, 1, 1, len(records), 33 + 32 * len(names), 1 + width * len(names))
    dbf += b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([width]) + bytes(15) for n in names) + b"\r"
    dbf += b"".join(b" " + b"".join(str(a[n]).encode().ljust(width) for n in names) for a, _ in records)
    base.with_suffix(".dbf").write_bytes(dbf + b"\x1a")


def square(x, y, r):
    return [(x - r, y - r), (x - r, y + r), (x + r, y + r), (x + r, y - r), (x - r, y - r)]


@pytest.mark.parametrize("run", [7, 2000])
def test_geometry_is_that_of_geojson(spark, tmp_path, run):
    records = []
    for k in range(40):
        rings = [square(k, 0.5 * k, 1)] + [square(k, 0.5 * k, 0.25)] * (k % 3)
        records.append(({"ID_UEV": f"B{k}", "ETAGE_HORS": 1 + k % 5, "Volume": 10.5 + k}, None if k == 11 else rings))
    write_shapefile(tmp_path / "b", records)
    features = [{"type": "Feature", "properties": a, "geometry": None if r is None else {"type": "Polygon", "coordinates": r}} for a, r in records]
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    shapes = shapefile.read_shapes(spark, str(tmp_path / "b.shp"), run)
    got = {r.record: r.rings for r in shapes.collect()}
    assert sorted(got) == list(range(40)) and got[11] is None
    assert len(got[2]) == 3 and [tuple(p) for p in got[2][0]] == square(2, 1.0, 1)
    both = [sorted(map(str, readers.read_building_geometry(spark, str(tmp_path / f"b.{end}")).select("building_id", "stories", "volume", "rings").collect())) for end in ("shp", "geojson")]
    assert both[0] == both[1] and len(both[0]) == 40
    assert run > 40 or shapes.rdd.glom().filter(len).count() > 1


def test_other_shapes_are_an_error(spark, tmp_path):
    write_shapefile(tmp_path / "p", [({"ID_UEV": "B1"}, [square(0, 0, 1)])], kind=3)
    with pytest.raises(Exception, match="aren't polygons"):
        shapefile.read_shapes(spark, str(tmp_path / "p.shp")).collect()
