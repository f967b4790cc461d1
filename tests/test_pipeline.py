"""Specifications, mapping, sources, sinks and whole pipelines."""
import json
import os

import pytest
from pyspark.sql import functions as F

import geoweft
from geoweft.functions import codes, crs, dialect, text, wkb
from geoweft.operators import http
from geoweft.plans import mapping, spec
from geoweft.sources import described, geo_crs, geo_metadata, gml_geometry, jdbc_options, read_source, services, sinks, with_hex_geometry


def square(x0, y0, x1, y1):
    return {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}


def dot(x, y):
    return {"type": "Point", "coordinates": [x, y]}


@pytest.fixture()
def geojson(tmp_path):
    def write(name, features):
        path = tmp_path / f"{name}.geojson"
        path.write_text(json.dumps({"type": "FeatureCollection", "features": [
            {"type": "Feature", "properties": {"name": n}, "geometry": g} for n, g in features]}))
        return {"id": name, "format": "geojson", "uri": str(path), "crs": "EPSG:25833"}

    return write


def config(tmp_path, sources, steps, mapping=(), **more):
    return geoweft.load({
        "name": "t", "working_crs": "EPSG:25833", "sources": sources, "base": sources[0]["id"], "steps": steps, "mapping": list(mapping),
        "output": {"path": str(tmp_path / "out.parquet"), "layer": "out", "crs": "EPSG:25833"}, **more,
    })


def harbour(geojson):
    """Berths in two basins, and the ships of some of them."""
    berths = [(f"{basin}{i}", square(10 * i, y, 10 * i + 8, y + 6)) for basin, y in (("n", 0), ("s", 40)) for i in range(4)]
    ships = [("Ada", dot(3, 3)), ("Bo", dot(33, 2)), ("Cyl", dot(14, 44))]
    return geojson("berths", berths), geojson("ships", ships)


def test_a_pipeline_with_a_branch_runs_previews_and_counts(spark, tmp_path, geojson):
    berths, ships = harbour(geojson)
    cfg = config(tmp_path, [berths, ships], [
        {"type": "attributes", "columns": [{"to": "basin", "expr": "left(name, 1)"}]},
        {"type": "snapshot", "id": "basins"},
        {"type": "dissolve", "branch": "basins", "by": ["basin"], "aggregates": [{"to": "places", "how": "count"}]},
        {"type": "attribute_join", "source": "basins", "left": "basin", "right": "basin", "fields": {"places": "places"}},
        {"type": "spatial_join", "source": "ships", "fields": {"ship": "name"}, "rejects": "free"},
    ], [{"to": c, "from": c} for c in ("name", "places", "ship")])
    one = geoweft.PipelineRun(spark, cfg.pipelines[0])
    taken = {"n0": "Ada", "n3": "Bo", "s1": "Cyl"}
    shown = one.preview(10).collect()
    assert {r.name: r.ship for r in shown} == taken and {r.places for r in shown} == {4}
    assert all(json.loads(r["__geojson"])["type"] == "Polygon" for r in shown)
    counts = one.counts()
    assert counts["base"] == 8 and counts["steps"][3] == 2 and counts["steps"][5] == counts["layers"][0] == 3 and counts["rejects"] == {5: 5}
    written = {w["layer"]: w for w in geoweft.run(spark, cfg, ledger=str(tmp_path / "runs"))}
    assert {n: (w["rows"], w["kind"]) for n, w in written.items()} == {"out": (3, "layer"), "free": (5, "rejects")}
    back = {n: read_source(spark, spec.source({"id": n, "format": "parquet", "uri": w["path"], "crs": "EPSG:25833"})) for n, w in written.items()}
    assert {r.name for r in back["out"].collect()} == set(taken) and "ship" not in back["free"].columns
    assert geo_crs(geo_metadata(spark, written["out"]["path"])) == "EPSG:25833" and geo_metadata(spark, str(tmp_path / "none")) == {}
    folder = os.path.dirname(written["out"]["path"])
    back["free"].drop("geom", "__src_row").write.parquet(f"{folder}/old.parquet")
    os.mkdir(f"{folder}/mine.parquet")
    geoweft.run(spark, cfg)
    assert sorted(os.listdir(folder)) == ["free.parquet", "mine.parquet", "out.parquet"]  # no layer of an earlier run, nothing else touched
    run = sinks.list_runs(spark, str(tmp_path / "runs")).first()
    assert run.ok and {w["layer"] for w in sinks.get_run(spark, str(tmp_path / "runs"), run.id)["layers"]} == set(written)


WRONG = {
    "simplify": [({"tolerance": 3, "keep_outer_boundary": True}, "shared_boundaries too"), ({"tolerance": -2}, "above zero"), ({}, "can't do without tolerance")],
    "remove_duplicates": [({}, "what makes rows equal")],
    "explode": [({"part_field": "__src_row"}, "kept for the engine")],
    "eliminate_slivers": [({}, "what a sliver is")],
    "split_lines": [({"source": "fences"}, "asks for table 'fences'")],
    "dissolve": [({"by": ["kind"], "aggregates": [{"to": "Kind", "how": "count"}]}, "would be called Kind"), ({"aggregates": [{"to": "n"}]}, "how values are combined")],
    "attributes": [({"drop": ["Geom"]}, "stays with its rows"), ({"columns": [{"to": "x", "from": "a", "const": 1}]}, "one origin is expected")],
    "filter": [({"where": "1 = 1", "branch": "north"}, "asks for branch 'north'"), ({"where": "true", "rejects": "Out"}, "but so does")],
    "spatial_join": [({"source": "base", "match": "summarize", "fields": {"y": "name"}}, "several matches become one"), ({"source": "base", "predicate": "near"}, "among the choices")],
    "http_lookup": [({"url": "u", "url_column": "v"}, "give one of them")],
    "buffer": [({"distance": 1, "ends": "flat"}, "doesn't take ends"), ({"distance": "far"}, "a number is expected")],
    "snapshot": [({"id": "base"}, "but so does source base")],
}


@pytest.mark.parametrize("step, message", [({"type": kind, **fields}, message) for kind, cases in WRONG.items() for fields, message in cases])
def test_wrong_steps_are_refused(tmp_path, geojson, step, message):
    with pytest.raises(ValueError, match=message):
        config(tmp_path, [geojson("base", [("only", dot(0, 0))])], [step])


def test_degrees_and_unknown_systems_are_refused(spark, tmp_path, geojson):
    base = {**geojson("base", [("a", dot(10, 60))]), "crs": "EPSG:4326"}
    with pytest.raises(ValueError, match="counts in degrees"):
        geoweft.PipelineRun(spark, config(tmp_path, [base], [{"type": "buffer", "distance": 500}], working_crs="EPSG:4326").pipelines[0])
    with pytest.raises(ValueError, match=r"unknown CRS 'EPSG:999999'\npipelines\.0\.working_crs"):
        geoweft.PipelineRun(spark, config(tmp_path, [base], [], working_crs="EPSG:999999").pipelines[0])


def test_coordinates_and_codes(spark):
    df = spark.createDataFrame([(3.0028786, 51.4570268), (10.40744, 57.64911)], "lon double, lat double")
    got = df.select(
        F.expr(codes.geohash("lon", "lat")).alias("hash"), F.expr(codes.mgrs("lon", "lat")).alias("ref"),
        F.expr(crs.transform_xy("lon", "lat", "EPSG:4326", "EPSG:32631")).alias("u")).collect()
    assert got[0].ref == "31UET0019900649" and got[1].hash == "u4pruydqqvj8"
    assert (round(got[0].u.x, 3), round(got[0].u.y, 3)) == (500199.999, 5700649.996)


def test_casts_read_both_date_orders_and_round(spark):
    df = spark.createDataFrame([("2024-03-14",), ("2024-03-14 08:30:00",), ("14.03.2024",), ("14.03.2024 08:30",), ("14.03.2024 08:30:15",), ("March 2024",)], "v string")
    items = spec.map_items([{"to": "d", "from": "v", "cast": "date"}, {"to": "t", "from": "v", "cast": "TIMESTAMP"}], "m")
    got = [(str(r.d), str(r.t)) for r in mapping.mapped(df, items, "EPSG:25833").collect()]
    assert got == [("2024-03-14", f"2024-03-14 {t}") for t in ("00:00:00", "08:30:00", "00:00:00", "08:30:00", "08:30:15")] + [("None", "None")]
    numbers = spark.createDataFrame([("12.5", 2.5), ("x", 3.5)], "s string, f double")
    items = spec.map_items([{"to": "a", "from": "s", "cast": "INTEGER"}, {"to": "b", "from": "f", "cast": "INTEGER"}], "m")
    assert [tuple(r) for r in mapping.mapped(numbers, items, "EPSG:25833").collect()] == [(13, 2), (None, 4)]


def test_text_and_binary_forms_round_trip(spark):
    forms = [
        "POINT (1.5 2)", "LINESTRING Z (0 0 1, 3 4 5)", "MULTIPOINT (1 1, 2 2)", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))",
        "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3.5, 4 4))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 7 5, 7 7, 5 7, 5 5)))", "POLYGON EMPTY",
    ]
    df = spark.createDataFrame([(w,) for w in [*forms, "junk", "POINT (1 east)"]], "w string").withColumn("geom", F.expr(text.from_wkt("w")))
    both = df.withColumn("b", wkb.to_wkb(F.col("geom"))).withColumn("g2", wkb.from_wkb(F.col("b"))).select(
        "w", F.expr(text.as_wkt("geom")).alias("again"), F.expr("g2 <=> geom").alias("same"), F.expr(f"{text.from_geojson(text.as_geojson('geom'))} <=> geom").alias("json"))
    rows = both.collect()
    assert [r.again for r in rows] == [*forms, None, None] and all(r.same for r in rows) and all(r.json for r in rows[:6])


def test_table_sources(spark, tmp_path):
    (tmp_path / "xy.csv").write_text("name,lon,lat\na,10.5,60\nb,,60\nc,east,60\n")
    xy = read_source(spark, spec.source({"id": "s", "format": "csv", "uri": str(tmp_path / "xy.csv"), "x_field": "lon", "y_field": "lat"}))
    assert [(r.name, r.geom is not None) for r in xy.collect()] == [("a", True), ("b", False), ("c", False)] and "lon" not in xy.columns
    (tmp_path / "plain.csv").write_text("1,Oslo\n2,Bergen\n")
    assert read_source(spark, spec.source({"id": "s", "format": "csv", "uri": str(tmp_path / "plain.csv"), "header_row": False})).columns[:2] == ["field_1", "field_2"]
    (tmp_path / "rec.json").write_text(json.dumps({"data": {"items": [{"n": 1, "g": dot(1, 2)}, {"n": 2, "g": None}]}}))
    rec = read_source(spark, spec.source({"id": "s", "format": "json", "uri": str(tmp_path / "rec.json"), "records": "data.items", "geom_field": "g"}))
    assert [(r.n, r.geom and r.geom.kind) for r in rec.collect()] == [(1, "POINT"), (2, None)]
    hexed = spark.createDataFrame([("0101000020E6100000000000000000F03F0000000000000040",), ("zz",)], "g string")
    assert [r.geom and r.geom.parts[0].rings[0][0].y for r in with_hex_geometry(hexed.filter("g <> 'zz'"), "g").collect()] == [2.0]
    assert jdbc_options(spec.source({"id": "s", "format": "postgres", "uri": "postgresql://h/db", "layer": "roads"}))["dbtable"] == '"public"."roads"'


def test_text_files_keep_their_order_and_their_line_breaks(spark, tmp_path):
    (tmp_path / "notes.csv").write_text('n,note\n1,"two\nlines"\n2,one\n')
    notes = read_source(spark, spec.source({"id": "s", "format": "csv", "uri": str(tmp_path / "notes.csv"), "lines": False}))
    assert [r.note for r in notes.orderBy("__src_row").collect()] == ["two\nlines", "one"]
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.json").write_text("".join(json.dumps({"n": 10 * k + i}) + "\n" for i in range(10)))
    many = read_source(spark, spec.source({"id": "s", "format": "json", "uri": str(folder), "lines": True}))
    assert [r.n for r in many.orderBy("__src_row").collect()] == list(range(30))
    assert many.select("__src_row").distinct().count() == 30


def test_headers_take_what_the_environment_holds(spark, tmp_path, monkeypatch):
    seen = {"url": "http://h/{k}", "headers": {"Key": "${GEOWEFT_TEST_KEY}"}, "fields": {"a": "a"}}
    df = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError, match="GEOWEFT_TEST_KEY"):
        http.http_lookup(df, seen, str(tmp_path / "c1"), lambda *a: (200, b"{}", {}))
    monkeypatch.setenv("GEOWEFT_TEST_KEY", "k1")
    out = http.http_lookup(df, seen, str(tmp_path / "c2"), lambda url, headers, timeout: (200, json.dumps({"a": headers["Key"]}).encode(), {}))
    assert [r.a for r in out.collect()] == ["k1"]


def test_geopackage_source(spark, tmp_path):
    import sqlite3
    import struct

    path = str(tmp_path / "x.gpkg")
    con = sqlite3.connect(path)
    con.executescript("CREATE TABLE gpkg_contents(table_name TEXT); CREATE TABLE gpkg_geometry_columns(table_name TEXT, column_name TEXT);"
                      "INSERT INTO gpkg_contents VALUES('places'); INSERT INTO gpkg_geometry_columns VALUES('places', 'shape');"
                      "CREATE TABLE places(fid INTEGER PRIMARY KEY, shape BLOB, name TEXT, open BOOLEAN)")
    blob = b"GP\x00\x01" + struct.pack("<i", 4326) + struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    con.executemany("INSERT INTO places VALUES(?, ?, ?, ?)", [(1, blob, "a", 1), (2, None, "b", 0)])
    con.commit()
    con.close()
    df = read_source(spark, spec.source({"id": "s", "format": "gpkg", "uri": path}))
    assert [(r.fid, r.name, r.open, r.geom and r.geom.parts[0].rings[0][0].x) for r in df.collect()] == [(1, "a", True, 3.0), (2, "b", False, None)]


def test_gml_source(spark, tmp_path):
    path = tmp_path / "x.gml"
    path.write_text("""<c><gml:featureMember>
<app:House><app:name>a</app:name><app:geom><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 4 0 4 4 0 4 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></app:geom></app:House>
</gml:featureMember><gml:featureMember>
<app:House><app:name>b</app:name><app:geom><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>9 9 10 9 10 10 9 10 9 9</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></app:geom></app:House>
</gml:featureMember></c>""")
    df = read_source(spark, spec.source({"id": "s", "format": "gml", "uri": str(path), "layer": "app:House", "crs": "EPSG:25833"}))
    from geoweft.functions import geometry as geo

    assert sorted(tuple(r) for r in df.select("name", F.expr(geo.area("geom"))).collect()) == [("a", 16.0), ("b", 1.0)]
    found = read_source(spark, spec.source({"id": "s", "format": "gml", "uri": str(path), "crs": "EPSG:25833"}))
    assert sorted(r.name for r in found.collect()) == ["a", "b"]
    assert "MULTIPOLYGON" in gml_geometry("x")


def test_services_page_and_land(spark, tmp_path):
    def fetch(url, headers, timeout):
        import json
        from urllib.parse import parse_qs, urlparse

        q = {k: v[0] for k, v in parse_qs(urlparse(url).query).items()}
        feature = lambda i: {"type": "Feature", "properties": {"n": i}, "geometry": {"type": "Point", "coordinates": [i, i]}}
        if "returnCountOnly" in q:
            return 200, json.dumps({"count": 5}), {}
        if "resultOffset" in q:
            at, size = int(q["resultOffset"]), int(q["resultRecordCount"])
            return 200, json.dumps({"features": [feature(i) for i in range(at, min(5, at + size))]}), {}
        if "page" in q:
            return 200, json.dumps({"features": [feature(9)], "links": []}), {}
        if "items" in url:
            return 200, json.dumps({"features": [feature(8)], "links": [{"rel": "next", "href": url + "&page=2"}]}), {}
        return (404, "", {}) if "gone" in url else (200, "name\na\n", {})

    arc = spec.source({"id": "a", "format": "arcgis_rest", "uri": "http://h/MapServer", "layer": "0", "page_size": 2})
    assert sorted(r.n for r in services.read_features(spark, arc, str(tmp_path), fetch).collect()) == [0, 1, 2, 3, 4]
    api = spec.source({"id": "o", "format": "oapif", "uri": "http://h/api", "layer": "places"})
    assert sorted(r.n for r in services.read_features(spark, api, str(tmp_path), fetch).collect()) == [8, 9]
    folder = str(tmp_path / "land")
    got = services.land(spark, ["http://h/x.csv"], folder, fetch)
    assert open(got["http://h/x.csv"]).read() == "name\na\n"
    assert services.land(spark, ["http://h/x.csv"], folder, lambda *a: 1 / 0, max_age=600) == got
    with pytest.raises(OSError, match="no earlier copy"):
        services.land(spark, ["http://h/gone.csv"], folder, fetch)
    assert "SRSNAME=urn%3Aogc%3Adef%3Acrs%3AEPSG%3A%3A25833" in services.wfs_url(spec.source({"id": "w", "format": "wfs", "uri": "http://h/wfs?service=x", "layer": "a:b", "crs": "EPSG:25833"}))


def test_http_lookup_asks_once_per_url(spark, tmp_path):
    log = str(tmp_path / "asked")

    def fetch(url, headers, timeout):
        with open(log, "a") as f:
            f.write(url + "\n")
        return 200, '{"hits": [{"p": {"lat": "59.9"}}]}' if "Oslo" in url else '{"hits": []}', {}

    df = spark.createDataFrame([(1, "Oslo gate"), (2, "Oslo gate"), (3, "Nowhere"), (4, None)], "id int, adr string")
    step = {"url": "http://h/find?q={adr}", "records": "hits", "fields": {"lat": "p.lat"}, "status_field": "st", "max_rate": 1000, "max_age_hours": 1}
    out = http.http_lookup(df, step, str(tmp_path / "cache"), fetch)
    assert sorted((r.id, r.lat, r.st, r["__matched"]) for r in out.collect()) == [(1, "59.9", 200, True), (2, "59.9", 200, True), (3, None, 200, False), (4, None, 0, False)]
    http.http_lookup(df, step, str(tmp_path / "cache"), fetch).collect()
    assert sorted(open(log).read().split()) == ["http://h/find?q=Nowhere", "http://h/find?q=Oslo%20gate"]


def test_sql_functions_and_description(spark):
    dialect.register(spark)
    r = spark.sql("SELECT ST_Area(ST_GeomFromText('POLYGON ((0 0, 2 0, 2 3, 0 3, 0 0))')) a, ST_AsText(ST_PointOnSurface(ST_MakeEnvelope(0, 0, 2, 2))) p, "
                  "ST_AsText(ST_LineInterpolatePoint(ST_GeomFromText('LINESTRING (0 0, 10 0)'), 0.25)) q, ST_Within(ST_Point(1, 1), ST_MakeEnvelope(0, 0, 2, 2)) w, "
                  "strftime(TIMESTAMP '2024-03-14 08:30:00', '%d.%m.%Y') d, date_diff_crossed('month', TIMESTAMP '2024-01-31', TIMESTAMP '2024-02-01') m").first()
    assert (r.a, r.p, r.q, r.w, r.d, r.m) == (6.0, "POINT (1 1)", "POINT (2.5 0)", True, "14.03.2024", 1)
    df = spark.range(3).selectExpr("id", "ST_Point(id * 1000.0, 500000.0) AS geom")
    assert "look like metres" in described(df, spec.source({"id": "s", "format": "geojson", "uri": "x", "crs": "EPSG:4326"}))["warning"]
