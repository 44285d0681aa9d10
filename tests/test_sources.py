import json

import pytest
from pyspark.sql import functions as F

from plumbline import cli, io, schema
from plumbline.sources import checkpoints, datasheets, dispatch, runways, stations
from plumbline.sources.common import from_text

INDEX = """Sta Lat Long Hgt X Y Z Dtbeg Dtend Dtmod NumSol StaOrigName
AAAA 36.1 244.5 700.0 1 2 3 2000-01-01 2020-01-01 2020-02-02 100 MY OLD NAME
BBBB -10.0 180.0 5.0 1 2 3 2010-01-01 2011-01-01 2020-02-02 7
"""
SERIES = """site YYMMMDD yyyy.yyyy _latitude(deg) _longitude(deg) __height(m) ant sig_e(m) sig_n(m) sig_u(m)
AAAA 10JAN01 2010.0000 36.1 244.5 700.0 0.1 0.001 0.002 0.003
AAAA 10JAN11 2010.0274 36.2 244.6 701.0 0.1 0.001 0.002 0.003
AAAA 96FEB01 1996.0849 36.3 244.7 702.0 0.1 0.001 0.002 0.003
"""
STEPS = "AAAA 10JAN05 1 Antenna_Type_Changed\nBBBB 99OCT16 2 575.440 225.783 7.1 ci9108652\n"


def test_station_index(spark):
    rows = {r["sta"]: r for r in stations.parse_index(from_text(spark, INDEX)).collect()}
    assert rows["AAAA"]["lon"] == pytest.approx(-115.5) and rows["AAAA"]["sta_orig_name"] == "MY OLD NAME" and rows["BBBB"]["sta_orig_name"] == ""
    assert rows["BBBB"]["lon"] == -180.0 and rows["BBBB"]["num_sol"] == 7
    with pytest.raises(ValueError, match="line 2"):
        stations.parse_index(from_text(spark, "Sta x\nAAAA 1 2"))
    near = stations.select_stations(stations.parse_index(from_text(spark, INDEX)), (-180, -90, 180, 90), epoch=2011.05)
    assert {r["sta"] for r in near.collect()} == {"AAAA", "BBBB"}
    assert stations.select_stations(stations.parse_index(from_text(spark, INDEX)), (-120, 30, -110, 40), most=1).count() == 1


def test_series_and_positions(spark):
    rows = stations.parse_series(from_text(spark, SERIES))
    assert sorted(r["date"].year for r in rows.collect()) == [1996, 2010, 2010]
    out = stations.parse(rows, stations.parse_index(from_text(spark, INDEX)), epoch=2010.01).first()
    assert out["height"] == 700.5 and out["horizontal_crs"] == "EPSG:7912" and out["measurement_datetime"].day == 1 and json.loads(out["raw"])["n_solutions_used"] == 2
    assert out["vel_e"] is None and stations.parse(rows, stations.parse_index(from_text(spark, INDEX)), span=(1900.0, 1901.0)).count() == 0
    with pytest.raises(ValueError):
        stations.parse_series(from_text(spark, "site YYMMMDD\nA 1"))
    with pytest.raises(ValueError):
        stations.parse(rows, rows, frame="X")


def test_steps_and_velocities(spark):
    a, b = sorted(stations.parse_steps(from_text(spark, STEPS)).collect(), key=lambda r: r["sta"])
    assert a["event"] == "Antenna_Type_Changed" and a["magnitude"] is None and b["event_id"] == "ci9108652" and b["date"].year == 1999 and b["threshold_km"] == 575.44
    for bad in ("AAAA 10JAN05 3 x", "AAAA 10JAN05 2 1 2 3", "AAAA 10JAN05 1"):
        with pytest.raises(ValueError):
            stations.parse_steps(from_text(spark, bad))
    line = "AAAA V5 " + " ".join(str(i) for i in range(22)) + " 36.0 -229.156 5.0"
    v = stations.parse_velocities(from_text(spark, line)).first()
    assert v["lon"] == pytest.approx(130.844) and v["vel_e"] == 6.0 and v["n_steps"] == 21
    for bad in (line + " 1", line.replace(" 5.0", " nan")):
        with pytest.raises(ValueError):
            stations.parse_velocities(from_text(spark, bad))


RECORDS = [
    {"orthoHt": "600.5", "pid": "AB0001", "epoch": " ", "lon": "-115.1", "lat": "36.1", "posDatum": "NAD 83(2011)", "vertDatum": "NAVD 88", "netAccHz": "1.2", "lastRecovered": "2012"},
    {"pid": "AB0002", "lat": "36.2", "lon": "-115.2", "posDatum": "NAD 83(CORS)", "orthoHt": " "},
    {"pid": "AB0003", "lat": "36.3", "lon": "-115.3", "orthoHt": "1"},
    {"pid": "AB0001", "lat": "0", "lon": "0", "posDatum": "NAD 83(2011)", "orthoHt": "1"},
    {"pid": " "},
]


def test_datasheets_quarantine_and_first_wins(spark):
    records = datasheets.dedupe_first(datasheets.records_frame(spark, RECORDS), datasheets.field("pid"))
    good, bad = datasheets.parse_sheets(records)
    (r,) = good.collect()
    assert r["height"] == 600.5 and r["coord_epoch"] == 2010.0 and r["acc_h"] == pytest.approx(0.012) and r["vertical_crs"] == "EPSG:5703" and r["native_crs"] == "EPSG:6318+5703"
    assert r["measurement_datetime"].month == 7 and "netAccHz" in json.loads(r["raw"]) and "pid" not in json.loads(r["raw"])
    assert {x["reason"]: x["n"] for x in bad.collect()} == {"NAD 83(CORS)": 1, "(missing)": 1}
    solution = {"pid": "X", "lat": "1", "lon": "2", "refFrame": "NAD_83(2011)", "orthoHt": "3", "latP2p": "0.01", "lonP2p": "0.02", "orthoHtP2p": "0.03", "obsTimeStart": "2015-01-02 03:04:05"}
    (o,) = datasheets.parse_solutions(datasheets.records_frame(spark, [solution]))[0].collect()
    assert o["acc_h"] == 0.02 and o["acc_v"] == 0.03 and o["ref_frame"] == "NAD 83(2011)" and o["measurement_datetime"].year == 2015


def test_requests_are_split_and_retried():
    everything = [{"pid": str(i), "x": i % 40, "y": i // 40} for i in range(1600)]

    def fetch(box):
        return [r for r in everything if box[0] <= r["x"] <= box[2] and box[1] <= r["y"] <= box[3]][:500]

    got = datasheets.fetch_box(fetch, (-1, -1, 41, 41))
    assert {r["pid"] for r in got} == {r["pid"] for r in everything}
    waits = []
    with pytest.raises(RuntimeError):
        datasheets.get_records(lambda box: {"error": 1}, (0, 0, 1, 1), sleep=waits.append)
    assert waits == [1, 2, 4]


def _put(line, start, text):
    return line[:start] + text + line[start + len(text) :]


def _runway_text():
    apt = _put(_put(_put(_put(" " * 300, 0, "APT"), 3, "12345.*A"), 14, "AIRPORT"), 27, "LAS")
    rwy = _put(_put(" " * 1000, 0, "RWY"), 3, "12345.*A")
    rwy = _put(_put(_put(rwy, 16, "01L/19R"), 65, "01L"), 68, "014")
    rwy = _put(_put(_put(rwy, 103, "129871.1700N"), 130, "414612.5904W"), 142, "2181.2")
    rwy = _put(_put(_put(rwy, 171, "129881.1700N"), 198, "414612.5904W"), 210, "2180.0")
    rwy = _put(_put(rwy, 568, "NGS"), 584, "01/02/2020")
    rwy = _put(_put(_put(rwy, 65 + 222, "19R"), 103 + 222, "130000.0000N"), 130 + 222, "414600.0000W")
    return f"{apt}\n{rwy}\nATT x\n"


def test_runways(spark):
    rows = {r["id"]: r for r in runways.parse(runways.of_text(spark, _runway_text())).collect()}
    assert set(rows) == {"LAS_01L", "LAS_01L_DT", "LAS_19R"}
    end = rows["LAS_01L"]
    assert end["y"] == pytest.approx(36.075325) and end["x"] == pytest.approx(-115.170164) and end["height"] == pytest.approx(2181.2 * 0.3048) and end["acc_h"] == 0.30
    assert rows["LAS_01L_DT"]["point_type"] == "displaced_threshold" and rows["LAS_19R"]["acc_h"] is None and rows["LAS_19R"]["height"] is None
    assert json.loads(rows["LAS_19R"]["raw"])["pos_class"] == "estimated" and json.loads(end["raw"])["true_az"] == "14.0"
    assert runways.parse(runways.of_text(spark, _runway_text()), (0, 0, 1, 1)).count() == 0
    with pytest.raises(ValueError):
        runways.rows(runways.of_text(spark, _runway_text().split("\n")[1]))


def _checkpoints(spark):
    return spark.createDataFrame([("p1", "NVA", "2015-01-01", "10.5", None, -115.0, 36.0), ("p2", "VVA", None, "x", 1.0, -100.0, 36.0)], "id string, point_type string, datetime string, z_meter_vdatum_update string, accuracy double, x double, y double")


def test_checkpoints_push_the_box_down(spark, tmp_path):
    _checkpoints(spark).write.parquet(str(tmp_path / "c"))
    table = checkpoints.read(spark, str(tmp_path / "c"), (-116, 35, -114, 37))
    assert "GreaterThanOrEqual(x,-116.0)" in table._jdf.queryExecution().toString()
    (r,) = checkpoints.parse(table).collect()
    assert r["height"] == 10.5 and r["vertical_crs"] == "EPSG:5703" and json.loads(r["raw"]) == {"accuracy": "None"}
    assert [r["height"] for r in checkpoints.parse(_checkpoints(spark)).where("id = 'p2'").collect()] == [None]


@pytest.fixture
def providers(spark):
    def broken(spark, box):
        raise OSError("no network")

    dispatch.register("3dep", lambda spark, box: _checkpoints(spark), checkpoints.parse)
    dispatch.register("ngs", lambda spark, box: datasheets.records_frame(spark, RECORDS[:3]), datasheets.parse_sheets)
    dispatch.register("bad", broken, checkpoints.parse)
    dispatch.register("late", lambda spark, box: _checkpoints(spark).withColumn("id", F.raise_error(F.lit("late"))), checkpoints.parse)
    yield
    dispatch.PROVIDERS.clear()


def test_a_failing_source_is_reported_and_the_others_return(spark, providers):
    rows, status = dispatch.fetch_control(spark, (-180, -90, 180, 90), ["3dep", "ngs", "bad", "late", "none"])
    assert rows.count() == 3 and status["3dep"].n_rows == 2 and status["ngs"].n_skipped == 2
    assert all(status[s].error for s in ("bad", "late", "none")) and "no network" in status["bad"].error
    none, _ = dispatch.fetch_control(spark, (0, 0, 1, 1), ["bad"])
    assert none.count() == 0 and none.columns == [f.name for f in schema.CONTROL.fields]
    with pytest.raises(NotImplementedError):
        dispatch.fetch_control(spark, (0, 0, 1, 1), ["bad"], target_crs="EPSG:1")


def test_polygon_area_write_and_provenance(spark, providers, tmp_path):
    area = tmp_path / "a.geojson"
    area.write_text(json.dumps({"features": [{"geometry": {"coordinates": [[[-116, 35], [-114, 35], [-114, 37], [-116, 37], [-116, 35]]], "type": "Polygon"}}]}))
    rows, status = dispatch.fetch_control(spark, str(area), ["3dep", "ngs"])
    assert {r["id"] for r in rows.collect()} == {"p1", "AB0001"}
    record = io.write(rows, str(tmp_path / "out.parquet"), status, "test")
    assert record["n_rows"] == 2 and io.read_provenance(str(tmp_path / "out.parquet"))["transforms"] == {"identity": 2}
    _checkpoints(spark).coalesce(1).write.parquet(str(tmp_path / "plain"))
    assert io.read_provenance(str(tmp_path / "plain")) is None
    io.write(rows, str(tmp_path / "out.csv"))
    with pytest.raises(ValueError):
        io.write(rows, str(tmp_path / "out.xyz"))
    assert io.export_crs(rows, "EPSG:6318") == "EPSG:6318+5703"
    assert io.export_crs(rows.withColumn("vertical_crs", F.when(F.col("source") == "ngs", F.col("vertical_crs"))), "EPSG:6318") == "EPSG:6318"
    assert cli.fetch_main(["--aoi", str(area), "--out", str(tmp_path / "cli.parquet"), "--source", "3dep"], spark) == 0
    assert cli.fetch_main(["--aoi", str(area), "--out", str(tmp_path / "x.parquet"), "--source", "bad"], spark) == 1


def test_assess_from_the_command_line(spark, providers, tmp_path):
    rows, _ = dispatch.fetch_control(spark, (-180, -90, 180, 90), ["3dep", "ngs"])
    rows.write.parquet(str(tmp_path / "control"))
    spark.createDataFrame([(r, c, 500.0) for r in range(5) for c in range(5)], "row int, col int, z double").write.parquet(str(tmp_path / "dtm"))
    (tmp_path / "dtm.json").write_text(json.dumps({"x0": -117.0, "y0": 38.0, "dx": 1.0, "dy": -1.0, "height": 5, "width": 5, "crs": "EPSG:6319"}))
    code = cli.assess_main(["--control", str(tmp_path / "control"), "--product", f"DTM={tmp_path / 'dtm'}", "--target-crs", "EPSG:6319", "--out", str(tmp_path / "o"), "--require", "opus"], spark)
    assert code == 0
    out = spark.read.option("header", True).csv(str(tmp_path / "o" / "stats.csv"))
    assert out.count() == 5 and out.where("segment = 'ALL'").first()["n_valid"] == "2"
    for bad in (["a"], ["a=1", "a=2"], ["=x"]):
        with pytest.raises(ValueError):
            cli.key_values(bad)
    (tmp_path / "crs.txt").write_text("EPSG:6318\n")
    assert cli.crs_argument(str(tmp_path / "crs.txt")) == "EPSG:6318" == cli.crs_argument("EPSG:6318")


def test_schema(spark):
    df = schema.normalize(spark.createDataFrame([("a", "1.5", float("nan"))], "id string, height string, acc_h double"), source="s")
    r = df.first()
    assert (r["source"], r["height"], r["acc_h"], r["raw"]) == ("s", 1.5, None, None) and schema.empty(spark).schema == schema.CONTROL
    with pytest.raises(schema.SchemaError):
        schema.validate(df)  # no frame
    with pytest.raises(schema.SchemaError):
        schema.validate(df.drop("raw"))
    assert schema.validate(df, require_crs=False) is df
    with pytest.raises(schema.SchemaError):
        schema.validate(df.withColumn("z", F.lit(1)))


def test_streaming_stage(spark, providers, tmp_path):
    from plumbline.streaming import stages

    rows, _ = dispatch.fetch_control(spark, (-180, -90, 180, 90), ["3dep"])
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stages.landed(stream, ["EPSG:6318"]).writeStream.format("memory").queryName("landed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("landed").count() == rows.count()
    w = stages.report_each_batch(stream, "height", ["point_type"], str(tmp_path / "rep")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "rep")).count() == 2
