"""Readers and sinks on small files."""

import datetime as dt
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from headrace.schemas import FLOW, METRIC, STATION
from headrace.sources import loads, sinks, tables, text


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)
    return str(path)


def test_station_csv_with_differing_columns(spark, tmp_path):
    a = put(tmp_path / "brazil" / "sul" / "hydro" / "st.csv", "name,lat,capacity_mw,extra\nFunil,-22.5,180,x\nFunil,-21.1,bad,y\n")
    b = put(tmp_path / "peru" / "peru" / "hydro" / "st.csv", "name,lon,capacity_mw\n Inga ,12.5,nan\n")
    rows = tables.read_station_csv(spark, [a, b], STATION, region_pattern=r"([^/]+)/hydro/[^/]+$").collect()
    assert {(r["name"], r["lat"], r["lon"], r["capacity_mw"], r["path_region"]) for r in rows} == {
        ("Funil", -22.5, None, 180.0, "sul"), ("Funil", -21.1, None, None, "sul"), ("Inga", None, 12.5, None, "peru")}


def subday(first, hours=24):
    lines = ["simulation title", "jday mon day yr tstep unit gis_id name flo_out", "m^3/h"]
    lines += [f" 1 1 1 2027 {first + h} 1 {c} cha{c}   {3600.0 * (h + c)}" for h in range(hours) for c in (7, 9)]
    return "\n".join(lines) + "\n"


NAMES = ("jday", "mon", "day", "yr", "tstep", "unit", "gis_id", "name", "flo_out")


@pytest.mark.parametrize("first", [0, 1])
def test_subday_steps(spark, tmp_path, first):
    path = put(tmp_path / "channel.txt", subday(first))
    ids = spark.createDataFrame([(9,)], "id int")
    rows = text.channel_subday(text.read_lines(spark, path), NAMES, ids).orderBy("ts").collect()
    assert len(rows) == 24 and {r["channel"] for r in rows} == {9}
    assert (rows[0]["ts"], rows[0]["flo_out"], rows[23]["flo_out"]) == (dt.datetime(2027, 1, 1), 9.0, 32.0)


def test_subday_rejects_other_steps(spark, tmp_path):
    path = put(tmp_path / "channel.txt", subday(2))
    with pytest.raises(Exception, match="unexpected step range"):
        text.channel_subday(text.read_lines(spark, path), NAMES).collect()


def test_weather_files_round_trip(spark, tmp_path):
    rows = [("s1000n2000e", 1.0, 2.0, dt.date(2027, 3, d), 20.0 + d, None if d == 2 else 10.0) for d in (1, 2, 3)]
    series = spark.createDataFrame(rows, "station string, lat double, lon double, date date, tmax double, tmin double")
    folder = str(tmp_path / "weather")
    sinks.write_station_weather(sinks.station_weather_lines(series, "tmp"), folder)
    lines = spark.read.text(folder).filter("ext = 'tmp'").select("value").collect()
    assert len(lines) == 6
    back = text.temperature(text.read_lines(spark, folder + "/station=s1000n2000e/ext=tmp")).orderBy("date").collect()
    assert [(r["date"], r["tmax"], r["tmin"], r["tmp_ave"]) for r in back] == [
        (dt.date(2027, 3, 1), 21.0, 10.0, 15.5), (dt.date(2027, 3, 2), 22.0, None, None), (dt.date(2027, 3, 3), 23.0, 10.0, 16.5)]


def test_weather_station_catalogue(spark, tmp_path):
    path = put(tmp_path / "weather-sta.cli", "title\nname wgn pcp tmp slr hmd wnd wnd_dir atmo_dep\ns31500n108900e w1 a.pcp a.tmp a.slr a.hmd a.wnd null null\n")
    row = text.weather_stations(text.read_lines(spark, path)).first()
    assert (row["pcp"], row["lat"], row["lon"]) == ("a.pcp", 31.5, 108.9)


def test_array_archives(spark, tmp_path):
    cube = np.arange(8784 * 2 * 2, dtype=float).reshape(8784, 2, 2)
    cube[5, 0, 1] = np.nan
    buffer = io.BytesIO()
    np.savez(buffer, Q_in_nat=cube, Q_out=cube * 2, simulation_years=np.array([2027, 2028]), hrs_byyear=np.array([8760.0, 8784.0]))
    (tmp_path / "run.npz").write_bytes(buffer.getvalue())
    flow = tables.read_cubes(spark, str(tmp_path), {"Q_in_nat": "nat", "Q_out": "CONV", "absent": "x"})
    assert flow.count() == 2 * 2 * (8760 + 8784)
    got = {r["scenario"]: r["q"] for r in flow.filter("year = 2028 and hoy = 8783 and station_idx = 1").collect()}
    assert got == {"nat": cube[8783, 1, 1], "CONV": 2 * cube[8783, 1, 1]}
    assert flow.filter("q is null").count() == 2 and flow.filter("year = 2027").agg(F.max("hoy")).first()[0] == 8759


def test_xml_rows(spark, tmp_path):
    path = put(tmp_path / "load.xml", "<root><DataTable><DT>2020-01-01T00:10:00</DT><MW>5.5</MW></DataTable><DataTable><DT>2020-01-01T00:20:00</DT><MW>x</MW></DataTable></root>")
    rows = loads.read_xml(spark, path, area="vn").collect()
    assert [tuple(r) for r in rows] == [("vn", dt.datetime(2020, 1, 1, 0, 10), 5.5)]


def test_delimited_with_lead_in(spark, tmp_path):
    path = put(tmp_path / "on.csv", "Report A\nmade 2020-01-02\nall times local\nDate,Hour,Ontario Demand\n2020-01-01,1,15000\n2020-01-01,24,14000\n")
    df = loads.read_delimited(spark, path, ["Date", "Hour", "Demand"], header_starts="Date,")
    ts = F.timestamp_add("HOUR", F.col("Hour").cast("int") - 1, loads.parse_time("Date", "yyyy-MM-dd"))
    rows = loads.load_rows(df, F.lit("on"), ts, loads.number("Demand")).collect()
    assert [(r["ts"], r["load_mw"]) for r in rows] == [(dt.datetime(2020, 1, 1), 15000.0), (dt.datetime(2020, 1, 1, 23), 14000.0)]
    semi = put(tmp_path / "br.csv", "t;area;mw\n2020-01-01 05:00:00;SUL;7.5\n")
    assert [tuple(r) for r in loads.read_delimited(spark, semi, ["t", "area", "mw"], sep=";").collect()] == [("2020-01-01 05:00:00", "SUL", "7.5")]


def test_metric_table_replaces_only_its_run(spark, tmp_path):
    path = str(tmp_path / "metrics")

    def rows(region, value):
        df = spark.createDataFrame([(region, "g", "s", "t", 1, 2.0, value)], "region string, gcm string, ssp string, scenario_tag string, station_idx int, n double, r double")
        return sinks.metric_rows(df.withColumn("scenario", F.lit("CONV")), "sediment", "STCI", "n", "r", param="b_low")
    assert rows("a", 1.0).columns == METRIC.names
    sinks.write_long_table(rows("a", 1.0).unionByName(rows("b", 4.0)), path)
    sinks.write_long_table(rows("a", 8.0), path)
    back = {r["region"]: r["ratio"] for r in spark.read.parquet(path).collect()}
    assert back == {"a": 4.0, "b": 2.0}


def test_catalogue_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "flow")
    rows = [(r, "g", "s", t, "nat", 0, 2027, 0, 1.0) for r in ("peru", "brazil_sul", "brazil_norte") for t in ("", "flat")]
    df = spark.createDataFrame(rows, FLOW)
    df.withColumn("tag", F.when(F.col("tag") == "", "base").otherwise(F.col("tag"))).write.partitionBy("region", "gcm", "ssp", "tag").parquet(path)
    got = {(r["region"], r["tag"]) for r in tables.scenario_catalog(spark, path, tag="flat", contains="brazil").collect()}
    assert got == {("brazil_sul", "flat"), ("brazil_norte", "flat")}
    plan = tables.scenario_catalog(spark, path, regions=["peru"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(region" in plan


def test_column_notes_survive_parquet(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.with_metadata(spark.range(3), {"id": {"unit": "m3/s"}}).write.parquet(path)
    assert spark.read.parquet(path).schema["id"].metadata["unit"] == "m3/s"


def test_named_outputs(spark, tmp_path):
    sinks.write_outputs({"a": spark.range(3), "b": spark.range(4)}, str(tmp_path / "out"))
    assert [spark.read.parquet(str(tmp_path / "out" / n)).count() for n in "ab"] == [3, 4]


def test_row_order_is_total_across_files(spark, tmp_path):
    a = put(tmp_path / "z" / "a.csv", "name,lat\n" + "".join(f"a{i},{i}\n" for i in range(50)))
    b = put(tmp_path / "b.csv", 'lat,name\n1,"b, 0"\n2,b1\n')
    rows = tables.read_station_csv(spark, [a, b], STATION).orderBy("row_ord").collect()
    assert [r["name"] for r in rows] == [*(f"a{i}" for i in range(50)), "b, 0", "b1"]
    assert len({tuple(r["row_ord"]) for r in rows}) == 52


def test_quoted_separator_is_kept(spark, tmp_path):
    path = put(tmp_path / "q.csv", 'made by x\nDate,Area,MW\n2020-01-01,"South, east",5\n2020-01-02,North,6\nDate,Area,MW\nshort,line\n')
    df = loads.read_delimited(spark, path, ["Date", "Area", "MW"], header_starts="Date,")
    assert {tuple(r) for r in df.collect()} == {("2020-01-01", "South, east", "5"), ("2020-01-02", "North", "6")}
