"""Hand-made lines for the readers; the numbers of the rows are those of the fixture list."""

import zipfile

from aerolytics import operators as op
from aerolytics.sources import bad_rows, flights_from_lines, flights_from_wire, flights_from_wire_compat, load_raw_lines, read_flights, to_wire, unzip_csv, wide_lines
from pyspark.sql import functions as F

HEADER = ",".join(["f"] * 5 + ["FlightDate", "f", "f", "Carrier", "f", "FlightNum", "Origin"] + ["f"] * 5 + ["Dest", "DestCityName"] + ["f"] * 24)


def line(origin="JFK", dest="LAX", city='"New York, NY"', far='"Los Angeles, CA"', date="2008-04-03", carrier="WN", num="460", crs="1245", dep="1440", dd="115.00", ad="108.00"):
    t = [""] * 40
    t[5], t[8], t[10], t[11], t[12], t[17], t[18], t[23], t[24], t[25], t[36] = date, f'"{carrier}"', f'"{num}"', f'"{origin}"', city, f'"{dest}"', far, f'"{crs}"', f'"{dep}"', dd, ad
    return ",".join(t)


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_strict_reader(spark):
    rows = lines(spark, HEADER, line(), line(city='"Albuquerque"'), line(ad=""), line(dep="", dd="", ad=""), line(dd="abc"), ",".join(line().split(",")[:14]), line(origin="JFKX"), line(dd="NaN"), line(origin="SEA", dest="SEA"))
    f = flights_from_lines(rows).cache()
    assert f.count() == 7  # the header, the cut line and the long code are gone
    assert {(r.origin, r.dest) for r in f.collect()} == {("JFK", "LAX"), ("SEA", "SEA")}
    first = f.first()
    assert (str(first.flight_date), first.carrier, first.flight_num, first.crs_dep_time, first.dep_time, first.dep_delay, first.arr_delay) == ("2008-04-03", "WN", "460", "1245", "1440", 115.0, 108.0)
    assert f.filter("dep_delay IS NULL").count() == 3 and f.agg(F.sum("bad_delays")).first()[0] == 2
    assert bad_rows(rows).first().asDict() == {"lines": 10, "kept": 7, "dropped": 3, "bad_delays": 2}
    assert {r.airport: r.n for r in op.endpoint_counts(f).collect()} == {"JFK": 6, "LAX": 6, "SEA": 2}
    assert op.mean_delay(f, ["carrier"], "arr_delay").first().n == 5


def test_naive_reader_keeps_the_shift(spark):
    f = flights_from_lines(lines(spark, HEADER, line(), line(city='"Albuquerque"'), ",".join(line().split(",")[:15])), "naive").collect()
    assert [(r.origin, r.dest) for r in f] == [("Origin", "DestCityName"), ("JFK", "LAX"), ("JFK", "Los Angeles"), ("JFK", None)]
    assert f[1].arr_delay == 108.0 and f[1].dep_delay == 115.0


def test_files_globs_zip_and_raw_table(spark, tmp_path):
    for y in (2007, 2008):
        (tmp_path / f"perf_{y}_1.csv").write_text("\n".join([HEADER, line(date=f"{y}-01-02")]) + "\n")
    assert [str(r.flight_date) for r in read_flights(spark, f"{tmp_path}/*2008*.csv").collect()] == ["2008-01-02"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "perf_2007_1.csv", "x/perf.csv")
        z.writestr("readme.html", "no")
    got = unzip_csv(spark, str(tmp_path / "a.zip"))
    assert got.count() == 2 and flights_from_lines(got).count() == 1
    load_raw_lines(got, f"{tmp_path}/raw")
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 2


def test_wire(spark):
    f = flights_from_lines(lines(spark, line(), line(ad=""), line(dep="", dd="", ad="")))
    sent = to_wire(f).cache()
    assert sent.first().value == "JFK LAX 2008-04-03 WN 460 1245 1440 115.0 108.0"
    back = flights_from_wire(sent)
    assert back.select(sorted(back.columns)).exceptAll(f.drop("bad_delays").select(sorted(back.columns))).isEmpty()
    # any run of spaces: a missing field moves the later ones left
    assert flights_from_wire_compat(sent).count() == 1
    moved = flights_from_wire_compat(lines(spark, "JFK LAX 2008-04-03 WN 460 1245  115.0 108.0"), 8).first()
    assert (moved.dep_time, moved.dep_delay, moved.arr_delay) == ("115.0", 108.0, None)


def test_wide_lines(spark):
    rows = lines(spark, line(), ",".join(line().split(",")[:20]), '"a,b"' + "," * 37, "," * 37, "")
    assert wide_lines(rows).count() == 2  # a quoted comma counts, as quotes are deleted first
    assert wide_lines(rows, 10).count() == 4
