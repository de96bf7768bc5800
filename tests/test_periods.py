"""Documents read period by period: split files, prefixes, broken parts."""

import datetime as dt

import pytest
from helpers import T0, as_set, hours, noise_series
from pyspark.sql import functions as F
from test_storage import DOC

from loadcast.sources.documents import (
    build_load_xml,
    corrupt_periods,
    land_documents,
    parse_load_periods,
    parse_load_xml,
    read_load_documents,
    read_load_periods,
)


def land(path, **files):
    for name, text in files.items():
        folder = path / f"country={name[:2]}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.xml").write_text(text)
    return str(path)


def period(i, points=24):
    inner = "".join(f"<Point><position>{k + 1}</position><quantity>{i * 24 + k}</quantity></Point>" for k in range(points))
    day = dt.date(1990, 1, 1) + dt.timedelta(days=i)
    return f"<Period><timeInterval><start>{day}T00:00Z</start></timeInterval><resolution>PT60M</resolution>{inner}</Period>"


def test_one_large_line_is_read_by_many_tasks(spark, tmp_path):
    n = 4000
    text = "<Doc><TimeSeries>" + "".join(map(period, range(n))) + "</TimeSeries></Doc>"
    path = land(tmp_path, FRa=text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows = read_load_periods(spark, path)
        tasks = rows.groupBy(F.spark_partition_id()).count().collect()
        points = parse_load_periods(rows).agg(F.count("*"), F.sum("quantity_MW"), F.count_distinct("datetime")).first()
        found = corrupt_periods(rows).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(text) > 6_000_000 and len(tasks) > 20 and max(r["count"] for r in tasks) < n / 10
    assert tuple(points) == (24 * n, float(sum(range(24 * n))), 24 * n)
    assert tuple(found) == (n, 0)


def test_the_same_points_as_from_whole_documents(spark, tmp_path):
    odd = DOC.format(res="PT15M").replace("<Period>", '<Period id="1">', 1)
    direct = "<Doc>" + period(1) + "\n" + period(2) + "</Doc>"
    path = land(tmp_path, FRa=DOC.format(res="PT60M"), ESa=odd, ESb=direct, PTa="<Doc><Periods/></Doc>", PTb="", PTc="no XML")
    whole = parse_load_xml(read_load_documents(spark, path))
    assert as_set(parse_load_periods(read_load_periods(spark, path))) == as_set(whole) and whole.count() == 3 + 3 + 48


def test_prefixes_and_broken_parts(spark, tmp_path):
    prefixed = '<n:Doc xmlns:n="urn:x">' + period(1).replace("<", "<n:").replace("<n:/", "</n:") + "</n:Doc>"
    rows = read_load_periods(spark, land(tmp_path / "a", FRa=prefixed), "n:Period")
    assert parse_load_periods(rows).count() == 24
    whole = "<Doc>" + period(1) + period(2) + period(3) + "</Doc>"
    wrong = whole.replace("<position>5</position>", "<position>5</quantity>", 1)
    path = land(tmp_path / "b", FRa=whole, FRb=whole[: whole.rindex("<Point>") + 20], FRc=wrong)
    rows = read_load_periods(spark, path)
    assert tuple(corrupt_periods(rows).first()) == (9, 2)
    assert parse_load_periods(rows).count() == 24 * 7
    assert parse_load_periods(rows.limit(0)).count() == 0 and tuple(corrupt_periods(rows.limit(0)).first()) == (0, 0)


def test_landed_readings_come_back(spark, tmp_path):
    panel = hours(spark, {"A": noise_series(50), "B": noise_series(30, 2)})
    path = land_documents(build_load_xml(panel, 60), str(tmp_path / "landed"))
    back = parse_load_periods(read_load_periods(spark, path)).select("datetime", "country", F.col("quantity_MW"))
    assert as_set(back) == as_set(panel.select("datetime", "country", "quantity_MW"))


def test_two_readings_in_a_step_are_an_error(spark):
    twice = hours(spark, {"A": [1.0]}).unionAll(hours(spark, {"A": [2.0]}, T0 + dt.timedelta(minutes=20)))
    assert build_load_xml(twice, 20).count() == 1
    with pytest.raises(Exception, match="two readings in one step"):
        build_load_xml(twice, 60).collect()
