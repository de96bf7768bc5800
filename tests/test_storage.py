import datetime as dt

import pytest
from helpers import T0, as_set, hours, noise_series
from pyspark.sql import functions as F

from loadcast.functions.clock import floor_hour, resolution_minutes, resolution_seconds, time_parts
from loadcast.operators.windows import flat_matrix, panel_frame, sequence_windows, step_columns, window_country_id
from loadcast.session import scratch_path
from loadcast.sources import datasets as D
from loadcast.sources.documents import build_load_xml, parse_load_xml, read_load_documents, request_grid
from loadcast.sources.measurements import scan_measurements, write_base

V = "quantity_MW"

DOC = """<?xml version="1.0"?>
<GL_MarketDocument xmlns="urn:load:3:0"><mRID>x</mRID><TimeSeries><mRID>1</mRID>
<Period><timeInterval><start>2024-01-01T00:00Z</start><end>2024-01-01T01:00Z</end></timeInterval><resolution>{res}</resolution>
<Point><position>1</position><quantity>10</quantity></Point>
<Point><position>2</position><quantity>11.5</quantity></Point>
<Point><position>3</position></Point><Point><quantity>4</quantity></Point></Period>
<Period><timeInterval><start>2024-01-02T00:00Z</start></timeInterval><resolution>PT60M</resolution>
<Point><position>3</position><quantity>7</quantity></Point></Period></TimeSeries></GL_MarketDocument>"""


def parsed(spark, text):
    df = spark.createDataFrame([("FR", text)], "country string, xml string")
    return {(r.datetime, r.quantity_MW) for r in parse_load_xml(df).collect()}


@pytest.mark.parametrize("res, second", [("PT15M", dt.timedelta(minutes=15)), ("PT60M", dt.timedelta(hours=1)), ("PT1H", dt.timedelta(hours=1))])
def test_xml_points(spark, res, second):
    later = dt.datetime(2024, 1, 2, 2)
    assert parsed(spark, DOC.format(res=res)) == {(T0, 10.0), (T0 + second, 11.5), (later, 7.0)}


def test_xml_odd_documents(spark):
    assert {q for t, q in parsed(spark, DOC.format(res="P1M")) if t is None} == {10.0, 11.5}
    assert parsed(spark, "<Ack><reason>none</reason></Ack>") == set()
    assert parsed(spark, "this is not xml") == set()
    root_period = "<Doc><Period><timeInterval><start>2024-01-01T00:00:00Z</start></timeInterval><resolution>PT60M</resolution><Point><position>1</position><quantity>3</quantity></Point></Period></Doc>"
    assert parsed(spark, root_period) == {(T0, 3.0)}


def test_xml_files_with_series_folders(spark, tmp_path):
    for country in ("FR", "ES"):
        folder = tmp_path / f"country={country}"
        folder.mkdir()
        (folder / "day.xml").write_text(DOC.format(res="PT60M"))
    rows = parse_load_xml(read_load_documents(spark, str(tmp_path)))
    assert rows.count() == 6 and {r.country for r in rows.collect()} == {"FR", "ES"}


def test_xml_round_trip(spark):
    df = hours(spark, {"A": noise_series(50), "B": noise_series(7)})
    back = parse_load_xml(build_load_xml(df, 60)).select("datetime", "country", V)
    assert as_set(back) == as_set(df)


def test_resolution_and_grid(spark):
    durations = {"PT15M": 900, "PT1H": 3600, "P1D": 86_400, "P7D": 604_800, "PT1H30M": 5400, "PT30S": 30, "P1DT1H": 90_000}
    durations |= dict.fromkeys(["", None, "PTxM", "P", "PT", "P1DT", "P1M", "P1Y", "PT15", "15M"])
    texts = spark.createDataFrame([(t,) for t in durations], "t string")
    found = texts.select(resolution_seconds(F.col("t")), resolution_minutes(F.col("t"))).collect()
    assert [r[0] for r in found] == list(durations.values())
    assert [r[1] for r in found] == [None if s is None or s % 60 else s // 60 for s in durations.values()]
    series = spark.createDataFrame([("FR",), ("ES",)], "country string")
    end = floor_hour(F.lit("2024-01-04 05:30:00").cast("timestamp"))
    grid = request_grid(series, end - F.make_dt_interval(days=F.lit(3)), end).collect()
    assert len(grid) == 6 and {r.period_start for r in grid} == {"202401010500", "202401020500", "202401030500"}
    assert {r.period_end for r in grid} == {"202401020500", "202401030500", "202401040500"}
    assert {(r.country, r.domain) for r in grid} == {("FR", "10YFR-RTE------C"), ("ES", "10YES-REE------0")}
    assert request_grid(series.select(F.lit("XX").alias("country")), F.lit("2024-01-01").cast("timestamp"), end).first().domain is None
    assert request_grid(series, end, end).count() == 0


def test_base_round_trip_and_pushdown(spark):
    df = hours(spark, {"A": noise_series(30), "B": noise_series(5)})
    path = write_base(df, scratch_path(spark, "base"), ["country"])
    rows = scan_measurements(spark, path, ["B"])
    assert as_set(rows) == as_set(df.where("country = 'B'"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [country" in plan.replace("cast(", "").replace("(", "") or "country" in plan.split("PartitionFilters")[1][:80]
    with pytest.raises(Exception):
        write_base(df, path)


def panel(spark):
    df = hours(spark, {"A": noise_series(60), "B": noise_series(60, 2)})
    return df.withColumn("split", F.when(F.col("datetime") < T0 + dt.timedelta(hours=40), "train").otherwise("test"))


GROUPS = ["split", "country"]


def test_flat_dataset(spark):
    flat = flat_matrix(panel(spark), [V], [V], 4, 2, groups=GROUPS)
    path = scratch_path(spark, "flat")
    features, targets = [V, *step_columns(V, "lag", 4), "country"], step_columns(V, "lead", 2)
    D.write_flat_split(flat, path, [*features, *targets], targets, ["country", "datetime"])
    meta = {r.split: r for r in D.read_meta(spark, path, "flat").collect()}
    assert set(meta) == {"train", "test"} and meta["train"].rows == 2 * (40 - 6)
    assert (meta["train"].x_dim, meta["train"].y_dim) == (5, 2) and meta["train"].basename.endswith("_train")
    rows = D.read_flat_split(spark, path, "test")
    assert rows.columns == ["country", "datetime", V, *step_columns(V, "lag", 4), *targets]
    assert rows.schema[V].dataType.simpleString() == "float" and rows.count() == 2 * (20 - 6)
    arrays = D.read_flat_split(spark, path, "test", arrays=True)
    assert {len(r.X) for r in arrays.collect()} == {5}
    with pytest.raises(ValueError):
        D.read_flat_split(spark, path, "val")


def test_sequence_dataset(spark):
    windows = window_country_id(sequence_windows(panel(spark).withColumn("h", F.hour("datetime")), [V, "h"], [V], 5, 2, GROUPS), "none")
    path = scratch_path(spark, "seq")
    D.write_seq_split(windows, path, [V, "h"], [V], 5, 2)
    rows = D.read_seq_split(spark, path, "train").collect()
    assert len(rows) == 2 * (40 - 6) and all(len(r.X) == 5 and len(r.X[0]) == 2 and len(r.Y) == 2 for r in rows)
    assert D.read_seq_split(spark, path, "train", steps=False).schema["X"].dataType.simpleString() == "array<float>"
    meta = D.read_meta(spark, path, "sequence").first()
    assert (meta.seq_len, meta.lead, meta.x_dim, meta.y_dim) == (5, 2, 2, 1)


def test_panel_dataset(spark):
    frame = panel_frame(time_parts(panel(spark)), GROUPS)
    path = scratch_path(spark, "panel")
    D.write_panel_split(frame, path, [V, "year", "month", "day", "hour", "minute"], [V], 6, 2)
    meta = {r.split: r for r in D.read_meta(spark, path, "panel").collect()}
    train = meta["train"]
    assert (train.rows, train.groups, train.lag, train.lead) == (80, 2, 6, 2)
    assert train.min_time == "2024-01-01T00:00:00+00:00" and train.max_time == "2024-01-02T15:00:00+00:00"
    assert train.tft_schema.time_varying_known_reals == ["time_idx", "year", "month", "day", "hour", "minute"]
    assert train.dtypes[V] == "double" and train.dtypes["time_idx"] == "int" and train.tft_schema.target == V
    assert D.read_panel_split(spark, path, "train").count() == 80
    windows = D.read_panel_split(spark, path, "train", windows=True, known=["hour"])
    assert windows.count() == 2 * (40 - 7) and {len(r.decoder_known) for r in windows.collect()} == {2}


def test_rows_per_file_bounds_files(spark, tmp_path):
    path = str(tmp_path / "d")
    D.write_splits(panel(spark).coalesce(1), path, rows_per_file=10)
    sizes = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in sizes) <= 10 and sum(r["count"] for r in sizes) == 120


def test_scratch_needs_a_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
