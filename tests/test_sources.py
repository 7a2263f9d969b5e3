import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from custvalue.operators import cleaning
from custvalue.operators.periods import Period
from custvalue.operators.scoring import LinearModel
from custvalue.plans import Inputs, documents, load_reports, publish
from custvalue.sources import (
    CONTACTS,
    TRANSACTIONS,
    read_contacts,
    read_geo,
    read_table,
    read_transactions,
    venue_coordinates,
    write_json,
    write_table,
)
from tests.conftest import rows_of


def test_transactions_from_csv(spark, tmp_path):
    path = tmp_path / "tx.csv"
    path.write_text(
        "Location,CtcID,OrderDate,Extra,Transactional Value,Source\n"
        '"The Hare, Old",7,2022-04-30 18:22:01,x,12.5,Web\n'
        "NaN,8,2022-04-29 00:00:00,x,-3,n/a\n"
        ",NA,2022-04-28,,null,App\n"
        "B,9007199254740993,2022-04-28,,1,App\n"
        "B,12.0,2022-04-28,,1,App\n"
    )
    tx = read_transactions(spark, str(path))
    assert [(f.name, f.dataType) for f in tx.schema] == [(f.name, f.dataType) for f in TRANSACTIONS]
    assert sorted(rows_of(tx), key=lambda r: (r[0] is None, r[0])) == [
        (7, dt.date(2022, 4, 30), "Web", "The Hare, Old", 12.5),
        (8, dt.date(2022, 4, 29), None, None, -3.0),
        (12, dt.date(2022, 4, 28), "App", "B", 1.0),
        (9007199254740993, dt.date(2022, 4, 28), "App", "B", 1.0),
        (None, dt.date(2022, 4, 28), "App", None, None),
    ]
    assert cleaning.as_of(tx).first()[0] == dt.date(2022, 4, 30)


HEADER = "CtcID,OrderDate,Source,Location,Transactional Value"


def test_a_file_with_another_column_order_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEADER}\n1,2022-01-01,web,PLACE,3\n")
    (tmp_path / "b.csv").write_text("CtcID,OrderDate,Location,Source,Transactional Value\n2,2022-01-01,PLACE,web,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_transactions(spark, str(tmp_path)).collect()


def test_files_with_one_header_read_together(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.csv").write_text(f"{HEADER}\n1,2022-01-01,{name},PLACE,3\n")
    assert rows_of(read_transactions(spark, str(tmp_path)), "source", "location") == [(n, "PLACE") for n in "abc"]


@pytest.mark.parametrize("number", ["12.7", "1e3", "x", "99999999999999999999"])
def test_an_id_that_is_no_whole_number_raises(spark, tmp_path, number):
    (tmp_path / "a.csv").write_text(f"{HEADER}\n{number},2022-01-01,web,PLACE,3\n")
    with pytest.raises(Exception, match="not a whole number"):
        read_transactions(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("number, expected", [("9007199254740993.0", 9007199254740993), (" -7.00 ", -7), ("+5", 5)])
def test_long_ids_written_with_zeros_stay_exact(spark, tmp_path, number, expected):
    (tmp_path / "a.csv").write_text(f"{HEADER}\n{number},2022-01-01,web,PLACE,3\n")
    assert rows_of(read_transactions(spark, str(tmp_path)), "ctc_id") == [(expected,)]


def test_typed_formats_keep_their_texts(spark, tmp_path):
    path = str(tmp_path / "tx")
    kinds = "ctc_id double, order_date date, source string, location string, value double"
    rows = [(12.0, dt.date(2022, 1, 1), "nan", "NA", 1.0), (float("nan"), dt.date(2022, 1, 1), "", "null", 2.0)]
    spark.createDataFrame(rows, kinds).write.parquet(path)
    assert rows_of(read_transactions(spark, path, "parquet"), "ctc_id", "source", "location") == [
        (12, "nan", "NA"), (None, "", "null"),
    ]
    for wrong in (12.7, 2.0**60):
        spark.createDataFrame([(wrong, None, "a", "b", 1.0)], kinds).write.mode("overwrite").parquet(path)
        with pytest.raises(Exception, match="not a whole number"):
            read_transactions(spark, path, "parquet").collect()


def test_contacts_from_csv(spark, tmp_path):
    path = tmp_path / "contacts.csv"
    path.write_text(
        "CtcID,PostCode,Age,BirthDate,Age Category\n1,,,,25-34\n2,RG1,41,1981-02-03,\n3,RG1,41,1981-02-03,35-44\n"
    )
    contacts = read_contacts(spark, str(path))
    assert [f.dataType for f in contacts.schema] == [f.dataType for f in CONTACTS]
    assert rows_of(cleaning.clean_contacts(contacts)) == [(1, "25-34"), (3, "35-44")]


def test_geo_and_parquet_inputs(spark, tmp_path):
    path = str(tmp_path / "geo")
    spark.createDataFrame([("A", 1.5, 2.5)], "Location string, Latitude double, Longitude double") \
        .write.parquet(path)
    assert rows_of(read_geo(spark, path, "parquet")) == [("A", 1.5, 2.5)]


def test_csv_scan_reads_only_needed_columns(spark, tmp_path):
    path = tmp_path / "tx.csv"
    path.write_text("CtcID,OrderDate,Source,Location,Transactional Value\n1,2022-01-01,w,A,3\n")
    plan = read_transactions(spark, str(path)).select("ctc_id")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<CtcID:string>" in plan


def test_written_table_keeps_types_and_prunes_partitions(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3 + 2020).alias("year"), F.lit("x").alias("s"))
    back = write_table(df, str(tmp_path / "t"), ("year",))
    assert back.schema.simpleString() == df.schema.simpleString()
    assert rows_of(back) == rows_of(df)
    plan = back.filter("year = 2021")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert read_table(spark, str(tmp_path / "t")).count() == 100
    assert rows_of(write_table(df.limit(1), str(tmp_path / "t"))) == rows_of(df.limit(1))


def test_json_sink_keeps_missing_values(spark, tmp_path):
    write_json(spark.createDataFrame([(None, 1)], "a string, b int"), str(tmp_path / "j"))
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"a":null,"b":1}']


def test_files_to_dashboard(spark, tmp_path):
    """From the two source files to the document of one venue, all defaults."""
    lines = ["CtcID,OrderDate,Source,Location,Transactional Value"]
    for customer in range(40):
        for visit in range(1 + customer % 4):
            day = dt.date(2021, 1 + customer % 12, 1 + 7 * visit)
            place = "The Sun Inn" if customer % 3 else "Reigate"
            lines.append(f"{customer},{day} 12:00:00,Web,{place},{10 + customer}")
    (tmp_path / "tx.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "contacts.csv").write_text(
        "CtcID,PostCode,Age,BirthDate,Age Category\n"
        + "".join(f"{c},,,,{'18-24' if c % 2 else '25-34'}\n" for c in range(30))
    )
    inputs = Inputs(
        read_transactions(spark, str(tmp_path / "tx.csv")),
        read_contacts(spark, str(tmp_path / "contacts.csv")),
        venue_coordinates(spark),
        LinearModel(5, {"value": 1.5}),
        LinearModel(100, {"day_of_week": 3}),
    )
    written = publish(inputs, str(tmp_path / "reports"), with_transactions=True)
    assert rows_of(written["transactions"]) == rows_of(inputs.transactions)
    reports = load_reports(spark, str(tmp_path / "reports"))
    row = documents.dashboard(reports, "The Sun Inn", Period.from_params())
    doc = json.loads(documents.as_json(row).first()[0])
    graph = doc["prediction_graph"]
    assert len(graph["day_of_year"]) == 395 and graph["map_location"] == ["Reigate", "The Sun Inn"]
    assert doc["all_cus_clv"]["users"] == 26
    assert doc["analytics_graph"]["age_category"] == ["18-24", "25-34"]
    assert doc["executive_summary"]["orders_prev"] == "-"


def test_publish_passes_over_the_transactions_twice(spark, tmp_path):
    """Once for the as-of date, the locations and the pairs to number, once for the distinct visits."""
    read = spark.sparkContext.accumulator(0)

    def counted(row):
        read.add(1)
        return row

    rows = [
        (c, dt.date(2021, 1 + c % 12, 1 + v), f"s{v % 2}", f"place {c % 3}", 10.0 + c) for c in range(30) for v in range(1 + c % 4)
    ] + [(1, dt.date(2022, 5, 5), "late", "closed", None), (None, None, None, None, 1.0)]
    schema = "ctc_id long, order_date date, source string, location string, value double"
    tx = spark.createDataFrame(rows, schema)
    geo = venue_coordinates(spark)
    contacts = spark.createDataFrame([(1, "x", 30, None, "25-34")], "ctc_id long, post_code string, age int, birth_date date, age_category string")
    models = LinearModel(5, {"value": 1.5}), LinearModel(100, {"day_of_week": 3})
    several = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(counted), schema)
    written = publish(Inputs(several, contacts, geo, *models), str(tmp_path / "r"))
    assert read.value == 2 * len(rows)
    assert rows_of(written["as_of"]) == [(dt.date(2022, 5, 5),)]
    assert rows_of(written["locations"]) == [("closed",), ("place 0",), ("place 1",), ("place 2",)]
    parts = publish(Inputs(tx, contacts, geo, *models), str(tmp_path / "p"), state=str(tmp_path / "state"))
    for name in ("as_of", "clv", "locations", "weekday_revenue"):
        assert rows_of(parts[name]) == rows_of(written[name])
