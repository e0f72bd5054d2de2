"""Queries that write files from tables first, on rows of their own."""

import datetime
import sys

import pytest

sys.path.insert(0, ".")
import __spark_entry__ as entry_points  # noqa: E402

QUERIES = entry_points.queries()


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of tables, each from rows and a schema."""
    def make(**given):
        for name, (rows, schema) in given.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def counter_tables():
    ts, at = "timestamp_ntz", datetime.datetime
    events = [(i, at(2024, 1, day, 5), kind, 70.0) for i, (kind, day) in enumerate([("click", 3), ("click", 3), ("click", 20), ("view", 3)])]
    # Days of one month and of months on both sides of 1995-02-01; two orders share a day.
    orders = [(i, at(*day)) for i, day in enumerate([(1994, 12, 31), (1995, 1, 1), (1995, 1, 2), (1995, 1, 2), (1997, 5, 6), (1997, 5, 7), (1997, 5, 31)])]
    return {"events": (events, f"event_id long, ts {ts}, event_type string, value double"),
            "orders": (orders, f"o_orderkey long, o_orderdate {ts}"), "region": ([(0,), (1,)], "r_regionkey int")}


def test_counter_file_audit_counts_a_file_for_every_day_of_all_orders(spark, tables):
    got = {r.kind: (r.n_files, r.n_unreadable, r.n_lacking) for r in QUERIES["counter_file_audit"](spark, tables(**counter_tables())).collect()}
    assert got == {"click": (2, 0, 0), "view": (1, 0, 0), "other": (6, 0, 6), "silent": (2, 2, 0)}


def test_station_files_are_written_and_landed_by_every_task(spark, tables):
    """More parts of the table are more files, and rows that several steps read lie in the shared folder as Parquet."""
    from daygauge.plans import files as plans
    from daygauge.sources import audits

    day = datetime.datetime(1996, 1, 2)
    line = [("N", day, 20.0, 0.02, 0.05, 30000.0, 1, "F")] * 60
    schema = ("l_returnflag string, l_shipdate timestamp_ntz, l_quantity double, l_tax double, l_discount double, "
              "l_extendedprice double, l_linenumber int, l_linestatus string")
    root = tables(region=([(0,)], "r_regionkey int"))
    spark.createDataFrame(line, schema).repartition(6).write.parquet(f"{root}/lineitem.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 27)  # a task for each file of the table
    try:
        path = plans.write_station_files(spark, root)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(spark.read.option("pathGlobFilter", "*.csv").text(path + "/station=N").inputFiles()) == 6
    rows = audits.landed(audits.station_hours(spark, path, plans.STATION_IN_PATH))
    assert rows.count() == 60 and all(f.endswith(".parquet") for f in rows.inputFiles()) and rows.first().timestamp == day


def test_survey_files_do_not_grow_with_the_table(spark, tables, monkeypatch):
    from daygauge.plans import files as plans

    docs = [(i, f'text "{i}"\nof two lines', "en", f"src{10 + i % 10}", 20) for i in range(50)]
    root = tables(documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"),
                  labels=([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    monkeypatch.setattr(plans, "ANSWERS_A_FILE", 3)
    path = plans.write_survey(spark, root)
    reader = spark.read.option("recursiveFileLookup", True).options(header=True, multiLine=True, escape='"')
    assert reader.csv(path + "/a").count() + reader.csv(path + "/b").count() == 50
    sizes = reader.csv(path + "/a").groupBy("_metadata.file_path").count().collect()
    assert max(r["count"] for r in sizes) <= 3


def test_profile_of_a_table_without_rows_has_no_column(spark):
    from daygauge.operators import quality as ql

    rows = spark.createDataFrame([], "date date, a double, b string")
    values = ql.value_table(rows, ["a", "b"], date="date")
    assert ql.column_profile(rows, ["a", "b"], values=values).count() == 0
