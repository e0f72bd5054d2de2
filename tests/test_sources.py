import datetime

import pytest

from daygauge.sources import columns as cl
from daygauge.operators import quality as ql
from daygauge.sources import counters, headers, intent, sinks, station, survey, weather


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_find_column_and_header():
    names = ["region", "overall rating", "service rating", "day"]
    assert cl.find_column(names, names=["date", "day"]) == "day"
    assert cl.find_column(names, contains=["rating"], without=["overall"]) == "service rating"
    assert cl.find_column(names, position=0) == "region" and cl.find_column(names, names=["x"]) is None
    header = [("時", "時"), ("風速", "風向"), ("風速・風向", "風速(m/s)")]
    assert cl.locate_header(header, "風速", level=1) == 2 and cl.locate_header(header, "風向", level=1) == 1
    assert cl.locate_header(header, "時") == 0 and cl.locate_header(header, "雪") is None


def test_counter_files(spark, tmp_path):
    write(tmp_path / "a/2024-01-01.csv", "aggregate from,aggregate to,total count\n00:00,00:05,3\n00:05,00:10,4\n")
    write(tmp_path / "b/2024-01-01.csv", "total count,aggregate from\n5,00:00\n")
    write(tmp_path / "a/2024-01-02.csv", "aggregate from,aggregate to,total count\n00:00,00:05,0\n")
    write(tmp_path / "a/2024-01-03.csv", "something,else\n1,2\n")
    write(tmp_path / "a/notes.csv", "aggregate from,total count\n00:00,8\n")
    files = counters.counter_files(spark, str(tmp_path))
    assert {(r.stem, r["count"]) for r in files.collect()} == {("2024-01-01", 7), ("2024-01-01", 5), ("2024-01-02", 0), ("notes", 8)}
    assert [(str(r.date), r["count"]) for r in counters.counter_days(files).collect()] == [("2024-01-01", 12)]
    assert counters.counter_days(files, drop_zero=False).count() == 2
    assert [str(r.date) for r in counters.zero_days(files).collect()] == ["2024-01-02"]
    by_site = counters.counter_files(spark, str(tmp_path), series_pattern=r"/([ab])/[^/]+$")
    assert {(r.series, r["count"]) for r in counters.counter_days(by_site, by_series=True).collect()} == {("a", 7), ("b", 5)}


def test_weather_paths(spark, tmp_path):
    write(tmp_path / "new/w.csv", "timestamp,temp_c,precip_1h_mm,snow_depth_cm\n2024-01-01 00:00:00,5.0,,\n2024-01-01 01:00:00,--,1.5,\n2024-01-02 00:00:00,1,,3\n")
    days = weather.read_weather_days(spark, str(tmp_path / "absent"), str(tmp_path / "new")).orderBy("date").collect()
    assert [(r.precip, r.temp, r.snow_depth) for r in days] == [(1.5, 5.0, None), (0.0, 1.0, 3.0)]
    with pytest.raises(FileNotFoundError):
        weather.read_weather_days(spark, str(tmp_path / "absent"))
    sites = weather.read_site_weather(spark, {"x": str(tmp_path / "new"), "y": str(tmp_path / "none")})
    assert {r.site for r in sites.collect()} == {"x"} and "wind" in sites.columns


def test_intent_years(spark, tmp_path):
    write(tmp_path / "2024/total_daily_metrics.csv", "date,directions\n2024-12-31,7\n2025-01-01,8\n")
    write(tmp_path / "2025/total_daily_metrics.csv", "calls,directions,date\n1,99,2025-01-01\n1,9,2025-01-02\n")
    got = {str(r.date): r.intent for r in intent.read_intent_days(spark, str(tmp_path), ["directions", "routes"]).collect()}
    assert got == {"2024-12-31": 7.0, "2025-01-01": 8.0, "2025-01-02": 9.0}
    with pytest.raises(ValueError):
        intent.read_intent_days(spark, str(tmp_path), ["routes"])


def test_survey_files(spark, tmp_path):
    write(tmp_path / "2023.csv", '県,回答日,満足度,おすすめ度,理由,不便\n甲県,2023-05-01,5,"10(強く)","良い\n景色",\n乙県,bad,4,8,,道\n')
    write(tmp_path / "2024.csv", "県,回答日,場所,サービス理由,理由,満足度\n甲県,2024-05-01,寺,店,静か,2\n")
    dates = survey.survey_dates(spark, str(tmp_path)).collect()
    assert {(r.prefecture, str(r.date)) for r in dates} == {("甲県", "2023-05-01"), ("甲県", "2024-05-01")}
    names = {"satisfaction": "満足度", "nps": "おすすめ度", "location": "場所", "reason": "理由", "inconvenience": "不便"}
    rows = {str(r.date): r for r in survey.survey_satisfaction(spark, str(tmp_path), names).collect()}
    assert rows["2023-05-01"].nps_raw == 10.0 and rows["2023-05-01"].reason == "良い\n景色" and rows["2023-05-01"].location == ""
    assert rows["2024-05-01"].satisfaction == 2.0 and rows["2024-05-01"].nps_raw is None and rows["2024-05-01"].location == "寺"
    texts = survey.survey_texts(spark, str(tmp_path), satisfaction="満足度", reason="理由", not_reason="サービス", inconvenience="不便", freetext="自由")
    assert {(str(r.date), r.reason) for r in texts.collect()} == {("2023-05-01", "良い\n景色"), ("2024-05-01", "静か")}  # the bad date goes


def test_no_column_is_cut_off_and_answers_keep_their_lines(spark, tmp_path):
    head = ",".join(["region", "day", *[f"c{i}" for i in range(68)], "rating", "reason"])
    rows = [",".join(["r", day, *["x"] * 68, "4", '"one\ntwo, ""so""\nthree"']) for day in ("2024/1/4 10:11", "2024-01-05", "soon")]
    write(tmp_path / "wide.csv", "\n".join([head, *rows]) + "\n")
    got = survey.survey_satisfaction(spark, str(tmp_path), {"satisfaction": "rating", "reason": "reason"}).collect()
    assert sorted((r.date.day, r.satisfaction, r.reason) for r in got) == [(d, 4.0, 'one\ntwo, "so"\nthree') for d in (4, 5)]
    raw = survey.raw_survey(spark, str(tmp_path / "wide.csv"), date="day", spending="rating", midpoints={"4": 1.0})
    assert raw.count() == 3


def test_raw_survey(spark, tmp_path):
    write(tmp_path / "raw.csv", "when,spent\n2024-01-02 10:00:00,low\nx,high\n")
    rows = survey.raw_survey(spark, str(tmp_path / "raw.csv"), date="when", spending="spent", midpoints={"low": 500.0}).collect()
    assert [(r.date, r.spending_midpoint) for r in rows] == [(datetime.date(2024, 1, 2), 500.0), (None, None)]
    assert survey.raw_survey(spark, str(tmp_path / "none.csv"), date="when", spending="spent", midpoints={"low": 1.0}).count() == 0


EXPORT = """ダウンロードした時刻：2024/02/01 10:00:00

,駅,駅,駅,駅,駅,駅,駅,駅,駅,駅,駅,駅,駅,駅
年月日時,気温(℃),気温(℃),降水量(mm),降水量(mm),降雪(cm),積雪(cm),日照時間(時間),風速(m/s),風速(m/s),風速(m/s),風速(m/s),天気,相対湿度(％),相対湿度(％)
,,,,,,,,,,風向,風向,,,
,,品質情報,,品質情報,,,,,品質情報,,品質情報,,,品質情報
2024/1/1 1:00:00,5.5,8,0.0,8,,3,0.2,4.1,8,北,8,晴,70,8
2024/1/1 2:00:00,×,8,1.5,8,0,,,2.0,8,北,8,,,1
bad,1,1,1,1,1,1,1,1,1,1,1,1,1,1
"""


def test_station_export(spark, tmp_path):
    write(tmp_path / "one.csv", EXPORT, "cp932")
    write(tmp_path / "other.csv", "no,header\n1,2\n", "cp932")
    rows = station.read_station_exports(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [str(r.timestamp) for r in rows] == ["2024-01-01 01:00:00", "2024-01-01 02:00:00"]
    assert (rows[0].temp_c, rows[0].wind_speed_ms, rows[0].weather_type, rows[0].humidity_pct, rows[0].snow_depth_cm) == (5.5, 4.1, "晴", 70.0, 3.0)
    assert (rows[1].temp_c, rows[1].precip_1h_mm, rows[1].weather_type, rows[1].humidity_pct) == (None, 1.5, None, None)
    assert rows[0].source_file == "one.csv"


def test_scraped_rows(spark):
    rows = spark.createDataFrame([("2024-12-31", "24", "5.0 )", "--"), ("2024-12-31", "3", "///", "1.5]"), ("2024-12-31", "時", "x", "y")],
                                 "date string, hour string, temp_c string, precip_1h_mm string")
    got = sorted((str(r.timestamp), r.temp_c, r.precip_1h_mm) for r in station.scraped_hours(rows).collect())
    assert got == [("2024-12-31 03:00:00", "", "1.5"), ("2025-01-01 00:00:00", "5.0", "")]


def test_monthly_upsert_leaves_other_months(spark, tmp_path):
    path = str(tmp_path / "table")

    def rows(*items):
        return spark.createDataFrame([(datetime.datetime.fromisoformat(t), v, s) for t, v, s in items], "timestamp timestamp_ntz, v double, source string")

    sinks.upsert_months(spark, path, rows(("2024-01-01T00:00:00", 1.0, "f0"), ("2024-02-01T00:00:00", 2.0, "f0")), ["timestamp"], ["source"])
    january = {p: p.stat().st_mtime_ns for p in (tmp_path / "table" / "month=2024-01").glob("*.parquet")}
    sinks.upsert_months(spark, path, rows(("2024-02-01T00:00:00", 9.0, "f1"), ("2024-02-02T00:00:00", 3.0, "f1")), ["timestamp"], ["source"])
    got = {str(r.timestamp): r.v for r in spark.read.parquet(path).collect()}
    assert got == {"2024-01-01 00:00:00": 1.0, "2024-02-01 00:00:00": 9.0, "2024-02-02 00:00:00": 3.0}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "table" / "month=2024-01").glob("*.parquet")} == january


def test_fixed_order_and_rename(spark):
    df = spark.createDataFrame([(1, 2.0)], "b int, temp_c double")
    assert sinks.fixed_order(df, ["a", "b"]).first().asDict() == {"a": "", "b": 1}
    assert cl.rename_missing(df, {"temp_c": "temp", "b": "temp_c"}).columns == ["b", "temp"]


def test_upsert_of_months_keeps_rows_without_time_and_stored_columns(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "k string, timestamp timestamp, v int"
    at = datetime.datetime(2024, 1, 5)
    sinks.upsert_months(spark, path, spark.createDataFrame([("a", None, 1, "old"), ("b", at, 2, "old")], schema + ", more string"), ["k"], ["v"])
    sinks.upsert_months(spark, path, spark.createDataFrame([("c", None, 3), ("b", at, 4)], schema), ["k"], ["v"])
    got = {r["k"]: (r["v"], r["more"]) for r in spark.read.parquet(path).collect()}
    assert got == {"a": (1, "old"), "b": (4, None), "c": (3, None)}


def test_upsert_of_months_follows_a_key_to_its_new_month(spark, tmp_path):
    path = str(tmp_path / "moved")
    schema = "k string, timestamp timestamp, v int"
    january, march = datetime.datetime(2024, 1, 9), datetime.datetime(2024, 3, 2)
    sinks.upsert_months(spark, path, spark.createDataFrame([("a", january, 1), (None, january, 2), ("c", march, 3)], schema), ["k"], ["v"])
    sinks.upsert_months(spark, path, spark.createDataFrame([("a", march, 4), (None, march, 5)], schema), ["k"], ["v"])
    got = sorted((str(r["k"]), r["month"], r["v"]) for r in spark.read.parquet(path).collect())
    assert got == [("None", "2024-03", 5), ("a", "2024-03", 4), ("c", "2024-03", 3)]


def test_a_later_line_like_the_header_is_data(spark, tmp_path):
    (tmp_path / "s.csv").write_text("name,n\nx,1\nname,n\n")
    rows = cl.cells_by_header(cl.read_cells(spark, str(tmp_path)), {"n": cl.named("n")})
    assert sorted(r.n for r in rows.collect()) == ["1", "n"]


def test_headers_with_line_breaks_are_read_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"place\nof ""stay"", in town","third\r\n\nline",b,wanted\n1,"x\ny",z,,yes\n')
    (tmp_path / "b.csv").write_text('\nid,5" pipe,c\n1,2,3\n')
    (tmp_path / "c.csv").write_text("")
    wanted = {"wanted": cl.named("wanted"), "c": cl.named("c")}
    by_cells = cl.cells_by_header(cl.read_cells(spark, str(tmp_path), multiline=True), wanted)
    for rows in (by_cells, cl.read_wanted(spark, str(tmp_path), wanted, multiline=True)):
        rows = rows.select("wanted", "c").collect()
        assert {tuple(r) for r in rows} == {("yes", None), (None, "3")} and len(rows) == 2


def test_leading_records():
    text = '\ufeff\n  \n"a\n""b""",c\r\n1,2\n'
    for size in (1, 3, 50):
        assert headers.leading_records(text[i:i + size] for i in range(0, len(text), size)) == [['a\n"b"', "c"]]
    assert headers.leading_records(["x,y"]) == [["x", "y"]] and headers.leading_records([]) is None
    lines = "t\n,u\nwhen,v,w\ns1,s2\nq\n1,2\n"
    assert headers.leading_records([lines], "when", 2)[-3:] == [["when", "v", "w"], ["s1", "s2"], ["q"]]
    assert headers.leading_records([lines], "absent") is None


@pytest.mark.parametrize("opens", [True, False])
def test_scan_follows_the_header_index(spark, tmp_path, monkeypatch, opens):
    monkeypatch.setattr(headers, "_opens", lambda uri: opens)
    write(tmp_path / "a b[1].csv", "name,n\nx,1\nname,n\n")
    write(tmp_path / "d/b.csv", "n,other\n2,y\n")
    write(tmp_path / "d/c.csv", "nothing\n3\n")
    write(tmp_path / "d/e.csv", "")
    index = headers.header_index(spark, str(tmp_path)).collect()
    assert sorted((r.header or [""])[0] for r in index) == ["", "n", "name", "nothing"]
    rows = cl.read_wanted(spark, str(tmp_path), {"n": cl.named("n"), "first": 0})
    assert sorted((r.n or "", r.first, r.has_n) for r in rows.collect()) == [("", "3", False), ("1", "x", True), ("2", "2", True), ("n", "name", True)]
    plan = rows._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan
    needed = cl.read_wanted(spark, str(tmp_path), {"n": cl.named("n")}, needed=["n"])
    assert sorted(r.n for r in needed.collect()) == ["1", "2", "n"]
    assert cl.read_wanted(spark, str(tmp_path / "d" / "none"), {"n": cl.named("n")}).count() == 0
    monkeypatch.setattr(headers, "SCANS", 1)  # too many kinds of headers for a scan each
    assert sorted(r.n for r in cl.read_wanted(spark, str(tmp_path), {"n": cl.named("n")}, needed=["n"]).collect()) == ["1", "2", "n"]


def test_damage_is_counted(spark, tmp_path):
    import gzip

    whole = "n,text\n" + "".join(f'{i},"line {i}\nof ""two"""\n' for i in range(40_000))
    packed = gzip.compress(whole.encode())
    (tmp_path / "whole.csv").write_text(whole)
    (tmp_path / "packed.csv.gz").write_bytes(packed)
    (tmp_path / "cut.csv.gz").write_bytes(packed[: len(packed) * 2 // 3])
    (tmp_path / "quote.csv").write_text('n,text\n1,a\n2,"b\n3,c\n4,d\n')
    (tmp_path / "none.csv").write_text("")
    audit = {r.file.rsplit("/", 1)[1]: r for r in cl.file_audit(spark, str(tmp_path), ["n"], multiline=True).collect()}
    assert {f: r.damage for f, r in audit.items()} == {"whole.csv": None, "packed.csv.gz": None, "cut.csv.gz": "truncated", "quote.csv": "open quote", "none.csv": None}
    assert audit["whole.csv"].n_records == audit["whole.csv"].n_read == audit["packed.csv.gz"].n_read == 40_001
    assert 0 < audit["cut.csv.gz"].n_records < 40_001
    assert audit["cut.csv.gz"].n_lost == max(audit["cut.csv.gz"].n_records - audit["cut.csv.gz"].n_read, 0)
    assert (audit["quote.csv"].n_records, audit["quote.csv"].n_read, audit["quote.csv"].n_lost) == (5, 3, 2)
    assert audit["none.csv"].n_read == 0 and not audit["none.csv"].readable
    counts = spark.createDataFrame([(datetime.date(2024, 1, 1), 5)], "date date, count bigint")
    errors = ql.counter_report(counts, files=cl.file_audit(spark, str(tmp_path), multiline=True)).first().errors
    lost = sum(r.n_lost for r in audit.values())
    assert f"2 damaged files, {lost} records known to be lost." in errors


@pytest.mark.parametrize("lost", ["before the swap", "amid the swap", "before the clean-up"])
def test_upsert_lost_after_its_commit_keeps_each_key_once(spark, tmp_path, monkeypatch, lost):
    """From the rename on the table is the new one; the next upsert finishes the swap."""
    path, schema = str(tmp_path / "t"), "k string, timestamp timestamp_ntz, v int"
    january, march, may = (datetime.datetime(2024, m, 1) for m in (1, 3, 5))
    sinks.upsert_months(spark, path, spark.createDataFrame([("a", january, 1), ("b", march, 2), ("c", may, 3), ("d", None, 4)], schema), ["k"], ["v"])

    class Lost(Exception):
        pass

    def stop(*_):
        raise Lost

    remove, recover, calls = sinks._remove, sinks.recover_months, []
    with monkeypatch.context() as m:
        if lost == "before the swap":
            m.setattr(sinks, "recover_months", lambda *a: stop() if calls else calls.append(recover(*a)))
        elif lost == "amid the swap":
            m.setattr(sinks, "_remove", stop)
        else:
            m.setattr(sinks, "_remove", lambda s, p: stop() if p.endswith(".pending") else remove(s, p))
        with pytest.raises(Lost):
            sinks.upsert_months(spark, path, spark.createDataFrame([("a", march, 5), ("d", may, 6)], schema), ["k"], ["v"])
    want = {"a": (march, 5), "b": (march, 2), "c": (may, 3), "d": (may, 6)}

    def held(rows):
        out = rows.collect()
        assert len(out) == len({r.k for r in out})
        return {r.k: (r.timestamp, r.v) for r in out}

    assert held(sinks.read_months(spark, path)) == want
    sinks.upsert_months(spark, path, spark.createDataFrame([("e", january, 7)], schema), ["k"], ["v"])
    assert held(spark.read.parquet(path)) == held(sinks.read_months(spark, path)) == want | {"e": (january, 7)}
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
