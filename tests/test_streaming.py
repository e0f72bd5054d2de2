from daygauge.streaming import incremental


def test_only_new_files_are_taken_in(spark, tmp_path):
    arrivals, table, seen = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "seen")
    arrivals.mkdir()

    def run():
        stream = incremental.new_rows(spark, str(arrivals), "timestamp timestamp_ntz, v double")
        incremental.start_upsert(stream, table, ["timestamp"], ["source_file"], checkpoint=seen).awaitTermination()
        return {str(r.timestamp): r.v for r in spark.read.parquet(table).collect()}

    (arrivals / "a.csv").write_text("timestamp,v\n2024-01-01T00:00:00,1\n2024-02-01T00:00:00,2\n")
    assert run() == {"2024-01-01 00:00:00": 1.0, "2024-02-01 00:00:00": 2.0}
    (arrivals / "b.csv").write_text("timestamp,v\n2024-02-01T00:00:00,9\n")
    (arrivals / "c.csv").write_text("timestamp,v\n2024-02-01T00:00:00,7\n2024-02-01T01:00:00,5\n")
    assert run() == {"2024-01-01 00:00:00": 1.0, "2024-02-01 00:00:00": 7.0, "2024-02-01 01:00:00": 5.0}
    assert run() == {"2024-01-01 00:00:00": 1.0, "2024-02-01 00:00:00": 7.0, "2024-02-01 01:00:00": 5.0}
