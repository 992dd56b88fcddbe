import datetime as dt

from pyspark.sql import functions as F

from lapidar.streaming import windows


def test_rows_too_late_are_dropped_and_changed_windows_replaced(spark, tmp_path):
    schema = "event_id int, ts timestamp, event_type string, value double"
    day = dt.datetime(2024, 5, 10, 12)

    def write(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "all" / name))

    write("a", [(1, day, "x", 1.0), (2, day + dt.timedelta(minutes=5), "x", 2.0)])
    write("b", [(3, day + dt.timedelta(minutes=10), "x", 4.0)])
    # one file after another: newest first in none, so the order is that of writing
    write("c", [(4, day - dt.timedelta(days=5), "x", 8.0), (5, day + dt.timedelta(minutes=50), "y", 16.0)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "all"))
    got = windows.drained(spark, stream, windows.event_counts, ["window_start", "event_type"])
    rows = {(r.event_type, r.n, r.total) for r in got.select("event_type", "n", "total").collect()}
    assert rows == {("x", 3, 7.0), ("y", 1, 16.0)}
    assert got.where(F.col("window_start") < "2024-05-09").count() == 0
