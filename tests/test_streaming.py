from pyspark.sql import functions as F

from siltstone.streaming.upserts import windowed_counts


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    source = str(tmp_path / "in")
    batches = [[("10:05", "a"), ("10:40", "b")], [("13:10", "a"), ("10:30", "a")], [("12:30", "a"), ("16:00", "b")], [("20:00", "a"), ("10:20", "a")]]
    schema = "at timestamp, kind string"
    for n, rows in enumerate(batches):
        made = spark.createDataFrame(rows, "t string, kind string").select(F.to_timestamp(F.concat(F.lit("2030-01-01 "), "t")).alias("at"), "kind")
        made.coalesce(1).write.mode("append").parquet(f"{source}/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{source}/*")
    counted = windowed_counts(stream, "at", "1 hour", "2 hours", "kind").select(F.date_format("window.start", "HH:mm").alias("start"), "kind", "rows")
    query = counted.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    # 13:10 makes what is before 11:10 late, from the next batch but one on: 10:20 isn't counted any more
    got = sorted(map(tuple, spark.table("late").collect()))
    assert got == [("10:00", "a", 2), ("10:00", "b", 1), ("12:00", "a", 1), ("13:00", "a", 1), ("16:00", "b", 1)]
