"""Completion per file over a stream: once at k of n, expiry by timer, the same after a restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sequora.streaming import streams

START = dt.datetime(2024, 1, 1)
ROWS = [  # (file, piece, minute, needed)
    ("a", 1, 0, 3), ("a", 1, 1, 3), ("a", 2, 2, 3), ("b", 7, 3, 2),
    ("a", 5, 10, 3), ("a", 6, 11, 3), ("c", 1, 12, 1), ("d", 4, 13, 9),
    ("a", 9, 20, 3), ("b", 7, 21, 2), ("b", 8, 22, 2), ("c", 1, 23, 1),
    ("e", 1, 300, 5), ("b", 9, 301, 2), ("e", 1, 302, 5), ("b", 9, 303, 2),
    ("f", 1, 900, 1), ("d", 5, 901, 9),
]
WANT = {("a", 3, 4, "complete", 10), ("b", 2, 3, "complete", 22), ("c", 1, 1, "complete", 12), ("d", 1, 1, "expired", 13), ("e", 1, 2, "expired", 302), ("f", 1, 1, "complete", 900)}


@pytest.mark.parametrize("restarts", [False, True])
def test_files_complete_once(spark, tmp_path, restarts):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = "file string, piece long, ts timestamp, needed long"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
        found = streams.completion(stream, "file", "piece", "ts", "needed", "1 hour")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()

    for i in range(0, len(ROWS), 4):
        rows = [(f, p, START + dt.timedelta(minutes=m), n) for f, p, m, n in ROWS[i : i + 4]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if restarts:
            run()
    if not restarts:
        run()
    run()
    got = spark.read.parquet(out).select("file", "pieces", "reads", "outcome", ((F.unix_seconds("at") - F.unix_seconds(F.lit(START).cast("timestamp"))) / 60).cast("int").alias("minute")).collect()
    assert sorted(map(tuple, got)) == sorted(WANT)
