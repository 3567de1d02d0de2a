from pyspark.sql import functions as F

from postloom.operators.dedup import body_key
from postloom.operators.parse import parse_messages
from postloom.streaming import ingest


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [(f"f{i}", f"Date: Thu, 24 Jun 2021 1{i % 10}:00:00 +0000\nFrom: a{i % 2}@x.example\n\nbody {i % 4}") for i in range(12)]
    raw = spark.createDataFrame(rows, "file string, message string")
    for k in range(3):
        raw.filter(F.col("file").isin([f"f{i}" for i in range(4 * k, 4 * k + 4)])).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.run_available(ingest.unique_messages(ingest.read_messages(spark, f"{tmp_path}/in", 1)), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == parse_messages(raw).select(body_key(F.col("body"))).distinct().count() == 4
    ingest.run_available(ingest.unique_messages(ingest.read_messages(spark, f"{tmp_path}/in", 1)), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
