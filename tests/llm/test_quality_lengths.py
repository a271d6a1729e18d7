"""The verdict on labelled documents too short for the limits of long ones."""

from pyspark.sql import functions as F

from tracewright.llm import quality


def test_short_bad_documents_are_rejected(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    short = quality.judge(d).join(labels, "doc_id").filter("NOT base_failed AND n_words < 200")
    kept = {r.quality: (r.kept, r.n) for r in short.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    assert kept[0][1] >= 10 and kept[0][0] <= 0.1 and kept[1][0] >= 0.98


def test_limits_fall_with_length(spark):
    lengths = spark.createDataFrame([(n,) for n in (0, 19, 20, 59, 60, 99, 100, 149, 150, 5000)], "n_words long")
    for table in (quality.MOST_CLASS_DISTANCE, quality.MOST_COMMON_DISTANCE):
        got = [r[0] for r in lengths.orderBy("n_words").select(quality.limit(table)).collect()]
        assert got[:2] == [1.0, 1.0] and got == sorted(got, reverse=True) and got[-1] == table[0][1]
