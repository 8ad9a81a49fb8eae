"""The URL classifier's rows are made once and dealt by number."""

import pytest
from pyspark.sql import functions as F

from wardline.operators import models


def test_url_classifier_reads_its_rows_once_and_in_many_tasks(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(i):
        read.add(1)
        return i

    rows = spark.range(2500, numPartitions=1).withColumn("id", F.udf(seen, "long")("id"))
    bad = F.col("id") % 3 == 0
    rows = rows.select(F.concat(F.when(bad, F.lit("http://login-verify.xyz/")).otherwise(F.lit("https://example.org/")), F.col("id").cast("string")).alias("url"), bad.cast("int").alias("label"), "id")
    model = models.url_classifier_fit(rows, trees=20, depth=5)
    assert read.value == 2500
    found = models.url_classifier_predict(model, rows).select("id", "p")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert [(r.id, r.p > 0.5) for r in found.orderBy("id").collect()] == [(i, i % 3 == 0) for i in range(2500)]


def test_url_classifier_needs_rows(spark):
    with pytest.raises(ValueError, match="need at least 100 rows, got 3"):
        models.url_classifier_fit(spark.createDataFrame([("http://a.b/", 1), ("http://a.b/", 1), (None, 0)], "url string, label int"))
