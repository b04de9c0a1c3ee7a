from pyspark.sql import functions as F

from loomtext import profiling


def test_figures_of_a_job(spark):
    def work():
        rows = spark.range(200_000, numPartitions=3).groupBy((F.col("id") % 1000).alias("k")).count()
        rows.mapInArrow(lambda batches: batches, rows.schema).write.format("noop").mode("overwrite").save()

    got = profiling.measured(spark, work)
    assert got["stages"] >= 2 and got["tasks"] >= 4 and got["seconds"] > 0 and got["shuffle_bytes"] > 1000 and got["spill_bytes"] == 0
    assert got["jvm_mb"] > 100 and got["worker_mb"] > 10 and got["workers_mb"] >= got["worker_mb"]
    assert profiling.measured(spark, lambda: None)["stages"] == 0
