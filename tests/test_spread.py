from pyspark.sql import functions as F

from corvid.session import spread


def test_many_rows_of_one_file_are_dealt(spark):
    """above a million test rows the table was left as its file lay, in one task."""
    one = spark.range(100).coalesce(1).withColumn("v", F.lit(1.0))
    assert spread(one, 1e12, 2_000_000).rdd.getNumPartitions() >= 40
    assert spread(one, 10.0, 100).rdd.getNumPartitions() == 1


def test_tasks_come_in_whole_waves(spark):
    """F2-F10's step in knn_accuracy: 10 equal tasks on 8 cores took as long as 16."""
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert cores > 1
    assert spread(one, 1e12, 50_000 * (cores + 1)).rdd.getNumPartitions() == 2 * cores
    assert spread(one, 1e12, 50_000 * cores).rdd.getNumPartitions() == cores
