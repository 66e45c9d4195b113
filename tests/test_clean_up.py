"""Intermediate tables can be deleted by those who made them."""
import os

from meshwork.plans.session import clean_up, stored


def test_only_own_intermediate_tables_go(spark):
    clean_up(spark)
    kept = spark.range(3)
    kept.write.mode("overwrite").parquet(f"{spark.sparkContext.getCheckpointDir()}/of-the-user")
    df = stored(spark.range(5))
    place = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.exists(place)
    assert clean_up(spark) == 1 and not os.path.exists(place) and clean_up(spark) == 0
    assert spark.read.parquet(f"{spark.sparkContext.getCheckpointDir()}/of-the-user").count() == 3
