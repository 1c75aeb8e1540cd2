"""Unions keep the rows of a key together."""

from pyspark.sql import functions as F

from pagewright.operators import resume


def test_a_difference_of_lists_that_are_dealt_by_address(spark):
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
    left = spark.range(2000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    one = left.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    other = one.join(left.distinct().hint("merge"), "url", "left_semi")
    assert resume.incomplete(one.union(one.limit(0)), other).count() == 0
