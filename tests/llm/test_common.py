"""The bitmap that tells which rows need a join."""

from pyspark.sql import functions as F

from spanloom.llm.common import split_by_keys


def test_no_partner_is_missed(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("k"), F.lit("x").alias("_bits"))
    found = rows.where("id % 11 = 0").select("id", "k")
    may, cannot = split_by_keys(rows, found, "id", "k")
    assert may.columns == cannot.columns == rows.columns
    assert may.join(found, ["id", "k"]).count() == found.count()
    assert may.count() + cannot.count() == 5000 and may.count() < found.count() + 50
    assert split_by_keys(rows, found.where("1 = 0"), "id", "k")[0].count() == 0


def test_null_keys_stay(spark):
    rows = spark.createDataFrame([(1,), (None,), (None,)], "id bigint")
    may, cannot = split_by_keys(rows, rows.where("id = 1"), "id")
    assert may.count() == 1 and cannot.count() == 2
