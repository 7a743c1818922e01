from pyspark.sql import functions as F

from veriloom.plans.prefix import running_total
from veriloom.plans.session import stage


def test_running_total_with_hot_group_and_nulls(spark):
    rows = [("a", i, 1) for i in range(500)] + [("b", 1, 2), ("b", 2, None), (None, 1, 5), (None, 2, 6)]
    df = spark.createDataFrame(rows, "g string, o int, w int")
    got = {(r.g, r.o): r.t for r in running_total(df, ["g"], [F.col("o").desc()], "w", "t").collect()}
    assert got["a", 499] == 1 and got["a", 0] == 500
    assert got["b", 2] == 0 and got["b", 1] == 2
    assert got[None, 2] == 6 and got[None, 1] == 11
    assert len(got) == len(rows)


def test_running_total_without_groups_and_empty(spark):
    df = spark.range(100).withColumn("w", F.lit(1))
    got = {r.id: r.t for r in running_total(df, [], [F.col("id")], "w", "t").collect()}
    assert got == {i: i + 1 for i in range(100)}
    assert running_total(df.limit(0), [], [F.col("id")], "w", "t").count() == 0


def test_stage_keeps_schema_of_empty_table(spark):
    df = spark.createDataFrame([], "a int, b array<string>")
    assert stage(df, "t").schema == df.schema and stage(df, "t").count() == 0
