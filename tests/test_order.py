import __spark_entry__ as entry

DATA = "/root/testdata/sf0.01"


def test_mean_accuracy_does_not_depend_on_the_layout_of_documents(spark, tmp_path):
    """The mean of (beta, heavy) is 0.5003125 within the error of a sum of doubles: its last digit tells in which order they were added."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = []
    for i, n in enumerate((1, 3, 8, 40)):
        docs.repartition(n, "text").write.parquet(f"{tmp_path}/{i}/documents.parquet")
        found.append({(r.config, r.attack): r.bit_acc_mean for r in entry.queries()["bit_accuracy_by_attack"](spark, f"{tmp_path}/{i}").collect()})
    assert found[0]["beta", "heavy"] == 0.500312 and all(f == found[0] for f in found)
