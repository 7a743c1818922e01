import numpy as np
from test_similar import brute

from veriloom.llm import queries


def test_every_vector_gets_its_five_nearest_and_pairs_keep_the_cutoff(spark, tmp_path):
    x = np.random.default_rng(8).normal(size=(300, 16)).astype(np.float32)
    x[1] = x[0] + 0.01
    spark.createDataFrame([("m", "ip", 16)], "method string, metric string, dim int").write.parquet(f"{tmp_path}/methods.parquet")
    rows = [("m", f"i{i:04d}", v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "method string, item_id string, vec array<float>").write.parquet(f"{tmp_path}/descriptors_vec.parquet")
    got = {(int(r.item_id[1:]), int(r.other[1:])) for r in queries.p3_neighbours(spark, str(tmp_path)).collect()}
    assert len(got) == 5 * len(x) and len(got & brute(x, 5, -1.0, "ip")) >= 0.97 * len(got)
    assert {(r.item_a, r.item_b) for r in queries.p3_found(spark, str(tmp_path)).collect()} == {("i0000", "i0001")}
