"""Records still to be processed, by content."""

from cinderloom.plans.analytics import QUERIES


def test_remaining(spark, tmp_path):
    records = [(0, "p", "a"), (1, "p", "b"), (2, None, "a"), (3, "q", None), (4, None, None), (5, "p", "a"), (6, "new", None)]
    rollouts = [(1, "p", "a", "known"), (2, None, "a", "known"), (3, "q", None, None), (4, "q", "z", None)]
    spark.createDataFrame(records, "pos long, prompt string, answer string").write.parquet(f"{tmp_path}/records.parquet")
    spark.createDataFrame(rollouts, "row_id long, prompt string, ground_truth string, data_type string").write.parquet(f"{tmp_path}/rollouts.parquet")
    assert {r.pos for r in QUERIES["resume_remaining"](spark, str(tmp_path)).collect()} == {1, 4, 6}
