from quire.llm import queries


def test_p4_found_on_a_fixture(spark, tmp_path):
    spark.createDataFrame([("r1", "a", "ベルカ、走れ！"), ("r2", "a", "x y"), ("r3", "b", "ベルカ、走れ！"), ("r4", None, "q"), ("r5", "a", None)], "region_id string, asset_id string, expected string").write.parquet(
        str(tmp_path / "evaluation_regions.parquet")
    )
    reads = [("f1", "a", "べル力､走れ!"), ("f1", "a", "べル力､走れ!"), ("f2", "a", "ベルカ、走れ！"), ("f3", "a", "x　y"), ("f4", "b", "ヘルカ、走れ！"), ("f5", None, "ｑ"), ("f6", "a", None), ("f7", "a", "")]
    spark.createDataFrame(reads, "fragment_id string, asset_id string, ocr_text string").write.parquet(str(tmp_path / "fragments.parquet"))
    assert {tuple(r) for r in queries.p4_found(spark, str(tmp_path)).collect()} == {("f1", "r1"), ("f3", "r2")}
