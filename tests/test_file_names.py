"""File names of whole titles."""

from korpusflow.plans import catalog


def test_whole_text_is_translated(spark, tmp_path):
    text = "a title of forty characters and then: " + 'x/y\\z|"q"?*<b> ' * 9
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalog.QUERIES["file_names"](spark, str(tmp_path)).first().file_name
    assert got == text.translate(str.maketrans('<>:"/\\|?* ', "_" * 10)) and len(got) == len(text) > 40
