"""unwind and unwind_preserve split every text."""

from collections import Counter

from tessera import queries


def test_unwind_splits_every_text(spark, tmp_path):
    spark.createDataFrame([(0, "a b a"), (1, "b"), (3, "c b"), (4, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.w: r.n for r in queries.unwind(spark, str(tmp_path)).collect()} == Counter("abacbb")
    assert {r.doc_id: r.n for r in queries.unwind_preserve(spark, str(tmp_path)).collect()} == {0: 3, 1: 1, 3: 2, 4: 1}
