"""What an operator returns does not plan its earlier steps again."""

from tidemark.llm import decontaminate


def test_clean_returns_one_join(spark):
    """The documents against the found ones; before, the plan of a result held fingerprints and verification too."""
    item = " ".join(f"word{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"a {item} z"), (2, "nothing of it"), (3, None)], "doc_id long, text string")
    kept = decontaminate.clean(docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
