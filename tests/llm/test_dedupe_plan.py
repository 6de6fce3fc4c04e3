"""What jaccard_dedupe shuffles."""

from stratalog.llm.jaccard import jaccard_dedupe


def test_few_dropped_rows_go_to_the_documents(spark):
    """Whether the keys of the dropped rows are broadcast or all rows shuffled, the same rows stay; broadcast does not depend on Spark's own threshold."""
    words = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)]
    docs = spark.createDataFrame([(i, words[i % 20] + (" end" if i >= 20 else "")) for i in range(50)], "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = jaccard_dedupe(docs), jaccard_dedupe(docs, most_broadcast=0)
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (few, many)]
        assert sorted(r["doc_id"] for r in few.collect()) == sorted(r["doc_id"] for r in many.collect()) == list(range(20))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]
