from lodestrata import queries
from lodestrata.operators import redundancy
from lodestrata.plans.cutting import stage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_stay_where_they_are(spark):
    """labels meet the few sizes of clusters without being dealt out or sorted, and pairs of columns come from a point's row."""
    labels = stage(spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 3), (2, 1, 1)], "mask long, p long, label long"))
    found = redundancy.min_size_filter(labels, 2)
    assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, 2), (1, 2, 1, 2)]
    twos = queries._labels(spark, "/root/testdata/sf0.001", 5)[1]
    assert "SortMergeJoin" not in plan(twos)
    points = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert twos.count() == 10 * points and twos.select("mask").distinct().count() == 10
