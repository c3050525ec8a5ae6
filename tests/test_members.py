from lodestrata.plans.clustering import Clustering
from lodestrata.plans.cutting import stage


def test_members_of_large_regions_are_not_written_again(spark):
    """F1 F2 F3 F5: the table itself where all regions have enough points; else those that have."""
    coords = spark.createDataFrame([(p, 0, p / 9) for p in range(10)], "p long, dim int, x double")
    members = stage(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "region long, p long"))
    one, two = (Clustering(coords, 1, 0.1, 1.0, 1, n) for n in (1, 2))
    kept, rows = one._sizable(members, "kept")
    assert kept is members and rows == 3
    kept, rows = two._sizable(members, "kept")
    assert sorted(map(tuple, kept.collect())) == [(1, 1), (1, 2)] and rows == 2
    kept, rows = two._sizable(members.filter("p > 9"), "kept")
    assert not rows
