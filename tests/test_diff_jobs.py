from scoreloom.plans import score_queries


def test_diff_ends_in_a_plan_of_written_issues(spark):
    """Not one plan of all comparisons, which the driver would hold at once."""
    files = score_queries.s_score_diff(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/issues/" in f for f in files)
