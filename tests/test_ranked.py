"""The best classes of a row whose scores stand together."""

from pyspark.sql import functions as F


def test_scores_of_a_row_are_ranked_where_they_are(spark):
    from scrivena.operators import evaluation as ev

    wide = spark.createDataFrame([(1, 2, [(0.5, 0), (0.5, 1), (0.9, 2)]), (2, 0, [(0.1, 0)]), (3, 1, [(None, 0), (0.2, 1)])], "id long, true_class int, scores array<struct<score: double, class: int>>")
    long = wide.select("id", "true_class", F.explode("scores").alias("s")).select("id", "true_class", "s.*")
    top = {r.id: (r.true_class, r.top) for r in ev.ranked_rows(wide, "id", 2).collect()}
    assert top == {r.id: (r.true_class, r.top) for r in ev.ranked_scores(long, "id", 2).collect()} and [t["class"] for t in top[1][1]] == [2, 1]


def test_top_k_queries_shuffle_no_row_for_each_class(spark):
    from scrivena.plans import reporting_queries as rq

    plan = rq.ranked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Generate explode" not in plan and "collect_list" not in plan
