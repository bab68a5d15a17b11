from conftest import rows

from postpulse.operators.align import align_news, time_histogram


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "epoch long")


def test_histogram_keeps_empty_bins_and_right_end(spark):
    found = rows(time_histogram(frame(spark, [0, 1, 9, 10, 95, 100, None]), 10), "bin", "n")
    counts = {1: 3, 2: 1, 10: 2}
    assert found == sorted(((b, counts.get(b, 0)) for b in range(1, 11)), key=lambda r: str(r[0]))


def test_histogram_of_one_value_and_of_nothing(spark):
    single = time_histogram(frame(spark, [7, 7]), 4).orderBy("bin").collect()
    assert [r["n"] for r in single] == [0, 0, 2, 0]
    assert (single[0]["lo"], single[-1]["hi"]) == (6.5, 7.5)
    assert rows(time_histogram(frame(spark, []))) == []


def test_news_outside_the_posts_are_not_shown(spark):
    news = spark.createDataFrame([("a", -1), ("b", 0), ("c", 55), ("d", 100), ("e", 101)],
                                 "title string, epoch long")
    found = align_news(frame(spark, [0, 1, 100]), news)
    assert rows(found, "title", "bin", "posts") == [("b", 1, 2), ("c", 6, 0), ("d", 10, 1)]
